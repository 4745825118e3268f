"""Every query of the library outside the training-data subpackage, with its SQL.

Queries take (spark, sf_dir) and read the driver's tables whole, in the shape that each operator needs.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import providers, values
from foliant.operators import calc, chunk, evaluate, facts, indicators, news, parse, search, status, store, verify
from foliant.plans import ingest, star
from foliant.streaming import ingest as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
FLAGSHIP = "V4_hybrid_searches"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return star.securities(spark, d), star.filings(spark, d), star.chunks(spark, d)


_WITH = f"WITH {star.SQL}"
# chunks are counted by filing and filings by security before securities are looked at
_SUMMARY = """SELECT ticker, first_filed, last_filed, CAST(coalesce(n, 0) AS BIGINT) AS filings, CAST(coalesce(done, 0) AS BIGINT) AS embedded, CAST(coalesce(n - done - gone, 0) AS BIGINT) AS partial, CAST(coalesce(gone, 0) AS BIGINT) AS failed, CAST(coalesce(pieces, 0) AS BIGINT) AS chunks, CAST(coalesce(vectors, 0) AS BIGINT) AS embedded_chunks FROM securities
  LEFT JOIN (SELECT security_id, min(filed_date) AS first_filed, max(filed_date) AS last_filed, count(*) AS n, sum(CASE status WHEN 'embedded' THEN 1 ELSE 0 END) AS done, sum(CASE status WHEN 'failed' THEN 1 ELSE 0 END) AS gone, sum(coalesce(k, 0)) AS pieces, sum(coalesce(e, 0)) AS vectors
    FROM filings LEFT JOIN (SELECT filing_id, count(*) AS k, sum(CAST(embedded AS INTEGER)) AS e FROM chunks GROUP BY filing_id) t ON t.filing_id = filings.id GROUP BY security_id) y ON y.security_id = securities.id"""


# --- corpus status ----------------------------------------------------------------------------------


@query(f"{_WITH} {_SUMMARY}")
def E1_corpus_summary(spark, d):
    return status.summary(*_store(spark, d))


@query(f"{_WITH} SELECT s.ticker, f.accession_number, f.filing_type, f.filed_date, f.status, count(c.filing_id) AS chunks, count(c.filing_id) FILTER (WHERE c.embedded) AS embedded_chunks FROM filings f JOIN securities s ON s.id = f.security_id LEFT JOIN chunks c ON c.filing_id = f.id GROUP BY ALL")
def E2_per_filing(spark, d):
    return status.per_filing(*_store(spark, d))


@query(f"{_WITH} SELECT ticker, accession_number, filing_type, filed_date, status FROM filings f JOIN securities s ON s.id = f.security_id WHERE status <> 'embedded'")
def E3_issues(spark, d):
    s, f, _ = _store(spark, d)
    return status.issues(s, f)


@query(f"{_WITH} SELECT sum(filings) AS filings, sum(embedded) AS embedded, sum(partial) AS partial, sum(failed) AS failed, sum(chunks) AS chunks, sum(embedded_chunks) AS embedded_chunks, round(sum(embedded_chunks) * 100.0 / sum(chunks), 4) AS embedded_percent FROM ({_SUMMARY})")
def E4_totals(spark, d):
    return status.totals(status.summary(*_store(spark, d)))


@query(f"{_WITH} SELECT count(*) AS chunks, min(token_count) AS least, round(avg(token_count), 6) AS mean, max(token_count) AS most FROM chunks")
def E5_token_stats(spark, d):
    return status.token_stats(star.chunks(spark, d))


@query(f"{_WITH} SELECT ticker, CASE WHEN chunks > 0 THEN round(embedded_chunks * 100.0 / chunks, 4) END AS embedded_percent FROM ({_SUMMARY})")
def E6_embedded_percent(spark, d):
    return status.summary(*_store(spark, d)).select("ticker", status.percent("embedded_chunks", "chunks").alias("embedded_percent"))


@query(f"{_WITH} SELECT id, accession_number, status, filed_date FROM filings WHERE accession_number IN (SELECT max(accession_number) FROM filings) OR security_id = 3")
def A13_keyed_scans(spark, d):
    f = star.filings(spark, d)
    top = f.agg(F.max("accession_number").alias("m"))
    return f.join(F.broadcast(top)).where((F.col("accession_number") == F.col("m")) | (F.col("security_id") == 3)).select("id", "accession_number", "status", "filed_date")


@query(f"{_WITH} SELECT id, filed_date, status FROM filings WHERE status IN ('parsed', 'failed') ORDER BY filed_date DESC, id LIMIT 50")
def A14_by_status(spark, d):
    return status.by_status(star.filings(spark, d), ["parsed", "failed"], 50).select("id", "filed_date", "status")


@query(f"{_WITH} SELECT accession_number, filing_id, chunk_index FROM chunks c JOIN filings f ON f.id = c.filing_id WHERE NOT embedded")
def A15_without_embeddings(spark, d):
    _, f, c = _store(spark, d)
    return status.without_embeddings(f, c)


@query("SELECT c_mktsegment AS ticker, o_orderpriority AS filing_type, strftime(o_orderdate, '%Y-%m') AS fiscal_period, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(38,4))) AS DOUBLE), 2) AS revenue FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL")
def A16_metric_trend(spark, d):
    o, c = star.read(spark, d, "orders"), star.read(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    g = j.groupBy(F.col("c_mktsegment").alias("ticker"), F.col("o_orderpriority").alias("filing_type"), F.date_format("o_orderdate", "yyyy-MM").alias("fiscal_period"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(38,4)")).cast("double"), 2).alias("revenue"))


@query(f"{_WITH}, k AS (SELECT * FROM filings WHERE status <> 'parsed') SELECT f.accession_number, k.id IS NOT NULL AS in_corpus, k.status AS corpus_status FROM filings f LEFT JOIN k ON k.accession_number = f.accession_number")
def D5_in_corpus(spark, d):
    f = star.filings(spark, d)
    return status.in_corpus(f.select("accession_number"), f.where("status <> 'parsed'"))


@query(f"{_WITH} SELECT accession_number, filed_date FROM filings f WHERE NOT EXISTS (SELECT 1 FROM filings k WHERE k.status <> 'parsed' AND k.accession_number = f.accession_number)")
def D6_new_filings(spark, d):
    f = star.filings(spark, d)
    return status.new_filings(f.select("accession_number", "filed_date"), f.where("status <> 'parsed'"))


@query(f"{_WITH} SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'parsed') AS already, count(*) FILTER (WHERE status = 'parsed') AS new FROM filings")
def D6_new_counts(spark, d):
    f = star.filings(spark, d)
    return status.new_counts(f.select("id"), f.where("status <> 'parsed'"), "id")


# --- sources and sinks ------------------------------------------------------------------------------


@query("SELECT o_custkey AS filer, o_orderkey AS accession_number, o_orderpriority AS form, CAST(o_orderdate AS DATE) AS filing_date FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1996-01-01'")
def A1_list_filings(spark, d):
    o = star.read(spark, d, "orders")
    row = F.struct("o_orderkey", F.col("o_orderpriority").alias("form"), F.to_date("o_orderdate").alias("day"))
    arrays = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("r"))  # a filer's list
    part = lambda c: F.transform("r", lambda x: x[c]).alias(c)
    told = arrays.select("o_custkey", part("o_orderkey"), part("form"), part("day"))
    rows = told.select(F.col("o_custkey").alias("filer"), F.inline(F.arrays_zip("o_orderkey", "form", "day")))
    return rows.where(F.col("form").isin("1-URGENT", "2-HIGH") & (F.col("day") >= F.lit(date(1996, 1, 1)))).select("filer", F.col("o_orderkey").alias("accession_number"), "form", F.col("day").alias("filing_date"))


@query("SELECT o_custkey AS filer, CASE WHEN bool_or(o_orderpriority = '5-LOW') THEN '20-F,6-K' ELSE '10-K,10-Q,8-K' END AS forms FROM orders GROUP BY o_custkey")
def A2_default_forms(spark, d):
    from foliant.sources import filings

    o = star.read(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderpriority") == "5-LOW", "20-F").otherwise("10-K").alias("form"))
    return o.groupBy(F.col("o_custkey").alias("filer")).agg(F.array_join(filings.default_forms(F.collect_set("form")), ",").alias("forms"))


@query("SELECT user_id AS ticker, min(src) AS source, count(*) FILTER (WHERE src = best) AS bars FROM (SELECT user_id, src, min(CASE WHEN n >= 30 THEN src END) OVER (PARTITION BY user_id) AS best FROM (SELECT user_id, event_id % 2 AS src, count(*) OVER (PARTITION BY user_id, event_id % 2) AS n FROM events)) WHERE src = best GROUP BY user_id")
def A8_preferred_bars(spark, d):
    e = star.read(spark, d, "events").select(F.col("user_id").alias("ticker"), (F.col("event_id") % 2).alias("source"))
    best = indicators.prefer([e.where("source = 0"), e.where("source = 1")], enough=30)
    return best.groupBy("ticker").agg(F.min("source").alias("source"), F.count("*").alias("bars"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-25'")
def A9_bounded_json(spark, d):
    e = star.read(spark, d, "events").where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-25").cast("timestamp")))
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0")
def B1_upsert(spark, d):
    c = star.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    old = c.where("id % 5 <> 0")
    first = c.where("id % 3 = 0").withColumn("seq", F.lit(1)).withColumn("name", F.lit("superseded"))
    last = c.where("id % 3 = 0").withColumn("seq", F.lit(2)).withColumn("name", F.upper("name"))
    changed = last.withColumn("balance", F.when(F.col("id") % 5 == 0, F.col("balance")).otherwise(F.lit(-1.0)))  # not overwritten where the row exists
    return store.upsert(old, first.unionByName(changed), ["id"], ["name"], "seq")


@query(f"{_WITH} SELECT id, CASE WHEN id % 4 = 0 THEN 'failed' WHEN id % 2 = 0 THEN 'chunked' ELSE status END AS status FROM filings")
def B3_mark_status(spark, d):
    f = star.filings(spark, d).select("id", "status")
    changes = f.where("id % 2 = 0").select("id", F.lit("chunked").alias("status"), F.lit(1).alias("seq")).unionByName(f.where("id % 4 = 0").select("id", F.lit("failed").alias("status"), F.lit(2).alias("seq")))
    return store.set_status(f, changes)


@query("SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN CAST(label AS FLOAT) ELSE embedding[1] END AS first FROM embeddings")
def B5_update_embeddings(spark, d):
    e = star.read(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    new = e.where("id % 2 = 0").select("id", F.array(F.col("label").cast("float")).alias("embedding"))
    return store.set_embeddings(e.select("id", "embedding"), new).select("id", F.get("embedding", F.lit(0)).alias("first"))


@query("SELECT doc_id, source, CASE WHEN source IN ('src1', 'src2') THEN upper(lang) ELSE lang END AS lang FROM documents WHERE source NOT IN ('src1', 'src2') OR doc_id % 40 < 20")
def B7_replace_by_source(spark, d):
    docs = star.read(spark, d, "documents").select("doc_id", "source", "lang")
    new = docs.where(F.col("source").isin("src1", "src2") & (F.col("doc_id") % 40 < 20)).withColumn("lang", F.upper("lang"))
    return store.replace_by_source(docs, new)


# --- predicates and projections ---------------------------------------------------------------------


@query("SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE upper(c_mktsegment) IN ('BUILDING', 'FURNITURE') AND o_orderpriority IN ('1-URGENT') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def C1_filters(spark, d):
    o, c = star.read(spark, d, "orders"), star.read(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), F.upper("c_mktsegment").alias("ticker"), F.col("o_orderpriority").alias("filing_type"), F.to_date("o_orderdate").alias("filed_date"))
    wanted = search.Filters(tickers=["building", "Furniture"], filing_types=["1-URGENT"], filed_after=date(1995, 1, 1), filed_before=date(1996, 12, 31))
    return j.where(wanted.predicate()).select("id")


@query("SELECT o_custkey AS id FROM orders GROUP BY o_custkey HAVING list_has_any(list(DISTINCT o_orderpriority), ['1-URGENT', '4-NOT SPECIFIED'])")
def C3_path_overlap(spark, d):
    p = star.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("section_path"))
    return p.where(search.Filters(section_path_contains=["1-URGENT", "4-NOT SPECIFIED"]).predicate()).select("id")


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END AS preview FROM documents")
def C7_preview(spark, d):
    return star.read(spark, d, "documents").select("doc_id", values.preview(F.col("text")).alias("preview"))


@query(f"{_WITH} SELECT f.id, '[' || s.ticker || ' ' || f.filing_type || ' ' || year(f.filed_date) || CASE WHEN f.id % 2 = 0 THEN ' §Item ' || (f.id % 10) ELSE '' END || ']' AS citation FROM filings f JOIN securities s ON s.id = f.security_id")
def C8_citation(spark, d):
    s, f, _ = _store(spark, d)
    path = F.when(F.col("id") % 2 == 0, F.array(F.lit("Part I"), F.concat(F.lit("Item "), (F.col("id") % 10).cast("string")))).otherwise(F.array(F.lit("Part I")))
    j = f.join(s.select(F.col("id").alias("security_id"), "ticker"), "security_id").withColumn("section_path", path)
    return j.select("id", values.citation("ticker", "filing_type", "filed_date", "section_path").alias("citation"))


@query("SELECT c_nationkey AS query_id, string_agg(c_name || ' (similarity ' || printf('%.3f', c_custkey / 8.0) || ')' || chr(10) || c_mktsegment || ' > ' || 'x' || chr(10) || 'text', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY c_custkey) AS block FROM customer GROUP BY c_nationkey")
def C9_context_block(spark, d):
    c = star.read(spark, d, "customer")
    told = c.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("rank"), F.col("c_name").alias("citation"), (F.col("c_custkey") / 8).alias("similarity"), F.array("c_mktsegment", F.lit("x")).alias("section_path"), F.lit("text").alias("content"))
    return values.context_block(told)


@query("SELECT conv_id, turn, c.name AS citation FROM conversations, (SELECT unnest(['the', 'data', 'Item', 'of']) AS name) c WHERE contains(text, c.name)")
def D14_cited(spark, d):
    c = star.read(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("answer"))
    tags = c.select("query_id", F.explode(F.array(*map(F.lit, ["the", "data", "Item", "of"]))).alias("citation"))
    return values.cited(tags, c).select("query_id.conv_id", "query_id.turn", "citation")


# --- search -----------------------------------------------------------------------------------------

_NEAR = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
_TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains([{}], w))".format(", ".join(f"'{w}'" for w in sorted(search.STOP_WORDS)))


def _vectors(spark, d):
    e = star.read(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return e, e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"SELECT query_id, id, similarity, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_NEAR} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_NEAR} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.label <> 3) WHERE rank <= 10")
def V1_vector_search(spark, d):
    e, q = _vectors(spark, d)
    return search.by_vector(e, q, 10, F.col("label") != 3)


_LEXICAL = f"(SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT doc_id AS id, round(len(list_filter(t, lambda w: w IN ('ther', 'thand', 'ing'))) / len(t), 6) AS score FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_contains(t, 'ing')))"


@query(f"SELECT id, score, rank FROM {_LEXICAL.replace(chr(39) + 'ther' + chr(39) + ', ' + chr(39) + 'thand' + chr(39) + ', ', '')} WHERE rank <= 20")
def V2_text_search(spark, d):
    docs = star.read(spark, d, "documents").withColumnRenamed("doc_id", "id")
    return search.by_text(docs, "the ing of", 20)


@query(f"""WITH v AS (SELECT id, rank FROM (SELECT e.vec_id AS id, row_number() OVER (ORDER BY {_NEAR} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id = 0) WHERE rank <= 30),
t AS (SELECT id, rank FROM {_LEXICAL.replace(chr(39) + 'ther' + chr(39) + ', ' + chr(39) + 'thand' + chr(39) + ', ', '')} WHERE rank <= 30),
b AS (SELECT coalesce(v.id, t.id) AS id, v.rank AS vector_rank, t.rank AS text_rank, round(coalesce(1.0 / (60 + v.rank), 0.0) + coalesce(1.0 / (60 + t.rank), 0.0), 9) AS score FROM v FULL JOIN t ON v.id = t.id)
SELECT * FROM (SELECT id, score, vector_rank, text_rank, row_number() OVER (ORDER BY score DESC, vector_rank ASC NULLS LAST, text_rank ASC NULLS LAST) AS rank FROM b) WHERE rank <= 10""")
def V4_hybrid_search(spark, d):
    e, q = _vectors(spark, d)
    docs = star.read(spark, d, "documents").withColumnRenamed("doc_id", "id")
    vector = search.by_vector(e, q.where("query_id = 0"), 30)
    return search.fuse(vector, search.by_text(docs, "ing", 30), 10)


#: Each query's words are the first three terms of the document of its number.
_HYBRID = f"""d AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents),
q AS (SELECT vec_id AS query_id, list_distinct(t[1:3]) AS w FROM embeddings JOIN d ON id = vec_id WHERE vec_id % 20 = 0),
v AS (SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_NEAR} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 30),
t AS (SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(len(list_filter(t, lambda x: list_contains(w, x))) / len(t), 6) AS score FROM d, q WHERE len(w) > 0 AND list_has_all(t, w))) WHERE rank <= 30),
b AS (SELECT query_id, id, v.rank AS vector_rank, t.rank AS text_rank, round(coalesce(1.0 / (60 + v.rank), 0.0) + coalesce(1.0 / (60 + t.rank), 0.0), 9) AS score FROM v FULL JOIN t USING (query_id, id)),
h AS (SELECT * FROM (SELECT query_id, id, score, vector_rank, text_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank ASC NULLS LAST, text_rank ASC NULLS LAST) AS rank FROM b) WHERE rank <= 10)"""


@query(f"WITH {_HYBRID} SELECT query_id, id, score, vector_rank, text_rank, rank FROM h")
def V4_hybrid_searches(spark, d):
    e, q = _vectors(spark, d)
    docs = star.read(spark, d, "documents").withColumnRenamed("doc_id", "id")
    asked = q.join(docs.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.array_join(F.slice(search.terms("text"), 1, 3), " ").alias("query_text")), "query_id", "left")
    return search.fuse(search.by_vector(e, q, 30), search.by_text(docs, asked, 30), 10)


@query(f"""WITH r AS (SELECT query_id AS sub, id, similarity AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_NEAR} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_NEAR} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10),
m AS (SELECT id, max(score) AS score, min(sub * 1000000 + rank) AS seen FROM r GROUP BY id)
SELECT id, score, rank FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, seen) AS rank FROM m) WHERE rank <= 10""")
def V5_merged_search(spark, d):
    e, q = _vectors(spark, d)
    ranked = search.by_vector(e, q, 10).select(F.col("query_id").alias("sub"), "id", F.col("similarity").alias("score"), "rank")
    return search.merge(ranked, 10)


@query(f"""WITH {_HYBRID}, m AS (SELECT id, max(score) AS score, min(query_id * 1000000 + rank) AS seen FROM h GROUP BY id)
SELECT id, score, rank FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, seen) AS rank FROM m) WHERE rank <= 10""")
def V5_merged_hybrid(spark, d):
    ranked = V4_hybrid_searches(spark, d).select(F.col("query_id").alias("sub"), "id", "score", "rank")
    return search.merge(ranked, 10)


_ROUTES = ["Compare revenue of A vs B", "margin as a % of revenue", "supply chain exposure", "What is the moat?", "Revenue in 2024", "growing much faster", "EBITDA trend"]


@query("SELECT doc_id, CASE WHEN regexp_matches(q, '{}') THEN 'decompose' WHEN regexp_matches(q, '{}') THEN 'expand' END AS route FROM (SELECT doc_id, [{}][CAST(doc_id % 7 AS INTEGER) + 1] || ' ' || lang AS q FROM documents)".format(search.DECOMPOSE, search.EXPAND, ", ".join(f"'{q}'" for q in _ROUTES)))
def V9_route(spark, d):
    docs = star.read(spark, d, "documents")
    q = F.concat(F.get(F.array(*map(F.lit, _ROUTES)), (F.col("doc_id") % 7).cast("int")), F.lit(" "), F.col("lang"))
    return docs.select("doc_id", search.route(q).alias("route"))


@query("SELECT doc_id, CASE WHEN len(k) > 0 THEN array_to_string(k, '|') ELSE 'q' END AS subs FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(lower(x), 'rewritten') AND NOT starts_with(lower(x), 'original')) AS k FROM documents)")
def V10_sub_queries(spark, d):
    return star.read(spark, d, "documents").select("doc_id", F.array_join(search.sub_queries(F.col("text"), F.lit("q")), "|").alias("subs"))


# --- indicators -------------------------------------------------------------------------------------


def _bars(spark, d):
    e = star.read(spark, d, "events")
    return e.select((F.col("user_id") % 10).cast("string").alias("ticker"), F.col("event_id").alias("ts"), F.round("value", 2).alias("close"), (F.col("event_id") % 97 + 1).alias("volume"))


_BARS = "bars AS (SELECT CAST(user_id % 10 AS VARCHAR) AS ticker, event_id AS ts, round(value, 2) AS close, event_id % 97 + 1 AS volume FROM events)"


@query(f"""WITH {_BARS}, r AS (SELECT ticker, ts, close, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS n,
  avg(close) OVER w50 AS s50, count(*) OVER w50 AS c50, avg(close) OVER w200 AS s200, count(*) OVER w200 AS c200, avg(close) OVER w20 AS m, stddev_pop(close) OVER w20 AS sd, count(*) OVER w20 AS c20, avg(volume) OVER w20 AS v, volume FROM bars
  WINDOW w50 AS (PARTITION BY ticker ORDER BY ts ROWS 49 PRECEDING), w200 AS (PARTITION BY ticker ORDER BY ts ROWS 199 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY ts ROWS 19 PRECEDING))
SELECT ticker, ts, close, round(CASE WHEN c50 = 50 THEN s50 END, 6) AS sma_50, round(CASE WHEN c200 = 200 THEN s200 END, 6) AS sma_200, round(CASE WHEN c20 = 20 THEN m + 2 * sd END, 6) AS bb_upper, round(CASE WHEN c20 = 20 THEN m END, 6) AS bb_mid, round(CASE WHEN c20 = 20 THEN m - 2 * sd END, 6) AS bb_lower, round(volume / v, 6) AS volume_ratio FROM r WHERE n = 1""")
def F4_rolling_indicators(spark, d):
    return indicators.indicators(_bars(spark, d)).select("ticker", "ts", F.round("close", 2).alias("close"), "sma_50", "sma_200", "bb_upper", "bb_mid", "bb_lower", "volume_ratio")


# --- news -------------------------------------------------------------------------------------------


def _articles(spark, d):
    e = star.read(spark, d, "events")
    return e.select(F.col("event_id").alias("ordinal"), F.concat(F.col("event_type"), F.lit("  "), (F.col("user_id") % 7).cast("string")).alias("headline"), F.when(F.col("event_id") % 11 == 0, F.lit(0)).otherwise(F.expr("datediff(ts, DATE '1970-01-01') * 86400L + hour(ts) * 3600 + minute(ts) * 60 + second(ts)")).alias("datetime"), F.col("event_type").alias("summary"))


_ARTICLES = """a AS (SELECT event_id AS ordinal, event_type || ' ' || (user_id % 7) AS story, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events),
c AS (SELECT *, CASE WHEN day IS NULL THEN 'missing' WHEN day NOT BETWEEN DATE '2024-01-05' AND DATE '2024-01-19' THEN 'window' ELSE 'kept' END AS early FROM a),
f AS (SELECT *, CASE WHEN early = 'kept' AND row_number() OVER (PARTITION BY early, day, story ORDER BY ordinal) > 1 THEN 'duplicate' ELSE early END AS fate FROM c)"""


@query(f"WITH {_ARTICLES} SELECT ordinal, day, story FROM f WHERE fate = 'kept' ORDER BY day DESC, ordinal LIMIT 60")
def N1_newest_stories(spark, d):
    found = news.classified(_articles(spark, d), date(2024, 1, 19), date(2024, 1, 5))
    return news.newest(found).select("ordinal", "day", "story")


@query(f"WITH {_ARTICLES} SELECT count(*) AS raw, count(*) FILTER (WHERE fate = 'missing') AS dropped_missing, count(*) FILTER (WHERE fate = 'window') AS dropped_window, count(*) FILTER (WHERE fate = 'duplicate') AS deduped, least(count(*) FILTER (WHERE fate = 'kept'), 60) AS kept, count(*) FILTER (WHERE fate = 'kept') > 60 AS truncated FROM f")
def E12_news_counters(spark, d):
    return news.counters(news.classified(_articles(spark, d), date(2024, 1, 19), date(2024, 1, 5)))


_SENTIMENT = "CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' ELSE 'neutral' END"


@query(f"SELECT ticker, count(*) FILTER (WHERE p AND s = 'positive') AS positive, count(*) FILTER (WHERE p AND s = 'negative') AS negative, count(*) FILTER (WHERE p AND s = 'neutral') AS neutral, CASE WHEN count(*) FILTER (WHERE p) > 0 THEN round((count(*) FILTER (WHERE p AND s = 'positive') - count(*) FILTER (WHERE p AND s = 'negative')) / count(*) FILTER (WHERE p), 6) ELSE 0.0 END AS net, count(*) FILTER (WHERE NOT p) AS excluded FROM (SELECT user_id AS ticker, {_SENTIMENT} AS s, value > 20 AS p FROM events) GROUP BY ticker")
def N5_sentiment(spark, d):
    e = star.read(spark, d, "events")
    items = e.select(F.col("user_id").alias("ticker"), F.expr(_SENTIMENT).alias("sentiment"), F.when(F.col("value") > 20, "primary").otherwise("mentioned").alias("relevance"))
    return news.sentiment(items, ["ticker"])


@query("SELECT batch, string_agg('[' || (position % 15) || '] ' || headline || chr(10) || substr(summary, 1, 600), chr(10) || chr(10) ORDER BY position) AS body FROM (SELECT CAST(floor(doc_id / 15) AS BIGINT) AS batch, doc_id AS position, source AS headline, text AS summary FROM documents) GROUP BY batch")
def N3_batches(spark, d):
    items = star.read(spark, d, "documents").select(F.col("doc_id").alias("position"), F.col("source").alias("headline"), F.col("text").alias("summary"))
    return news.batches(items, "X").select("batch", F.expr("substring(prompt, length('Company: X') + 3)").alias("body"))


@query("""WITH o AS (SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN '[' || user_id || ']' WHEN 2 THEN user_id || '.0' WHEN 3 THEN 'true' ELSE user_id || '.7' END AS ix, event_type AS s FROM events),
p AS (SELECT seq, s, TRY_CAST(nullif(regexp_extract(ix, '^\\s*"?\\[?([0-9]+)(?:\\.0+)?\\]?"?\\s*$', 1), '') AS INTEGER) AS position FROM o),
first AS (SELECT position, arg_min(s, seq) AS s FROM p WHERE position IS NOT NULL GROUP BY position)
SELECT doc_id AS position, CASE WHEN s = 'purchase' THEN 'positive' ELSE 'neutral' END AS sentiment, 'mentioned' AS relevance, first.position IS NULL AS unanswered FROM documents LEFT JOIN first ON first.position = doc_id""")
def N4_joined_output(spark, d):
    ix = F.expr("CASE event_id % 5 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN '[' || user_id || ']' WHEN 2 THEN user_id || '.0' WHEN 3 THEN 'true' ELSE user_id || '.7' END")
    out = star.read(spark, d, "events").select(F.col("event_id").alias("seq"), ix.alias("index"), F.when(F.col("event_type") == "purchase", "Positive").otherwise("bullish").alias("sentiment"), F.lit("sort of").alias("relevance"))
    return news.joined(star.read(spark, d, "documents").select(F.col("doc_id").alias("position")), out)


# --- chunks and parsing -----------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 520)) AS s FROM t WHERE len(w) > 0)
SELECT doc_id, CAST(s / 520 AS INTEGER) AS chunk_index, len(list_slice(w, s + 1, s + 600)) AS token_count, md5(array_to_string(list_slice(w, s + 1, s + 600), ' ')) AS content_md5 FROM s WHERE s = 0 OR s + 80 < len(w)""")
def J4_token_windows(spark, d):
    return chunk.windows(star.read(spark, d, "documents")).select("doc_id", "chunk_index", "token_count", F.md5("content").alias("content_md5"))


@query()
def J1_text_blocks(spark, d):
    return parse.blocks(star.read(spark, d, "pages"))


@query()
def J2_sections(spark, d):
    docs = star.read(spark, d, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("<p>Item "), (i % 16 + 1).cast("string"), F.lit(". Title</p><p>"), x, F.lit("</p>")))
    return parse.parse(docs.select(F.col("doc_id").alias("document_id"), F.array_join(lines, "").alias("html"), F.when(F.col("doc_id") % 2 == 0, "10-K").otherwise("20-F").alias("form_type")))


# --- verification and calculation -------------------------------------------------------------------


@query("SELECT doc_id, position, number FROM (SELECT doc_id, unnest(n) AS number, unnest(range(1, len(n) + 1)) AS position FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9][0-9,]*\\.?[0-9]*'), lambda x: regexp_replace(x, '\\.+$', '')) AS n FROM documents)) QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY position) = 1")
def K1_numbers(spark, d):
    docs = star.read(spark, d, "documents")
    every = F.transform(F.regexp_extract_all("text", F.lit(verify.NUMBER), F.lit(0)), lambda n: F.regexp_replace(n, r"\.+$", ""))
    first = docs.select("doc_id", every.alias("n"), F.explode(verify.numbers(F.col("text"))).alias("number"))
    return first.select("doc_id", F.array_position("n", F.col("number")).alias("position"), "number")


@query("SELECT doc_id, number, regexp_matches(b, '^(19|20)[0-9]{2}$') OR TRY_CAST(b AS DOUBLE) IS NULL OR (TRY_CAST(b AS DOUBLE) = floor(TRY_CAST(b AS DOUBLE)) AND TRY_CAST(b AS DOUBLE) < 100) AS structural FROM (SELECT DISTINCT doc_id, number, replace(number, ',', '') AS b FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[0-9][0-9,]*\\.?[0-9]*'), lambda x: regexp_replace(x, '\\.+$', ''))) AS number FROM documents))")
def K4_structural_numbers(spark, d):
    n = star.read(spark, d, "documents").select("doc_id", F.explode(verify.numbers(F.col("text"))).alias("number"))
    return n.select("doc_id", "number", verify.structural(F.col("number")).alias("structural"))


# turns hold no quotations, so each is put between marks, with a short one after it and a mark that is never closed
@query("""WITH p AS (SELECT conv_id, turn, string_split(replace(replace('said “' || text || '” and "' || role || '", "' || text, '“', '"'), '”', '"'), '"') AS p FROM conversations)
SELECT conv_id, turn, quote FROM (SELECT conv_id, turn, unnest(list_filter(p, lambda x, i: i % 2 = 0 AND i < len(p))) AS quote FROM p) WHERE length(quote) >= 15 AND len(list_filter(regexp_split_to_array(quote, '\\s+'), lambda w: w <> '')) >= 4""")
def K9_quotations(spark, d):
    said = F.concat(F.lit("said “"), "text", F.lit("” and \""), "role", F.lit("\", \""), "text")
    return star.read(spark, d, "conversations").select("conv_id", "turn", F.explode(verify.quotations(said)).alias("quote"))


@query("""SELECT count(*) AS benchmark, count(*) FILTER (WHERE contains(d.t, b.t)) AS quoted FROM (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM benchmark) b, (SELECT string_agg(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), chr(10)) AS t FROM (SELECT text FROM benchmark WHERE item_id % 2 = 0)) d""")
def K10_quote_match(spark, d):
    b = star.read(spark, d, "benchmark")
    corpus = b.where("item_id % 2 = 0").agg(F.array_join(F.collect_list(verify.normalized(F.col("text"))), "\n").alias("corpus"))  # the benchmark is bounded
    return b.join(F.broadcast(corpus)).agg(F.count("*").alias("benchmark"), F.count_if(F.contains("corpus", verify.normalized(F.col("text")))).alias("quoted"))


_PLAIN = """lower(trim(regexp_replace(translate(text, '“”‘’—–', '""''''--'), '\\s+', ' ', 'g')))"""


@query(f"""SELECT b.item_id, count(d.doc_id) AS documents, min(d.doc_id) AS first_document FROM (SELECT item_id, {_PLAIN} AS t FROM benchmark) b
LEFT JOIN (SELECT doc_id, {_PLAIN} AS t FROM documents) d ON contains(d.t, b.t) GROUP BY b.item_id""")
def K10_quotes_in_documents(spark, d):
    b = star.read(spark, d, "benchmark").select("item_id", verify.normalized(F.col("text")).alias("quote"))
    docs = star.read(spark, d, "documents").select("doc_id", verify.normalized(F.col("text")).alias("t"))
    found = docs.join(F.broadcast(b), F.contains("t", "quote"))  # the benchmark is a bounded set of queries
    counted = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_document"))
    return b.select("item_id").join(counted, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), "first_document")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 <> 0 THEN round_even(o_totalprice / (o_custkey % 7) * 100, 1) END AS ratio FROM orders")
def M1_ratio(spark, d):
    o = star.read(spark, d, "orders").withColumn("k", F.col("o_custkey") % 7)
    return o.select(F.col("o_orderkey").alias("id"), calc.ratio("o_totalprice", "k").alias("ratio"))


@query("SELECT run, seq, r FROM (SELECT user_id AS run, event_id AS seq, round_even(value, 2) AS r, event_type = 'error' AS bad FROM events) a WHERE bad AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type <> 'error' AND e.user_id = a.run AND round_even(e.value, 2) = a.r)")
def L7_unretried(spark, d):
    e = star.read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("value").alias("result"), (F.col("event_type") != "error").alias("passed"))
    return calc.unretried(e).select("run", "seq", F.bround("result", 2).alias("r"))


# --- analyst formulas -------------------------------------------------------------------------------

_FACTS = "f AS (SELECT c_mktsegment AS ticker, strftime(o_orderdate, '%Y') AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(38,2))) AS DOUBLE) AS revenue, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(38,2)) ELSE 0 END) AS DOUBLE) AS ocf, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(38,2)) ELSE 0 END) AS DOUBLE) AS capex FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


def _facts(spark, d):
    o, c = star.read(spark, d, "orders"), star.read(spark, d, "customer")
    price = F.col("o_totalprice").cast("decimal(38,2)")
    kinds = F.array(F.struct(F.lit("revenue").alias("k"), price.alias("v")), F.struct(F.lit("operating_cash_flow").alias("k"), F.when(F.col("o_orderstatus") == "F", price).otherwise(0).alias("v")), F.struct(F.lit("capex").alias("k"), F.when(F.col("o_orderpriority") == "1-URGENT", price).otherwise(0).alias("v")))
    long = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("ticker"), F.date_format("o_orderdate", "yyyy").alias("period"), F.explode(kinds).alias("x"))
    return long.groupBy("ticker", "period", F.col("x.k").alias("concept")).agg(F.sum("x.v").cast("double").alias("value"))


@query(f"WITH {_FACTS}, g AS (SELECT *, ocf - capex AS fcf FROM f), h AS (SELECT *, lag(fcf) OVER w AS pf, lag(revenue) OVER w AS pr FROM g WINDOW w AS (PARTITION BY ticker ORDER BY period)) SELECT ticker, period, round(fcf, 2) AS fcf, CASE WHEN pf > 0 THEN round((fcf - pf) / pf * 100, 4) END AS fcf_growth, CASE WHEN pr > 0 THEN round((revenue - pr) / pr * 100, 4) END AS revenue_growth FROM h")
def R1_free_cash_flow(spark, d):
    f = facts.wide(_facts(spark, d), ["operating_cash_flow", "capex", "revenue"]).withColumn("capitalized_software", F.lit(None).cast("double"))
    return facts.free_cash_flow(f).withColumn("fcf", F.round("fcf", 2))


@query(f"WITH {_FACTS} SELECT ticker, period, CASE WHEN ocf > 0 THEN round(capex / ocf, 4) END AS gross, CASE WHEN ocf > 0 THEN round((capex - revenue) / ocf, 4) END AS net FROM f")
def R4_leverage(spark, d):
    f = facts.wide(_facts(spark, d), ["operating_cash_flow", "capex", "revenue"])
    return facts.leverage(f.select("ticker", "period", F.lit(None).cast("double").alias("current_debt"), F.col("capex").alias("long_term_debt"), F.col("revenue").alias("cash"), F.col("operating_cash_flow").alias("operating_income")))


@query("SELECT run, count(*) FILTER (WHERE full_gap) AS full_gaps, CASE WHEN count(*) FILTER (WHERE full_gap) > 4 OR bool_or(key_gap) THEN 'INSUFFICIENT_EVIDENCE' ELSE 'OPEN' END AS gate FROM (SELECT run, item, bool_and(gapped) AS full_gap, bool_or(item = 10 AND part = 'a' AND gapped) AS key_gap FROM (SELECT user_id AS run, event_id % 12 + 1 AS item, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS part, event_type IN ('click', 'view', 'error') AS gapped FROM events) GROUP BY run, item) GROUP BY run")
def R10_coverage_gate(spark, d):
    e = star.read(spark, d, "events")
    return facts.coverage(e.select(F.col("user_id").alias("run"), (F.col("event_id") % 12 + 1).alias("item"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("part"), F.col("event_type").isin("click", "view", "error").alias("gapped")))


# --- evaluation -------------------------------------------------------------------------------------


def _ranked(spark, d):
    e, q = _vectors(spark, d)
    return search.by_vector(e, q, 20).select(F.col("query_id").alias("qid"), "id", "rank")


def _gold(spark, d):
    """For each query four neighbours by id, in two components."""
    q = _vectors(spark, d)[0].where("id % 20 = 0")
    return q.select(F.col("id").alias("qid"), F.when(F.col("label") < 5, "low").otherwise("high").alias("category"), F.explode(F.array(*map(F.lit, range(1, 5)))).alias("i")).select("qid", "category", (F.col("i") % 2).cast("string").alias("component"), (F.col("qid") + F.col("i")).alias("id"))


_EVAL = f"""r AS (SELECT query_id AS qid, id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_NEAR} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 20),
g AS (SELECT vec_id AS qid, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS category, CAST(i % 2 AS VARCHAR) AS component, vec_id + i AS id FROM embeddings, (SELECT unnest([1, 2, 3, 4]) AS i) n WHERE vec_id % 20 = 0),
h AS (SELECT g.*, r.rank FROM g LEFT JOIN r ON r.qid = g.qid AND r.id = g.id),
a AS (SELECT qid, category, coalesce(round(1 / min(rank), 6), 0.0) AS reciprocal_rank, round(count(*) FILTER (WHERE rank <= 5) / count(*), 6) AS recall_5, round(count(*) FILTER (WHERE rank <= 10) / count(*), 6) AS recall_10, CASE WHEN count(*) FILTER (WHERE rank <= 5) > 0 THEN 1.0 ELSE 0.0 END AS success_5, CASE WHEN count(*) FILTER (WHERE rank <= 10) > 0 THEN 1.0 ELSE 0.0 END AS success_10 FROM h GROUP BY qid, category),
c AS (SELECT qid, round(count(*) FILTER (WHERE m <= 5) / count(*), 6) AS coverage_5, round(count(*) FILTER (WHERE m <= 10) / count(*), 6) AS coverage_10 FROM (SELECT qid, component, min(rank) AS m FROM h GROUP BY qid, component) GROUP BY qid),
e AS (SELECT a.*, coverage_5, coverage_10 FROM a JOIN c USING (qid))"""


@query(f"WITH {_EVAL} SELECT * FROM e")
def O1_retrieval_quality(spark, d):
    return evaluate.retrieval(_ranked(spark, d), _gold(spark, d))


_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("reciprocal_rank", "recall_5", "recall_10", "success_5", "success_10", "coverage_5", "coverage_10"))


@query(f"WITH {_EVAL} SELECT category, count(*) AS questions, {_MEANS} FROM e GROUP BY category UNION ALL SELECT 'overall' AS category, count(*) AS questions, {_MEANS} FROM e")
def O2_report(spark, d):
    return evaluate.report(O1_retrieval_quality(spark, d))


@query("SELECT c_custkey AS \"case\", 'balance' AS field, c_acctbal AS expected, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal + c_custkey % 3 END AS actual, coalesce(abs(CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal + c_custkey % 3 END - c_acctbal) <= 1.5, false) AS passed FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE), CAST(c_nationkey AS DOUBLE), true FROM customer")
def O4_extraction_checks(spark, d):
    c = star.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    expected = evaluate.long_form(c, "k", ["balance", "nation"])
    actual = expected.select("case", "field", F.when(F.col("field") == "nation", F.col("value")).when(F.col("case") % 4 != 0, F.col("value") + F.col("case") % 3).alias("value"))
    return evaluate.extraction(expected, actual, 1.5)


@query("SELECT k AS \"case\", bool_and(p) AS passed, count(*) AS fields FROM (SELECT c_custkey AS k, c_custkey % 4 <> 0 AND c_custkey % 3 < 2 AS p FROM customer UNION ALL SELECT c_custkey, true FROM customer) GROUP BY k")
def O5_extraction_cases(spark, d):
    return evaluate.cases(O4_extraction_checks(spark, d))


@query("SELECT user_id AS run, sum(event_id % 1000) AS tokens, round(sum((event_id % 1000) * CASE event_type WHEN 'click' THEN 3.0 WHEN 'view' THEN 15.0 ELSE 0.0 END) / 1000000, 6) AS cost FROM events GROUP BY user_id")
def E11_costs(spark, d):
    usage = star.read(spark, d, "events").select(F.col("user_id").alias("run"), F.lit("m").alias("model"), F.col("event_type").alias("kind"), (F.col("event_id") % 1000).alias("tokens"))
    prices = spark.createDataFrame([("m", "click", 3.0), ("m", "view", 15.0)], "model string, kind string, per_million double")
    return evaluate.costs(usage, prices)


# --- plans, streams, providers ----------------------------------------------------------------------


@query(f"{_WITH} SELECT id, CASE WHEN status = 'parsed' AND id % 9 = 0 THEN 'failed' WHEN status = 'parsed' THEN 'embedded' ELSE status END AS status FROM filings")
def P1_advance(spark, d):
    f = star.filings(spark, d).select("id", "status", F.lit(None).cast("string").alias("error_message"))
    chunked = lambda r: r.select("id", F.when(F.col("id") % 9 == 0, "no text").alias("error"))
    embedded = lambda r: r.select("id", F.lit(None).cast("string").alias("error"))
    return ingest.run(f, {"chunked": chunked, "embedded": embedded}).select("id", "status")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE), 4) AS value FROM events GROUP BY ALL")
def S1_windowed_events(spark, d):
    return streams.windowed(star.read(spark, d, "events"))


@query()
def Q1_embed(spark, d):
    return providers.embed(star.read(spark, d, "documents"), "doc_id", "text")


from foliant import catalog_checks as _checks  # noqa: E402, F401  these register their queries
from foliant import catalog_more as _more  # noqa: E402, F401
from foliant import catalog_search as _search  # noqa: E402, F401
from foliant import catalog_lexical as _lexical  # noqa: E402, F401
from foliant import catalog_vectors as _vector_index  # noqa: E402, F401
from foliant import catalog_sections as _sections  # noqa: E402, F401
from foliant import catalog_runs as _runs  # noqa: E402, F401
from foliant import catalog_states as _states  # noqa: E402, F401
from foliant import catalog_store as _stored  # noqa: E402, F401
