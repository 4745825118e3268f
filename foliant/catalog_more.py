"""More queries of the catalog: keyed writes, joins, ordered analytics, set operations, verification, formulas."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.catalog import _BARS, _EVAL, _FACTS, _WITH, O1_retrieval_quality, O4_extraction_checks, _bars, _facts, _gold, _ranked, _store, query
from foliant.functions import providers, values
from foliant.operators import calc, evaluate, facts, search, status, store, verify
from foliant.plans import star
from foliant.sources import filings as sources


# --- sources and sinks ------------------------------------------------------------------------------


@query("SELECT 'T' || c_nationkey AS ticker, lpad(CAST(arg_max(c_custkey, c_custkey) AS VARCHAR), 10, '0') AS cik FROM customer GROUP BY c_nationkey")
def A5_resolve_tickers(spark, d):
    c = star.read(spark, d, "customer").select(values.ticker(F.concat(F.lit(" t"), F.col("c_nationkey").cast("string"))).alias("ticker"), values.cik(F.col("c_custkey")).alias("cik"), "c_custkey")
    return c.groupBy("ticker").agg(F.max_by("cik", "c_custkey").alias("cik"))


@query("SELECT s_name AS ticker, CASE WHEN n_regionkey = 1 THEN 'thesis ' || n_nationkey ELSE 'No thesis on file.' END AS thesis FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def A10_thesis(spark, d):
    n, s = star.read(spark, d, "nation"), star.read(spark, d, "supplier")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    watched = j.where("n_regionkey = 1").select(F.upper("s_name").alias("ticker"), F.concat(F.lit("thesis "), F.col("n_nationkey").cast("string")).alias("thesis"))
    return sources.thesis(s.select(F.col("s_name").alias("ticker")), watched)


@query(f"{_WITH} SELECT accession_number, CASE WHEN id % 3 = 0 THEN 'embedded' ELSE status END AS status, filing_type FROM filings")
def B2_upsert_filings(spark, d):
    f = star.filings(spark, d).select("accession_number", "status", "filing_type", "id")
    new = f.where("id % 3 = 0").select("accession_number", F.lit("embedded").alias("status"), F.lit("changed").alias("filing_type"), "id")
    return store.upsert(f, new, ["accession_number", "id"], ["status"]).drop("id")


@query("SELECT 2 * count(*) AS chunks, 2 * count(*) AS ids FROM lineitem")
def B4_append_with_ids(spark, d):
    # a line's key repeats here, so its number among equals belongs to its natural key
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = star.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("n")).withColumn("copy", F.lit(1))
    key = rows.columns
    old = store.append_with_ids(rows.limit(0).withColumn("id", F.lit(0).cast("long")), rows, key)
    both = store.append_with_ids(old, rows.withColumn("copy", F.lit(2)), key)
    return both.agg(F.count("*").alias("chunks"), F.countDistinct("id").alias("ids"))


@query("SELECT c_nationkey AS ticker, c_mktsegment AS filing_type, CASE WHEN c_nationkey % 2 = 0 THEN 2 * n ELSE n END AS revenue, first AS filed FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY ALL)")
def B6_upsert_metrics(spark, d):
    m = star.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("ticker"), F.col("c_mktsegment").alias("filing_type")).agg(F.count("*").alias("revenue"), F.min("c_custkey").alias("filed"))
    new = m.where("ticker % 2 = 0").select("ticker", "filing_type", (F.col("revenue") * 2).alias("revenue"), F.lit(-1).cast("long").alias("filed"))
    return store.upsert(m, new, ["ticker", "filing_type"], ["revenue"])


@query("SELECT sha256(text) AS hash FROM documents GROUP BY text HAVING bool_and(doc_id % 3 <> 0)")
def B11_cache_misses(spark, d):
    docs = star.read(spark, d, "documents")
    cached = docs.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("hash")).distinct()
    return store.cache_misses(docs, cached).select("hash")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10")
def B10_newest_results(spark, d):
    return star.read(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(10)


# --- predicates -------------------------------------------------------------------------------------


@query(f"{_WITH} SELECT id FROM filings WHERE filing_type IN ('1-URGENT', '5-LOW')")
def C2_membership(spark, d):
    return star.filings(spark, d).where(search.Filters(filing_types=["1-URGENT", "5-LOW"]).predicate()).select("id")


@query("SELECT count(*) FILTER (WHERE x IS NULL) AS without, count(*) FILTER (WHERE x IS NOT NULL) AS with FROM (SELECT CASE WHEN vec_id % 7 <> 0 THEN embedding END AS x FROM embeddings)".replace("AS with FROM", 'AS "with" FROM'))
def C4_nulls(spark, d):
    e = star.read(spark, d, "embeddings").withColumn("x", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")))
    return e.agg(F.count_if(F.col("x").isNull()).alias("without"), F.count_if(F.col("x").isNotNull()).alias("with"))


@query(f"{_WITH} SELECT id FROM filings WHERE filed_date BETWEEN DATE '1996-03-01' - INTERVAL 30 DAY AND DATE '1996-03-01' + INTERVAL 30 DAY")
def C5_window_of_days(spark, d):
    day = F.lit(date(1996, 3, 1))
    return star.filings(spark, d).where(F.col("filed_date").between(F.date_sub(day, 30), F.date_add(day, 30))).select("id")


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang END AS lang, CASE WHEN source IN ('src1', 'src2') THEN 'mentioned' ELSE 'unrelated' END AS relevance FROM documents")
def R11_enums(spark, d):
    docs = star.read(spark, d, "documents")
    return docs.select("doc_id", values.one_of(F.col("lang"), ("en", "fr")).alias("lang"), F.when(F.col("source").isin("src1", "src2"), "mentioned").otherwise("unrelated").alias("relevance"))


# --- joins ------------------------------------------------------------------------------------------


@query(f"{_WITH} SELECT s.ticker, f.id, c.chunk_index FROM securities s LEFT JOIN filings f ON f.security_id = s.id AND f.status = 'failed' LEFT JOIN chunks c ON c.filing_id = f.id")
def D1_outer_chain(spark, d):
    s, f, c = _store(spark, d)
    failed = f.where("status = 'failed'").select("id", "security_id")
    return s.select(F.col("id").alias("security_id"), "ticker").join(failed, "security_id", "left").join(c.select(F.col("filing_id").alias("id"), "chunk_index"), "id", "left").select("ticker", "id", "chunk_index")


@query("SELECT l_orderkey, l_linenumber, c_nationkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def D4_inner_chain(spark, d):
    lines, o, c = (star.read(spark, d, t) for t in ("lineitem", "orders", "customer"))
    return lines.join(o, lines.l_orderkey == o.o_orderkey).join(c.where("c_mktsegment = 'BUILDING'"), o.o_custkey == c.c_custkey).select("l_orderkey", "l_linenumber", "c_nationkey")


@query("SELECT d.doc_id, s.section FROM documents d LEFT JOIN (SELECT source, lang, max(doc_id) AS section FROM documents WHERE doc_id % 2 = 0 GROUP BY source, lang) s ON s.source = d.source AND s.lang = d.lang WHERE s.section IS NOT NULL")
def D7_last_section_of_a_path(spark, d):
    docs = star.read(spark, d, "documents").withColumn("path", F.array("source", "lang"))
    last = docs.where("doc_id % 2 = 0").groupBy("path").agg(F.max("doc_id").alias("section"))
    return docs.join(last, "path").select("doc_id", "section")


@query("SELECT a.event_id AS id, count(*) AS near FROM events a JOIN events b ON b.user_id = a.user_id AND b.event_id <> a.event_id AND abs(b.event_id - a.event_id) <= 200 WHERE a.event_type = 'purchase' AND b.event_type = 'error' GROUP BY a.event_id")
def D12_proximity(spark, d):
    e = star.read(spark, d, "events")
    bucket = F.floor(F.col("event_id") / 200)
    # neighbours lie in the same stretch of 200 or in one beside it, so the join has keys
    a = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    b = e.where("event_type = 'error'").select("event_id", "user_id", bucket.alias("b"))
    return a.join(b, ["user_id", "b"]).where((F.col("event_id") != F.col("id")) & (F.abs(F.col("event_id") - F.col("id")) <= 200)).groupBy("id").agg(F.count("*").alias("near"))


# --- aggregates and ordered analytics ---------------------------------------------------------------


@query("SELECT count(*) AS checks, count(*) FILTER (WHERE p) AS passed FROM (SELECT c_custkey % 4 <> 0 AND c_custkey % 3 < 2 AS p FROM customer UNION ALL SELECT true FROM customer)")
def E10_extraction_totals(spark, d):
    return O4_extraction_checks(spark, d).agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"))


@query("SELECT doc_id, round(list_max(n) / list_sum(n), 6) AS ratio FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CAST(length(x) AS DOUBLE)) AS n FROM documents) WHERE list_sum(n) > 0")
def E13_dominant_ratio(spark, d):
    n = star.read(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("double")).alias("n"))
    total = F.aggregate("n", F.lit(0.0), lambda z, x: z + x)
    return n.where(total > 0).select("doc_id", F.round(F.array_max("n") / total, 6).alias("ratio"))


@query("SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 7")
def F1_ranks(spark, d):
    w = Window.partitionBy("label").orderBy(F.desc(F.get("embedding", F.lit(0))), "vec_id")
    return star.read(spark, d, "embeddings").withColumn("rank", F.row_number().over(w)).where("rank <= 7").select("label", "vec_id", "rank")


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 100) - turn - 1 AS gap FROM conversations")
def F2_gap_to_next(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return star.read(spark, d, "conversations").select("conv_id", "turn", (F.coalesce(F.lead("turn").over(w), F.lit(100)) - F.col("turn") - 1).alias("gap"))


@query("SELECT source, arg_max(doc_id, n_chars * 1000000 + doc_id) AS doc_id FROM documents GROUP BY source")
def F3_longest_of_each(spark, d):
    return star.read(spark, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"))


@query(f"WITH {_BARS} SELECT ticker, arg_max(close, ts) FILTER (WHERE close > 50) AS last_valid FROM bars GROUP BY ticker")
def F9_last_valid(spark, d):
    return _bars(spark, d).groupBy("ticker").agg(F.max_by(F.when(F.col("close") > 50, F.col("close")), F.when(F.col("close") > 50, F.col("ts"))).alias("last_valid"))


@query(f"WITH {_EVAL} SELECT qid, min(rank) AS first_hit FROM h GROUP BY qid")
def F10_first_hit(spark, d):
    return _gold(spark, d).join(_ranked(spark, d), ["qid", "id"], "left").groupBy("qid").agg(F.min("rank").alias("first_hit"))


@query("SELECT ticker, filed, pos FROM (SELECT c_mktsegment AS ticker, c_custkey AS filed, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS pos FROM customer) WHERE pos <= 25")
def G6_multi_key_sort(spark, d):
    c = star.read(spark, d, "customer").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").limit(25)
    w = Window.orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")
    return c.select(F.col("c_mktsegment").alias("ticker"), F.col("c_custkey").alias("filed"), F.row_number().over(w).alias("pos"))


# --- set operations ---------------------------------------------------------------------------------

_SETS = "SELECT user_id, list(DISTINCT event_type) AS a, list(DISTINCT event_type) FILTER (WHERE value > 30) AS b FROM events GROUP BY user_id"


def _sets(spark, d):
    e = star.read(spark, d, "events").groupBy("user_id")
    return e.agg(F.collect_set("event_type").alias("a"), F.collect_set(F.when(F.col("value") > 30, F.col("event_type"))).alias("b"))


@query(f"WITH s AS ({_SETS}) SELECT user_id, array_to_string(list_sort(list_filter(a, lambda x: coalesce(list_contains(b, x), false))), ',') AS common, len(list_filter(a, lambda x: coalesce(list_contains(b, x), false))) AS n FROM s")
def H3_intersections(spark, d):
    both = F.array_sort(F.array_intersect("a", "b"))
    return _sets(spark, d).select("user_id", F.array_join(both, ",").alias("common"), F.size(both).alias("n"))


@query(f"WITH s AS ({_SETS}) SELECT user_id, array_to_string(list_sort(list_filter(a, lambda x: NOT coalesce(list_contains(b, x), false) AND x NOT IN ('view'))), ',') AS undeclared FROM s")
def H4_differences(spark, d):
    rest = F.array_except(F.array_except("a", "b"), F.array(F.lit("view")))
    return _sets(spark, d).select("user_id", F.array_join(F.array_sort(rest), ",").alias("undeclared"))


@query("SELECT label AS qid, count(DISTINCT vec_id) AS gold FROM (SELECT label, vec_id FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT label, vec_id FROM embeddings WHERE vec_id % 3 = 0) GROUP BY label")
def H2_gold_union(spark, d):
    e = star.read(spark, d, "embeddings").select(F.col("label").alias("qid"), "vec_id")
    return e.where("vec_id % 2 = 0").unionByName(e.where("vec_id % 3 = 0")).distinct().groupBy("qid").agg(F.count("*").alias("gold"))


# --- chunks, verification, calculation --------------------------------------------------------------


@query("SELECT doc_id, source AS ticker, row_number() OVER (PARTITION BY source ORDER BY doc_id, k) - 1 AS chunk_index FROM (SELECT doc_id, source, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents)")
def J5_chunk_numbers(spark, d):
    lines = star.read(spark, d, "documents").select("doc_id", F.col("source").alias("ticker"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return lines.select("doc_id", "ticker", (F.row_number().over(Window.partitionBy("ticker").orderBy("doc_id", "k")) - 1).alias("chunk_index"))


# texts hold few figures, so each gets some of its own
@query("""WITH b AS (SELECT DISTINCT item_id, replace(regexp_replace(n, '\\.+$', ''), ',', '') AS n FROM (SELECT item_id, unnest(regexp_extract_all(text || ' 1,' || (100 + item_id) || '. ' || item_id || '.5', '[0-9][0-9,]*\\.?[0-9]*')) AS n FROM benchmark)),
d AS (SELECT DISTINCT doc_id, replace(regexp_replace(n, '\\.+$', ''), ',', '') AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text || ' 1' || (100 + doc_id % 70) || ' and ' || (doc_id % 30) || '.5', '[0-9][0-9,]*\\.?[0-9]*')) AS n FROM documents))
SELECT item_id, count(DISTINCT doc_id) AS docs FROM b JOIN d ON d.n = b.n GROUP BY item_id""")
def K5_number_join(spark, d):
    of = lambda t, k, *more: star.read(spark, d, t).select(k, F.explode(F.array_distinct(F.transform(verify.numbers(F.concat("text", *more)), verify.bare))).alias("n"))
    text = lambda c: c.cast("string")
    items = of("benchmark", "item_id", F.lit(" 1,"), text(100 + F.col("item_id")), F.lit(". "), text(F.col("item_id")), F.lit(".5"))
    docs = of("documents", "doc_id", F.lit(" 1"), text(100 + F.col("doc_id") % 70), F.lit(" and "), text(F.col("doc_id") % 30), F.lit(".5"))
    return items.join(docs, "n").groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))


@query("SELECT conv_id AS run, turn AS seq, regexp_replace(CASE WHEN contains(text, 'the') THEN substr(text, 1, strpos(text, 'the') - 1) ELSE text END, ',?\\s*sim(?:ilarity)?\\s*=\\s*0?\\.[0-9]+', '', 'g') AS text FROM conversations WHERE role <> 'user'")
def L8_provenance(spark, d):
    c = star.read(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "calculate").otherwise(F.col("role")).alias("tool"), "text")
    return calc.provenance(c, "the").select("run", "seq", "text")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS ticker, o_orderpriority AS fiscal_period, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS revenue FROM orders")
def M2_metric_coercion(spark, d):
    o = star.read(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    figures = o.select(F.col("o_orderkey").cast("string").alias("ticker"), F.col("o_orderpriority").alias("fiscal_period"), text.alias("revenue"), F.lit(None).cast("string").alias("operating_income"), F.lit("x").alias("stock_compensation"))
    return calc.metrics(figures).select("ticker", "fiscal_period", "revenue")


@query(f"WITH {_EVAL} SELECT qid, category FROM e WHERE recall_10 = 0")
def O3_failures(spark, d):
    return evaluate.failures(O1_retrieval_quality(spark, d))


# --- formulas ---------------------------------------------------------------------------------------


def _wide(spark, d):
    return facts.wide(_facts(spark, d), ["operating_cash_flow", "capex", "revenue"])


@query(f"WITH {_FACTS}, g AS (SELECT *, round(capex / revenue * 100, 4) AS p FROM f) SELECT ticker, period, p AS sbc_percent, round((p - lag(p) OVER (PARTITION BY ticker ORDER BY period)) * 100, 2) AS change_bps FROM g")
def R2_stock_compensation(spark, d):
    return facts.stock_compensation(_wide(spark, d).select("ticker", "period", F.col("capex").alias("stock_compensation"), F.lit(None).cast("double").alias("one_time_charge"), "revenue"))


@query(f"WITH {_FACTS}, g AS (SELECT *, round(ocf / revenue * 100, 4) AS m FROM f), h AS (SELECT *, lag(m) OVER w AS pm, lag(revenue) OVER w AS pr FROM g WINDOW w AS (PARTITION BY ticker ORDER BY period)) SELECT ticker, 's' AS segment, period, m AS margin, coalesce(m < pm AND revenue > pr, false) AS falls_while_growing FROM h")
def R3_segment_margins(spark, d):
    return facts.segment_margins(_wide(spark, d).select("ticker", F.lit("s").alias("segment"), "period", "revenue", F.col("operating_cash_flow").alias("operating_income")))


@query("SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS due, o_totalprice AS amount FROM orders JOIN customer ON c_custkey = o_custkey WHERE CAST(o_orderdate AS DATE) > DATE '1995-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1997-01-01' AND o_totalprice > c_acctbal * 20")
def R5_maturity_wall(spark, d):
    o, c = star.read(spark, d, "orders"), star.read(spark, d, "customer")
    due = o.select(F.col("o_custkey").cast("string").alias("ticker"), F.to_date("o_orderdate").alias("due"), F.col("o_totalprice").alias("amount"))
    income = c.select(F.col("c_custkey").cast("string").alias("ticker"), F.lit(date(1995, 1, 1)).alias("as_of"), (F.col("c_acctbal") * 20).alias("operating_income"))
    return facts.maturity_wall(due, income)


@query(f"WITH {_FACTS}, h AS (SELECT *, lag(revenue) OVER (PARTITION BY ticker ORDER BY period) AS pr FROM f) SELECT ticker, period, CASE WHEN pr > 0 THEN round((revenue - pr) / pr * 100, 4) END AS share_growth, round(capex / (capex + ocf + revenue) * 100, 4) AS capex_percent, round(ocf / (capex + ocf + revenue) * 100, 4) AS acquisitions_percent, round(revenue / (capex + ocf + revenue) * 100, 4) AS repurchases_percent, round(capex / revenue * 100, 4) AS goodwill_percent FROM h")
def R6_capital(spark, d):
    f = _wide(spark, d).select("ticker", "period", F.col("revenue").alias("diluted_shares"), "capex", F.col("operating_cash_flow").alias("acquisitions"), F.col("revenue").alias("repurchases"), F.col("capex").alias("goodwill"), F.col("revenue").alias("total_assets"))
    return facts.capital(f)


@query(f"WITH {_FACTS}, h AS (SELECT *, lag(revenue) OVER w AS pr, lag(capex) OVER w AS pc FROM f WINDOW w AS (PARTITION BY ticker ORDER BY period)), g AS (SELECT ticker, period, round(ocf - capex, 2) AS gap, CASE WHEN pc > 0 THEN round((capex - pc) / pc * 100, 4) END AS receivables_growth, CASE WHEN pr > 0 THEN round((revenue - pr) / pr * 100, 4) END AS revenue_growth FROM h) SELECT *, round(receivables_growth - revenue_growth, 4) AS excess FROM g")
def R7_accruals(spark, d):
    f = _wide(spark, d).select("ticker", "period", "operating_cash_flow", F.col("capex").alias("net_income"), F.col("capex").alias("receivables"), "revenue")
    return facts.accruals(f).withColumn("gap", F.round("gap", 2))


@query(f"WITH {_FACTS}, h AS (SELECT *, lag(revenue) OVER w AS pr, lag(ocf) OVER w AS po FROM f WINDOW w AS (PARTITION BY ticker ORDER BY period)) SELECT ticker, period, CASE WHEN po > 0 THEN round((ocf - po) / po * 100, 4) END AS backlog_growth, CASE WHEN pr > 0 THEN round((revenue - pr) / pr * 100, 4) END AS revenue_growth FROM h")
def R8_backlog(spark, d):
    return facts.backlog(_wide(spark, d).select("ticker", "period", F.col("operating_cash_flow").alias("backlog"), "revenue"))


@query("SELECT k AS ticker, p AS period, CASE WHEN b > 0 THEN round((v - b) / b * 100, 4) END AS growth FROM (SELECT c_nationkey AS k, c_custkey AS p, c_acctbal AS v, lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer)")
def R9_no_growth_from_losses(spark, d):
    c = star.read(spark, d, "customer").select(F.col("c_nationkey").alias("ticker"), F.col("c_custkey").alias("period"), F.col("c_acctbal").alias("v"))
    return c.select("ticker", "period", facts.growth("v").alias("growth"))


# --- models -----------------------------------------------------------------------------------------


@query()
def Q1_similar_to_first(spark, d):
    docs = star.read(spark, d, "documents").withColumnRenamed("doc_id", "id")
    e = providers.embed(docs, "id", "text")
    return search.by_vector(e, providers.embed(docs.where("id % 20 = 0"), "id", "text").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 10)


@query(f"{_WITH} SELECT ticker, count(*) AS open FROM filings f JOIN securities s ON s.id = f.security_id WHERE status <> 'embedded' GROUP BY ticker")
def C6_open_filings(spark, d):
    s, f, _ = _store(spark, d)
    return status.issues(s, f).groupBy("ticker").agg(F.count("*").alias("open"))
