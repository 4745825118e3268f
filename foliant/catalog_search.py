"""Queries that ask questions of a corpus, and the indicators that are folds over a series."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalog import _BARS, _TOKENS, _bars, query
from foliant.operators import indicators, retrieval, search
from foliant.plans import star


class LetterCounts:
    """A model of vectors that SQL can say too: how often a text has each of the letters a to z."""

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(chr(c))) for c in range(97, 123)] for t in texts]


_LETTERS = "list_transform(range(97, 123), lambda c: CAST(length({0}) - length(replace({0}, chr(CAST(c AS INTEGER)), '')) AS DOUBLE))"
_COSINE = "round(list_cosine_similarity(c.v, q.v), 6)"
_CHUNKS = f"c AS (SELECT doc_id AS id, source AS ticker, CAST(DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS DATE) AS filed_date, {_TOKENS} AS t, {_LETTERS.format('text')} AS v FROM documents)"
# the questions of every row whose id is divisible by 20: two words of its text, as a comparison or not, and one in seven blank
_ASKED = f"""a AS (SELECT doc_id AS query_id, {_TOKENS} AS t FROM documents WHERE doc_id % 20 = 0),
b AS (SELECT query_id, CASE WHEN query_id % 7 = 0 THEN ' ' WHEN query_id % 3 = 0 THEN t[1] || ' vs ' || t[2] ELSE t[1] || ' ' || t[2] END AS question, t FROM a WHERE len(t) > 1),
s AS (SELECT query_id, unnest(CASE WHEN query_id % 7 <> 0 AND query_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS sub, question, t FROM b),
u AS (SELECT query_id, sub, CASE WHEN query_id % 7 <> 0 AND query_id % 3 = 0 THEN t[sub + 1] ELSE question END AS question FROM s WHERE trim(question) <> '')"""


def _chunks(spark, d):
    docs = star.read(spark, d, "documents")
    letters = F.array(*[(F.length("text") - F.length(F.replace("text", F.lit(chr(c)), F.lit("")))).cast("float") for c in range(97, 123)])
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).alias("filed_date"), "text", letters.alias("embedding"))


def _questions(spark, d):
    docs = star.read(spark, d, "documents").where("doc_id % 20 = 0")
    t = docs.select(F.col("doc_id").alias("query_id"), search.terms("text").alias("t")).where(F.size("t") > 1)
    joint = F.when(F.col("query_id") % 3 == 0, " vs ").otherwise(" ")
    return t.select("query_id", F.when(F.col("query_id") % 7 == 0, " ").otherwise(F.concat(F.col("t")[0], joint, F.col("t")[1])).alias("query_text"))


@query(f"""WITH {_CHUNKS}, {_ASKED}, q AS (SELECT query_id, {_LETTERS.format('question')} AS v FROM b WHERE trim(question) <> '')
SELECT query_id, id, similarity, rank FROM (SELECT q.query_id, c.id, {_COSINE} AS similarity, row_number() OVER (PARTITION BY q.query_id ORDER BY {_COSINE} DESC, c.id) AS rank FROM c, q WHERE isfinite({_COSINE})) WHERE rank <= 8""")
def V3_retrieve(spark, d):
    return retrieval.retrieve(_chunks(spark, d), _questions(spark, d), embedder=LetterCounts())


_SUBS = f"""{_CHUNKS}, {_ASKED}, q AS (SELECT query_id, sub, {_LETTERS.format('question')} AS v, list_distinct({_TOKENS.replace('text', 'question')}) AS w FROM u),
near AS (SELECT q.query_id, sub, c.id, {_COSINE} AS score, row_number() OVER (PARTITION BY q.query_id, sub ORDER BY {_COSINE} DESC, c.id) AS rank FROM c, q WHERE isfinite({_COSINE}))"""
_MERGED = """m AS (SELECT query_id, id, max(score) AS score, min(sub * 1000000 + rank) AS seen FROM {} WHERE rank <= 8 GROUP BY query_id, id)
SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM m) WHERE rank <= 8"""


@query(f"WITH {_SUBS}, {_MERGED.format('near')}")
def V6_decomposed_search(spark, d):
    return retrieval.retrieve_with_decomposition(_chunks(spark, d), _questions(spark, d), embedder=LetterCounts())


_SAID = """said AS (SELECT q.query_id, sub, c.id, row_number() OVER (PARTITION BY q.query_id, sub ORDER BY round(len(list_filter(c.t, lambda x: list_contains(w, x))) / len(c.t), 6) DESC, c.id) AS rank FROM c, q WHERE len(w) > 0 AND list_has_all(c.t, w)),
fused AS (SELECT coalesce(n.query_id, s.query_id) AS query_id, coalesce(n.sub, s.sub) AS sub, coalesce(n.id, s.id) AS id, n.rank AS v, s.rank AS t, round(coalesce(1.0 / (60 + n.rank), 0.0) + coalesce(1.0 / (60 + s.rank), 0.0), 9) AS score
  FROM (SELECT * FROM near WHERE rank <= 24) n FULL JOIN (SELECT * FROM said WHERE rank <= 24) s ON n.query_id = s.query_id AND n.sub = s.sub AND n.id = s.id),
both_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub ORDER BY score DESC, v NULLS LAST, t NULLS LAST) AS rank FROM fused)"""


@query(f"WITH {_SUBS}, {_SAID}, {_MERGED.format('both_ranked')}")
def V5_retrieve_full(spark, d):
    return retrieval.retrieve_full(_chunks(spark, d), _questions(spark, d), embedder=LetterCounts())


_METRIC = ", ".join(f"({i}, '{q}')" for i, q in enumerate(retrieval.METRIC_QUERIES))
_FILINGS = f"""f AS (SELECT DISTINCT ticker, filed_date FROM c WHERE id % 20 = 0), q AS (SELECT n AS query_id, {_LETTERS.format('s')} AS v, list_distinct({_TOKENS.replace('text', 's')}) AS w FROM (VALUES {_METRIC}) x(n, s))"""


def _filings(chunks):
    return chunks.where("id % 20 = 0").select("ticker", "filed_date").distinct()


@query(f"""WITH {_CHUNKS}, {_FILINGS}, near AS (SELECT f.ticker, f.filed_date, c.id, {_COSINE} AS similarity, row_number() OVER (PARTITION BY f.ticker, f.filed_date, query_id ORDER BY {_COSINE} DESC, c.id) AS rank FROM f JOIN c ON c.ticker = f.ticker AND c.filed_date = f.filed_date CROSS JOIN q WHERE isfinite({_COSINE}))
SELECT ticker, CAST(filed_date AS VARCHAR) AS filed_date, id, max(similarity) AS similarity FROM near WHERE rank <= 5 GROUP BY ALL""")
def V7_extraction_search(spark, d):
    chunks = _chunks(spark, d).withColumn("ticker", F.upper("ticker"))
    found = retrieval.retrieve_for_extraction(chunks, _filings(chunks), embedder=LetterCounts())
    return found.withColumn("ticker", F.lower("ticker")).withColumn("filed_date", F.col("filed_date").cast("string"))


@query(f"""WITH {_CHUNKS}, {_FILINGS}, o AS (SELECT f.ticker, f.filed_date AS day, query_id, c.id, c.t, q.w, {_COSINE} AS similarity FROM f JOIN c ON c.ticker = f.ticker AND c.filed_date BETWEEN f.filed_date - 30 AND f.filed_date + 30 CROSS JOIN q),
near AS (SELECT *, row_number() OVER (PARTITION BY ticker, day, query_id ORDER BY similarity DESC, id) AS rank FROM o WHERE isfinite(similarity)),
said AS (SELECT *, row_number() OVER (PARTITION BY ticker, day, query_id ORDER BY round(len(list_filter(t, lambda x: list_contains(w, x))) / len(t), 6) DESC, id) AS rank FROM o WHERE list_has_all(t, w)),
fused AS (SELECT coalesce(n.ticker, s.ticker) AS ticker, coalesce(n.day, s.day) AS day, coalesce(n.query_id, s.query_id) AS query_id, coalesce(n.id, s.id) AS id, n.rank AS v, s.rank AS x, round(coalesce(1.0 / (60 + n.rank), 0.0) + coalesce(1.0 / (60 + s.rank), 0.0), 9) AS score
  FROM (SELECT * FROM near WHERE rank <= 15) n FULL JOIN (SELECT * FROM said WHERE rank <= 15) s ON n.ticker = s.ticker AND n.day = s.day AND n.query_id = s.query_id AND n.id = s.id),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker, day, query_id ORDER BY score DESC, v NULLS LAST, x NULLS LAST) AS rank FROM fused)
SELECT ticker, CAST(day AS VARCHAR) AS filed_date, id, max(score) AS score FROM r WHERE rank <= 5 GROUP BY ALL""")
def V8_gather(spark, d):
    chunks = _chunks(spark, d).withColumn("ticker", F.upper("ticker"))
    found = retrieval.gather_for_extraction(chunks, _filings(chunks), embedder=LetterCounts())
    return found.withColumn("ticker", F.lower("ticker")).withColumn("filed_date", F.col("filed_date").cast("string"))


@query(f"""WITH d AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents), n AS (SELECT id, len(t) AS len, len(list_filter(t, lambda x: x = 'ing')) AS n0, len(list_filter(t, lambda x: x = 'tion')) AS n1 FROM d),
g AS (SELECT count(*) AS docs, avg(len) AS mean, count(*) FILTER (WHERE n0 > 0) AS d0, count(*) FILTER (WHERE n1 > 0) AS d1 FROM n),
s AS (SELECT id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * n0 * 2.2 / (n0 + 1.2 * (0.25 + 0.75 * len / mean)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * n1 * 2.2 / (n1 + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score FROM n, g)
SELECT id, score, rank FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""")
def V2_bm25(spark, d):
    return search.bm25(star.read(spark, d, "documents").withColumnRenamed("doc_id", "id"), "ing the tion", 20)


@query(f"""WITH d AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents), q AS (SELECT id AS query_id, list_distinct(t[1:2]) AS w FROM d WHERE id % 20 = 0)
SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(len(list_filter(t, lambda x: list_contains(w, x))) / len(t), 6) AS score FROM d, q WHERE len(w) > 0 AND list_has_all(t, w))) WHERE rank <= 20""")
def V2_text_searches(spark, d):
    docs = star.read(spark, d, "documents").withColumnRenamed("doc_id", "id")
    asked = docs.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.array_join(F.slice(search.terms("text"), 1, 2), " ").alias("query_text"))
    return search.by_text(docs, asked, 20)


@query(f"""WITH RECURSIVE {_BARS}, n AS (SELECT ticker, CAST(close AS DOUBLE) AS close, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i, CAST(close AS DOUBLE) - lag(CAST(close AS DOUBLE)) OVER (PARTITION BY ticker ORDER BY ts) AS move, count(*) OVER (PARTITION BY ticker) AS bars FROM bars),
h AS (SELECT ticker, sum(greatest(move, 0.0)) / 14 AS up, sum(greatest(-move, 0.0)) / 14 AS down FROM n WHERE i BETWEEN 2 AND 15 GROUP BY ticker),
r(ticker, i, bars, f, s, g, up, down) AS (SELECT n.ticker, n.i, n.bars, close, close, CAST(0 AS DOUBLE), h.up, h.down FROM n JOIN h ON h.ticker = n.ticker WHERE i = 1
UNION ALL SELECT r.ticker, n.i, n.bars, r.f + 2.0 / 13 * (n.close - r.f), r.s + 2.0 / 27 * (n.close - r.s), r.g + 2.0 / 10 * (r.f + 2.0 / 13 * (n.close - r.f) - (r.s + 2.0 / 27 * (n.close - r.s)) - r.g), CASE WHEN n.i <= 15 THEN r.up ELSE (13 * r.up + greatest(move, 0.0)) / 14 END, CASE WHEN n.i <= 15 THEN r.down ELSE (13 * r.down + greatest(-move, 0.0)) / 14 END FROM r JOIN n ON n.ticker = r.ticker AND n.i = r.i + 1)
SELECT ticker, round(CASE WHEN bars > 14 THEN CASE WHEN down = 0 THEN CASE WHEN up = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + up / down) END END, 6) AS rsi_14, round(f - s, 6) AS macd, round(g, 6) AS macd_signal, round(f - s - g, 6) AS macd_histogram FROM r WHERE i = bars""")
def F5_rsi_macd(spark, d):
    return indicators.indicators(_bars(spark, d)).select("ticker", "rsi_14", "macd", "macd_signal", "macd_histogram")


# all events as one series, and by user: folds over lists in SQL
_FOLDED = """b AS (SELECT {0} AS ticker, event_id AS ts, CAST(round(value, 2) AS DOUBLE) AS x FROM events),
m AS (SELECT ticker, ts, x, x - lag(x) OVER w AS move, row_number() OVER w AS i FROM b WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
l AS (SELECT ticker, count(*) AS n, list({{'f': x, 's': x, 'g': CAST(0 AS DOUBLE)}} ORDER BY ts) AS c, sum(greatest(move, 0.0)) FILTER (WHERE i BETWEEN 2 AND 15) / 14 AS u, sum(greatest(-move, 0.0)) FILTER (WHERE i BETWEEN 2 AND 15) / 14 AS d,
  list({{'u': greatest(move, 0.0), 'd': greatest(-move, 0.0)}} ORDER BY ts) FILTER (WHERE i > 15) AS moves FROM m GROUP BY ticker),
e AS (SELECT ticker, n, list_reduce(c, lambda z, y: {{'f': z.f + 2.0 / 13 * (y.f - z.f), 's': z.s + 2.0 / 27 * (y.s - z.s), 'g': z.g + 2.0 / 10 * (z.f + 2.0 / 13 * (y.f - z.f) - (z.s + 2.0 / 27 * (y.s - z.s)) - z.g)}}) AS z,
  CASE WHEN n > 14 THEN list_reduce(list_concat([{{'u': u, 'd': d}}], coalesce(moves, [])), lambda z, y: {{'u': (13 * z.u + y.u) / 14, 'd': (13 * z.d + y.d) / 14}}) END AS r FROM l)
SELECT ticker, round(CASE WHEN n > 14 THEN CASE WHEN r.d = 0 THEN CASE WHEN r.u = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + r.u / r.d) END END, {1}) AS rsi_14, round(z.f - z.s, {1}) AS macd, round(z.g, {1}) AS macd_signal, round(z.f - z.s - z.g, {1}) AS macd_histogram FROM e"""


def _series(spark, d, ticker):
    return star.read(spark, d, "events").select(ticker.alias("ticker"), F.col("event_id").alias("ts"), F.round("value", 2).alias("close"))


@query(f"WITH {_FOLDED.format(chr(39) + 'all' + chr(39), 6)}")
def F5_one_long_series(spark, d):
    return indicators.scanned(_series(spark, d, F.lit("all")))


@query(f"WITH {_FOLDED.format('CAST(user_id AS VARCHAR)', 6)}")
def F6_scanned_series(spark, d):
    return indicators.scanned(_series(spark, d, F.col("user_id").cast("string")))
