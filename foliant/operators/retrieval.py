"""Questions to chunks: what a caller of the engine asks, over the searches beneath.

All take questions as rows, so that many are one job. Blank questions find nothing. Chunks: (id, embedding, text, and
what filters name); a model of vectors is given or the deterministic one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import providers
from foliant.operators import search

#: Chunks of an answer and of an extraction query, days on either side of a filing's date in which it gathers, and its queries.
ANSWER_CHUNKS, EXTRACTION_CHUNKS, GATHER_DAYS = 8, 5, 30
METRIC_QUERIES = (
    "revenue gross profit cost of revenue gross margin net income loss",
    "free cash flow operating cash flow capital expenditures",
    "stock-based compensation expense percentage of revenue",
    "net dollar retention rate customer retention",
)


def asked(questions: DataFrame, embedder: providers.Embedder | None = None) -> DataFrame:
    """(query_id, query_text) to (query_id, query, query_text), without blank ones."""
    told = questions.where(F.coalesce(F.trim(F.regexp_replace("query_text", r"\s+", " ")), F.lit("")) != "").select("query_id", "query_text")
    vectors = providers.embed(told, "query_id", "query_text", embedder).withColumnRenamed("embedding", "query")
    return vectors.join(told, "query_id").select("query_id", "query", "query_text")


def retrieve_by_embedding(chunks: DataFrame, queries: DataFrame, k: int = ANSWER_CHUNKS, filters: search.Filters | None = None) -> DataFrame:
    """For each query (query_id, query): its k nearest chunks."""
    return search.by_vector(chunks, queries, k, filters.predicate() if filters else None)


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = ANSWER_CHUNKS, filters: search.Filters | None = None, embedder: providers.Embedder | None = None) -> DataFrame:
    """For each question (query_id, query_text): the k chunks nearest to its vector."""
    return retrieve_by_embedding(chunks, asked(questions, embedder), k, filters)


def decomposed(questions: DataFrame, rewriter: providers.Rewriter | None = None) -> DataFrame:
    """(query_id, query_text) to (query_id, sub, query_text): the rewriter's sub-questions of routed questions, others as they are."""
    model = rewriter or providers.SplitsAtComparisons()
    rewrite = F.udf(lambda q, mode: model.rewrite(q, mode))  # a model's call, one a question
    routed = questions.withColumn("mode", search.route(F.col("query_text")))
    lines = F.when(F.col("mode").isNull(), F.array("query_text")).otherwise(search.sub_queries(rewrite("query_text", "mode"), F.col("query_text")))
    return routed.select("query_id", F.posexplode(lines).alias("sub", "query_text"))


def _by_sub(found: DataFrame, score: str, k: int) -> DataFrame:
    return search.merge(found.select("query_id.query_id", "query_id.sub", "id", F.col(score).alias("score"), "rank"), k)


def retrieve_with_decomposition(chunks: DataFrame, questions: DataFrame, k: int = ANSWER_CHUNKS, filters: search.Filters | None = None, embedder: providers.Embedder | None = None, rewriter: providers.Rewriter | None = None) -> DataFrame:
    """(query_id, id, score, rank): vector search for each sub-question, each chunk once with its best similarity."""
    subs = decomposed(questions, rewriter).select(F.struct("query_id", "sub").alias("query_id"), "query_text")
    return _by_sub(retrieve(chunks, subs, k, filters, embedder), "similarity", k)


def retrieve_full(chunks: DataFrame, questions: DataFrame, k: int = ANSWER_CHUNKS, filters: search.Filters | None = None, embedder: providers.Embedder | None = None, rewriter: providers.Rewriter | None = None) -> DataFrame:
    """(query_id, id, score, rank): hybrid search for each sub-question, each chunk once with its best score."""
    subs = decomposed(questions, rewriter).select(F.struct("query_id", "sub").alias("query_id"), "query_text")
    return _by_sub(search.hybrid(chunks, asked(subs, embedder), k, filters.predicate() if filters else None), "score", k)


def _metric_queries(spark, embedder: providers.Embedder | None) -> DataFrame:
    return asked(spark.createDataFrame(list(enumerate(METRIC_QUERIES)), "query_id int, query_text string"), embedder)


def _of_filings(chunks: DataFrame, filings: DataFrame, days: int) -> DataFrame:
    """Chunks of each asked filing (ticker, filed_date): those of its ticker within so many days, with the filing's date as asked_date."""
    wanted = filings.select(F.upper("ticker").alias("ticker"), F.explode(F.sequence(F.date_sub("filed_date", days), F.date_add("filed_date", days))).alias("filed_date"), F.col("filed_date").alias("asked_date")).distinct()
    return chunks.join(wanted, ["ticker", "filed_date"])


def _nearest(scope: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(ticker, asked_date, query_id, id, similarity, rank) of the k nearest chunks of each filing's scope."""
    pairs = scope.where("embedding is not null").join(F.broadcast(queries.select("query_id", "query")), F.size("embedding") == F.size("query"))  # four rows are sent out
    scored = pairs.select("ticker", "asked_date", "query_id", "id", F.round(search.cosine("embedding", "query"), 6).alias("similarity")).where("similarity is not null")
    w = Window.partitionBy("ticker", "asked_date", "query_id").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(found: DataFrame, score: str) -> DataFrame:
    return found.groupBy("ticker", F.col("asked_date").alias("filed_date"), "id").agg(F.max(score).alias(score))


def retrieve_for_extraction(chunks: DataFrame, filings: DataFrame, k: int = EXTRACTION_CHUNKS, embedder: providers.Embedder | None = None) -> DataFrame:
    """(ticker, filed_date, id, similarity): what the metric queries find in each asked filing (ticker, filed_date), by exact date, each chunk once with its best similarity."""
    return _best(_nearest(_of_filings(chunks, filings, 0), _metric_queries(chunks.sparkSession, embedder), k), "similarity")


def gather_for_extraction(chunks: DataFrame, filings: DataFrame, k: int = EXTRACTION_CHUNKS, days: int = GATHER_DAYS, embedder: providers.Embedder | None = None, text: str = "text") -> DataFrame:
    """(ticker, filed_date, id, score): the same by hybrid search, within `days` days before and after."""
    scope = _of_filings(chunks, filings, days)
    queries = _metric_queries(chunks.sparkSession, embedder)
    by = ["ticker", "asked_date", "query_id"]
    vector = _nearest(scope, queries, 3 * k)
    scored = None
    for i, q in enumerate(METRIC_QUERIES):
        one = search.scored(scope, q, text, ["ticker", "asked_date"]).withColumn("query_id", F.lit(i))
        scored = one if scored is None else scored.unionByName(one)
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    lexical = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3 * k)
    return _best(search.fuse(vector, lexical, k, by=by), "score")
