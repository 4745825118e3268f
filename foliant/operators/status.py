"""State of a corpus of filings: summaries, issues, what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("embedded", "failed")


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """(filing_id, chunks, embedded_chunks): combined before any join, so that joins never fan out."""
    return chunks.groupBy("filing_id").agg(F.count("*").alias("chunks"), F.count_if("embedded").alias("embedded_chunks"))


def summary(securities: DataFrame, filings: DataFrame, chunks: DataFrame, ticker: str | None = None) -> DataFrame:
    """One row per ticker: filings in all and by state, dates, chunks. Securities without filings appear with zeros."""
    s = securities if ticker is None else securities.where(F.col("ticker") == ticker.strip().upper())
    f = filings.join(chunk_totals(chunks), filings.id == F.col("filing_id"), "left")
    by = f.groupBy("security_id").agg(
        F.count("*").alias("filings"),
        F.min("filed_date").alias("first_filed"),
        F.max("filed_date").alias("last_filed"),
        F.count_if(F.col("status") == "embedded").alias("embedded"),
        F.count_if(~F.col("status").isin(*TERMINAL)).alias("partial"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks"),
        F.sum(F.coalesce("embedded_chunks", F.lit(0))).alias("embedded_chunks"),
    )
    counts = ("filings", "embedded", "partial", "failed", "chunks", "embedded_chunks")
    return s.join(by, s.id == by.security_id, "left").select("ticker", "first_filed", "last_filed", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def per_filing(securities: DataFrame, filings: DataFrame, chunks: DataFrame, ticker: str | None = None) -> DataFrame:
    """One row per filing with its counts of chunks."""
    s = securities if ticker is None else securities.where(F.col("ticker") == ticker.strip().upper())
    f = filings.join(s.select(F.col("id").alias("security_id"), "ticker"), "security_id")
    return f.join(chunk_totals(chunks), f.id == F.col("filing_id"), "left").select("ticker", "accession_number", "filing_type", "filed_date", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("embedded_chunks", F.lit(0)).alias("embedded_chunks"))


def issues(securities: DataFrame, filings: DataFrame) -> DataFrame:
    """Filings that are not embedded: unfinished or failed."""
    return filings.where(F.col("status") != "embedded").join(securities.select(F.col("id").alias("security_id"), "ticker"), "security_id").select("ticker", "accession_number", "filing_type", "filed_date", "status")


def totals(summaries: DataFrame) -> DataFrame:
    """Grand totals of summaries, and the share of chunks that have embeddings (null without chunks)."""
    out = summaries.agg(*[F.sum(c).alias(c) for c in ("filings", "embedded", "partial", "failed", "chunks", "embedded_chunks")])
    return out.withColumn("embedded_percent", percent("embedded_chunks", "chunks"))


def percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.round(F.col(part) * 100.0 / F.col(whole), 4))


def token_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.min("token_count").alias("least"), F.round(F.avg("token_count"), 6).alias("mean"), F.max("token_count").alias("most"))


def by_status(filings: DataFrame, statuses: list[str], limit: int | None = None) -> DataFrame:
    """Filings in any of the states, newest first; ties by id."""
    out = filings.where(F.col("status").isin(*statuses)).orderBy(F.desc("filed_date"), "id")
    return out if limit is None else out.limit(limit)


def without_embeddings(filings: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks that lack an embedding, with their filing's accession number: no page limit that would leave some behind."""
    return chunks.where(~F.col("embedded")).join(filings.select(F.col("id").alias("filing_id"), "accession_number"), "filing_id").select("accession_number", "filing_id", "chunk_index")


def in_corpus(listed: DataFrame, known: DataFrame, key: str = "accession_number") -> DataFrame:
    """Listed filings with in_corpus and the state they have there."""
    k = known.select(key, F.col("status").alias("corpus_status")).withColumn("_there", F.lit(True))
    return listed.join(k, key, "left").select(*listed.columns, F.coalesce("_there", F.lit(False)).alias("in_corpus"), "corpus_status")


def new_filings(listed: DataFrame, known: DataFrame, key: str = "accession_number") -> DataFrame:
    return listed.join(known.select(key), key, "left_anti")


def new_counts(listed: DataFrame, known: DataFrame, key: str = "accession_number") -> DataFrame:
    return in_corpus(listed, known, key).agg(F.count("*").alias("total"), F.count_if("in_corpus").alias("already"), F.count_if(~F.col("in_corpus")).alias("new"))
