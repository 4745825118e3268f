"""Mutation of stored tables without a table format: new versions out of old rows and incoming ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys, the one that came last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], overwrite: list[str], order: str | None = None) -> DataFrame:
    """Rows of both; where keys meet, the columns in `overwrite` are the incoming row's and the others stay."""
    new = (latest(incoming, keys, order) if order else incoming).select(*existing.columns)
    rest = [c for c in existing.columns if c not in keys]
    named = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_has_new"))
    old = existing.withColumn("_has_old", F.lit(True))
    joined = old.join(named, keys, "full")
    chosen = [F.when(F.col("_has_new") & (F.col("_has_old").isNull() | F.lit(c in overwrite)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in rest]
    return joined.select(*keys, *chosen).select(*existing.columns)


def set_status(filings: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: (id, status, seq); the last change of each filing holds."""
    last = changes.groupBy("id").agg(F.max_by("status", "seq").alias("_status"))
    return filings.join(last, "id", "left").select(*[F.coalesce("_status", "status").alias("status") if c == "status" else F.col(c) for c in filings.columns])


def set_embeddings(chunks: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Chunks with the embeddings that `vectors` (key, embedding) has for them; others keep theirs."""
    v = vectors.select(key, F.col("embedding").alias("_new"))
    return chunks.join(v, key, "left").select(*[F.coalesce("_new", "embedding").alias("embedding") if c == "embedding" else F.col(c) for c in chunks.columns])


def append_with_ids(existing: DataFrame, new: DataFrame, natural_key: list[str]) -> DataFrame:
    """New rows get an id by hash of their natural key: the same whenever and wherever it is made."""
    return existing.unionByName(new.withColumn("id", F.xxhash64(*natural_key)).select(*existing.columns))


def replace_by_source(existing: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """Rows of the sources that `new` brings are replaced by its rows."""
    return existing.join(new.select(source).distinct(), source, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def write_version(df: DataFrame, path: str, version: int) -> str:
    """Writes a new version beside the old ones; nothing that is being read is overwritten."""
    at = f"{path}/version={version:06d}"
    df.write.mode("errorifexists").parquet(at)
    return at


def write_by_source(df: DataFrame, path: str, source: str = "source") -> None:
    """Dynamic partition overwrite: only the sources in `df` are replaced on disk."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def cache_misses(wanted: DataFrame, cached: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts whose hash is not cached (hash)."""
    return wanted.select(F.sha2(text, 256).alias("hash"), text).dropDuplicates(["hash"]).join(cached.select("hash"), "hash", "left_anti")


def newest(results: DataFrame, keep: int = 10, order: str = "created_at") -> DataFrame:
    """The `keep` newest results."""
    return results.orderBy(F.desc(order)).limit(keep)
