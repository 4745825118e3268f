"""Chunks as they are searched: with what their filing says, clustered by ticker and date, and a table of the elements of their paths.

A chunk is written once with its ticker, dates, type and path, so that filters need no join. The table lies in ranges of (ticker, filed_date, id),
sorted: a filter on tickers and dates skips files, row groups and pages by their least and largest values, and a ticker that has a third
of all chunks spreads over as many ranges as it needs. Which chunks have an element in their path is a table of its own, in ranges of
(element, id): containment reads one element's rows and meets the chunks by id.

Defined cases: ids are unique; chunks without a filing, and filings without a security, are left out; a null path has no elements; filters are those of `search.Filters`.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.shared import new_path
from foliant.operators.search import Filters

#: Rows to a page: the least that a filter can skip.
PAGE_ROWS = 2_000


def denormalised(chunks: DataFrame, filings: DataFrame, securities: DataFrame) -> DataFrame:
    """chunks (id, filing_id, section_path, ..) with ticker, filed_date and filing_type of their filing in place of its id."""
    told = filings.join(securities.select(F.col("id").alias("security_id"), "ticker"), "security_id").select(F.col("id").alias("filing_id"), "ticker", "filed_date", "filing_type")
    return chunks.join(told, "filing_id").drop("filing_id")


def write(chunks: DataFrame, path: str | None = None) -> str:
    """Writes both tables of denormalised chunks under a path, which it returns."""
    path = path or new_path(chunks.sparkSession)
    chunks.repartitionByRange("ticker", "filed_date", "id").sortWithinPartitions("ticker", "filed_date", "id").write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/chunks")
    elements = chunks.sparkSession.read.parquet(f"{path}/chunks").select(F.explode(F.array_distinct("section_path")).alias("element"), "id")
    elements.repartitionByRange("element", "id").sortWithinPartitions("element", "id").write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/elements")
    return path


def read(spark, path: str, filters: Filters) -> DataFrame:
    """The chunks that filters leave: predicates that reach the scan, and a semi-join with the ids of elements."""
    found = spark.read.parquet(f"{path}/chunks").where(replace(filters, section_path_contains=[]).predicate())
    if filters.section_path_contains:
        ids = spark.read.parquet(f"{path}/elements").where(F.col("element").isin(*filters.section_path_contains)).select("id")
        found = found.join(ids, "id", "left_semi")
    return found


def rows_read(df: DataFrame) -> dict[str, int]:
    """Rows that the scans of a collected plan without exchanges read, by the folder they read: what a filter did not skip."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return {s.relation().location().rootPaths().head().getName(): s.metrics().apply("numOutputRows").value() for s in scans}
