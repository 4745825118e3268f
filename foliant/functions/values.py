"""Validated values and renderings as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("discovered", "downloaded", "parsed", "chunked", "embedded", "failed", "metrics_extracted")
CONFIDENCES = ("stated", "computed", "not_disclosed")

#: Texts that a task turns into Python objects at once.
FEW = 256


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of FEW rows: what is made of texts does not grow with the rows that a batch has."""
    for b in batches:
        for at in range(0, b.num_rows, FEW):
            yield b.slice(at, FEW)


def cik(x: Column) -> Column:
    """Ten digits, padded on the left; null for anything but digits, or more than ten of them."""
    s = F.trim(x.cast("string"))
    return F.when(F.rlike(s, F.lit("^[0-9]{1,10}$")), F.lpad(s, 10, "0"))


def ticker(x: Column) -> Column:
    s = F.upper(F.trim(x))
    return F.when(F.rlike(s, F.lit(r"^[A-Z0-9.\-]{1,10}$")), s)


def accession(x: Column) -> Column:
    return F.when(F.rlike(x, F.lit("^[0-9]{10}-[0-9]{2}-[0-9]{6}$")), x)


def section_path(x: Column) -> Column:
    return F.when(F.size(x) >= 1, x)


def status(x: Column) -> Column:
    return F.when(x.isin(*STATUSES), x)


def preview(x: Column, n: int = 300) -> Column:
    return F.concat(F.substring(x, 1, n), F.when(F.length(x) > n, F.lit("…")).otherwise(""))


def citation(ticker_: str, form: str, filed: str, path: str) -> Column:
    """[TICKER FORM YEAR §Item X]: the year of filing, and the first element of the path that is an item, if any."""
    item = F.get(F.filter(path, lambda p: F.startswith(p, F.lit("Item "))), F.lit(0))
    return F.concat(F.lit("["), F.concat_ws(" ", F.col(ticker_), F.col(form), F.year(filed).cast("string"), F.concat(F.lit("§"), item)), F.lit("]"))


def context_block(chunks: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, block): the retrieved chunks (by, rank, citation, similarity, section_path, content) of a question as one text."""
    one = F.concat(F.col("citation"), F.lit(" (similarity "), F.format_string("%.3f", "similarity"), F.lit(")\n"), F.array_join("section_path", " > "), F.lit("\n"), F.col("content"))
    parts = chunks.select(by, "rank", one.alias("text"))
    return parts.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n---\n\n").alias("block"))


def cited(chunks: DataFrame, answers: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, citation): citations of a question's chunks that its answer contains, each once."""
    return chunks.join(answers.select(by, "answer"), by).where(F.contains("answer", F.col("citation"))).select(by, "citation").distinct()


def one_of(x: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(x.isin(*allowed), x)
