"""Schemas of stored tables by revision, with the steps between neighbours: a table of any revision is read as any other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Revision:
    """A schema, the step to it from the revision before, and the step back."""

    schema: T.StructType
    up: Step | None = None
    down: Step | None = None


class Versions:
    """The revisions of one table, the first of which may be later than that of the store."""

    def __init__(self, first: int, *revisions: Revision):
        if not revisions or any(r.up is None or r.down is None for r in revisions[1:]):
            raise ValueError("every revision but the first needs its two steps")
        self.revisions = {first + i: r for i, r in enumerate(revisions)}

    def schema(self, version: int) -> T.StructType:
        """The table's schema when the store is at a revision: that of its last change."""
        known = [v for v in self.revisions if v <= version]
        if not known:
            raise ValueError(f"the table is not there before revision {min(self.revisions)}")
        return self.revisions[max(known)].schema

    def read_as(self, table: DataFrame, have: int, want: int) -> DataFrame:
        """A table written at revision `have` in the schema of `want`. Columns that the old schema lacks or has in another order are as `DataFrame.to` sees them: missing ones null, others dropped."""
        out, last = table.to(self.schema(have)), max(self.revisions)
        self.schema(want)
        at, goal = min(have, last), min(want, last)
        while at != goal:
            out = self.revisions[at + 1].up(out) if at < goal else self.revisions[at].down(out)
            at += 1 if at < goal else -1
            out = out.to(self.schema(at))
        return out


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType()}


def _kind(name: str) -> T.DataType:
    if name.startswith("array<"):
        return T.ArrayType(_kind(name[6:-1]))
    return T.DecimalType(*map(int, name[8:-1].split(","))) if name.startswith("decimal(") else _KINDS[name]


def fields(text: str) -> T.StructType:
    """A schema out of "name type, name type": without a session, so that modules can declare theirs."""
    return T.StructType([T.StructField(name, _kind(kind)) for name, kind in (x.split(" ") for x in text.split(", "))])


_CHUNKS = "id long, section_id long, content string, chunk_index int, token_count int, embedding array<float>, ticker string, filed_date date, filing_type string, section_path array<string>, created_at timestamp"
#: The store: chunks from the first revision, with the words of their text from the second; metrics from the third.
TABLES = {
    "chunks": Versions(
        1,
        Revision(fields(_CHUNKS)),
        Revision(fields(f"{_CHUNKS}, content_words array<string>"), lambda t: t.withColumn("content_words", F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0))), lambda t: t.drop("content_words")),
    ),
    "financial_metrics": Versions(
        3,
        Revision(
            fields(
                "id int, ticker string, filing_type string, fiscal_period string, filed_date date, revenue decimal(38,6), gross_margin_pct decimal(38,6), gaap_net_income decimal(38,6), free_cash_flow decimal(38,6), "
                "sbc_pct_of_revenue decimal(38,6), net_dollar_retention decimal(38,6), extraction_confidence string, source_citations array<string>, extracted_at timestamp_ntz"
            )
        ),
    ),
}
