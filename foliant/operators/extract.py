"""Metrics out of chunks of filings without a language model: each label gets the one figure that can only be its own.

A chunk is cut into clauses, and a clause at its labels. A label's figure is the only one between it and the next label or
the end; where there are several, or one that is rounded to billions, the label has none and says why. A filing's metric is the value that all its
labels agree on. Amounts are in millions. The deterministic stand-in for a model that fills in the same typed record.

Defined cases: a null text has no labels; several equal figures are one; a filing without any metric has a row with nulls and confidence not_disclosed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is extracted, with the words that label it; figures with their units; what parts clauses.
LABELS = {
    "revenue": "(?:total )?revenues?",
    "gross_profit": "gross profit",
    "gaap_net_income": "net (?:income|loss)",
    "free_cash_flow": "free cash flow",
    "sbc_expense": "(?:stock|share)-based compensation(?: expense)?",
    "net_dollar_retention": "net (?:dollar|revenue) retention(?: rate)?",
}
FIGURE = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(thousand|million|billion|%)?"
CLAUSE = r";|\n|\.(?:\s|$)"
UNITS = {"thousand": 1e-3, "million": 1.0, "billion": 1e3, "%": 1.0, "": 1e-6}
_ANY = "(?i)\\b(?:" + "|".join(sorted(LABELS.values(), key=len, reverse=True)) + ")\\b"


def _concept(label: Column) -> Column:
    return F.coalesce(*[F.when(F.rlike(label, F.lit(f"(?i)^(?:{words})$")), name) for name, words in LABELS.items()])


def pairs(chunks: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, concept, value, problem): a row for each label in each clause; value in millions, or why there is none."""
    clause = chunks.select(*by, F.explode(F.split(F.coalesce(text, F.lit("")), CLAUSE)).alias("clause")).where(F.rlike("clause", F.lit(_ANY)))
    cut = clause.select(*by, F.regexp_extract_all("clause", F.lit(_ANY), F.lit(0)).alias("labels"), F.split("clause", _ANY).alias("gaps"))
    # what stands behind a label, up to the next
    each = cut.select(*by, F.explode(F.zip_with("labels", F.slice("gaps", F.lit(2), F.size("labels")), lambda a, b: F.struct(a.alias("label"), b.alias("behind")))).alias("x"))
    figures = F.zip_with(F.regexp_extract_all("x.behind", F.lit(FIGURE), F.lit(1)), F.regexp_extract_all("x.behind", F.lit(FIGURE), F.lit(2)), lambda n, u: F.struct(n.alias("n"), u.alias("unit")))
    told = each.select(*by, _concept(F.col("x.label")).alias("concept"), F.array_distinct(figures).alias("figures"))
    one = F.get("figures", F.lit(0))
    rounded = (one["unit"] == "billion") & ~F.rlike(one["n"], F.lit(r"\.[0-9]{3}"))
    percent = (F.col("concept") == "net_dollar_retention") != (one["unit"] == "%")
    problem = F.when(F.size("figures") == 0, "no figure").when(F.size("figures") > 1, "several figures").when(rounded, "rounded").when(percent, "unit")
    scale = F.coalesce(*[F.when(one["unit"] == u, k) for u, k in UNITS.items()])
    value = F.replace(one["n"], F.lit(","), F.lit("")).try_cast("double") * scale
    return told.select(*by, "concept", F.when(problem.isNull(), F.round(value, 6)).alias("value"), problem.alias("problem"))


def figures(chunks: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, the six figures, extraction_confidence, errors): one typed record for each filing (`by`); errors: concept and why it is null, in order."""
    found = pairs(chunks, by, text)
    agreed = found.groupBy(*by, "concept").agg(F.count_distinct("value").alias("values"), F.max("value").alias("value"), F.min("problem").alias("problem"))
    value = F.when(F.col("values") == 1, F.col("value"))
    error = F.when(F.col("values") > 1, "values differ").when(F.col("values") == 0, F.col("problem"))
    wide = agreed.groupBy(*by).agg(*[F.max(F.when(F.col("concept") == c, value)).alias(c) for c in LABELS], F.array_sort(F.collect_list(F.when(error.isNotNull(), F.concat("concept", F.lit(": "), error)))).alias("errors"))  # six at most
    every = chunks.select(*by).distinct().join(wide, by, "left")
    stated = F.coalesce(*[F.col(c) for c in LABELS]).isNotNull()
    return every.select(*by, *LABELS, F.when(stated, "stated").otherwise("not_disclosed").alias("extraction_confidence"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))
