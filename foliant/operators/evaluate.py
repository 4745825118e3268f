"""Quality of retrieval and of extraction against gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval(ranked: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Per question: recall, success and coverage at each cut, and reciprocal rank.

    ranked: (qid, id, rank); gold: (qid, category, component, id). A chunk that several components name counts once
    for recall; coverage is the share of components of which a chunk is found.
    """
    hits = gold.join(ranked, ["qid", "id"], "left")
    one = hits.groupBy("qid", "category", "id").agg(F.min("rank").alias("rank"))
    by_id = one.groupBy("qid", "category").agg(F.coalesce(F.round(1 / F.min("rank"), 6), F.lit(0.0)).alias("reciprocal_rank"), *[F.round(F.count_if(F.col("rank") <= c) / F.count("*"), 6).alias(f"recall_{c}") for c in cuts], *[F.when(F.count_if(F.col("rank") <= c) > 0, 1.0).otherwise(0.0).alias(f"success_{c}") for c in cuts])
    part = hits.groupBy("qid", "component").agg(F.min("rank").alias("rank"))
    by_part = part.groupBy("qid").agg(*[F.round(F.count_if(F.col("rank") <= c) / F.count("*"), 6).alias(f"coverage_{c}") for c in cuts])
    return by_id.join(by_part, "qid")


def report(results: DataFrame) -> DataFrame:
    """Macro-averages by category and overall, with the number of questions."""
    numbers = [c for c in results.columns if c not in ("qid", "category")]
    return results.rollup("category").agg(F.count("*").alias("questions"), *[F.round(F.avg(c), 6).alias(c) for c in numbers]).withColumn("category", F.coalesce("category", F.lit("overall")))


def failures(results: DataFrame, cut: int = 10) -> DataFrame:
    return results.where(F.col(f"recall_{cut}") == 0).select("qid", "category")


def extraction(expected: DataFrame, actual: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """expected and actual: (case, field, value); each expected field with whether it is met. Missing values are not."""
    a = actual.select("case", "field", F.col("value").alias("actual"))
    met = F.coalesce(F.abs(F.col("actual") - F.col("value")) <= tolerance, F.lit(False))
    return expected.join(a, ["case", "field"], "left").select("case", "field", F.col("value").alias("expected"), "actual", met.alias("passed"))


def cases(fields: DataFrame) -> DataFrame:
    """A case passes if all its fields do."""
    return fields.groupBy("case").agg(F.bool_and("passed").alias("passed"), F.count("*").alias("fields"))


def long_form(df: DataFrame, case: str, fields: list[str]) -> DataFrame:
    """(case, field, value) out of one column for each field."""
    return df.select(F.col(case).alias("case"), *fields).unpivot("case", fields, "field", "value")


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage: (run, model, kind, tokens); prices: (model, kind, per_million). Tokens and cost by run."""
    return usage.join(prices, ["model", "kind"], "left").groupBy("run").agg(F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") * F.coalesce("per_million", F.lit(0.0))) / 1_000_000, 6).alias("cost"))
