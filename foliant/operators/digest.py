"""Digests of feeds in batches under a budget: what is called, what that costs, where it stops, and what came back.

A feed's batches are called in order while the running cost stays within its budget; a batch that would pass it, and all behind it, are
not called. A batch whose call fails costs its input and keeps its error; others go on. Feeds are rows, so that many are one job, and a batch is a row:
windows run over batches, never over a feed's articles.

Defined cases: nulls in headline or summary are empty texts; a feed without articles has no batches; an article of null position is in no batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.news import BATCH, BODY, MOST_COST

#: Characters to a token and tokens of an answer for each article: how the stand-in counts; dollars for a million tokens in and out.
CHARACTERS, ANSWER_TOKENS, PRICES = 4, 40, (1.0, 5.0)


def _body() -> Column:
    return F.substring(F.trim(F.coalesce("summary", F.lit(""))), 1, BODY)


def planned(feed: DataFrame, budget: float = MOST_COST, size: int = BATCH) -> DataFrame:
    """feed (run, position, headline, summary) to (run, batch, articles, cost, running, status): called, error or skipped."""
    told = feed.where("position is not null").select("run", F.floor(F.col("position") / size).alias("batch"), F.length(F.coalesce("headline", F.lit(""))).alias("h"), F.length(_body()).alias("b"))
    batches = told.groupBy("run", "batch").agg(F.count("*").alias("articles"), F.sum(F.col("h") + F.col("b")).alias("characters"), F.sum("b").alias("body"))
    failed = F.col("body") == 0  # nothing to summarise: the call comes back without an answer
    tokens_in, tokens_out = F.ceil(F.col("characters") / CHARACTERS), F.when(failed, 0).otherwise(F.col("articles") * ANSWER_TOKENS)
    cost = F.round((tokens_in * PRICES[0] + tokens_out * PRICES[1]) / 1_000_000, 9)
    running = F.round(F.sum("cost").over(Window.partitionBy("run").orderBy("batch")), 9)
    out = batches.withColumn("failed", failed).withColumn("cost", cost).withColumn("running", running)
    status = F.when(F.col("running") > budget, "skipped").when(F.col("failed"), "error").otherwise("called")
    return out.select("run", "batch", "articles", "cost", "running", status.alias("status"))


def sentiment(text: Column, positive: list[str], negative: list[str]) -> Column:
    """The stand-in for a model's judgement: which of two lists of words a text has more of."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    n = lambda some: F.size(F.filter(words, lambda w: w.isin(*some)))
    return F.when(n(positive) > n(negative), "positive").when(n(positive) < n(negative), "negative").otherwise("neutral")


def digest(feed: DataFrame, company: Column, positive: list[str], negative: list[str], budget: float = MOST_COST, size: int = BATCH) -> DataFrame:
    """(run, position, sentiment, relevance) of the articles of batches that were called. relevance: primary if the headline names the company, else mentioned."""
    called = planned(feed, budget, size).where("status = 'called'").select("run", "batch")
    rows = feed.where("position is not null").withColumn("batch", F.floor(F.col("position") / size)).withColumn("company", company)
    judged = rows.select("run", "batch", "position", sentiment(_body(), positive, negative).alias("sentiment"), F.when(F.contains(F.lower(F.coalesce("headline", F.lit(""))), F.lower("company")), "primary").otherwise("mentioned").alias("relevance"))
    return judged.join(called, ["run", "batch"], "left_semi").select("run", "position", "sentiment", "relevance")
