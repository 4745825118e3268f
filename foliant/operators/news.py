"""News: bounded windows, deduplication, batches, joins of model output, sentiment."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP = 60
BATCH = 15
BODY = 600
MOST_COST = 0.20
SENTIMENTS = ("positive", "negative", "neutral")
RELEVANCES = ("primary", "mentioned", "unrelated")


def utc_date(unix_seconds: Column) -> Column:
    """The UTC day of a unix time, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(unix_seconds / 86_400).cast("int"))


def classified(raw: DataFrame, as_of: date, start: date) -> DataFrame:
    """raw (ordinal, headline, datetime, ...) with day, story and fate: missing, window, empty, duplicate or kept.

    A story is a headline in lower case with single spaces; the first of a story's articles of a day is kept.
    """
    if as_of is None:
        raise ValueError("as_of is required")
    day = utc_date(F.col("datetime"))
    story = F.trim(F.regexp_replace(F.lower(F.coalesce("headline", F.lit(""))), r"\s+", " "))
    out = raw.withColumn("day", F.when(F.coalesce("datetime", F.lit(0)) != 0, day)).withColumn("story", story)
    early = F.when(F.col("day").isNull(), "missing").when(~F.col("day").between(F.lit(start), F.lit(as_of)), "window").when(F.col("story") == "", "empty").otherwise("kept")
    out = out.withColumn("_early", early)
    w = Window.partitionBy("_early", "day", "story").orderBy("ordinal")
    again = (F.col("_early") == "kept") & (F.row_number().over(w) > 1)
    return out.withColumn("fate", F.when(again, "duplicate").otherwise(F.col("_early"))).drop("_early")


def newest(articles: DataFrame, cap: int = CAP) -> DataFrame:
    """The newest kept articles: by day, then in their given order."""
    return articles.where("fate = 'kept'").orderBy(F.desc("day"), "ordinal").limit(cap)


def counters(articles: DataFrame, cap: int = CAP) -> DataFrame:
    """What became of the raw articles, in one row."""
    n = lambda f: F.count_if(F.col("fate") == f)
    return articles.agg(F.count("*").alias("raw"), n("missing").alias("dropped_missing"), n("window").alias("dropped_window"), n("duplicate").alias("deduped"), F.least(n("kept"), F.lit(cap)).alias("kept"), (n("kept") > cap).alias("truncated"))


def batches(items: DataFrame, company: str, size: int = BATCH, body: int = BODY) -> DataFrame:
    """(batch, prompt): numbered articles, cut bodies, under a header. items: (position from 0, headline, summary), CAP at most."""
    line = F.concat(F.lit("["), (F.col("position") % size).cast("string"), F.lit("] "), F.coalesce("headline", F.lit("")), F.lit("\n"), F.substring(F.coalesce("summary", F.lit("")), 1, body))
    told = items.select(F.floor(F.col("position") / size).alias("batch"), "position", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n\n")
    return told.groupBy("batch").agg(F.concat(F.lit(f"Company: {company}\n\n"), joined).alias("prompt"))


def parsed_index(x: Column) -> Column:
    """An article number out of JSON text: integers, integral floats and "[n]"; nothing else (not true, 1.7 or words)."""
    bare = F.regexp_extract(F.coalesce(x, F.lit("")), r'^\s*"?\[?([0-9]+)(?:\.0+)?\]?"?\s*$', 1)
    return F.when(bare != "", bare.try_cast("int"))


def degraded(value: Column, allowed: tuple[str, ...], otherwise: str) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(*allowed), low).otherwise(otherwise)


def joined(items: DataFrame, output: DataFrame) -> DataFrame:
    """items (position, ...) with the model's sentiment and relevance; output: (seq, index, sentiment, relevance).

    Only the first answer for an article counts; articles without one are neutral and mentioned, and say so.
    """
    rows = output.withColumn("position", parsed_index(F.col("index")))
    first = rows.where("position is not null").groupBy("position").agg(F.min_by(F.struct("sentiment", "relevance"), "seq").alias("_a"))
    out = items.join(first, "position", "left")
    return out.select(*items.columns, degraded(F.col("_a.sentiment"), SENTIMENTS, "neutral").alias("sentiment"), degraded(F.col("_a.relevance"), RELEVANCES, "mentioned").alias("relevance"), F.col("_a").isNull().alias("unanswered"))


def answer_issues(items: DataFrame, output: DataFrame) -> DataFrame:
    """(issue, detail): indexes that can't be read, that no article has, or that come again; values out of bounds; articles without an answer."""
    rows = output.withColumn("position", parsed_index(F.col("index")))
    known = items.select("position")
    w = Window.partitionBy("position").orderBy("seq")
    numbered = rows.where("position is not null")
    unread = rows.where("position is null").select(F.lit("unreadable").alias("issue"), F.coalesce("index", F.lit("null")).alias("detail"))
    outside = numbered.join(known, "position", "left_anti").select(F.lit("out of range").alias("issue"), F.col("position").cast("string").alias("detail"))
    again = numbered.join(known, "position", "left_semi").withColumn("_n", F.row_number().over(w)).where("_n > 1").select(F.lit("duplicate").alias("issue"), F.col("position").cast("string").alias("detail"))
    missing = known.join(numbered, "position", "left_anti").select(F.lit("missing").alias("issue"), F.col("position").cast("string").alias("detail"))
    bad = [numbered.where(~F.coalesce(F.lower(F.trim(c)).isin(*allowed), F.lit(False))).select(F.lit(f"bad {c}").alias("issue"), F.coalesce(c, F.lit("null")).alias("detail")) for c, allowed in (("sentiment", SENTIMENTS), ("relevance", RELEVANCES))]
    out = unread
    for more in (outside, again, missing, *bad):
        out = out.unionByName(more)
    return out


def sentiment(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts over primary articles, net score (positive less negative, over all; 0 without any), and how many were left out."""
    primary = F.col("relevance") == "primary"
    n = lambda s: F.count_if(primary & (F.col("sentiment") == s))
    grouped = items.groupBy(*(by or []))
    total = F.count_if(primary)
    return grouped.agg(n("positive").alias("positive"), n("negative").alias("negative"), n("neutral").alias("neutral"), F.when(total > 0, F.round((n("positive") - n("negative")) / total, 6)).otherwise(0.0).alias("net"), F.count_if(~primary).alias("excluded"))


def none_after(items: DataFrame, as_of: date) -> DataFrame:
    """The items, or an error on reading one of a later day."""
    return items.where(F.assert_true(F.col("day") <= F.lit(as_of), F.lit("an article is later than as_of")).isNull())


def within_budget(cost: float, most: float = MOST_COST) -> float:
    if cost > most:
        raise ValueError(f"a digest of ${cost:.4f} is over the budget of ${most:.2f}")
    return cost
