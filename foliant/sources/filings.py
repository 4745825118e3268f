"""Lists of filings, tickers, bars, news and gold out of files, with declared schemas."""

from __future__ import annotations

from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import values

_STRINGS = "array<string>"
SUBMISSIONS = f"filings struct<recent: struct<accessionNumber: {_STRINGS}, form: {_STRINGS}, filingDate: {_STRINGS}, reportDate: {_STRINGS}, primaryDocument: {_STRINGS}>>"
NEWS = "array<struct<headline: string, datetime: bigint, source: string, url: string, summary: string, related: string>>"
BARS = "Date string, Open double, High double, Low double, Close double, Volume bigint, Dividends double, `Stock Splits` double"
#: The forms of foreign and domestic filers.
FOREIGN, DOMESTIC = ("20-F", "6-K"), ("10-K", "10-Q", "8-K")


def submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSIONS).json(path, multiLine=True)


def listed(submissions_: DataFrame, forms: list[str] | None = None, since: date | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per filing out of parallel arrays, in their order (ordinal); no forms: all of them."""
    r = F.col("filings.recent")
    zipped = F.arrays_zip(r["accessionNumber"].alias("accession_number"), r["form"].alias("form"), r["filingDate"].alias("filing_date"), r["reportDate"].alias("report_date"), r["primaryDocument"].alias("primary_document"))
    rows = submissions_.select(*keep, F.posexplode(zipped).alias("ordinal", "f"))
    out = rows.select(*keep, "ordinal", F.col("f.accession_number"), F.col("f.form"), F.to_date("f.filing_date").alias("filing_date"), F.to_date(F.nullif("f.report_date", F.lit(""))).alias("report_date"), F.col("f.primary_document"))
    if forms:
        out = out.where(F.col("form").isin(*forms))
    return out if since is None else out.where(F.col("filing_date") >= F.lit(since))


def default_forms(forms: Column) -> Column:
    """Which forms to fetch of a filer that has filed these."""
    return F.when(F.array_contains(forms, FOREIGN[0]), F.array(*map(F.lit, FOREIGN))).otherwise(F.array(*map(F.lit, DOMESTIC)))


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik, title) out of one JSON object of numbered entries; of repeated tickers the last."""
    entry = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", entry)).alias("n", "e"))
    last = rows.groupBy(values.ticker(F.col("e.ticker")).alias("ticker")).agg(F.max_by("e", F.col("n").cast("int")).alias("e"))
    return last.where("ticker is not null").select("ticker", values.cik(F.col("e.cik_str")).alias("cik"), F.col("e.title"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): files as UTF-8; bytes that are none are replaced."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("html"))


def bars(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """(ticker, ts, open, high, low, close, volume) of a CSV file of daily bars."""
    raw = spark.read.schema(BARS).csv(path, header=True)
    return raw.select(F.lit(ticker).alias("ticker"), F.to_timestamp("Date").alias("ts"), F.col("Open").alias("open"), F.col("High").alias("high"), F.col("Low").alias("low"), F.col("Close").alias("close"), F.col("Volume").alias("volume"))


def news(spark: SparkSession, path: str) -> DataFrame:
    """Articles of JSON files that each hold one list, numbered in its order."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", NEWS).alias("a"))
    return rows.where("a is not null").select(F.posexplode("a").alias("ordinal", "a")).select("ordinal", "a.*")


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, thesis, key_metrics, risks_watching) of a YAML list."""
    import yaml

    schema = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("thesis", T.StringType()), T.StructField("key_metrics", T.ArrayType(T.StringType())), T.StructField("risks_watching", T.ArrayType(T.StringType()))])
    entries = yaml.safe_load(Path(path).read_text()) or []
    entries = entries.get("watchlist", []) if isinstance(entries, dict) else entries
    return spark.createDataFrame([(e["ticker"], e.get("thesis"), e.get("key_metrics") or [], e.get("risks_watching") or []) for e in entries], schema)


def thesis(asked: DataFrame, watched: DataFrame, otherwise: str = "No thesis on file.") -> DataFrame:
    """asked (ticker) with the first thesis of its ticker, whatever the case."""
    w = watched.groupBy(F.upper("ticker").alias("_t")).agg(F.first("thesis").alias("thesis"))
    return asked.join(w, F.upper("ticker") == F.col("_t"), "left").select(*asked.columns, F.coalesce("thesis", F.lit(otherwise)).alias("thesis"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(qid, category, component, id) of a YAML test set; raises ValueError for questions without components or ids that are no integers."""
    import yaml

    rows = []
    for q in yaml.safe_load(Path(path).read_text())["questions"]:
        if not q.get("components"):
            raise ValueError(f"question {q.get('id')} has no components")
        for c in q["components"]:
            if not c.get("chunk_ids") or not all(isinstance(i, int) and not isinstance(i, bool) for i in c["chunk_ids"]):
                raise ValueError(f"question {q['id']}, {c.get('name')}: chunk ids must be integers")
            rows += [(q["id"], q["category"], c["name"], i) for i in c["chunk_ids"]]
    return spark.createDataFrame(rows, "qid string, category string, component string, id long")
