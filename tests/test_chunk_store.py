from datetime import date, timedelta

from foliant.operators import chunk_store
from foliant.operators.search import Filters
from pyspark.sql import functions as F


def test_filters_skip_what_they_do_not_need(spark):
    securities = spark.createDataFrame([(i, f"T{i:02d}") for i in range(20)], "id long, ticker string")
    filings = spark.createDataFrame([(i, i % 20, "10-K" if i % 3 else "10-Q", date(2020, 1, 1) + timedelta(days=i % 700)) for i in range(2000)], "id long, security_id long, filing_type string, filed_date date")
    chunks = spark.range(40_000).select("id", (F.col("id") % 2001).alias("filing_id"), F.when(F.col("id") % 7 > 0, F.array(F.lit("Part I"), F.concat(F.lit("Item "), (F.col("id") % 50).cast("string")))).alias("section_path"), F.lit("x").alias("content"))
    made = chunk_store.denormalised(chunks, filings, securities)
    assert made.columns == ["id", "section_path", "content", "ticker", "filed_date", "filing_type"]
    path = chunk_store.write(made)
    wanted = Filters(tickers=["t03"], filed_after=date(2020, 3, 1), filed_before=date(2020, 6, 30), section_path_contains=["Item 5", "Item 6"])
    got = chunk_store.read(spark, path, wanted)
    want = {r.id for r in made.where(wanted.predicate()).select("id").collect()}
    assert {r.id for r in got.collect()} == want and len(want) > 0
    one = chunk_store.read(spark, path, Filters(tickers=["T03"], filed_after=date(2020, 3, 1), filed_before=date(2020, 6, 30)))
    one.collect()
    assert chunk_store.rows_read(one)["chunks"] < 0.3 * made.count()
    element = spark.read.parquet(f"{path}/elements").where("element = 'Item 6'")
    element.collect()
    assert chunk_store.rows_read(element)["elements"] < 0.5 * spark.read.parquet(f"{path}/elements").count()
    assert chunk_store.read(spark, path, Filters()).count() == made.count() == 40_000 - 40_000 // 2001  # chunks of the filing that is not there


def test_null_paths_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "A", date(2024, 1, 1), "8-K"), (2, ["x", "x"], "A", date(2024, 1, 2), "8-K")], "id long, section_path array<string>, ticker string, filed_date date, filing_type string")
    path = chunk_store.write(df)
    assert [r.id for r in chunk_store.read(spark, path, Filters(section_path_contains=["x"])).collect()] == [2]
    assert chunk_store.read(spark, chunk_store.write(df.limit(0)), Filters(tickers=["a"])).count() == 0
