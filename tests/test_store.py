from datetime import date

import pytest

from foliant import catalog, catalog_more
from foliant.functions import providers, values
from foliant.operators import search, store
from foliant.plans import ingest
from foliant.sources import filings
from pyspark.sql import functions as F


def test_upsert_keeps_what_is_not_overwritten(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, created int")
    new = spark.createDataFrame([(2, "x", 99, 1), (2, "c", 99, 2), (3, "d", 30, 1)], "id int, name string, created int, seq int")
    got = sorted(map(tuple, store.upsert(old, new, ["id"], ["name"], "seq").collect()))
    assert got == [(1, "a", 10), (2, "c", 20), (3, "d", 30)]


def test_versions_and_sources_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source string, x int")
    store.write_by_source(df, str(tmp_path / "t"))
    store.write_by_source(df.where("source = 'a'").withColumn("x", F.lit(5)), str(tmp_path / "t"))
    assert sorted((r.source, r.x) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 5), ("b", 2)]
    assert store.write_version(df, str(tmp_path / "v"), 3).endswith("version=000003")


def test_fusion_orders_ties_like_insertion(spark):
    v = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    t = spark.createDataFrame([(3, 1), (2, 2)], "id int, rank int")
    got = search.fuse(v, t, 10).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 1, 3]
    assert got[0].score == round(2 / 62, 9)


def test_hybrid_search_keeps_queries_apart(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], "net sales rose"), (2, [0.0, 1.0], "net loss"), (3, [0.6, 0.8], "sales, sales and loss")], "id int, embedding array<float>, text string")
    asked = spark.createDataFrame([(7, [1.0, 0.0], "the sales"), (8, [0.0, 1.0], "loss net"), (9, [0.0, 1.0], "of the"), (10, [1.0, 0.0], None)], "query_id int, query array<float>, query_text string")
    found = search.by_text(chunks, asked, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score) for r in found] == [(7, 3, 0.666667), (7, 1, 0.333333), (8, 2, 1.0)]
    got: dict[int, list] = {}
    for r in search.hybrid(chunks, asked, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.vector_rank, r.text_rank, r.rank))
    assert got == {7: [(1, 1, 2, 1), (3, 2, 1, 2)], 8: [(2, 1, 1, 1), (3, 2, None, 2)], 9: [(2, 1, None, 1), (3, 2, None, 2)], 10: [(1, 1, None, 1), (3, 2, None, 2)]}


def test_searches_take_every_stated_query(spark):
    d = "/root/testdata/sf0.001"
    assert catalog.V4_hybrid_searches(spark, d).select("query_id").distinct().count() == 25
    assert catalog.V5_merged_hybrid(spark, d).count() == 10
    assert catalog_more.Q1_similar_to_first(spark, d).select("query_id").distinct().count() == 10


def test_text_search_needs_all_terms(spark):
    docs = spark.createDataFrame([(1, "Net sales rose"), (2, "sales"), (3, None)], "id int, text string")
    assert [r.id for r in search.by_text(docs, "the sales NET", 5).collect()] == [1]
    assert search.by_text(docs, "of the", 5).count() == 0


def test_values(spark):
    df = spark.createDataFrame([("320193", " brk.b ", "0000320193-24-000001"), ("x1", "TOO-LONG-TICKER", "1-2-3")], "c string, t string, a string")
    got = df.select(values.cik(F.col("c")), values.ticker(F.col("t")), values.accession(F.col("a"))).collect()
    assert tuple(got[0]) == ("0000320193", "BRK.B", "0000320193-24-000001") and tuple(got[1]) == (None, None, None)


def test_listed_filings(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"filings":{"recent":{"accessionNumber":["a","b","c"],"form":["10-K","8-K","10-K"],"filingDate":["2024-01-02","2024-01-03","2020-01-01"],"reportDate":["","2024-01-01",""],"primaryDocument":["x","y","z"]}}}')
    got = filings.listed(filings.submissions(spark, str(tmp_path / "s.json")), ["10-K"], date(2023, 1, 1)).collect()
    assert [(r.accession_number, r.report_date) for r in got] == [("a", None)]


def test_tickers_last_wins(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"0":{"cik_str":1,"ticker":"aa","title":"x"},"1":{"cik_str":2,"ticker":"AA","title":"y"}}')
    assert [tuple(r) for r in filings.tickers(spark, str(tmp_path / "t.json")).collect()] == [("AA", "0000000002", "y")]


def test_news_and_gold_files(spark, tmp_path):
    (tmp_path / "n.json").write_text('[{"headline":"h","datetime":1,"source":"s","url":"u","summary":"m"},{"headline":"i","datetime":null}]')
    assert [(r.ordinal, r.headline, r.datetime) for r in filings.news(spark, str(tmp_path / "n.json")).collect()] == [(0, "h", 1), (1, "i", None)]
    (tmp_path / "g.yaml").write_text("questions: [{id: q1, category: c, question: x, components: [{name: n, chunk_ids: [1, 2]}]}]")
    assert filings.gold(spark, str(tmp_path / "g.yaml")).count() == 2
    (tmp_path / "b.yaml").write_text("questions: [{id: q1, category: c, question: x, components: []}]")
    with pytest.raises(ValueError):
        filings.gold(spark, str(tmp_path / "b.yaml"))


def test_ingestion_resumes_and_keeps_failures(spark):
    f = spark.createDataFrame([(1, "discovered", None), (2, "parsed", None), (3, "failed", "old")], "id int, status string, error_message string")
    ok = lambda r: r.select("id", F.when(F.col("id") == 1, "boom").alias("error"))
    got = {r.id: (r.status, r.error_message) for r in ingest.run(f, {"downloaded": ok, "chunked": ok, "embedded": ok}).collect()}
    assert got == {1: ("failed", "boom"), 2: ("embedded", None), 3: ("failed", "old")}
    assert ingest.may_become("failed", "discovered") and not ingest.may_become("failed", "parsed")
    assert ingest.legs(["news", "technical"]) == ["technical", "news"]
    done = spark.createDataFrame([("t", "a")], "thread_id string, stage string")
    assert ingest.resume(done, "t", ["a", "b"]) == ("resumed", ["b"]) and ingest.resume(done, "u", ["a"])[0] == "started"


def test_providers(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, None)], "id int, text string")
    got = {r.id: r.embedding for r in providers.embed(df, "id", "text").collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5) and not any(got[2])
    assert providers.Extractive().answer("x", "") == providers.Extractive.NOTHING


def test_stream_matches_batch(spark, tmp_path):
    from foliant.streaming import ingest as streams

    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    seen = []
    streams.each_batch(streams.deduplicated(stream.withColumn("ts", F.col("ts").cast("timestamp"))), lambda df, i: seen.append(df.count()), str(tmp_path / "cp")).start().awaitTermination(60)
    assert sum(seen) == batch.count()
