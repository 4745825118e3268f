import math
from math import comb

import numpy as np
from foliant.llm import sharding as sh
from pyspark.sql import functions as F


def test_univariate_law_is_exact(spark):
    n = 20_000
    got = spark.range(n).select(sh.hypergeometric(F.lit(30), F.lit(20), F.lit(12), (F.col("id") + 0.5) / n).alias("x")).groupBy("x").count().collect()
    for r in got:
        assert abs(r["count"] / n - comb(30, r.x) * comb(20, 12 - r.x) / comb(50, 12)) < 2 / n
    edge = spark.range(3).select(*[sh.hypergeometric(F.lit(a), F.lit(b), F.lit(k), (F.col("id") + 0.5) / 3).alias(f"e{i}") for i, (a, b, k) in enumerate([(0, 5, 3), (5, 0, 3), (4, 4, 0), (4, 4, 8)])])
    assert {tuple(r) for r in edge.collect()} == {(0, 3, 0, 4)}


def test_a_draw_at_the_root_takes_few_steps_and_is_right(spark):
    n = 400
    for rows in (1_000_000_000, 100_000_000_000):  # one of 40 shards, half of all rows
        room = rows // 40
        spread = math.sqrt(rows // 2 * (room / rows) * (1 - room / rows) * (rows // 2) / (rows - 1))
        u = (F.col("id") + 0.5) / n
        steps = [r[0] for r in spark.range(n).select(F.lit(spread).alias("spread"), u.alias("u")).select(F.expr(sh.STEPS)).collect()]
        assert sum(steps) / n < 1.5 * spread + 20 and max(steps) < 4.1 * spread  # a walk over both tails and again was 34
    rows, room = 1_000_000_000, 25_000_000
    spread = math.sqrt(rows // 2 * 0.025 * 0.975 / 2)
    x = np.array([r.x for r in spark.range(n).select(sh.hypergeometric(F.lit(room), F.lit(rows - room), F.lit(rows // 2), (F.col("id") + 0.5) / n).alias("x")).collect()])
    assert abs(x.mean() - room / 2) < 0.15 * spread and 0.93 < x.std() / spread < 1.05
    far = np.sort(np.abs(x - room / 2) / spread)  # the larger u, the farther from the mode: quantiles of the normal law's absolute value
    assert abs(far[n // 2] - 0.6745) < 0.02 and abs(far[int(0.9 * n)] - 1.645) < 0.03


def test_mass_of_the_mode(spark):
    cases = [(30, 20, 12), (1, 1, 1), (0, 5, 3), (5, 0, 3), (4, 4, 8), (400, 1, 200), (7, 900, 450), (2000, 3000, 2500), (16, 15, 17)]
    df = spark.createDataFrame([(k, b, n, i) for i, (k, b, n) in enumerate(cases)], "k long, b long, n long, i int")
    asked = []
    for r in df.select("k", "b", "n", sh.hypergeometric(F.col("k"), F.col("b"), F.col("n"), F.lit(0.0)).alias("m")).collect():
        p = comb(r.k, r.m) * comb(r.b, r.n - r.m) / comb(r.k + r.b, r.n)
        asked += [(r.k, r.b, r.n, min(p * (1 - eps), 1 - 1e-16), r.m, eps > 0 or p == 1) for eps in (1e-12, -1e-12)]
    told = spark.createDataFrame(asked, "k long, b long, n long, u double, m long, same boolean")
    for r in told.withColumn("x", sh.hypergeometric(F.col("k"), F.col("b"), F.col("n"), F.col("u"))).collect():
        assert (r.x == r.m) == r.same, r


def test_blocks_in_groups_keep_both_margins(spark, monkeypatch):
    monkeypatch.setattr(sh, "GROUP_BLOCKS", 4)
    sizes = [(i * 7) % 11 for i in range(37)]
    counts = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "block int, n long")
    m = np.zeros((37, 3))
    for r in sh.communication_matrix(counts, 37, 3, sum(sizes), 5).collect():
        m[r.block] = r.to
    assert m.sum(axis=1).tolist() == sizes and sorted(m.sum(axis=0).tolist()) == sorted(len(range(i, sum(sizes), 3)) for i in range(3))
    rows = sh.shuffle(spark.range(500), ["id"], 6, block_rows=10).collect()
    assert sorted(r.id for r in rows) == list(range(500))
    for s in range(6):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(84 if s < 2 else 83))


def test_hot_rows_and_names(spark):
    df = spark.range(900).select(F.when(F.col("id") < 700, 5).otherwise(F.col("id")).alias("doc_id"), *[F.lit(i).alias(c) for i, c in enumerate(("key", "part", "block", "rank", "cuts", "_block", "turn", "range", "c0", "n"))])
    out = sh.shuffle(df, ["doc_id"], 8, block_rows=50)
    assert out.columns == [*df.columns, "shard", "slot"]
    rows = out.collect()
    assert {tuple(r)[1:11] for r in rows} == {tuple(range(10))} and sum(r.doc_id == 5 for r in rows) == 700
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(113 if s < 4 else 112))
        assert 60 < sum(r.doc_id == 5 for r in rows if r.shard == s) < 105


def test_matrix_has_both_margins_and_the_right_mean(spark):
    sizes = [5, 0, 9, 30, 1]
    counts = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "block int, n long")
    total = np.zeros((5, 4))
    for seed in range(12):
        m = np.zeros((5, 4))
        for r in sh.communication_matrix(counts, 5, 4, 45, seed).collect():
            m[r.block] = r.to
        assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == [12, 11, 11, 11]
        total += m
    assert abs(total[3, 0] / 12 - 30 * 12 / 45) < 1.5


def test_shards_are_equal_gapless_and_repeatable(spark):
    df = spark.range(3_001).select(F.col("id").alias("doc_id"), F.lit("t").alias("shard"))
    out = sh.shuffle(df, ["doc_id"], 7, block_rows=300)
    rows = out.collect()
    assert out.columns == ["doc_id", "shard", "slot"] and sorted(r.doc_id for r in rows) == list(range(3_001))
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(429 if s < 5 else 428))
    assert set(map(tuple, rows)) == set(map(tuple, sh.shuffle(df.repartition(5), ["doc_id"], 7, block_rows=300).collect()))


def test_shuffle_is_uniform(spark):
    df = spark.range(40)
    first = np.zeros(40)
    for seed in range(25):
        for r in sh.shuffle(df, ["id"], 4, seed=seed, block_rows=10).where("shard = 0").collect():
            first[r.id] += 1
    assert first.sum() == 250 and first.max() <= 14 and (first[:20].sum() - 125) ** 2 < 40**2


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, "b"), (1, "b")], "doc_id long, text string")
    assert sorted(r.slot for r in sh.shuffle(df, ["doc_id", "text"], 1).collect()) == [0, 1, 2, 3, 4]
    assert sh.shuffle(df.limit(0), ["doc_id"], 3).count() == 0
    assert sorted(r.shard for r in sh.shuffle(df, ["doc_id", "text"], 40).collect()) == [0, 1, 2, 3, 4]


def test_no_python_in_the_plan(spark):
    plan = sh.op4_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
