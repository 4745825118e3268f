import numpy as np
import pytest
from foliant.llm import vantage_points as vp
from pyspark.sql import functions as F


def brute(rows, queries, k):
    """[(query, rank, id, score)] by all inner products, each summed as the operator does; ties to the smaller id."""
    out = []
    for q, v in queries:
        every = sorted((-(np.array(v, float) * np.array(x, float)).sum(), i) for i, x in rows if i != q and len(x) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(every[:k])]
    return sorted(out)


def vectors(n, d, seed=0, kind="any"):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * r.choice([0.1, 1, 3], size=(n, 1)) if kind == "any" else r.integers(-1, 2, size=(n, d))
    x = x.astype(np.float32).astype(float)
    x[(x == 0).all(axis=1), 0] = 1
    x[n // 2 : n // 2 + n // 5] = x[0]  # a hot vector
    return [(int(i), v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("n,d,k,kind", [(700, 3, 5, "any"), (900, 8, 20, "any"), (600, 4, 7, "whole"), (15, 2, 20, "any"), (2, 2, 3, "any")])
def test_factor_one_is_exact(spark, n, d, k, kind):
    rows = vectors(n, d, n, kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    shards = vp.index(df, leaf=10, shard_bytes=64 * 8 * d)
    got = vp.nearest(shards, df.where("vec_id % 5 = 0"), k, factor=1, block_bytes=64 * 8 * d).collect()
    assert sorted(map(tuple, got)) == brute(rows, [r for r in rows if r[0] % 5 == 0], k)


def test_trees_prune_and_a_larger_factor_prunes_more():
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 3))
    tree = vp.plant(x, np.arange(4000), 20)
    assert sorted(tree.ids) == list(range(4000)) and sorted(map(tuple, tree.points)) == sorted(map(tuple, x))
    assert tree.nodes[:, 4].max() == 4000 and ((tree.nodes[:, 4] - tree.nodes[:, 3])[tree.nodes[:, 0] < 0] <= 20).all()
    visits = [vp.search(tree, x[:50], 5, f)[2] for f in (1, 2, 8)]
    assert visits[0] < 0.5 * 50 * 4000 and visits[0] > visits[1] > visits[2]


def test_parts_lie_within_their_distances():
    x = np.random.default_rng(4).normal(size=(500, 6))
    tree = vp.plant(x, np.arange(500), 16)
    high = vp.lifted(tree.points)
    for (vantage, inner, outer, *_), (a, b, c, d) in zip(tree.nodes, tree.bounds):
        if vantage >= 0:
            for child, low, top in ((inner, a, b), (outer, c, d)):
                far = np.sqrt(((high[slice(*tree.nodes[child, 3:5])] - high[vantage]) ** 2).sum(axis=1))
                assert abs(far.min() - low) < 1e-9 and abs(far.max() - top) < 1e-9


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0, 2.0]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (9, [-0.0, 2.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (20, [3.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id int, embedding array<float>, points string, size int")
    got = vp.nearest(vp.index(df), df, 3, factor=1).collect()
    said = {q: [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert said[0] == [(20, 3.0), (20, 1.0), (8, 0.5)] and said[20] == [(0, 1.0), (8, 0.5), (8, 0.5)]  # asked once, with its least vector
    assert said[8] == [(20, 1.5), (9, 1.0), (0, 0.5)] and set(said) == {0, 8, 9, 20}  # 7 has no other vector of its length
    for a, b in ((df.limit(0), df), (df, df.limit(0))):
        assert vp.nearest(vp.index(a), b, 3).count() == 0
    for k, factor in ((0, 1), (3, 0.5)):
        with pytest.raises(ValueError):
            vp.nearest(df, df, k, factor=factor)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got = vp.op13_vantage_points(spark, f"/root/testdata/{sf}")
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got = [tuple(r) for r in got.collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert len(got) == len(want)
    score = {(q, i): s for q, _, i, s in want}
    hits = [(q, i) for q, _, i, _ in got if (q, i) in score]
    assert len(hits) >= 0.95 * len(want) and all(s == score[q, i] for q, _, i, s in got if (q, i) in score)


def test_recall_on_clusters_and_independent_vectors(spark):
    r = np.random.default_rng(8)
    for x in (r.normal(size=(6000, 48)), r.normal(size=(60, 48))[r.integers(0, 60, 6000)] + 0.3 * r.normal(size=(6000, 48))):
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        tree = vp.plant(x, np.arange(6000))
        places, _, _ = vp.search(tree, x[:200], 20)
        near = x[:200] @ tree.points.T
        want = np.argsort(-near, axis=1)[:, :20]
        assert np.mean([len(set(a) & set(b)) for a, b in zip(places[:, :20], want)]) >= 0.93 * 20


def test_blocks_and_shards_are_bounded(spark):
    df = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    sizes = [len(r.ids) // 8 for r in vp.index(df.repartition(2), shard_bytes=16 * 700).collect()]
    assert max(sizes) <= 700 and sum(sizes) == 5000
