import numpy as np
from foliant.operators import search, vector_index
from pyspark.sql import functions as F


def clustered(spark, n=1500, d=12, seed=2):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(30, d))[r.integers(0, 30, n)] + 0.15 * r.normal(size=(n, d))).astype(np.float32)
    x[: n // 3] = x[0]  # a hot vector
    return spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "id long, embedding array<float>, label int").repartition(3)


def test_all_probes_are_the_exact_scan_and_few_suffice_where_there_is_structure(spark):
    v = clustered(spark)
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    centroids = vector_index.fit(v)
    assert centroids.shape == (38, 12) and np.allclose((centroids**2).sum(axis=1), 1)
    index = vector_index.write(v, centroids)
    assert index.columns == ["id", "embedding", "label", "cell"] and index.count() == 1500
    where = F.col("label") != 3
    exact = sorted(map(tuple, search.by_vector(v, q, 10, where).collect()))
    assert sorted(map(tuple, vector_index.nearest(index, centroids, q, 10, len(centroids), where).collect())) == exact
    probes = vector_index.probes_for(index, centroids, q, 10, where=where)
    assert probes <= 8
    some = {(r.query_id, r.id) for r in vector_index.nearest(index, centroids, q, 10, probes, where).collect()}
    assert len(some & {(a, b) for a, b, *_ in exact}) >= 0.93 * len(exact)


def test_the_sample_is_bounded_and_drawn_by_ids(spark, monkeypatch):
    v = clustered(spark)
    monkeypatch.setattr(vector_index, "SAMPLE", 300)
    a, b = vector_index.fit(v, 9), vector_index.fit(v.repartition(7), 9)
    assert a.shape == (9, 12) and np.array_equal(a, b)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.0, 2.0]), (9, [5.0, 5.0]), (9, [5.0, 5.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    centroids = vector_index.fit(v, 2)
    index = vector_index.write(v, centroids)
    assert sorted(r.id for r in index.collect()) == [1, 8, 9, 9]
    q = v.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    got = [tuple(r) for r in vector_index.nearest(index, centroids, q.where("query_id < 9"), 2, 2).collect()]
    assert sorted(got) == [(1, 1, 1.0, 1), (1, 9, 0.707107, 2), (8, 8, 1.0, 1), (8, 9, 0.707107, 2)]
    assert vector_index.fit(v.limit(0)).shape == (0, 0)
    assert vector_index.nearest(index, vector_index.fit(v.limit(0)), q, 2, 2).count() == 0


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 8 * 12 * 50)
    v = clustered(spark)
    centroids = vector_index.fit(v, 4)
    sizes = [len(r.ids) for r in vector_index._by_cell(vector_index.write(v, centroids), "id", "embedding", None).collect()]
    assert max(sizes) <= 50 and sum(sizes) == 1500


def test_products_are_held_for_few_queries():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(8_192, 8)), rng.normal(size=(1_024, 8))
    ids = pa.array(rng.permutation(8_192))
    tracemalloc.start()
    got = [np.concatenate(z) for z in zip(*vector_index._products(x, y, ids, 3))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = np.round(y @ x.T, 6)
    want = [np.lexsort((ids.to_numpy(), -row))[:3] for row in near]
    assert (got[0] == np.repeat(np.arange(1_024), 3)).all() and (got[1].reshape(-1, 3) == want).all()
    assert np.allclose(got[2], near[got[0], got[1]]) and peak < 30 << 20  # one product of all is 64 MB
