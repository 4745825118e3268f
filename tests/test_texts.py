import random
import re

from foliant.operators import search


def _brute(docs, asked, k):
    out = []
    for q, text in asked:
        want = {w for w in re.findall("[a-z0-9]+", (text or "").lower()) if w not in search.STOP_WORDS}
        found = []
        for i, t in docs:
            said = [w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in search.STOP_WORDS]
            if want and want <= set(said):
                found.append((-round(sum(w in want for w in said) / len(said), 6), i))
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_matches_of_many_queries_leave_a_task_as_its_best(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["net", "sales", "loss", "the", "rare" if i % 50 == 0 else "Gain"]) for _ in range(r.randint(0, 9)))) for i in range(300)] + [(900, None)]
    asked = [(q, r.choice(["net sales", "Sales, net", "loss", "gain loss net", "rare", "rare gain", "none net", "the", None])) for q in range(60)]
    chunks = spark.createDataFrame(docs, "id long, text string").repartition(5)
    out = search.by_text(chunks, spark.createDataFrame(asked, "query_id long, query_text string"), 7)
    assert sorted((x.query_id, x.id, x.score, x["rank"]) for x in out.collect()) == _brute(docs, asked, 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_term" not in plan and "hashpartitioning(id" not in plan  # neither words nor matches are exchanged


def test_repeated_rows_are_matches_of_their_own(spark):
    chunks = spark.createDataFrame([("b", "net sales"), ("b", "net sales"), ("a", "sales net"), (None, "net")], "id string, text string")
    asked = spark.createDataFrame([(1, "net"), (1, "net")], "query_id int, query_text string")
    assert [(x.id, x.score) for x in search.by_text(chunks, asked.limit(1), 9).orderBy("rank").collect()] == [(None, 1.0), ("a", 0.5), ("b", 0.5), ("b", 0.5)]
    assert search.by_text(chunks.limit(0), asked, 9).count() == 0 and search.by_text(chunks, asked.limit(0), 9).count() == 0


def test_vector_search_of_more_queries_than_one_product_holds(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x, y = r.integers(-2, 3, (90, 4)).astype(float), r.integers(-2, 3, (2 * search.PRODUCT_ROWS + 5, 4)).astype(float)
    x[:, 0], y[:, 0] = 1, 1  # none without a direction
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "query_id int, query array<double>").coalesce(1)
    near = np.round((y / np.linalg.norm(y, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 6)
    want = [(q, int(i), n + 1) for q in range(len(y)) for n, i in enumerate(np.lexsort((np.arange(len(x)), -near[q]))[:5])]
    assert sorted((z.query_id, z.id, z["rank"]) for z in search.by_vector(chunks, asked, 5).collect()) == sorted(want)


def test_vector_search_reads_each_vector_once_and_loses_no_near_tie(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "CHUNK_ROWS", 50)
    monkeypatch.setattr(search, "QUERY_ROWS", 7)
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 16))
    x[100:200] = x[0] + r.normal(size=(100, 16)) * 1e-6  # told apart in double precision only, or by id
    x[300:350] = x[0]
    x = x.astype(np.float32).astype(float)
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>").repartition(6).mapInArrow(told, "id int, embedding array<double>")
    asked = chunks.where("id % 20 = 0").selectExpr("id as query_id", "embedding as query")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were too many queries to send
    try:
        found = sorted((z.query_id, z["rank"], z.id) for z in search.by_vector(chunks, asked, 12).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = np.round(x[::20] @ x.T, 6)
    assert found == [(20 * q, n + 1, int(i)) for q in range(20) for n, i in enumerate(np.lexsort((np.arange(400), -near[q]))[:12])]
    assert read.value == 800  # once as chunks, once for the queries among them


def test_texts_are_cut_a_few_at_a_time():
    import pyarrow as pa

    from foliant.functions.values import FEW, few

    rows = pa.RecordBatch.from_pydict({"id": list(range(2 * FEW + 3))})
    cut = list(few(iter([rows, rows.slice(0, 0), rows.slice(5, 2)])))
    assert [b.num_rows for b in cut] == [FEW, FEW, 3, 2]
    assert [i for b in cut for i in b.column(0).to_pylist()] == [*range(2 * FEW + 3), 5, 6]
