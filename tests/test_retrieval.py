from datetime import date

from foliant.operators import retrieval, search


def one_hot():
    class OneHot:
        """Vectors of four words; made here so that it travels with the code."""

        def embed_many(self, texts):
            return [[float(w in t.split()) for w in ("cash", "revenue", "risk", "staff")] for t in texts]

    return OneHot()


def corpus(spark):
    rows = [(1, "A", "cash and revenue"), (2, "A", "cash"), (3, "B", "revenue risk"), (4, "B", "staff"), (5, "B", None)]
    return spark.createDataFrame([(i, t, date(2024, 3, i), x, None if x is None else one_hot().embed_many([x])[0]) for i, t, x in rows], "id long, ticker string, filed_date date, text string, embedding array<float>")


def test_blank_questions_find_nothing(spark):
    q = spark.createDataFrame([(1, " "), (2, None), (3, "cash")], "query_id long, query_text string")
    got = retrieval.retrieve(corpus(spark), q, 2, embedder=one_hot()).collect()
    assert [(r.query_id, r.id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(3, 2, 1), (3, 1, 2)]
    some = retrieval.retrieve(corpus(spark), q, 2, search.Filters(tickers=["b"]), one_hot()).collect()
    assert {r.id for r in some} == {3, 4}


def test_parts_of_a_comparison_are_merged(spark):
    q = spark.createDataFrame([(1, "cash vs staff"), (2, "risk")], "query_id long, query_text string")
    got = retrieval.retrieve_with_decomposition(corpus(spark), q, 2, embedder=one_hot()).collect()
    assert {(r.query_id, r.id): r["rank"] for r in got} == {(1, 2): 1, (1, 4): 2, (2, 3): 1, (2, 1): 2}
    full = retrieval.retrieve_full(corpus(spark), q, 1, embedder=one_hot()).collect()
    assert {(r.query_id, r.id) for r in full} <= {(1, 2), (1, 4), (2, 3)} and len(full) == 2


def test_extraction_keeps_to_its_filing(spark):
    asked = spark.createDataFrame([("a", date(2024, 3, 1)), ("B", date(2024, 3, 4))], "ticker string, filed_date date")
    got = retrieval.retrieve_for_extraction(corpus(spark), asked, embedder=one_hot()).collect()
    assert {(r.ticker, r.id) for r in got} == {("A", 1), ("B", 4)}
    wide = retrieval.gather_for_extraction(corpus(spark), asked, days=2, embedder=one_hot()).collect()
    assert {(r.ticker, r.id) for r in wide} == {("A", 1), ("A", 2), ("B", 3), ("B", 4)}


def test_vectors_of_other_lengths_and_without_direction(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0, 1.0]), (4, None), (5, [1.0, 0.0]), (6, [])], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, query array<float>")
    got = search.by_vector(c, q, 1).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1.0, 1)]
    assert search.by_vector(c.limit(0), q, 1).count() == 0
