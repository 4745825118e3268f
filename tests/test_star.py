from datetime import datetime

import pytest

from foliant import catalog, catalog_more  # noqa: F401  both register queries

KEYS = (7, 999_999, 1_234_567, 1_234_568, 1_234_569, 12_345_670)


@pytest.fixture(scope="module")
def large_keys(spark, tmp_path_factory):
    """Keys of more digits than an accession number has for them, so that some filings share theirs."""
    at = tmp_path_factory.mktemp("star")
    orders = [(k, c, s, float(k), datetime(1995, 1 + i, 3), "1-URGENT") for i, (k, c, s) in enumerate(zip(KEYS, (1, 1, 2, 2, 2, 12_345_678_901), "FPOFOP"))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(str(at / "orders.parquet"))
    spark.createDataFrame([(1, 3), (2, 3), (12_345_678_901, 4)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(str(at / "customer.parquet"))
    spark.createDataFrame([(3, "a"), (4, "b")], "n_nationkey int, n_name string").coalesce(1).write.parquet(str(at / "nation.parquet"))
    spark.createDataFrame([(k, i, f, 1.0, 5) for k in KEYS[1:] for i, f in enumerate("NRA")], "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_partkey long").coalesce(1).write.parquet(str(at / "lineitem.parquet"))
    return str(at)


def _both(spark, d, name):
    import duckdb

    c = duckdb.connect()
    for t in ("orders", "customer", "nation", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    got, told = catalog.QUERIES[name](spark, d), c.execute(catalog.SQL[name])
    columns = [x[0] for x in told.description]
    return sorted((tuple(r) for r in got.select(*columns).collect()), key=str), sorted(told.fetchall(), key=str)


@pytest.mark.parametrize("name", ["A13_keyed_scans", "A15_without_embeddings", "D5_in_corpus", "D6_new_filings", "E2_per_filing", "E3_issues"])
def test_long_keys_make_the_accession_numbers_of_the_sql(spark, large_keys, name):
    got, want = _both(spark, large_keys, name)
    assert got == want


@pytest.mark.parametrize("name", ["B2_upsert_filings", "D6_new_counts"])
def test_filings_that_share_an_accession_number_stay_apart(spark, large_keys, name):
    got, want = _both(spark, large_keys, name)
    assert got == want
