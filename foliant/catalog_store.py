"""Queries over the clustered store of chunks, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from foliant.catalog import query
from foliant.operators import chunk_store
from foliant.operators.search import Filters
from foliant.plans import star

_STORED = f"""WITH {star.SQL}, k AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS filing_id, ['Part ' || (l_linenumber % 3), 'Item ' || (min(l_partkey) % 10)] AS path, min(l_quantity) AS token_count FROM lineitem GROUP BY l_orderkey, l_linenumber),
s AS (SELECT k.id, ticker, filed_date, filing_type, path, token_count FROM k JOIN filings f ON f.id = k.filing_id JOIN securities s ON s.id = f.security_id)"""


def _store(spark, d) -> str:
    lines = star.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"))  # numbers of lines repeat
    path = F.array(F.concat(F.lit("Part "), (F.col("l_linenumber") % 3).cast("string")), F.concat(F.lit("Item "), (F.col("l_partkey") % 10).cast("string")))
    chunks = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("filing_id"), path.alias("section_path"), F.col("l_quantity").alias("token_count"))
    return chunk_store.write(chunk_store.denormalised(chunks, star.filings(spark, d), star.securities(spark, d)))


@query(f"{_STORED} SELECT id, ticker, CAST(filed_date AS VARCHAR) AS filed_date, filing_type, array_to_string(path, ' > ') AS path, token_count FROM s")
def J6_stored_chunks(spark, d):
    rows = chunk_store.read(spark, _store(spark, d), Filters())
    return rows.select("id", "ticker", F.col("filed_date").cast("string").alias("filed_date"), "filing_type", F.array_join("section_path", " > ").alias("path"), "token_count")


@query(f"{_STORED} SELECT id, ticker, filing_type FROM s WHERE ticker IN ('FRANCE', 'NATION_7', 'CHINA') AND filed_date BETWEEN DATE '1995-03-01' AND DATE '1996-02-29' AND list_has_any(path, ['Item 7'])")
def C3_stored_search(spark, d):
    wanted = Filters(tickers=["france", "nation_7", "China"], filed_after=date(1995, 3, 1), filed_before=date(1996, 2, 29), section_path_contains=["Item 7"])
    return chunk_store.read(spark, _store(spark, d), wanted).select("id", "ticker", "filing_type")
