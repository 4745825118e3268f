"""Queries over an index of vectors. Which rows are looked at depends on fitted centroids, so SQL says what share is found."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalog import _vectors, query
from foliant.functions.shared import written
from foliant.operators import search, vector_index


def _index(spark, d):
    e, q = _vectors(spark, d)
    centroids = vector_index.fit(e)
    return vector_index.write(e, centroids), centroids, q


@query()
def V1_probed_search(spark, d):
    index, centroids, q = _index(spark, d)
    return vector_index.nearest(index, centroids, q, 10, vector_index.probes_for(index, centroids, q, 10))


@query("SELECT count(*) AS queries, 10 * count(*) AS neighbours, TRUE AS enough FROM embeddings WHERE vec_id % 20 = 0")
def V1_probe_recall(spark, d):
    """Whether the index finds at least 0.9 of the exact scan's ten nearest, over all queries."""
    index, centroids, q = _index(spark, d)
    exact = written(search.by_vector(index, q, 10)).select("query_id", "id")
    got = vector_index.nearest(index, centroids, q, 10, vector_index.probes_for(index, centroids, q, 10)).select("query_id", "id", F.lit(1).alias("got"))
    met = exact.join(got, ["query_id", "id"], "left")
    return met.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.count("got") >= 0.9 * F.count("*")).alias("enough"))


@query("SELECT count(*) AS rows, sum(vec_id) AS ids, TRUE AS nearest FROM embeddings")
def V1_cells(spark, d):
    """Every row is in one cell, and no centroid is nearer than that cell's."""
    index, centroids, _ = _index(spark, d)
    again = vector_index.probed(index.select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), centroids, 1).select(F.col("query_id").alias("id"), F.col("cell").alias("best"))
    return index.join(again, "id").agg(F.count("*").alias("rows"), F.sum("id").alias("ids"), F.bool_and(F.col("cell") == F.col("best")).alias("nearest"))
