"""An index over vectors: a coarse quantiser, a cell for every row, searches that probe a few cells and rank exactly within them.

1. Centroids: spherical k-means on a sample of at most SAMPLE rows (and SAMPLE_BYTES), drawn by a hash of the id. Only the sample meets in
   one place; its size does not depend on the table's.
2. Every row gets the cell of its nearest centroid. The table is written in ranges of (cell, id) and sorted, so that a cell that
   holds a third of all rows spreads over as many ranges as it needs, and a filter by cell skips the other files.
3. How many cells to probe is measured, not guessed: for a bounded number of queries, the exact neighbours' cells are ranked by the
   queries' centroids, and the least number of probes is taken that finds the wanted share of them. Where vectors have
   structure this is a few cells, where they have none about half of them.
4. A search sends each query to its cells, by an equi-join of blocks of bounded bytes on the cell; a pair of blocks is one product, of
   which each query's best leave. Scores are exact cosines; what is approximate is only which rows are looked at. With as many probes as
   cells the search is exact, as is `search.by_vector`, the other mode.

Defined cases: vectors that are null, empty, zero, of another length than the centroids' or not finite have no cell and are not in the index; queries of that
kind find nothing; ties by id; an empty table has no centroids and its searches no rows; other columns come through, for filters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.shared import new_path, written
from foliant.operators import search

#: Rows and bytes of the sample that centroids are fitted on, rounds of the fit, and the most cells.
SAMPLE, SAMPLE_BYTES, ROUNDS, MOST_CELLS = 20_000, 64 << 20, 10, 4_096
#: Queries that the number of probes is measured with, and the share of their neighbours that is wanted.
CHECKED, RECALL = 256, 0.95
#: Bytes of a block of vectors in double precision, and rows of a block of queries.
BLOCK_BYTES, QUERY_ROWS = 4 << 20, 1_024


def _unit(values: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of the lists of n numbers that have a direction, at length 1."""
    of = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(values), n), False).to_numpy(zero_copy_only=False))
    x = pc.fill_null(pc.list_flatten(values.take(pa.array(of))), float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
    length = np.sqrt((x * x).sum(axis=1))
    some = (length > 0) & np.isfinite(length)
    return of[some], x[some] / length[some, None]


def _blocks_of(values: pa.Array, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, similarities to all centroids), a bounded number of rows at a time."""
    of, x = _unit(values, centroids.shape[1])
    step = max(1, BLOCK_BYTES // (8 * max(centroids.shape)))
    for at in range(0, len(of), step):
        yield of[at : at + step], x[at : at + step] @ centroids.T


def fit(vectors: DataFrame, cells: int | None = None, key: str = "id", vector: str = "embedding", seed: int = 7) -> np.ndarray:
    """Centroids of a table's vectors of its most frequent length, as rows of length 1; by default as many as the root of the number of rows."""
    told = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "size").first()
    if told is None:
        return np.empty((0, 0))
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * told["size"])))
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / told["rows"]))
    some = vectors.where((F.size(vector) == told["size"]) & share).select(F.col(vector).alias("v")).toArrow()  # the sample
    _, x = _unit(some.column(0).combine_chunks() if some.num_rows else pa.array([], pa.list_(pa.float64())), told["size"])
    x = x[np.lexsort(x.T)]  # whatever order it came in
    rng = np.random.default_rng(seed)
    cells = min(cells or max(1, min(MOST_CELLS, math.isqrt(told["rows"]))), len(x))
    centroids = x[np.sort(rng.choice(len(x), cells, replace=False))].copy() if len(x) else np.empty((0, told["size"]))
    for _ in range(ROUNDS if cells else 0):
        cell = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        length = np.sqrt((sums * sums).sum(axis=1))
        centroids[length > 0] = sums[length > 0] / length[length > 0, None]
    return centroids


def cells(vectors: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """`vectors` with the cell of each row; rows without one are left out."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for of, near in _blocks_of(b.column(b.schema.get_field_index(vector)), centroids):
                part = b.take(pa.array(of))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.argmax(near, axis=1).astype(np.int32))], names=[f.name for f in schema])

    if not len(centroids):
        return vectors.withColumn("cell", F.lit(0)).limit(0)
    return vectors.mapInArrow(run, schema)


def write(vectors: DataFrame, centroids: np.ndarray, path: str | None = None, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The index: every row with its cell, in ranges of (cell, id), sorted; read again."""
    spark = vectors.sparkSession
    path = path or new_path(spark)
    made = cells(vectors, centroids, vector)
    made.repartitionByRange("cell", key).sortWithinPartitions("cell", key).write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def probed(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(query_id, query, cell, nth) for the cells of each query (query_id, query), nearest first."""
    schema = T.StructType([queries.schema["query_id"], queries.schema["query"], T.StructField("cell", T.IntegerType()), T.StructField("nth", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for of, near in _blocks_of(b.column(1), centroids):
                nearest = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
                for at, cells_ in zip(of, nearest, strict=True):
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, 1).take(pa.array(np.zeros(len(cells_), np.int64))) for c in b.columns), pa.array(cells_), pa.array(np.arange(len(cells_), dtype=np.int32))], names=[f.name for f in schema])

    return queries.select("query_id", "query").mapInArrow(run, schema)


def probes_for(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, recall: float = RECALL, where: Column | None = None) -> int:
    """The least number of probes that finds `recall` of the k nearest of at most CHECKED queries, drawn by a hash; found by one exact scan."""
    some = written(queries.select("query_id", "query").orderBy(F.xxhash64("query_id"), "query_id").limit(CHECKED))
    exact = search.by_vector(index, some, k, where).select("query_id", "id").join(index.select("id", "cell"), "id")
    nth = probed(some, centroids, len(centroids)).select("query_id", "cell", "nth")
    ranks = np.sort([r.nth for r in exact.join(nth, ["query_id", "cell"]).select("nth").collect()])  # CHECKED times k numbers at most
    return int(ranks[max(0, math.ceil(recall * len(ranks)) - 1)]) + 1 if len(ranks) else 1


def _by_cell(rows: DataFrame, key: str, vector: str, most: int | None) -> DataFrame:
    """(cell, ids, size, matrix): rows in order of their cells as matrices of bounded bytes (and at most so many rows), each of one cell."""
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("ids", T.ArrayType(rows.schema[key].dataType)), T.StructField("size", T.IntegerType()), T.StructField("matrix", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(0).to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))
            for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                n = len(b.column(2)[int(first)])
                of, x = _unit(b.column(2).slice(first, end - first), n)
                step = max(1, min(most or len(cell), BLOCK_BYTES // (8 * max(1, n))))
                for at in range(0, len(of), step):
                    ids = b.column(1).take(pa.array(first + of[at : at + step]))
                    yield pa.RecordBatch.from_arrays([pa.array([cell[first]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([n], pa.int32()), pa.array([x[at : at + step].tobytes()])], names=[f.name for f in schema])

    return rows.select("cell", key, vector).mapInArrow(run, schema)


def _best(near: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's k largest, ties by id."""
    order = np.empty(len(ids), np.int64)
    order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    least = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(near), -np.inf)
    rows, cols = np.nonzero(near >= least[:, None])
    best = np.lexsort((order[cols], -near[rows, cols], rows))
    rows, cols = rows[best], cols[best]
    kept = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(near)))[rows] < k
    return rows[kept], cols[kept]


def _products(x: np.ndarray, y: np.ndarray, ids: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, columns, similarities): of each row of y the k nearest rows of x, with products of a bounded number of queries held at once."""
    for at in range(0, len(y), search.PRODUCT_ROWS):
        near = y[at : at + search.PRODUCT_ROWS] @ x.T
        np.round(near, 6, out=near)
        rows, cols = _best(near, ids, k)
        yield at + rows, cols, near[rows, cols]


def nearest(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int, where: Column | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): of each query (query_id, query) the k nearest rows in the cells that it probes."""
    kinds = [queries.schema["query_id"].dataType, index.schema["id"].dataType]
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("id", kinds[1]), T.StructField("similarity", T.DoubleType())])
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    if not len(centroids):
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.row_number().over(w))
    c = _by_cell(index.where(F.lit(True) if where is None else where), "id", "embedding", None)
    sent = probed(queries, centroids, probes).repartitionByRange("cell", "query_id").sortWithinPartitions("cell", "query_id")
    q = _by_cell(sent, "query_id", "query", QUERY_ROWS).toDF("cell", "q_ids", "q_size", "q_matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n, ids, asked = b.column(2)[i].as_py(), b.column(1)[i].values, b.column(4)[i].values
                x, y = (np.frombuffer(b.column(j)[i].as_buffer()).reshape(-1, n) for j in (3, 6))
                for rows, cols, similar in _products(x, y, ids, k):
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(rows)), ids.take(pa.array(cols)), pa.array(similar)], names=["query_id", "id", "similarity"])

    pairs = c.join(q, "cell").select("cell", "ids", "size", "matrix", "q_ids", "q_size", "q_matrix").where("size = q_size")
    return pairs.mapInArrow(run, schema).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
