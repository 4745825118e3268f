"""Nearest vectors by largest inner product: vantage-point trees, one a shard, pruned by the triangle inequality.

1. Vectors fall into shards of bounded bytes, as they come: nothing is exchanged. Equal vectors of a shard are one point with a list of ids.
2. A shard's points get one more coordinate, which makes all of them as long as its longest vector; a query's is 0. Then the Euclidean
   distance falls as the inner product rises, and distances obey the triangle inequality.
3. Each shard has a tree: a node's vantage point, one of a few that spreads the node's points most, parts them by the median of
   their distances to it, and both parts keep the least and the largest of these. Leaves are slices of the shard's points.
4. Queries meet the shards in blocks. A block goes down to each query's home leaf first, which gives a bound on its k-th distance; then
   through the tree, where a part is left out for the queries whose least possible distance to it, times `factor`, is beyond the
   bound. A task hands the bounds it has for a block on from shard to shard.
5. What is left is scored again on the original vectors, in double precision, and a query's k best of all shards are ranked.

`factor` 1 leaves out only what cannot be among the k best: the search is exact. Larger ones leave out more; recall falls.

Defined cases: vectors that are null, empty, zero or have a null or non-finite component take no part, as candidates or queries; a null id neither; only
vectors of a query's length are compared with it; all rows with the query's own id are its own row and no candidates; other ids that repeat are found as often as they
occur, and an id that repeats among queries asks once, with its least vector; ties go to the smaller id; an empty table, or
no query, gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._common import column, materialise, tidy

#: Bytes of a shard's vectors, and of a block of queries, in double precision.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 512 << 10
#: Points to a leaf, and how many points a vantage point is chosen from, by the spread of their distances to so many others.
LEAF, CHOICES, SPREAD_OVER = 48, 6, 64
#: How much the triangle inequality's bound is raised before a part is left out; 1 is exact. At 5, recall at 20 is 0.986 to 0.988 on vectors of 64
#: nearly independent coordinates (README), whose distances differ so little that bounds are a few hundredths of them.
FACTOR = 5.0
#: Points beyond k that are scored again, as the first scores come from matrix products.
SPARE = 8


class Tree(NamedTuple):
    """Points in the order of the leaves, ids of point i from starts[i] to starts[i + 1], and the nodes: (vantage point, inner child, outer child, first point, end), with the least and largest distance of either part."""

    points: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    nodes: np.ndarray
    bounds: np.ndarray


def lifted(points: np.ndarray) -> np.ndarray:
    """One more coordinate, after which all points are as far from the origin as the farthest."""
    square = (points * points).sum(axis=1)
    return np.column_stack([points, np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))])


def plant(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of some vectors; equal ones become one point, with their ids in order."""
    order = np.lexsort((ids, *points.T[::-1]))
    points, ids = points[order] + 0.0, ids[order]  # -0.0 and 0.0 are equal
    new = np.ones(len(points), bool)
    new[1:] = (points[1:] != points[:-1]).any(axis=1)
    starts = np.append(np.flatnonzero(new), len(points))
    points = points[new]
    high = lifted(points)
    place = np.arange(len(points))
    nodes: list[list[int]] = []
    bounds: list[list[float]] = []
    todo = [(0, len(points), -1, 0)]
    rng = np.random.default_rng(len(points))
    while todo:
        first, end, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([-1, -1, -1, first, end])
        bounds.append([0.0, 0.0, 0.0, 0.0])
        if parent >= 0:
            nodes[parent][1 + side] = me
        if end - first <= leaf:
            continue
        mine = place[first:end]
        some, others = high[rng.choice(mine, min(CHOICES, len(mine)), replace=False)], high[rng.choice(mine, min(SPREAD_OVER, len(mine)), replace=False)]
        best = some[np.argmax(np.sqrt(((some[:, None] - others[None]) ** 2).sum(axis=2)).std(axis=1))]
        far = np.sqrt(((high[mine] - best) ** 2).sum(axis=1))
        half = len(mine) // 2
        by = np.argpartition(far, half)
        place[first:end], far = mine[by], far[by]
        nodes[me][0] = int(place[first:end][np.argmin(far)])
        bounds[me] = [far[:half].min(), far[:half].max(), far[half:].min(), far[half:].max()]
        todo += [(first, first + half, me, 0), (first + half, end, me, 1)]
    # points in the order of the leaves
    sizes = np.diff(starts)[place]
    at = np.repeat(starts[place] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    moved = np.empty(len(place), np.int64)
    moved[place] = np.arange(len(place))
    told = np.array(nodes, np.int32).reshape(-1, 5)
    inner = told[:, 0] >= 0
    told[inner, 0] = moved[told[inner, 0]]
    return Tree(points[place], ids[at], np.append(0, np.cumsum(sizes)), told, np.array(bounds))


def _distance(high: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((high - one) ** 2).sum(axis=1))


def search(tree: Tree, asked: np.ndarray, k: int, factor: float = FACTOR, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, visits): of each vector asked, the k + SPARE best points found with their inner products (place -1: none), and how many points were compared.

    least: scores below which a query needs nothing, as it has k better ones already.
    """
    m, wanted = len(asked), k + SPARE
    high = lifted(tree.points)
    square = (tree.points * tree.points).sum(axis=1).max(initial=0.0) + (asked * asked).sum(axis=1)
    query = np.column_stack([asked, np.zeros(m)])
    slack = 1e-9 * (1.0 + np.sqrt(square))
    places, scores = np.full((m, wanted), -1), np.full((m, wanted), -np.inf)
    least = np.full(m, -np.inf) if least is None else least
    first_id = np.minimum.reduceat(tree.ids, tree.starts[:-1]) if len(tree.points) else tree.ids
    visits = 0

    def reach(of: np.ndarray) -> np.ndarray:
        """The distance beyond which a query needs nothing: that of the worst score it would still take, its own row besides."""
        score = np.maximum(least[of], scores[of, k])
        return np.sqrt(np.maximum(square[of] - 2 * np.where(np.isfinite(score), score, -np.inf), 0.0)) + slack[of]

    def compare(node: int, of: np.ndarray) -> None:
        nonlocal visits
        first, end = tree.nodes[node, 3:5]
        visits += len(of) * (end - first)
        at = np.concatenate([places[of], np.broadcast_to(np.arange(first, end), (len(of), end - first))], axis=1)
        near = np.concatenate([scores[of], asked[of] @ tree.points[first:end].T], axis=1)
        best = np.lexsort((np.where(at < 0, np.iinfo(np.int64).max, first_id[at]), -near), axis=1)[:, :wanted]
        places[of], scores[of] = np.take_along_axis(at, best, 1), np.take_along_axis(near, best, 1)

    home = np.zeros(m, np.int64)
    if len(tree.points):
        todo = [(0, np.arange(m))]
        while todo:
            node, of = todo.pop()
            vantage, inner, outer = tree.nodes[node, :3]
            if vantage < 0:
                home[of] = node
                compare(node, of)
                continue
            low = _distance(query[of], high[vantage]) <= (tree.bounds[node, 1] + tree.bounds[node, 2]) / 2
            todo += [(child, part) for child, part in ((inner, of[low]), (outer, of[~low])) if len(part)]
        todo = [(0, np.arange(m))]
        while todo:
            node, of = todo.pop()
            vantage, inner, outer = tree.nodes[node, :3]
            if vantage < 0:
                of = of[home[of] != node]
                if len(of):
                    compare(node, of)
                continue
            far, most = _distance(query[of], high[vantage]), reach(of)
            for child, (low, top) in ((inner, tree.bounds[node, :2]), (outer, tree.bounds[node, 2:])):
                part = of[np.maximum(low - far, far - top) * factor <= most]
                if len(part):
                    todo.append((child, part))
    return places, scores, visits


def _usable(key: str, vector: str) -> Column:
    v, bad = column(vector), (lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return column(key).isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, bad)


def _matrix(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of each length in a column of lists."""
    size = pc.list_value_length(values).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        of = np.flatnonzero(size == n)
        yield of, pc.list_flatten(values.take(pa.array(of))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(n))


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of one length and of at most so many bytes, over the batches of a task."""
    held: dict[int, list] = {}
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for of, x in _matrix(b.column(1)):
            n, rows = x.shape[1], max(64, most // (8 * x.shape[1]))
            mine = held.setdefault(n, [])
            mine.append((ids[of], x))
            while sum(len(i) for i, _ in mine) >= rows:
                i, x = (np.concatenate(z) for z in zip(*mine, strict=True))
                yield i[:rows], x[:rows]
                mine[:] = [(i[rows:], x[rows:])]
    for mine in held.values():
        if sum(len(i) for i, _ in mine):
            yield tuple(np.concatenate(z) for z in zip(*mine, strict=True))


_INDEX = "size int, points binary, ids binary, starts binary, nodes binary, bounds binary"


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", leaf: int = LEAF, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a shard: its vectors' length, its points and its tree. Every usable row is in one shard; a table to be written and searched again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _shards(batches, shard_bytes):
            t = plant(x, ids, leaf)
            cells = [a.astype(kind).tobytes() for a, kind in zip(t, (np.float64, np.int64, np.int64, np.int32, np.float64), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names=["size", *Tree._fields])

    return vectors.where(_usable(key, vector)).select(column(key).cast("long").alias("id"), column(vector).alias("vector")).mapInArrow(tidy(run), _INDEX)


def _blocks(queries: DataFrame, key: str, vector: str, block_bytes: int) -> DataFrame:
    told = queries.where(_usable(key, vector)).select(column(key).cast("long").alias("id"), column(vector).alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _shards(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([ids.astype(np.int64).tobytes()], pa.binary())], names=["q_size", "q_vectors", "q_ids"])

    return told.mapInArrow(run, "q_size int, q_vectors binary, q_ids binary")


def _tree(b: pa.RecordBatch, i: int, n: int) -> Tree:
    points, ids, starts, nodes, bounds = (np.frombuffer(b.column(j)[i].as_buffer(), kind) for j, kind in zip(range(4, 9), (np.float64, np.int64, np.int64, np.int32, np.float64), strict=True))
    return Tree(points.reshape(-1, n), ids, starts, nodes.reshape(-1, 5), bounds.reshape(-1, 4))


class _Best:
    """The k best (id, score) of each query of a block so far, over the shards that its task has seen."""

    def __init__(self, vectors: np.ndarray, own: np.ndarray, k: int):
        self.vectors, self.own, self.k = vectors, own, k
        self.ids, self.scores = np.full((len(own), k), np.iinfo(np.int64).max), np.full((len(own), k), -np.inf)

    def add(self, tree: Tree, factor: float) -> None:
        places, _, _ = search(tree, self.vectors, self.k, factor, self.scores[:, -1] - 1e-9 * np.abs(np.where(np.isfinite(self.scores[:, -1]), self.scores[:, -1], 0.0)))
        row, col = np.nonzero(places >= 0)
        at = places[row, col]
        score = (self.vectors[row] * tree.points[at]).sum(axis=1)  # the measure itself, alike wherever a vector stands
        # a point's first ids: of more than k + 1 none can be among the k best beside the own one
        many = np.minimum(np.diff(tree.starts)[at], self.k + np.where(np.isin(self.own[row], tree.ids), self._repeats(tree), 0))
        of = np.repeat(np.arange(len(at)), many)
        ids = tree.ids[np.repeat(tree.starts[at], many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)]
        some = ids != self.own[row[of]]
        row, ids, score = row[of][some], ids[some], score[of][some]
        m = len(self.own)
        row, ids, score = np.concatenate([np.repeat(np.arange(m), self.k), row]), np.concatenate([self.ids.ravel(), ids]), np.concatenate([self.scores.ravel(), score])
        best = np.lexsort((ids, -score, row))
        row, ids, score = row[best], ids[best], score[best]
        kept = np.arange(len(row)) - np.searchsorted(row, np.arange(m))[row] < self.k
        self.ids, self.scores = ids[kept].reshape(m, self.k), score[kept].reshape(m, self.k)

    @staticmethod
    def _repeats(tree: Tree) -> int:
        """How often an id occurs in a shard at most."""
        return int(np.unique(tree.ids, return_counts=True)[1].max(initial=1))

    def rows(self) -> pa.RecordBatch:
        row, col = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(self.own[row]), pa.array(self.ids[row, col]), pa.array(self.scores[row, col])], names=["query_id", "id", "score"])


def nearest(shards: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", factor: float = FACTOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, score): of each query (key, vector) the k nearest rows of an index that are found, but its own."""
    if k < 1 or factor < 1:
        raise ValueError("k and factor are at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None
        for b in batches:
            for i in range(b.num_rows):
                n, ids = b.column(0)[i].as_py(), b.column(2)[i].as_py()
                if n != b.column(3)[i].as_py():
                    continue
                if block != ids:
                    if best is not None:
                        yield best.rows()
                    block, best = ids, _Best(np.frombuffer(b.column(1)[i].as_py()).reshape(-1, n), np.frombuffer(ids, np.int64), k)
                best.add(_tree(b, i, n), factor)
        if best is not None:
            yield best.rows()

    # rows are blocks and shards here: a table of queries is compared with every shard, block by block
    pairs = _blocks(queries, key, vector, block_bytes).crossJoin(shards.select("size", *Tree._fields))
    found = pairs.mapInArrow(tidy(run), "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op13_vantage_points(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20, among all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    shards = materialise(index(rows))
    return nearest(shards, rows.where("vec_id % 20 = 0"), 20).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
