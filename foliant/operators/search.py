"""Vector, lexical and hybrid search over chunks with metadata filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.shared import written

RRF_K = 60
#: Chunks and queries to a block of a vector search.
CHUNK_ROWS, QUERY_ROWS = 8_192, 2_048
#: Queries of a block whose products are held at once.
PRODUCT_ROWS = 64
#: Parts of the chunks of a vector search at most, products made at once in double precision, and what rounding a similarity can add.
VECTOR_TASKS, EXACT_ROWS, ROUNDED = 64, 32_768, 1e-6
#: Chunks, their words and sets of words to a block of a text search, its tasks at most, and matches that a task holds before it keeps the best.
TEXT_ROWS, TEXT_WORDS, SET_ROWS, TEXT_TASKS, HELD = 4_096, 1_000_000, 8_192, 64, 200_000
#: Words that carry no meaning in a query.
STOP_WORDS = frozenset("a an and are as at be but by for from has have in into is it its of on or that the their this to was were what which will with".split())


@dataclass
class Filters:
    """Each filter holds only if it is not empty; both dates are inclusive."""

    tickers: list[str] = field(default_factory=list)
    filing_types: list[str] = field(default_factory=list)
    filed_after: date | None = None
    filed_before: date | None = None
    section_path_contains: list[str] = field(default_factory=list)

    def predicate(self) -> Column:
        parts = [F.lit(True)]
        if self.tickers:
            parts.append(F.col("ticker").isin(*[t.upper() for t in self.tickers]))
        if self.filing_types:
            parts.append(F.col("filing_type").isin(*self.filing_types))
        if self.filed_after:
            parts.append(F.col("filed_date") >= F.lit(self.filed_after))
        if self.filed_before:
            parts.append(F.col("filed_date") <= F.lit(self.filed_before))
        if self.section_path_contains:
            parts.append(F.arrays_overlap("section_path", F.array(*map(F.lit, self.section_path_contains))))
        return reduce(lambda a, b: a & b, parts)


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda z, x: z + x)


def cosine(a: str, b: str) -> Column:
    """Cosine similarity of two float arrays, in double precision; null for a zero vector."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def _packed(vectors: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """(ids, size, matrix): vectors of one length as matrices of at most `rows` rows, scaled to length 1; those without a direction are left out."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(vectors.schema[key].dataType)), T.StructField("size", T.IntegerType()), T.StructField("matrix", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                size = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                for n in np.unique(size[size > 0]):
                    of = np.flatnonzero(size == n)
                    x = pc.list_flatten(part.column(1).take(pa.array(of))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(n))
                    length = np.sqrt((x * x).sum(axis=1))
                    some = (length > 0) & np.isfinite(length)
                    ids = part.column(0).take(pa.array(of[some]))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([n], pa.int32()), pa.array([(x[some] / length[some, None]).tobytes()])], names=[f.name for f in schema])

    return vectors.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(run, schema)


def _near_in_block(s: np.ndarray, x: np.ndarray, y: np.ndarray, least: np.ndarray, slack: float, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of y the k rows of x nearest to it, those below `least` left out: places in y and x, and products.

    s: products in single precision, which are off by `slack` at most. They tell what can be among the k, of which products are then made in double precision.
    """
    if len(x) > k and (none := np.isneginf(least)).any():
        least = least.copy()
        least[none] = np.partition(s[none], len(x) - k, axis=1)[:, len(x) - k] - slack - ROUNDED
    rows, cols = np.divmod(np.flatnonzero(s >= (least - slack - ROUNDED).astype(np.float32)[:, None]), len(x))
    sim = np.empty(len(rows))
    for at in range(0, len(rows), EXACT_ROWS):
        some = slice(at, at + EXACT_ROWS)
        sim[some] = np.round(np.einsum("ij,ij->i", y[rows[some]], x[cols[some]]), 6)
    best = np.lexsort((order[cols], -sim, rows))
    rows, cols, sim = rows[best], cols[best], sim[best]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    kept = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows)))) < k
    return rows[kept], cols[kept], sim[kept]


class _Nearest:
    """The k nearest chunks so far of each query of a block."""

    def __init__(self, asked: pa.Array, k: int):
        self.asked, self.k, self.held, self.size = asked, k, [], 0
        self.least = np.full(len(asked), -np.inf)

    def add(self, rows: np.ndarray, ids: pa.Array, sim: np.ndarray) -> None:
        self.held.append(pa.table([pa.array(rows, pa.int64()), ids, pa.array(sim)], names=["_set", "id", "score"]))
        self.size += len(rows)

    def cut(self) -> None:
        best = _k_best(pa.concat_tables(self.held), self.k)
        self.held, self.size = [best], 0
        rows, score = best.column("_set").to_numpy(), best.column("score").to_numpy()
        full = np.bincount(rows, minlength=len(self.asked)) == self.k
        last = np.flatnonzero(np.diff(rows, append=-1))
        self.least[rows[last]] = np.where(full[rows[last]], score[last], -np.inf)


def by_vector(chunks: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """For each query (query_id, query): its k nearest chunks with an embedding of its length: query_id, id, similarity, rank.

    An exact search in blocks: chunks and queries become matrices of bounded size, which are written once, and each pair of blocks is one product.
    Of all chunks of a task only each query's k best leave it, ties by id.
    """
    c = written(_packed(chunks.where(F.lit(True) if where is None else where), "id", "embedding", CHUNK_ROWS))
    asked = written(queries.select("query_id", "query"))
    # in few parts, so that blocks are full
    asked = asked.coalesce(max(1, min(VECTOR_TASKS, asked.count() // (4 * QUERY_ROWS))))
    q = written(_packed(asked, "query_id", "query", QUERY_ROWS).withColumn("q_block", F.monotonically_increasing_id()))
    kinds = [queries.schema["query_id"].dataType, chunks.schema["id"].dataType]
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("id", kinds[1]), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, _Nearest] = {}
        for b in batches:
            for i in range(b.num_rows):
                size, other = b.column(1)[i].as_py(), b.column(4)[i].as_py()
                ids, asked = b.column(0)[i].values, b.column(3)[i].values
                if size != other or not len(ids) or not len(asked):
                    continue
                nearest = found.setdefault(b.column(6)[i].as_py(), _Nearest(asked, k))
                x, y = (np.frombuffer(b.column(j)[i].as_buffer()).reshape(-1, size) for j in (2, 5))
                order = np.empty(len(ids), np.int64)
                order[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
                x4, y4 = x.astype(np.float32), y.astype(np.float32)
                # twice what rounding to single precision and adding up can do to products of such lengths
                slack = (size + 4) * 2.0**-23 * max(1.0, float(np.sqrt((x * x).sum(axis=1).max() * (y * y).sum(axis=1).max())))
                for low in range(0, len(y), 2 * PRODUCT_ROWS):  # of half the size
                    part = slice(low, low + 2 * PRODUCT_ROWS)
                    rows, cols, sim = _near_in_block(y4[part] @ x4.T, x, y[part], nearest.least[part], slack, order, k)
                    if len(rows):
                        nearest.add(low + rows, ids.take(pa.array(cols)), sim)
                if nearest.size > k * len(asked) // 2:
                    nearest.cut()
        for nearest in found.values():
            if nearest.held:
                nearest.cut()
                best = nearest.held[0].combine_chunks()
                for at in range(0, best.num_rows, 65_536):
                    some = best.slice(at, 65_536).to_batches()[0]
                    yield pa.RecordBatch.from_arrays([nearest.asked.take(some.column(0)), some.column(1), some.column(2)], names=schema.names)

    # rows are blocks here: a table of queries is compared with all chunks, block by block
    pairs = c.coalesce(VECTOR_TASKS).crossJoin(q.select(F.col("ids").alias("q_ids"), F.col("size").alias("q_size"), F.col("matrix").alias("q_matrix"), "q_block"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return pairs.mapInArrow(run, schema).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def terms(text: str) -> Column:
    """Words in lower case, in order, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*sorted(STOP_WORDS)))


def _words(query: str) -> list[str]:
    """The terms of a query, each once."""
    return [w for w in dict.fromkeys("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()) if w not in STOP_WORDS]


def by_text(chunks: DataFrame, query: str | DataFrame, k: int, where: Column | None = None, text: str = "text") -> DataFrame:
    """Chunks that have all terms of the query, by the share of the query's terms among the chunk's: id, score, rank. A query of stop words matches nothing.

    For queries as rows (query_id, query_text): query_id, id, score, rank, each query's k.
    """
    if isinstance(query, DataFrame):
        return _by_texts(chunks, query, k, where, text)
    wanted = _words(query)
    if not wanted:
        return chunks.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    top = scored(chunks if where is None else chunks.where(where), query, text).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # over k rows


def scored(chunks: DataFrame, query: str, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """(by, id, score) of the chunks that have all terms of a query."""
    wanted = _words(query)
    found = chunks.select(*(by or []), "id", terms(text).alias("_terms")).where(F.size(F.array_except(F.array(*map(F.lit, wanted)), "_terms")) == 0)
    return found.select(*(by or []), "id", F.round(F.size(F.filter("_terms", lambda t: t.isin(*wanted))) / F.size("_terms"), 6).alias("score"))


def _chunk_blocks(found: DataFrame) -> DataFrame:
    """(ids, lengths, words, starts, rows, counts) of (id, terms): blocks of chunks in order of id, and where each word of a block stands and how often."""
    kinds = {"ids": found.schema["id"].dataType, "lengths": T.IntegerType(), "words": T.StringType(), "starts": T.IntegerType(), "rows": T.IntegerType(), "counts": T.IntegerType()}
    schema = T.StructType([T.StructField(n, T.ArrayType(kind)) for n, kind in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, at = np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)), 0
            while at < b.num_rows:
                size = max(1, min(TEXT_ROWS, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_WORDS, "right")) - at))
                part, at = b.slice(at, size), at + size
                part = part.take(pc.array_sort_indices(part.column(0), null_placement="at_start"))
                coded = pc.list_flatten(part.column(1)).dictionary_encode()
                key = coded.indices.to_numpy().astype(np.int64) * part.num_rows + pc.list_parent_indices(part.column(1)).to_numpy()
                key, counts = np.unique(key, return_counts=True)
                starts = np.searchsorted(key, np.arange(len(coded.dictionary) + 1) * part.num_rows)
                cols = [part.column(0), pc.list_value_length(part.column(1)), coded.dictionary, *[pa.array(x.astype(np.int32)) for x in (starts, key % part.num_rows, counts)]]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols], names=schema.names)

    return found.mapInArrow(run, schema)


def _set_blocks(sets: DataFrame) -> DataFrame:
    """(sets, asked, firsts, of) of (set, words): blocks of sets, the words that they ask for, and which of these each set has."""
    schema = "sets array<bigint>, asked array<string>, firsts array<int>, of array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SET_ROWS):
                part = b.slice(at, SET_ROWS)
                coded = pc.list_flatten(part.column(1)).dictionary_encode()
                firsts = np.append(0, np.cumsum(pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)))
                cols = [part.column(0), coded.dictionary, pa.array(firsts.astype(np.int32)), coded.indices]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols], names=["sets", "asked", "firsts", "of"])

    return sets.select("_set", "_words").mapInArrow(run, schema)


def _best_of_block(row: dict[str, pa.Array], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set of a pair of blocks the k best chunks that have all of its words: places of sets and of chunks, and scores."""
    lengths, starts, rows, counts, firsts, of = (row[n].to_numpy() for n in ("lengths", "starts", "rows", "counts", "firsts", "of"))
    there = pc.fill_null(pc.index_in(row["asked"], value_set=row["words"]), -1).to_numpy()[of]
    none = np.zeros(0, np.int64)
    found = [(none, none, np.zeros(0))]
    for s in np.flatnonzero(np.minimum.reduceat(there, firsts[:-1]) >= 0):
        words = there[firsts[s] : firsts[s + 1]]
        words = words[np.argsort(starts[words + 1] - starts[words])]  # the rarest first
        at, n = rows[starts[words[0]] : starts[words[0] + 1]], counts[starts[words[0]] : starts[words[0] + 1]]
        for w in words[1:]:
            others = rows[starts[w] : starts[w + 1]]
            place = np.minimum(np.searchsorted(others, at), len(others) - 1)
            same = others[place] == at
            at, n = at[same], n[same] + counts[starts[w] + place[same]]
        score = np.floor(n / lengths[at] * 1e6 + 0.5) / 1e6
        if len(at) > k:  # chunks are in order of id, which decides between equal scores
            least = np.partition(score, len(at) - k)[len(at) - k]
            better = np.flatnonzero(score > least)
            kept = np.concatenate([better, np.flatnonzero(score == least)[: k - len(better)]])
            at, score = at[kept], score[kept]
        found.append((np.full(len(at), s), at, score))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _k_best(found: pa.Table, k: int) -> pa.Table:
    """Each set's k best, ties by id."""
    found = found.take(pc.sort_indices(found, sort_keys=[("_set", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
    of = found.column("_set").to_numpy()
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))[: len(of)]
    return found.filter(pa.array(np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of)))) < k))


def best_of_sets(blocks: DataFrame, sets: DataFrame, kind: T.DataType, k: int, best_of_block: Callable[[dict[str, pa.Array], int], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(_set, id, score): of each set (_set, _words) the k best chunks of all blocks, by what finds those of a pair of blocks. Of a task's matches, each set's k best leave it."""
    schema = T.StructType([T.StructField("_set", T.LongType()), T.StructField("id", kind), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, most = 0, HELD
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].values for n in b.schema.names}
                s, at, score = best_of_block(row, k)
                held.append(pa.table([row["sets"].take(pa.array(s)), row["ids"].take(pa.array(at)), pa.array(score)], names=schema.names))
                size += len(s)
                if size > most:
                    held = [_k_best(pa.concat_tables(held), k)]
                    size = held[0].num_rows
                    most = max(HELD, 2 * size)
        if held:
            yield from _k_best(pa.concat_tables(held), k).to_batches(max_chunksize=65_536)

    # rows are blocks here, and those of sets of words are sent
    pairs = blocks.crossJoin(F.broadcast(_set_blocks(sets.coalesce(8))))
    of_set = Window.partitionBy("_set").orderBy(F.desc("score"), "id")
    return pairs.mapInArrow(run, schema).withColumn("_n", F.row_number().over(of_set)).where(F.col("_n") <= k)


def _by_texts(chunks: DataFrame, queries: DataFrame, k: int, where: Column | None, text: str) -> DataFrame:
    """Blocks of chunks meet blocks of sets of words, where queries with the same words are one set.

    Matches do not leave a task: of all that its chunks give a set, the k best do. So what is exchanged is at most k rows for each
    set and task, of which there are TEXT_TASKS at most, and neither texts nor words.
    """
    asked = written(queries.select("query_id", F.array_sort(F.array_distinct(terms("query_text"))).alias("_words")).where(F.size("_words") > 0))
    sets = written(asked.select("_words").distinct().withColumn("_set", F.monotonically_increasing_id()))
    found = (chunks if where is None else chunks.where(where)).select("id", terms(text).alias("_terms")).where(F.size("_terms") > 0)
    best = best_of_sets(_chunk_blocks(found.coalesce(TEXT_TASKS)), sets, chunks.schema["id"].dataType, k, _best_of_block)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    told = asked.join(sets, "_words").select("query_id", "_set").join(best, "_set")
    return told.select("query_id", "id", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _equals(word: str):
    return lambda t: t == word


def bm25(chunks: DataFrame, query: str, k: int, text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 over any of the query's terms: id, score, rank."""
    wanted = _words(query)
    docs = chunks.select("id", terms(text).alias("_terms"))
    counts = [F.size(F.filter("_terms", _equals(w))).alias(f"n{i}") for i, w in enumerate(wanted)]
    t = docs.select("id", F.size("_terms").alias("len"), *counts)
    stats = t.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        n = F.col(f"n{i}")
        score = score + idf * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    top = t.join(F.broadcast(stats)).select("id", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)  # one row is sent
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(vector: DataFrame, text: DataFrame, k: int, rrf_k: int = RRF_K, by: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, rank): id, score, rank. Ties: by vector rank, those without it last, then by text rank.

    If both have a query_id (or what `by` names), lists are fused by query, and each keeps its k; otherwise they are those of one query.
    """
    if by is None:
        by = ["query_id"] if "query_id" in vector.columns and "query_id" in text.columns else []
    v = vector.select(*by, "id", F.col("rank").alias("vector_rank"))
    t = text.select(*by, "id", F.col("rank").alias("text_rank"))
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    both = v.join(t, [*by, "id"], "full").select(*by, "id", "vector_rank", "text_rank", F.round(part("vector_rank") + part("text_rank"), 9).alias("score"))
    order = [F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("text_rank")]
    top = both if by else both.orderBy(*order).limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(*by, "id", "score", "vector_rank", "text_rank", "rank")


def hybrid(chunks: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """For each query (query_id, query, query_text): vector and text candidates, three times k of each, fused."""
    return fuse(by_vector(chunks, queries, 3 * k, where), by_text(chunks, queries, 3 * k, where), k)


def merge(ranked: DataFrame, k: int) -> DataFrame:
    """Lists of several sub-queries (sub, id, score, rank) as one: each chunk once with its best score; ties in order of first sight. With a query_id: one for each."""
    by = ["query_id"] if "query_id" in ranked.columns else []
    best = ranked.groupBy(*by, "id").agg(F.max("score").alias("score"), F.min(F.struct("sub", "rank")).alias("seen"))
    if not by:
        return best.orderBy(F.desc("score"), "seen").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "seen"))).select("id", "score", "rank")
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "seen")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "id", "score", "rank")


#: Signals of questions about several facts, and terms that filers phrase in other words.
DECOMPOSE = (
    r"(?i)\b(vs\.?|versus|relative\s+to|compar(e|ed|ing)\b|as\s+a?\s*%\s*of|as\s+percentage\s+of|faster\s+than|slower\s+than|"
    r"comes?\s+from.*\bvs\b|trajectory|trend|ratio\s+of|growing.*(faster|slower)|buyback.*operational|operational.*buyback)"
)
EXPAND = r"(?i)\b(supply\s+chain|contingent\s+liabilit|capital\s+intensity|buyback|EBITDA|customer\s+concentration|moat|switching\s+cost|pricing\s+power)"


def route(question: Column) -> Column:
    """'decompose', 'expand' or null; the first wins."""
    return F.when(F.rlike(question, F.lit(DECOMPOSE)), "decompose").when(F.rlike(question, F.lit(EXPAND)), "expand")


def sub_queries(answer: Column, original: Column) -> Column:
    """A rewriter's lines without blank ones and headings; the question itself where nothing is left."""
    lines = F.transform(F.split(answer, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~F.startswith(F.lower(x), F.lit("rewritten")) & ~F.startswith(F.lower(x), F.lit("original")))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(original))
