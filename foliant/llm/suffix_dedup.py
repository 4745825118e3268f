"""Removes every byte of strings of a given length that start more than once anywhere in a corpus.

Suffixes are compared by prefix polynomial hashes: with the running sums of byte values times powers of a
base, modulo 2^64, the hash of any substring takes one subtraction and one product, so two suffixes
compare at any extent in constant time. Here that is the extent of 200 bytes: suffixes are grouped by it, not ordered at
every extent, so there is no binary search for how far two agree.
Sorting all suffixes of a large corpus is not affordable, and not needed to find repeats of 200 bytes:

1. Sampled suffixes. In each window of 200 bytes the 73-byte substring with the least hash is its anchor
   (leftmost of equals). Equal windows have equal anchors at equal places, so windows are compared among
   those of equal anchors only. Neighbouring windows with one anchor form a run, about 65 of them.
2. The anchor is what all windows of a run have in common. Anchors are merged by hash over the corpus;
   where one occurs once, no window of its run is repeated. (One exchange, combined before it.)
3. All windows of a run together are one string too. Where the same occurs twice around its anchor, all
   windows of the run are repeated.
4. What is left lies between the two extents: runs at the edge of a repeated passage. Their contexts, one
   for each different string, come together by anchor and are sorted by the hashes of their suffixes at the
   200-byte extent; neighbours with equal hashes are compared byte by byte, which settles collisions.
   Anchors with very many different contexts are not brought together: their windows are counted by
   two hashes, combined before the exchange.
5. The spans go back to their documents, are united and cut out.

The merging is the external sort and sort-merge join of Spark rather than a merge sort of one process, so
that no task ever holds more than its share; step 3 compares by two independent 64-bit hashes.

Defined cases: a null text is empty; texts shorter than the length lose nothing; a row that is repeated
loses every byte that a window covers, like any other copy; equal keys with different texts are told
apart by a hash of the text; null keys are keys; bytes are those of UTF-8, and `clean` drops what is left of
a character that was cut; an empty table gives an empty table; columns with an output's name are replaced.
Texts of any length are read in segments, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._common import column, drop_written, materialise, tidy, without

LENGTH = 200
#: Window starts that are read at a time.
SEGMENT = 1 << 17
#: Different contexts of an anchor that are sorted together at most; beyond, their windows are counted.
TOGETHER = 4_096
#: Contexts, of whole anchors, whose windows are in memory at a time, if one anchor does not have more.
LOT = 1_024

_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Hasher:
    """Prefix polynomial hashes modulo 2^64 with random values for bytes and a random odd base."""

    def __init__(self, seed: int, most: int):
        draw = np.random.default_rng(seed)
        self.value = draw.integers(1, 1 << 63, 256, dtype=_U)
        base = int(draw.integers(1 << 20, 1 << 62)) | 5
        self.power = self._powers(base, most)
        self.inverse = self._powers(pow(base, -1, 1 << 64), most)

    @staticmethod
    def _powers(base: int, most: int) -> np.ndarray:
        out = np.full(most + 1, base, _U)
        out[0] = 1
        return np.cumprod(out, dtype=_U)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums along the last axis, with a zero first."""
        out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), _U)
        np.cumsum(self.value[data] * self.power[: data.shape[-1]], axis=-1, out=out[..., 1:])
        return out

    def part(self, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self.inverse[start])


@lru_cache(4)
def _hashers(length: int) -> tuple[Hasher, Hasher]:
    most = SEGMENT + 2 * length
    return Hasher(11, most), Hasher(23, most)


def places(length: int) -> int:
    """How many places an anchor can have in a window."""
    return max(1, min(128, length * 16 // 25))


def runs(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Running sums, hashes of all places, and first window, last window and anchor of each run in one segment."""
    w = places(length)
    k = length - w + 1
    n = len(data) - length + 1
    sums = _hashers(length)[0].sums(data)
    h = _hashers(length)[0].part(sums, slice(0, len(data) - k + 1), slice(k, len(data) + 1))
    # sliding minimum by blocks of w: from each place to its block's end, and from its block's start to it
    bits = _U(max(1, (w - 1).bit_length()))
    mask = (_U(1) << bits) - _U(1)
    rows = -(-len(h) // w) + 1
    keyed = np.full(rows * w, ~_U(0))
    keyed[: len(h)] = h & ~mask
    keyed = keyed.reshape(rows, w)
    keyed[: -(-len(h) // w)] |= np.arange(w, dtype=_U)
    ahead = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    behind = np.minimum.accumulate(keyed, axis=1).reshape(-1)[w - 1 : w - 1 + n]
    s = np.arange(n)
    first = (ahead >> bits) <= (behind >> bits)
    anchor = np.where(first, s // w * w + (ahead & mask).astype(np.int64), (s + w - 1) // w * w + (behind & mask).astype(np.int64))
    at = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    return sums, h, at, np.concatenate([at[1:], [n]]) - 1, anchor[at]


def _packed(start: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First window, least and largest place of the anchor, and how often (0: a span known to be repeated; its end stands for a hash)."""
    return start.astype(np.int64) << 32 | low.astype(np.int64) << 24 | high.astype(np.int64) << 16 | np.minimum(n, 0xFFFF)


def _same(data: np.ndarray, s1: np.ndarray, s2: np.ndarray, at: np.ndarray, to: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of the runs `at` and `to` are equal, byte by byte."""
    out = s2[at] - s1[at] == s2[to] - s1[to]
    span = np.arange(places(length) - 1 + length)
    for lot in range(0, len(at), 4096):
        a, b = at[lot : lot + 4096], to[lot : lot + 4096]
        beyond = span >= (s2[a] - s1[a])[:, None] + length
        x, y = (data[np.minimum(s1[i][:, None] + span, len(data) - 1)] for i in (a, b))
        out[lot : lot + 4096] &= ((x == y) | beyond).all(axis=1)
    return out


def document_runs(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, string hash, second hash, packed place) of all runs of a text. Strings that a segment repeats stand once, the others as spans."""
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(text) - length + 1, SEGMENT):
        data = np.frombuffer(text, np.uint8)[a : a + SEGMENT + length - 1]
        sums, h, s1, s2, p = runs(data, length)
        whole = _hashers(length)[0].part(sums, s1, s2 + length)
        low, high = p - s2, p - s1
        again, count = np.zeros(len(p), bool), np.ones(len(p), np.int64)
        _, one, which = np.unique(whole, return_index=True, return_inverse=True)
        if len(one) < len(p):
            again[:] = True
            again[one] = False
            told = np.flatnonzero(again)
            again[told[~_same(data, s1, s2, told, one[which[told]], length)]] = False  # a collision: a string of its own
            np.add.at(count, one[which[again]], 1)
            spans = np.flatnonzero(again)
            end = s2[spans] + length
            # unite what touches
            order = np.argsort(s1[spans], kind="stable")
            start, end = s1[spans][order], np.maximum.accumulate(end[order])
            new = np.concatenate([[True], start[1:] > end[:-1]])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(start)]]) - 1
            zero = np.zeros(len(first), np.int64)
            key = _mixed((start[first] + a).astype(_U) * _U(0x9E3779B97F4A7C15) + h[0])
            out.append((key, (end[last] + a).astype(_U), zero.astype(_U), _packed(start[first] + a, zero, zero, zero)))
        keep = ~again
        second = _hashers(length)[1].sums(data)
        check = _hashers(length)[1].part(second, s1[keep], s2[keep] + length)
        out.append((h[p[keep]], whole[keep], check, _packed(s1[keep] + a, low[keep], high[keep], count[keep])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, _U),) * 3 + (np.empty(0, np.int64),)


def _key_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(column(key).alias("_key"), F.xxhash64(column(text)).alias("_hash"), F.coalesce(column(text), F.lit("")).cast("binary").alias("_text"))


def _place(df: DataFrame) -> DataFrame:
    at = F.col("at")
    low, high = F.shiftright(at, 24).bitwiseAND(F.lit(0xFF)), F.shiftright(at, 16).bitwiseAND(F.lit(0xFF))
    return df.select(*[column(c) for c in df.columns if c != "at"], F.shiftright(at, 32).alias("start"), low.cast("int").alias("low"), high.cast("int").alias("high"), at.bitwiseAND(F.lit(0xFFFF)).alias("n"))


def _take(column_: pa.Array, at: list[int] | np.ndarray) -> pa.Array:
    return column_.take(pa.array(at, pa.int64()))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, together: int = TOGETHER) -> DataFrame:
    """(_key, _hash, spans): for each text that has any, the byte spans struct<a, b> that repeated strings cover; they may overlap."""
    if length < 2:
        raise ValueError("strings of at least 2 bytes are compared")
    w = places(length)
    kind = docs.schema[key].dataType
    texts = _key_text(docs, key, text)
    named = [T.StructField("_key", kind), T.StructField("_hash", T.LongType())]
    schema = T.StructType([*named, *[T.StructField(n, T.LongType()) for n in ("anchor", "string", "check", "at")]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i, t in enumerate(b.column(2)):
                found = document_runs(t.as_py(), length)
                rows.append((i, found))
                size += len(found[0])
                if size > 100_000 or i + 1 == b.num_rows:
                    at = np.repeat([i for i, _ in rows], [len(f[0]) for _, f in rows])
                    cols = [np.concatenate(c).view(np.int64) for c in zip(*(f for _, f in rows), strict=True)]
                    yield pa.RecordBatch.from_arrays([_take(b.column(0), at), _take(b.column(1), at), *map(pa.array, cols)], names=[f.name for f in schema])
                    rows, size = [], 0

    found = texts.mapInArrow(tidy(read), schema)
    times = F.col("at").bitwiseAND(F.lit(0xFFFF))
    anchors = found.where(times > 0).groupBy("anchor").agg(F.sum(times).alias("c")).where("c > 1")
    kept = materialise(found.join(anchors, "anchor", "left").where((times == 0) | F.col("c").isNotNull()).drop("c"))
    placed = _place(kept)
    known = placed.where("n = 0").select("_key", "_hash", F.col("start").alias("a"), F.col("string").alias("b"))
    run = placed.where("n > 0")
    string = ["anchor", "string", "check", "low", "high"]
    strings = run.groupBy(*string).agg(F.sum("n").alias("n"), F.min(F.struct("_key", "_hash", "start")).alias("one"))
    strings = materialise(strings.withColumn("id", F.monotonically_increasing_id()))
    whole = run.join(strings.where("n > 1").select(*string), string, "left_semi").select("_key", "_hash", F.col("start").alias("a"), (F.col("start") + F.col("high") - F.col("low") + length).alias("b"))

    # contexts: all strings of the anchors that have a string of one occurrence
    mixed = strings.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("least = 1 and contexts > 1").select("anchor", "contexts")
    asked = strings.join(mixed, "anchor").select(F.col("one._key").alias("_k"), F.col("one._hash").alias("_h"), F.struct("anchor", "contexts", "id", "n", "low", "high", F.col("one.start").alias("start")).alias("run"))
    by_text = asked.groupBy("_k", "_h").agg(F.collect_list("run").alias("runs"))  # fewer than the text has bytes
    wanted = texts.join(by_text, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h"))).select("_key", "_hash", F.explode("runs").alias("run"), "_text")
    context = F.substring(F.col("_text"), (F.col("run.start") + 1).cast("int"), F.col("run.high") - F.col("run.low") + length)
    contexts = wanted.select("_key", "_hash", "run.*", context.alias("context")).dropDuplicates(["id"])
    contexts = materialise(contexts)

    span_schema = T.StructType([*named, T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; anchors are settled a few thousand contexts at a time."""
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            at, a, b = repeats_among(table["context"].to_pylist(), table["low"].to_numpy(), table["high"].to_numpy(), length)
            once = table["n"].to_numpy()[at] == 1
            at, a, b = at[once], a[once], b[once]
            start = table["start"].to_numpy()[at]
            part = table.select(["_key", "_hash"]).take(pa.array(at))
            for x in part.append_column("a", pa.array(start + a)).append_column("b", pa.array(start + b)).combine_chunks().to_batches():
                yield x

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 2 * together:
                table = pa.Table.from_batches(held)
                ids = table["anchor"].to_numpy()
                cut = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if (ids != ids[-1]).any() else 0
                if cut:
                    for lot in _lots(ids[:cut], LOT):
                        yield from done(table.slice(lot[0], lot[1] - lot[0]).combine_chunks())
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            for lot in _lots(table["anchor"].to_numpy(), LOT):
                yield from done(table.slice(lot[0], lot[1] - lot[0]).combine_chunks())

    few = contexts.where(F.col("contexts") <= together).repartition("anchor").sortWithinPartitions("anchor")
    settled = few.mapInArrow(tidy(settle), span_schema)

    window_schema = T.StructType([*named, T.StructField("n", T.LongType()), T.StructField("a", T.LongType()), T.StructField("window", T.LongType()), T.StructField("check", T.LongType())])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for lot in range(0, whole_batch.num_rows, 1024):
                b = whole_batch.slice(lot, 1024)
                low, high, start = (b.column(c).to_numpy() for c in ("low", "high", "start"))
                first, second, valid = context_windows(b.column("context").to_pylist(), low, high, length)
                at, c = np.nonzero(valid)
                a = start[at] + high[at] - (w - 1 - c)
                yield pa.RecordBatch.from_arrays([_take(b.column("_key"), at), _take(b.column("_hash"), at), _take(b.column("n"), at), pa.array(a), pa.array(first[at, c].view(np.int64)), pa.array(second[at, c].view(np.int64))], names=[f.name for f in window_schema])

    each = contexts.where(F.col("contexts") > together).mapInArrow(tidy(windows), window_schema)
    twice = each.groupBy("window", "check").agg(F.count("*").alias("c")).where("c > 1").select("window", "check")
    counted = each.where("n = 1").join(twice, ["window", "check"], "left_semi").select("_key", "_hash", "a", (F.col("a") + length).alias("b"))

    spans = known.unionByName(whole).unionByName(settled).unionByName(counted)
    out = materialise(spans.groupBy("_key", "_hash").agg(F.collect_list(F.struct("a", "b")).alias("spans")))  # fewer than the text has bytes
    for step in (kept, strings, contexts):
        drop_written(docs.sparkSession, step)
    return out


def _lots(ids: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts sorted ids into lots of whole groups of about `most` rows."""
    ends = np.concatenate([np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])
    start, end = 0, 0
    for e in ends:
        if e - start > most and end > start:
            yield start, end
            start = end
        end = int(e)
    if end > start:
        yield start, end


def _laid(contexts: list[bytes], high: np.ndarray, length: int) -> np.ndarray:
    """Contexts as rows of bytes, anchors one below the other."""
    w = places(length)
    x = np.zeros((len(contexts), w - 1 + length), np.uint8)
    for i, c in enumerate(contexts):
        at = w - 1 - high[i]
        x[i, at : at + len(c)] = np.frombuffer(c, np.uint8)
    return x


def context_windows(contexts: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of the windows of each context by column, the last column being the window that starts with the anchor, and which are the run's own."""
    w = places(length)
    x = _laid(contexts, high, length)
    out = []
    for hasher in _hashers(length):
        sums = hasher.sums(x)
        out.append(_mixed((sums[:, length : length + w] - sums[:, :w]) * hasher.inverse[:w]))
    offset = w - 1 - np.arange(w)
    return out[0], out[1], (offset >= low[:, None]) & (offset <= high[:, None])


def repeats_among(contexts: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, a, b): spans, relative to each context's first byte, of windows that another of the contexts has.

    The suffixes at all windows are sorted by the hash of their first `length` bytes; equal neighbours are compared
    byte by byte with the first of them, and where that fails (a collision) all of that hash by their bytes.
    """
    w = places(length)
    x = _laid(contexts, high, length)
    first, _, valid = context_windows(contexts, low, high, length)
    at, c = np.nonzero(valid)
    h = first[at, c]
    order = np.argsort(h, kind="stable")
    h, at, c = h[order], at[order], c[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)[group]
    size = np.bincount(group)[group]
    repeated = size > 1
    span = np.arange(length)
    strange: set[int] = set()
    for lot in np.array_split(np.flatnonzero(repeated & ~new), max(1, int(repeated.sum()) // 20_000 + 1)):
        same = (x[at[lot][:, None], c[lot][:, None] + span] == x[at[head[lot]][:, None], c[head[lot]][:, None] + span]).all(axis=1)
        strange.update(group[lot[~same]].tolist())
    for g in strange:
        members = np.flatnonzero(group == g)
        by: dict[bytes, list[int]] = {}
        for m in members:
            by.setdefault(x[at[m], c[m] : c[m] + length].tobytes(), []).append(m)
        for same in by.values():
            repeated[same] = len(same) > 1
    mask = np.zeros((len(contexts), w + 1), bool)
    mask[at[repeated], c[repeated]] = True
    edge = np.diff(np.concatenate([np.zeros((len(contexts), 1), bool), mask], axis=1).astype(np.int8), axis=1)
    i, a = np.nonzero(edge > 0)
    _, b = np.nonzero(edge < 0)
    shift = (w - 1 - high)[i]
    return i, a - shift, b - 1 - shift + length


def _united(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def _kept(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in cuts for x in s], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """`docs` with the repeated strings cut out of `text`, and columns n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes)."""
    spans = repeated_spans(docs, key, text, length)
    base = without(docs, "n_bytes", "n_removed", "n_spans", "kept_sha256")
    there = base.select(*[column(c).alias(f"c{i}") for i, c in enumerate(base.columns)], F.xxhash64(column(text)).alias("h"))
    k, t = base.columns.index(key), base.columns.index(text)
    joined = there.join(spans, F.col(f"c{k}").eqNullSafe(F.col("_key")) & (F.col("h") == F.col("_hash")), "left").drop("_key", "_hash", "h")
    schema = T.StructType([*joined.schema.fields[: len(base.columns)], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):
                b = whole_batch.slice(at, 256)
                texts, rows = [], []
                for x, s in zip(b.column(t).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                    raw = (x or "").encode("utf-8", "surrogatepass")
                    cuts = _united(s)
                    rest = _kept(raw, cuts)
                    rows.append((len(raw), len(raw) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest()))
                    texts.append(x if not cuts else rest.decode("utf-8", "ignore"))
                cols = list(b.columns[:-1])
                cols[t] = pa.array(texts, pa.string())
                told = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, kind) for c, kind in zip(told, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=[f.name for f in schema])

    out = joined.mapInArrow(tidy(cut), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(base.columns)], "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that start more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
