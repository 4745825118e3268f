"""Which tokens of two tokenizers cover the same bytes of a text, by elementary intervals.

Both tokenizers cut the same bytes, so a token is known by where it ends. The union of both arrays of ends cuts the text
into elementary intervals; a binary search for each interval's end in either array names the two tokens that own it. Each
interval is one overlap: two tokens that share bytes share a single stretch, and no end lies inside it. Where both arrays have an
end, a group closes: the smallest stretches that both tokenizers cut out whole. A group's products are all its tokens of one side with all
of the other; groups that have one token on either side have no others than their overlaps.

The texts of a slice are laid one behind the other (a text's end is an end of both), so that a slice is a few calls on whole arrays.
What documents hold a pair linked is counted over the corpus: each document's distinct pairs, with how often they occur in it, are written once
as arrays; counting combines them before the exchange, and they meet their counts by a join, for which the counts are sent out while
they are few and exchanged beyond that.

Defined cases: texts that are null or empty, or whose tokens' bytes on either side are not a space and the text (a tokenizer that
normalises has changed them), have no tokens and zeros everywhere; a null key is a key; rows that repeat are documents of their own and count as such;
strings of special tokens are ordinary text; an empty table gives an empty table; other columns are not read. Whole texts are read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._common import column, materialise, sent, tidy

#: Bytes of texts that are laid behind each other, and the rows of a slice; a longer text is a slice by itself.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 512
#: Fixed value: how byte-level vocabularies of this kind cut a text before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# --- the two tokenizers -----------------------------------------------------------------------------


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others for 256 and on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level vocabulary (tokenizers' JSON). Texts get a space in front.

    If its merges are in the order of the ids that they make, the faster of two libraries gives the same ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        of, vocabulary = byte_characters(), told["model"]["vocab"]
        special = {x["id"]: x["content"].encode() for x in told.get("added_tokens", [])}
        self.tokens = [b""] * (1 + max([*vocabulary.values(), *special]))
        for token, i in vocabulary.items():
            self.tokens[i] = special[i] if i in special else bytes(of[c] for c in token)
        merges = [x.split(" ") if isinstance(x, str) else x for x in told["model"]["merges"]]
        made = [vocabulary[a + b] for a, b in merges]
        plain = sorted(i for i, t in enumerate(self.tokens) if i not in special and len(t) == 1)
        before = told.get("pre_tokenizer") or {}
        if made == list(range(256, 256 + len(made))) and plain == list(range(256)) and told.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"):
            import tiktoken

            self._fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.tokens) if i not in special}, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self._fast, self._slow = None, Tokenizer.from_file(path)
            self._slow.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self._fast is not None:
            return [self._fast.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        return [np.array(e.ids, np.uint32) for e in self._slow.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A SentencePiece model, which puts a space in front by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self._model.get_piece_size()
        self.tokens = [bytes([int(p[3:-1], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self._model.id_to_piece(i)) for i in range(n))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self._model.encode(texts, num_threads=1)]


class Pair:
    """Two tokenizers with their tokens' bytes and lengths, and the strings of their ids before each sign that may follow."""

    def __init__(self, a: ByteLevel | Pieces, b: ByteLevel | Pieces):
        self.a, self.b = a, b
        self.bytes = [np.array([*x.tokens, None], object)[:-1] for x in (a, b)]
        self.lengths = [np.array([len(t) for t in x.tokens], np.int64) for x in (a, b)]
        self.width = len(b.tokens)
        numbers = [[b"%d" % i for i in range(len(x.tokens))] for x in (a, b)]
        told = [n + sign for side, signs in zip(numbers, (b",|", b",;"), strict=True) for sign in (signs[:1], signs[1:]) for n in side]
        self.signed = np.array([*told, None], object)[:-1]

    def slices(self, texts: list[str | None]) -> Iterator[Slice]:
        """The texts of a batch, aligned slice by slice."""
        held: list[bytes] = []
        size = 0
        for t in texts:
            raw = b" " + t.encode() if t else b""
            if held and (size + len(raw) > SLICE_BYTES or len(held) == SLICE_ROWS):
                yield self.aligned(held)
                held, size = [], 0
            held.append(raw)
            size += len(raw)
        if held:
            yield self.aligned(held)

    def aligned(self, raws: list[bytes]) -> Slice:
        some = [i for i, raw in enumerate(raws) if raw]
        texts = [raws[i][1:].decode() for i in some]
        sides = [x.encode(texts) for x in (self.a, self.b)]
        kept = [k for k, i in enumerate(some) if all(b"".join(pool[ids[k]].tolist()) == raws[i] for pool, ids in zip(self.bytes, sides, strict=True))]
        a, b = (np.concatenate([np.empty(0, np.uint32), *(ids[k] for k in kept)]).astype(np.int64) for ids in sides)
        docs = np.array([some[k] for k in kept], np.int64)
        ends = np.cumsum([len(raws[i]) for i in docs], dtype=np.int64)
        return Slice(len(raws), docs, ends, a, b, np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]))


class Slice(NamedTuple):
    """Aligned texts laid behind each other: which of `rows` they are, where they end, both sides' ids and where these end."""

    rows: int
    docs: np.ndarray
    ends: np.ndarray
    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray


class Intervals(NamedTuple):
    """Elementary intervals: where each ends, the tokens (places) of either side that own it, whether a group closes there."""

    ends: np.ndarray
    owner_a: np.ndarray
    owner_b: np.ndarray
    closes: np.ndarray


def union1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of two rising arrays, rising: a merge of two runs, which the stable sort finds (the library's own hashes them first)."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[np.diff(both, prepend=-1) != 0]


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> Intervals:
    ends = union1d(ends_a, ends_b)
    owner_a, owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return Intervals(ends, owner_a, owner_b, (ends_a[owner_a] == ends) & (ends_b[owner_b] == ends))


def _sizes(x: Intervals) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side lie before the end of each group."""
    return x.owner_a[x.closes] + 1, x.owner_b[x.closes] + 1


def _spelt(pair: Pair, s: Slice, x: Intervals) -> tuple[np.ndarray, np.ndarray]:
    """(strings, ends): the ids of all groups in order with the signs after them, and how many of them lie before the end of each text."""
    to_a, to_b = _sizes(x)
    n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    last_a, last_b = np.zeros(len(s.a), bool), np.zeros(len(s.b), bool)
    last_a[to_a - 1] = last_b[to_b - 1] = True
    out = np.empty(len(s.a) + len(s.b), np.int64)
    out[np.arange(len(s.a)) + np.repeat(to_b - n_b, n_a)] = s.a + last_a * len(pair.a.tokens)
    out[np.arange(len(s.b)) + np.repeat(to_a, n_b)] = s.b + last_b * pair.width + 2 * len(pair.a.tokens)
    return pair.signed[out], np.searchsorted(s.ends_a, s.ends) + np.searchsorted(s.ends_b, s.ends) + 2


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


@lru_cache(maxsize=2)
def _pair(a: str, b: str) -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    return Pair(ByteLevel(a), Pieces(b))


def default_paths() -> tuple[str, str]:
    """The two vocabularies of the query, which are files on every machine."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- documents --------------------------------------------------------------------------------------


def groups(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, group, start, end, a_ids, b_ids): the groups of each text, numbered from 0, over bytes of a space and the text."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("group", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("a_ids", T.ArrayType(T.IntegerType())), T.StructField("b_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a, b)
        for batch in batches:
            at = 0
            for s in pair.slices(batch.column(1).to_pylist()):
                x = intervals(s.ends_a, s.ends_b)
                to_a, to_b = _sizes(x)
                ends = x.ends[x.closes]
                of = np.searchsorted(s.ends, ends)
                first, base = np.searchsorted(of, np.arange(len(s.docs))), np.append(0, s.ends)
                cells = [np.arange(len(of)) - first[of], np.append(0, ends)[:-1] - base[of], ends - base[of]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + s.docs[of])), *(pa.array(c, pa.int64()) for c in cells), _lists(s.a, np.diff(to_a, prepend=0), pa.int32()), _lists(s.b, np.diff(to_b, prepend=0), pa.int32())], names=[f.name for f in schema])
                at += s.rows

    return docs.select(column(key), column(text)).mapInArrow(tidy(run), schema)


def products(grouped: DataFrame) -> DataFrame:
    """The rows of groups() by pair: a_id, b_id for each of a group's tokens of one side with each of the other, and the share of the group that falls to the pair."""
    share = F.lit(1.0) / (F.size("a_ids") * F.size("b_ids"))
    return grouped.withColumn("share", share).withColumn("a_id", F.explode("a_ids")).withColumn("b_id", F.explode("b_ids")).drop("a_ids", "b_ids")


def linked(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: row (its own number), key, n_a, n_b, n_groups, n_links, n_products, groups_sha256, and its distinct links: pairs (a's id times b's ids, plus b's id) with times."""
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_products")
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", docs.schema[key].dataType), *[T.StructField(n, T.LongType()) for n in numbers], T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def rows(pair: Pair, s: Slice) -> list[pa.Array]:
        x = intervals(s.ends_a, s.ends_b)
        to_a, to_b = _sizes(x)
        n, of = len(s.docs), np.searchsorted(s.ends, x.ends)
        # distinct links of each text, in order
        code = np.sort(of * (len(pair.a.tokens) * pair.width) + s.a[x.owner_a] * pair.width + s.b[x.owner_b])
        first = np.flatnonzero(np.diff(code, prepend=-1))
        times = np.diff(first, append=len(code))
        whose, code = np.divmod(code[first], len(pair.a.tokens) * pair.width)
        ends, of_group = [np.searchsorted(e, s.ends) + 1 for e in (s.ends_a, s.ends_b)], of[x.closes]
        made = np.bincount(of_group, np.diff(to_a, prepend=0) * np.diff(to_b, prepend=0), n).astype(np.int64)
        strings, cuts = _spelt(pair, s, x)
        cuts = np.append(0, cuts)
        hashes = [hashlib.sha256(b"".join(strings[i:j].tolist())[:-1]).hexdigest() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        out, spelt = [], np.full(s.rows, "", object)
        spelt[s.docs] = hashes
        for told in (np.diff(ends[0], prepend=0), np.diff(ends[1], prepend=0), np.bincount(of_group, minlength=n), np.bincount(of, minlength=n), made):
            cell = np.zeros(s.rows, np.int64)
            cell[s.docs] = told
            out.append(pa.array(cell))
        many = np.zeros(s.rows, np.int64)
        many[s.docs] = np.bincount(whose, minlength=n)
        return [*out, pa.array(spelt.tolist(), pa.string()), _lists(code, many, pa.int64()), _lists(times, many, pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = _pair(a, b), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for s in pair.slices(batch.column(1).to_pylist()):
                ids = pa.array(np.arange(number, number + s.rows))
                yield pa.RecordBatch.from_arrays([ids, batch.column(0).slice(at, s.rows), *rows(pair, s)], names=[f.name for f in schema])
                at, number = at + s.rows, number + s.rows

    return docs.select(column(key), column(text)).mapInArrow(tidy(run), schema)


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): how many documents hold a pair linked, and whether no pair of its a's id is in more. `width`: how many ids b has."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = materialise(counts.withColumn("a", F.expr(f"pair div {width}")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of a's vocabulary at most
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_a, n_b, n_groups, n_links, n_best (links whose pair is the best of its a's id), count_sum (of the links' counts), groups_sha256, n_products."""
    links = materialise(linked(docs, a, b, key, text))
    width = len(_pair(a, b).b.tokens)
    counts = sent(materialise(pair_counts(links, width)))
    each = links.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    # a document's links follow one another, so the sums are made before anything moves
    sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    out = links.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", "n_products")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's whole text, cut by a byte-level vocabulary and by pieces."""
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_paths())
