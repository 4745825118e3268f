"""SentencePiece encoding and decoding by weighted finite-state transduction.

A model is compiled into machines over the tropical semiring, where weights add along a path and the least wins:

* the normaliser, a transducer of characters to characters: the model's rule map, whose arcs read a rule's longest match (or copy a
  character) at weight 0, and arcs that put a mark at the start and for each space;
* the pieces, a trie whose arcs read a character each, and whose ends give an id and return to the root, at the weight of the piece;
* byte fallback, an arc for each character without a piece, which gives the ids of its bytes;
* for models by merges (BPE), a grammar: its state is the last piece, and its arc to the next has weight 0 or infinity.

For models by likelihood (unigram) a piece weighs the negative of its score, and there is no grammar. For models by merges it weighs 1,
and the grammar allows two pieces to follow each other if merging them alone gives just these two. As merging takes the best
pair anywhere, what has not merged across a boundary has merged beside it as it would have alone; so a sequence of pieces is the
library's if and only if each two neighbours are allowed, and each prefix of a text has one path of finite weight.

A text is composed with the machines segment by segment (no piece goes on after a mark or contains a line feed, so all paths meet in one
state there). The composition's states are positions with the last piece, its arcs are laid out as a matrix of the position where
they end by their length, and the path is found by relaxing all arcs, in order of positions, for all new segments at once. Whether two
pieces may follow each other is found by undoing their merges, latest first, until one across the boundary would have come
earlier. Paths of segments are remembered, within a bound of bytes.

Decoding is the inverse: ids to strings or bytes, marks to spaces, less the mark for the start.

Defined cases: a null text is empty and has no ids; repeated rows give repeated results; bytes that are no
characters decode to U+FFFD each; an id outside the model raises ValueError; an empty table gives an empty table;
columns of the input that bear an output's name are not read. Whole texts are read, one at a time.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.llm._common import column, tidy

MARK = "▁"
#: Bytes of segments and their ids that a task remembers, by about what Python takes for each, and the longest of them.
REMEMBERED_BYTES, EACH, LONGEST = 192 << 20, 220, 64
#: Characters of segments that are composed together, and the longest segment that is not composed by itself.
TOGETHER, ALONE = 150_000, 256
#: Texts that are Python objects at a time.
SLICE = 256
#: Kinds of models and of pieces, as the format numbers them (fixed values).
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NEVER = np.int64(1) << 40


# --- the model file ---------------------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of an encoded message: integers, or the bytes of strings, messages and fixed-size numbers."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


def rule_map(charsmap: bytes) -> dict[str, str]:
    """The rules of a normaliser out of its double array: the first four bytes are the array's size; leaves point into the strings behind it."""
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units = np.frombuffer(charsmap[4 : 4 + size], "<u4").tolist()
    strings = charsmap[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    out: dict[str, str] = {}
    stack = [(offset(units[0]), b"")]
    while stack:
        base, key = stack.pop()
        for label in range(1, 256):
            at = base ^ label
            if at >= len(units) or units[at] & 0x800000FF != label:
                continue
            child, read = at ^ offset(units[at]), key + bytes([label])
            if units[at] >> 8 & 1:
                start = units[child] & 0x7FFFFFFF
                out[read.decode()] = strings[start : strings.index(b"\0", start)].decode()
            stack.append((child, read))
    return out


class Normaliser:
    """From a text to what is cut into pieces: the rules' longest matches from left to right, run before the composition. Where all rules read one character, a translation table does it."""

    def __init__(self, spec: bytes):
        told = dict(_fields(spec))
        self.rules = rule_map(bytes(told.get(2, b"")))
        self.prefix, self.squeeze, self.escape = (bool(told.get(n, 1)) for n in (3, 4, 5))
        self.longest = max(map(len, self.rules), default=1)
        self.single = str.maketrans({k: v for k, v in self.rules.items() if len(k) == 1})

    def _rewritten(self, text: str) -> str:
        if self.longest <= 1:
            return text.translate(self.single) if self.rules else text
        out, at = [], 0
        while at < len(text):
            for n in range(min(self.longest, len(text) - at), 0, -1):
                if (to := self.rules.get(text[at : at + n])) is not None:
                    out.append(to)
                    at += n
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self._rewritten(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = " " + text if self.prefix else text
        return text.replace(" ", MARK) if self.escape else text


# --- machines ---------------------------------------------------------------------------------------


class Table:
    """A fixed map from whole numbers to whole numbers, looked up for whole arrays; -1 where there is none."""

    def __init__(self, entries: dict[int, int]):
        bits = max(4, (4 * len(entries)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        at = self._slot(np.fromiter(entries, np.int64, len(entries))).tolist()
        taken = bytearray(1 << bits)
        for slot, (k, v) in zip(at, entries.items(), strict=True):
            while taken[slot]:
                slot = slot + 1 & self.mask
            taken[slot] = 1
            self.keys[slot], self.values[slot] = k, v

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Merges:
    """The grammar of a model by merges: how each piece is made, and whether two pieces may follow each other."""

    def __init__(self, score: dict[str, float], ids: dict[str, int], size: int):
        by_score = {x: n for n, x in enumerate(sorted({-score[p] for p in ids if len(p) > 1}), 1)}
        order = {p: by_score[-score[p]] for p in ids if len(p) > 1}  # equal scores, equal turns
        self.turn = np.zeros(size, np.int64)  # when a piece is made; 0: a character
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.made = {p for p in ids if len(p) == 1}  # pieces that merging makes at all
        pairs: dict[int, int] = {}
        for p, n in sorted(order.items(), key=lambda x: len(x[0])):
            if (cut := self._last_cut(p, score)) is not None:
                self.made.add(p)
                self.turn[ids[p]], self.left[ids[p]], self.right[ids[p]] = n, ids[p[:cut]], ids[p[cut:]]
        for p in self.made:
            for cut in range(1, len(p)):
                if p[:cut] in self.made and p[cut:] in self.made:
                    pairs[ids[p[:cut]] << 32 | ids[p[cut:]]] = order[p]
        self.pairs = Table(pairs)

    @staticmethod
    def _last_cut(piece: str, score: dict[str, float]) -> int | None:
        """Where the last merge joins a piece out of its characters, best pair first and leftmost of equals; None if merging does not give it."""
        parts = list(piece)
        while len(parts) > 2:
            scores = [score.get(a + b, -math.inf) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -math.inf:
                return None
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts[0])

    def weight(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """0 where piece b may follow piece a, else infinity.

        Merges are undone, the later one of both sides first. What then stands at the boundary must not have merged before the
        undone merge: earlier on the left side, and as early or earlier on the right side, as the leftmost of equals merges first.
        """
        a, b, limit = a.copy(), b.copy(), np.full(len(a), _NEVER)
        out, left = np.zeros(len(a)), np.arange(len(a))
        while len(left):
            across = self.pairs(a << 32 | b)
            wrong = (across >= 0) & (across < limit)
            out[left[wrong]] = np.inf
            one, two = self.turn[a], self.turn[b]
            go = ~wrong & ((one > 0) | (two > 0))
            left, a, b, one, two = left[go], a[go], b[go], one[go], two[go]
            first = one > two
            limit = np.where(first, one, two + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out


class Transducer:
    def __init__(self, model: str | bytes):
        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        pieces, trainer, spec = [], {}, b""
        for n, value in _fields(model):
            if n == 1:
                pieces.append(dict(_fields(value)))
            elif n == 2:
                trainer = dict(_fields(value))
            elif n == 3:
                spec = value
        self.normaliser = Normaliser(spec)
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, MERGES) or any(x.get(3, NORMAL) == USER_DEFINED for x in pieces):
            raise ValueError("models by likelihood or merges are compiled, without pieces of the user's")
        self.strings: list[str | None] = []
        self.bytes_of: dict[int, int] = {}
        ids: dict[str, int] = {}
        score: dict[str, float] = {}
        byte_id: dict[int, int] = {}
        self.unknown = 0
        for i, x in enumerate(pieces):
            name, sort = x[1].decode(), x.get(3, NORMAL)
            self.strings.append(None if sort == CONTROL else name)
            if sort == BYTE:
                byte_id[int(name[3:5], 16)] = i
                self.bytes_of[i] = int(name[3:5], 16)
            elif sort == UNKNOWN:
                self.unknown = i
            elif sort == NORMAL:
                ids[name], score[name] = i, float(np.frombuffer(x.get(2, b"\0\0\0\0"), "<f4")[0])
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in ids):
            raise ValueError("pieces must not go on after a mark or contain a line feed")
        self.fallback = [byte_id[b] for b in range(256)] if len(byte_id) == 256 else None
        n = len(pieces)
        self.merges = Merges(score, ids, n) if kind == MERGES else None
        self.ids = {p: i for p, i in ids.items() if self.merges is None or p in self.merges.made}
        # weights by id; the last one is that of byte fallback
        self.weights = np.ones(n + 1)
        if self.merges is None:
            for p, i in ids.items():
                self.weights[i] = -score[p]
            self.weights[n] = 10.0 - min(score.values())
        self.other = n
        # the trie: edges by node and character, and the piece that ends at a node
        edges: dict[int, int] = {}
        ends = [-1]
        for p, i in self.ids.items():
            node = 0
            for c in p:
                key = node << 21 | ord(c)
                if (to := edges.get(key)) is None:
                    to = edges[key] = len(ends)
                    ends.append(-1)
                node = to
            ends[node] = i
        self.edges, self.ends = Table(edges), np.array(ends, np.int64)
        self.longest = max(map(len, self.ids), default=1)
        self.segment = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    # --- composition and shortest path

    def arcs(self, codes: np.ndarray, room: np.ndarray) -> np.ndarray:
        """By end and length of a string, the piece that it is, or -1; fallback for characters that are none. room: how many characters of its segment follow a place."""
        out = np.full((len(codes) + 1, self.longest), -1, np.int64)
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for depth in range(self.longest):
            node = self.edges(node << 21 | codes[at + depth])
            go = node >= 0
            at, node = at[go], node[go]
            out[at + depth + 1, depth] = self.ends[node]
            go = room[at] > depth + 1
            at, node = at[go], node[go]
        single = out[1:, 0]
        single[single < 0] = self.other
        return out

    def _relaxed(self, arcs: np.ndarray, last: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, ...]:
        """(weight, piece, length) of the best arc into each of some positions: pieces by length, with the weights and last pieces of the positions where they begin."""
        weight = np.full(arcs.shape, np.inf)
        i, j = np.nonzero((arcs >= 0) & (far < np.inf))
        piece, before = arcs[i, j], last[i, j]
        total = far[i, j] + self.weights[piece]
        if self.merges is not None:
            both = np.flatnonzero((before >= 0) & (before < self.other) & (piece < self.other))
            total[both] += self.merges.weight(before[both], piece[both])
        weight[i, j] = total
        best = weight.argmin(axis=1)
        rows = np.arange(len(arcs))
        return weight[rows, best], arcs[rows, best], best + 1

    def shortest(self, segments: list[str]) -> list[bytes]:
        """The ids on the path of least weight through the composition of the machines with each segment, as native unsigned 32-bit numbers."""
        if not segments:
            return []
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.cumsum(size) - size
        offset = np.arange(len(codes)) - np.repeat(first, size)
        arcs = self.arcs(codes, np.repeat(size, size) - offset)
        # a segment's positions are those of its characters and one more; columns of arcs reach back by their length
        base = first + np.arange(len(size))
        far, last, length = np.full(len(codes) + len(size), np.inf), np.full(len(codes) + len(size), -1, np.int64), np.zeros(len(codes) + len(size), np.int64)
        far[base] = 0.0
        back = np.arange(1, self.longest + 1)
        live, order = len(size), np.argsort(-size, kind="stable")
        ordered = size[order]
        for p in range(1, int(size.max()) + 1):
            while ordered[live - 1] < p:
                live -= 1
            these = order[:live]
            width = min(p, self.longest)
            row = arcs[first[these] + p, :width]
            source = (base[these] + p)[:, None] - back[:width]
            at = base[these] + p
            far[at], last[at], length[at] = self._relaxed(row, last[source], far[source])
        if np.isinf(far[base + size]).any():
            raise ValueError("a segment has no path")  # cannot be: single characters always have one
        return [self._ids(s, last, length, b) for s, b in zip(segments, base.tolist(), strict=True)]

    def _ids(self, segment: str, last: np.ndarray, length: np.ndarray, base: int) -> bytes:
        out: list[int] = []
        n = len(segment)
        pieces, lengths = last[base : base + n + 1].tolist(), length[base : base + n + 1].tolist()
        while n:
            piece = pieces[n]
            if piece != self.other:
                out.append(piece)
            elif self.fallback is None:
                out.append(self.unknown)
            else:
                out += [self.fallback[b] for b in reversed(segment[n - 1].encode("utf-8", "replace"))]
            n -= lengths[n]
        out.reverse()
        return array("I", out).tobytes()

    def alone(self, segment: str) -> bytes:
        """The same for one long segment, position by position without matrices over many."""
        n, step = len(segment), self.longest
        codes = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        far, last, length = [0.0] + [math.inf] * n, [-1] * (n + 1), [0] * (n + 1)
        known: dict[tuple[int, int], float] = {}
        weights = self.weights.tolist()
        for at in range(0, n, TOGETHER):
            low = max(0, at - step)
            arcs = self.arcs(codes[low : at + TOGETHER], np.arange(min(n, at + TOGETHER) - low, 0, -1))
            for p in range(at + 1, min(n, at + TOGETHER) + 1):
                row = arcs[p - low]
                for j in np.flatnonzero(row[: min(p, step)] >= 0).tolist():
                    source = p - j - 1
                    piece, before = int(row[j]), last[source]
                    total = far[source] + weights[piece]
                    if total < far[p] and self.merges is not None and 0 <= before < self.other and piece < self.other:
                        if (pair := (before, piece)) not in known:
                            known[pair] = float(self.merges.weight(np.array([before]), np.array([piece]))[0])
                        total += known[pair]
                    if total < far[p]:
                        far[p], last[p], length[p] = total, piece, j + 1
        return self._ids(segment, np.array(last), np.array(length), 0)

    def decode(self, ids: bytes | list[int]) -> str:
        numbers = memoryview(ids).cast("I") if isinstance(ids, bytes) else ids
        out: list[str] = []
        raw = bytearray()
        for i in numbers:
            if (b := self.bytes_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_characters(bytes(raw)))
                raw.clear()
            if not 0 <= i < len(self.strings):
                raise ValueError(f"id {i} is outside the model")
            if i == self.unknown:
                out.append(" ⁇ ")
            elif (s := self.strings[i]) is not None:
                out.append(s)
        if raw:
            out.append(_characters(bytes(raw)))
        text = "".join(out)
        return (text[1:] if text[:1] == MARK else text).replace(MARK, " ")


def _characters(raw: bytes) -> str:
    """UTF-8, with U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode())
            out.append("�")
            at += e.start + 1
    return "".join(out)


class Encoder:
    """Texts to ids, with what a task remembers of segments."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.known, self.held = transducer, {}, 0

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as native unsigned 32-bit numbers."""
        t, known = self.transducer, self.known
        split = [t.segment.findall(t.normaliser(x)) if x else [] for x in texts]
        here = {s for x in split for s in x}
        new = here.difference(known)
        if self.held > REMEMBERED_BYTES:
            known.clear()
            self.held, new = 0, here
        lot, size = [], 0
        ordered = sorted(new, key=len)
        for i, s in enumerate(ordered):
            if len(s) > ALONE:
                known[s] = t.alone(s)
            else:
                lot.append(s)
                size += len(s)
            if size >= TOGETHER or i + 1 == len(ordered):
                known.update(zip(lot, t.shortest(lot), strict=True))
                lot, size = [], 0
        out = [b"".join(map(known.__getitem__, x)) for x in split]
        for s in new:
            if len(s) > LONGEST:
                del known[s]
            else:
                self.held += EACH
        return out


@lru_cache(2)
def _transducer(model: str) -> Transducer:
    return Transducer(model)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each text; model: a path that all executors can read."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_transducer(model))
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                ids = [memoryview(x).cast("I").tolist() for x in encoder(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[f.name for f in schema])

    return docs.select(column(key), column(text)).mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the inverse; null ids are none."""
    schema = T.StructType([T.StructField(key, encoded.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[f.name for f in schema])

    return encoded.select(column(key), column(ids)).mapInArrow(tidy(run), schema)


def round_trips(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, n_ids, n_fallback, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, same): texts encoded, and their ids decoded."""
    kinds = (("n_chars", T.LongType(), pa.int64()), ("n_ids", T.LongType(), pa.int64()), ("n_fallback", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64()), ("decoded_sha256", T.StringType(), pa.string()), ("same", T.BooleanType(), pa.bool_()))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(n, t) for n, t, _ in kinds]])

    def one(t: Transducer, x: str | None, ids: bytes) -> tuple:
        numbers = memoryview(ids).cast("I")
        back = t.decode(ids)
        return len(x or ""), len(numbers), sum(map(t.bytes_of.__contains__, numbers)), zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (x or "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(model)
        encoder = Encoder(t)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                texts = part.column(1).to_pylist()
                cols = list(zip(*(one(t, x, ids) for x, ids in zip(texts, encoder(texts), strict=True)), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, (_, _, k) in zip(cols, kinds, strict=True))], names=[f.name for f in schema])

    return docs.select(column(key), column(text)).mapInArrow(tidy(run), schema)


def op3_piece_transducer(spark, sf_dir: str) -> DataFrame:
    """Every document encoded with the 32k BPE pieces with byte fallback, and decoded again."""
    import public_tokenizers

    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
