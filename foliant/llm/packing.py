"""Packing of token sequences: bounded-space, best-fit, online.

Every task reads its documents once and keeps a fixed number of open windows. A document goes whole into
the window that it fills best. If it fits none, the fullest window is emitted: first topped up with the
head of the document if its gap is worth a cut, else as it is. Documents longer than a window give full
windows of their own and place the rest. What is left in the open windows of the tasks is merged
in the same way, by groups of tasks and again by groups of groups, and cut to powers of two at the very
end, where lengths are kept as they are. So memory is bounded by the windows, not by the partition, and
what a merging task reads by the number of windows times the tasks in a group.

Token ids come from the tokenizers library. Its pre-tokenizer drops white space and no rule crosses it,
so a text's ids are the ids of its parts between spaces and line feeds; these are remembered.

Defined cases: a null text is empty and consists of its end id only; repeated rows are packed as often
as they occur; of windows that fit equally well the first opened is taken; an empty table gives an empty
table; only the key and the text are read, so other columns cannot clash. Each piece's place is
decided by the order of rows in the input's partitions; a task that is repeated decides alike.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._common import column, materialise, tidy

LENGTH = 4096
OPEN_WINDOWS = 16
#: Gaps of so many tokens and more are filled by cutting a document.
WORTH_A_CUT = 48
END_ID = 2
#: Tasks whose leftovers meet in one task of the next round.
FAN = 64
#: Bytes of parts of texts, and of runs within them, whose ids a worker remembers, by about what Python takes for each, and the longest of them.
REMEMBERED_BYTES, EACH, LONGEST = 256 << 20, 200, 64
#: Texts that are Python objects at a time.
SLICE = 256
#: How the tokenizer splits what it has brought into lower case.
RUN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
MARKS = frozenset(".,;:!?")
PLAIN = regex.compile(r"[\x21-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF]+")


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, with the end id.

    Ids of parts between spaces are remembered, and so are those of the runs of letters, digits and marks that
    the tokenizer makes of a part in lower case: far fewer. Parts of other than printable ASCII and Latin-1
    letters, and such as may hold a special token, go to the tokenizer as they are.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        told |= {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}, "added_tokens": [], "post_processor": None}
        self.model = Tokenizer.from_str(json.dumps(told))  # for what is split and in lower case already
        self.parts: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {}
        self.held = 0
        self.end = end_id.to_bytes(4, "little")
        self.by_runs = self._splits_like_us()

    def _splits_like_us(self) -> bool:
        """Whether the tokenizer lower-cases and splits as RUN does; else only whole parts are remembered."""
        probes = ["Ab's-7,x", "\u00c9t\u00e9!!", "don't're'LL", "a\u00ff\u00d612", "x_y<z>", "'S'd9'm"]
        whole, run = ([i for i in t.encode_batch_fast(x, add_special_tokens=False)] for t, x in ((self.tokenizer, probes), (self.model, [r for p in probes for r in RUN.findall(p.lower())])))
        return [i for e in whole for i in e.ids] == [i for e in run for i in e.ids]

    @staticmethod
    def _encode(tokenizer: object, strings: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(strings), 4096):
            out += [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(strings[at : at + 4096], add_special_tokens=False)]
        return out

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs, which are words of one sequence here: so there is one result for thousands of them, cut by the numbers of the words."""
        out: list[bytes] = []
        for at in range(0, len(runs), 4096):
            some = runs[at : at + 4096]
            e = self.model.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = array("I", e.ids).tobytes()
            ends = (np.searchsorted(np.array(e.word_ids), np.arange(len(some)), side="right") * 4).tolist()
            out += [ids[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _learn(self, new: list[str]) -> None:
        """Ids of parts: those of their runs where the tokenizer splits as RUN does, others as the tokenizer gives them."""
        whole: list[str] = []  # letters only
        marked: list[str] = []  # letters and a mark
        mixed: list[str] = []
        other: list[str] = []
        for p in new:
            if not (self.by_runs and (p.isascii() or PLAIN.fullmatch(p))):
                other.append(p)
            elif p.isalpha():
                whole.append(p)
            elif p[-1] in MARKS and p[:-1].isalpha():
                marked.append(p)
            elif PLAIN.fullmatch(p) and "<|" not in p:
                mixed.append(p)
            else:
                other.append(p)
        parts, runs = self.parts, self.runs
        low = list(map(str.lower, whole))
        low_marked = [p[:-1].lower() for p in marked]
        split = [RUN.findall(p.lower()) for p in mixed]
        unknown = list({*low, *low_marked, *(p[-1] for p in marked), *chain.from_iterable(split)}.difference(runs))
        runs.update(zip(unknown, self._encode_runs(unknown), strict=True))
        known = runs.__getitem__
        parts.update(zip(whole, map(known, low), strict=True))
        mark = {m: runs[m] for m in MARKS if m in runs}
        parts.update((p, known(x) + mark[p[-1]]) for p, x in zip(marked, low_marked, strict=True))
        parts.update((p, b"".join(map(known, x))) for p, x in zip(mixed, split, strict=True))
        parts.update(zip(other, self._encode(self.tokenizer, other), strict=True))
        self.held += EACH * (len(new) + len(unknown)) + 2 * (sum(map(len, new)) + sum(map(len, unknown)))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if self.held > REMEMBERED_BYTES:
            self.parts, self.runs, self.held = {"": b""}, {}, 0
        new = {*chain.from_iterable(split)}.difference(self.parts)
        self._learn(list(new))
        known = self.parts.__getitem__
        out = [b"".join(map(known, s)) + self.end for s in split]
        for p in new:
            if len(p) > LONGEST:
                del self.parts[p]
                self.runs.pop(p.lower(), None)
        return out


@lru_cache(1)
def _encoder(path: str, end_id: int) -> Encoder:
    """A worker's encoder: what it remembers, within its bound, serves the tasks that follow in the same process."""
    return Encoder(path, end_id)


class Packer:
    """Places pieces (key, start, doc_tokens, ids as bytes) and collects rows of closed windows."""

    def __init__(self, length: int, windows: int, worth: int, first_id: int):
        self.length, self.windows, self.worth, self.next_id = length, windows, worth, first_id
        self.open: list[list] = []  # [filled, pieces]
        self.rows: list[tuple] = []  # key, start, length, crc, doc_tokens, sequence, offset, ids

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for key, start, whole, ids in pieces:
            self.rows.append((key, start, len(ids) // 4, zlib.crc32(ids), whole, self.next_id, at, ids))
            at += len(ids) // 4
        self.next_id += 1

    def add(self, key: object, start: int, whole: int, ids: bytes) -> None:
        full = 4 * self.length
        while len(ids) > full:
            self.close([(key, start, whole, ids[:full])])
            ids, start = ids[full:], start + self.length
        while True:
            n = len(ids) // 4
            best = max((w for w in self.open if w[0] + n <= self.length), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.windows:
                best = [0, []]
                self.open.append(best)
            if best is not None:
                best[0] += n
                best[1].append((key, start, whole, ids))
                if best[0] == self.length:
                    self.emit(best)
                return
            fullest = max(self.open, key=lambda w: w[0])
            if (gap := self.length - fullest[0]) >= self.worth:
                fullest[1].append((key, start, whole, ids[: 4 * gap]))
                ids, start = ids[4 * gap :], start + gap
            self.emit(fullest)

    def emit(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self.close(window[1])

    def finish(self) -> None:
        """Lays what is still open end to end and cuts it into full windows, then into powers of two."""
        rest = [p for w in self.open for p in w[1]]
        total, self.open = sum(len(p[3]) // 4 for p in rest), []
        while total:
            size = self.length if total >= self.length else 1 << total.bit_length() - 1
            window, need = [], size
            while need:
                key, start, whole, ids = rest.pop(0)
                take = min(need, len(ids) // 4)
                window.append((key, start, whole, ids[: 4 * take]))
                if take < len(ids) // 4:
                    rest.insert(0, (key, start + take, whole, ids[4 * take :]))
                need -= take
            self.close(window)
            total -= size


def _schema(docs: DataFrame, key: str) -> T.StructType:
    return T.StructType([T.StructField("_key", docs.schema[key].dataType), *[T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType()), ("part", T.IntegerType()), ("window", T.IntegerType()))]])


def _batches(packer: Packer, kind: pa.DataType, part: int, with_ids: bool, leave: bool) -> Iterator[pa.RecordBatch]:
    """Rows of closed windows, and with `leave` those of open ones, which carry their task and window."""
    rows = [(*r[:7], r[7] if with_ids else None, None, None) for r in packer.rows]
    packer.rows.clear()
    if leave:
        rows += [(k, start, len(ids) // 4, None, whole, None, None, ids, part, i) for i, w in enumerate(packer.open) for k, start, whole, ids in w[1]]
    kinds = (kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part", "window"])


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, windows: int = OPEN_WINDOWS, worth: int = WORTH_A_CUT, end_id: int = END_ID, with_ids: bool = False, fan: int = FAN) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, `with_ids`, ids (array<int>).

    tokenizer: path of a tokenizers file, readable by all executors.
    """
    if windows < 1 or length < 1 or worth < 1:
        raise ValueError("windows, lengths and gaps are at least 1")
    schema = _schema(docs, key)

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, packer, kind = _encoder(tokenizer, end_id), Packer(length, windows, worth, part << 32), None
        for b in batches:
            kind = b.column(0).type
            for at in range(0, b.num_rows, SLICE):
                some = b.slice(at, SLICE)
                for k, ids in zip(some.column(0).to_pylist(), encoder(some.column(1).to_pylist()), strict=True):
                    packer.add(k, 0, len(ids) // 4, ids)
                yield from _batches(packer, kind, part, with_ids, False)
        if kind is not None:
            yield from _batches(packer, kind, part, with_ids, True)

    placed = materialise(docs.select(column(key), column(text)).mapInArrow(tidy(first_round), schema))
    done = [placed.where("part is null")]
    left = placed.where("part is not null")
    parts = left.agg(F.max("part")).first()[0]
    turn = 0
    while parts is not None:
        turn += 1
        groups = parts // fan + 1
        last = groups == 1

        def next_round(batches: Iterator[pa.RecordBatch], turn: int = turn, last: bool = last) -> Iterator[pa.RecordBatch]:
            packer = kind = part = None
            for b in batches:
                kind = b.column(0).type
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if row[-1] != part:  # rows come sorted by group; each ends before the next begins
                        if packer is not None:
                            packer.finish() if last else None
                            yield from _batches(packer, kind, part, with_ids, not last)
                        part = row[-1]
                        packer = Packer(length, windows, worth, turn << 56 | part << 32)
                    packer.add(row[0], row[1], row[4], row[7])
            if packer is not None:
                packer.finish() if last else None
                yield from _batches(packer, kind, part, with_ids, not last)

        grouped = left.withColumn("_group", (F.col("part") / fan).cast("int")).repartition(groups, "_group").sortWithinPartitions("_group", "part", "window", "start", "_key")
        placed = materialise(grouped.mapInArrow(tidy(next_round), schema))
        done.append(placed.where("part is null"))
        left = placed.where("part is not null")
        parts = None if last else groups - 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    columns = [F.col("_key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        digits = F.hex("ids")  # little-endian, eight digits to an id
        byte = lambda i, j: F.substring(digits, i * 8 + 2 * j + 1, F.lit(2))
        numbers = F.transform(F.sequence(F.lit(0), (F.octet_length("ids") / 4).cast("int") - 1), lambda i: F.conv(F.concat(*[byte(i, j) for j in (3, 2, 1, 0)]), 16, 10).cast("int"))
        columns.append(numbers.alias("ids"))
    return out.select(*columns)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens of the 49k word BPE."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
