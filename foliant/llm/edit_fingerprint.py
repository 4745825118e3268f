"""Fingerprints that keep edit distance: a randomised embedding into Hamming space, and bit sampling.

All texts share one family of random functions from characters to bits. A walk reads a text and at each
step writes the character under its pointer, which moves on if the function of this step says so for this
character. Walks over texts that differ in an edit meet again soon after it, so the written strings differ
in few places: edit distance becomes Hamming distance. The walk is over when the text is.

A fingerprint samples 128 places of the written string, each a hex digit by a hash of the character there.
Places are those of the least of one random number for each place, over as many as are written: so texts
of nearly the same length sample the same places but for a share like that of their lengths, and any length
gives 128 digits. The likeness of two fingerprints is the share of equal digits.

How long the walk stays at a character depends on the step and the character only: it is looked up, in one
step for each character. The functions repeat after 2048 steps.

`fingerprints` gives one for each text; `with_next` compares texts with edits of themselves and with their
successors; `near_groups` bands the digits of what these give, and verifies by edit distance what has a band in common.
Bands propose few of the pairs that EDITED allows: see its docstring.

Defined cases: a null text is empty; empty texts have a fingerprint of their own and no near texts but each other; the order of
documents is by key, nulls first, then by a hash of the text; repeated rows follow one another; a single document is its own
successor; an empty table gives an empty table; only the key and the text are read. Whole texts are read,
in pieces of a million characters; no task holds more than its own texts and one of the next task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._common import column, components, drop_written, materialise, tidy

DIGITS = 128
CLASSES = 256
PERIOD = 2048
PIECE = 1 << 20
#: Digits to a band, how far apart bands begin, and how many of all digits near texts have in common at least: of unrelated
#: texts of 200 to 3,000 characters none had more than 45, of near ones with a common band none less than 51.
BAND, STRIDE, ALIKE = 12, 6, 48
#: The share of characters that may be edited between near texts.
EDITED = 0.1
#: Bits of the filter that texts pass before they are exchanged: at least so many a key, and so many in all (32 MB).
KEY_BITS, FILTER_BITS = 16, 1 << 28
#: Columns of a distance after which it is looked at.
COLUMNS = 64
#: Characters of the grams that tell texts apart without their distance, and classes of them.
GRAM, GRAMS = 4, 1024
#: Members of a list that the others meet at first, and members and characters in a block of a list.
PIVOTS, BLOCK, BLOCK_CHARACTERS = 3, 512, 2 << 20


def _packed(text: pa.StringScalar) -> bytes:
    """A text's UTF-8, compressed, behind its length; a null text is empty."""
    raw = text.as_buffer() or b""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> str:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True).decode()


class Embedder:
    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        bits = draw.integers(0, 2, (CLASSES, PERIOD)).astype(bool)
        bits[:, draw.integers(0, PERIOD)] = True
        after = np.where(np.concatenate([bits, bits], axis=1), np.arange(2 * PERIOD), 1 << 30)
        after = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
        numbers = list(range(PERIOD))
        self.next = [[numbers[x] for x in row] for row in ((after + 1) % PERIOD).tolist()]
        # places of running minima: the next one after the n-th is past n / u, for u uniform
        records = np.zeros((DIGITS, 96))
        for i in range(1, 96):
            records[:, i] = np.minimum(np.floor((records[:, i - 1] + 1) / draw.uniform(1e-12, 1, DIGITS)), 1e15)
        self.records = records.astype(np.int64)
        self.salt = draw.integers(1, 1 << 63, DIGITS, dtype=np.uint64)

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")

    def walk(self, codes: np.ndarray, start: int = 0) -> np.ndarray:
        """Steps at which the walk leaves each character, if it comes to the first at `start`."""
        rows, t = self.next, start % PERIOD
        out, base = [], start
        for at in range(0, len(codes), PIECE):
            classes = ((codes[at : at + PIECE].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()
            first = t
            steps = np.array([t := rows[c][t] for c in classes], np.int64)
            stay = np.diff(steps, prepend=first) % PERIOD
            stay[stay == 0] = PERIOD
            left = base + np.cumsum(stay)
            base = int(left[-1])
            out.append(left)
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def digits(self, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        if len(codes):
            written = int(left[-1])
            which = (self.records < written).sum(axis=1) - 1
            place = self.records[np.arange(DIGITS), which]
            under = codes[np.searchsorted(left, place, side="right")].astype(np.uint64)
        else:
            under = np.full(DIGITS, 0x110000, np.uint64)  # no character
        x = (under + np.uint64(1)) * self.salt
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(60)).astype(np.uint8)

    def fingerprint(self, text: str) -> np.ndarray:
        codes = self.codes(text)
        return self.digits(codes, self.walk(codes))


def as_text(digits: np.ndarray) -> str:
    return "".join("0123456789abcdef"[d] for d in digits)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """`text` with its last half replaced by as much of the start of `following`, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


@lru_cache(1)
def _embedder() -> Embedder:
    return Embedder()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, fingerprint) of every text."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([as_text(_embedder().fingerprint(t)) for t in texts], pa.string())], names=[f.name for f in schema])

    return docs.select(column(key), column(text)).mapInArrow(tidy(run), schema)


def _compared(text: str, digits: np.ndarray, left: np.ndarray, codes: np.ndarray, following: str, next_digits: np.ndarray) -> tuple:
    """A document's row; the walk over the edited text starts where it leaves the part that stays."""
    embedder = _embedder()
    half = len(text) // 2
    stay, new = len(text) - half, embedder.codes(following[:half])
    walked = np.concatenate([left[:stay], embedder.walk(new, int(left[stay - 1]) if stay else 0)])
    other = embedder.digits(np.concatenate([codes[:stay], new]), walked)
    sha = hashlib.sha256(edited(text, following).encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, as_text(digits), as_text(other), likeness(digits, other), likeness(digits, next_digits), _id(text)


def _id(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


_ROW = (("n_chars", T.LongType(), pa.int64()), ("edited_sha256", T.StringType(), pa.string()), ("fingerprint", T.StringType(), pa.string()), ("edited_fingerprint", T.StringType(), pa.string()), ("near_edited", T.DoubleType(), pa.float64()), ("near_next", T.DoubleType(), pa.float64()), ("text_id", T.BinaryType(), pa.binary()))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, text_id): see `edited`; after the last document comes the first.

    text_id: 128 bits of the text.
    Texts are exchanged once, compressed, by ranges of the key. Each task compares its documents with their successors
    as it reads them; its first and last text, which meet those of its neighbours, are joined by the task's number.
    """
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *[T.StructField(n, t) for n, t, _ in _ROW], T.StructField("part", T.IntegerType()), T.StructField("head", T.StringType()), T.StructField("tail", T.StringType())])
    names = [f.name for f in schema]
    kinds = [k for _, _, k in _ROW]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_packed(t) for t in b.column(1)], pa.binary()), b.column(2), b.column(3)], names=b.schema.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder, part = _embedder(), TaskContext.get().partitionId()
        head = before = kind = None

        def batch(keys: list, rows: list[tuple], edge: tuple = (None, None, None)) -> pa.RecordBatch:
            told = zip(*rows, strict=True) if rows else [()] * len(kinds)
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(list(c), k) for c, k in zip(told, kinds, strict=True)), *(pa.array([e] * n, t) for e, t in zip(edge, (pa.int32(), pa.string(), pa.string()), strict=True))], names=names)

        for b in batches:
            kind = b.column(0).type
            keys, rows = [], []
            for k, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = _unpacked(packed.as_py())
                codes = embedder.codes(t)
                left = embedder.walk(codes)
                now = (k, t, embedder.digits(codes, left), left, codes)
                if before is None:
                    head = t
                else:
                    keys.append(before[0])
                    rows.append(_compared(*before[1:], t, now[2]))
                before = now
            if keys:
                yield batch(keys, rows)
        if before is not None:
            yield batch([before[0]], [(None,) * len(kinds)], (part, head, before[1]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = _embedder()
        for b in batches:
            rows = []
            for t, following in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                codes = embedder.codes(t)
                left = embedder.walk(codes)
                rows.append(_compared(t, embedder.digits(codes, left), left, codes, following, embedder.fingerprint(following)))
            told = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(told, kinds, strict=True))], names=names[: 1 + len(kinds)])

    # equal keys with equal texts are told apart by their place, so that they need not share a task
    spread = [F.xxhash64(column(text)), F.monotonically_increasing_id()]
    light = docs.select(column(key).alias("key"), column(text).alias("text"), spread[0].alias("_h"), spread[1].alias("_i"))
    light = light.mapInArrow(tidy(pack), T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("text", T.BinaryType()), T.StructField("_h", T.LongType()), T.StructField("_i", T.LongType())]))
    told = light.repartitionByRange("key", "_h", "_i").sortWithinPartitions("key", "_h", "_i").drop("_h", "_i")
    done = materialise(told.mapInArrow(tidy(read), schema))
    edges = done.where("part is not null").select("key", "part", "head", "tail")
    numbers = edges.select("part")
    # one row for each task: a window over their numbers only
    order = Window.orderBy("part")
    following = numbers.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    pairs = edges.join(following, "part").join(edges.select(F.col("part").alias("after"), F.col("head").alias("following")), "after").select("key", "tail", "following")
    last = pairs.mapInArrow(tidy(meet), T.StructType(schema.fields[: 1 + len(kinds)]))
    return done.where("part is null").select(*names[: 1 + len(kinds)]).unionByName(last).withColumnRenamed("key", key)


def _shared(a: str, b: str) -> int:
    """How many characters two texts begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance by bit-parallel columns, or most + 1 if it is larger. What both begin and end with costs nothing and takes no part."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    same = _shared(a, b)
    a, b = a[same:], b[same:]
    same = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - same], b[: len(b) - same]
    if len(a) < len(b):  # bits for the longer, columns for the shorter
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    plus, minus = full, 0
    for at in range(0, len(b), COLUMNS):
        for c in b[at : at + COLUMNS]:
            eq = where.get(c, 0)
            x = ((eq & plus) + plus ^ plus) | eq | minus
            up = (minus | full & ~(x | plus)) << 1 | 1
            down = (x & plus) << 1
            plus, minus = full & (down | ~(x | up)), full & x & up
        done = min(at + COLUMNS, len(b))
        d = done + plus.bit_count() - minus.bit_count()
        if d - (len(b) - done) > most:
            return most + 1
    d = len(b) + plus.bit_count() - minus.bit_count()
    return d if d <= most else most + 1


def _grams(text: str) -> np.ndarray:
    """How often a text has the runs of GRAM characters of each class. An edit changes at most GRAM of these and adds as many."""
    codes = Embedder.codes(text).astype(np.uint64)
    x = np.zeros(max(0, len(codes) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        x = (x ^ codes[i : i + len(x)]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return np.bincount((x % np.uint64(GRAMS)).astype(np.int64), minlength=GRAMS).astype(np.int32)


def _near(x: str, y: str, edits: float) -> bool:
    most = int(edits * max(len(x), len(y)))
    return edit_distance(x, y, most) <= most


def _alike(a: pa.Array, b: pa.Array) -> np.ndarray:
    """How many digits of two columns of fingerprints are equal, row by row."""
    x, y = (np.frombuffer("".join(c.to_pylist()).encode(), np.uint8).reshape(-1, DIGITS) for c in (a, b))
    return (x == y).sum(axis=1)


def _candidates(rows: list[tuple], edits: float, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of a group (token, i, j, block, cid, label, n_chars, fingerprint, place, ..) are of two labels, of lengths that allow the edits, alike, and in no list of an earlier band; and how many digits they share."""
    block, label, n = (np.array([r[c] for r in rows]) for c in (3, 5, 6))
    apart = np.triu(label[:, None] != label[None, :], 1)
    if rows[0][1] != rows[0][2]:
        apart &= block[:, None] != block[None, :]
    longer = np.maximum(n[:, None], n[None, :])
    apart &= longer - np.minimum(n[:, None], n[None, :]) <= (edits * longer).astype(np.int64)
    agree = np.zeros(apart.shape, np.uint8)
    if apart.any():
        digits = np.frombuffer("".join(r[7] for r in rows).encode(), np.uint8).reshape(-1, DIGITS)
        for c in range(DIGITS):
            agree += digits[:, c][:, None] == digits[:, c][None, :]
        apart &= agree >= ALIKE
        # a pair is looked at once, in the list of the first band that it shares
        for at in range(0, rows[0][8], STRIDE):
            same = np.unique(digits[:, at : at + band], axis=0, return_inverse=True)[1].ravel()
            apart &= same[:, None] != same[None, :]
    return apart, agree


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each (token, i, j), which come one group after the other."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[-1][:3] != row[:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _passed(rows: DataFrame, key: str, wanted: DataFrame, low: str) -> DataFrame:
    """The rows whose key can be among those of a written table, and few others: by a bit for each hashed key, in pages of 32,768 bits that are sent to all tasks."""
    size = min(FILTER_BITS, 1 << max(15, (KEY_BITS * wanted.count()).bit_length()))

    def at(name: str) -> tuple[Column, Column]:
        h = F.pmod(F.xxhash64(name), F.lit(size))
        return F.bitmap_bucket_number(h), F.bitmap_bit_position(h)

    page, bit = at(low)
    pages = wanted.select(page.alias("page_"), bit.alias("bit_")).groupBy("page_").agg(F.bitmap_construct_agg("bit_").alias("bits_"))
    page, bit = at(key)
    byte = F.conv(F.hex(F.substring("bits_", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return rows.join(F.broadcast(pages), page == F.col("page_")).where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def near_groups(marked: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", edits: float = EDITED, band: int = BAND) -> DataFrame:
    """(text_id, group_id): texts that have a band in common, linked by at most `edits` times the longer length of edits; group_id is the group's smallest key.

    marked: (key, text_id, n_chars, fingerprint) of all docs, as `with_next` gives them. No link is false, and none between texts with a
    band and ALIKE digits in common is lost; other texts are no candidates, which are most of those with more than some edits: README
    has the shares. So it finds texts with few edits, not all those that `edits` allows.

    Equal texts are one class. Classes that share the digits of a band make a list. Members of a list first meet its pivots, of which each verifies
    the most alike. Lists that then still hold several groups are cut into blocks of bounded size; pairs of blocks compare fingerprints within
    a task, each pair in the list of the first band that it shares, then the texts of those that are alike, skip what is joined already and keep the links of a forest. Pairs are not written out, and
    texts are read only of classes that have an alike partner.
    """
    spark = docs.sparkSession
    classes = marked.groupBy("text_id").agg(F.min(column(key)).alias("low"), F.first("fingerprint").alias("fingerprint"), F.first("n_chars").alias("n_chars")).withColumn("cid", F.monotonically_increasing_id())
    classes = materialise(classes)
    bands = F.array(*[F.struct(F.xxhash64(F.lit(i), F.substring("fingerprint", i + 1, band)).alias("token"), F.lit(i).alias("place")) for i in range(0, DIGITS - band + 1, STRIDE)])
    posted = classes.where("n_chars > 0").select("cid", F.explode(bands).alias("b")).select("cid", "b.token", "b.place")
    posts = materialise(posted.join(posted.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token"), "token", "left_semi"))
    digits = classes.select("cid", "n_chars", "fingerprint")

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = [r for r in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True) if _id(r[2]) == r[0]]
                yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["cid", "text"])

    def bodies(cids: DataFrame) -> DataFrame:
        """Texts of some classes: rows of a class's key, less those with another text. A filter of bounded size keeps the texts of other keys from being exchanged."""
        wanted = materialise(classes.join(cids.distinct(), "cid", "left_semi").select("text_id", "cid", "low"))
        texts = _passed(docs.select(column(key).alias("key_"), F.coalesce(column(text), F.lit("")).alias("text")), "key_", wanted, "low")
        found = texts.join(wanted, F.col("key_").eqNullSafe(F.col("low"))).select("text_id", "cid", "text")
        out = materialise(found.mapInArrow(tidy(known), "cid long, text string").dropDuplicates(["cid"]))
        drop_written(spark, wanted)
        return out

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            agree = _alike(b.column(4), b.column(5)) if b.num_rows else np.empty(0, np.int64)
            keep = (agree >= ALIKE) & (np.abs(n - m) <= (edits * np.maximum(n, m)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(agree)], names=["a", "b", "n"]).filter(pa.array(keep))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                near = [_near(x, y, edits) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    pivot = [F.min(F.struct(F.xxhash64("cid", F.lit(i)).alias("h"), F.col("cid"))).getField("cid") for i in range(PIVOTS)]
    pivots = posts.groupBy("token").agg(F.array_distinct(F.array(*pivot)).alias("p"))
    meet = posts.join(pivots, "token").select(F.col("cid").alias("a"), F.explode("p").alias("b")).where("a <> b").distinct()
    met = meet.join(digits.withColumnsRenamed({"cid": "a", "fingerprint": "fa", "n_chars": "na"}), "a").join(digits.withColumnsRenamed({"cid": "b", "fingerprint": "fb", "n_chars": "nb"}), "b")
    scored = met.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(tidy(alike), "a long, b long, n long")
    best = scored.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    best = materialise(best)
    body = bodies(best.select(F.explode(F.array("a", "b")).alias("cid")))
    both = best.join(body.withColumnsRenamed({"cid": "a", "text": "ta"}), "a").join(body.withColumnsRenamed({"cid": "b", "text": "tb"}), "b")
    first = materialise(components(both.select("a", "b", "ta", "tb").mapInArrow(tidy(verified), "a long, b long")))
    for step in (best, body):
        drop_written(spark, step)

    # lists of several groups: members outside the largest meet each other and the largest, block by block
    labelled = materialise(posts.join(first.withColumnRenamed("id", "cid"), "cid", "left").select("token", "place", "cid", F.coalesce("root", "cid").alias("label")).join(classes.select("cid", "n_chars"), "cid"))
    sums = [F.sum(F.xxhash64(F.lit(i), "cid").cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
    cost = F.lit(1.0 / BLOCK) + F.col("n_chars") / BLOCK_CHARACTERS
    by_label = labelled.groupBy("token", "label").agg(F.min("place").alias("place"), F.count("*").alias("m"), F.sum(cost).alias("cost"), *sums)
    mixed = by_label.groupBy("token").agg(F.min("place").alias("place"), F.max(F.struct("m", "label", "cost")).alias("most"), F.count("*").alias("n"), F.sum("m").alias("m"), F.sum("cost").alias("cost"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).where("n > 1")
    # one of lists with the same members, that of their first band: there their pairs are looked at
    mixed = mixed.groupBy("m", "s1", "s2").agg(F.min(F.struct("place", "token", F.col("most.label").alias("largest"), F.ceil(F.col("cost") - F.col("most.cost") + 1e-9).cast("int").alias("few"), F.ceil("most.cost").cast("int").alias("many"))).alias("l")).select("l.token", "l.largest", "l.few", "l.many")
    members = labelled.join(mixed, "token").join(classes.select("cid", "fingerprint"), "cid")
    inside = F.col("label") == F.col("largest")
    hashed = F.xxhash64("cid", "token")
    block = F.when(inside, F.col("few") + F.pmod(hashed, F.greatest("many", F.lit(1)))).otherwise(F.pmod(hashed, F.greatest("few", F.lit(1)))).cast("int")
    cut = members.withColumn("block", block)
    pairs = F.transform(F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    dealt = cut.select("token", "block", "cid", "label", "n_chars", "fingerprint", "place", F.explode(pairs).alias("g")).select("token", F.col("g.i").alias("i"), F.col("g.j").alias("j"), "block", "cid", "label", "n_chars", "fingerprint", "place")

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32())
        for rows in _groups(batches):
            apart, _ = _candidates(rows, edits, band)
            if there := np.flatnonzero(apart.any(axis=0) | apart.any(axis=1)).tolist():
                cols = zip(*(rows[x] for x in there), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=dealt_names)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            apart, agree = _candidates(rows, edits, band)
            root = {r[5]: r[5] for r in rows}
            grams = np.stack([_grams(r[9]) for r in rows])
            found, pairs = [], np.argwhere(apart)
            # the most alike first, so that what is near is joined before the rest is looked at
            for x, y in pairs[np.argsort(-agree[apart].astype(np.int64), kind="stable")].tolist():
                p, q = root[rows[x][5]], root[rows[y][5]]
                if p == q:
                    continue
                # texts that differ in more grams than the allowed edits can change are told apart without their distance
                if int(np.abs(grams[x] - grams[y]).sum()) <= 2 * GRAM * int(edits * max(rows[x][6], rows[y][6])) and _near(rows[x][9], rows[y][9], edits):
                    root = {k: p if v == q else v for k, v in root.items()}
                    found.append((rows[x][4], rows[y][4]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    group, dealt_names = ["token", "i", "j"], dealt.columns
    partnered = materialise(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(partners), dealt.schema))
    body = bodies(partnered.select("cid"))
    with_text = partnered.join(body, "cid").select(*dealt_names, "text")
    more = materialise(with_text.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(links), "a long, b long"))
    final = components(first.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = classes.select("text_id", "cid", "low").join(final.withColumnRenamed("id", "cid"), "cid", "left").select("text_id", "low", F.coalesce("root", "cid").alias("root"))
    out = materialise(named.join(named.groupBy("root").agg(F.min("low").alias("group_id")), "root").select("text_id", "group_id"))
    for step in (classes, posts, first, labelled, partnered, body, more):
        drop_written(spark, step)
    return out


def op6_edit_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against those of its edited text and of the next document, and the verified group of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = materialise(with_next(docs))
    groups = near_groups(marked.select("doc_id", "text_id", "n_chars", "fingerprint"), docs)
    return marked.join(groups, "text_id").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id")
