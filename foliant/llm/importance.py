"""Quality by importance resampling: how much likelier a text is under the target's n-grams than under the raw ones.

1. Two generative models over hashed n-grams: words (any case), pairs of neighbouring words, and pairs of
   neighbouring shapes (case, digits, marks). The raw model counts all documents. The target model counts documents
   labelled good in a sample of labelled ones, at most SAMPLE of them, chosen by a hash of their ids.
2. A text's log weight is the ratio of the two: over all its n-grams, repeats included, the sum of
   log (t + PRIOR) / T - log (e + PRIOR) / T, where t is how often the target, of T n-grams of that kind, has the bucket,
   and e how often T n-grams of the raw model would.
3. Sampling without replacement is Gumbel top-k: the k largest of SHARPNESS times a document's margin plus a Gumbel
   number by hash. The k-th largest is found exactly, by counts of digits from the highest on. k is a parameter;
   where it is not given it is the number of documents of a margin of 0 or more.
4. The margin is the log weight less the cut that loses fewest labelled documents of the sample, good ones lost
   counting LOSS times bad ones kept. A few bad words in a long good text hardly move the sum, so a second ratio
   (the option `confirmed`) looks at words alone, and the margin is the lesser of both. It counts a word's bucket once for
   a text, and only if the target has it less by SPREAD standard deviations and a tenth than the raw text at the usual
   ratio of the two (their weighted median, as the total of the raw text includes what is unlike the target), and
   labelled bad texts have it four times as often; it is truncated at 1, so that good words do not make up for bad ones.

What is sent to the driver and to the executors are bucket counts, of a fixed number, and the sample's scores.

Defined cases: a null text is empty; a text without tokens is rejected; repeated rows have equal log weights
and, with equal keys, equal numbers; where no document is labelled good or none bad, all with tokens are kept;
labels that contradict each other count as bad; an empty table gives an empty table; columns of the
input may bear any name. Whole texts are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._common import by_position, column, materialise, tidy

WORD_BUCKETS = 1 << 17
PAIR_BUCKETS = 1 << 14
SHAPES = 64
#: Where the buckets of words, of pairs, of pairs of shapes, and of whether a word stands five times in a row begin.
BEGIN = (0, WORD_BUCKETS, WORD_BUCKETS + PAIR_BUCKETS, WORD_BUCKETS + PAIR_BUCKETS + SHAPES * SHAPES)
BUCKETS = BEGIN[3] + 2
SAMPLE = 20_000
PRIOR = 10.0
SPREAD = 3.0
RARER = 10.0
LOSS = 5.0
SHARPNESS = 1.0
#: Texts that are Python objects at a time, and bytes of words that a task remembers.
SLICE, REMEMBERED_BYTES = 64, 24 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Features:
    """Texts to the numbers of the buckets that their n-grams fall into, as often as they do."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0

    @staticmethod
    def token(t: str) -> int:
        if t[0].isalpha():
            shape = 0 if t.islower() else 1 if len(t) == 1 or not t.isupper() else 2
        elif t[0].isdigit():
            shape = 3
        else:
            shape = 4 + xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) % (SHAPES - 4)
        return (xxhash.xxh64_intdigest(t.lower().encode("utf-8", "surrogatepass")) >> 7) * SHAPES | shape

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text or "")
        known = self.known
        new = set(tokens).difference(known)
        if self.held > REMEMBERED_BYTES:
            known.clear()
            self.held, new = 0, set(tokens)
        for t in new:
            known[t] = self.token(t)
        self.held += 150 * len(new) + sum(map(len, new))
        x = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        word, shape = x // SHAPES, x % SHAPES
        said = word[shape < 3]
        same = said[1:] == said[:-1]
        again = same[3:] & same[2:-1] & same[1:-2] & same[:-3]
        pair = ((word[:-1].astype(np.uint64) * _ODD ^ word[1:].astype(np.uint64)) * _ODD >> np.uint64(40)).astype(np.int64)
        return np.concatenate([word % WORD_BUCKETS, BEGIN[1] + pair % PAIR_BUCKETS, BEGIN[2] + shape[:-1] * SHAPES + shape[1:], BEGIN[3] + again])


def bucket_counts(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in all texts, and in how many: counted by each task, then summed by bucket; two times BUCKETS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total, having = Features(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                some = [features(t) for t in b.column(0).slice(at, SLICE).to_pylist()]
                total += np.bincount(np.concatenate(some), minlength=BUCKETS)
                having += np.bincount(np.concatenate([np.unique(x) for x in some]), minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there]), pa.array(having[there])], names=["bucket", "n", "m"])

    out = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    counted = docs.select(column(text)).mapInArrow(tidy(run), "bucket int, n long, m long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
    at = counted["bucket"].to_numpy()
    out[0][at], out[1][at] = counted["n"].to_numpy(), counted["m"].to_numpy()
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """By bucket, log of the target's share less log of the raw share, each kind of n-gram by itself; PRIOR is added to the counts of both at the target's size."""
    out = np.zeros(BUCKETS)
    for low, high in zip(BEGIN, (*BEGIN[1:], BUCKETS), strict=True):
        t, r = target[low:high].astype(float), raw[low:high].astype(float)
        if t.any() and r.any():
            size = t.sum() + prior * (high - low)
            out[low:high] = np.log((t + prior) / size) - np.log((r * (t.sum() / r.sum()) + prior) / size)
    return out


def confirmed_ratios(target: np.ndarray, raw: np.ndarray, bad: np.ndarray, prior: float = 1.0, spread: float = SPREAD) -> np.ndarray:
    """By bucket, out of numbers of texts that have it: the log ratio where the target has it surely less and the bad texts confirm it, else 0."""
    there = np.flatnonzero(target)
    ratio = target[there] / np.maximum(raw[there], 1)
    order = np.argsort(ratio, kind="stable")
    below = np.cumsum(target[there][order])
    usual = ratio[order][np.searchsorted(below, below[-1] / 2)]
    expected = raw * usual
    sure = (target < expected - spread * np.sqrt(expected + prior)) & (target < expected / RARER)
    sure &= bad * float(target.sum()) > 4.0 * target * float(bad.sum())
    sure[BEGIN[1] :] = False  # words alone decide: pairs share buckets, and shapes are the sum's to judge
    return np.where(sure, np.log((target + prior) / (expected + prior)), 0.0)


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int) -> DataFrame:
    """(text, good) of at most `sample` labelled documents, the same ones for the same labels."""
    told = labels.where(column(key).isNotNull() & F.col("quality").isNotNull()).groupBy(column(key).alias("_id")).agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    few = told.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # at most `sample` ids are sent out
    return docs.select(column(key).alias("_key"), column(text).alias("text")).join(F.broadcast(few), F.col("_key") == F.col("_id")).select("text", "good")


def best_cut(weights: np.ndarray, good: np.ndarray, loss: float = LOSS) -> float:
    """The cut between two log weights that costs least: `loss` for each good one below, 1 for each bad one above; midway, lowest of equals."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    cost = np.concatenate([[0], np.cumsum(np.where(g, loss, 0))]) + np.concatenate([np.cumsum(np.where(g, 0, 1)[::-1])[::-1], [0]])
    allowed = np.concatenate([[True], w[1:] > w[:-1], [True]])
    cost = np.where(allowed, cost, np.inf)
    i = int(np.argmin(cost))
    if i == 0:
        return -math.inf
    return float(w[i - 1] + 1e-9) if i == len(w) else float((w[i - 1] + w[i]) / 2)


class Model:
    """Fitted ratios and cuts; small and of fixed size, so it travels with the code."""

    def __init__(self, ratios: np.ndarray, confirmed: np.ndarray, cut: float = -math.inf, low: float = -math.inf, accuracy: float = 1.0):
        self.ratios, self.confirmed, self.cut, self.low, self.accuracy = ratios, confirmed, cut, low, accuracy

    def __call__(self, features: Features, text: str | None) -> tuple[float | None, float | None]:
        """(log weight, confirmed log weight) of a text, null without tokens."""
        x = features(text)
        if not len(x):
            return None, None
        told = x[self.confirmed[x] != 0]
        return float(self.ratios[x].sum()), float(self.confirmed[np.unique(told)].sum())


def _scored(docs: DataFrame, at: int, model: Model) -> DataFrame:
    """`docs` (columns by position, text at `at`) with weight and low: both log weights."""
    schema = T.StructType([*docs.schema.fields, T.StructField("weight", T.DoubleType()), T.StructField("low", T.DoubleType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            both: list[tuple] = []
            for i in range(0, b.num_rows, SLICE):
                both += [model(features, t) for t in b.column(at).slice(i, SLICE).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[i] for x in both], pa.float64()) for i in (0, 1))], names=names)

    return docs.mapInArrow(tidy(run), schema)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, confirmed: bool = True) -> Model:
    few = materialise(labelled(docs, labels, key, text, sample))
    target, having = bucket_counts(few.where("good"))
    if not target.any():
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS))
    raw, raw_having = bucket_counts(docs, text)
    bad_having = bucket_counts(few.where(~F.col("good")))[1]
    model = Model(log_ratios(target, raw), confirmed_ratios(having, raw_having, bad_having) if confirmed and bad_having.any() else np.zeros(BUCKETS))
    rows = _scored(few, 0, model).select("good", "weight", "low").where("weight is not null").toArrow()  # at most `sample`
    w, low, g = (rows[c].to_numpy() for c in ("weight", "low", "good"))
    g = g.astype(bool)
    if g.all():
        return model
    model.cut = best_cut(w, g)
    if (rest := w >= model.cut).any() and not g[rest].all():
        model.low = best_cut(low[rest], g[rest])
    model.accuracy = float(((rest & (low >= model.low)) == g).mean())
    return model


def _gumbel(seed: int, *cells: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cells), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def _ranked(scored: DataFrame, model: Model, key: Column, text_hash: Column, seed: int, sharpness: float) -> DataFrame:
    """`scored` with margin and rank, a number whose order is that of the perturbed margins, ties broken by hash."""
    over = [F.col(c) - F.lit(x) for c, x in (("weight", model.cut), ("low", model.low)) if x > -math.inf]
    margin = F.least(*over) if len(over) > 1 else over[0] if over else F.col("weight") * 0
    perturbed = F.lit(sharpness) * margin + _gumbel(seed, key, text_hash)
    number = F.greatest(F.lit(-1.0e9), F.least(F.lit(1.0e9), perturbed))
    tie = F.pmod(F.xxhash64(F.lit(seed + 1), key, text_hash), F.lit(1 << 20))
    return scored.withColumns({"margin": margin, "rank": F.when(F.col("weight").isNotNull(), F.shiftleft(F.round(number * 1024).cast("long"), 20) + tie)})


def kth_largest(df: DataFrame, rank: str, k: int) -> int | None:
    """The k-th largest of a long column without nulls, or the least if there are fewer: 16 bits at a time, from the highest."""
    if k < 1:
        return None
    low = 0
    x = F.col(rank).bitwiseXOR(F.lit(-(1 << 63)))  # as unsigned
    within, left = df, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(0xFFFF))
        rows = sorted(within.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect(), reverse=True)  # at most 65,536
        if not rows:
            return None
        for d, n in rows:
            if n >= left or (d, n) == rows[-1]:
                break
            left -= n
        low |= d << shift
        within = within.where(digit == d)
    return low - (1 << 63)


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, seed: int = 17, sharpness: float = SHARPNESS, k: int | None = None, confirmed: bool = True) -> tuple[DataFrame, int | None, Model]:
    """(scores, cut rank, model): key, text_hash, log_weight, confirmed, margin, rank and kept of every document; kept ones have at least the cut rank."""
    model = fit(docs, labels, key, text, sample, confirmed)
    scored = _scored(docs.select(column(key).alias("c0"), column(text).alias("c1")), 1, model)
    scores = materialise(_ranked(scored.select("c0", F.xxhash64("c1").alias("text_hash"), "weight", "low"), model, F.col("c0"), F.col("text_hash"), seed, sharpness))
    cut = _cut(scores, k)
    return scores.select(F.col("c0").alias(key), "text_hash", F.col("weight").alias("log_weight"), F.col("low").alias("confirmed"), "margin", "rank", _kept(cut).alias("kept")), cut, model


def _cut(ranked: DataFrame, k: int | None) -> int | None:
    known = ranked.where("rank is not null")
    return kth_largest(known, "rank", known.where("margin >= 0").count() if k is None else k)


def _kept(cut: int | None) -> Column:
    return F.lit(False) if cut is None else F.coalesce(F.col("rank") >= cut, F.lit(False))


def select(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, seed: int = 17, sharpness: float = SHARPNESS, k: int | None = None, confirmed: bool = True) -> DataFrame:
    """The documents that are sampled, with their columns. They are written once with their ranks, so that texts are neither read for it again nor exchanged."""
    model = fit(docs, labels, key, text, sample, confirmed)
    base, at = by_position(docs), docs.columns.index(text)
    ranked = materialise(_ranked(_scored(base, at, model), model, F.col(f"c{docs.columns.index(key)}"), F.xxhash64(f"c{at}"), seed, sharpness))
    return ranked.where(_kept(_cut(ranked, k))).select(*base.columns).toDF(*docs.columns)


def op10_importance(spark, sf_dir: str) -> DataFrame:
    """All documents by how much they are like those labelled good and not toxic."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scores, _, _ = resample(docs, labels)
    return scores.select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("confirmed", 6).alias("confirmed"), "kept")
