import math
import random
from collections import Counter

import numpy as np
import pytest
from foliant.llm import importance as im
from pyspark.sql import functions as F

GOOD = "the of and to in that is was for on with as his they at be this from have".split()


def corpus(seed, n):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(GOOD) for _ in range(r.randrange(20, 80))]
        kind = r.random()
        if kind < 0.1:
            words = [w.upper() + "!!" for w in words]
        elif kind < 0.2:
            words = [r.choice(GOOD)] * 30
        elif kind < 0.3:
            words[3] = words[9] = "scoundrel"
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind >= 0.2), int(0.2 <= kind < 0.3)))
    return docs, labels


def frames(spark, seed=1, n=900):
    docs, labels = corpus(seed, n)
    d = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, log_weight double")
    return d, spark.createDataFrame(labels[: n // 2], "doc_id long, quality int, toxic int"), labels


def test_held_out_accuracy(spark):
    d, known, labels = frames(spark)
    kept = {r.doc_id: r.kept for r in im.resample(d, known)[0].collect()}
    held = labels[450:]
    good = [kept[i] for i, q, t in held if q and not t]
    bad = [kept[i] for i, q, t in held if not q or t]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    chosen = im.select(d, known)
    assert chosen.columns == d.columns and sorted(r.doc_id for r in chosen.collect()) == sorted(i for i, k in kept.items() if k)


def plain_grams(text):
    """The n-grams of a text as (kind, bucket), one after the other."""
    tokens = im._TOKEN.findall(text or "")
    codes = [im.Features.token(t) for t in tokens]
    word, shape = [c // im.SHAPES for c in codes], [c % im.SHAPES for c in codes]
    out = [(0, w % im.WORD_BUCKETS) for w in word]
    for a, b in zip(word, word[1:]):
        h = ((a * int(im._ODD) ^ b) * int(im._ODD)) % (1 << 64) >> 40
        out.append((1, im.BEGIN[1] + h % im.PAIR_BUCKETS))
    out += [(2, im.BEGIN[2] + a * im.SHAPES + b) for a, b in zip(shape, shape[1:])]
    said = [w for w, s in zip(word, shape) if s < 3]
    return out + [(3, im.BEGIN[3] + (len(set(said[i : i + 5])) == 1)) for i in range(len(said) - 4)]


def test_counts_and_ratio_against_plain(spark):
    d, known, labels = frames(spark, 2, 120)
    texts = {r.doc_id: r.text for r in d.collect()}
    raw, having = Counter(g for t in texts.values() for g in plain_grams(t)), Counter(g for t in texts.values() for g in set(plain_grams(t)))
    n, m = im.bucket_counts(d.repartition(7))
    assert {b: n[b] for b in np.flatnonzero(n)} == {b: c for (_, b), c in raw.items()}
    assert {b: m[b] for b in np.flatnonzero(m)} == {b: c for (_, b), c in having.items()}
    target = Counter(g for i, q, t in labels[:60] if q and not t for g in plain_grams(texts[i]))
    size = lambda c, k: sum(v for (x, _), v in c.items() if x == k)

    def weight(text):
        out = 0.0
        for k, b in plain_grams(text):
            t, e = target[k, b], raw[k, b] * size(target, k) / size(raw, k)
            out += math.log(t + im.PRIOR) - math.log(e + im.PRIOR)
        return out

    got = {r.doc_id: r.log_weight for r in im.resample(d, known)[0].collect()}
    assert all(abs(got[i] - weight(t)) < 1e-6 for i, t in texts.items())


@pytest.mark.parametrize("k", [1, 50, 899, None])
def test_sampling_is_gumbel_top_k(spark, k):
    d, known, _ = frames(spark)
    scores, _, _ = im.resample(d, known, k=k, sharpness=0.5)
    rows = scores.select("margin", "kept", F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", "text_hash"), 11).alias("u")).collect()
    number = [0.5 * r.margin - math.log(-math.log((r.u + 0.5) / (1 << 53))) for r in rows]
    wanted = sum(r.margin >= 0 for r in rows) if k is None else k
    assert sum(r.kept for r in rows) == wanted
    assert min(x for x, r in zip(number, rows) if r.kept) >= max((x for x, r in zip(number, rows) if not r.kept), default=-1e9) - 2e-3


def test_gumbel_numbers_draw_in_proportion_to_weights(spark):
    # of ten with weights 1 to 10, the first of many draws is each in proportion
    u = spark.range(20000).select(*[im._gumbel(s, F.col("id")).alias(f"g{s}") for s in range(10)]).toPandas().to_numpy()
    first = np.bincount((u + np.log(np.arange(1, 11))).argmax(axis=1), minlength=10) / 20000
    assert np.abs(first - np.arange(1, 11) / 55).max() < 0.015


def test_names_do_not_clash(spark):
    d, known, _ = frames(spark, 3, 80)
    wide = d.selectExpr("*", "1 as good", "2 as _id", "3 as _hash", "4 as `rank`", "5 as weight", "6 as c0", "7 as `a.b`", "8 as kept")
    got = im.select(wide, known)
    assert got.columns == wide.columns
    assert {tuple(r)[3:] for r in got.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8)}


def test_kth_largest(spark):
    r = random.Random(3)
    values = [r.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [5] * 20 + [-1, 0, 1, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 150, 160, len(values), len(values) + 9):
        assert im.kth_largest(df, "x", k) == ranked[min(k, len(values)) - 1]
    assert im.kth_largest(df, "x", 0) is None and im.kth_largest(df.limit(0), "x", 3) is None


def test_cut_costs_least():
    r = np.random.default_rng(4)
    for _ in range(30):
        w, g = r.integers(-5, 5, 20).astype(float), r.random(20) < 0.6
        cost = lambda c: 5 * (g & (w < c)).sum() + (~g & (w >= c)).sum()  # noqa: B023, E731
        assert cost(im.best_cut(w, g)) == min(cost(c) for c in [-np.inf, *(np.arange(-6, 7) + 0.5)])


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (4, "some text"), (4, "some text"), (None, "text"), (5, "w " * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = im.resample(d, none)[0].collect()
    assert sorted((r.doc_id or 0, r.kept) for r in got) == [(0, True), (1, False), (2, False), (3, False), (4, True), (4, True), (5, True)]
    assert im.select(d.limit(0), none).count() == 0 and im.select(d, none).count() == 4
    torn = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.good for r in im.labelled(d, torn, "doc_id", "text", 9).collect()} == {False}
