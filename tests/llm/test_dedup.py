import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from foliant.llm import minhash as mh
from foliant.llm import suffix_dedup as sd
from foliant.llm._common import components


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(8, 40)] + [(60, 61), (61, 62), (62, 60), (1, 1)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(101, 131)} == {100} and {got[i] for i in range(8, 40)} == {7} and got[62] == 60 and 1 not in got


def brute_components(rows, words, hundredths=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else frozenset()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= hundredths * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sets, {i: find(i) for i in ids}


def corpus(r, n):
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.randrange(5, 120))] for _ in range(6)]
    shared = [r.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(r.choice(base)) if r.random() < 0.7 else [r.choice(vocabulary) for _ in range(60)] + shared
        for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One Two"), (n + 4, "one  two"), (n + 5, "É é"), (n + 6, "é é")]


def broadcast_parts(plan):
    """The lines under each BroadcastExchange of a plan's tree down to the next exchange, which is where Spark has measured sizes."""
    lines, out = plan.splitlines(), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line) or "Exchange hashpartitioning" in below:
                    break
                out.append(below)
    return out


def test_what_grows_by_arrays_is_not_broadcast(spark, monkeypatch):
    # Spark sizes an array as one element and an explode as the rows before it, so by its sizes it would send both
    plans, write = [], mh.materialise
    monkeypatch.setattr(mh, "materialise", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    mh.near_duplicates(spark.createDataFrame(corpus(random.Random(3), 60), "doc_id long, text string")).collect()
    sent = [x for p in plans for x in broadcast_parts(p)]
    assert sent and not [x for x in sent if "Generate explode(signature" in x or "Generate posexplode(" in x or "Generate explode(prefix" in x or "FileScan" in x and "signature#" in x and "block#" not in x]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_are_those_of_all_pairs(spark, words):
    rows = corpus(random.Random(words), 150)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cid string")
    sets, want = brute_components(rows, words)
    got = mh.near_duplicates(df, words=words).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == want[r.doc_id]) for r in got)


@pytest.mark.parametrize(("block", "size", "columns"), [(7, 1 << 20, 50), (512, 1500, 4096)])
def test_lists_of_several_blocks_lose_no_link(spark, monkeypatch, block, size, columns):
    monkeypatch.setattr(mh, "BLOCK", block)
    monkeypatch.setattr(mh, "BLOCK_BYTES", size)
    monkeypatch.setattr(mh, "COLUMNS", columns)
    monkeypatch.setattr(mh, "ROUNDS", 0)  # more is left to the blocks
    draw = random.Random(block)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(160):  # all share most words; some pairs, here and there, share enough
        own = random.Random(draw.randrange(60))
        w = common + [f"o{own.randrange(10**6)}" for _ in range(own.randrange(14, 30))]
        rows.append((i, " ".join([*w, f"e{draw.randrange(3)}"])))
    sets, want = brute_components(rows, 5)
    assert 20 < len(set(want.values())) < 120
    got = mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_stated_rate_of_missed_pairs():
    p = sum(math.comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(mh.MATCHES))
    assert 8e-8 < p < 8.4e-8


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(1, 1 << 63, 1000, dtype=np.uint64))
    b = np.concatenate([a[:900], r.integers(1, 1 << 63, 100, dtype=np.uint64)])
    share = (mh.signature(a) == mh.signature(b)).mean()
    assert 0.65 < share < 0.97 and (mh.signature(a) == mh.signature(a[::-1])).all()


def test_pairs_whose_signatures_agree_least_are_linked(spark):
    # 8 of 10 shingles are common; of 400,000 such pairs, these are among the 12 that agree in 36 or 37 of 64 coordinates
    numbers = [53249, 109372, 150559, 267329]
    texts = [" ".join(f"w{n}x{i}" for i in range(at, at + 13)) for n in numbers for at in (0, 1)]
    sketched = [mh.signature(mh.Shingler(5)(t)) for t in texts]
    assert [int((sketched[i] == sketched[i + 1]).sum()) for i in range(0, 8, 2)] == [37, 37, 36, 36]
    got = mh.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i in range(8)}


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " x"), (2, text + " x"), (None, text), (3, "other words that stand here alone"), (3, "other words that stand here alone"), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = mh.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, len(r.text or "")) for r in got.collect()) == [(1, len(text)), (3, 33), (4, 0), (4, 0), (5, 0)]
    assert mh.keep_one(df.limit(0)).count() == 0


def brute_repeats(rows, length):
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for k, t in rows:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        rest = bytes(c for c, h in zip(t, hit) if not h)
        out.append((k, len(t), sum(hit), sum(1 for i in range(len(hit)) if hit[i] and not (i and hit[i - 1])), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "together", "segment"), [(8, 4096, 1 << 17), (25, 2, 64), (40, 4096, 64)])
def test_repeats_are_those_of_all_substrings(spark, monkeypatch, length, together, segment):
    monkeypatch.setattr(sd, "SEGMENT", segment)
    r = random.Random(length)
    passages = ["".join(r.choice("abcde é") for _ in range(r.randrange(10, 90))) for _ in range(6)]
    rows = []
    for i in range(60):
        t = "".join(r.choice(passages) if r.random() < 0.4 else "".join(r.choice("abcdefghij ") for _ in range(30)) for _ in range(r.randrange(6)))
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "ab" * 150), (103, "a" * 200), (104, rows[0][1]), (104, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_spans int")
    spans = {(x["_key"], x["_hash"]): sd._united([s.asDict() for s in x.spans]) for x in sd.repeated_spans(df, length=length, together=together).collect()}
    keyed = df.select("doc_id", "text", sd.F.xxhash64("text").alias("h")).collect()
    got = []
    for x in keyed:
        raw = (x.text or "").encode()
        cuts = spans.get((x.doc_id, x.h), [])
        rest = sd._kept(raw, cuts)
        got.append((x.doc_id, len(raw), len(raw) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest()))
    assert sorted(got, key=str) == brute_repeats([(k, (t or "").encode()) for k, t in rows], length)


def test_clean_keeps_columns(spark):
    text = "é" * 150
    df = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (3, "short", "c"), (4, None, "d")], "doc_id long, text string, n_bytes string")
    got = {r.doc_id: r for r in sd.clean(df).collect()}
    assert (got[1].text, got[1].n_bytes, got[1].n_removed, got[1].n_spans) == ("", 300, 300, 1)
    assert got[3].text == "short" and got[4].text is None and got[4].n_bytes == 0
    assert sd.clean(df.limit(0)).count() == 0
    assert got[3].kept_sha256 == hashlib.sha256(b"short").hexdigest()


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(sd, "_mixed", lambda h: h & np.uint64(7))
    contexts = [b"abcdefghij", b"abcdefghij", b"0123456789", b"zzzzzzzzzz", b"0123456789"]
    zero = np.zeros(5, np.int64)
    at, a, b = sd.repeats_among(contexts, zero, zero, 10)
    assert sorted(at.tolist()) == [0, 1, 2, 4] and set(a.tolist()) == {0} and set(b.tolist()) == {10}
