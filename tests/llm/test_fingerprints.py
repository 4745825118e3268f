import hashlib
import random
import time

import numpy as np
from foliant.llm import edit_fingerprint as ef


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, q in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (p != q))
    return row[-1]


def test_distance_is_levenshteins():
    r = random.Random(1)
    for _ in range(400):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(14))) for _ in range(2))
        most, want = r.randrange(15), levenshtein(a, b)
        assert ef.edit_distance(a, b, most) == min(want, most + 1)


def test_walk_can_start_anywhere():
    e, text = ef.Embedder(), "the quick brown fox " * 30
    codes = e.codes(text)
    whole = e.walk(codes)
    assert (whole[200:] == e.walk(codes[200:], int(whole[199]))).all()
    assert ((whole[1:] - whole[:-1]) >= 1).all()


def test_likeness_falls_with_edits():
    e, r = ef.Embedder(), random.Random(2)
    text = "".join(r.choice("etaoin shrdlu") for _ in range(3000))
    other = "".join(r.choice("etaoin shrdlu") for _ in range(3000))
    one = text[:1500] + "x" + text[1500:]
    fp = e.fingerprint
    assert ef.likeness(fp(text), fp(one)) > 0.8
    assert 0.4 < ef.likeness(fp(text), fp(ef.edited(text, other))) < 0.8
    assert ef.likeness(fp(text), fp(other)) < 0.35


def test_rows_against_plain_python(spark):
    rows = [(5, "abc" * 50), (1, "é🎉" * 30), (3, None), (2, ""), (4, "x"), (9, "abc" * 50), (7, "y" * 5000), (7, "y" * 5000), (None, "first")]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = ef.with_next(df).collect()
    texts = [t or "" for _, t in sorted(rows, key=lambda x: -1 if x[0] is None else x[0])]
    e = ef.Embedder()
    want = []
    for i, t in enumerate(texts):
        n = texts[(i + 1) % len(texts)]
        x = ef.edited(t, n)
        want.append((len(t), hashlib.sha256(x.encode()).hexdigest(), ef.as_text(e.fingerprint(t)), ef.as_text(e.fingerprint(x)), ef.likeness(e.fingerprint(t), e.fingerprint(x)), ef.likeness(e.fingerprint(t), e.fingerprint(n)), ef._id(t)))
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)
    assert ef.with_next(df.limit(0)).count() == 0
    assert len(ef.with_next(df.where("doc_id = 4")).collect()) == 1


def test_walk_and_digits_step_by_step():
    # the random functions as they are drawn: one bit for a class of characters and a step, and the records of one random number a place
    draw = np.random.default_rng(5)
    bits = draw.integers(0, 2, (ef.CLASSES, ef.PERIOD)).astype(bool)
    bits[:, draw.integers(0, ef.PERIOD)] = True
    e, r = ef.Embedder(), random.Random(8)
    for n in (1, 2, 50, 700):
        text = "".join(r.choice("abc é🎉\n") for _ in range(n))
        written, at, step = [], 0, 0
        while at < n:
            written.append(text[at])
            class_ = (ord(text[at]) * 0x9E3779B97F4A7C15) % (1 << 64) >> 56
            at += bool(bits[class_, step % ef.PERIOD])
            step += 1
        left = e.walk(e.codes(text))
        assert int(left[-1]) == len(written)
        assert "".join(text[int(np.searchsorted(left, x, side="right"))] for x in range(len(written))) == "".join(written)
        want = []
        for d in range(ef.DIGITS):
            place = max(int(x) for x in e.records[d] if x < len(written))
            x = (ord(written[place]) + 1) * int(e.salt[d]) % (1 << 64)
            x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
            want.append(x >> 60)
        assert e.fingerprint(text).tolist() == want


def marked(df):
    return ef.with_next(df).select("doc_id", "text_id", "n_chars", "fingerprint")


def test_near_groups(spark):
    r = random.Random(3)
    base = ["".join(r.choice("etaoin shrdlucmf") for _ in range(600)) for _ in range(5)]
    rows, truth = [], {}
    for i in range(40):
        t = list(base[i % 5])
        for _ in range(r.randrange(3)):
            t[r.randrange(len(t))] = "z"
        rows.append((i, "".join(t)))
        truth[i] = i % 5
    rows += [(100, None), (101, ""), (39, "".join(t)), (None, base[0])]
    df = spark.createDataFrame([(*x, "z", 1) for x in rows], "doc_id long, text string, cid string, token int")
    got = {x.doc_id: x.group_id for x in marked(df).join(ef.near_groups(marked(df), df), "text_id").collect()}
    assert all(truth[got[i]] == truth[i] for i in truth) and sum(got[i] == truth[i] for i in truth) >= 34
    assert got[100] == got[101] == 100 and got[None] == 0
    assert ef.near_groups(marked(df.limit(0)), df.limit(0)).count() == 0


def test_groups_of_bands_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ef, "BLOCK", 6)
    monkeypatch.setattr(ef, "PIVOTS", 1)
    r = random.Random(9)
    frame = "".join(r.choice("etaoin shrdlu") for _ in range(150))
    rows = []
    for i in range(60):  # all share places; some are near
        own = random.Random(r.randrange(25))
        t = list(frame)
        for _ in range(own.randrange(25)):
            t[own.randrange(len(t))] = own.choice("xyzwv")
        t[r.randrange(len(t))] = "q"
        rows.append((i, "".join(t)))
    e = ef.Embedder()
    prints = [ef.as_text(e.fingerprint(t)) for _, t in rows]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            bands = any(prints[i][b : b + ef.BAND] == prints[j][b : b + ef.BAND] for b in range(0, ef.DIGITS - ef.BAND + 1, ef.STRIDE))
            bands = bands and sum(x == y for x, y in zip(prints[i], prints[j])) >= ef.ALIKE
            if bands and levenshtein(rows[i][1], rows[j][1]) <= 15 and root[i] != root[j]:
                p, q = sorted((root[i], root[j]))
                root = [p if x == q else x for x in root]
    assert 5 < len(set(root)) < 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.group_id for x in marked(df).join(ef.near_groups(marked(df), df), "text_id").collect()}
    assert got == dict(enumerate(root))


def test_grams_bound_edits():
    r = random.Random(4)
    for _ in range(300):
        a = "".join(r.choice("abc") for _ in range(r.randrange(40)))
        b = list(a)
        for _ in range(r.randrange(6)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = r.choice(["", "a", "b", "cc"])
        b = "".join(b)
        assert np.abs(ef._grams(a) - ef._grams(b)).sum() <= 2 * ef.GRAM * levenshtein(a, b)


def test_pairs_are_looked_at_in_their_first_band():
    print_ = "0123456789abcdef" * 8
    row = lambda place, cid, digits: (place, 0, 0, 0, cid, cid, 600, digits, place)
    rows = [(1, print_), (2, print_), (3, "ffffff" + print_[6:])]  # the third shares no band before that at 6
    seen = {}
    for place in (0, 6, 12):
        some = rows if place else rows[:2]
        for x, y in np.argwhere(ef._candidates([row(place, *r) for r in some], 0.1, ef.BAND)[0]).tolist():
            seen.setdefault((some[x][0], some[y][0]), []).append(place)
    assert seen == {(1, 2): [0], (1, 3): [6], (2, 3): [6]}


def test_few_texts_pass_the_filter(spark):
    docs = spark.range(20_000).selectExpr("if(id = 7, null, id) as id", "'x' as text")
    wanted = ef.materialise(docs.where("id is null or id % 50 = 0").selectExpr("id as low"))
    got = {r.id for r in ef._passed(docs, "id", wanted, "low").collect()}
    assert {None, *range(0, 20_000, 50)} <= got and len(got) < 2_500
    assert ef._passed(docs, "id", wanted.limit(0), "low").count() == 0


def test_exchanged_texts_are_compressed():
    import pyarrow as pa

    text = "the quick brown fox jumps over the lazy dog, é🎉 " * 40
    assert len(ef._packed(pa.scalar(text))) < len(text) / 2
    assert all(ef._unpacked(ef._packed(pa.scalar(t, pa.string()))) == (t or "") for t in (text, "", None, "\0"))


def test_what_texts_begin_and_end_with_alike_costs_nothing():
    tail = "Is onhe. " * 60_000
    began = time.process_time()
    assert ef.edit_distance("abc" + tail + "kitten" + tail, "abc" + tail + "sitting" + tail, 10) == 3
    assert time.process_time() - began < 5
    draw = random.Random(7)
    for _ in range(300):
        a, b = ("".join(draw.choice("aé😀b") for _ in range(draw.choice([0, 1, 3, 64, 65, 130]))) for _ in range(2))
        b = draw.choice([b, a[:40] + b[:5] + a[50:], a + b, b + a])
        most = draw.choice([0, 2, 20, 300])
        assert ef.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)
