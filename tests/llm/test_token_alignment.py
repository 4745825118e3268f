import hashlib
import json
import random
import sys
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from foliant.llm import token_alignment as ta
from pyspark.sql import functions as F
from tokenizers import Tokenizer

A, B = ta.default_paths()


@pytest.fixture(scope="module")
def libraries():
    """The two libraries and the bytes of their tokens, by hand."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    # GPT-2's rule by the book: printable bytes stand for themselves
    shown = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    of, n = {chr(x): x for x in shown}, 0
    for x in range(256):
        if x not in shown:
            of[chr(256 + n)] = x
            n += 1
    entry = {i: t for t, i in a.get_vocab(with_added_tokens=False).items()}

    def bytes_a(i):
        return bytes(of[c] for c in entry[i])

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    return a, b, bytes_a, bytes_b


def by_hand(libraries, rows):
    """Every row's digest by spans of all tokens and all pairs of them."""
    a, b, bytes_a, bytes_b = libraries
    told, held = [], Counter()
    for key, text in rows:
        links, groups = [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        if not text or any(b"".join(map(f, ids)) != (" " + text).encode() for f, ids in ((bytes_a, ids_a), (bytes_b, ids_b))):
            told.append((key, [], [], [], []))
            continue
        spans = []
        for ids, f in ((ids_a, bytes_a), (ids_b, bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((i, at, at + len(f(i))))
                at += len(f(i))
            spans.append(out)
        ends = {e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}
        at = 0
        for e in sorted(ends):
            groups.append([[i for i, s, t in side if s >= at and t <= e] for side in spans])
            at = e
        if len(text) < 3000:
            links = [(i, j) for i, s, t in spans[0] for j, u, v in spans[1] if s < v and u < t]
        else:  # by bytes
            own = [[k for k, (_, s, t) in enumerate(side) for _ in range(s, t)] for side in spans]
            links = [(spans[0][x][0], spans[1][y][0]) for x, y in dict.fromkeys(zip(*own))]
        held.update(set(links))
        told.append((key, ids_a, ids_b, groups, links))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(n, best.get(i, 0))
    out = []
    for key, ids_a, ids_b, groups, links in told:
        spelt = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((key, len(ids_a), len(ids_b), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(spelt.encode()).hexdigest() if ids_a else "", sum(len(g) * len(h) for g, h in groups)))
    return out


def texts(n, seed=1):
    r = random.Random(seed)
    odd = [None, "", " ", "  x   y ", "\n\n\ta\r\n", "<|endoftext|> <s></s> <unk> <0x41>", "▁a▁", "é" * 50, "日本語 テスト", "🎉🎉 👩‍👩‍👧", "\x00\x01", "don't we'll I'VE", "ﬁne ½ Å é", "1234567 8,9.0", "a" * 4000, "word " * 900, "  　x", "﻿b"]
    return odd + ["".join(r.choice(["the ", "of", " ing", "é", "🎉", "\n", " ", "Zq", "0x", "7", "<", "s>", "漢", "'s", "un", "able"]) for _ in range(r.randrange(1, 40))) for _ in range(n)]


def test_rows_are_those_of_all_pairs(spark, libraries, monkeypatch):
    rows = [(i % 50 if i % 17 else None, t) for i, t in enumerate(texts(150))] + [(7, "the of ing")] * 40
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id int, text string, n_a int, `pairs.` string").repartition(3)
    want = by_hand(libraries, rows)
    assert len({r[7] for r in want}) > 100
    got = ta.alignment(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_products"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    monkeypatch.setattr(sys.modules["foliant.llm._common"], "SENT_ROWS", 3)  # beyond it counts are exchanged
    assert sorted(map(repr, map(tuple, ta.alignment(df, A, B).collect()))) == sorted(map(repr, want))


def test_slices_do_not_matter(monkeypatch):
    pair, some = ta._pair(A, B), texts(60, 2)

    def all_of():
        out = []
        for s in pair.slices(some):
            x = ta.intervals(s.ends_a, s.ends_b)
            strings, cuts = ta._spelt(pair, s, x)
            out += [b"".join(strings[i:j].tolist()) for i, j in zip([0, *cuts[:-1]], cuts)]
        return out

    whole = all_of()
    monkeypatch.setattr(ta, "SLICE_BYTES", 40)
    monkeypatch.setattr(ta, "SLICE_ROWS", 3)
    assert all_of() == whole


def test_groups_and_products(spark):
    df = spark.createDataFrame([(3, "unbelievable 日本 x"), (4, None), (5, "the")], "doc_id long, text string")
    rows = ta.groups(df, A, B).collect()
    pair = ta._pair(A, B)
    for key, raw in ((3, " unbelievable 日本 x".encode()), (5, b" the")):
        mine = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.group)
        assert [r.group for r in mine] == list(range(len(mine))) and mine[0].start == 0 and mine[-1].end == len(raw)
        assert all(x.end == y.start for x, y in zip(mine, mine[1:]))
        for r in mine:
            assert raw[r.start : r.end] == b"".join(pair.a.tokens[i] for i in r.a_ids) == b"".join(pair.b.tokens[i] for i in r.b_ids)
    assert not [r for r in rows if r.doc_id == 4]
    each = ta.products(ta.groups(df, A, B))
    assert each.count() == sum(len(r.a_ids) * len(r.b_ids) for r in rows)
    assert abs(each.agg(F.sum("share")).first()[0] - len(rows)) < 1e-9


def test_union_and_owners():
    x = ta.intervals(np.array([2, 5, 9]), np.array([1, 5, 6, 9]))
    assert x.ends.tolist() == [1, 2, 5, 6, 9] and x.owner_a.tolist() == [0, 0, 1, 2, 2] and x.owner_b.tolist() == [0, 1, 1, 2, 3]
    assert x.closes.tolist() == [False, False, True, False, True]
    r = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in "ab")
        assert ta.union1d(a, b).tolist() == np.union1d(a, b).tolist()


def test_the_faster_library_gives_the_same_ids(libraries):
    """Over all entries of the vocabulary, and every character of Unicode between, before and after others."""
    side, slow = ta.ByteLevel(A), libraries[0]
    assert side._fast is not None
    entries = [t.decode(errors="ignore") for t in side.tokens]
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    step = 400  # characters to a text, each among letters, digits, marks and spaces
    around = [("x", "y"), ("1", " "), (".", "'s"), (" ", "\n ")]
    told = entries + ["".join(f"{a}{c}{b}" for i, c in enumerate(points[at : at + step]) for a, b in (around[(i + at // step) % 4],)) for at in range(0, len(points), step)]
    for at in range(0, len(told), 2000):
        part = told[at : at + 2000]
        want = slow.encode_batch([" " + t for t in part], add_special_tokens=False)
        for t, x, y in zip(part, side.encode(part), want):
            assert x.tolist() == y.ids, t[:80]


def test_other_vocabularies_take_the_slower_library(tmp_path):
    told = json.load(open(A, encoding="utf-8"))
    told["model"]["merges"] = told["model"]["merges"][:200][::-1]
    (tmp_path / "own.json").write_text(json.dumps(told))
    side = ta.ByteLevel(str(tmp_path / "own.json"))
    assert side._fast is None
    assert b"".join(side.tokens[i] for i in side.encode(["the thing é"])[0]) == " the thing é".encode()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ta.alignment(df, A, B).count() == 0 and ta.groups(df, A, B).count() == 0


def test_query_on_whole_documents(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, ta.op11_token_alignment(spark, sf).collect())) == sorted(by_hand(libraries, rows))
