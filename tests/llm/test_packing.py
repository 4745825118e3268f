import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from foliant.llm import packing as pk
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers():
    e, t, r = pk.Encoder(PATH), Tokenizer.from_file(PATH), random.Random(1)
    texts = ["", "  a  b\n\n", "İstanbul Σας ς", "don't I'LL 's'S", "á b ́c", "<|endoftext|> a<|startoftext|>b", "\x1cq tab\tz\u3000v", "日本語 12３", "x" * 300, "ﬁ Ａ"]
    texts += ["".join(r.choice("aB'.,! 7ÀéßΣ\u0301\n\t<|>_-sStLl") for _ in range(50)) for _ in range(500)]
    assert e.by_runs
    for ids, x in zip(e(texts), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == np.array([*x.ids, 2], "<u4").tobytes()


def check(rows, ids, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[k])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[k])
    assert set(by_doc) == set(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


@pytest.mark.parametrize(("parts", "fan"), [(1, 64), (6, 2)])
def test_every_id_once_and_little_padding(spark, parts, fan):
    r = random.Random(parts)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "the", "Gamma,"]) for _ in range(r.choice([0, 3, 40, 200, 900])))) for i in range(200)] + [(900, None), (901, ""), (902, "word " * 3000)]
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, start int").repartition(parts)
    t = Tokenizer.from_file(PATH)
    ids = {k: [*t.encode(x or "", add_special_tokens=False).ids, 2] for k, x in rows}
    out = pk.pack(df, PATH, length=512, windows=8, worth=16, fan=fan, with_ids=True).collect()
    padding = check(out, ids, 512)
    assert padding < 0.02 * sum(map(len, ids.values()))
    assert all(list(x.ids) == ids[x.doc_id][x.start : x.start + x.length] for x in out)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    out = pk.pack(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in out if r.start == 0) == [(0, 2), (1, 3), (1, 3)]
    assert sum(r.length for r in out) == 8
    assert pk.pack(df.limit(0), PATH).count() == 0
