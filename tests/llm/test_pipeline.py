from collections import Counter

import corpus_pipeline as cp
import pytest
from foliant.llm._common import materialise
from foliant.llm.suffix_dedup import LENGTH

SF = "/root/testdata/sf0.001"


def brute_clean(rows):
    """(doc_id, bytes left) of texts as bytes, without what strings of LENGTH bytes that start twice cover."""
    seen = Counter(t[i : i + LENGTH] for _, t in rows for i in range(len(t) - LENGTH + 1))
    out = {}
    for k, t in rows:
        hit = bytearray(len(t))
        for i in range(len(t) - LENGTH + 1):
            if seen[t[i : i + LENGTH]] > 1:
                hit[i : i + LENGTH] = b"\1" * LENGTH
        out[k] = bytes(c for c, h in zip(t, hit) if not h)
    return out


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = materialise(stage(spark, docs, SF))
        seen[name] = docs
        if name != "packed":
            assert docs.columns == columns
    kept = {r.doc_id for r in seen["quality"].collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    near = seen["near_duplicates"].collect()
    texts = [r.text for r in near]
    assert len(texts) == len(set(texts)) and {r.doc_id for r in near} <= kept
    want = brute_clean([(r.doc_id, r.text.encode()) for r in near])
    cleaned = {r.doc_id: r for r in seen["repeated_strings"].collect()}
    lengths = {r.doc_id: len(r.text.encode()) for r in near}
    assert {k: r.text for k, r in cleaned.items()} == {k: rest.decode("utf-8", "ignore") for k, rest in want.items() if rest or not lengths[k]}
    assert any(len(want[k]) < lengths[k] for k in want)
    assert all(r.n_chars == len(r.text) for r in cleaned.values())
    assert {r.doc_id for r in seen["packed"].collect()} == set(cleaned)
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "repeated_strings", "packed"]


NAMES = "k h _hash _key _id _rank _weight _rule _block _cuts good bad cid token label n c0 c1 c9 pair n_removed n_bytes n_spans kept_sha256 spans rank weight low margin kept start length".split()


@pytest.mark.parametrize("stage", cp.STAGES[:3], ids=lambda s: s[0])
def test_stages_on_odd_rows_and_names(spark, stage):
    passage = " ".join(f"und{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, " \n"), (4, passage), (5, passage), (5, passage), (None, passage + " ende"), (6, "der Rat " * 20_000), (7, "kurz und gut")]
    df = spark.createDataFrame([(k, t, "de", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", *[f"{i} as `{n}`" for i, n in enumerate(NAMES)])
    got = stage[1](spark, df, SF)
    assert got.columns == df.columns
    out = got.collect()
    assert all(r[5:] == tuple(range(len(NAMES))) for r in map(tuple, out))
    ids = Counter(r.doc_id for r in out)
    if stage[0] == "quality":
        assert not ids[1] and not ids[2] and not ids[3]
    elif stage[0] == "near_duplicates":
        assert ids[1] == ids[2] == ids[3] == ids[4] == ids[6] == ids[7] == 1 and not ids[5] and not ids[None]
    else:
        assert ids[1] == ids[2] == ids[3] == ids[7] == 1 and not ids[4] and not ids[5] and not ids[6]
        assert {r.doc_id: r.text for r in out}[None] == " ende"
    assert stage[1](spark, df.limit(0), SF).count() == 0


def test_packed_on_odd_rows_and_names(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (5, "der rat und " * 40), (5, "der rat und " * 40), (None, "ende"), (6, "der Rat " * 20_000), (7, "kurz und gut")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"{i} as `{n}`" for i, n in enumerate(NAMES) if n not in ("start", "length")], "'x' AS sequence_id", "1 AS offset")
    out = cp.packed(spark, df, SF).collect()
    held, room = Counter(), {}
    for r in out:
        held[r.doc_id] += r.length
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    whole = {r.doc_id: r.doc_tokens for r in out}
    assert set(whole) == {1, 2, 3, 5, None, 6, 7} and whole[1] == whole[2] == whole[3] == 1 and whole[6] > 4096
    assert all(held[k] == n * (2 if k == 5 else 1) for k, n in whole.items())
    for pieces in room.values():
        assert sum(n for _, n in pieces) <= 4096
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
    assert cp.packed(spark, df.limit(0), SF).count() == 0
