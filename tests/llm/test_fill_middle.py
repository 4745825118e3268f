import hashlib
import random
import re
import tracemalloc

import duckdb
import pytest
from foliant.llm import fill_middle as fm
from pyspark.sql import functions as F


def by_hand(text, key, rate=100, spm=50, seed=7, units=fm.LINES):
    """All units as a list, cut and joined."""
    text, parts = text or "", [m.end() for m in re.finditer(units, text or "")]
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(parts)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted(([0] + parts)[h % (n + 1)] for h in (h1, h2))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts(n, seed=1):
    r = random.Random(seed)
    odd = ["", None, "\n", "\n\n\n", "a", "a\n", "\na", "é🎉\n漢\n", "<", "<\nS>\n<P\n>", "x<P>y", "<M>", "a<S>\nb", "<<P\nP>>", "M>\n<", "\r\n   \x00\n", "x" * 50_000, "l\n" * 20_000]
    return odd + ["".join(r.choice(["a", "b ", "\n", "é", "🎉", "<", ">", "P>", "S", "M"]) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("units,rate,spm,seed", [(fm.LINES, 100, 50, 7), (fm.LINES, 60, 0, 1), (r"\S+", 100, 100, 2), (r"(?s).", 90, 50, 3), (r"q", 100, 50, 4)])
def test_rows_are_those_of_lists_and_turn_back(spark, units, rate, spm, seed):
    rows = [(i if i % 11 else None, t, "kept") for i, t in enumerate(texts(300, seed))]
    df = spark.createDataFrame(rows, "doc_id long, text string, `N.` string")
    out = fm.transform(df, units=units, rate=rate, suffix_first=spm, seed=seed)
    assert out.columns == ["doc_id", "N.", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.select("*", fm.restore(F.col("output"), F.col("form")).alias("back"), F.lit(1)).collect()
    want = [(k, "kept", *by_hand(t, k, rate, spm, seed, units), t or "") for k, t, _ in rows]
    assert sorted(map(repr, (tuple(r)[:-1] for r in got))) == sorted(map(repr, want))


def test_places_move_over_all_ranks():
    units, text = re.compile(fm.LINES), "a\nbb\n\nccc"
    ends = [0, 2, 5, 6, 9]
    for i in range(5):
        for j in range(i, 5):
            assert fm.places(units, text, i, j) == (ends[i], ends[j])
    assert fm.count_units(units, text) == 4 and fm.count_units(units, "") == 0


def test_memory_does_not_grow_with_the_units():
    units, few, many = re.compile(fm.LINES), "x" * 600_000, "x\n" * 300_000

    def most(text):
        tracemalloc.start()
        n = fm.count_units(units, text)
        fm.places(units, text, n // 2, n)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert most(many) < most(few) + 20_000


def test_clashing_names_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(5, "a\nb", 1, "x", 2.0)] * 3, "doc_id int, text string, n int, Form string, output double")
    out = fm.transform(df)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert len(set(out.collect())) == 1 and out.count() == 3
    assert fm.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fm.transform(df, rate=101)


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = fm.op12_fill_middle(spark, sf)
    want = duckdb.sql(fm.OP12_SQL)
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
