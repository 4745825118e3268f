import random
import time
from itertools import combinations, product

from foliant import catalog, catalog_checks
from foliant.operators import verify
from pyspark.sql import functions as F

CHUNK = "Revenue was $3,420.5 thousand against 1,283.2 and 2,344.63; 1,364.1 in 2024; 10874.36 in all; 877,433 and 615,433; 1,271 and 66,295."
SCHEMA = "id long, answer string, chunks array<struct<id:int,text:string>>, computed array<double>, rejected array<struct<value:double,reason:string>>"


def findings(spark, answer, chunk=CHUNK, computed=None, rejected=None):
    return verify.verify(spark.createDataFrame([(1, answer, [(1, chunk)], computed, rejected)], SCHEMA)).orderBy("position").collect()


def classes(spark, *args, **named):
    return {r.value: r["class"] for r in findings(spark, *args, **named) if r.kind != "quote"}


def test_parts_of_longer_numbers_do_not_verify(spark):
    assert classes(spark, "It was 420.5, 283.2 and 344.6. It was 83.2, 44.6.") == dict.fromkeys(("420.5", "283.2", "344.6", "83.2", "44.6"), "unverified")


def test_truncation_rounding_and_scale(spark):
    got = {r.value: r for r in findings(spark, "About 1364 of 10,874.4; that is 877.4M and 615M, in 2024 over 12 months, and 3,420,500.")}
    assert {got[x].chunk for x in ("1364", "10,874.4")} == {1} and {got[x].chunk for x in ("877.4", "615", "3,420,500")} == {verify.SCALED}
    assert got["2024"]["class"] == got["12"]["class"] == "skipped"
    assert classes(spark, "Under Item 103 it has 103", "103.7 in all") == {"103": "skipped"}


def test_rejected_calculations_flag_unless_retried(spark):
    rejected = [(26.233, "unit"), (None, None)]
    assert classes(spark, "A margin of 26.2 percent", rejected=rejected) == {"26.2": "flagged"}
    assert classes(spark, "A margin of 26.2 percent", computed=[26.233, None], rejected=rejected) == {"26.2": "verified"}
    assert classes(spark, "It is 18.1", rejected=[(18.1503, "x")]) == {"18.1": "flagged"}


def test_sums_of_verified_numbers_are_underived(spark):
    assert classes(spark, "Total 67,566 (of 1,271 and 66,295).")["67,566"] == "underived"
    assert classes(spark, "Total 67,566 " + "x " * 120 + "(of 1,271 and 66,295).")["67,566"] == "unverified"
    assert classes(spark, "Total 999,999 (of 1,271 and 66,295).")["999,999"] == "unverified"


def test_first_chunk_and_order(spark):
    rows = [(1, "First 200.5\nthen 300.25, again 200.5", [(9, None), (7, "300.25"), (5, "300.25 and 200.5"), (3, "200.5")], [], [])]
    got = verify.verify(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect()
    assert [(r.position, r.value, r.chunk) for r in got] == [(0, "200.5", 5), (1, "300.25", 7)]
    assert got[0].context == "First 200.5 then 300.25, again 200.5"


def test_quotes_pair_in_order_and_match_loosely(spark):
    text = 'Measures “put in place” last year and "revenue  was $3,420.5\nthousand against" nothing, "words that no chunk of it has".'
    quotes = [r for r in findings(spark, text) if r.kind == "quote"]
    assert [r["class"] for r in quotes] == ["verified", "unverified"]
    assert quotes[0].context.startswith(" “put in place” last year and \"revenue") and quotes[1].context.endswith('has".')


def test_memo_gets_sections_only_with_a_corpus(spark):
    rows = [(1, "Sales of 999,999.", " "), (2, "Sales of 999,999.", CHUNK), (3, "Total 67,566 (of 1,271 and 66,295); 18.1", CHUNK), (4, "Nothing", CHUNK), (5, "Sales", None)]
    df = spark.createDataFrame(rows, "id long, text string, corpus string").selectExpr("*", "cast(null as array<double>) as computed", "array(named_struct('value', 18.15D, 'reason', 'unit')) as rejected")
    got = {r.id: r.text for r in verify.memos(df).collect()}
    assert got[1] == "Sales of 999,999." and got[4] == "Nothing" and got[5] == "Sales"
    assert got[2] == "Sales of 999,999.\n\n## Unverified figures\n\n- 999,999: Sales of 999,999."
    assert [x.split("\n")[0] for x in got[3].split("## ")[1:]] == ["Unvalidated derivations", "Derived without a calculation"]


def test_indicator_guard(spark):
    known = [0.529, 1.2153, 318.73, 352.11, -1.2158, 46.5, None]
    cases = {"the 55-day average": [], "53% of it": [], "90% of it": ["90%"], "22% above": [], "318.73-352.11": [], "around -1.22, or 812": ["812"], "21%-99% above": ["99% above/below"], "-5.3": ["-5.3"], "": []}
    df = spark.createDataFrame([(t, known) for t in cases], "t string, known array<double>")
    assert {r.t: r.u for r in df.select("t", verify.unmatched("t", "known").alias("u")).collect()} == cases
    narrow = spark.createDataFrame([("20%-25% above", [1.225])], "t string, known array<double>")
    assert narrow.select(verify.unmatched("t", "known").alias("u")).first().u == ["20% above/below", "25% above/below"]


def test_verify_on_rows(spark):
    rows = [(1, "Sales of 1,364.1", [(7, CHUNK)], [1.5], []), (2, None, None, None, None), (3, "Sales of 1,364.1 and 1e5 9", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = verify.verify(df).collect()
    assert sorted((r.id, r.value, r["class"], r.chunk) for r in got if r.chunk or r["class"] != "skipped") == [(1, "1,364.1", "verified", 7), (3, "1,364.1", "unverified", None)]
    assert verify.counts(verify.verify(df)).where("id = 1").first().verified == 1
    assert verify.verify(df.limit(0)).count() == 0


def test_derivable_equals_all_signed_sums():
    draw = random.Random(3)
    seen = set()
    for _ in range(300):
        parts = [draw.choice([draw.uniform(0, 1e5), float(draw.randint(1, 300)), round(draw.uniform(0, 9e3), 2)]) for _ in range(draw.randint(0, 7))]
        target = draw.choice([draw.uniform(0, 1e5), float(draw.randint(1, 600)), abs(sum(parts[:4]) - 0.05)])
        sums = (sum(s * x for s, x in zip(signs, some, strict=True)) for n in (2, 3, 4) for some in combinations(parts, n) for signs in product((1, -1), repeat=n))
        expected = any(abs(s - target) <= max(0.1, target * 0.001) for s in sums)
        assert verify.derivable(target, parts) == expected
        seen.add(expected)
    assert seen == {True, False}


def test_derivable_is_fast_on_dense_figures():
    draw = random.Random(4)
    parts = [10_000.0 * draw.randint(1, 10**6) for _ in range(70)]
    began = time.time()
    assert not verify.derivable(1_005_000.0, parts)  # all sums are multiples of 10,000
    assert time.time() - began < 5


def test_whole_texts_are_verified(spark, tmp_path):
    text = "word " * 500 + "Income was 4,321.5 then, and 9,753.25 of it was in sales."
    spark.createDataFrame([(0, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.value: r["class"] for r in catalog_checks.K11_verify(spark, str(tmp_path)).collect()}
    assert got["4,321.5"] == got["9,753.25"] == "verified"
    assert catalog_checks.K13_verdict_counts(spark, str(tmp_path)).first().verified == len([c for c in got.values() if c == "verified"])
    assert [r.value for r in catalog_checks.K8_derived_totals(spark, str(tmp_path)).collect()] == ["67,566"]


def test_quotations_are_found_in_documents(spark, tmp_path):
    spark.createDataFrame([(1, "Net sales — as “stated” — rose"), (2, "Nobody quotes this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(5, "It says: net  sales - as \"stated\"\n- ROSE again."), (6, "x " * 3000 + "Net sales — as “stated” — rose"), (7, "Net sales rose"), (8, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.K10_quotes_in_documents(spark, str(tmp_path)).orderBy("item_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, 5), (2, 0, None)]


def test_keys_find_what_all_pairs_find(spark):
    """Figures against all numbers of their sources by the three rules, whatever their decimals, ties and scales."""
    r = random.Random(3)

    def number():
        x = r.choice([r.uniform(0, 3), r.uniform(0, 2000), r.uniform(1e5, 1e7), r.uniform(1e8, 1e12), r.choice([0.05, 0.1, 0.125, 0.25, 0.45, 2.65, 99.5, 100.5, 1000.5])])
        return f"{x:.{r.choice([0, 0, 1, 1, 2, 3])}f}"

    rows = []
    for i in range(60):
        told = [number() for _ in range(25)]
        near = [f"{float(x) * r.choice([1, 1000, 1e6, 1e-3, 1e-6]) * r.choice([1, 1, 1.0003, 1.0005, 0.9996]) + r.choice([0, 0, 0.5, 0.05, -0.05, 0.005]):.{r.choice([0, 1, 2, 3, 5])}f}" for x in told if r.random() < 0.6]
        rows.append((i, "; ".join(told), [(7, " ".join(x for x in near[::2] if "-" not in x)), (9, " ".join(x for x in near[1::2] if "-" not in x) + " 4465758382889437")], [], []))
    rows.append((60, "4465758382889437 and 0.05 and 0.0500", [(1, "4465758382889437 0.0000001")], [], []))
    schema = "id int, answer string, chunks array<struct<id:int,text:string>>, computed array<double>, rejected array<struct<value:double,reason:string>>"
    given = verify._given(spark.createDataFrame(rows, schema), "id")
    got = {(x.key, x.raw): (x["class"], x.chunk) for x in verify._classed(given).collect()}

    def dec(t):
        return min(len(t.split(".")[1]), 15) if "." in t else 0

    hits = 0
    for i, answer, chunks, _, _ in rows:
        sources = [(float(t), dec(t), "." in t, c) for c, text in chunks for t in text.split() if float(t) > 0]
        for raw in set(answer.replace(" and ", "; ").split("; ")):
            v, half = float(raw), 0.5 * 10.0 ** -dec(raw)
            if (v == int(v) and v < 100) or (len(raw) == 4 and raw[:2] in ("19", "20")):
                assert got[i, raw][0] == "skipped"
                continue
            one = [c for s, d, dot, c in sources if abs(s - v) <= half or (v == int(v) and dot and int(s) == v) or (v != int(v) and d in (1, 2) and abs(s - v) <= 0.5 * 10.0**-d)]
            other = any(abs(s / k - v) <= half for s, *_ in sources for k in (1e3, 1e6)) or any(abs(v * (1 / k) - s) <= s * 0.0005 for s, *_ in sources for k in (1e3, 1e6))
            want = ("verified", one[0]) if one else ("verified", -2) if other else ("unverified", None)
            assert got[i, raw] == want, (raw, sources)
            hits += want[0] == "verified"
    assert hits > 300


def test_a_figure_asks_for_few_keys(spark):
    figures = ["0.05", "0.1", "0.5", "18.1", "0.0001", "345,678.9", "100", "4465758382889437", "99.95", "3.14159265358979", "1000000.00"]
    rows = spark.createDataFrame([(x.replace(",", ""),) for x in figures], "t string").select(F.col("t").cast("double").alias("v"), verify.decimals(F.col("t")).alias("shown"))
    assert max(r[0] for r in rows.select(F.size(verify._asked())).collect()) <= 9


def test_keys_without_sources_go_no_further(spark):
    rows = [(1, "It was 1,234.5 and 777 in all.", [(1, "About 777 of them.")]), (2, "It was 4,321.", None)]
    answers = spark.createDataFrame([(*r, None, None) for r in rows], "id int, answer string, chunks array<struct<id:int,text:string>>, computed array<double>, rejected array<struct<value:double,reason:string>>")
    met = verify._met(verify._given(answers, "id")).select("key", "raw", "source", "wide").collect()
    assert all(r.wide is not None or r.source is not None for r in met)
    assert sorted((r.key, r.raw) for r in met if r.raw != "777") == [(1, "1,234.5"), (2, "4,321")]
    assert sum(r.wide is not None for r in met) == 3 and {r.source for r in met if r.raw == "777"} >= {777.0}
