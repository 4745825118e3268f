import pytest
from foliant.operators import digest, extract, facts
from foliant.plans import analysis
from foliant.plans.checkpoints import Checkpoints
from foliant.sources.versions import TABLES, Revision, Versions, fields
from pyspark.sql import functions as F


def test_verdicts_by_the_first_rule(spark):
    whole = [(i, "a", "clear", None) for i in range(1, 13)]

    def of(changes):
        rows = {(i, p): (i, p, f, e) for i, p, f, e in whole}
        rows.update({(i, p): (i, p, f, e) for i, p, f, e in changes})
        return list(rows.values())

    runs = {
        "clean": of([]),
        "gaps": of([(i, "a", "gap", None) for i in (1, 2, 3, 4, 5)]),
        "four gaps": of([(i, "a", "gap", None) for i in (1, 2, 3, 4)]),
        "parts": of([(i, "a", "gap", None) for i in (1, 2, 3, 4, 5)] + [(5, "b", "clear", None)]),
        "unknown": of([(10, "a", None, None), (10, "b", "clear", None)]),
        "weak": of([(10, "a", "flag", True)]),
        "persistent": of([(11, "a", "flag", True), (11, "b", "flag", True)]),
        "once": of([(11, "a", "flag", True), (11, "b", "clear", None)]),
        "unexplained": of([(3, "a", "flag", None)]),
        "gaps first": of([(i, "a", "gap", None) for i in (1, 2, 3, 4, 5)] + [(10, "a", "flag", False)]),
    }
    df = spark.createDataFrame([(r, *x) for r, rows in runs.items() for x in rows], "run string, item int, part string, finding string, explained boolean")
    got = {x.run: (x.verdict, x.rule) for x in facts.verdict(df).collect()}
    assert got == {
        "clean": ("CLEAN", "no flags"), "gaps": ("INSUFFICIENT_EVIDENCE", "too many gaps"), "four gaps": ("CLEAN", "no flags"), "parts": ("CLEAN", "no flags"),
        "unknown": ("INSUFFICIENT_EVIDENCE", "controls unknown"), "weak": ("IMPAIRED", "material weakness"), "persistent": ("IMPAIRED", "persistent accrual gap"),
        "once": ("MIXED", "isolated flags"), "unexplained": ("IMPAIRED", "unexplained divergence"), "gaps first": ("INSUFFICIENT_EVIDENCE", "too many gaps"),
    }


def test_stages_go_on_behind_the_last_whole_one(spark, tmp_path):
    schemas = {s: fields("n long") for s in ("a", "b", "c")}
    kept, ran = Checkpoints(spark, str(tmp_path), schemas), []

    def stage(name, before=None, breaks=()):
        def run(outputs):
            ran.append(name)
            if name in breaks:
                raise InterruptedError
            return spark.range(3).select(F.col("id").alias("n")) if before is None else outputs[before].withColumn("n", F.col("n") + 10)

        return run

    with pytest.raises(InterruptedError):
        kept.run("t/1", {"a": stage("a"), "b": stage("b", "a"), "c": stage("c", "b", "c")})
    assert ran == ["a", "b", "c"] and kept.whole("t/1", "b") and not kept.whole("t/1", "c") and not kept.whole("t/2", "a")
    state, out = kept.run("t/1", {"a": stage("a"), "b": stage("b", "a"), "c": stage("c", "b")})
    assert state == "resumed" and ran[3:] == ["c"] and sorted(r.n for r in out["c"].collect()) == [20, 21, 22]
    assert kept.run("t/1", {"a": stage("a"), "b": stage("b", "a"), "c": stage("c", "b")})[0] == "completed" and ran[4:] == []


def test_only_declared_and_whole_outputs_are_read(spark, tmp_path):
    kept = Checkpoints(spark, str(tmp_path), {"a": fields("n long, s string")})
    with pytest.raises(ValueError, match="no declared schema"):
        kept.run("t", {"x": lambda _: spark.range(1)})
    with pytest.raises(Exception, match="INVALID_COLUMN"):
        kept.save("t", "a", spark.range(1).select(F.col("id").alias("n"), F.array(F.lit(1)).alias("s")))
    spark.range(5).write.parquet(f"{tmp_path}/thread=p/stage=a")
    (tmp_path / "thread=p/stage=a/_SUCCESS").unlink()
    with pytest.raises(ValueError, match="not whole"):
        kept.load("p", "a")
    spark.range(5).write.parquet(f"{tmp_path}/thread=q/stage=a")
    with pytest.raises(ValueError, match="bigint"):
        kept.load("q", "a")
    kept.save("p", "a", spark.sql("SELECT 'x' AS s, 1 AS n, 2 AS more"))  # a partial output is overwritten, columns are put in order
    assert [tuple(r) for r in kept.load("p", "a").collect()] == [(1, "x")]


def test_tables_of_the_store_by_revision(spark):
    chunks = TABLES["chunks"]
    old = spark.createDataFrame([(1, "The Cat, 3", ["Part I"])], "id long, content string, section_path array<string>")
    new = chunks.read_as(old, 1, 3)
    assert new.schema == chunks.schema(2) and new.first().content_words == ["the", "cat", "3"] and new.first().embedding is None
    back = chunks.read_as(new, 3, 1)
    assert back.schema == chunks.schema(1) and back.first().content == "The Cat, 3"
    with pytest.raises(ValueError, match="before revision 3"):
        TABLES["financial_metrics"].read_as(old, 3, 2)
    with pytest.raises(ValueError, match="two steps"):
        Versions(1, Revision(chunks.schema(1)), Revision(chunks.schema(2)))


def test_figures_of_labels(spark):
    rows = [
        (1, "Total revenues were $1,234.5 million. Gross profit: 400 million; NET LOSS of 12.25 million\nFree cash flow 7 thousand."),
        (2, "Revenue rose from 1 million to 2 million. Revenue of $3.4 billion. Net income and revenue of 5 million"),
        (3, "Revenue 7 million; revenues 7 million; net dollar retention 110%; net income 4%"),
        (4, None), (4, ""), (5, "unrevenue 5 million"), (6, "revenue 5 million"), (6, "revenue 6 million"), (7, "Revenue $4.125 billion"),
    ]
    got = {r.id: r for r in extract.figures(spark.createDataFrame(rows, "id int, text string"), ["id"]).collect()}
    assert (got[1].revenue, got[1].gross_profit, got[1].gaap_net_income, got[1].free_cash_flow, got[1].errors) == (1234.5, 400.0, 12.25, 0.007, [])
    assert got[2].revenue == 5.0 and got[2].gaap_net_income is None and got[2].errors == ["gaap_net_income: no figure"]
    assert (got[3].revenue, got[3].net_dollar_retention, got[3].gaap_net_income, got[3].errors) == (7.0, 110.0, None, ["gaap_net_income: unit"])
    assert got[4].extraction_confidence == got[5].extraction_confidence == "not_disclosed" and got[4].errors == []
    assert got[6].revenue is None and got[6].errors == ["revenue: values differ"] and got[7].revenue == 4125.0


def test_a_feed_stops_at_its_budget(spark):
    rows = [("x", i, "ACME up", "gain " * 40) for i in range(40)] + [("y", i, None, None) for i in range(20)] + [("z", None, "h", "s")]
    feed = spark.createDataFrame(rows, "run string, position long, headline string, summary string")
    plan = {(r.run, r.batch): r for r in digest.planned(feed, budget=0.0076, size=15).collect()}
    assert [plan["x", b].status for b in range(3)] == ["called", "called", "skipped"] and [plan["x", b].articles for b in range(3)] == [15, 15, 10]
    assert [plan["y", b].status for b in range(2)] == ["error", "error"] and len(plan) == 5
    got = digest.digest(feed, F.lit("acme"), ["gain"], ["loss"], 0.0076, 15).collect()
    assert {(r.sentiment, r.relevance) for r in got} == {("positive", "primary")} and sorted(r.position for r in got) == list(range(30))
    assert digest.planned(feed.limit(0)).count() == 0


def test_legs_left_out_are_gaps(spark, tmp_path):
    kept = Checkpoints(spark, str(tmp_path), {"technical": fields("ticker string"), "news": fields("ticker string"), "sentiment": fields("ticker string"), "memo": analysis.MEMO})
    tickers, ran = spark.createDataFrame([("A",), ("B",), ("A",)], "ticker string"), []

    def leg(name, rows):
        def run(outputs):
            ran.append(name)
            return spark.createDataFrame(rows, "ticker string")

        return run

    stages = {"technical": leg("technical", [("A",), ("B",)]), "news": leg("news", [("A",)]), "sentiment": leg("sentiment", [("A",)])}
    state, memo = analysis.run(kept, "t", tickers, stages, ["news", "technical"])
    assert state == "started" and ran == ["technical", "news", "sentiment"]
    assert {r.ticker: (r.evidence, r.data_gaps) for r in memo.collect()} == {
        "A": (["technical", "news"], ["fundamentals: did not run"]),
        "B": (["technical"], ["fundamentals: did not run", "news: nothing on this ticker"]),
    }
    assert analysis.run(kept, "t", tickers, stages, ["technical", "news"])[0] == "completed" and len(ran) == 3
    only = analysis.run(kept, "t", tickers, stages, ["technical"])
    assert only[0] == "started" and only[1].first().data_gaps == ["fundamentals: did not run", "news: did not run"]
    for wrong in (["charts"], []):
        with pytest.raises(ValueError):
            analysis.run(kept, "t", tickers, stages, wrong)
