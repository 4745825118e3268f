"""Queries of runs over stored tables: verdicts, schema revisions, resumed stages, extraction and digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.catalog import query
from foliant.functions.shared import new_path, written
from foliant.operators import calc, digest, extract, facts, news
from foliant.plans import analysis, checkpoints, star
from foliant.sources.versions import Revision, Versions, fields

# --- verdicts ---------------------------------------------------------------------------------------


@query("""WITH i AS (SELECT user_id * 1000 + event_id % 40 AS run, event_id % 12 + 1 AS item, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS part, CASE WHEN event_type = 'error' THEN 'flag' WHEN event_type = 'click' AND user_id % 3 = 0 THEN 'gap' WHEN event_type = 'view' AND user_id % 5 = 0 THEN NULL ELSE 'clear' END AS finding, value > 8 AS explained FROM events),
p AS (SELECT run, item, part, bool_and(coalesce(finding NOT IN ('clear', 'flag'), true)) AS gap, coalesce(bool_or(finding = 'flag'), false) AS flag, coalesce(bool_and(coalesce(explained, false)) FILTER (WHERE finding = 'flag'), true) AS explained FROM i GROUP BY ALL),
t AS (SELECT run, item, bool_and(gap) AS gap, count(*) FILTER (WHERE flag) AS flags, bool_and(flag) AS throughout, bool_and(explained) AS explained, coalesce(bool_or(item = 10 AND part = 'a' AND gap), false) AS unknown, coalesce(bool_or(item = 10 AND part = 'a' AND flag), false) AS weak FROM p GROUP BY ALL),
r AS (SELECT run, count(*) FILTER (WHERE gap) AS full_gaps, CAST(sum(flags) AS BIGINT) AS flags, bool_or(unknown) AS unknown, bool_or(weak) AS weak, bool_or(item = 11 AND throughout) AS persistent, bool_and(explained) AS explained FROM t GROUP BY run)
SELECT run, full_gaps, flags, CASE WHEN full_gaps > 4 OR unknown THEN 'INSUFFICIENT_EVIDENCE' WHEN weak OR persistent OR NOT explained THEN 'IMPAIRED' WHEN flags > 0 THEN 'MIXED' ELSE 'CLEAN' END AS verdict,
  CASE WHEN full_gaps > 4 THEN 'too many gaps' WHEN unknown THEN 'controls unknown' WHEN weak THEN 'material weakness' WHEN persistent THEN 'persistent accrual gap' WHEN NOT explained THEN 'unexplained divergence' WHEN flags > 0 THEN 'isolated flags' ELSE 'no flags' END AS rule FROM r""")
def R10_verdicts(spark, d):
    e = star.read(spark, d, "events")
    u, kind = F.col("user_id"), F.col("event_type")
    finding = F.when(kind == "error", "flag").when((kind == "click") & (u % 3 == 0), "gap").when((kind == "view") & (u % 5 == 0), F.lit(None)).otherwise("clear")
    return facts.verdict(e.select((u * 1000 + F.col("event_id") % 40).alias("run"), (F.col("event_id") % 12 + 1).alias("item"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("part"), finding.alias("finding"), (F.col("value") > 8).alias("explained")))


# --- schema revisions -------------------------------------------------------------------------------

_SPELT = {"F": "embedded", "P": "failed", "O": "parsed"}


def _spell(codes: dict[str, str], column: str):
    return F.coalesce(*[F.when(F.col(column) == a, b) for a, b in codes.items()])


#: Three revisions of orders as filings: codes, then spelt states and days, then exact values and a type.
FILINGS = Versions(
    1,
    Revision(fields("id long, status string, value double, filed timestamp")),
    Revision(
        fields("id long, status string, filed_date date, value double"),
        lambda t: t.withColumn("status", _spell(_SPELT, "status")).withColumn("filed_date", F.to_date("filed")),
        lambda t: t.withColumn("status", _spell({b: a for a, b in _SPELT.items()}, "status")).withColumn("filed", F.col("filed_date").cast("timestamp")),
    ),
    Revision(
        fields("id long, filing_type string, filed_date date, status string, value decimal(18,2)"),
        lambda t: t.withColumn("value", F.col("value").cast("decimal(18,2)")),
        lambda t: t.withColumn("value", F.col("value").cast("double")),
    ),
)


@query("""SELECT have, want, count(*) AS filings, CASE want WHEN 1 THEN 'id,status,value,filed' WHEN 2 THEN 'id,status,filed_date,value' ELSE 'id,filing_type,filed_date,status,value' END AS columns,
CASE want WHEN 1 THEN 'double' WHEN 2 THEN 'double' ELSE 'decimal(18,2)' END AS value_type, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
count(*) FILTER (WHERE have >= 3 AND want >= 3) AS typed, sum(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS days
FROM orders, (SELECT unnest([1, 2, 3, 4]) AS have), (SELECT unnest([1, 2, 3, 4]) AS want) GROUP BY have, want""")
def B13_versions(spark, d):
    """A table written at each revision, read as each other; revision 4 of the store changes another table."""
    o = star.read(spark, d, "orders")
    day = F.to_date("o_orderdate")
    old = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").cast("timestamp").alias("filed"))
    new = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("filing_type"), day.alias("filed_date"), _spell(_SPELT, "o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    stored = {1: written(old), 2: written(FILINGS.read_as(old, 1, 2)), 3: written(new), 4: written(new)}
    out = None
    for have, table in stored.items():
        for want in stored:
            t = FILINGS.read_as(table, have, want)
            names = ",".join(t.columns)
            t = t.withColumn("typed", F.col("filing_type").isNotNull() if "filing_type" in t.columns else F.lit(False)).withColumn("day", F.to_date("filed" if "filed" in t.columns else "filed_date"))
            one = t.agg(F.lit(have).alias("have"), F.lit(want).alias("want"), F.count("*").alias("filings"), F.lit(names).alias("columns"), F.lit(dict(t.dtypes)["value"]).alias("value_type"), F.count_if(F.col("status").isin("P", "failed")).alias("failed"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"), F.count_if("typed").alias("typed"), F.sum(F.datediff("day", F.lit("1970-01-01").cast("date"))).alias("days"))
            out = one if out is None else out.unionByName(one)
    return out


# --- resumed runs -----------------------------------------------------------------------------------

_STAGES = {
    "filings": fields("customer long, day date, value double"),
    "days": fields("day date, filings long, value decimal(38,2)"),
    "report": fields("month string, filings long, best_day date"),
}


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS filings, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS value FROM orders GROUP BY 1)
SELECT strftime(day, '%Y-%m') AS month, CAST(sum(filings) AS BIGINT) AS filings, CAST(arg_max(day, CAST(value AS DOUBLE) * 100000 + datediff('day', DATE '1970-01-01', day)) AS VARCHAR) AS best_day, 'resumed' AS state FROM d GROUP BY 1""")
def B12_resumed_run(spark, d):
    """Three stages, of which the last breaks off once; the second run goes on behind the second stage."""
    kept = checkpoints.Checkpoints(spark, new_path(spark), _STAGES)
    broken = []

    def report(outputs):
        if not broken:
            broken.append(True)
            raise InterruptedError("broken off")
        days = outputs["days"]
        best = F.max_by("day", F.struct("value", "day"))
        return days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("filings").alias("filings"), best.alias("best_day"))

    stages = {
        "filings": lambda _: star.read(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("value")),
        "days": lambda o: o["filings"].groupBy("day").agg(F.count("*").alias("filings"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("value")),
        "report": report,
    }
    try:
        kept.run("q1/2024", stages)
    except InterruptedError:
        state, outputs = kept.run("q1/2024", stages)
    return outputs["report"].select("month", "filings", F.col("best_day").cast("string").alias("best_day"), F.lit(state).alias("state"))


# --- extraction -------------------------------------------------------------------------------------

_P, _G, _N = "CAST(o_totalprice AS DECIMAL(18,2))", "CAST(floor(o_totalprice * 0.4) AS BIGINT)", "CAST(floor(o_totalprice * 0.1) AS BIGINT)"
_AMOUNTS = "round(CAST({} AS DOUBLE) * 0.001, 6)"


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS turn, {_AMOUNTS.format(_P)} AS p, {_AMOUNTS.format(_G)} AS g, {_AMOUNTS.format(_N)} AS n FROM orders),
m AS (SELECT id, CASE WHEN turn IN (0, 4) THEN p END AS revenue, CASE WHEN turn IN (0, 1) THEN g END AS gross_profit, CASE WHEN turn IN (0, 2) THEN n END AS gaap_net_income, CASE WHEN turn = 1 THEN 104.5 END AS net_dollar_retention, CASE WHEN turn = 4 THEN n END AS sbc_expense, turn, p, g, n FROM o)
SELECT id, revenue, gross_profit, gaap_net_income, net_dollar_retention, sbc_expense, CASE WHEN turn IN (0, 1, 2, 4) THEN 'stated' ELSE 'not_disclosed' END AS extraction_confidence,
CASE turn WHEN 1 THEN 'revenue: several figures' WHEN 2 THEN 'free_cash_flow: no figure,revenue: rounded' WHEN 4 THEN CASE WHEN g <> n THEN 'gross_profit: values differ' ELSE '' END ELSE '' END AS errors,
CASE WHEN turn = 0 AND p <> 0 THEN round_even(g / p * 100, 1) END AS gross_margin_pct, CASE WHEN turn = 4 AND p <> 0 THEN round_even(n / p * 100, 1) END AS sbc_pct_of_revenue FROM m""")
def Q4_extracted_metrics(spark, d):
    """Sentences about every order's price, in two chunks, and what is read out of them; with margins."""
    o = star.read(spark, d, "orders")
    p, g, n = (F.expr(x).cast("string") for x in (_P, _G, _N))
    turn, say = F.col("o_orderkey") % 5, F.concat
    first = (
        F.when(turn == 0, say(F.lit("Total revenue was $"), p, F.lit(" thousand and gross profit $"), g, F.lit(" thousand. We grew.")))
        .when(turn == 1, say(F.lit("Revenue rose from "), p, F.lit(" thousand to "), g, F.lit(" thousand; gross profit was "), g, F.lit(" thousand\nNet dollar retention rate: 104.5%")))
        .when(turn == 2, say(F.lit("Revenues of $1.4 billion; net loss of "), n, F.lit(" thousand; free cash flow was good.")))
        .when(turn == 4, say(F.lit("Gross profit: "), g, F.lit(" thousand. Share-based compensation expense of "), n, F.lit(" thousand")))
        .otherwise(say(F.lit("In all, "), p, F.lit(" thousand")))
    )
    second = F.when(turn == 0, say(F.lit("Net income "), n, F.lit(" thousand; REVENUE "), p, F.lit(" thousand"))).when(turn == 4, say(F.lit("gross profit "), n, F.lit(" thousand; revenue "), p, F.lit(" thousand")))
    chunks = o.select(F.col("o_orderkey").alias("id"), F.explode(F.array(first, second)).alias("text"))
    out = extract.figures(chunks, ["id"])
    names = ("revenue", "gross_profit", "gaap_net_income", "net_dollar_retention", "sbc_expense", "extraction_confidence")
    return out.select("id", *names, F.array_join("errors", ",").alias("errors"), calc.ratio("gross_profit", "revenue").alias("gross_margin_pct"), calc.ratio("sbc_expense", "revenue").alias("sbc_pct_of_revenue"))


# --- digests ----------------------------------------------------------------------------------------

_FEED = """f AS (SELECT conv_id % 10 AS run, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) - 1 AS position, role || CASE WHEN conv_id % 4 = 0 THEN ' of ACME' ELSE '' END AS headline, CASE WHEN (conv_id // 10) % 7 < 4 THEN text ELSE ' ' END AS summary FROM conversations),
b AS (SELECT run, CAST(floor(position / 5) AS BIGINT) AS batch, count(*) AS articles, sum(length(headline) + length(substr(trim(summary), 1, 600))) AS characters, sum(length(substr(trim(summary), 1, 600))) AS body FROM f GROUP BY ALL),
c AS (SELECT *, round((ceil(characters / 4) * 1.0 + CASE WHEN body = 0 THEN 0 ELSE articles * 40 END * 5.0) / 1000000, 9) AS cost FROM b),
p AS (SELECT run, batch, articles, cost, round(sum(cost) OVER (PARTITION BY run ORDER BY batch), 9) AS running, body FROM c),
s AS (SELECT run, batch, articles, cost, running, CASE WHEN running > 0.009 THEN 'skipped' WHEN body = 0 THEN 'error' ELSE 'called' END AS status FROM p)"""
_GOOD, _BAD = ["la", "the", "que"], ["ing", "er", "de"]


def _count(words: list[str]) -> str:
    return f"len(list_filter(regexp_extract_all(lower(substr(trim(summary), 1, 600)), '[a-z]+'), lambda w: w IN ({', '.join(map(repr, words))})))"


def _feed(spark, d):
    c = star.read(spark, d, "conversations")
    run = F.col("conv_id") % 10
    return c.select(run.alias("run"), (F.row_number().over(Window.partitionBy(run).orderBy("conv_id", "turn")) - 1).alias("position"), F.concat("role", F.when(F.col("conv_id") % 4 == 0, " of ACME").otherwise("")).alias("headline"), F.when(F.floor(F.col("conv_id") / 10) % 7 < 4, F.col("text")).otherwise(" ").alias("summary"))


@query(f"WITH {_FEED} SELECT * FROM s")
def Q5_planned_batches(spark, d):
    return digest.planned(_feed(spark, d), 0.009, 5)


@query(f"""WITH {_FEED} SELECT f.run, position, CASE WHEN {_count(_GOOD)} > {_count(_BAD)} THEN 'positive' WHEN {_count(_GOOD)} < {_count(_BAD)} THEN 'negative' ELSE 'neutral' END AS sentiment, CASE WHEN contains(headline, 'ACME') THEN 'primary' ELSE 'mentioned' END AS relevance
FROM f JOIN s ON s.run = f.run AND batch = floor(position / 5) AND status = 'called'""")
def Q5_digest(spark, d):
    return digest.digest(_feed(spark, d), F.lit("Acme"), _GOOD, _BAD, 0.009, 5)


# --- analyses ---------------------------------------------------------------------------------------

_LEGS = {"technical": fields("ticker string, mean double"), "news": fields("ticker string, sentiment string, relevance string"), "sentiment": fields("ticker string, positive long, negative long, neutral long, net double, excluded long"), "memo": analysis.MEMO}


@query("""WITH u AS (SELECT CAST(user_id AS VARCHAR) AS ticker, count(*) AS n, count(*) FILTER (WHERE event_type IN ('view', 'purchase') AND value > 60) AS stories FROM events GROUP BY user_id)
SELECT ticker, concat_ws(',', CASE WHEN n >= 65 THEN 'technical' END, CASE WHEN stories > 0 THEN 'news' END) AS evidence,
concat_ws(',', 'fundamentals: did not run', CASE WHEN n < 65 THEN 'technical: nothing on this ticker' END, CASE WHEN stories = 0 THEN 'news: nothing on this ticker' END) AS data_gaps FROM u""")
def P4_data_gaps(spark, d):
    """Two of three legs over all users as tickers; the news leg is two stages."""
    e = star.read(spark, d, "events").withColumn("ticker", F.col("user_id").cast("string"))
    stages = {
        "technical": lambda _: e.groupBy("ticker").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).where("n >= 65"),
        "news": lambda _: e.where("event_type IN ('view', 'purchase') AND value > 60").select("ticker", F.when(F.col("event_type") == "purchase", "positive").otherwise("neutral").alias("sentiment"), F.lit("primary").alias("relevance")),
        "sentiment": lambda o: news.sentiment(o["news"], ["ticker"]),
    }
    _, memos = analysis.run(checkpoints.Checkpoints(spark, new_path(spark), _LEGS), "all", e.select("ticker"), stages, ["news", "technical"])
    return memos.select("ticker", F.array_join("evidence", ",").alias("evidence"), F.array_join("data_gaps", ",").alias("data_gaps"))
