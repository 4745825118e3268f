"""Analyst formulas over facts (ticker, period, concept, value); periods sort as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide(facts: DataFrame, concepts: list[str]) -> DataFrame:
    """One row per ticker and period, one column for each concept."""
    return facts.groupBy("ticker", "period").pivot("concept", concepts).agg(F.first("value"))


def _before(column: str) -> Column:
    return F.lag(column).over(Window.partitionBy("ticker").orderBy("period"))


def growth(column: str) -> Column:
    """Percent since the period before; null from a base that is not positive."""
    base = _before(column)
    return F.when(base > 0, F.round((F.col(column) - base) / base * 100, 4))


def margin(part: str, whole: str) -> Column:
    return F.round(F.try_divide(F.col(part), F.col(whole)) * 100, 4)


def free_cash_flow(f: DataFrame) -> DataFrame:
    """operating_cash_flow, capex, capitalized_software, revenue: free cash flow, its growth and revenue's."""
    out = f.withColumn("fcf", F.col("operating_cash_flow") - F.col("capex") - F.coalesce("capitalized_software", F.lit(0.0)))
    return out.select("ticker", "period", "fcf", growth("fcf").alias("fcf_growth"), growth("revenue").alias("revenue_growth"))


def stock_compensation(f: DataFrame) -> DataFrame:
    """stock_compensation, one_time_charge, revenue: recurring share of revenue, and its change in basis points."""
    out = f.withColumn("sbc_percent", F.round(F.try_divide(F.col("stock_compensation") - F.coalesce("one_time_charge", F.lit(0.0)), F.col("revenue")) * 100, 4))
    return out.select("ticker", "period", "sbc_percent", F.round((F.col("sbc_percent") - _before("sbc_percent")) * 100, 2).alias("change_bps"))


def segment_margins(segments: DataFrame) -> DataFrame:
    """(ticker, segment, period, revenue, operating_income): margin, and whether it falls while revenue grows."""
    w = Window.partitionBy("ticker", "segment").orderBy("period")
    out = segments.withColumn("margin", margin("operating_income", "revenue"))
    falls = (F.col("margin") < F.lag("margin").over(w)) & (F.col("revenue") > F.lag("revenue").over(w))
    return out.select("ticker", "segment", "period", "margin", F.coalesce(falls, F.lit(False)).alias("falls_while_growing"))


def leverage(f: DataFrame) -> DataFrame:
    """current_debt, long_term_debt, cash, operating_income (consolidated): gross and net debt by operating income."""
    debt = F.coalesce("current_debt", F.lit(0.0)) + F.coalesce("long_term_debt", F.lit(0.0))
    over = lambda x: F.when(F.col("operating_income") > 0, F.round(x / F.col("operating_income"), 4))
    return f.select("ticker", "period", over(debt).alias("gross"), over(debt - F.coalesce("cash", F.lit(0.0))).alias("net"))


def maturity_wall(maturities: DataFrame, income: DataFrame, months: int = 24) -> DataFrame:
    """maturities (ticker, due, amount), income (ticker, as_of, operating_income): those due within the months that exceed a year's income."""
    j = maturities.join(income, "ticker")
    return j.where((F.col("due") > F.col("as_of")) & (F.col("due") <= F.add_months("as_of", months)) & (F.col("amount") > F.col("operating_income"))).select("ticker", "due", "amount")


def capital(f: DataFrame) -> DataFrame:
    """diluted_shares, capex, acquisitions, repurchases, goodwill, total_assets: share growth, how cash is split, goodwill's share."""
    spent = F.col("capex") + F.col("acquisitions") + F.col("repurchases")
    part = lambda c: F.round(F.try_divide(F.col(c), spent) * 100, 4).alias(f"{c}_percent")
    return f.select("ticker", "period", growth("diluted_shares").alias("share_growth"), part("capex"), part("acquisitions"), part("repurchases"), margin("goodwill", "total_assets").alias("goodwill_percent"))


def accruals(f: DataFrame) -> DataFrame:
    """operating_cash_flow, net_income, receivables, revenue: the gap, and growth of receivables beyond revenue's."""
    out = f.select("ticker", "period", (F.col("operating_cash_flow") - F.col("net_income")).alias("gap"), growth("receivables").alias("receivables_growth"), growth("revenue").alias("revenue_growth"))
    return out.withColumn("excess", F.round(F.col("receivables_growth") - F.col("revenue_growth"), 4))


def backlog(f: DataFrame) -> DataFrame:
    return f.select("ticker", "period", growth("backlog").alias("backlog_growth"), growth("revenue").alias("revenue_growth"))


def coverage(items: DataFrame) -> DataFrame:
    """items (run, item, part, gapped): INSUFFICIENT_EVIDENCE if more than 4 items have gaps in all parts or part a of item 10 has; else OPEN to a verdict."""
    by = items.groupBy("run", "item").agg(F.bool_and("gapped").alias("full"), F.bool_or((F.col("item") == 10) & (F.col("part") == "a") & F.col("gapped")).alias("key"))
    return by.groupBy("run").agg(F.count_if("full").alias("full_gaps"), F.when((F.count_if("full") > 4) | F.bool_or("key"), "INSUFFICIENT_EVIDENCE").otherwise("OPEN").alias("gate"))


#: The item (and its part) on internal controls, the item on earnings quality, and how many items may be gaps.
CONTROLS, EARNINGS, MOST_GAPS = (10, "a"), 11, 4
INSUFFICIENT, IMPAIRED, MIXED, CLEAN = "INSUFFICIENT_EVIDENCE", "IMPAIRED", "MIXED", "CLEAN"


def verdict(items: DataFrame) -> DataFrame:
    """items (run, item, part, finding: gap, clear or flag, explained) to (run, full_gaps, flags, verdict, rule): the first rule that holds decides.

    A part is a gap if all its rows are, flagged if any is, and explained if all its flags are; an item is a gap if all its parts are, and flagged
    throughout if all are. Other findings, null too, count as gaps; a flag whose explanation is null has none; a run without items has no row.
    """
    flag, gap = F.col("finding") == "flag", ~F.coalesce(F.col("finding").isin("clear", "flag"), F.lit(False))
    parts = items.groupBy("run", "item", "part").agg(F.bool_and(gap).alias("gap"), F.coalesce(F.bool_or(flag), F.lit(False)).alias("flag"), F.coalesce(F.bool_and(F.when(flag, F.coalesce("explained", F.lit(False)))), F.lit(True)).alias("explained"))
    controls = (F.col("item") == CONTROLS[0]) & (F.col("part") == CONTROLS[1])
    told = parts.groupBy("run", "item").agg(
        F.bool_and("gap").alias("gap"), F.count_if("flag").alias("flags"), F.bool_and("flag").alias("throughout"), F.bool_and("explained").alias("explained"),
        F.coalesce(F.bool_or(controls & F.col("gap")), F.lit(False)).alias("unknown"), F.coalesce(F.bool_or(controls & F.col("flag")), F.lit(False)).alias("weak"),
    )
    runs = told.groupBy("run").agg(
        F.count_if("gap").alias("full_gaps"), F.sum("flags").alias("flags"), F.bool_or("unknown").alias("unknown"), F.bool_or("weak").alias("weak"),
        F.bool_or((F.col("item") == EARNINGS) & F.col("throughout")).alias("persistent"), F.bool_and("explained").alias("explained"),
    )
    rules = (
        ("too many gaps", F.col("full_gaps") > MOST_GAPS, INSUFFICIENT),
        ("controls unknown", F.col("unknown"), INSUFFICIENT),
        ("material weakness", F.col("weak"), IMPAIRED),
        ("persistent accrual gap", F.col("persistent"), IMPAIRED),
        ("unexplained divergence", ~F.col("explained"), IMPAIRED),
        ("isolated flags", F.col("flags") > 0, MIXED),
        ("no flags", F.lit(True), CLEAN),
    )
    decided = F.coalesce(*[F.when(holds, F.struct(F.lit(v).alias("verdict"), F.lit(name).alias("rule"))) for name, holds, v in rules])
    return runs.select("run", "full_gaps", "flags", decided.alias("d")).select("run", "full_gaps", "flags", "d.verdict", "d.rule")
