"""Analyses of many tickers as a chain of legs and a memo, over typed checkpoints.

Legs can be left out; those that are chosen run in their own order, whatever order they are asked in. The memo always comes last and says for each
ticker what it rests on: a leg that did not run, or that has nothing on a ticker, is a gap there, never a finding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.checkpoints import Checkpoints, Stage
from foliant.sources.versions import fields

#: Legs in order, each with its stages, the last of which is what the memo looks at.
LEGS = {"fundamentals": ("fundamentals",), "technical": ("technical",), "news": ("news", "sentiment")}
MEMO = fields("ticker string, evidence array<string>, data_gaps array<string>")


def chosen(legs: list[str] | None) -> list[str]:
    """All legs, or those that are asked for, in order; ValueError for unknown ones and for none."""
    if unknown := sorted(set(legs or ()) - set(LEGS)):
        raise ValueError(f"unknown legs: {', '.join(unknown)}")
    if legs is not None and not legs:
        raise ValueError("at least one leg is needed")
    return [x for x in LEGS if legs is None or x in legs]


def memo(tickers: DataFrame, outputs: dict[str, DataFrame], legs: list[str]) -> DataFrame:
    """(ticker, evidence, data_gaps) for each ticker, out of the last stage of each leg that ran (ticker, ..)."""
    out, evidence, gaps = tickers.select("ticker").distinct(), [], []
    for leg, stages in LEGS.items():
        if leg not in legs:
            gaps.append(F.lit(f"{leg}: did not run"))
            continue
        out = out.join(outputs[stages[-1]].select("ticker").distinct().withColumn(leg, F.lit(True)), "ticker", "left")
        evidence.append(F.when(F.col(leg), leg))
        gaps.append(F.when(F.col(leg).isNull(), f"{leg}: nothing on this ticker"))
    some = lambda c: F.filter(F.array(*c), lambda x: x.isNotNull())
    return out.select("ticker", some(evidence).alias("evidence"), some(gaps).alias("data_gaps"))


def run(kept: Checkpoints, thread: str, tickers: DataFrame, stages: dict[str, Stage], legs: list[str] | None = None) -> tuple[str, DataFrame]:
    """('completed', 'resumed' or 'started', the memo of all tickers). A thread and its legs go together: another choice of legs is another run."""
    some = chosen(legs)
    chain: dict[str, Stage] = {s: stages[s] for leg in some for s in LEGS[leg]}
    chain["memo"] = lambda outputs: memo(tickers, outputs, some)
    state, outputs = kept.run(f"{thread}:{','.join(some)}", chain)
    return state, outputs["memo"]
