"""Ingestion as stages over all filings in the state before: discovered, downloaded, parsed, chunked, embedded.

A stage takes the filings that are ready for it, all at once, and records what failed and why; others go on. Running
it again finds what is left, so it resumes wherever it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("discovered", "downloaded", "parsed", "chunked", "embedded")
ALLOWED = {**dict(zip(ORDER, ORDER[1:], strict=False)), "failed": "discovered"}


def may_become(old: str, new: str) -> bool:
    """Each state leads to the next or to failed; a failed filing starts again."""
    return ALLOWED.get(old) == new or (new == "failed" and old != "failed")


def ready(filings: DataFrame, stage: str) -> DataFrame:
    """The filings that this stage is next for."""
    before = ORDER[ORDER.index(stage) - 1]
    return filings.where(F.col("status") == before)


def advance(filings: DataFrame, outcomes: DataFrame, stage: str) -> DataFrame:
    """outcomes (id, error): those without an error reach the stage, the others fail with its message. Only filings that were ready move."""
    before = ORDER[ORDER.index(stage) - 1]
    o = outcomes.groupBy("id").agg(F.first("error", ignorenulls=True).alias("_error"), F.lit(True).alias("_done"))
    moved = F.coalesce("_done", F.lit(False)) & (F.col("status") == before)
    status = F.when(moved, F.when(F.col("_error").isNull(), stage).otherwise("failed")).otherwise(F.col("status"))
    message = F.when(moved, F.col("_error")).otherwise(F.col("error_message"))
    out = filings.join(o, "id", "left")
    return out.select(*[status.alias(c) if c == "status" else message.alias(c) if c == "error_message" else F.col(c) for c in filings.columns])


def run(filings: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Applies each stage (a function from ready filings to outcomes) in order."""
    for stage in ORDER[1:]:
        if stage in stages:
            filings = advance(filings, stages[stage](ready(filings, stage)), stage)
    return filings


def legs(chosen: list[str], known: tuple[str, ...] = ("fundamentals", "technical", "news", "sentiment")) -> list[str]:
    """The chosen legs of an analysis in their order; ValueError for unknown ones."""
    if unknown := sorted(set(chosen) - set(known)):
        raise ValueError(f"unknown legs: {unknown}")
    return [k for k in known if k in chosen] or list(known)


def resume(outputs: DataFrame, thread: str, stages: list[str]) -> tuple[str, list[str]]:
    """outputs (thread_id, stage): ('completed' | 'resumed' | 'started', stages still to run)."""
    done = {r.stage for r in outputs.where(F.col("thread_id") == thread).select("stage").distinct().limit(len(stages) + 1).collect()}
    left = [s for s in stages if s not in done]
    return ("completed" if not left else "resumed" if done else "started"), left
