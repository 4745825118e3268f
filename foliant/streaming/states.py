"""Filings' states as a stream: transitions by rule, late and refused ones told, stalled filings reported, ended ones forgotten after a while.

An event (id, at, seq, status, error) asks for a filing's next state. Of one filing, events count in the order in which they come (`at`); one whose `seq`
is not beyond the last one's is late and changes nothing, one that the rules forbid is refused. `replayed` is the same as one batch, for
a table of events that has all of them.

Defined cases: a null id, at, seq or status is no event; a filing begins as discovered; an error counts with the state failed only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.plans.ingest import ALLOWED, may_become

#: Days after which a filing that has not moved is reported, and its state forgotten; the first state.
STALLED_DAYS, FORGOTTEN_DAYS, FIRST = 7, 90, "discovered"
_DAY = 86_400_000
_COLUMNS = ("id", "at", "seq", "status", "error")
#: The table that is told: a row for each event, and for each filing that stalls.
TOLD = "id long, at long, seq long, before string, status string, outcome string, error string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(events: DataFrame) -> DataFrame:
    return events.select(F.col("id").cast("long"), F.col("at").cast("long"), F.col("seq").cast("long"), "status", "error").where("id is not null and at is not null and seq is not null and status is not null")


class _Filing(StatefulProcessor):
    """Status and last seq of one filing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("filing", "status string, seq long", ttlDurationMs=FORGOTTEN_DAYS * _DAY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        status, last = self.state.get() or (FIRST, None)
        # a filing's few events: lists, since frames of a few rows take longer to join and sort than the events to fold
        events = sorted((e for r in rows for e in zip(*(r[c].tolist() for c in _COLUMNS[1:]), strict=True)), key=lambda e: e[:2])
        out = []
        for at, seq, asked, error in events:
            before = status
            if last is not None and seq <= last:
                outcome = "late"
            else:
                outcome, last = "moved" if may_become(status, asked) else "refused", seq
                status = asked if outcome == "moved" else status
            out.append((key[0], at, seq, before, status, outcome, error if outcome == "moved" and status == "failed" else None))
        self.state.update((status, int(last)))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if status in ALLOWED and status != "failed":
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + STALLED_DAYS * _DAY)
        yield pd.DataFrame(out, columns=["id", "at", "seq", "before", "status", "outcome", "error"])

    def handleExpiredTimer(self, key: tuple, timers: object, expired: object) -> Iterator[pd.DataFrame]:
        status, last = self.state.get() if self.state.exists() else (FIRST, -1)
        yield pd.DataFrame([(key[0], expired.getExpiryTimeInMs(), last, status, status, "stalled", None)], columns=["id", "at", "seq", "before", "status", "outcome", "error"])

    def close(self) -> None:
        pass


def transitions(stream: DataFrame) -> DataFrame:
    """TOLD of a stream of events. Sets the session's state store to one that can expire state, and no batches without data, which would follow each other for the timers' sake and never let a replay end."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return _events(stream).groupBy("id").transformWithStateInPandas(_Filing(), TOLD, "Append", "ProcessingTime")


def states(told: DataFrame) -> DataFrame:
    """(id, status, error, moved, refused, late): what the rows of TOLD leave of each filing."""
    counted = told.where("outcome <> 'stalled'").groupBy("id")
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    last = F.max_by(F.struct("status", "error"), F.when(F.col("outcome") == "moved", F.struct("at", "seq")))
    out = counted.agg(last.alias("l"), n("moved"), n("refused"), n("late"))
    return out.select("id", F.coalesce("l.status", F.lit(FIRST)).alias("status"), F.col("l.error").alias("error"), "moved", "refused", "late")


def replayed(events: DataFrame) -> DataFrame:
    """The same out of a table with all events: one fold over each filing's few events."""
    each = _events(events).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "status", "error"))).alias("events"))
    rules = F.create_map(*[F.lit(x) for pair in ALLOWED.items() for x in pair])

    def step(z, e):
        late, may = e["seq"] <= z["seq"], (F.try_element_at(rules, z["status"]) == e["status"]) | ((e["status"] == "failed") & (z["status"] != "failed"))
        moved = ~late & F.coalesce(may, F.lit(False))
        return F.struct(
            F.when(moved, e["status"]).otherwise(z["status"]).alias("status"), F.when(late, z["seq"]).otherwise(e["seq"]).alias("seq"),
            F.when(moved & (e["status"] == "failed"), e["error"]).when(~moved, z["error"]).alias("error"),
            (z["moved"] + moved.cast("long")).alias("moved"), (z["refused"] + (~late & ~moved).cast("long")).alias("refused"), (z["late"] + late.cast("long")).alias("late"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(FIRST).alias("status"), F.lit(-(1 << 62)).cast("long").alias("seq"), F.lit(None).cast("string").alias("error"), zero.alias("moved"), zero.alias("refused"), zero.alias("late"))
    return each.select("id", F.aggregate("events", start, step).alias("z")).select("id", "z.status", "z.error", "z.moved", "z.refused", "z.late")
