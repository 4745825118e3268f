"""Events as a stream: windowed counts with late data, and filings advanced by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and values by type and window; rows later than `late` behind the newest are left out on a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("events"), F.round(F.sum(F.col("value").cast("decimal(38,6)")).cast("double"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """The first of the events with one key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """A writer that hands over each micro-batch; what is available now is handled, then it stops."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)
