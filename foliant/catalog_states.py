"""Filings' states out of all events: as one batch, and replayed as a stream of micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalog import query
from foliant.functions.shared import new_path
from foliant.plans import star
from foliant.streaming import states

_ASKS = ("downloaded", "parsed", "chunked", "failed", "discovered", "embedded")
_LIST = ", ".join(f"'{s}'" for s in _ASKS)
# every thirteenth event comes 40 events too late
_STATES = f"""WITH e AS (SELECT user_id * 100 + event_id % 3 AS id, event_id + CASE WHEN event_id % 13 = 0 THEN 400 ELSE 0 END AS came, event_id AS seq, [{_LIST}][CAST(event_id // 450 % 6 + 1 AS INTEGER)] AS status, 'no ' || event_type AS error FROM events),
l AS (SELECT id, list({{'status': status, 'seq': seq, 'error': error, 'moved': CAST(0 AS BIGINT), 'refused': CAST(0 AS BIGINT), 'late': CAST(0 AS BIGINT)}} ORDER BY came, seq) AS x FROM e GROUP BY id),
r AS (SELECT id, list_reduce(list_concat([{{'status': 'discovered', 'seq': CAST(-1 AS BIGINT), 'error': CAST(NULL AS VARCHAR), 'moved': CAST(0 AS BIGINT), 'refused': CAST(0 AS BIGINT), 'late': CAST(0 AS BIGINT)}}], x), lambda z, y:
  CASE WHEN y.seq <= z.seq THEN {{'status': z.status, 'seq': z.seq, 'error': z.error, 'moved': z.moved, 'refused': z.refused, 'late': z.late + 1}}
  WHEN (z.status || '>' || y.status) IN ('discovered>downloaded', 'downloaded>parsed', 'parsed>chunked', 'chunked>embedded', 'failed>discovered') OR (y.status = 'failed' AND z.status <> 'failed')
  THEN {{'status': y.status, 'seq': y.seq, 'error': CASE WHEN y.status = 'failed' THEN y.error END, 'moved': z.moved + 1, 'refused': z.refused, 'late': z.late}}
  ELSE {{'status': z.status, 'seq': y.seq, 'error': z.error, 'moved': z.moved, 'refused': z.refused + 1, 'late': z.late}} END) AS z FROM l)
SELECT id, z.status AS status, z.error AS error, z.moved AS moved, z.refused AS refused, z.late AS late FROM r"""


def _events(spark, d):
    e = star.read(spark, d, "events")
    asks = F.get(F.array(*map(F.lit, _ASKS)), (F.floor(F.col("event_id") / 450) % 6).cast("int"))
    return e.select((F.col("user_id") * 100 + F.col("event_id") % 3).alias("id"), (F.col("event_id") + F.when(F.col("event_id") % 13 == 0, 400).otherwise(0)).alias("at"), F.col("event_id").alias("seq"), asks.alias("status"), F.concat(F.lit("no "), "event_type").alias("error"))


@query(_STATES)
def P1_replayed_states(spark, d):
    return states.replayed(_events(spark, d))


@query(_STATES)
def P1_streamed_states(spark, d):
    """The events in parts by order of their coming, a part a micro-batch; what the stream tells is a table, of which the states are read."""
    events, path = _events(spark, d), new_path(spark)
    most = events.agg(F.max("at")).first()[0] + 1
    for i in range(3):
        # as many files as tasks write them; the stream takes up where it ended
        events.where((F.col("at") >= most * i // 3) & (F.col("at") < most * (i + 1) // 3)).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        run = states.transitions(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/told").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return states.states(spark.read.schema(states.TOLD).parquet(f"{path}/told"))
