from foliant.plans.ingest import may_become
from foliant.streaming import states

EVENTS = [
    (1, 1, 1, "downloaded", None), (1, 2, 2, "parsed", None), (1, 3, 2, "chunked", None), (1, 4, 5, "failed", "no text"), (1, 5, 4, "discovered", None),
    (2, 1, 1, "parsed", None), (2, 2, 3, "downloaded", "x"), (3, 1, 1, "failed", "gone"), (3, 2, 2, "failed", "again"), (3, 3, 3, "discovered", None),
    (4, None, 1, "parsed", None), (None, 1, 1, "parsed", None), (5, 1, 1, None, None), (6, 1, 1, "nonsense", None),
]
SCHEMA = "id long, at long, seq long, status string, error string"


def by_hand(events):
    out = {}
    for i, _, seq, status, error in sorted((e for e in events if None not in e[:4]), key=lambda e: e[:3]):
        s = out.setdefault(i, ["discovered", None, 0, 0, 0, None])
        if s[5] is not None and seq <= s[5]:
            s[4] += 1
            continue
        s[5] = seq
        if may_become(s[0], status):
            s[0], s[1], s[2] = status, error if status == "failed" else None, s[2] + 1
        else:
            s[3] += 1
    return sorted((i, *s[:5]) for i, s in out.items())


def test_one_batch_follows_the_rules(spark):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    assert sorted(map(tuple, states.replayed(df).collect())) == by_hand(EVENTS)
    assert states.replayed(df.limit(0)).count() == 0


def test_a_stream_in_batches_ends_as_the_table_does(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, SCHEMA).coalesce(1)
    for n, part in enumerate(("at <= 1 or at is null", "at = 2", "at > 2")):
        df.where(part).write.mode("append").parquet(str(tmp_path / "in"))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = states.transitions(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "told")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert run.awaitTermination(150)
    finally:
        run.stop()
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    told = spark.read.schema(states.TOLD).parquet(str(tmp_path / "told"))
    assert sorted(map(tuple, states.states(told).collect())) == by_hand(EVENTS)
    assert {(r.id, r.seq): r.outcome for r in told.collect()}[3, 2] == "refused"


def test_parts_of_a_replay_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from foliant import catalog_states

    spark.range(600).selectExpr("id AS event_id", "id % 7 AS user_id", "'view' AS event_type", "timestamp_seconds(id) AS ts", "1.0D AS value", "'{}' AS props").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog_states, "new_path", lambda _: str(tmp_path / "run"))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")}
    try:
        got = sorted(map(tuple, catalog_states.P1_streamed_states(spark, str(tmp_path)).collect()))
        assert got == sorted(map(tuple, catalog_states.P1_replayed_states(spark, str(tmp_path)).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(list((tmp_path / "run" / "in").glob("*.parquet"))) > 3  # a file for each part would be one task's
