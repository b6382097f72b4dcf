"""Session totals: late turns, expiry, sessions that come back; capture writes changed sessions only."""

from datetime import datetime, timedelta, timezone

from notelake.streaming.changes import latest_sessions, live_session_totals, use_state_store

DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)


def turns(spark, *rows):
    made = [(s, r, DAY + timedelta(hours=h)) for s, r, h in rows]
    return spark.createDataFrame(made, "session_id string, role string, at timestamp")


def test_sessions_expire_and_return(spark, tmp_path):
    use_state_store(spark)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run(*rows):
        turns(spark, *rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema("session_id string, role string, at timestamp").parquet(source)
        totals = live_session_totals(stream, delay="2 hours", idle_ms=24 * 3_600_000)
        job = (
            totals.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        job.awaitTermination()

    hours = lambda t: round((t.replace(tzinfo=timezone.utc) - DAY).total_seconds() / 3600) if t.tzinfo is None else round((t - DAY).total_seconds() / 3600)
    run(("a", "user", 5), ("a", "assistant", 6), ("b", "user", 5))
    run(("a", "user", 5), ("b", "user", 40))  # a late turn of a, and b goes on
    run(("b", "assistant", 41), ("c", "user", 60))
    run(("a", "user", 62), ("c", "user", 63))  # a comes back after it was closed
    rows = [(r.session_id, hours(r.started_at), hours(r.ended_at), r.turn_count, r.closed) for r in spark.read.parquet(out).collect()]
    assert ("a", 5, 6, 2, False) in rows and ("a", 5, 6, 2, True) in rows
    assert ("a", 62, 62, 1, False) in rows and ("b", 5, 40, 2, False) in rows and ("c", 60, 63, 2, False) in rows
    assert not [r for r in rows if r[0] == "a" and r[1] == 5 and r[2] > 6]


def test_latest_sessions(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", None, 2), ("b", 3, 1)], "session_id string, turn_count int, batch int")
    assert {r.session_id: r.turn_count for r in latest_sessions(rows).collect()} == {"a": None, "b": 3}


def test_tables_of_several_files_are_streamed(spark, tmp_path):
    from suite.streams import stream_session_totals

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "x") for c in range(6) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    table.repartition(3).write.parquet(f"{tmp_path}/folder/conversations.parquet")
    table.toPandas().to_parquet(f"{tmp_path}/conversations.parquet")
    for at in (f"{tmp_path}/folder", str(tmp_path)):
        got = sorted(tuple(r) for r in stream_session_totals(spark, at).collect())
        assert got == [(c, 0, 180, 2) for c in range(6)]
