"""Queries that run a stream to its end over the given tables and return its result."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.plans.indexing import build_index
from notelake.sources.store import load_index
from notelake.streaming.changes import (
    distinct_changes,
    latest_sessions,
    live_session_totals,
    run_batches,
    stream_index_updates,
    stream_session_capture,
    use_state_store,
)
from suite.indexing import _CHANGES, scanned_notes, stored_notes
from suite.inputs import new_dir, table
from suite.registry import query
from suite.sessions import _ROLLING, NOW, lines, stored


#: Conversations begin a day after the epoch: the first watermark is the epoch itself, and what is not above it is late.
DAY = 86_400


def stream(spark, sf, name) -> DataFrame:
    """A given table as a stream, whether it is one file or a folder of files. A pattern takes both; a plain path has to be a folder."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query("stream_changed_paths", "SELECT DISTINCT user_id || '/' || event_type || '.md' AS path FROM events WHERE event_type <> 'error'")
def stream_changed_paths(spark, sf):
    """Change events as a stream: notes only, each path once."""
    ext = F.when(F.col("event_type") == "error", ".txt").otherwise(".md")
    changes = stream(spark, sf, "events").select(
        F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("/"), "event_type", ext).alias("value")
    )
    work = new_dir(spark, "paths")
    handle = lambda batch, n: distinct_changes(batch).write.mode("overwrite").parquet(f"{work}/out/batch={n}")
    run_batches(changes, handle, f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out").select("path").distinct()


@query("stream_late_paths", "SELECT DISTINCT user_id || '/' || hour(ts) || '.md' AS path FROM events")
def stream_late_paths(spark, sf):
    """Changes of the second half of the day arrive first, those of the first half in a later run: none is lost."""
    work = new_dir(spark, "late")
    path = F.concat_ws("/", "user_id", F.concat(F.hour("ts"), F.lit(".md")))
    events = table(spark, sf, "events").select(path.alias("value"), (F.hour("ts") < 12).alias("late"))
    handle = lambda batch, n: distinct_changes(batch).write.mode("overwrite").parquet(f"{work}/out/batch={n}")
    for late in (False, True):
        events.filter(F.col("late") == late).select("value").write.mode("append").text(f"{work}/dirty")
        run_batches(spark.readStream.text(f"{work}/dirty"), handle, f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out").select("path").distinct()


@query(
    "stream_session_totals",
    """
SELECT conv_id AS session_id, (min(turn) * 60)::BIGINT AS started, (max(turn) * 60)::BIGINT AS ended,
       count(*) FILTER (role = 'user') AS turn_count FROM conversations GROUP BY 1""",
)
def stream_session_totals(spark, sf):
    turns = stream(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), "role", F.timestamp_seconds(F.col("turn") * 60 + DAY).alias("at")
    )
    work = new_dir(spark, "totals")
    use_state_store(spark)
    handle = lambda batch, n: batch.write.mode("overwrite").parquet(f"{work}/out/batch={n}")
    job = (
        live_session_totals(turns, delay="10 days")
        .writeStream.outputMode("update")
        .foreachBatch(handle)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    # A later batch replaces the totals of the sessions it touched.
    newest = latest_sessions(spark.read.parquet(f"{work}/out").filter("NOT closed"))
    return newest.select(
        "session_id", (F.unix_seconds("started_at") - DAY).alias("started"), (F.unix_seconds("ended_at") - DAY).alias("ended"), "turn_count"
    )


@query(
    "stream_index_update",
    f"""WITH {_CHANGES}
SELECT doc_path, new_hash AS content_hash, change_kind FROM changes WHERE new_hash IS NOT NULL""",
)
def stream_index_update(spark, sf):
    """A dirty-path stream drives the incremental build; every document is listed."""
    work = new_dir(spark, "stream")
    build_index(stored_notes(spark, sf), f"{work}/index")
    table(spark, sf, "documents").select(
        F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".md"))).alias("value")
    ).write.text(f"{work}/dirty")
    stream_index_updates(
        spark.readStream.text(f"{work}/dirty"),
        lambda s: scanned_notes(s, sf),
        f"{work}/index",
        f"{work}/checkpoint",
        f"{work}/audit",
    ).awaitTermination()
    held = load_index(spark, f"{work}/index").docs.select("doc_path", "content_hash")
    audit = spark.read.parquet(f"{work}/audit").select("doc_path", F.col("action").alias("change_kind"))
    return held.join(audit, "doc_path", "left").withColumn(
        "change_kind", F.coalesce("change_kind", F.lit("unchanged"))
    )


@query(
    "stream_audit_retry",
    f"""WITH {_CHANGES}
SELECT doc_path, change_kind FROM changes WHERE change_kind <> 'unchanged'""",
)
def stream_audit_retry(spark, sf):
    """The same first batch handled twice leaves the audit rows of the first time."""
    work = new_dir(spark, "retry")
    build_index(stored_notes(spark, sf), f"{work}/index")
    table(spark, sf, "documents").select(
        F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".md"))).alias("value")
    ).write.text(f"{work}/dirty")
    for attempt in ("first", "again"):
        stream_index_updates(
            spark.readStream.text(f"{work}/dirty"),
            lambda s: scanned_notes(s, sf),
            f"{work}/index",
            f"{work}/checkpoint-{attempt}",
            f"{work}/audit",
        ).awaitTermination()
    return spark.read.parquet(f"{work}/audit").select("doc_path", F.col("action").alias("change_kind"))


@query(
    "stream_audit_crash",
    f"""WITH {_CHANGES}
SELECT doc_path, change_kind FROM changes WHERE change_kind <> 'unchanged'""",
)
def stream_audit_crash(spark, sf):
    """The job dies between the commit and the audit, and notes change before it runs again: the audit has the rows
    of the version that was committed."""
    work = new_dir(spark, "crash")
    build_index(stored_notes(spark, sf), f"{work}/index")
    table(spark, sf, "documents").select(
        F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".md"))).alias("value")
    ).write.text(f"{work}/dirty")

    def die(batch_id):
        raise RuntimeError("lost driver")

    def run(notes, on_commit):
        stream_index_updates(
            spark.readStream.text(f"{work}/dirty"), notes, f"{work}/index", f"{work}/checkpoint", f"{work}/audit", on_commit=on_commit
        ).awaitTermination()

    try:
        run(lambda s: scanned_notes(s, sf), die)
        raise AssertionError("the first run has to fail")
    except StreamingQueryException:
        pass
    run(lambda s: scanned_notes(s, sf).withColumn("content", F.concat("content", F.lit(" later"))), None)
    return spark.read.parquet(f"{work}/audit").select("doc_path", F.col("action").alias("change_kind"))


@query(
    "stream_session_capture",
    f"""WITH {_ROLLING}, old AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')
SELECT 's' || conv_id AS session_id, coalesce(n, 1) AS turn_count
FROM (SELECT u.conv_id, n FROM users u JOIN rolling USING (conv_id) WHERE n > 0) FULL JOIN old USING (conv_id)""",
)
def stream_session_capture_(spark, sf):
    """A transcript stream keeps the session table current."""
    work = new_dir(spark, "capture")
    lines(spark, sf).write.parquet(f"{work}/lines")
    stored(spark, sf).write.parquet(f"{work}/sessions/batch=-1")
    def read_sessions(s):
        return latest_sessions(s.read.parquet(f"{work}/sessions"))

    def read_all(s, touched):
        return s.read.parquet(f"{work}/lines").join(touched, "session_file", "left_semi")

    def publish(df, n):
        df.write.mode("overwrite").parquet(f"{work}/sessions/batch={n}")

    source = spark.readStream.schema(lines(spark, sf).schema).parquet(f"{work}/lines")
    stream_session_capture(
        source, read_all, read_sessions, publish, "/repo", NOW, f"{work}/checkpoint"
    ).awaitTermination()
    return read_sessions(spark).select("session_id", "turn_count")
