"""Streams: changed paths, incremental indexing, session capture, audit trail.

Each stream reads a folder that producers append to; its checkpoint remembers
what was consumed, which replaces clearing a list by hand.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from datetime import timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from notelake.functions.text import trim_ws
from notelake.operators.sessions import upsert_sessions
from notelake.operators.transcripts import capture
from notelake.plans.indexing import update_index
from notelake.sources.notes import clean_paths, read_changed_notes
from notelake.sources.workdir import cut


def changed_paths(lines: DataFrame, suffix: str = ".md", column: str = "value") -> DataFrame:
    """Trimmed note paths of a line stream; other paths are dropped."""
    path = F.translate(trim_ws(F.col(column)), "\\", "/")
    return lines.withColumn("path", path).filter(F.col("path").endswith(suffix))


def distinct_changes(batch: DataFrame) -> DataFrame:
    """Each changed path of one batch of lines once. No state is kept, so a path that arrives late is not lost."""
    return changed_paths(batch).select("path").distinct()


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Process everything that has arrived, batch by batch, then stop."""
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_index_updates(
    dirty_lines: DataFrame,
    notes: Callable[[SparkSession], DataFrame] | str,
    root: str,
    checkpoint: str,
    audit_path: str | None = None,
    stream: str | None = None,
    on_commit: Callable[[int], None] | None = None,
    **options,
) -> StreamingQuery:
    """Incremental index build for every batch of changed paths.

    ``notes`` is the note folder, of which only the changed files are opened, or a
    function that gives all notes. Paths below the folder may be absolute.
    The version that applies a batch carries the stream's name (its checkpoint, if not given) and the batch's
    number, so a batch that is repeated after a crash finds its version and is not applied twice. With
    ``audit_path`` the changes are kept, as that version stores them: a crash at any point between the commit and
    the audit loses no row. ``on_commit`` is called with the batch's number between the two.
    """
    name = stream or checkpoint

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        paths = distinct_changes(batch)
        if paths.isEmpty():
            return
        if isinstance(notes, str):
            paths = clean_paths(paths, "path", notes)
            changes = update_index(read_changed_notes(spark, notes, paths, None), paths, root, batch=(name, batch_id), **options)
        else:
            changes = update_index(notes(spark), paths, root, batch=(name, batch_id), **options)
        if on_commit is not None:
            on_commit(batch_id)
        if audit_path is not None:
            write_audit(changes, audit_path, name, batch_id)

    return run_batches(dirty_lines, handle, checkpoint)


def write_audit(changes: DataFrame, path: str, stream: str, batch_id: int) -> None:
    """Audit rows of one batch, from the changes its version stores. Writing them again writes the same rows."""
    rows = changes.filter("change_kind <> 'unchanged'").select(
        F.lit(batch_id).alias("batch_id"),
        F.lit(stream).alias("stream"),
        F.current_timestamp().alias("at"),
        F.col("change_kind").alias("action"),
        "doc_path",
        F.col("old_hash").alias("hash_before"),
        F.col("new_hash").alias("hash_after"),
    )
    rows.write.mode("overwrite").parquet(f"{path}/of={zlib.crc32(stream.encode())}/batch={batch_id}")


def stream_session_capture(
    lines: DataFrame,
    read_all: Callable[[SparkSession, DataFrame], DataFrame],
    read_sessions: Callable[[SparkSession], DataFrame],
    publish: Callable[[DataFrame, int], None],
    project_dir: str,
    now_ms: int,
    checkpoint: str,
) -> StreamingQuery:
    """Session capture for the transcripts touched by every batch.

    ``lines``: a stream with ``session_file``; ``read_all`` returns the complete
    lines of the touched files, ``read_sessions`` the current session table, and
    ``publish`` stores the sessions that the batch changed under its number. Only those
    are read, merged and written; ``latest_sessions`` gives readers the newest row of each.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = batch.select("session_file").distinct()
        snapshots = cut(capture(read_all(spark, touched), project_dir, now_ms))
        known = read_sessions(spark).join(snapshots.select("session_id"), "session_id", "left_semi")
        publish(upsert_sessions(known, snapshots), batch_id)

    return run_batches(lines, handle, checkpoint)


def latest_sessions(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """The row of the latest batch of every session."""
    cols = [c for c in rows.columns if c not in ("session_id", batch)]
    newest = rows.groupBy("session_id").agg(F.max_by(F.struct(*cols), batch).alias("_row"))
    return newest.select("session_id", "_row.*").select(*[c for c in rows.columns if c != batch])


TOTALS = "started_at timestamp, ended_at timestamp, turn_count long"


class _SessionTotals(StatefulProcessor):
    """First and last turn and the user's turns of a session, until it has been idle for a while."""

    def __init__(self, event_time: str, idle_ms: int):
        self.event_time, self.idle_ms = event_time, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)

    def _row(self, key: tuple, totals: tuple, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "started_at": [totals[0]], "ended_at": [totals[1]], "turn_count": [totals[2]], "closed": [closed]})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802,N803 - the interface's names
        held = self.totals.get() if self.totals.exists() else None
        first, last, n = held if held is not None else (None, None, 0)
        for frame in rows:
            low, high = frame[self.event_time].min(), frame[self.event_time].max()
            first = low if first is None else min(first, low)
            last = high if last is None else max(last, high)
            n += int((frame["role"] == "user").sum())
        totals = (pd.Timestamp(first).to_pydatetime(), pd.Timestamp(last).to_pydatetime(), n)
        self.totals.update(totals)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(totals[1].replace(tzinfo=timezone.utc).timestamp() * 1000) + self.idle_ms)
        yield self._row(key, totals, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802,N803
        totals = self.totals.get()
        self.totals.clear()
        yield self._row(key, totals, True)

    def close(self) -> None:
        pass


def live_session_totals(turn_stream: DataFrame, event_time: str = "at", delay: str = "1 hour", idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """Running totals per session of a turn stream ``session_id, role, at``: a row for every session a batch touches.

    Turns may be late by ``delay``; later ones, and those not after the epoch, are not counted. A session that has been idle for ``idle_ms`` of event time is ``closed`` and its
    state goes, so state is bounded by the sessions that are active; when it returns, a new row begins with its own
    start. The session needs the RocksDB state store (``use_state_store``).
    """
    kind = turn_stream.schema["session_id"].dataType.simpleString()
    turns = turn_stream.select("session_id", "role", event_time).withWatermark(event_time, delay)
    return turns.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_SessionTotals(event_time, idle_ms),
        outputStructType=f"session_id {kind}, {TOTALS}, closed boolean",
        outputMode="Update",
        timeMode="EventTime",
    )


def use_state_store(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, which stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
