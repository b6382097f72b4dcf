"""Transcript files: line reader, listing, backup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all ``*.jsonl`` files: ``session_file, slice, seq, value``.

    Files are split as usual. The start of a split is the slice, and ids grow
    along a split, so the order of lines survives without reading a whole file
    into one row.
    """
    return (
        spark.read.option("pathGlobFilter", "*.jsonl")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("session_file"),
            F.col("_metadata.file_block_start").alias("slice"),
            F.monotonically_increasing_id().alias("seq"),
            "value",
        )
    )


def list_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.jsonl")
        .load(path)
        .select("path", "modificationTime", "length")
    )


def backup_transcripts(lines: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Raw lines of the transcripts that are not stored yet, or not as they are now.

    Write them with ``partitionBy('session_file')`` in dynamic overwrite mode, so that a transcript's newest copy
    replaces the one before. Copies are compared by their number of lines and a hash over all of them.
    """
    raw = lines.select("session_file", "slice", "seq", "value")
    if stored is None:
        return raw
    if "value" not in stored.columns:  # only their names are known
        return raw.join(stored.select("session_file").distinct(), "session_file", "left_anti")
    state = lambda df: df.groupBy("session_file").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("value")).alias("h"))
    return raw.join(state(raw).join(state(stored), ["session_file", "n", "h"], "left_anti").select("session_file"), "session_file", "left_semi")
