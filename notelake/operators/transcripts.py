"""Conversation transcripts: turns, session headers, tools, files, rolling text.

A transcript line is ``session_file, slice, seq, value``: ``slice`` is a bounded
part of a file (a file split, or a range of line numbers) and ``(slice, seq)`` is
the line order. One very long session therefore never has to be collected by one
task before it has been reduced slice by slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import is_blank, trim_ws

LINE_KEY = ("session_file", "slice", "seq")

# Line types without conversation, tools that change files and
# the arguments that name the file.
SKIPPED_TYPES = ("progress", "file-history-snapshot")
FILE_TOOLS = ("Write", "Edit", "NotebookEdit")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Readable JSON lines with their top-level fields; other lines are dropped."""
    v = F.col("_v")
    get = lambda path: F.try_variant_get(v, path, "string")
    content = F.try_variant_get(v, "$.message.content", "variant")
    return (
        lines.filter(~is_blank(F.col("value")))
        .withColumn("_v", F.try_parse_json("value"))
        .filter(F.col("_v").isNotNull())
        .select(
            *LINE_KEY,
            get("$.type").alias("type"),
            get("$.sessionId").alias("session_id"),
            get("$.slug").alias("slug"),
            get("$.timestamp").alias("timestamp"),
            get("$.message.role").alias("role"),
            F.schema_of_variant(content).alias("_kind"),
            content.alias("_content"),
        )
    )


def _is_text(kind: Column) -> Column:
    return kind == "STRING"


def turns(parsed: DataFrame) -> DataFrame:
    """Conversation turns: ``session_file, slice, seq, role, text, timestamp, tools, files``.

    User turns have text content (lists are tool results and are skipped).
    Assistant turns join their text blocks and name their tools; other blocks are
    left out. A turn needs text or a tool.
    """
    said = parsed.filter(
        ~F.col("type").isin(*SKIPPED_TYPES) & (F.col("role") == F.col("type"))
    )
    user = said.filter((F.col("type") == "user") & _is_text(F.col("_kind"))).select(
        *LINE_KEY,
        "role",
        trim_ws(F.try_variant_get("_content", "$", "string")).alias("text"),
        "timestamp",
        F.array().cast("array<string>").alias("tools"),
        F.array().cast("array<string>").alias("files"),
    )
    blocks = F.col("_blocks")
    texts = F.filter(
        F.transform(
            F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()),
            lambda b: trim_ws(b["text"]),
        ),
        lambda t: t != "",
    )
    used = F.filter(
        blocks, lambda b: (b["type"] == "tool_use") & (F.coalesce(b["name"], F.lit("")) != "")
    )
    assistant = (
        said.filter((F.col("type") == "assistant") & F.col("_kind").startswith("ARRAY"))
        .withColumn("_blocks", _content_blocks(F.col("_content")))
        .select(
            *LINE_KEY,
            "role",
            F.array_join(texts, "\n").alias("text"),
            "timestamp",
            F.transform(used, lambda b: b["name"]).alias("tools"),
            F.filter(
                F.transform(
                    F.filter(used, lambda b: b["name"].isin(*FILE_TOOLS)), lambda b: b["file"]
                ),
                lambda f: f.isNotNull(),
            ).alias("files"),
        )
    )
    return user.unionByName(assistant).filter((F.col("text") != "") | (F.size("tools") > 0))


def _content_blocks(content: Column) -> Column:
    """Content blocks of an assistant line as plain structs."""
    items = F.try_variant_get(content, "$", "array<variant>")
    text_of = lambda b, path: F.try_variant_get(b, path, "string")

    def named_file(b: Column) -> Column:
        first = F.coalesce(
            _not_json_null(F.try_variant_get(b, "$.input.file_path", "variant")),
            _not_json_null(F.try_variant_get(b, "$.input.notebook_path", "variant")),
        )
        return F.when(
            F.schema_of_variant(first) == "STRING", F.try_variant_get(first, "$", "string")
        )

    return F.transform(
        items,
        lambda b: F.struct(
            text_of(b, "$.type").alias("type"),
            text_of(b, "$.text").alias("text"),
            text_of(b, "$.name").alias("name"),
            named_file(b).alias("file"),
        ),
    )


def _not_json_null(v: Column) -> Column:
    return F.when(~F.is_variant_null(v), v)


def session_headers(parsed: DataFrame) -> DataFrame:
    """First non-empty session id and slug, first and last timestamp, in line order."""
    at = F.struct("slice", "seq")

    def first(name: str) -> Column:
        value = F.when(F.col(name) != "", F.col(name))
        return F.min_by(value, F.when(value.isNotNull(), at))

    stamp = F.when(F.col("timestamp") != "", F.col("timestamp"))
    last = F.max_by(stamp, F.when(stamp.isNotNull(), at))
    ms = lambda c: F.coalesce(F.unix_millis(F.to_timestamp(c)), F.lit(0))
    return parsed.groupBy("session_file").agg(
        F.coalesce(first("session_id"), F.lit("")).alias("session_id"),
        F.coalesce(first("slug"), F.lit("")).alias("slug"),
        ms(first("timestamp")).alias("started_at"),
        ms(last).alias("ended_at"),
    )


def turn_totals(turn_rows: DataFrame) -> DataFrame:
    """User turns and the sorted distinct tools of every transcript."""
    return turn_rows.groupBy("session_file").agg(
        F.count_if(F.col("role") == "user").alias("turn_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tools")))).alias("tools_used"),
    )


def files_modified(turn_rows: DataFrame) -> DataFrame:
    """Distinct changed files per transcript in the order they were first named."""
    named = turn_rows.select(*LINE_KEY, F.posexplode("files").alias("pos", "file"))
    first = named.groupBy("session_file", "file").agg(
        F.min(F.struct("slice", "seq", "pos")).alias("at")
    )
    return first.groupBy("session_file").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "file"))), lambda x: x["file"]).alias(
            "files_modified"
        )
    )


def rolling_parts(turn_rows: DataFrame) -> DataFrame:
    """Readable conversation text, one row per slice of a transcript."""
    speaker = F.when(F.col("role") == "user", "**User**").otherwise("**Assistant**")
    line = F.struct("seq", F.concat(speaker, F.lit(": "), "text").alias("line"))
    return (
        turn_rows.filter(F.col("text") != "")
        .groupBy("session_file", "slice")
        .agg(F.sort_array(F.collect_list(line)).alias("_lines"))
        .select(
            "session_file",
            "slice",
            F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("part"),
        )
    )


def rolling_summary(turn_rows: DataFrame) -> DataFrame:
    """The whole conversation text of every transcript, joined from its slices."""
    return (
        rolling_parts(turn_rows)
        .groupBy("session_file")
        .agg(F.sort_array(F.collect_list(F.struct("slice", "part"))).alias("_parts"))
        .select(
            "session_file",
            F.array_join(F.transform("_parts", lambda x: x["part"]), "\n").alias("rolling_summary"),
        )
    )


def capture(lines: DataFrame, project_dir: str, now_ms: int) -> DataFrame:
    """Session snapshots from transcript lines; transcripts without a user turn are skipped.

    When several transcripts carry one session id the one that ended last counts.
    """
    parsed = parse_lines(lines)
    said = turns(parsed)
    snapshots = (
        session_headers(parsed)
        .join(turn_totals(said).filter("turn_count > 0"), "session_file")
        .join(rolling_summary(said), "session_file", "left")
    )
    newest = snapshots.groupBy("session_id").agg(
        F.max_by(
            F.struct("turn_count", "tools_used", "rolling_summary"), F.struct("ended_at", "session_file")
        ).alias("_s")
    )
    return newest.select(
        "session_id",
        F.lit(project_dir).alias("project_dir"),
        F.lit(now_ms).cast("long").alias("saved_at"),
        F.col("_s.turn_count").alias("turn_count"),
        F.coalesce("_s.rolling_summary", F.lit("")).alias("rolling_summary"),
        F.array().cast("array<string>").alias("decisions"),
        F.col("_s.tools_used").alias("search_footprint"),
        F.lit("active").alias("status"),
    )


def transcript_view(parsed: DataFrame, session_files: DataFrame) -> DataFrame:
    """Turns of the chosen transcripts in order."""
    held = parsed.join(F.broadcast(session_files.select("session_file")), "session_file", "left_semi")
    return turns(held).orderBy(*LINE_KEY)


def latest_transcript(files: DataFrame) -> DataFrame:
    """Newest file of a listing ``path, modificationTime``."""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
