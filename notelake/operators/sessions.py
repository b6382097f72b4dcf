"""Session table: upsert, summaries, listing, Markdown export.

``sessions``: ``session_id, project_dir, started_at, last_saved_at, turn_count,
rolling_summary, decisions, search_footprint, summary, status``; ``summary`` is a
struct of an overview and four lists, or NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY_LISTS = ("decisions", "outcomes", "open_items", "tags")
SUMMARY_TYPE = (
    "struct<overview:string,decisions:array<string>,outcomes:array<string>,"
    "open_items:array<string>,tags:array<string>>"
)
_EMPTY = "array<string>"


def json_list(text: Column) -> Column:
    """JSON list of strings; anything unreadable is an empty list."""
    return F.coalesce(F.from_json(text, _EMPTY), F.array().cast(_EMPTY))


def upsert_sessions(sessions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """New session table: a snapshot replaces its session but keeps ``started_at`` and ``summary``."""
    old = sessions.select([F.col(c).alias(f"_{c}") for c in sessions.columns])
    both = old.join(snapshots, F.col("_session_id") == F.col("session_id"), "full_outer")
    fresh = F.col("session_id").isNotNull()
    pick = lambda new, was: F.when(fresh, new).otherwise(was)
    return both.select(
        F.coalesce("session_id", "_session_id").alias("session_id"),
        pick(F.col("project_dir"), F.col("_project_dir")).alias("project_dir"),
        F.coalesce("_started_at", "saved_at").alias("started_at"),
        pick(F.col("saved_at"), F.col("_last_saved_at")).alias("last_saved_at"),
        pick(F.col("turn_count"), F.col("_turn_count")).alias("turn_count"),
        pick(F.col("rolling_summary"), F.col("_rolling_summary")).alias("rolling_summary"),
        pick(F.col("decisions"), F.col("_decisions")).alias("decisions"),
        pick(F.col("search_footprint"), F.col("_search_footprint")).alias("search_footprint"),
        F.col("_summary").alias("summary"),
        pick(F.col("status"), F.col("_status")).alias("status"),
    )


def merge_summary(old: Column, new: Column) -> Column:
    """New overview; each list is the old one followed by the new entries, without repeats."""
    none = F.array().cast(_EMPTY)
    merged = F.struct(
        new["overview"].alias("overview"),
        *[
            F.array_union(F.coalesce(old[f], none), F.coalesce(new[f], none)).alias(f)
            for f in SUMMARY_LISTS
        ],
    )
    return F.when(old.isNull(), new).otherwise(merged)


def update_summaries(sessions: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge ``session_id, seq, saved_at, summary`` updates into the session table.

    Several updates of one session are merged in ``seq`` order.
    """
    # Repeated updates of a session reduce to one before they meet the table:
    # distinct entries by the place they were first named, and the last overview.
    entries = None
    for name in SUMMARY_LISTS:
        part = updates.select(
            "session_id", F.lit(name).alias("_list"), "seq", F.posexplode(f"summary.{name}").alias("pos", "entry")
        )
        entries = part if entries is None else entries.unionAll(part)
    lists = (
        entries.groupBy("session_id", "_list", "entry")
        .agg(F.min(F.struct("seq", "pos")).alias("at"))
        .groupBy("session_id")
        .agg(
            *[
                F.transform(
                    F.sort_array(
                        F.collect_list(F.when(F.col("_list") == name, F.struct("at", "entry")))
                    ),
                    lambda x: x["entry"],
                ).alias(name)
                for name in SUMMARY_LISTS
            ]
        )
    )
    heads = updates.groupBy("session_id").agg(
        F.max_by(F.col("summary.overview"), F.col("seq")).alias("overview"),
        F.max("saved_at").alias("_saved_at"),
    )
    none = F.array().cast(_EMPTY)
    folded = heads.join(lists, "session_id", "left").select(
        "session_id",
        "_saved_at",
        F.struct("overview", *[F.coalesce(n, none).alias(n) for n in SUMMARY_LISTS])
        .cast(SUMMARY_TYPE)
        .alias("_new"),
    )
    joined = sessions.join(folded, "session_id", "left")
    return joined.withColumns(
        {
            "summary": F.when(
                F.col("_new").isNotNull(), merge_summary(F.col("summary"), F.col("_new"))
            ).otherwise(F.col("summary")),
            "last_saved_at": F.coalesce("_saved_at", "last_saved_at"),
        }
    ).drop("_new", "_saved_at")


def compact_sessions(sessions: DataFrame, ids: DataFrame, now_ms: int, truncate: int | None = None) -> DataFrame:
    """Mark sessions as compacted. The text stays whole unless ``truncate`` is given:
    then it is cut there, at the last sentence end before it."""
    marked = sessions.join(
        ids.select("session_id", F.lit(True).alias("_hit")).distinct(), "session_id", "left"
    )
    hit = F.col("_hit").isNotNull()
    text = F.col("rolling_summary")
    if truncate is not None:
        text = truncate_at_sentence(text, truncate)
    return marked.withColumns(
        {
            "rolling_summary": F.when(hit, text).otherwise(F.col("rolling_summary")),
            "status": F.when(hit, "compacted").otherwise(F.col("status")),
            "last_saved_at": F.when(hit, now_ms).otherwise(F.col("last_saved_at")),
        }
    ).drop("_hit")


def truncate_at_sentence(text: Column, chars: int = 500) -> Column:
    head = F.substring(text, 1, chars)
    sentence = F.regexp_extract(head, "(?s)^(.*[.。!?])", 1)
    return (
        F.when(F.length(text) <= chars, text).when(sentence != "", sentence).otherwise(head)
    )


def list_sessions(
    sessions: DataFrame,
    status: str | None = None,
    has_summary: bool | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Sessions by filter, newest first."""
    out = sessions
    if status is not None:
        out = out.filter(F.col("status") == status)
    if has_summary is not None:
        out = out.filter(F.col("summary").isNotNull() if has_summary else F.col("summary").isNull())
    out = out.orderBy(F.desc("last_saved_at"), "session_id")
    return out.limit(limit) if limit else out


def list_active(sessions: DataFrame) -> DataFrame:
    return list_sessions(sessions, status="active")


def get_session(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.filter(F.col("session_id") == session_id)


def latest_session(sessions: DataFrame) -> DataFrame:
    """Id of the session saved last."""
    return sessions.agg(
        F.max_by("session_id", F.struct("last_saved_at", "session_id")).alias("session_id")
    )


def update_sessions(sessions: DataFrame, updates: DataFrame) -> DataFrame:
    """Partial update: a non-NULL column of ``updates`` replaces the stored value.

    Updates of unknown sessions are ignored.
    """
    given = [c for c in updates.columns if c != "session_id"]
    new = updates.select("session_id", *[F.col(c).alias(f"_{c}") for c in given])
    return sessions.join(new, "session_id", "left").select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in sessions.columns]
    )


def _block(items: Column, each, sep: str, none: str) -> Column:
    filled = F.array_join(F.transform(items, each), sep)
    return F.when(F.size(items) > 0, filled).otherwise(none)


def session_markdown(sessions: DataFrame) -> DataFrame:
    """Markdown note per session: ``session_id, file_name, markdown``."""
    lit, s = F.lit, F.col("summary")
    bullet = lambda x: F.concat(lit("- "), x)
    code = lambda x: F.concat(lit("`"), x, lit("`"))
    text = lambda name: F.col(name).cast("string")
    head = F.concat(
        lit('---\nsession_id: "'), "session_id",
        lit("\"\nproject_dir: '"), "project_dir",
        lit("'\nstarted_at: "), text("started_at"),
        lit("\nlast_saved_at: "), text("last_saved_at"),
        lit("\nturn_count: "), text("turn_count"),
        lit("\nstatus: "), "status",
        lit("\n---\n\n# Session: "), "session_id", lit("\n"),
    )
    empty = "_None._"
    summary = F.concat(
        lit("\n## Summary\n\n### Overview\n"), F.coalesce(s["overview"], lit("")),
        lit("\n\n### Key Decisions\n"), _block(s["decisions"], bullet, "\n", empty),
        lit("\n\n### Outcomes\n"), _block(s["outcomes"], bullet, "\n", empty),
        lit("\n\n### Open Items\n"),
        _block(s["open_items"], lambda x: F.concat(lit("- [ ] "), x), "\n", empty),
        lit("\n\n### Tags\n"), _block(s["tags"], code, " ", empty), lit("\n"),
    )
    rolling = F.when(F.coalesce("rolling_summary", lit("")) != "", F.col("rolling_summary"))
    none = F.array().cast(_EMPTY)
    tail = F.concat(
        lit("\n## Rolling Summary\n\n"), F.coalesce(rolling, lit("_No summary yet._")),
        lit("\n\n## Decisions\n\n"),
        _block(F.coalesce("decisions", none), bullet, "\n", "_No decisions recorded._"),
        lit("\n\n## Search Footprint\n\n"),
        _block(
            F.coalesce("search_footprint", none),
            lambda x: F.concat(lit("- "), code(x)), "\n", "_No searches performed._",
        ),
        lit("\n"),
    )
    # The UTC day, whatever the time zone of the session.
    days = F.floor(F.col("last_saved_at") / 86_400_000).cast("int")
    day = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return sessions.select(
        "session_id",
        F.concat(day, lit("_"), "session_id", lit(".md")).alias("file_name"),
        F.concat(head, F.when(s.isNotNull(), summary).otherwise(""), tail).alias("markdown"),
    )
