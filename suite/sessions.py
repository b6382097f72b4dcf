"""Queries over transcripts and sessions; every conversation is one transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.operators import sessions as ses
from notelake.operators import transcripts as tr
from notelake.sources.transcripts import backup_transcripts
from suite.inputs import table
from suite.registry import query

START = 1_704_067_200_000
NOW = 1_710_000_000_000
_TOOLS = ("Read", "Edit", "Write", "NotebookEdit", "Bash")
_TRIM = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"
_TOOL_SQL = "(CASE turn % 5 WHEN 0 THEN 'Read' WHEN 1 THEN 'Edit' WHEN 2 THEN 'Write' WHEN 3 THEN 'NotebookEdit' ELSE 'Bash' END)"
_SAID = f"""
said AS (
  SELECT conv_id, turn, role, {_TRIM} AS text, {_TOOL_SQL} AS tool,
         'src/f' || ((turn * 7) % 3) || '.py' AS file
  FROM conversations WHERE role <> 'system' AND (role = 'assistant' OR {_TRIM} <> '')
)"""


def _stamp(seconds: Column) -> Column:
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    return F.concat(
        day.cast("string"), F.lit("T"), two(seconds % 86400 / 3600), F.lit(":"),
        two(seconds % 3600 / 60), F.lit(":00.000Z"),
    )


def lines(spark, sf) -> DataFrame:
    """Three lines per turn: the turn, a tool result, and a broken line."""
    turn = F.col("turn")
    tool = F.element_at(F.array(*[F.lit(t) for t in _TOOLS]), (turn % 5 + 1).cast("int"))
    file = F.concat(F.lit("src/f"), (turn * 7 % 3).cast("string"), F.lit(".py"))
    sid = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    head = [
        sid.alias("sessionId"),
        F.concat(F.lit("chat-"), F.col("conv_id").cast("string")).alias("slug"),
        _stamp(F.col("conv_id") * 3600 + turn * 60).alias("timestamp"),
    ]
    notebook = tool == "NotebookEdit"
    blocks = F.array(
        F.struct(F.lit("text").alias("type"), F.concat(F.lit(" \n"), "text", F.lit("\n")).alias("text"),
                 F.lit(None).cast("string").alias("thinking"), F.lit(None).cast("string").alias("name"),
                 F.lit(None).cast("struct<file_path:string,notebook_path:string>").alias("input")),
        F.struct(F.lit("thinking").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("hm").alias("thinking"),
                 F.lit(None).cast("string").alias("name"),
                 F.lit(None).cast("struct<file_path:string,notebook_path:string>").alias("input")),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"),
                 F.lit(None).cast("string").alias("thinking"), tool.alias("name"),
                 F.struct(F.when(~notebook, file).alias("file_path"), F.when(notebook, file).alias("notebook_path")).alias("input")),
    )
    message = lambda content: F.struct(F.col("role").alias("role"), content.alias("content")).alias("message")
    said = (
        F.when(F.col("role") == "system", F.to_json(F.struct(F.lit("progress").alias("type"), *head, message(F.col("text")))))
        .when(F.col("role") == "user", F.to_json(F.struct(F.lit("user").alias("type"), *head, message(F.concat(F.lit("  "), "text")))))
        .otherwise(F.to_json(F.struct(F.lit("assistant").alias("type"), *head, message(blocks))))
    )
    result = F.to_json(
        F.struct(
            F.lit("user").alias("type"), *head,
            F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("tool_result").alias("type"), F.col("text").alias("content"))).alias("content")).alias("message"),
        )
    )
    return table(spark, sf, "conversations").select(
        F.concat(sid, F.lit(".jsonl")).alias("session_file"),
        F.floor(turn / 1000).cast("long").alias("slice"),
        F.posexplode(F.array(said, result, F.lit("{not json"))).alias("_part", "value"),
        turn.alias("_turn"),
    ).select("session_file", "slice", (F.col("_turn") * 3 + F.col("_part")).alias("seq"), "value")


def parsed(spark, sf):
    return tr.parse_lines(lines(spark, sf))


def said(spark, sf):
    return tr.turns(parsed(spark, sf))


def conv() -> Column:
    return F.regexp_extract("session_file", "^s(\\d+)", 1).cast("long").alias("conv_id")


@query(
    "turns",
    f"""WITH {_SAID}
SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN tool ELSE '' END AS tools FROM said""",
)
def turns(spark, sf):
    return said(spark, sf).select(
        conv(), F.floor(F.col("seq") / 3).cast("long").alias("turn"), "role", "text",
        F.array_join("tools", ",").alias("tools"),
    )


@query(
    "session_header",
    f"""
SELECT 's' || conv_id AS session_id, 'chat-' || conv_id AS slug,
       {START} + (conv_id * 3600 + min(turn) * 60) * 1000 AS started_at,
       {START} + (conv_id * 3600 + max(turn) * 60) * 1000 AS ended_at
FROM conversations GROUP BY conv_id""",
)
def session_header(spark, sf):
    return tr.session_headers(parsed(spark, sf)).drop("session_file")


@query(
    "turn_totals",
    f"""WITH {_SAID}
SELECT conv_id, count(*) FILTER (role = 'user') AS turn_count,
       coalesce(string_agg(DISTINCT tool, ',' ORDER BY tool) FILTER (role = 'assistant'), '') AS tools_used
FROM said GROUP BY 1""",
)
def turn_totals(spark, sf):
    return tr.turn_totals(said(spark, sf)).select(
        conv(), "turn_count", F.array_join("tools_used", ",").alias("tools_used")
    )


@query(
    "files_modified",
    f"""WITH {_SAID}
SELECT conv_id, string_agg(file, ',' ORDER BY first) AS files FROM (
  SELECT conv_id, file, min(turn) AS first FROM said
  WHERE role = 'assistant' AND tool IN ('Edit', 'Write', 'NotebookEdit') GROUP BY 1, 2)
GROUP BY 1""",
)
def files_modified(spark, sf):
    return tr.files_modified(said(spark, sf)).select(conv(), F.array_join("files_modified", ",").alias("files"))


_ROLLING = f"""{_SAID},
rolling AS (
  SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '**User**: ' ELSE '**Assistant**: ' END || text, chr(10) ORDER BY turn) AS text
  FROM said WHERE text <> '' GROUP BY 1
),
users AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n,
  coalesce(string_agg(DISTINCT tool, ',' ORDER BY tool) FILTER (role = 'assistant'), '') AS tools FROM said GROUP BY 1)"""


@query("rolling_summary", f"WITH {_ROLLING} SELECT conv_id, text AS rolling_summary FROM rolling")
def rolling_summary(spark, sf):
    return tr.rolling_summary(said(spark, sf)).select(conv(), "rolling_summary")


@query(
    "session_capture",
    f"""WITH {_ROLLING}
SELECT 's' || conv_id AS session_id, n AS turn_count, sha256(text) AS rolling_hash, tools AS search_footprint, 'active' AS status
FROM users JOIN rolling USING (conv_id) WHERE n > 0""",
)
def session_capture(spark, sf):
    return tr.capture(lines(spark, sf), "/repo", NOW).select(
        "session_id", "turn_count", F.sha2("rolling_summary", 256).alias("rolling_hash"),
        F.array_join("search_footprint", ",").alias("search_footprint"), "status",
    )


@query(
    "transcript_view",
    f"""WITH {_SAID}
SELECT conv_id, turn, role, text FROM said WHERE conv_id = (SELECT max(conv_id) FROM conversations)""",
)
def transcript_view(spark, sf):
    """Turns of the transcript that ended last."""
    held = parsed(spark, sf)
    newest = tr.session_headers(held).agg(
        F.max_by("session_file", F.struct("ended_at", "session_file")).alias("session_file")
    )
    return tr.transcript_view(held, newest).select(
        conv(), F.floor(F.col("seq") / 3).cast("long").alias("turn"), "role", "text"
    )


@query(
    "transcript_backup",
    """
SELECT conv_id, count(*) * 3 AS n_lines FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1""",
)
def transcript_backup(spark, sf):
    """Raw lines of transcripts that are not in the backup yet."""
    stored = table(spark, sf, "conversations").filter("role = 'system'").select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("session_file")
    )
    return backup_transcripts(lines(spark, sf), stored).groupBy(conv()).agg(F.count("*").alias("n_lines"))


# ---- stored sessions: conversations that have a system turn ----

_LISTS = "struct<overview:string,decisions:array<string>,outcomes:array<string>,open_items:array<string>,tags:array<string>>"


def stored(spark, sf) -> DataFrame:
    per = table(spark, sf, "conversations").filter("role = 'system'").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("text")
    )
    long_text = F.length("text") > per.agg(F.avg(F.length("text"))).scalar()
    entry = lambda *parts: F.array(*[F.lit(p) for p in parts])
    summary = F.struct(
        F.lit("old").alias("overview"), entry("keep it", "use spark").alias("decisions"),
        entry("done").alias("outcomes"), entry("todo a", "todo b").alias("open_items"), entry("x").alias("tags"),
    ).cast(_LISTS)
    return per.select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.lit("/old").alias("project_dir"),
        F.col("conv_id").alias("started_at"),
        (F.lit(START) + F.col("conv_id") * 3_600_000).alias("last_saved_at"),
        F.lit(1).cast("long").alias("turn_count"),
        F.col("text").alias("rolling_summary"),
        F.array().cast("array<string>").alias("decisions"),
        F.array(F.lit("Read")).alias("search_footprint"),
        F.when(long_text, summary).alias("summary"),
        F.when(long_text, "active").otherwise("closed").alias("status"),
    )


_STORED = f"""
sys AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY 1),
stored AS (SELECT conv_id, text, length(text) > (SELECT avg(length(text)) FROM sys) AS long,
                  {START} + conv_id * 3600000 AS saved FROM sys)"""


@query(
    "session_upsert",
    f"""WITH {_ROLLING}, {_STORED}, snap AS (SELECT conv_id, n, text AS rolled, tools FROM users JOIN rolling USING (conv_id) WHERE n > 0)
SELECT 's' || conv_id AS session_id, CASE WHEN n IS NULL THEN '/old' ELSE '/repo' END AS project_dir,
       coalesce(CASE WHEN s.text IS NOT NULL THEN conv_id END, {NOW})::BIGINT AS started_at,
       CASE WHEN n IS NULL THEN saved ELSE {NOW} END::BIGINT AS last_saved_at, coalesce(n, 1) AS turn_count,
       sha256(coalesce(rolled, s.text)) AS rolling_hash, coalesce(tools, 'Read') AS footprint,
       coalesce(long, FALSE) AS has_summary,
       CASE WHEN n IS NOT NULL OR long THEN 'active' ELSE 'closed' END AS status
FROM snap FULL JOIN stored s USING (conv_id)""",
)
def session_upsert(spark, sf):
    """Captured snapshots over the stored sessions."""
    out = ses.upsert_sessions(stored(spark, sf), tr.capture(lines(spark, sf), "/repo", NOW))
    return out.select(
        "session_id", "project_dir", "started_at", "last_saved_at", "turn_count",
        F.sha2("rolling_summary", 256).alias("rolling_hash"),
        F.array_join("search_footprint", ",").alias("footprint"),
        F.col("summary").isNotNull().alias("has_summary"), "status",
    )


@query(
    "session_list",
    f"WITH {_STORED} SELECT 's' || conv_id AS session_id, saved AS last_saved_at FROM stored WHERE long ORDER BY saved DESC",
)
def session_list(spark, sf):
    """Active sessions with a summary, newest first."""
    return ses.list_sessions(stored(spark, sf), "active", True).select("session_id", "last_saved_at")


@query(
    "session_list_recent",
    f"WITH {_STORED} SELECT 's' || conv_id AS session_id, long AS has_summary FROM stored ORDER BY saved DESC LIMIT 5",
)
def session_list_recent(spark, sf):
    return ses.list_sessions(stored(spark, sf), limit=5).select(
        "session_id", F.col("summary").isNotNull().alias("has_summary")
    )


@query(
    "session_latest",
    "SELECT 's' || max(conv_id) AS session_id FROM conversations WHERE role = 'system'",
)
def session_latest(spark, sf):
    return ses.latest_session(stored(spark, sf))


def updates(spark, sf) -> DataFrame:
    """A summary per assistant turn; sequence is the turn."""
    turn = F.col("turn").cast("string")
    summary = F.struct(
        F.concat(F.lit("after "), turn).alias("overview"),
        F.array(F.lit("use spark"), F.concat(F.lit("d"), turn)).alias("decisions"),
        F.array().cast("array<string>").alias("outcomes"),
        F.array(F.concat(F.lit("todo "), (F.col("turn") % 4).cast("string"))).alias("open_items"),
        F.array(F.lit("x"), F.lit("y")).alias("tags"),
    ).cast(_LISTS)
    return table(spark, sf, "conversations").filter("role = 'assistant'").select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.col("turn").alias("seq"), F.lit(NOW).cast("long").alias("saved_at"), summary.alias("summary"),
    )


@query(
    "summary_merge",
    f"""WITH {_STORED}, upd AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'),
last AS (SELECT conv_id, max(turn) AS turn FROM upd GROUP BY 1),
ds AS (SELECT conv_id, string_agg('d' || turn, '|' ORDER BY turn) AS d FROM upd GROUP BY 1),
op AS (SELECT conv_id, string_agg('todo ' || m, '|' ORDER BY first) AS o FROM (
  SELECT conv_id, turn % 4 AS m, min(turn) AS first FROM upd GROUP BY 1, 2) GROUP BY 1)
SELECT 's' || conv_id AS session_id,
       CASE WHEN l.turn IS NOT NULL THEN 'after ' || l.turn WHEN long THEN 'old' ELSE '' END AS overview,
       CASE WHEN long THEN 'keep it|use spark' || coalesce('|' || d, '') ELSE coalesce('use spark|' || d, '') END AS decisions,
       CASE WHEN long THEN 'done' ELSE '' END AS outcomes,
       CASE WHEN long THEN 'todo a|todo b' || coalesce('|' || o, '') ELSE coalesce(o, '') END AS open_items,
       CASE WHEN l.turn IS NOT NULL THEN 'x|y' WHEN long THEN 'x' ELSE '' END AS tags,
       CASE WHEN l.turn IS NOT NULL THEN {NOW} ELSE saved END::BIGINT AS last_saved_at
FROM stored LEFT JOIN last l USING (conv_id) LEFT JOIN ds USING (conv_id) LEFT JOIN op USING (conv_id)""",
)
def summary_merge(spark, sf):
    """Many updates per session merge in order into the stored summaries."""
    out = ses.update_summaries(stored(spark, sf), updates(spark, sf))
    text = lambda f: F.coalesce(F.array_join(f"summary.{f}", "|"), F.lit("")).alias(f)
    return out.select(
        "session_id", F.coalesce("summary.overview", F.lit("")).alias("overview"),
        *[text(f) for f in ses.SUMMARY_LISTS], "last_saved_at",
    )


@query(
    "session_compact",
    f"""WITH {_STORED}
SELECT 's' || conv_id AS session_id, text AS rolling_summary, CASE WHEN long THEN 'closed' ELSE 'compacted' END AS status
FROM (SELECT conv_id, text, NOT long AS long FROM stored)""",
)
def session_compact(spark, sf):
    """Compaction of the active sessions; the text stays whole."""
    held = stored(spark, sf)
    active = ses.list_active(held).select("session_id")
    return ses.compact_sessions(held, active, NOW).select("session_id", "rolling_summary", "status")


@query(
    "session_update",
    f"""WITH {_STORED}
SELECT 's' || conv_id AS session_id, CASE WHEN long THEN 'closed' ELSE 'reopened' END AS status,
       CASE WHEN long THEN 1 ELSE 7 END::BIGINT AS turn_count, '/old' AS project_dir
FROM (SELECT conv_id, NOT long AS closed, long FROM stored)""",
)
def session_update(spark, sf):
    """Partial update: only the given columns change."""
    held = stored(spark, sf)
    closed, active = held.filter("status = 'closed'"), held.filter("status = 'active'")
    changes = closed.select("session_id", F.lit("reopened").alias("status"), F.lit(7).cast("long").alias("turn_count")).unionByName(
        active.select("session_id", F.lit("closed").alias("status"), F.lit(None).cast("long").alias("turn_count"))
    )
    return ses.update_sessions(held, changes).select("session_id", "status", "turn_count", "project_dir")


_MD = """'---' || chr(10) || 'session_id: "s' || conv_id || '"' || chr(10) || 'project_dir: ''/old''' || chr(10)
 || 'started_at: ' || conv_id || chr(10) || 'last_saved_at: ' || saved || chr(10) || 'turn_count: 1' || chr(10)
 || 'status: ' || CASE WHEN long THEN 'active' ELSE 'closed' END || chr(10) || '---' || chr(10) || chr(10) || '# Session: s' || conv_id || chr(10)
 || CASE WHEN long THEN chr(10) || '## Summary' || chr(10) || chr(10) || '### Overview' || chr(10) || 'old' || chr(10) || chr(10)
    || '### Key Decisions' || chr(10) || '- keep it' || chr(10) || '- use spark' || chr(10) || chr(10) || '### Outcomes' || chr(10) || '- done'
    || chr(10) || chr(10) || '### Open Items' || chr(10) || '- [ ] todo a' || chr(10) || '- [ ] todo b' || chr(10) || chr(10)
    || '### Tags' || chr(10) || '`x`' || chr(10) ELSE '' END
 || chr(10) || '## Rolling Summary' || chr(10) || chr(10) || CASE WHEN text = '' THEN '_No summary yet._' ELSE text END || chr(10) || chr(10)
 || '## Decisions' || chr(10) || chr(10) || '_No decisions recorded._' || chr(10) || chr(10)
 || '## Search Footprint' || chr(10) || chr(10) || '- `Read`' || chr(10)"""


@query(
    "session_markdown",
    f"""WITH {_STORED}
SELECT 's' || conv_id AS session_id, strftime(make_timestamp(saved * 1000), '%Y-%m-%d') || '_s' || conv_id || '.md' AS file_name,
       {_MD} AS markdown FROM stored""",
)
def session_markdown(spark, sf):
    return ses.session_markdown(stored(spark, sf))


@query(
    "json_lists",
    """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || '|b' ELSE '' END AS items FROM conversations""",
)
def json_lists(spark, sf):
    """JSON lists with a fallback for missing and unreadable text."""
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('["'), "role", F.lit('", "b"]'))).when(
        F.col("turn") % 3 == 1, "[broken"
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(ses.json_list(raw), "|").alias("items")
    )
