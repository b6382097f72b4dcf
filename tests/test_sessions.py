import json

from notelake.operators import sessions as ses
from notelake.operators import transcripts as tr
from notelake.sources.transcripts import list_transcripts, read_transcripts

SESSION = (
    "session_id string, project_dir string, started_at long, last_saved_at long, turn_count long, rolling_summary string,"
    " decisions array<string>, search_footprint array<string>, summary struct<overview:string,decisions:array<string>,"
    "outcomes:array<string>,open_items:array<string>,tags:array<string>>, status string"
)


def user(text, **kw):
    return json.dumps({"type": "user", "message": {"role": "user", "content": text}, **kw})


def assistant(*blocks, **kw):
    return json.dumps({"type": "assistant", "message": {"role": "assistant", "content": list(blocks)}, **kw})


def text(t):
    return {"type": "text", "text": t}


def tool(name, **args):
    return {"type": "tool_use", "name": name, "input": args}


LINES = [
    json.dumps({"type": "progress", "timestamp": "2026-01-01T00:00:00.000Z"}),
    json.dumps({"type": "file-history-snapshot", "sessionId": "s1"}),
    user("  hello  ", sessionId="other", slug="a-slug", timestamp="2026-01-01T00:00:01.000Z"),
    assistant({"type": "thinking", "thinking": "x"}, text(" one "), text(""), text("two"), tool("Read", file_path="r.py")),
    user([{"type": "tool_result", "content": "big"}]),
    assistant(tool("Write", file_path="b.py"), tool("Edit", file_path="a.py"), tool("NotebookEdit", notebook_path="n.ipynb")),
    "not json",
    "",
    assistant(tool("Write", file_path="b.py"), tool("Edit", file_path=5), tool("Edit", file_path=None, notebook_path="z.py")),
    assistant({"type": "thinking", "thinking": "only"}),
    user("   "),
    user("bye", timestamp="2026-01-01T00:00:09.500Z"),
]


def lines(spark, rows=LINES, file="f"):
    return spark.createDataFrame([(file, i // 4, i, v) for i, v in enumerate(rows)], "session_file string, slice long, seq long, value string")


def test_turns_and_header(spark):
    parsed = tr.parse_lines(lines(spark))
    turns = tr.turns(parsed).orderBy("slice", "seq").collect()
    assert [(t.role, t.text) for t in turns] == [("user", "hello"), ("assistant", "one\ntwo"), ("assistant", ""), ("assistant", ""), ("user", "bye")]
    head = tr.session_headers(parsed).first()
    assert (head.session_id, head.slug) == ("s1", "a-slug")
    assert head.ended_at - head.started_at == 9500
    totals = tr.turn_totals(tr.turns(parsed)).first()
    assert totals.turn_count == 2 and totals.tools_used == ["Edit", "NotebookEdit", "Read", "Write"]
    assert tr.files_modified(tr.turns(parsed)).first().files_modified == ["b.py", "a.py", "n.ipynb", "z.py"]
    rolled = tr.rolling_summary(tr.turns(parsed)).first().rolling_summary
    assert rolled == "**User**: hello\n**Assistant**: one\ntwo\n**User**: bye"


def test_capture_skips_transcripts_without_a_user_turn(spark):
    both = lines(spark).unionByName(lines(spark, [assistant(text("alone"), sessionId="s2")], "g"))
    rows = tr.capture(both, "/repo", 5).collect()
    assert [r.session_id for r in rows] == ["s1"]


def test_transcript_files_keep_line_order_across_splits(spark, tmp_path):
    rows = [user(f"turn {i} " + "x" * 50, sessionId="s") for i in range(2000)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        said = tr.turns(tr.parse_lines(read_transcripts(spark, str(tmp_path))))
        assert said.select("slice").distinct().count() > 3
        text_out = tr.rolling_summary(said).first().rolling_summary
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [int(line.split()[2]) for line in text_out.split("\n")] == list(range(2000))


def sessions(spark):
    summary = ("old", ["d1", "d2"], ["o"], [], ["t"])
    return spark.createDataFrame(
        [("a", "/p", 1, 10, 3, "text.", ["k"], ["q"], summary, "active"), ("b", "/p", 2, 20, 1, "", [], [], None, "closed")], SESSION
    )


def test_upsert_keeps_start_and_summary(spark):
    new = spark.createDataFrame(
        [("a", "/q", 99, 7, "new", [], ["x"], "active"), ("c", "/q", 99, 1, "n", [], [], "active")],
        "session_id string, project_dir string, saved_at long, turn_count long, rolling_summary string,"
        " decisions array<string>, search_footprint array<string>, status string",
    )
    rows = {r.session_id: r for r in ses.upsert_sessions(sessions(spark), new).collect()}
    assert (rows["a"].started_at, rows["a"].last_saved_at, rows["a"].summary.overview, rows["a"].turn_count) == (1, 99, "old", 7)
    assert rows["b"].last_saved_at == 20 and rows["c"].started_at == 99 and rows["c"].summary is None


def test_summary_merge_in_order(spark):
    updates = spark.createDataFrame(
        [
            ("a", 2, 50, ("last", ["d3", "d1"], ["o"], ["i2"], ["u"])),
            ("a", 1, 40, ("first", ["d4"], ["o2"], ["i1"], ["t"])),
            ("b", 1, 60, ("fresh", ["x", "x"], [], [], [])),
            ("zz", 1, 60, ("ignored", [], [], [], [])),
        ],
        "session_id string, seq long, saved_at long, summary struct<overview:string,decisions:array<string>,"
        "outcomes:array<string>,open_items:array<string>,tags:array<string>>",
    )
    rows = {r.session_id: r for r in ses.update_summaries(sessions(spark), updates).collect()}
    s = rows["a"].summary
    assert (s.overview, s.decisions, s.outcomes, s.open_items, s.tags) == ("last", ["d1", "d2", "d4", "d3"], ["o", "o2"], ["i1", "i2"], ["t", "u"])
    assert rows["a"].last_saved_at == 50 and rows["b"].summary.overview == "fresh" and set(rows) == {"a", "b"}


def test_listing_compaction_and_update(spark):
    held = sessions(spark)
    assert [r.session_id for r in ses.list_sessions(held).collect()] == ["b", "a"]
    assert [r.session_id for r in ses.list_sessions(held, has_summary=False).collect()] == ["b"]
    assert [r.session_id for r in ses.list_active(held).collect()] == ["a"]
    assert ses.latest_session(held).first().session_id == "b"
    ids = held.filter("session_id = 'a'").select("session_id")
    done = ses.get_session(ses.compact_sessions(held, ids, 77), "a").first()
    assert (done.status, done.rolling_summary, done.last_saved_at) == ("compacted", "text.", 77)
    long = held.selectExpr("repeat('One two. ', 100) AS x").select(ses.truncate_at_sentence(ses.F.col("x")).alias("y")).first().y
    assert long.endswith(".") and 480 < len(long) <= 500


def test_markdown_placeholders(spark):
    rows = {r.session_id: r for r in ses.session_markdown(sessions(spark)).collect()}
    assert rows["a"].file_name == "1970-01-01_a.md"
    assert "### Open Items\n_None._\n" in rows["a"].markdown and "- `q`\n" in rows["a"].markdown
    assert "## Summary" not in rows["b"].markdown
    for part in ("_No summary yet._", "_No decisions recorded._", "_No searches performed._"):
        assert part in rows["b"].markdown


def test_latest_transcript(spark, tmp_path):
    import os

    for i, name in enumerate(("old.jsonl", "new.jsonl")):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    newest = tr.latest_transcript(list_transcripts(spark, str(tmp_path))).first().path
    assert newest.endswith("new.jsonl")
