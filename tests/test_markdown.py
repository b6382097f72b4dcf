import random

import pytest
from pyspark.sql import functions as F

from notelake.functions.markdown import chunk_notes, parse_notes
from notelake.functions.text import (
    fold,
    query_phrases,
    score_band,
    snippet,
    token_estimate,
    tokens,
    trim_ws,
    utf16_left,
    utf16_length,
)
from notelake.params import ChunkParams

AUTH = (
    "# Authentication Service\n\nHandles JWT token generation and JIRA-1234 validation.\n\n"
    "## OAuth Flow\n\nOAuth2 flow implementation details."
)


def notes(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, body string")


def chunks_of(spark, text, tokens_limit=1500):
    rows = (
        chunk_notes(bodies(spark, text), params=ChunkParams(split_tokens=tokens_limit))
        .orderBy("chunk_index")
        .collect()
    )
    return [(r.heading_path, r.start_line, r.end_line, r.text) for r in rows]


def test_frontmatter_title_tags_and_refs(spark):
    content = (
        "---\ntitle: Auth Service\ntags: [auth, \"two words\"]\nref_code_paths:\n  - src/a.ts\n"
        "  - ' src/b.ts '\ncategory: architecture\nowner:\n---\n# Auth\nHandles authentication."
    )
    row = parse_notes(notes(spark, ("code-notes/auth.md", content))).first()
    assert row.title == "Auth Service"
    assert row.tags == ["auth", "two words"]
    assert row.tags_text == "auth,two words"
    assert row.ref_code_paths == ["src/a.ts", "src/b.ts"]
    assert not row.ref_scalar_warning
    assert row.properties_text == "category:architecture owner:null"
    assert row.body.startswith("# Auth")
    assert row.body_offset == 9
    assert row.source_kind == "code_note"


def test_scalar_ref_is_a_list_with_a_warning(spark):
    row = parse_notes(notes(spark, ("a.md", "---\nref_code_paths: src/service.ts\n---\nx"))).first()
    assert row.ref_code_paths == ["src/service.ts"]
    assert row.ref_scalar_warning


def test_absent_and_empty_refs(spark):
    rows = parse_notes(
        notes(spark, ("a.md", "# x"), ("b.md", "---\nref_code_paths: []\n---\nx"))
    ).orderBy("doc_path").collect()
    assert rows[0].ref_code_paths is None
    assert rows[1].ref_code_paths == []


@pytest.mark.parametrize(
    ("content", "title"),
    [
        ("# Coding Standards\nFollow SOLID principles.", "Coding Standards"),
        ("no heading", "coding"),
        ("---\ntitle:\n---\ntext", "coding"),
        ("---\ntitle: 'Quoted: yes'\n---\n# Other", "Quoted: yes"),
        ("---\n---\n# After empty block", "After empty block"),
        ("---\ntitle: a\ntitle: b # note\n---\n", "b"),
        ("", "coding"),
    ],
)
def test_title(spark, content, title):
    assert parse_notes(notes(spark, ("rules\\coding.md", content))).first().title == title


def test_headings_cut_sections(spark):
    got = chunks_of(spark, "# Introduction\nHello\n\n## Details\nMore\n\n## Conclusion\nBye")
    assert [c[0] for c in got] == [
        "Introduction",
        "Introduction / Details",
        "Introduction / Conclusion",
    ]


def test_preamble_plain_and_empty(spark):
    assert [c[0] for c in chunks_of(spark, "before\n\n# One\ntext")] == ["", "One"]
    assert len(chunks_of(spark, "just text")) == 1
    assert chunks_of(spark, "") == []
    assert chunks_of(spark, " \n \n") == []


def test_fence_hides_headings(spark):
    assert len(chunks_of(spark, "# Code\n```\n# not a heading\n## nor this\n```\nend")) == 1


def test_line_numbers(spark):
    got = chunks_of(spark, "# First\nline2\nline3\n\n# Second\nline6")
    assert [(c[1], c[2]) for c in got] == [(1, 4), (5, 6)]


def test_oversized_section_is_packed_and_single_paragraph_stays(spark):
    paragraphs = [f"p{i} " + "x" * 30 for i in range(6)] + ["y" * 200]
    text = "# Big\n\n" + "\n\n\n".join(paragraphs)
    got = chunks_of(spark, text, tokens_limit=20)
    assert all(len(t) <= 80 or t == "y" * 200 for _, _, _, t in got)
    assert "\n\n".join(c[3] for c in got) == "# Big\n\n" + "\n\n".join(paragraphs)
    lines = text.split("\n")
    for _, start, end, part in got:
        assert lines[start - 1] == part.split("\n")[0]
        assert lines[end - 1] == part.split("\n")[-1]


def plain_chunks(body, limit):
    """Independent restatement over plain Python strings."""
    sections, path, fenced = [("", [])], [], False
    for line in body.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and line.startswith("#"):
            mark, _, title = line.partition(" ")
            if title != "" or line.endswith(" "):
                if set(mark) == {"#"} and len(mark) <= 6:
                    path = [p for p in path if p[0] < len(mark)] + [(len(mark), title.strip())]
                    sections.append((" / ".join(p[1] for p in path), []))
        sections[-1][1].append(line)
    out = []
    for name, lines in sections:
        text = "\n".join(lines).strip()
        if not text:
            continue
        if len(text) <= limit:
            out.append((name, text))
            continue
        pack = []
        import re

        for para in re.split("\n\n+", text):
            if pack and len("\n\n".join([*pack, para])) > limit:
                out.append((name, "\n\n".join(pack).strip()))
                pack = []
            pack.append(para)
        out.append((name, "\n\n".join(pack).strip()))
    return [o for o in out if o[1]]


def test_random_notes_match_a_plain_restatement(spark):
    rng = random.Random(7)
    parts = ["# a", "## b", "### c", "###### f", "", "", "text one", "longer text here", "```", "#nope", "## "]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(300)]
    rows = (
        chunk_notes(bodies(spark, *texts), params=ChunkParams(split_tokens=10))
        .orderBy("doc_id", "chunk_index")
        .collect()
    )
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.heading_path, r.text))
        assert r.chunk_index == len(got[r.doc_id]) - 1
    for i, text in enumerate(texts):
        assert got.get(i, []) == plain_chunks(text, 40), repr(text)


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


def test_text_columns(spark):
    assert one(spark, "foo_bar a1-b2 Élan Ñandú straße", tokens) == [
        "foo", "bar", "a1", "b2", "elan", "nandu", "straße",
    ]
    assert one(spark, "éa", fold) == "ea"
    assert one(spark, None, tokens) == []
    assert one(spark, '  JIRA-1234 the "x" -- ', query_phrases) == [["jira", "1234"], ["the"], ["x"]]
    assert one(spark, "　 a b \n", trim_ws) == "a b"
    assert one(spark, "a😀b", utf16_length) == 4
    assert one(spark, "a😀b", lambda c: utf16_left(c, 2)) == "a"
    assert one(spark, "a😀b", lambda c: utf16_left(c, 3)) == "a😀"
    assert one(spark, "x" * 200, snippet) == "x" * 200
    assert one(spark, "x" * 201, snippet) == "x" * 200 + "..."
    assert one(spark, "abcde", token_estimate) == 2
    assert one(spark, "", lambda c: score_band(F.lit(0.5))) == "moderate"


def test_twenty_thousand_headings_are_cut_in_seconds(spark):
    import time

    text = "\n".join(f"{'#' * (1 + i % 6)} h{i}\n```\n# no\n```\ntext {i}" for i in range(20000))
    began = time.time()
    rows = chunk_notes(bodies(spark, text)).orderBy("chunk_index").collect()
    assert len(rows) == 20000 and rows[7].heading_path == "h6 / h7" and rows[19999].start_line == 5 * 19999 + 1
    assert time.time() - began < 20


def test_line_breaks_inside_a_line_and_other_columns(spark):
    assert [c[0] for c in chunks_of(spark, "# a\r\n\r\ntext\n## b\rc\n#\u3000d\u00a0\n####### e")] == ["a", "d"]
    docs = spark.createDataFrame([(1, "# a\nx", {"k": "v"}, 5), (2, None, None, 6)], "doc_id long, body string, m map<string,string>, chunk_total int")
    rows = chunk_notes(docs).collect()
    assert [(r.doc_id, r.m, r.chunk_total, r.start_line, r.end_line) for r in rows] == [(1, {"k": "v"}, 5, 1, 2)]
