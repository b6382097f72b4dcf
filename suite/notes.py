"""Queries over single notes: catalogue, frontmatter, chunking, text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.markdown import chunk_notes, parse_notes
from notelake.functions.text import content_hash, score_band, snippet, token_estimate
from notelake.operators.postings import (
    build_postings,
    token_positions,
)
from notelake.sources.notes import catalogue, clean_paths
from suite.blocks import TOKENS
from suite.inputs import DOC_PATH_SQL, doc_path, lexical_rows, table
from suite.registry import query


def plain_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as note files without any markup."""
    return table(spark, sf, "documents").select(
        doc_path().alias("path"),
        F.octet_length("text").cast("long").alias("file_size"),
        (F.lit(1700000000000) + F.col("doc_id")).alias("mtime_ms"),
        F.col("text").alias("content"),
    )


def marked_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as notes with frontmatter; every text line opens a section."""
    head = F.concat(
        F.lit("---\ntitle: "), "source", F.lit(" "), F.col("doc_id").cast("string"),
        F.lit("\ntags: ["), "lang", F.lit(", "), "source",
        F.lit("]\nref_code_paths:\n  - src/"), "source", F.lit(".ts\n  - \"lib/"), "lang",
        F.lit(".ts\"\nchars: "), F.col("n_chars").cast("string"), F.lit("\n---\n"),
    )
    body = F.concat(
        F.lit("# "), "lang", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n## Line\n\n"))
    )
    return table(spark, sf, "documents").select(
        "doc_id", doc_path().alias("path"), F.concat(head, body).alias("content")
    )


@query(
    "doc_catalog",
    f"""
SELECT {DOC_PATH_SQL} AS doc_path, doc_id::VARCHAR AS title, sha256(text) AS content_hash,
       strlen(text)::BIGINT AS file_size, round(strlen(text) / 1024.0::DOUBLE, 1) AS size_kb,
       1700000000000 + doc_id AS mtime_ms
FROM documents""",
)
def doc_catalog(spark, sf):
    return catalogue(plain_notes(spark, sf)).drop("frontmatter")


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", content_hash(F.col("text")).alias("content_hash")
    )


@query(
    "title_fallback",
    """
SELECT conv_id, turn,
       CASE turn % 3 WHEN 0 THEN 'Chat ' || conv_id WHEN 1 THEN role || ' says' ELSE turn::VARCHAR END AS title
FROM conversations""",
)
def title_fallback(spark, sf):
    """Title from the frontmatter, the first heading, or the file name, by turn."""
    kind = F.col("turn") % 3
    cid, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    content = (
        F.when(kind == 0, F.concat(F.lit("---\ntitle: Chat "), cid, F.lit("\n---\n# Other\n"), "text"))
        .when(kind == 1, F.concat(F.lit("intro\n\n#  "), "role", F.lit(" says \n"), "text"))
        .otherwise(F.concat(F.lit("plain: "), "text"))
    )
    notes = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("chat/"), cid, F.lit("/"), turn, F.lit(".md")).alias("path"),
        content.alias("content"),
    )
    return parse_notes(notes).select("conv_id", "turn", "title")


@query(
    "frontmatter_fields",
    f"""
SELECT {DOC_PATH_SQL} AS doc_path, source || ' ' || doc_id AS title, lang || ',' || source AS tags,
       'chars:' || n_chars AS properties, 'other' AS source_kind, 8::BIGINT AS body_offset
FROM documents""",
)
def frontmatter_fields(spark, sf):
    return parse_notes(marked_notes(spark, sf).drop("doc_id")).select(
        "doc_path",
        "title",
        F.col("tags_text").alias("tags"),
        F.col("properties_text").alias("properties"),
        "source_kind",
        F.col("body_offset").cast("long").alias("body_offset"),
    )


@query(
    "ref_paths",
    """
SELECT doc_id, lang = 'de' AS scalar_warning,
       CASE lang WHEN 'en' THEN 'src/' || source || '.ts|lib/en.ts' WHEN 'de' THEN 'src/de.ts'
                 WHEN 'fr' THEN 'a.ts|b.ts' END AS refs
FROM documents""",
)
def ref_paths(spark, sf):
    """Block list, scalar, inline list and no code references, by language."""
    block = F.concat(
        F.lit("---\nref_code_paths:\n  - src/"), "source", F.lit(".ts\n  - '  lib/en.ts '\n  - ''\n---\n")
    )
    head = (
        F.when(F.col("lang") == "en", block)
        .when(F.col("lang") == "de", "---\nref_code_paths:  src/de.ts \n---\n")
        .when(F.col("lang") == "fr", "---\nref_code_paths: [a.ts, 'b.ts']\nnote: x\n---\n")
        .otherwise("---\nnote: none\n---\n")
    )
    notes = table(spark, sf, "documents").select(
        F.col("doc_id").alias("_id"), doc_path().alias("path"), F.concat(head, "text").alias("content")
    )
    return parse_notes(notes).select(
        F.col("_id").alias("doc_id"),
        F.col("ref_scalar_warning").alias("scalar_warning"),
        F.array_join("ref_code_paths", "|").alias("refs"),
    )


@query("token_estimate", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS token_estimate FROM documents")
def token_estimates(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", token_estimate(F.col("text")).cast("long").alias("token_estimate")
    )


@query(
    "snippet",
    """
SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS snippet
FROM documents""",
)
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"))


@query(
    "score_band",
    """
SELECT event_id, CASE WHEN v >= 0.8 THEN 'high' WHEN v >= 0.5 THEN 'moderate' WHEN v >= 0.2 THEN 'low' ELSE 'skip' END AS band
FROM (SELECT event_id, value / (SELECT max(value) FROM events) AS v FROM events)""",
)
def score_bands(spark, sf):
    events = table(spark, sf, "events")
    top = events.agg(F.max("value")).scalar()
    return events.select("event_id", score_band(F.col("value") / top).alias("band"))


_SECTIONS = """
line AS (
  SELECT doc_id, lang, unnest(l) AS t, unnest(range(len(l))) AS i, len(l) AS n
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)
),
section AS (
  SELECT doc_id, i, 4 * i + 1 AS start_line, CASE WHEN i = n - 1 THEN 4 * i + 3 ELSE 4 * i + 4 END AS end_line,
         CASE WHEN i = 0 THEN lang ELSE lang || ' / Line' END AS heading_path,
         CASE WHEN i = 0 THEN '# ' || lang ELSE '## Line' END AS head, trim(t) AS t
  FROM line
),
part AS (
  SELECT doc_id, i, 0 AS j, heading_path, start_line, end_line,
         CASE WHEN t = '' THEN head ELSE head || chr(10) || chr(10) || t END AS text
  FROM section WHERE length(head) + 2 + length(t) <= 6000
  UNION ALL
  SELECT doc_id, i, 0, heading_path, start_line, start_line, head FROM section WHERE length(head) + 2 + length(t) > 6000
  UNION ALL
  SELECT doc_id, i, 1, heading_path, start_line + 2, start_line + 2, t FROM section WHERE length(head) + 2 + length(t) > 6000
)"""


@query(
    "chunk_headings",
    f"""
WITH {_SECTIONS}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk_index, heading_path,
       start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, text, sha256(text) AS text_hash
FROM part""",
)
def chunk_headings(spark, sf):
    """Every line of a document is a section below the level-1 heading."""
    docs = parse_notes(marked_notes(spark, sf).withColumnRenamed("doc_id", "_id"))
    return chunk_notes(docs.select(F.col("_id").alias("doc_id"), "body")).select(
        "doc_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "heading_path",
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
        "text",
        "text_hash",
    )


@query(
    "chunk_conversation",
    """
SELECT conv_id, turn, 0::BIGINT AS chunk_index, 'Conversation ' || conv_id AS heading_path,
       '# Conversation ' || conv_id AS text FROM conversations
UNION ALL
SELECT conv_id, turn, 1, 'Conversation ' || conv_id || ' / Turn ' || turn,
       '## Turn ' || turn || chr(10) || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' FROM conversations
UNION ALL
SELECT conv_id, turn, 2, 'Conversation ' || conv_id || ' / Turn ' || turn || ' / ' || role,
       '### ' || role || chr(10) || chr(10) || regexp_replace(text, '^[ \\n]+|[ \\n]+$', '', 'g') FROM conversations""",
)
def chunk_conversation(spark, sf):
    """Nested headings and a code fence around every conversation turn."""
    body = F.format_string(
        "# Conversation %d\n\n## Turn %d\n\n```\n# code\n```\n### %s\n\n%s",
        "conv_id", "turn", "role", "text",
    )
    notes = table(spark, sf, "conversations").select("conv_id", "turn", body.alias("body"))
    return chunk_notes(notes).select(
        "conv_id", "turn", F.col("chunk_index").cast("long").alias("chunk_index"), "heading_path", "text"
    )


@query(
    "chunk_oversize",
    """
WITH RECURSIVE body AS (
  SELECT doc_id, replace(trim(text, ' ' || chr(10) || chr(9)), chr(10), chr(10) || chr(10)) AS b,
         length(regexp_extract(text, '^[ \\n\\t]*')) - length(replace(regexp_extract(text, '^[ \\n\\t]*'), chr(10), '')) AS lead,
         1 + 2 * (length(text) - length(replace(text, chr(10), ''))) AS total
  FROM documents
),
gaps AS (
  SELECT doc_id, lead, total, unnest(l) AS t, unnest(range(len(l))) AS i, unnest(list_concat([0], list_transform(g, lambda x: length(x)))) AS gap
  FROM (SELECT doc_id, lead, total, string_split_regex(b, '\\n\\n+') AS l, regexp_extract_all(b, '\\n\\n+') AS g FROM body)
),
para AS (SELECT doc_id, total, t, i, 1 + 2 * lead + sum(gap) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM gaps),
pack AS (
  SELECT doc_id, i, length(t) AS size, 0 AS part FROM para WHERE i = 0
  UNION ALL
  SELECT p.doc_id, p.i,
         CASE WHEN k.size + 2 + length(p.t) > 6000 THEN length(p.t) ELSE k.size + 2 + length(p.t) END,
         CASE WHEN k.size + 2 + length(p.t) > 6000 THEN k.part + 1 ELSE k.part END
  FROM pack k JOIN para p ON p.doc_id = k.doc_id AND p.i = k.i + 1
)
SELECT doc_id, part::BIGINT AS chunk_index, max(size)::BIGINT AS n_chars, count(*)::BIGINT AS n_paragraphs,
       min(line)::BIGINT AS start_line, CASE WHEN max(max(part)) OVER (PARTITION BY doc_id) = 0 THEN any_value(total) ELSE max(line) END::BIGINT AS end_line,
       sha256(trim(string_agg(t, chr(10) || chr(10) ORDER BY i), ' ' || chr(10) || chr(9))) AS text_hash
FROM pack JOIN para USING (doc_id, i) GROUP BY doc_id, part""",
)
def chunk_oversize(spark, sf):
    """Documents above 6000 characters are packed from blank-line paragraphs."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body")
    )
    parts = chunk_notes(docs)
    return parts.select(
        "doc_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.length("text").cast("long").alias("n_chars"),
        F.size(F.split("text", "\n\n+")).cast("long").alias("n_paragraphs"),
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
        "text_hash",
    )


@query(
    "tokenize",
    f"""
WITH {TOKENS}
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs, max(pos)::BIGINT AS last_pos
FROM tok GROUP BY 1""",
)
def tokenize(spark, sf):
    return (
        token_positions(lexical_rows(spark, sf))
        .groupBy("term")
        .agg(
            F.count("*").alias("n"),
            F.count_distinct("doc_id").alias("docs"),
            F.max("pos").cast("long").alias("last_pos"),
        )
    )


@query(
    "postings_stats",
    f"""
WITH {TOKENS}
SELECT (SELECT count(*) FROM documents) AS n_rows, count(*) AS total_tokens,
       count(DISTINCT term) AS n_terms, (SELECT count(*) FROM (SELECT DISTINCT term, doc_id FROM tok)) AS n_postings
FROM tok""",
)
def postings_stats(spark, sf):
    # The rows of the empty term carry the length of their chunk.
    mark = F.col("term") == ""
    return (
        build_postings(lexical_rows(spark, sf), marks=True)
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum(F.when(mark, F.col("n_tokens"))).alias("tokens"))
        .agg(
            F.sum(F.when(mark, F.col("df"))).alias("n_rows"),
            F.sum("tokens").alias("total_tokens"),
            F.count_if(~mark).alias("n_terms"),
            F.sum(F.when(~mark, F.col("df"))).alias("n_postings"),
        )
    )


@query(
    "dirty_paths",
    "SELECT DISTINCT user_id || '/' || event_type || '.md' AS path FROM events",
)
def dirty_paths(spark, sf):
    """Change events as a dirty list with spaces, backslashes and repeats."""
    lines = table(spark, sf, "events").select(
        F.concat(F.lit("  "), F.col("user_id").cast("string"), F.lit("\\"), "event_type", F.lit(".md ")).alias("value")
    )
    return clean_paths(lines)
