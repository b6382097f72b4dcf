"""Lookups: search result enrichment, chunks by id, by document, by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import snippet
from notelake.operators.contexts import context_lines
from notelake.operators.postings import CHUNK_KEY
from notelake.operators.sizing import MAX_BROADCAST_ROWS, broadcast_if_small

_CHUNK_COLS = ("heading_path", "start_line", "end_line", "text")


def enrich_results(
    results: DataFrame,
    chunks: DataFrame,
    docs: DataFrame,
    max_rows: int | None = None,
    snippet_chars: int = 200,
) -> DataFrame:
    """Result rows with chunk and document columns; rows without a match are dropped.

    ``max_rows`` is the caller's bound on the result rows (queries x top k). With
    a small bound the results, which hold no texts, go to the scans; without one the joins are
    left to the optimiser, whose run-time filters cut the chunk side first. Texts come last and are
    not broadcast.
    """
    small = max_rows is not None and max_rows <= MAX_BROADCAST_ROWS
    ref = F.when(F.size("ref_code_paths") > 0, F.col("ref_code_paths"))
    held = docs.select("doc_id", "doc_path", "title", "namespace", ref.alias("ref_code_paths")).join(
        F.broadcast(results) if small else results, "doc_id"
    )
    texts = chunks.select(*CHUNK_KEY, *_CHUNK_COLS)
    joined = texts.join(F.broadcast(held) if small else held, list(CHUNK_KEY))
    order = ["doc_id", "doc_path", "title", "namespace", "ref_code_paths", "chunk_index", *_CHUNK_COLS]
    more = [c for c in results.columns if c not in order]
    return joined.select(*order, *more).withColumn("snippet", snippet(F.col("text"), snippet_chars))


def attach_contexts(results: DataFrame, contexts: DataFrame) -> DataFrame:
    """Add the ``contexts`` lines that apply to each result's ``doc_path``."""
    lines = context_lines(results.select(F.col("doc_path").alias("path")).distinct(), contexts)
    return results.join(lines.withColumnRenamed("path", "doc_path"), "doc_path", "left").withColumn(
        "contexts", F.coalesce("contexts", F.array().cast("array<string>"))
    )


def detail(results: DataFrame, level: str = "normal") -> DataFrame:
    """Columns of a detail level: ``brief``, ``normal`` or ``full``."""
    head = [c for c in ("query_id", "rank") if c in results.columns]
    ids = [*head, *CHUNK_KEY, "title", "doc_path"]
    if level == "brief":
        return results.select(*ids, "score")
    if level == "normal":
        return results.select(*ids, "heading_path", "snippet", "score", "lex_norm", "vec_norm")
    if level == "full":
        return results
    raise ValueError(f"unknown detail level {level!r}")


def _with_doc(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.select(*CHUNK_KEY, *_CHUNK_COLS).join(
        docs.select("doc_id", "doc_path", "title"), "doc_id"
    )


def chunk_by_id(chunks: DataFrame, docs: DataFrame, doc_id: int, chunk_index: int) -> DataFrame:
    """One chunk with its document; the filter reaches both scans."""
    return _with_doc(
        chunks.filter((F.col("doc_id") == doc_id) & (F.col("chunk_index") == chunk_index)),
        docs.filter(F.col("doc_id") == doc_id),
    )


def parse_chunk_id(identifier: Column) -> Column:
    """Number of an identifier written with or without ``#``; NULL for a path."""
    return F.regexp_extract(identifier, "^#?(\\d+)$", 1).try_cast("long")


def document_chunks(chunks: DataFrame, docs: DataFrame, doc_path: str) -> DataFrame:
    """All chunks of one document in order, with their number."""
    held = docs.filter(F.col("doc_path") == doc_path)
    count = F.count("*").alias("n_chunks")
    found = _with_doc(chunks, F.broadcast(held))
    totals = found.groupBy("doc_id").agg(count)
    return found.join(F.broadcast(totals), "doc_id").orderBy("chunk_index")


def get_chunks(chunks: DataFrame, docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of an id table in key order, and for every id whether it was found."""
    wanted = broadcast_if_small(ids.select(*CHUNK_KEY).distinct())
    hit = chunks.join(wanted, list(CHUNK_KEY), "left_semi")
    report = wanted.join(
        hit.select(*CHUNK_KEY, F.lit(True).alias("found")), list(CHUNK_KEY), "left"
    ).select(*CHUNK_KEY, F.coalesce("found", F.lit(False)).alias("found"))
    return _with_doc(hit, docs).orderBy(*CHUNK_KEY), report


def get_documents(chunks: DataFrame, docs: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks of many documents, ordered by path and position."""
    wanted = broadcast_if_small(paths.select("doc_path").distinct())
    held = docs.join(wanted, "doc_path", "left_semi")
    return _with_doc(chunks, held).orderBy("doc_path", "chunk_index")


def like_pattern(col: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = pattern.translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    return F.translate(col, upper, lower).like(plain)


def documents_like(docs: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    """First documents by path whose path matches a LIKE pattern."""
    return (
        docs.filter(like_pattern(F.col("doc_path"), pattern))
        .select("doc_path", "title")
        .distinct()
        .orderBy("doc_path")
        .limit(limit)
    )


def notes_for_code(docs: DataFrame, code_paths: DataFrame) -> DataFrame:
    """Notes that reference a code path: ``code_path`` to ``code_path, doc_path, title``."""
    refs = docs.select("doc_path", "title", F.explode("ref_code_paths").alias("code_path"))
    return refs.join(broadcast_if_small(code_paths.select("code_path").distinct()), "code_path")
