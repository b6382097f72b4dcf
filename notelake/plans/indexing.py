"""Index jobs: full build, change detection, incremental build, embedding, statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.markdown import chunk_notes, parse_notes
from notelake.functions.text import content_hash, is_blank
from notelake.operators.health import repair_chunks
from notelake.operators.namespaces import with_namespace
from notelake.operators.postings import CHUNK_KEY, build_postings, chunk_lengths, lexical_rows, term_blocks
from notelake.operators.sizing import broadcast_if_small
from notelake.operators.vectors import check_dimension
from notelake.params import ChunkParams
from notelake.sources.store import State, Version, committed, compact_index, due, hide, new_folder, remove_table, visible, write_lexical, write_table

DOC_COLS = (
    "doc_id", "doc_path", "namespace", "source_kind", "title", "content_hash", "file_size",
    "mtime_ms", "frontmatter", "tags", "ref_code_paths", "ref_scalar_warning",
)
CHUNK_COLS = (
    *CHUNK_KEY, "namespace", "title", "heading_path", "start_line", "end_line", "text",
    "text_hash", "token_estimate", "tags_text", "properties_text",
)
TEXT_COLS = ("body", "body_offset", "tags_text", "properties_text")
CHANGES = "doc_path string, new_hash string, old_hash string, change_kind string"
EMBED_BATCH = 100

Embedder = Callable[[list[str]], list[list[float]]]


def prepare_docs(notes: DataFrame, namespaces: DataFrame | None = None) -> DataFrame:
    """Parsed notes with a namespace, body included. Notes without a body are left out."""
    docs = parse_notes(notes).filter(~is_blank(F.col("body")))
    if namespaces is None:
        return docs.withColumn("namespace", F.lit("root"))
    return with_namespace(docs, namespaces)


def embed_chunks(chunks: DataFrame, embedder: Embedder, batch: int = EMBED_BATCH, carry: tuple[str, ...] = ()) -> DataFrame:
    """Vectors of chunk texts: ``doc_id, chunk_index, namespace, carry, embedding``.

    The embedder gets at most ``batch`` texts per call. A failed call leaves NULL
    vectors, so the lexical side of the index stays usable; callers filter and count them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    vectors = [np.asarray(v, dtype=np.float32) for v in embedder(part.text.tolist())]
                except Exception:  # noqa: BLE001 - an embedder may fail in any way
                    vectors = [None] * len(part)
                yield part[[*CHUNK_KEY, "namespace", *carry]].assign(embedding=vectors)

    kinds = dict(chunks.dtypes)
    more = "".join(f"{c} {kinds[c]}, " for c in carry)
    return chunks.select(*CHUNK_KEY, "namespace", *carry, "text").mapInPandas(
        run, f"doc_id long, chunk_index int, namespace string, {more}embedding array<float>"
    )


def _write_version(
    spark: SparkSession,
    root: str,
    folder: str,
    origin: int,
    docs: DataFrame,
    params: ChunkParams,
    embedder: Embedder | None,
    dimension: int | None,
    known: DataFrame | None = None,
) -> tuple[Version, int | None]:
    """Write the tables one after the other, each from the one before. Notes are parsed once: documents with their bodies
    are written down, which chunks are cut from, and go when the chunks are there, so an index holds each text once.
    Returns the version and the length of its vectors.

    ``known``: documents of earlier versions, whose keys must not be those of other paths.
    """
    tables = ["docs", "chunks", "postings", "blocks", "lengths"]
    columns = [c for c in (*DOC_COLS, *TEXT_COLS) if c in docs.columns]
    numbered = docs.select(*columns, F.lit(origin).alias("origin"), F.monotonically_increasing_id().alias("doc_no"))
    parsed = write_table(numbered, root, "parsed", folder)
    held = write_table(parsed.drop(*TEXT_COLS), root, "docs", folder)
    written = held.select("doc_id", "doc_path")
    if known is not None:
        written = written.unionAll(known.select("doc_id", "doc_path").join(written.select("doc_id"), "doc_id", "left_semi"))
    check_keys(written)
    chunks = write_table(chunk_notes(parsed, params=params).select(*CHUNK_COLS, "origin", "doc_no"), root, "chunks", folder)
    remove_table(spark, root, "parsed", folder)
    total = write_lexical(chunks, root, folder)
    if embedder is not None:
        numbers = chunks.select(*CHUNK_KEY, "namespace", "text", "origin", "doc_no")
        vectors = write_table(embed_chunks(numbers, embedder, carry=("origin", "doc_no")), root, "vectors", folder)
        given = vectors.filter("embedding IS NOT NULL")
        if dimension is None:
            first = given.select(F.size("embedding").alias("n")).first()
            dimension = first.n if first else None
        if dimension is not None:
            check_dimension(given, dimension)
        tables.append("vectors")
    return Version(folder, origin, origin, origin, tuple(tables), *total), dimension


def check_keys(docs: DataFrame) -> None:
    """Raise when two paths have the same ``doc_id``, which would merge their rows."""
    paths = docs.groupBy("doc_id").agg(F.min("doc_path").alias("one"), F.max("doc_path").alias("other"))
    both = paths.filter("one <> other").first()
    if both is not None:
        raise ValueError(f"{both.one} and {both.other} have the same doc_id {both.doc_id}")


def build_index(
    notes: DataFrame,
    root: str,
    namespaces: DataFrame | None = None,
    embedder: Embedder | None = None,
    dimension: int | None = None,
    params: ChunkParams = ChunkParams(),
) -> int:
    """Full build from note files: a fresh version that replaces everything before it."""
    spark = notes.sparkSession
    docs = prepare_docs(notes, namespaces)

    def attempt(state: State) -> State:
        version = state.version + 1
        made, length = _write_version(spark, root, new_folder(version), version, docs, params, embedder, dimension)
        return State(version, length, (made,), state.batches)

    return committed(spark, root, attempt).version


def detect_changes(notes: DataFrame, docs: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """``doc_path, old_hash, new_hash, change_kind`` by content hash.

    ``dirty`` (``path``) restricts both sides to the changed paths; without it every
    note and document is compared. Kinds: added, modified, unchanged, deleted.
    """
    now = notes.select(
        F.translate("path", "\\", "/").alias("doc_path"), content_hash(F.col("content")).alias("new_hash")
    )
    held = docs.select("doc_path", F.col("content_hash").alias("old_hash"))
    if dirty is not None:
        paths = dirty.select(F.col("path").alias("doc_path")).distinct()
        now, held = now.join(paths, "doc_path", "left_semi"), held.join(paths, "doc_path", "left_semi")
    kind = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("modified")
    )
    return now.join(held, "doc_path", "full_outer").withColumn("change_kind", kind)


def update_index(
    notes: DataFrame,
    dirty: DataFrame | None,
    root: str,
    namespaces: DataFrame | None = None,
    embedder: Embedder | None = None,
    params: ChunkParams = ChunkParams(),
    batch: tuple[str, int] | None = None,
    compact: bool = True,
) -> DataFrame:
    """Incremental build: only added and modified notes are parsed again.

    Returns the change table that was applied (read back from the store). ``batch`` names a stream and one of its
    batches: the version that applies a batch carries its number, so a repeated batch finds that version and
    returns its changes. When another writer is faster, the changes are found anew against what it wrote.
    ``compact`` merges versions of about the same size when there are many.
    """
    spark = notes.sparkSession
    applied: list[DataFrame] = []

    def attempt(state: State) -> State | None:
        if not state.version:
            raise ValueError(f"no index at {root}")
        done = state.batches.get(batch[0]) if batch else None
        if done and done["batch"] >= batch[1]:
            path = f"{root}/changes/folder={done['folder']}"
            applied[:] = [spark.read.schema(CHANGES).parquet(path) if done["batch"] == batch[1] else spark.createDataFrame([], CHANGES)]
            return None
        version = state.version + 1
        folder = new_folder(version)
        held = visible(spark, root, "docs", state)
        changes = write_table(detect_changes(notes, held, dirty), root, "changes", folder)
        applied[:] = [changes]
        todo = changes.filter("change_kind IN ('added', 'modified')").select(F.col("doc_path").alias("_p"))
        # Texts stay where they are unless very many notes have changed.
        fresh = notes.join(broadcast_if_small(todo), F.translate("path", "\\", "/") == F.col("_p"), "left_semi")
        doomed = changes.filter("change_kind IN ('modified', 'deleted')").select(F.xxhash64("doc_path").alias("doc_id"))
        batches = state.batches | ({batch[0]: {"batch": batch[1], "folder": folder}} if batch else {})
        live, hiding = (state.live, []) if doomed.isEmpty() else hide(spark, root, folder, state, doomed)
        docs = prepare_docs(fresh, namespaces)
        made, dimension = _write_version(spark, root, folder, version, docs, params, embedder, state.dimension, held)
        made = replace(made, tables=(*made.tables, *hiding))
        return State(version, dimension, (*live, made), batches)

    state = committed(spark, root, attempt)
    if compact and due(state):
        compact_index(spark, root)
    return applied[0]


def delete_documents(spark: SparkSession, root: str, doc_ids: DataFrame) -> int:
    """Hide every row of the given documents."""

    def attempt(state: State) -> State:
        version = state.version + 1
        folder = new_folder(version)
        live, tables = hide(spark, root, folder, state, doc_ids)
        made = Version(folder, version, version, version, tuple(tables))
        return replace(state, version=version, live=(*live, made))

    return committed(spark, root, attempt).version


def rebuild_lexical(chunks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, block bounds and lengths of the chunks that have a document, all five
    fields included."""
    held = chunks.join(docs.select("doc_id"), "doc_id", "left_semi")
    rows = lexical_rows(held)
    postings = build_postings(rows)
    return postings, term_blocks(postings), chunk_lengths(rows)


def repair_index(spark: SparkSession, root: str) -> int:
    """Write a version without orphaned chunks and vectors whose lexical tables are made anew from the chunks."""

    def attempt(state: State) -> State:
        version = state.version + 1
        folder, tables = new_folder(version), ["docs", "chunks", "postings", "blocks", "lengths"]
        docs = write_table(visible(spark, root, "docs", state), root, "docs", folder)
        chunks = write_table(repair_chunks(visible(spark, root, "chunks", state), docs), root, "chunks", folder)
        total = write_lexical(chunks, root, folder)
        vectors = visible(spark, root, "vectors", state)
        if vectors is not None:
            write_table(vectors.join(chunks.select(*CHUNK_KEY), list(CHUNK_KEY), "left_semi"), root, "vectors", folder)
            tables.append("vectors")
        one = Version(folder, state.live[0].low, state.live[-1].high, state.version, tuple(tables), *total)
        return replace(state, version=version, live=(one,))

    return committed(spark, root, attempt).version


def index_stats(changes: DataFrame, chunks: DataFrame, lengths: DataFrame, vectors: DataFrame | None, docs: DataFrame) -> DataFrame:
    """One row of counters of an index run.

    ``chunks``, ``lengths``, ``vectors`` and ``docs`` are the rows the run wrote.
    """
    parts = [
        changes.select(F.col("change_kind").alias("_what")),
        chunks.select(F.lit("chunk")),
        lengths.select(F.lit("lexical")),
        docs.filter("ref_scalar_warning").select(F.lit("warning")),
    ]
    if vectors is not None:
        parts.append(
            vectors.select(F.when(F.col("embedding").isNull(), "failed").otherwise("vector"))
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    n = lambda *what: F.count_if(F.col("_what").isin(*what))
    return rows.agg(
        n("added", "modified").alias("docs_processed"),
        n("unchanged").alias("docs_skipped"),
        n("deleted").alias("docs_deleted"),
        n("chunk").alias("chunks_created"),
        n("lexical").alias("lexical_rows"),
        n("vector").alias("vector_rows"),
        (n("failed") > 0).alias("embedding_failed"),
        n("warning").alias("warnings"),
    )
