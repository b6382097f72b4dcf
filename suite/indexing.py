"""Queries over the index jobs: change detection, builds, statistics, embedding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from notelake.operators.health import health_report
from notelake.plans.indexing import (
    build_index,
    delete_documents,
    detect_changes,
    embed_chunks,
    index_stats,
    update_index,
)
from notelake.sources.store import compact_index, load_index, read_state
from suite.inputs import DOC_PATH_SQL, chunks, new_dir, table
from suite.notes import plain_notes
from suite.registry import query

# The stored state lacks Spanish documents; the new scan lacks German ones and
# has other French texts.


def stored_notes(spark, sf):
    return plain_notes(spark, sf).filter(~F.col("path").contains("/es/"))


def scanned_notes(spark, sf):
    french = F.col("path").contains("/fr/")
    return plain_notes(spark, sf).filter(~F.col("path").contains("/de/")).withColumn(
        "content", F.when(french, F.concat("content", F.lit("\nchanged"))).otherwise(F.col("content"))
    )


_CHANGES = f"""
changes AS (
  SELECT {DOC_PATH_SQL} AS doc_path, CASE WHEN lang <> 'es' THEN sha256(text) END AS old_hash,
         CASE lang WHEN 'de' THEN NULL WHEN 'fr' THEN sha256(text || chr(10) || 'changed') ELSE sha256(text) END AS new_hash,
         CASE lang WHEN 'es' THEN 'added' WHEN 'de' THEN 'deleted' WHEN 'fr' THEN 'modified' ELSE 'unchanged' END AS change_kind
  FROM documents
)"""


@query("change_detection", f"WITH {_CHANGES} SELECT * FROM changes")
def change_detection(spark, sf):
    from notelake.functions.markdown import parse_notes

    return detect_changes(scanned_notes(spark, sf), parse_notes(stored_notes(spark, sf)))


@query(
    "change_detection_dirty",
    f"WITH {_CHANGES} SELECT * FROM changes WHERE doc_path IN (SELECT {DOC_PATH_SQL} FROM documents JOIN labels USING (doc_id))",
)
def change_detection_dirty(spark, sf):
    """Only the labelled documents are on the dirty list."""
    from notelake.functions.markdown import parse_notes

    listed = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    dirty = listed.select(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".md"))).alias("path"))
    return detect_changes(scanned_notes(spark, sf), parse_notes(stored_notes(spark, sf)), dirty)


def char_sum_vectors(texts: list[str]) -> list[list[float]]:
    """Deterministic vector of a text: character codes modulo 100."""
    out = []
    for text in texts:
        base = int(np.frombuffer(text.encode("utf-16-le"), dtype=np.uint16).sum(dtype=np.int64)) % 100 / 100
        out.append([base, 1 - base, base / 2, 0.1])
    return out


@query(
    "embed_batch",
    """
SELECT doc_id, round(b, 4) AS v0, round(1 - b, 4) AS v1, round(b / 2, 4) AS v2 FROM (
  SELECT doc_id, (list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))) % 100)::DOUBLE / 100 AS b FROM documents)""",
)
def embed_batch(spark, sf):
    """Embedding of every document text by a user function, at most 100 per call."""
    v = embed_chunks(chunks(spark, sf).repartition("doc_id"), char_sum_vectors)
    part = lambda i: F.round(F.col("embedding")[i].cast("double"), 4)
    return v.select("doc_id", part(0).alias("v0"), part(1).alias("v1"), part(2).alias("v2"))


def _updated(spark, sf):
    root = new_dir(spark, "update")
    build_index(stored_notes(spark, sf), root, embedder=char_sum_vectors, dimension=4)
    changes = update_index(scanned_notes(spark, sf), None, root, embedder=char_sum_vectors)
    return root, changes


@query(
    "index_update",
    f"""WITH {_CHANGES} SELECT doc_path, new_hash AS content_hash FROM changes WHERE new_hash IS NOT NULL""",
)
def index_update(spark, sf):
    """Full build, then an incremental one: the documents a reader sees."""
    root, _ = _updated(spark, sf)
    return load_index(spark, root).docs.select("doc_path", "content_hash")


@query(
    "index_update_health",
    """
SELECT count(*) AS total_docs, 0::BIGINT AS orphaned_chunks, 0::BIGINT AS lexical_gaps, TRUE AS healthy
FROM documents WHERE lang <> 'de'""",
)
def index_update_health(spark, sf):
    root, _ = _updated(spark, sf)
    held = load_index(spark, root)
    return health_report(held.docs, held.chunks, held.lengths).drop("total_chunks")


@query(
    "index_stats",
    f"""WITH {_CHANGES}
SELECT count(*) FILTER (change_kind IN ('added', 'modified')) AS docs_processed,
       count(*) FILTER (change_kind = 'unchanged') AS docs_skipped,
       count(*) FILTER (change_kind = 'deleted') AS docs_deleted, FALSE AS embedding_failed, 0::BIGINT AS warnings,
       TRUE AS equal_rows
FROM changes""",
)
def run_stats(spark, sf):
    """Counters of the incremental run; chunk, lexical and vector rows are equal in number."""
    root, changes = _updated(spark, sf)
    folder = read_state(spark, root).live[-1].folder
    wrote = {t: spark.read.parquet(f"{root}/{t}/folder={folder}") for t in ("docs", "chunks", "lengths", "vectors")}
    stats = index_stats(changes, wrote["chunks"], wrote["lengths"], wrote["vectors"], wrote["docs"])
    same = (F.col("chunks_created") == F.col("lexical_rows")) & (F.col("chunks_created") == F.col("vector_rows"))
    return stats.withColumn("equal_rows", same & (F.col("chunks_created") >= F.col("docs_processed"))).drop(
        "chunks_created", "lexical_rows", "vector_rows"
    )


@query(
    "index_delete",
    f"SELECT {DOC_PATH_SQL} AS doc_path FROM documents WHERE lang NOT IN ('es', 'fr')",
)
def index_delete(spark, sf):
    """Deleting documents hides their rows in every table."""
    root = new_dir(spark, "delete")
    build_index(stored_notes(spark, sf), root)
    gone = load_index(spark, root).docs.filter(F.col("doc_path").contains("/fr/"))
    delete_documents(spark, root, gone)
    held = load_index(spark, root)
    in_postings = held.postings.select("doc_id").distinct()
    in_chunks = held.chunks.select("doc_id").distinct()
    return held.docs.join(in_postings, "doc_id", "left_semi").join(in_chunks, "doc_id", "left_semi").select("doc_path")


@query(
    "index_compact",
    f"""WITH {_CHANGES}, held AS (SELECT * FROM documents WHERE lang <> 'de'),
changed AS (SELECT doc_id, lang, text || CASE lang WHEN 'fr' THEN chr(10) || 'changed' ELSE '' END AS text FROM held)
SELECT lang AS namespace, count(*) AS docs, TRUE AS merged, sum(length(text))::BIGINT AS chars FROM changed GROUP BY 1""",
)
def index_compact(spark, sf):
    """A full build, a delta per source folder, then the merge: what readers see, and that folders became fewer."""
    root = new_dir(spark, "compact")
    build_index(stored_notes(spark, sf), root)
    notes = scanned_notes(spark, sf)
    folders = [r.top for r in notes.select(F.split("path", "/")[0].alias("top")).distinct().orderBy("top").collect()]
    groups = [folders[i::6] for i in range(6)]
    paths = notes.select("path").union(stored_notes(spark, sf).select("path")).distinct()
    for names in groups:
        dirty = paths.filter(F.split("path", "/")[0].isin(names))
        update_index(notes.filter(F.split("path", "/")[0].isin(names)), dirty, root, compact=False)
    before = len(read_state(spark, root).live)
    after = len(compact_index(spark, root).live)
    held = load_index(spark, root)
    texts = notes.select(F.xxhash64("path").alias("doc_id"), F.length("content").alias("chars"))
    return (
        held.docs.join(held.lengths.select("doc_id").distinct(), "doc_id").join(texts, "doc_id")
        .groupBy(F.element_at(F.split("doc_path", "/"), -2).alias("namespace"))
        .agg(F.count("*").alias("docs"), F.lit(after < before and after <= 4).alias("merged"), F.sum("chars").cast("long").alias("chars"))
    )
