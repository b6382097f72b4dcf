"""Index status, consistency checks and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators.postings import CHUNK_KEY


def orphan_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Keys of chunks whose document does not exist."""
    return chunks.select(*CHUNK_KEY).join(docs.select("doc_id"), "doc_id", "left_anti")


def lexical_gaps(chunks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Keys of chunks that are missing from the lexical index."""
    return chunks.select(*CHUNK_KEY).join(lengths.select(*CHUNK_KEY), list(CHUNK_KEY), "left_anti")


def lexical_strays(chunks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Lexical rows without a chunk (an extra check)."""
    return lengths.select(*CHUNK_KEY).join(chunks.select(*CHUNK_KEY), list(CHUNK_KEY), "left_anti")


def vector_gaps(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector (an extra check)."""
    return chunks.select(*CHUNK_KEY).join(vectors.select(*CHUNK_KEY), list(CHUNK_KEY), "left_anti")


def health_report(docs: DataFrame, chunks: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: totals, number of orphans and gaps, and the verdict."""
    counts = (
        docs.select(F.lit("doc").alias("_what"))
        .unionAll(chunks.select(F.lit("chunk")))
        .unionAll(orphan_chunks(chunks, docs).select(F.lit("orphan")))
        .unionAll(lexical_gaps(chunks, lengths).select(F.lit("gap")))
    )
    total = lambda what: F.count_if(F.col("_what") == what)
    return counts.agg(
        total("doc").alias("total_docs"),
        total("chunk").alias("total_chunks"),
        total("orphan").alias("orphaned_chunks"),
        total("gap").alias("lexical_gaps"),
        ((total("orphan") == 0) & (total("gap") == 0)).alias("healthy"),
    )


def repair_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks without the orphans; the lexical tables are rebuilt from the result."""
    return chunks.join(docs.select("doc_id"), "doc_id", "left_semi")


def status_counts(docs: DataFrame, chunks: DataFrame, namespaces: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """One row of table sizes."""
    tables = [(docs, "doc"), (chunks, "chunk"), (namespaces, "namespace")]
    if cache is not None:
        tables.append((cache, "cache"))
    rows = None
    for df, what in tables:
        part = df.select(F.lit(what).alias("_what"))
        rows = part if rows is None else rows.unionAll(part)
    total = lambda what: F.count_if(F.col("_what") == what)
    return rows.agg(
        total("doc").alias("docs"),
        total("chunk").alias("chunks"),
        total("namespace").alias("namespaces"),
        total("cache").alias("cache_rows"),
    )


def docs_by_kind(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source_kind").count().orderBy(F.desc("count"), "source_kind")


def namespaces_by_name(namespaces: DataFrame) -> DataFrame:
    return namespaces.select("name", "kind").orderBy("name")


def vector_dimension(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.max(F.size("embedding")).alias("dimension"))
