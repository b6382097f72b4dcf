"""Inputs of the registered queries, all derived from the given tables.

Every document is one chunk of a note: ``source`` is the title, ``lang`` the
heading path and the namespace, ``text`` the body. ``source/lang/doc_id.md`` is its path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.text import content_hash, token_estimate
from notelake.sources.store import NoteIndex, State, Version, commit, load_index, new_folder, write_lexical, write_table
from notelake.sources.workdir import work_dir

DOC_PATH_SQL = "source || '/' || lang || '/' || doc_id || '.md'"
_BUILT: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def doc_path() -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        doc_path().alias("doc_path"),
        F.col("source").alias("title"),
        F.col("lang").alias("namespace"),
        F.col("source").alias("source_kind"),
        content_hash(F.col("text")).alias("content_hash"),
        F.array(F.concat(F.lit("src/"), "source", F.lit(".ts"))).alias("ref_code_paths"),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "documents")
        .select(
            "doc_id",
            F.col("source").alias("title"),
            F.col("lang").alias("heading_path"),
            F.col("lang").alias("namespace"),
            F.posexplode(F.array("text")).alias("chunk_index", "text"),
        )
        .select(
            "doc_id",
            "chunk_index",
            "title",
            "heading_path",
            "namespace",
            F.lit(1).alias("start_line"),
            (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("end_line"),
            "text",
            token_estimate(F.col("text")).alias("token_estimate"),
        )
    )


def lexical_rows(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select(
        "doc_id", "chunk_index", "title", "heading_path", F.col("text").alias("body"), "namespace"
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the documents that have one."""
    named = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("namespace"))
    return (
        table(spark, sf, "embeddings")
        .select(F.col("vec_id").alias("doc_id"), F.posexplode(F.array("embedding")).alias("chunk_index", "embedding"))
        .join(named, "doc_id")
    )


def index(spark: SparkSession, sf: str) -> NoteIndex:
    """The document index in the working folder, written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        root, folder = new_dir(spark, "index"), new_folder(1)
        keyed = lambda df: df.withColumns({"origin": F.lit(1), "doc_no": F.col("doc_id")})
        write_table(keyed(docs(spark, sf)), root, "docs", folder)
        held = write_table(keyed(chunks(spark, sf)), root, "chunks", folder)
        total = write_lexical(held.withColumnRenamed("text", "body"), root, folder)
        write_table(keyed(vectors(spark, sf)), root, "vectors", folder)
        names = ("docs", "chunks", "postings", "blocks", "lengths", "vectors")
        commit(spark, root, State(1, 64, (Version(folder, 1, 1, 1, names, *total),)))
        _BUILT[key] = root
    return load_index(spark, _BUILT[key])


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence of the benchmark passages as a query, with a query vector.

    All sentences of item n carry vector n.
    """
    said = (
        table(spark, sf, "benchmark")
        .select("item_id", F.posexplode(F.split("text", "[.\n]+")).alias("_i", "text"))
        .filter(F.trim("text") != "")
        .select("item_id", (F.col("item_id") * 1000 + F.col("_i")).alias("query_id"), "text")
    )
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return said.join(vec, "item_id", "left")


SENTENCES_SQL = """
sentences AS (
  SELECT item_id, item_id * 1000 + i AS query_id, s AS text
  FROM (SELECT item_id, unnest(l) AS s, unnest(range(len(l))) AS i
        FROM (SELECT item_id, string_split_regex(text, '[.\\n]+') AS l FROM benchmark))
  WHERE trim(s) <> ''
)"""

# Query texts for phrase search: plain words, hyphens, dots, quotes, repeated
# words, separators without any token.
TEXTS = [
    (1, "the of", None),
    (2, "BY-NC 4.0", None),
    (3, "de la", "fr"),
    (4, "und -- der", "de"),
    (5, "of-the", None),
    (6, "src3", None),
    (7, 'that "is"', "en"),
    (8, "the the and", None),
    (9, "2.0.", None),
    (10, "é de-la", "es"),
    (11, "in-the of", "en"),
    (12, "...", None),
]


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "query_id long, text string, namespace string")


def _quoted(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


TEXTS_SQL = (
    "texts(query_id, text, namespace) AS (VALUES "
    + ", ".join(f"({i}, {_quoted(t)}, {_quoted(n)})" for i, t, n in TEXTS)
    + ")"
)
