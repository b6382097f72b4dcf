"""Queries over the readers: the given tables are written as files first, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import namespaces as ns
from notelake.operators.lookup import detail
from notelake.operators.sessions import truncate_at_sentence
from notelake.operators.transcripts import latest_transcript
from notelake.operators.vectors import check_dimension
from notelake.plans.search import search
from notelake.sources.files import appended_lines, write_files
from notelake.sources.notes import list_notes, read_changed_notes, read_notes, read_submodule_files
from notelake.sources.transcripts import backup_transcripts, read_transcripts
from notelake.streaming.changes import distinct_changes, run_batches
from suite.blocks import TOKENS, bm25
from suite.inputs import SENTENCES_SQL, index, new_dir, sentences, table
from suite.registry import query
from suite.search import _LEX_ONLY, _cut

_WRITTEN: dict[tuple[str, str], str] = {}
_FILE_SQL = "source || '/' || lang || '/' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_' ELSE '.' END || doc_id || '.md'"


def vault(spark, sf) -> str:
    """Every document as a file, two thirds under names that Spark hides, and some copies in hidden folders."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        root = new_dir(spark, "vault")
        d = table(spark, sf, "documents")
        mark = F.element_at(F.array(F.lit(""), F.lit("_"), F.lit(".")), (F.col("doc_id") % 3 + 1).cast("int"))
        name = F.concat(mark, F.col("doc_id").cast("string"), F.lit(".md"))
        files = d.select(F.concat_ws("/", "source", "lang", name).alias("path"), F.col("text").alias("content"))
        trash = d.filter("doc_id % 7 = 0").select(F.concat_ws("/", "source", F.lit(".trash"), name).alias("path"), F.col("text").alias("content"))
        other = d.filter("doc_id % 5 = 0").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").alias("content"))
        write_files(files.unionByName(trash).unionByName(other).repartition(8), root)
        _WRITTEN[key] = root
    return _WRITTEN[key]


@query("scan_hidden_names", f"SELECT {_FILE_SQL} AS path, strlen(text)::BIGINT AS file_size, sha256(text) AS content_hash FROM documents")
def scan_hidden_names(spark, sf):
    """All Markdown files with their texts, whatever their names begin with; hidden folders are skipped."""
    return read_notes(spark, vault(spark, sf), None).select("path", "file_size", F.sha2("content", 256).alias("content_hash"))


@query("scan_folders", f"SELECT {_FILE_SQL} AS path, strlen(text)::BIGINT AS file_size FROM documents WHERE source < 'src3'")
def scan_folders(spark, sf):
    """Listing of some folders; contents are not read."""
    d = table(spark, sf, "documents").filter("source < 'src3'").select("source").distinct()
    return list_notes(spark, vault(spark, sf), [r.source for r in d.collect()]).select("path", "file_size")


@query("scan_changed", f"SELECT {_FILE_SQL} AS path, sha256(text) AS content_hash FROM documents JOIN labels USING (doc_id)")
def scan_changed(spark, sf):
    """Only the listed files are opened; names without a file have no row."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    mark = F.element_at(F.array(F.lit(""), F.lit("_"), F.lit(".")), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat_ws("/", "source", "lang", F.concat(mark, F.col("doc_id").cast("string"), F.lit(".md")))
    listed = d.select(path.alias("path")).unionByName(d.select(F.concat("source", F.lit("/gone"), "doc_id", F.lit(".md")).alias("path")))
    return read_changed_notes(spark, vault(spark, sf), listed, None).select("path", F.sha2("content", 256).alias("content_hash"))


@query(
    "submodule_files",
    """
SELECT DISTINCT source AS repo, lang AS name, 'libs/' || lang AS path, 'https://git.example.org/' || source || '/' || lang AS url
FROM documents""",
)
def submodule_files(spark, sf):
    """One ``.gitmodules`` per source, with a submodule per language."""
    entry = F.format_string('[submodule "%s"]\n\tpath = libs/%s\n\turl = https://git.example.org/%s/%s\n', "lang", "lang", "source", "lang")
    files = table(spark, sf, "documents").select("source", "lang").distinct().groupBy("source").agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("content"))
    root = new_dir(spark, "modules")
    write_files(files.select(F.concat("source", F.lit("/.gitmodules")).alias("path"), "content"), root)
    return ns.submodules(read_submodule_files(spark, root)).select("repo", "name", "path", "url")


@query("stream_appended_lines", "SELECT DISTINCT source || '/' || doc_id || '.md' AS path FROM documents")
def stream_appended_lines(spark, sf):
    """Lists that producers write to, one per language, read as a stream by their byte offsets."""
    d = table(spark, sf, "documents").select("lang", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md\n")).alias("line"))
    work = new_dir(spark, "lines")
    write_files(d.groupBy("lang").agg(F.array_join(F.collect_list("line"), "").alias("content")).select(F.concat("lang", F.lit(".txt")).alias("path"), "content"), f"{work}/in")
    handle = lambda batch, n: distinct_changes(batch).write.mode("overwrite").parquet(f"{work}/out/batch={n}")
    run_batches(appended_lines(spark, f"{work}/in"), handle, f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out").select("path").distinct()


def _transcripts(spark, sf) -> str:
    said = table(spark, sf, "conversations").select("conv_id", F.struct("turn", F.concat_ws(" ", F.lit("turn"), "turn", "role").alias("line")).alias("t"))
    text = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["line"]), "\n"), F.lit("\n"))
    root = new_dir(spark, "transcripts")
    write_files(said.groupBy("conv_id").agg(text.alias("content")).select(F.concat(F.lit("c"), "conv_id", F.lit(".jsonl")).alias("path"), "content"), root)
    return root


@query(
    "transcript_files",
    """
SELECT 'c' || conv_id AS session, count(*) AS n_lines, sha256(string_agg('turn ' || turn || ' ' || role, '|' ORDER BY turn)) AS lines_hash
FROM conversations GROUP BY conv_id""",
)
def transcript_files(spark, sf):
    """Conversations as transcript files, read back line by line in order."""
    lines = read_transcripts(spark, _transcripts(spark, sf))
    name = F.regexp_extract("session_file", "([^/]+)\\.jsonl$", 1)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("slice", "seq", "value"))), lambda x: x["value"])
    return lines.groupBy(name.alias("session")).agg(F.count("*").alias("n_lines"), F.sha2(F.array_join(ordered, "|"), 256).alias("lines_hash"))


@query(
    "transcript_refresh",
    "SELECT 's' || conv_id AS session, count(*) AS n_lines FROM conversations GROUP BY conv_id HAVING conv_id % 3 = 0 OR max(turn) >= 4",
)
def transcript_refresh(spark, sf):
    """Transcripts that are not stored yet or have grown since are stored again as a whole."""
    lines = table(spark, sf, "conversations").select(
        F.concat(F.lit("s"), "conv_id").alias("session_file"), F.lit(0).cast("long").alias("slice"), F.col("turn").alias("seq"), F.col("text").alias("value")
    )
    stored = lines.filter("seq < 4 AND CAST(substring(session_file, 2) AS LONG) % 3 <> 0")
    return backup_transcripts(lines, stored).groupBy(F.col("session_file").alias("session")).agg(F.count("*").alias("n_lines"))


@query("latest_transcript", "SELECT arg_max(source || '/' || doc_id, n_chars * 10000000 + doc_id) AS path FROM documents")
def latest_transcript_(spark, sf):
    """Newest of a listing."""
    files = table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), "doc_id").alias("path"), F.timestamp_seconds(F.col("n_chars") * 10_000_000 + F.col("doc_id")).alias("modificationTime")
    )
    return latest_transcript(files)


@query("dimension_check", "SELECT d.dim::INT AS dim, (SELECT bool_and(len(embedding) = d.dim) FROM embeddings) AS fits FROM (VALUES (64), (63)) d(dim)")
def dimension_check(spark, sf):
    """Whether all vectors have a length."""
    vectors = table(spark, sf, "embeddings").select("embedding")

    def fits(dim):
        try:
            check_dimension(vectors, dim)
            return True
        except ValueError:
            return False

    return spark.createDataFrame([(d, fits(d)) for d in (64, 63)], "dim int, fits boolean")


@query(
    "sentence_truncate",
    """
SELECT doc_id, sha256(CASE WHEN length(text) <= 300 THEN text WHEN s <> '' THEN s ELSE h END) AS kept_hash FROM (
  SELECT doc_id, text, substring(text, 1, 300) AS h, regexp_extract(substring(text, 1, 300), '(?s)^(.*[.。!?])', 1) AS s FROM documents)""",
)
def sentence_truncate(spark, sf):
    """Texts cut at the last sentence end before 300 characters."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(truncate_at_sentence(F.col("text"), 300), 256).alias("kept_hash"))


@query(
    "detail_full",
    f"""WITH {TOKENS}, {SENTENCES_SQL}, {bm25('sentences', 50)}, {_LEX_ONLY}, {_cut('one', '(0.7::DOUBLE * lex_norm)', 'lex_norm')}
SELECT query_id, rank, doc_id, source AS title, round(score, 6) AS score, 1::BIGINT AS start_line, sha256(text) AS text_hash
FROM ranked JOIN documents USING (doc_id)""",
)
def detail_full(spark, sf):
    """Every column of a result row, its whole text included."""
    out = detail(search(sentences(spark, sf), index(spark, sf), "bm25_only").results, "full")
    return out.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "title", F.round("score", 6).alias("score"),
        F.col("start_line").cast("long").alias("start_line"), F.sha2("text", 256).alias("text_hash"),
    )


@query(
    "namespace_assign_many",
    """
SELECT 'c' || o_custkey || '/o' || o_orderkey || '/x/n.md' AS doc_path,
       CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey || '/o' || o_orderkey WHEN o_custkey % 2 = 0 THEN 'c' || o_custkey ELSE 'root' END AS namespace
FROM orders""",
)
def namespace_assign_many(spark, sf):
    """Thousands of nested namespaces: every third order's folder, and the folders of half of the customers."""
    orders = table(spark, sf, "orders")
    customer = F.concat(F.lit("c"), "o_custkey")
    folder = F.concat(customer, F.lit("/o"), "o_orderkey")
    names = orders.filter("o_orderkey % 3 = 0").select(folder.alias("name")).union(orders.filter("o_custkey % 2 = 0").select(customer)).distinct()
    return ns.with_namespace(orders.select(F.concat(folder, F.lit("/x/n.md")).alias("doc_path")), names)
