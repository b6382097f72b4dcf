"""Queries over lookups, contexts, namespaces and index health."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import contexts as ctx
from notelake.operators import health, lookup
from notelake.operators import namespaces as ns
from suite.inputs import DOC_PATH_SQL, chunks, docs, index, table
from suite.registry import query

# ---- lookups ----


@query(
    "doc_chunks",
    f"""
SELECT doc_id, {DOC_PATH_SQL} AS doc_path, 0::BIGINT AS chunk_index, 1::BIGINT AS n_chunks, sha256(text) AS text_hash
FROM documents WHERE {DOC_PATH_SQL} = (SELECT max({DOC_PATH_SQL}) FROM documents)""",
)
def doc_chunks(spark, sf):
    held = index(spark, sf)
    last = held.docs.agg(F.max("doc_path")).first()[0]
    return lookup.document_chunks(held.chunks, held.docs, last).select(
        "doc_id", "doc_path", F.col("chunk_index").cast("long").alias("chunk_index"), "n_chunks",
        F.sha2("text", 256).alias("text_hash"),
    )


@query(
    "chunk_by_id",
    f"SELECT doc_id, {DOC_PATH_SQL} AS doc_path, source AS title, text FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)",
)
def chunk_by_id(spark, sf):
    held = index(spark, sf)
    last = held.chunks.agg(F.max("doc_id")).first()[0]
    return lookup.chunk_by_id(held.chunks, held.docs, last, 0).select("doc_id", "doc_path", "title", "text")


@query(
    "multi_get",
    f"""
SELECT l.doc_id * 3 AS doc_id, d.doc_id IS NOT NULL AS found
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 3""",
)
def multi_get(spark, sf):
    """Ids that partly do not exist: which ones were found."""
    ids = table(spark, sf, "labels").select((F.col("doc_id") * 3).alias("doc_id"), F.lit(0).alias("chunk_index"))
    held = index(spark, sf)
    return lookup.get_chunks(held.chunks, held.docs, ids)[1].select("doc_id", "found")


@query(
    "multi_get_chunks",
    f"""
SELECT doc_id, {DOC_PATH_SQL} AS doc_path, sha256(text) AS text_hash FROM documents
WHERE doc_id IN (SELECT doc_id * 3 FROM labels)""",
)
def multi_get_chunks(spark, sf):
    ids = table(spark, sf, "labels").select((F.col("doc_id") * 3).alias("doc_id"), F.lit(0).alias("chunk_index"))
    held = index(spark, sf)
    return lookup.get_chunks(held.chunks, held.docs, ids)[0].select(
        "doc_id", "doc_path", F.sha2("text", 256).alias("text_hash")
    )


@query(
    "multi_get_paths",
    f"""
SELECT {DOC_PATH_SQL} AS doc_path, 0::BIGINT AS chunk_index, source AS title, sha256(text) AS text_hash
FROM documents JOIN labels USING (doc_id) WHERE quality = 0""",
)
def multi_get_paths(spark, sf):
    held = index(spark, sf)
    bad = table(spark, sf, "labels").filter("quality = 0").select("doc_id")
    paths = held.docs.join(bad, "doc_id").select("doc_path")
    return lookup.get_documents(held.chunks, held.docs, paths).select(
        "doc_path", F.col("chunk_index").cast("long").alias("chunk_index"), "title",
        F.sha2("text", 256).alias("text_hash"),
    )


@query(
    "path_like",
    f"""
SELECT DISTINCT {DOC_PATH_SQL} AS doc_path, source AS title FROM documents
WHERE {DOC_PATH_SQL} ILIKE 'SRC1_/En/%' ORDER BY 1 LIMIT 20""",
)
def path_like(spark, sf):
    return lookup.documents_like(index(spark, sf).docs, "SRC1_/En/%")


@query(
    "code_refs",
    f"""
SELECT 'src/' || source || '.ts' AS code_path, {DOC_PATH_SQL} AS doc_path, source AS title
FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) >= (SELECT avg(c) FROM (SELECT count(*) AS c FROM documents GROUP BY source)))""",
)
def code_refs(spark, sf):
    """Notes that mention the code of sources with at least the average number of notes."""
    per = table(spark, sf, "documents").groupBy("source").count()
    busy = per.filter(F.col("count") >= per.agg(F.avg("count")).scalar())
    code = busy.select(F.concat(F.lit("src/"), "source", F.lit(".ts")).alias("code_path"))
    return lookup.notes_for_code(index(spark, sf).docs, code).select("code_path", "doc_path", "title")


@query(
    "enrich_results",
    f"""
SELECT doc_id, {DOC_PATH_SQL} AS doc_path, source AS title, lang AS heading_path, 1::BIGINT AS start_line,
       (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS end_line, quality::DOUBLE AS score,
       CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS snippet
FROM labels JOIN documents USING (doc_id)""",
)
def enrich_results(spark, sf):
    """Labelled documents as result rows; ids without a document are dropped."""
    results = table(spark, sf, "labels").select(
        "doc_id", F.lit(0).alias("chunk_index"), F.col("quality").cast("double").alias("score")
    )
    held = index(spark, sf)
    out = lookup.enrich_results(results, held.chunks, held.docs)
    return out.select(
        "doc_id", "doc_path", "title", "heading_path", F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"), "score", "snippet",
    )


# ---- contexts: descriptions of sources and of source/language folders ----

_CONTEXTS = """
contexts AS (
  SELECT source AS virtual_path, 'source ' || source AS description, min(doc_id) AS created_at FROM documents GROUP BY source
  UNION ALL
  SELECT source || '/' || lang, lang || ' notes', min(doc_id) FROM documents WHERE lang <> 'en' GROUP BY source, lang
)"""


def contexts(spark, sf):
    d = table(spark, sf, "documents")
    top = d.groupBy("source").agg(F.min("doc_id").alias("created_at")).select(
        F.col("source").alias("virtual_path"), F.concat(F.lit("source "), "source").alias("description"), "created_at"
    )
    below = d.filter("lang <> 'en'").groupBy("source", "lang").agg(F.min("doc_id").alias("created_at")).select(
        F.concat_ws("/", "source", "lang").alias("virtual_path"), F.concat("lang", F.lit(" notes")).alias("description"), "created_at"
    )
    return top.unionByName(below).withColumn("updated_at", F.col("created_at"))


@query(
    "context_ancestors",
    f"""WITH {_CONTEXTS}
SELECT {DOC_PATH_SQL} AS path, virtual_path, description,
       CASE WHEN virtual_path = source THEN 2::BIGINT ELSE 1::BIGINT END AS depth
FROM documents JOIN contexts ON virtual_path IN (source, source || '/' || lang)""",
)
def context_ancestors(spark, sf):
    """Contexts of every document path; paths carry a scheme and slashes."""
    paths = index(spark, sf).docs.select(F.concat(F.lit("kb:///"), "doc_path", F.lit("/")).alias("path"))
    found = ctx.applicable_contexts(paths, contexts(spark, sf))
    return found.select(
        F.regexp_replace("path", "^kb:///|/$", "").alias("path"), "virtual_path", "description",
        F.col("depth").cast("long").alias("depth"),
    )


@query(
    "context_for_docs",
    f"""WITH {_CONTEXTS}
SELECT {DOC_PATH_SQL} AS path, string_agg(virtual_path || ': ' || description, ' | ' ORDER BY length(virtual_path) DESC) AS contexts
FROM documents JOIN contexts ON virtual_path IN (source, source || '/' || lang) GROUP BY 1""",
)
def context_for_docs(spark, sf):
    paths = index(spark, sf).docs.select(F.col("doc_path").alias("path"))
    return ctx.context_lines(paths, contexts(spark, sf)).select(
        "path", F.array_join("contexts", " | ").alias("contexts")
    )


@query(
    "context_upsert",
    f"""WITH {_CONTEXTS}, change AS (
  SELECT DISTINCT source || '/' || lang AS virtual_path, 'updated ' || lang AS description FROM documents)
SELECT virtual_path, coalesce(c.description, o.description) AS description,
       coalesce(o.created_at, 1000000)::BIGINT AS created_at,
       CASE WHEN c.virtual_path IS NULL THEN o.created_at ELSE 1000000 END::BIGINT AS updated_at
FROM contexts o FULL JOIN change c USING (virtual_path)""",
)
def context_upsert(spark, sf):
    """New descriptions for every source/language folder; old ones keep their creation time."""
    changes = table(spark, sf, "documents").select(
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/")).alias("virtual_path"),
        F.concat(F.lit("updated "), "lang").alias("description"),
        F.lit(1_000_000).cast("long").alias("at"),
    ).distinct()
    return ctx.upsert_contexts(contexts(spark, sf), changes)


@query(
    "context_remove",
    f"""WITH {_CONTEXTS}, gone AS (SELECT DISTINCT source || '/' || lang AS virtual_path FROM documents)
SELECT virtual_path, virtual_path IN (SELECT virtual_path FROM contexts) AS removed, NULL AS description FROM gone
UNION ALL SELECT virtual_path, NULL, description FROM contexts WHERE virtual_path NOT IN (SELECT virtual_path FROM gone)""",
)
def context_remove(spark, sf):
    paths = table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("virtual_path"))
    left, found = ctx.remove_contexts(contexts(spark, sf), paths)
    return found.unionByName(left.select("virtual_path", "description"), True)


@query(
    "context_list",
    f"WITH {_CONTEXTS} SELECT virtual_path, description, created_at FROM contexts ORDER BY 1",
)
def context_list(spark, sf):
    return ctx.list_contexts(contexts(spark, sf)).drop("updated_at")


@query(
    "search_contexts",
    f"""WITH {_CONTEXTS}, c AS (
SELECT {DOC_PATH_SQL} AS doc_path, string_agg(virtual_path || ': ' || description, ' | ' ORDER BY length(virtual_path) DESC) AS contexts
FROM documents JOIN contexts ON virtual_path IN (source, source || '/' || lang) GROUP BY 1)
SELECT doc_id, doc_path, contexts FROM labels JOIN documents USING (doc_id) JOIN c ON c.doc_path = {DOC_PATH_SQL}""",
)
def search_contexts(spark, sf):
    """Contexts attached to result rows."""
    rows = table(spark, sf, "labels").join(index(spark, sf).docs, "doc_id").select("doc_id", "doc_path")
    return lookup.attach_contexts(rows, contexts(spark, sf)).withColumn("contexts", F.array_join("contexts", " | "))


# ---- namespaces: every source is a repository with three submodules ----


def module_files(spark, sf):
    """A submodule file per source; the module named after a language exists as a
    directory when the source has documents in that language."""
    section = lambda name, rest: F.concat(
        F.lit(f'[submodule "{name}"]\n\tpath = {name}\n'), F.lit(rest)
    )
    content = F.concat(
        section("es", "\turl = https://git.example.com/es.git\n\tbranch = main\n"),
        section("it", "  url=https://git.example.com/it.git\n"),
        section("broken", "\tbranch = main\n"),
        section("fr", "\turl = https://git.example.com/old.git\n\turl = https://git.example.com/fr.git"),
    )
    return table(spark, sf, "documents").select("source").distinct().select(
        F.col("source").alias("repo"), content.alias("content")
    )


def repo_directories(spark, sf):
    files = table(spark, sf, "documents").select(
        F.col("source").alias("repo"), F.concat_ws("/", "lang", F.concat("doc_id", F.lit(".md"))).alias("path")
    )
    services = table(spark, sf, "documents").select(
        F.col("source").alias("repo"), F.concat(F.lit("services/"), "lang", F.lit("/src/x.md")).alias("path")
    )
    return ns.directories_of(files.unionByName(services))


@query(
    "submodules",
    """
SELECT DISTINCT source AS repo, name, name AS path, 'https://git.example.com/' || name || '.git' AS url,
       CASE name WHEN 'es' THEN 'main' END AS branch
FROM documents, (VALUES ('es'), ('it'), ('fr')) v(name)""",
)
def submodules(spark, sf):
    return ns.submodules(module_files(spark, sf)).drop("section")


@query(
    "submodule_warnings",
    """
SELECT repo, path, 'declared submodule ' || path || ' has no directory; fetch it with git submodule update --init ' || path AS warning
FROM (SELECT DISTINCT source AS repo, path FROM documents, (VALUES ('es'), ('it'), ('fr')) v(path))
WHERE (repo, path) NOT IN (SELECT (source, lang) FROM documents)""",
)
def submodule_warnings(spark, sf):
    return ns.submodule_warnings(ns.submodules(module_files(spark, sf)), repo_directories(spark, sf))


@query(
    "namespace_list",
    """
SELECT DISTINCT source AS repo, 'root' AS name, 'root' AS kind, NULL AS git_url FROM documents
UNION ALL SELECT DISTINCT source, lang, 'submodule', 'https://git.example.com/' || lang || '.git' FROM documents WHERE lang IN ('es', 'it', 'fr')
UNION ALL SELECT DISTINCT source, 'services/' || lang, 'directory', NULL FROM documents""",
)
def namespace_list(spark, sf):
    files = module_files(spark, sf)
    return ns.list_namespaces(files.select("repo"), ns.submodules(files), repo_directories(spark, sf))


@query(
    "namespace_assign",
    f"""
SELECT {DOC_PATH_SQL} AS path,
       CASE WHEN lang = 'en' THEN source WHEN lang = 'es' THEN source || '/es' WHEN source > 'src5' THEN 'root' ELSE source END AS namespace
FROM (SELECT * FROM documents WHERE source <= 'src5' OR lang <> 'en')
UNION ALL SELECT {DOC_PATH_SQL}, 'root' FROM documents WHERE source > 'src5' AND lang = 'en'""",
)
def namespace_assign(spark, sf):
    """Longest prefix: sources up to ``src5`` and all Spanish folders are namespaces."""
    d = table(spark, sf, "documents")
    names = d.filter("source <= 'src5'").select(F.col("source").alias("name")).unionByName(
        d.filter("lang = 'es'").select(F.concat_ws("/", "source", "lang").alias("name"))
    ).distinct()
    paths = index(spark, sf).docs.select(F.col("doc_path").alias("path"))
    return ns.assign_namespaces(paths, names)


# ---- health: documents of one language are missing, the index lacks another ----


def _partial(spark, sf):
    held = index(spark, sf)
    some_docs = held.docs.filter("namespace <> 'es'")
    codes = held.chunks.filter("namespace <> 'fr'").select("doc_id", "chunk_index")
    lengths = held.lengths.join(codes, ["doc_id", "chunk_index"], "left_semi")
    return some_docs, held.chunks, lengths


@query("orphan_chunks", "SELECT doc_id, 0::BIGINT AS chunk_index FROM documents WHERE lang = 'es'")
def orphan_chunks(spark, sf):
    some_docs, held, _ = _partial(spark, sf)
    return health.orphan_chunks(held, some_docs).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("lexical_gaps", "SELECT doc_id, 0::BIGINT AS chunk_index FROM documents WHERE lang = 'fr'")
def lexical_gaps(spark, sf):
    _, held, lengths = _partial(spark, sf)
    return health.lexical_gaps(held, lengths).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("vector_gaps", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_gaps(spark, sf):
    held = index(spark, sf)
    return health.vector_gaps(held.chunks, held.vectors).select("doc_id")


@query(
    "health_report",
    """
SELECT count(*) FILTER (lang <> 'es') AS total_docs, count(*) AS total_chunks,
       count(*) FILTER (lang = 'es') AS orphaned_chunks, count(*) FILTER (lang = 'fr') AS lexical_gaps, FALSE AS healthy
FROM documents""",
)
def health_report(spark, sf):
    some_docs, held, lengths = _partial(spark, sf)
    return health.health_report(some_docs, held, lengths)


@query(
    "health_after_repair",
    """
SELECT count(*) FILTER (lang <> 'es') AS total_docs, count(*) FILTER (lang <> 'es') AS total_chunks,
       0::BIGINT AS orphaned_chunks, 0::BIGINT AS lexical_gaps, TRUE AS healthy
FROM documents""",
)
def health_after_repair(spark, sf):
    from notelake.operators.postings import chunk_lengths

    some_docs, held, _ = _partial(spark, sf)
    kept = health.repair_chunks(held, some_docs)
    return health.health_report(some_docs, kept, chunk_lengths(kept.withColumnRenamed("text", "body")))


@query(
    "status_counts",
    """
SELECT count(*) AS docs, count(*) AS chunks, count(DISTINCT lang) AS namespaces,
       (SELECT count(*) FROM benchmark) AS cache_rows FROM documents""",
)
def status_counts(spark, sf):
    held = index(spark, sf)
    names = held.docs.select("namespace").distinct()
    return health.status_counts(held.docs, held.chunks, names, table(spark, sf, "benchmark"))


@query("status_by_kind", "SELECT source AS source_kind, count(*) AS count FROM documents GROUP BY 1")
def status_by_kind(spark, sf):
    return health.docs_by_kind(docs(spark, sf))


@query(
    "namespaces_by_name",
    "SELECT DISTINCT lang AS name, 'directory' AS kind FROM documents ORDER BY 1",
)
def namespaces_by_name(spark, sf):
    names = docs(spark, sf).select(F.col("namespace").alias("name"), F.lit("directory").alias("kind"))
    return health.namespaces_by_name(names.distinct())


@query("vector_dimension", "SELECT max(len(embedding))::BIGINT AS dimension FROM embeddings")
def vector_dimension(spark, sf):
    return health.vector_dimension(table(spark, sf, "embeddings")).select(F.col("dimension").cast("long"))


@query(
    "candidate_texts",
    f"""
SELECT doc_id, substring(text, 1, 500) AS text FROM labels JOIN documents USING (doc_id)""",
)
def candidate_texts(spark, sf):
    """Texts for a scorer, cut to 500 characters."""
    from notelake.operators.rerank import rerank_inputs

    ids = table(spark, sf, "labels").select("doc_id", F.lit(0).alias("chunk_index"))
    return rerank_inputs(ids, chunks(spark, sf)).select("doc_id", "text")
