from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from notelake.operators.cache import ResultCache
from notelake.operators.health import health_report, lexical_gaps, orphan_chunks
from notelake.operators.rerank import score_with
from notelake.params import SearchParams
from notelake.plans.indexing import build_index, delete_documents, detect_changes, rebuild_lexical, update_index
from notelake.plans.search import search
from notelake.sources.store import load_index

FILES = {
    "code-notes/auth.md": (
        "# Authentication Service\n\nHandles JWT token generation and JIRA-1234 validation.\n\n"
        "## OAuth Flow\n\nOAuth2 flow implementation details."
    ),
    "code-notes/user.md": (
        "---\nref_code_paths: src/user.ts\ncategory: architecture\n---\n# User Profile\n\nUser management and avatar upload.\n\n"
        "## Settings\n\nUser preference settings."
    ),
    "services/gate/gateway.md": "# API Gateway\n\nRouting and rate limiting.\n\n## Health Check\n\nGateway health monitoring.",
    "rules/empty.md": "---\ntitle: nothing\n---\n  \n",
}


def char_vectors(texts):
    out = []
    for t in texts:
        b = sum(map(ord, t)) % 100 / 100
        out.append([b, 1 - b, b / 2, 0.1])
    return out


def notes(spark, files):
    return spark.createDataFrame([(p, len(c), 1, c) for p, c in files.items()], "path string, file_size long, mtime_ms long, content string")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    names = spark.createDataFrame([("services/gate",)], "name string")
    build_index(notes(spark, FILES), root, names, char_vectors, 4)
    return root


def queries(spark, *texts, vec=True):
    rows = [(i, t, char_vectors([t])[0] if vec else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id long, text string, embedding array<float>")


def test_full_build_counts(spark, built):
    held = load_index(spark, built)
    assert (held.docs.count(), held.chunks.count(), held.lengths.count(), held.vectors.count()) == (3, 6, 6, 6)
    assert {r.doc_path: r.namespace for r in held.docs.collect()}["services/gate/gateway.md"] == "services/gate"
    row = health_report(held.docs, held.chunks, held.lengths).first()
    assert row.healthy and row.total_docs == 3 and row.total_chunks == 6


def test_search_modes(spark, built):
    held = load_index(spark, built)
    out = search(queries(spark, "JIRA-1234", "architecture", "src/user.ts"), held)
    best = {r.query_id: r for r in out.results.filter("rank = 0").collect()}
    assert best[0].doc_path == "code-notes/auth.md" and best[0].rrf_score == best[0].score
    assert best[0].lex_norm == 0 and best[0].snippet.startswith("# Authentication")
    words = search(queries(spark, "architecture", "src/user.ts"), held, "bm25_only").results.collect()
    assert {r.query_id for r in words} == {0}
    assert max(r.score for r in words) == pytest.approx(0.7)
    near = search(queries(spark, "x"), held, "vec_only").results.orderBy("rank").collect()
    assert len(near) == 6 and near[0].score == pytest.approx(0.3)


def test_degradation(spark, built):
    held = load_index(spark, built)
    out = search(queries(spark, "gateway", vec=False), held)
    assert {r.doc_path for r in out.results.collect()} == {"services/gate/gateway.md"}
    report = out.report.first()
    assert report.mode == "bm25_only" and "no embedding" in report.warnings[0]
    none = search(queries(spark, "gateway"), replace(held, postings=None, vectors=None))
    assert none.results.count() == 0
    lex_gone = search(queries(spark, "gateway"), replace(held, postings=None))
    assert lex_gone.report.first().mode == "vec_only" and lex_gone.results.count() == 6


def test_deep_search(spark, built):
    held = load_index(spark, built)

    def expander(q):
        return q.selectExpr("query_id", "explode(sequence(1, 3)) AS variant_no").selectExpr(
            "query_id", "variant_no", "element_at(array('gateway', 'oauth', 'jwt'), variant_no) AS text",
            "array(float(0.1), float(0.9), float(0.05), float(0.1)) AS embedding",
        )

    def scorer(c):
        return c.selectExpr("query_id", "doc_id", "chunk_index", "if(text LIKE '%OAuth2%', 1.0D, 0.0D) AS score")

    asked = queries(spark, "user", "JIRA-1234")
    out = search(asked, held, "deep", expander=expander, scorer=scorer)
    report = {r.query_id: r for r in out.report.collect()}
    assert report[1].strong_signal and report[1].expanded_queries == []
    assert not report[0].strong_signal and report[0].expanded_queries == ["gateway", "oauth"]
    assert report[0].rerank_applied and report[0].total_candidates == 6
    rows = out.results.filter("query_id = 0").orderBy("rank").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert [r.rerank_score for r in rows if "OAuth2" in r.text] == [1.0]
    plain = search(asked, held, "deep", skip_expansion=True, skip_reranking=True)
    row = plain.report.filter("query_id = 0").first()
    assert row.stages[2].skip_reason == "user_requested" and row.stages[5].skip_reason == "user_requested"
    assert not row.rerank_applied
    assert all(r.score == r.rrf_score for r in plain.results.collect())
    bare = search(asked, held, "deep").report.orderBy("query_id").collect()
    assert [r.stages[2].skip_reason for r in bare] == ["llm_unavailable", "strong_signal_detected"]


def test_incremental_build(spark, tmp_path):
    root = str(tmp_path / "index")
    build_index(notes(spark, FILES), root, embedder=char_vectors)
    files = dict(FILES)
    del files["code-notes/auth.md"]
    files["code-notes/user.md"] = "# User Profile\n\nRewritten entirely with zebra."
    files["code-notes/new.md"] = "# New\n\nBrand new quagga."
    files["services/gate/gateway.md"] += "\nnot on the dirty list"
    dirty = spark.createDataFrame([(p,) for p in ("code-notes/auth.md", "code-notes/user.md", "code-notes/new.md", "code-notes/never.md")], "path string")
    changes = update_index(notes(spark, files), dirty, root, embedder=char_vectors)
    kinds = {r.doc_path: r.change_kind for r in changes.collect()}
    assert kinds == {"code-notes/auth.md": "deleted", "code-notes/user.md": "modified", "code-notes/new.md": "added"}
    held = load_index(spark, root)
    assert {r.doc_path for r in held.docs.collect()} == {"code-notes/user.md", "code-notes/new.md", "services/gate/gateway.md"}
    assert held.chunks.count() == held.vectors.count() == held.lengths.count() == 4
    found = search(queries(spark, "zebra", "avatar", "quagga", "jwt"), held, "bm25_only").results.collect()
    assert {r.query_id for r in found} == {0, 2}
    again = update_index(notes(spark, files), dirty, root, embedder=char_vectors)
    assert {r.change_kind for r in again.collect()} == {"unchanged"}
    assert load_index(spark, root).chunks.count() == 4
    delete_documents(spark, root, held.docs.filter("doc_path LIKE '%new.md'"))
    assert load_index(spark, root).docs.count() == 2


def test_change_kinds_over_everything(spark, built):
    held = load_index(spark, built)
    files = {**FILES, "x.md": "new"}
    kinds = {r.doc_path: r.change_kind for r in detect_changes(notes(spark, files), held.docs).collect()}
    assert kinds["x.md"] == "added" and kinds["code-notes/auth.md"] == "unchanged"


def test_failed_embedding_leaves_words_searchable(spark, tmp_path):
    def broken(texts):
        raise RuntimeError("down")

    root = str(tmp_path / "index")
    build_index(notes(spark, FILES), root, embedder=broken)
    held = load_index(spark, root)
    assert held.vectors.filter("embedding IS NOT NULL").count() == 0
    assert search(queries(spark, "gateway"), held, "bm25_only").results.count() > 0
    with pytest.raises(ValueError, match="dimension"):
        build_index(notes(spark, FILES), str(tmp_path / "other"), embedder=char_vectors, dimension=5)


def test_health_and_rebuild(spark, built):
    held = load_index(spark, built)
    docs = held.docs.filter("doc_path <> 'code-notes/auth.md'")
    lengths = held.lengths.filter("chunk_index = 0")
    assert orphan_chunks(held.chunks, docs).count() == 2
    assert lexical_gaps(held.chunks, lengths).count() == 3
    assert not health_report(docs, held.chunks, lengths).first().healthy
    postings, blocks, fresh = rebuild_lexical(held.chunks, docs)
    assert fresh.count() == 4
    assert postings.filter("term = 'architecture' AND tf_properties = 1").count() == 2
    assert blocks.filter("term = 'jwt'").count() == 0


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        SearchParams(lexical_weight=0.5)
    with pytest.raises(ValueError):
        SearchParams(fusion="other")
    assert SearchParams(top_k=4).candidate_k == 20


def test_deep_search_degrades_and_warns(spark, built):
    held = load_index(spark, built)
    asked = queries(spark, "user", "JIRA-1234")

    def broken(rows):
        raise RuntimeError("model is down\nsecond line")

    out = search(asked, held, "deep", expander=broken, scorer=broken)
    warned = {r.query_id: r.warnings for r in out.report.collect()}
    assert warned[0] == ["Query expansion failed: model is down", "Re-ranking failed: model is down"]
    assert not out.report.first().rerank_applied and out.results.count() > 0
    words = search(queries(spark, "gateway", vec=False), held, "deep")
    assert words.report.first().warnings == ['Vector search failed for query "gateway": the query has no embedding']
    assert {r.doc_path for r in words.results.collect()} == {"services/gate/gateway.md"}
    near = search(asked, replace(held, postings=None), "deep", skip_expansion=True)
    assert near.results.filter("query_id = 0").count() == 6 and "no lexical index" in near.report.first().warnings[0]
    none = search(asked, replace(held, postings=None, vectors=None), "deep")
    assert none.results.count() == 0 and len(none.report.first().warnings) == 3


def test_deep_search_cache(spark, built, tmp_path):
    held, calls = load_index(spark, built), spark.sparkContext.accumulator(0)

    def scorer(rows):
        def one(text, texts):
            calls.add(1)
            return [len(t) % 7 / 7 for t in texts]

        return score_with(rows, one)

    asked = queries(spark, "user", "user", "management")
    cache = ResultCache(str(tmp_path / "cache"), 1000, ttl_ms=50)
    plain = sorted(search(asked, held, "deep", scorer=scorer).results.select("query_id", "doc_id", "chunk_index", "score").collect())
    before = calls.value
    first = sorted(search(asked, held, "deep", scorer=scorer, cache=cache).results.select("query_id", "doc_id", "chunk_index", "score").collect())
    assert first == plain and calls.value - before == 2  # two of the three queries are the same
    again = sorted(search(asked, held, "deep", scorer=scorer, cache=replace(cache, now_ms=1050)).results.select("query_id", "doc_id", "chunk_index", "score").collect())
    assert again == plain and calls.value - before == 2
    search(asked, held, "deep", scorer=scorer, cache=replace(cache, now_ms=1051)).results.collect()
    assert calls.value - before == 4  # expired entries do not count


def test_a_failed_job_is_no_result(spark, built):
    """A model function may fail; a job that fails for another reason must not look like a search without the model."""
    held, asked = load_index(spark, built), queries(spark, "user", "JIRA-1234")

    def no_disk(rows):
        return rows.select("query_id", F.lit(1).alias("variant_no"), F.raise_error(F.lit("the disk is full")).cast("string").alias("text"))

    def no_scores(rows):
        return rows.select("query_id", "doc_id", "chunk_index", F.raise_error(F.lit("the disk is full")).cast("double").alias("score"))

    def worker(message):
        def fail(text):
            raise RuntimeError(message)

        return lambda rows: rows.select("query_id", F.lit(1).alias("variant_no"), F.udf(fail, "string")("text").alias("text"))

    for models in ({"expander": no_disk}, {"scorer": no_scores}, {"expander": worker("[Errno 28] No space left on device")}):
        with pytest.raises(Exception, match="the disk is full|No space left"):
            search(asked, held, "deep", **models)
    assert "Query expansion failed" in search(asked, held, "deep", expander=worker("model is down")).report.first().warnings[0]
    with pytest.raises(Exception, match="model is down"):
        search(asked, held, "deep", expander=worker("model is down"), strict=True)
