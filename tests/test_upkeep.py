from pyspark.sql import functions as F

from notelake.functions.paths import ancestors, normalize_path
from notelake.operators import contexts as ctx
from notelake.operators import namespaces as ns
from notelake.operators.lookup import documents_like, parse_chunk_id
from notelake.operators.rerank import (
    blend,
    cache_hits,
    cache_key,
    cache_misses,
    parse_indexed_scores,
    parse_scores,
    response_variants,
    score_with,
)
from notelake.sources.notes import catalogue, list_notes, read_dirty_paths, read_notes, read_submodule_files


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


def test_paths(spark):
    assert one(spark, "kb://code-notes/services/", normalize_path) == "code-notes/services"
    assert one(spark, "//a/b//", normalize_path) == "a/b"
    assert one(spark, "a/b/c", ancestors) == ["a/b/c", "a/b", "a"]
    assert one(spark, "#12", parse_chunk_id) == 12
    assert one(spark, "notes/a.md", parse_chunk_id) is None


def contexts(spark):
    rows = [("code-notes", "notes", 1, 1), ("code-notes/services", "svc", 2, 2), ("code-notes/services/auth", "auth", 3, 3)]
    return spark.createDataFrame(rows, "virtual_path string, description string, created_at long, updated_at long")


def test_context_inheritance_most_specific_first(spark):
    paths = spark.createDataFrame([("code-notes/services/auth",), ("code-notes/x.md",), ("rules/y.md",)], "path string")
    rows = {r.path: r.contexts for r in ctx.context_lines(paths, contexts(spark)).collect()}
    assert rows == {
        "code-notes/services/auth": ["code-notes/services/auth: auth", "code-notes/services: svc", "code-notes: notes"],
        "code-notes/x.md": ["code-notes: notes"],
    }


def test_context_upsert_keeps_creation_time(spark):
    changes = spark.createDataFrame([("kb://code-notes/", "new", 9), ("fresh", "f", 9)], "virtual_path string, description string, at long")
    rows = {r.virtual_path: r for r in ctx.upsert_contexts(contexts(spark), changes).collect()}
    assert (rows["code-notes"].description, rows["code-notes"].created_at, rows["code-notes"].updated_at) == ("new", 1, 9)
    assert rows["fresh"].created_at == 9
    left, found = ctx.remove_contexts(contexts(spark), spark.createDataFrame([("code-notes",), ("zz",)], "virtual_path string"))
    assert left.count() == 2
    assert {r.virtual_path: r.removed for r in found.collect()} == {"code-notes": True, "zz": False}


GITMODULES = (
    '[submodule "libs/shared-utils"]\n\tpath = libs/shared-utils\n\turl = https://git.example.com/utils.git\n'
    '[submodule "services/payment"]\n\tpath = services/payment\n\turl = https://git.example.com/pay.git\n\tbranch = main\n'
    '[submodule "bad"]\n\tpath = bad\n'
)


def test_submodules_and_namespaces(spark):
    files = spark.createDataFrame([("r", GITMODULES), ("empty", " ")], "repo string, content string")
    declared = ns.submodules(files)
    rows = {r.path: r for r in declared.collect()}
    assert set(rows) == {"libs/shared-utils", "services/payment"}
    assert rows["services/payment"].branch == "main" and rows["libs/shared-utils"].branch is None
    paths = spark.createDataFrame([("r", "services/payment/a.md"), ("r", "services/auth/src/b.md"), ("r", "docs/x.md")], "repo string, path string")
    dirs = ns.directories_of(paths)
    names = {(r.name, r.kind) for r in ns.list_namespaces(spark.createDataFrame([("r",)], "repo string"), declared, dirs).collect()}
    assert names == {("root", "root"), ("services/payment", "submodule"), ("services/payment", "directory"), ("services/auth", "directory")}
    assert [r.path for r in ns.submodule_warnings(declared, dirs).collect()] == ["libs/shared-utils"]


def test_namespace_lookup_and_join_agree(spark, monkeypatch):
    names = spark.createDataFrame([("root",), ("services/auth",), ("services",)], "name string")
    docs = spark.createDataFrame([("services/auth/a.md",), ("services/x.md",), ("serv/x.md",), ("y.md",)], "doc_path string")
    want = {"services/auth/a.md": "services/auth", "services/x.md": "services", "serv/x.md": "root", "y.md": "root"}
    assert {r.doc_path: r.namespace for r in ns.with_namespace(docs, names).collect()} == want
    monkeypatch.setattr(ns, "MAX_LISTED_NAMES", 1)
    assert {r.doc_path: r.namespace for r in ns.with_namespace(docs, names).collect()} == want


def test_scorer_answers(spark):
    raw = spark.createDataFrame(
        [
            (1, '[{"id": 1, "score": 0.95}, {"id": 2, "score": 0.3}]'),
            (2, '[{"id": 1, "score": 1.5}, {"id": 2, "score": -0.3}]'),
            (3, '[{"id": 99, "score": 0.9}, {"id": "1", "score": "high"}, {"score": 1}, 5]'),
            (4, 'Here:\n```json\n[{"id": 2, "score": 1}]\n```\n'),
            (5, "no json"),
            (6, 'so [{"id": 1, "score": 0.5}] it is'),
            (7, '{"id": 1, "score": 0.5}'),
            (8, '[{"id": 1, "score": null}, {"id": 1.5, "score": 0.5}]'),
        ],
        "query_id long, raw string",
    )
    cands = spark.range(1, 9).withColumnRenamed("id", "query_id").select("query_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("cand_id"))
    got = {(r.query_id, r.cand_id): r.score for r in parse_scores(raw, cands).collect()}
    assert got == {(1, 1): 0.95, (1, 2): 0.3, (2, 1): 1.0, (2, 2): 0.0, (3, 1): 0.0, (4, 2): 1.0, (6, 1): 0.5, (8, 1): 0.0}
    assert one(spark, '["a", "b", "c"]', response_variants) == ["a", "b"]
    assert one(spark, "sorry", response_variants) == []


def test_scores_by_position(spark):
    raw = spark.createDataFrame([(1, '{"results": [{"index": 1, "relevance_score": 2}, {"index": 5, "relevance_score": 1}, {"index": -1}, {"index": 0}]}')], "query_id long, raw string")
    cands = spark.createDataFrame([(1, 0, 10), (1, 1, 11)], "query_id long, rank int, doc_id long")
    assert {r.doc_id: r.score for r in parse_indexed_scores(raw, cands).collect()} == {10: 0.0, 11: 1.0}


def test_blend_weights_and_missing_scores(spark):
    fused = spark.createDataFrame([(1, i, 0, i, 1.0 - i / 20) for i in range(12)], "query_id long, doc_id long, chunk_index int, rank int, score double")
    scores = spark.createDataFrame([(1, 11, 0, 1.0), (1, 3, 0, 0.5)], "query_id long, doc_id long, chunk_index int, score double")
    rows = {r.doc_id: r for r in blend(fused, scores).collect()}
    assert rows[0].score == 0.75 and rows[0].rerank_score is None
    assert abs(rows[3].score - (0.6 * 0.85 + 0.4 * 0.5)) < 1e-12
    assert abs(rows[11].score - (0.4 * 0.45 + 0.6)) < 1e-12
    assert rows[11]["rank"] == 0


def test_scoring_function_failure_leaves_the_query_out(spark):
    inputs = spark.createDataFrame([(1, "good", 5, 0, "aa"), (1, "good", 6, 0, "b"), (2, "bad", 7, 0, "c")], "query_id long, query_text string, doc_id long, chunk_index int, text string")

    def scorer(query, texts):
        if query == "bad":
            raise RuntimeError("down")
        return [len(t) for t in texts]

    assert {(r.query_id, r.doc_id): r.score for r in score_with(inputs, scorer).collect()} == {(1, 5): 1.0, (1, 6): 1.0}


def test_cache_lifetime(spark):
    keyed = spark.createDataFrame([("a",), ("b",)], "text string").withColumn("cache_key", cache_key("expand", "m", F.col("text")))
    assert all(r.cache_key.startswith("expand:") and len(r.cache_key) == 39 for r in keyed.collect())
    cache = keyed.select("cache_key", F.lit("[]").alias("result_json"), F.when(F.col("text") == "a", 1000).otherwise(0).cast("long").alias("created_at"))
    assert [r.text for r in cache_misses(keyed, cache, 4500, 4000).collect()] == ["b"]
    assert [r.text for r in cache_hits(keyed, cache, 4500, 4000).collect()] == ["a"]


def test_note_files(spark, tmp_path):
    for name, text in {
        "code-notes/auth.md": "---\ntitle: Auth Service\ntags: [auth]\n---\n# Auth",
        "code-notes/deep/a b.md": "# Deep",
        "rules/r.md": "rule",
        "other/x.md": "no",
        "code-notes/.hidden/h.md": "no",
        "code-notes/t.txt": "no",
    }.items():
        path = tmp_path / "vault" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    root = str(tmp_path / "vault")
    assert sorted(r.path for r in list_notes(spark, root).collect()) == ["code-notes/auth.md", "code-notes/deep/a b.md", "rules/r.md"]
    rows = {r.doc_path: r for r in catalogue(read_notes(spark, root)).collect()}
    assert rows["code-notes/auth.md"].title == "Auth Service"
    assert rows["rules/r.md"].file_size == 4
    docs = spark.createDataFrame([(r.doc_path, r.title) for r in rows.values()], "doc_path string, title string")
    assert [r.doc_path for r in documents_like(docs, "CODE-notes/%").collect()] == ["code-notes/auth.md", "code-notes/deep/a b.md"]


def test_dirty_list_and_submodule_files(spark, tmp_path):
    (tmp_path / "dirty.txt").write_text(" a.md \n\nb\\c.md\na.md\n")
    assert sorted(r.path for r in read_dirty_paths(spark, str(tmp_path / "dirty.txt")).collect()) == ["a.md", "b/c.md"]
    assert read_dirty_paths(spark, str(tmp_path / "missing.txt")).count() == 0
    (tmp_path / "repos").mkdir()
    (tmp_path / "repos" / "one.gitmodules").write_text(GITMODULES)
    files = read_submodule_files(spark, str(tmp_path / "repos"))
    assert [r.repo for r in files.collect()] == ["one"]
    assert sorted(r.name for r in ns.submodules(files).collect()) == ["libs/shared-utils", "services/payment"]
