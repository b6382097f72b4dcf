"""Only changed files are opened; keys and vector lengths are checked."""

import os

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from notelake.operators.vectors import knn_topk
from notelake.plans.indexing import build_index, check_keys, update_index
from notelake.operators.namespaces import submodules
from notelake.sources.files import FolderFiles, appended_lines
from notelake.sources.notes import clean_paths, list_notes, read_changed_notes, read_notes, read_submodule_files
from notelake.sources.store import load_index
from notelake.streaming.changes import distinct_changes, run_batches, stream_index_updates

NAMES = ["a.md", "sub/b c.md", "sub/d[1]{x}.md", "e%20+f.md"]


def vault(tmp_path):
    root = tmp_path / "vault"
    for name in NAMES:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"# {name}\n\nfirst text\n")
    return root


def listed(spark, *paths):
    return spark.createDataFrame([(str(p),) for p in paths], "path string")


def test_only_listed_files_are_opened(spark, tmp_path):
    root = vault(tmp_path)
    changed = listed(spark, *NAMES[1:], "gone.md", NAMES[1])
    got = read_changed_notes(spark, str(root), changed, None)
    assert sorted(r.path for r in got.collect()) == sorted(NAMES[1:])
    assert "Scan" not in got._jdf.queryExecution().executedPlan().toString().replace("Scan ExistingRDD", "")
    assert read_changed_notes(spark, str(root), listed(spark, "../vault/a.md", ".git/x.md", "sub/../a.md"), None).collect() == []
    assert read_changed_notes(spark, str(root), listed(spark, "gone.md"), None).collect() == []


def test_absolute_paths_are_cut(spark):
    lines = spark.createDataFrame([("/v/n/a.md",), (" b/c.md ",), ("/v/other/a.md",), ("a.md",)], "value string")
    assert sorted(r.path for r in clean_paths(lines, root="/v/n/").collect()) == ["/v/other/a.md", "a.md", "b/c.md"]


def test_stream_over_a_folder(spark, tmp_path):
    root, index, dirty = vault(tmp_path), str(tmp_path / "index"), str(tmp_path / "dirty")
    build_index(read_notes(spark, str(root), None), index)
    (root / NAMES[0]).write_text("# new\n\nother words\n")
    (root / NAMES[2]).write_text("# not listed\n\nother words\n")
    os.remove(root / NAMES[1])
    spark.createDataFrame([(f"{root}/{NAMES[0]}",), (NAMES[1],)], "value string").write.text(dirty)
    stream_index_updates(spark.readStream.text(dirty), str(root), index, str(tmp_path / "checkpoint")).awaitTermination()
    titles = {r.doc_path: r.text for r in load_index(spark, index).chunks.join(load_index(spark, index).docs, "doc_id").select("doc_path", "text").collect()}
    assert set(titles) == {NAMES[0], NAMES[2], NAMES[3]}
    assert "other words" in titles[NAMES[0]] and "first text" in titles[NAMES[2]]


def test_equal_keys_of_two_paths_are_an_error(spark):
    check_keys(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, doc_path string"))
    with pytest.raises(ValueError, match="same doc_id"):
        check_keys(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, doc_path string"))


def test_vector_lengths(spark, tmp_path):
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    vectors = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0, 3.0, 4.0])], "doc_id long, chunk_index int, embedding array<float>")
    with pytest.raises(PythonException, match="dimension"):
        knn_topk(queries, vectors.coalesce(1), 2).collect()
    root, index = vault(tmp_path), str(tmp_path / "index")
    build_index(read_notes(spark, str(root), None), index, embedder=lambda texts: [[1.0, 2.0]] * len(texts))
    assert load_index(spark, index).dimension == 2
    (root / NAMES[0]).write_text("# new\n\nother words\n")
    with pytest.raises(ValueError, match="dimension 3"):
        update_index(read_notes(spark, str(root), None), None, index, embedder=lambda texts: [[1.0, 2.0, 3.0]] * len(texts))


def test_many_queries_keep_their_best(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    q, v = rng.integers(0, 9, (1500, 3)).astype(float), rng.integers(0, 9, (1300, 3)).astype(float)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<float>")
    vectors = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "doc_id long, chunk_index int, embedding array<float>")
    far = np.sqrt(((q[:, None] - v[None]) ** 2).sum(2))
    want = np.argsort(np.round(far, 9), axis=1, kind="stable")[:, :4]
    got = knn_topk(queries, vectors.coalesce(1), 4).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.round(-F.col("score"), 9).alias("s"), "doc_id"))).alias("near")).collect()
    assert len(got) == 1500
    assert all([x.doc_id for x in r.near] == want[r.query_id].tolist() for r in got)


def test_all_names_but_hidden_folders(spark, tmp_path):
    for name in ("_x.md", ".y.md", "a/_b/.c.md", "a/z.md", ".git/no.md", "a/.trash/no.md", "a/other.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}")
    got = {r.path: r for r in read_notes(spark, str(tmp_path), None).collect()}
    assert set(got) == {"_x.md", ".y.md", "a/_b/.c.md", "a/z.md"} and got["a/_b/.c.md"].content == "text of a/_b/.c.md"
    assert got["_x.md"].file_size == len("text of _x.md") and got["_x.md"].mtime_ms > 0
    assert {r.path for r in list_notes(spark, f"file://{tmp_path}", ["a"]).collect()} == {"a/_b/.c.md", "a/z.md"}
    assert {r.path for r in read_changed_notes(spark, str(tmp_path), listed(spark, ".y.md", "_x.md", "none.md"), None).collect()} == {".y.md", "_x.md"}


def test_folders_are_dealt_out(tmp_path):
    for i in range(30):
        (tmp_path / f"d{i}" / "sub").mkdir(parents=True)
        (tmp_path / f"d{i}" / "sub" / f"{i}.md").write_text("x")
    for slices in ("1", "4", "64"):
        reader = FolderFiles({"path": str(tmp_path), "slices": slices}).reader(None)
        parts = reader.partitions()
        found = [p for part in parts for batch in reader.read(part) for p in batch.column("path").to_pylist()]
        assert sorted(found) == sorted(f"d{i}/sub/{i}.md" for i in range(30))
    assert len(FolderFiles({"path": str(tmp_path), "slices": "4"}).reader(None).partitions()) == 31


def test_submodule_files_by_their_real_name(spark, tmp_path):
    for repo in ("one", "two/inner"):
        (tmp_path / repo).mkdir(parents=True)
        (tmp_path / repo / ".gitmodules").write_text(f'[submodule "{repo}"]\n\tpath = p\n\turl = u\n')
    assert {(r.repo, r.name) for r in submodules(read_submodule_files(spark, str(tmp_path))).collect()} == {("one", "one"), ("two/inner", "two/inner")}


def test_a_growing_list_is_read_once(spark, tmp_path):
    listing, out = tmp_path / "dirty.txt", str(tmp_path / "out")
    listing.write_text("a.md\nb.md\nhal")

    def run():
        handle = lambda batch, n: distinct_changes(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")
        run_batches(appended_lines(spark, str(listing)), handle, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted((r.path, r.batch) for r in spark.read.parquet(out).collect())

    assert [p for p, _ in run()] == ["a.md", "b.md"]
    with listing.open("a") as f:
        f.write("f.md\nc.md\n")
    rows = run()
    assert [p for p, _ in rows] == ["a.md", "b.md", "c.md", "half.md"] and len({n for _, n in rows}) == 2
