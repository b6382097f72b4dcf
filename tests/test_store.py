"""Versions, deletion bitmaps, merging, racing writers, and the layout of the lexical tables."""

import re
import threading
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelake.operators import lexical, postings as made
from notelake.operators.lexical import bm25_reads, bm25_topk
from notelake.operators.postings import BUCKETS, build_postings, chunk_lengths, corpus_stats, dealt, dealt_blocks, frequent_terms, lexical_rows, packed_blocks, term_blocks, token_slices
from notelake.params import FIELDS
from notelake.plans.indexing import build_index, delete_documents, repair_index, update_index
from notelake.plans.search import search
from notelake.sources import store
from notelake.sources.store import Conflict, State, Version, commit, committed, compact_index, due, load_index, read_state, vacuum_index, write_lexical
from notelake.sources.workdir import cut


def notes(spark, files):
    return spark.createDataFrame([(p, len(c), 1, c) for p, c in files.items()], "path string, file_size long, mtime_ms long, content string")


def text(i):
    return f"# Note {i}\n\ncommon word{i % 7} only{i} and {'even' if i % 2 == 0 else 'odd'} words\n\n## Part\n\nmore common text of {i}"


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


QUERIES = ("common", "word3 common", "odd-words", "only12", "even note", "never")


def ranking(spark, root):
    held = load_index(spark, root)
    rows = bm25_topk(asked(spark, *QUERIES), held.postings, held.blocks, held.stats, 8, gone=held.gone).collect()
    paths = {r.doc_id: r.doc_path for r in held.docs.collect()}
    return sorted((r.query_id, r.rank, paths[r.doc_id], round(r.score, 9)) for r in rows)


def test_many_deltas_read_like_one_build(spark, tmp_path):
    root, fresh = str(tmp_path / "index"), str(tmp_path / "fresh")
    files = {f"d{i % 3}/n{i}.md": text(i) for i in range(40)}
    build_index(notes(spark, files), root)
    for step in range(12):
        some = {f"d{step % 3}/n{step}.md": text(step) + f" changed{step}", f"new/m{step}.md": text(100 + step)}
        gone = f"d{(20 + step) % 3}/n{20 + step}.md"
        files = {k: v for k, v in (files | some).items() if k != gone}
        dirty = spark.createDataFrame([(p,) for p in [*some, gone]], "path string")
        update_index(notes(spark, files), dirty, root, compact=False)
    build_index(notes(spark, files), fresh)
    assert len(read_state(spark, root).live) == 13
    assert ranking(spark, root) == ranking(spark, fresh)
    held = load_index(spark, root)
    assert held.stats.first() == load_index(spark, fresh).stats.first()
    for df in (held.docs, held.chunks, held.postings, held.lengths):
        assert "LeftAnti" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert len(compact_index(spark, root).live) <= 4
    assert ranking(spark, root) == ranking(spark, fresh)
    delete_documents(spark, root, load_index(spark, root).docs.filter("doc_path = 'new/m3.md'"))
    files.pop("new/m3.md")
    build_index(notes(spark, files), fresh)
    assert ranking(spark, root) == ranking(spark, fresh)
    assert not due(compact_index(spark, root))
    assert ranking(spark, root) == ranking(spark, fresh)


def test_fifty_versions_are_a_bounded_number_of_folders():
    live, rows = (), 1
    for version in range(1, 61):
        live = (*live, Version(str(version), version, version, version, ("docs",), rows))
        while chosen := due(State(version, None, live)):
            one = Version("m", chosen[0].low, chosen[-1].high, version, ("docs",), sum(v.rows for v in chosen))
            live = tuple(v for v in live if v.high < one.low) + (one,) + tuple(v for v in live if v.low > one.high)
    assert len(live) <= 10 and sum(v.rows for v in live) == 60
    assert [v.low for v in live] == sorted(v.low for v in live) and live[0].low == 1 and live[-1].high == 60


def test_a_state_is_created_once(spark, tmp_path):
    root = str(tmp_path)
    commit(spark, root, State(1))
    with pytest.raises(Conflict):
        commit(spark, root, State(1, 7))
    assert read_state(spark, root).dimension is None
    seen = []

    def attempt(state):
        seen.append(state.version)
        if len(seen) == 1:
            commit(spark, root, State(2, 5))  # another writer is faster
        return State(state.version + 1, state.dimension)

    assert committed(spark, root, attempt) == State(3, 5) and seen == [1, 2]


def test_racing_writers_both_survive(spark, tmp_path):
    root = str(tmp_path / "index")
    files = {f"n{i}.md": text(i) for i in range(6)}
    build_index(notes(spark, files), root)
    errors = []

    def write(name):
        try:
            mine = {name: f"# {name}\n\nfrom {name[:-3]}"}
            update_index(notes(spark, files | mine), spark.createDataFrame([(name,)], "path string"), root)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in ("left.md", "right.md")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    held = load_index(spark, root)
    assert {"left.md", "right.md"} <= {r.doc_path for r in held.docs.collect()} and held.version == 3
    assert search(asked(spark, "left", "right"), held, "bm25_only").results.count() == 2


def test_a_repeated_batch_is_applied_once(spark, tmp_path):
    root = str(tmp_path / "index")
    build_index(notes(spark, {"a.md": text(1)}), root)
    dirty = spark.createDataFrame([("a.md",), ("b.md",)], "path string")
    first = update_index(notes(spark, {"a.md": text(2), "b.md": text(3)}), dirty, root, batch=("s", 4))
    again = update_index(notes(spark, {"a.md": text(9)}), dirty, root, batch=("s", 4))
    assert sorted(first.collect()) == sorted(again.collect()) and read_state(spark, root).version == 2
    assert update_index(notes(spark, {"a.md": text(9)}), dirty, root, batch=("s", 3)).collect() == []
    assert {r.change_kind for r in update_index(notes(spark, {"a.md": text(9)}), dirty, root, batch=("s", 5)).collect()} == {"modified", "deleted"}


def test_repair_writes_a_whole_index(spark, tmp_path):
    root = str(tmp_path / "index")
    build_index(notes(spark, {f"n{i}.md": text(i) for i in range(5)}), root, embedder=lambda t: [[1.0, 2.0]] * len(t))
    state = read_state(spark, root)
    # A broken state: a document is missing although its chunks are there.
    for table in state.live[0].tables:
        rows = store.visible(spark, root, table, state)
        store.write_table(rows.filter("doc_path <> 'n2.md'") if table == "docs" else rows, root, table, "broken")
    commit(spark, root, State(2, 2, (Version("broken", 1, 1, 1, state.live[0].tables, state.live[0].rows, state.live[0].tokens),)))
    assert load_index(spark, root).chunks.count() == 10
    repair_index(spark, root)
    fixed = load_index(spark, root)
    assert fixed.docs.count() == 4 and fixed.chunks.count() == fixed.lengths.count() == fixed.vectors.count() == 8
    assert fixed.stats.first().n_rows == 8 and fixed.postings.filter("term = 'only2'").count() == 0


def test_vacuum_keeps_what_readers_open(spark, tmp_path):
    root = str(tmp_path / "index")
    files = {f"n{i}.md": text(i) for i in range(5)}
    build_index(notes(spark, files), root)
    build_index(notes(spark, files), root)
    before = ranking(spark, root)
    assert vacuum_index(spark, root, 0) == 0
    assert vacuum_index(spark, root, int(time.time() * 1000) + 60_000) > 4
    assert ranking(spark, root) == before and len(store._manifests(spark, root)) == 1


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("root").alias("namespace"), F.lit("t").alias("title"), F.lit("").alias("heading_path"),
        F.concat_ws(" ", F.lit("everywhere"), F.concat(F.lit("w"), F.pmod(F.col("id"), F.lit(50))), F.concat(F.lit("u"), "id"), F.lit("the end")).alias("text"),
        F.lit("").alias("tags_text"), F.lit("").alias("properties_text"), F.lit(1).alias("origin"), F.col("id").alias("doc_no"),
    )
    root = str(tmp_path_factory.mktemp("layout"))
    total = write_lexical(rows, root, "1-a")
    assert total == (2000, 2000 * 6)
    commit(spark, root, State(1, None, (Version("1-a", 1, 1, 1, ("postings", "blocks", "lengths"), *total),)))
    return root, rows


def test_a_query_batch_opens_its_buckets(spark, corpus):
    root, rows = corpus
    assert {"everywhere", "the", "end"} <= set(frequent_terms(lexical_rows(rows))) and "u5" not in frequent_terms(lexical_rows(rows))
    postings = spark.read.parquet(f"{root}/postings/folder=1-a")
    plan = postings.filter(F.col("bucket").isin(3)).filter("term IN ('u5')")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan), plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # partitions of this size would be merged
    try:
        parts = dealt(postings.drop("bucket"), ["everywhere"]).withColumn("at", F.spark_partition_id()).groupBy("term").agg(F.count_distinct("at").alias("n"))
        spread = {r.term: r.n for r in parts.filter("term IN ('everywhere', 'w3')").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread["everywhere"] > 1 == spread["w3"]  # a term of every chunk is not one task's work
    assert postings.filter("term = 'u77'").select("bucket").distinct().count() == 1 and postings.select("bucket").distinct().count() <= BUCKETS + 1


def test_blocks_bound_and_prune(spark, corpus):
    root, rows = corpus
    postings, blocks = (spark.read.parquet(f"{root}/{t}/folder=1-a") for t in ("postings", "blocks"))
    stats = corpus_stats(spark.read.parquet(f"{root}/lengths/folder=1-a"))
    assert blocks.filter("term = 'everywhere'").agg(F.count("*"), F.sum("n")).first() == (63, 2000)
    reads = {r.query_id: r for r in bm25_reads(asked(spark, "everywhere u77", "everywhere", "the-end w3"), postings, blocks, stats, 10).collect()}
    assert reads[0].postings == 2001 and reads[0].postings_read <= 64
    assert reads[1].postings_read <= 2000 and reads[2].blocks_read <= reads[2].blocks_held
    best = bm25_topk(asked(spark, "everywhere w3 the-end"), postings, blocks, stats, 50).orderBy("rank").collect()
    assert [r.doc_id for r in best] == list(range(3, 2000, 50))[:50]


def test_scores_of_frequent_words_are_pruned_by_their_bound(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("t").alias("title"),
        F.concat(F.repeat(F.lit("wave "), F.when(F.floor(F.col("id") / 32) == 40, 9).otherwise(1)), F.lit("of text "), F.repeat(F.lit("filler "), (F.col("id") % 5).cast("int"))).alias("body"),
    )
    other = rows.filter("doc_id % 3 <> 0").withColumn("body", F.lit("nothing here"))
    rows = rows.filter("doc_id % 3 = 0").union(other)
    postings = build_postings(rows)
    blocks, stats = term_blocks(postings), corpus_stats(chunk_lengths(rows))
    reads = bm25_reads(asked(spark, "wave"), postings, blocks, stats, 10).first()
    assert reads.postings_read * 5 < reads.postings
    got = bm25_topk(asked(spark, "wave"), postings, blocks, stats, 10).orderBy("rank").collect()
    assert all(1280 <= r.doc_id < 1312 for r in got)


def test_dealt_postings_stay_whole(spark):
    rows = spark.createDataFrame([(i, 0, "a b", f"c{i} a") for i in range(40)], "doc_id long, chunk_index int, title string, body string")
    plain = build_postings(rows)
    assert sorted(map(str, dealt(plain, ["a"]).drop("bucket").collect())) == sorted(map(str, plain.collect()))


def test_parts_of_larger_tables(spark, corpus):
    root, rows = corpus
    often = frequent_terms(lexical_rows(rows))
    postings = spark.read.parquet(f"{root}/postings/folder=1-a")
    laid = dealt(postings.drop("bucket"), often, 3)
    at = laid.groupBy(F.spark_partition_id().alias("at")).agg(F.count_distinct("bucket").alias("buckets"), F.count("*").alias("n")).collect()
    whole = postings.groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert laid.rdd.getNumPartitions() == 3 * (BUCKETS + 1) and all(r.buckets == 1 for r in at) and max(r.n for r in at) < whole
    order = [c for c in postings.columns if c != "bucket"]
    assert sorted(map(str, laid.select(order).collect())) == sorted(map(str, postings.select(order).collect()))
    want = sorted(map(str, term_blocks(postings).collect()))
    assert [sorted(map(str, dealt_blocks(postings, often, n).collect())) for n in (1, 3)] == [want, want]


def test_postings_group_a_bounded_number_of_tokens():
    sizes = [5, 0, 9, 40, 3, 3, 3, 3]
    one = pa.array([["x"] * n for n in sizes], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([one] + [pa.array([[]] * len(sizes), pa.list_(pa.string()))] * (len(FIELDS) - 1), [f"_{f}" for f in FIELDS])
    got = [x.column(0).to_pylist() for x in token_slices([batch, batch.slice(0, 0)], 10)]
    assert [[len(r) for r in part] for part in got] == [[5, 0], [9], [40], [3, 3, 3], [3]]


def test_postings_are_written_where_they_are_made(spark, corpus, tmp_path, monkeypatch):
    root, rows = corpus
    monkeypatch.setattr(store, "dealt", None)  # what shuffles postings is for versions that are merged
    assert write_lexical(rows.limit(90), str(tmp_path), "1-a") == (90, 90 * 6)
    shown = spark.read.parquet(f"{root}/postings/folder=1-a").filter("bucket >= 0").select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "term", "doc_id")
    for rows in shown.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "term", "doc_id"))).alias("rows")).collect():
        order = [(r.term, r.doc_id) for r in rows.rows]
        assert order == sorted(order)
    table = spark.createDataFrame([(i, 0, "a", f"c{i % 9} a") for i in range(99)], "doc_id long, chunk_index int, title string, body string")
    assert "Exchange" not in build_postings(table)._jdf.queryExecution().executedPlan().toString()


def test_packed_blocks_are_the_blocks(spark, corpus, monkeypatch):
    root, _ = corpus
    postings = spark.read.parquet(f"{root}/postings/folder=1-a")
    want = sorted(map(str, term_blocks(postings).collect()))
    monkeypatch.setattr(made, "PACK_ROWS", 700)  # blocks are bounded in several packs
    for tokens in (0, 3 * BUCKETS * made.PART_TOKENS):
        got = packed_blocks(postings.repartition(5), tokens)
        assert got.columns == term_blocks(postings).columns and sorted(map(str, got.collect())) == want
    assert packed_blocks(postings.filter("false"), 0).collect() == []


def test_scores_are_summed_by_block_or_by_broadcast(spark, corpus, monkeypatch):
    root, _ = corpus
    postings, blocks = (spark.read.parquet(f"{root}/{t}/folder=1-a") for t in ("postings", "blocks"))
    stats = corpus_stats(spark.read.parquet(f"{root}/lengths/folder=1-a"))
    best = lambda: sorted(map(str, bm25_topk(asked(spark, "everywhere w3 the-end", "the u77", "w4"), postings, blocks, stats, 50).collect()))
    want = best()
    monkeypatch.setattr(lexical, "row_bound", lambda df: None)
    assert best() == want and len(want) > 50


def test_a_step_leaves_no_shuffle_files(spark):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    held = lambda: {f for d in folders for f in Path(d.getPath()).rglob("shuffle_*")}
    before = held()
    sums = spark.range(5000).groupBy((F.col("id") % 97).alias("k")).count()
    rows = sorted(cut(sums).collect())
    until = time.time() + 20  # files are removed behind the step
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and rows == sorted(sums.collect())


def test_an_index_holds_each_text_once(spark, tmp_path):
    root = str(tmp_path / "index")
    files = {f"n{i}.md": text(i) for i in range(5)}
    build_index(notes(spark, files), root)
    changed = files | {"n1.md": text(7), "m.md": text(8)}
    update_index(notes(spark, changed), spark.createDataFrame([("n1.md",), ("m.md",)], "path string"), root)
    assert "body" not in spark.read.parquet(f"{root}/docs").columns and not list(Path(root).glob("parsed/folder=*"))
    plan = hidden_joins(spark, root)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # texts stay where they are
    assert {r.doc_path for r in load_index(spark, root).docs.collect()} == set(changed)


def hidden_joins(spark, root):
    """Plans of what hides a document, with joins that Spark would shuffle by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    build = store.build_postings
    try:
        store.build_postings = lambda rows, **more: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or build(rows, **more)
        delete_documents(spark, str(root), load_index(spark, root).docs.filter("doc_path = 'none'"))
    finally:
        store.build_postings = build
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plans[0]
