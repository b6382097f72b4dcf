"""A third of all rows shares one term, one text, one session: results stay whole."""

from pyspark.sql import functions as F

from notelake.operators import transcripts as tr
from notelake.operators.fusion import top_k
from notelake.operators.lexical import bm25_scores
from notelake.operators.postings import build_postings, chunk_lengths, corpus_stats, term_blocks
from notelake.plans.indexing import detect_changes


def test_hot_term_and_copies(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.pmod("id", F.lit(3)).cast("int").alias("chunk_index"),
        F.lit("t").alias("title"),
        F.when(F.col("id") < 1000, "hot copy of one text").otherwise(F.concat(F.lit("hot word"), "id")).alias("body"),
    )
    held = build_postings(rows)
    index = held, term_blocks(held), corpus_stats(chunk_lengths(rows))
    q = spark.createDataFrame([(1, "hot"), (2, "hot copy"), (3, "copy-of one"), (4, "hot word2500")], "query_id long, text string")
    scores = bm25_scores(q, *index)
    counts = {r.query_id: r["count"] for r in scores.groupBy("query_id").count().collect()}
    assert counts == {1: 3000, 2: 1000, 3: 1000, 4: 1}
    best = top_k(scores, 5).filter("query_id = 2").orderBy("rank").collect()
    assert [r.doc_id for r in best] == [0, 1, 2, 3, 4]


def test_top_k_is_limited_before_the_exchange(spark):
    scored = spark.range(1000).selectExpr("pmod(id, 2) AS query_id", "id AS doc_id", "0 AS chunk_index", "id / 7D AS score")
    plan = top_k(scored, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_hot_session(spark):
    line = '{"type":"user","sessionId":"%s","message":{"role":"user","content":"t%d"}}'
    lines = spark.range(6000).select(
        F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("s"), F.pmod("id", F.lit(500)))).alias("session_file"),
        F.floor(F.col("id") / 100).cast("long").alias("slice"),
        F.col("id").alias("seq"),
    ).withColumn("value", F.format_string(line, "session_file", "seq"))
    said = tr.turns(tr.parse_lines(lines))
    parts = tr.rolling_parts(said).filter("session_file = 'hot'")
    assert parts.count() == 30
    text = tr.rolling_summary(said).filter("session_file = 'hot'").first().rolling_summary
    assert text == "\n".join(f"**User**: t{i}" for i in range(3000))


def test_change_detection_moves_hashes_not_texts(spark):
    notes = spark.createDataFrame([("a.md", "x" * 100)], "path string, content string")
    docs = spark.createDataFrame([("a.md", "h")], "doc_path string, content_hash string")
    plan = detect_changes(notes, docs)._jdf.queryExecution().optimizedPlan().toString()
    above_join = plan[: plan.index("Join")]
    assert "content#" not in above_join.replace("content_hash#", "")
