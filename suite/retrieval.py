"""Queries over the retrieval operators: BM25, nearest neighbours, fusion, signals."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from notelake.operators.evaluate import (
    engine_overlap,
    lexical_confidence,
    mean_quality,
    quality,
    query_weights,
    saturating_norm,
)
from notelake.operators.fusion import hybrid_rrf, linear_fusion, strong_signal, top_k
from notelake.operators.lexical import bm25_reads, bm25_topk
from notelake.operators.vectors import knn_topk
from notelake.params import SearchParams
from suite.blocks import DOCVEC, TOKENS, bm25, knn, rrf
from suite.inputs import SENTENCES_SQL, TEXTS_SQL, index, sentences, table, texts, vectors
from suite.registry import query

P = SearchParams()


def ranked(df):
    return df.select(
        "query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score")
    )


_OUT = "SELECT query_id::BIGINT AS query_id, doc_id, rank, round(score, 6) AS score FROM"


def words(spark, sf, queries, k=P.candidate_k, params=P):
    held = index(spark, sf)
    return bm25_topk(queries, held.postings, held.blocks, held.stats, k, params)


@query("bm25_topk", f"WITH {TOKENS}, {SENTENCES_SQL}, {bm25('sentences', 10)} {_OUT} lex")
def bm25_sentences(spark, sf):
    """Best ten documents for every sentence of the benchmark passages."""
    return ranked(words(spark, sf, sentences(spark, sf).select("query_id", "text"), 10))


PAIRS_SQL = """
pairs AS (
  SELECT item_id * 1000 + i AS query_id, w[i] || '-' || w[i + 1] AS text
  FROM (SELECT item_id, w, unnest(range(1, len(w), 7)) AS i
        FROM (SELECT item_id, list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda x: x <> '') AS w FROM benchmark))
)"""


@query("bm25_phrase_corpus", f"WITH {TOKENS}, {PAIRS_SQL}, {bm25('pairs', 10)} {_OUT} lex")
def bm25_phrase_corpus(spark, sf):
    """Every seventh pair of neighbouring words of the benchmark passages as a phrase."""
    word = F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != "")
    said = table(spark, sf, "benchmark").select("item_id", word.alias("w")).filter(F.size("w") > 1)
    at = said.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1, F.lit(7))).alias("i"))
    asked = at.select((F.col("item_id") * 1000 + F.col("i")).alias("query_id"), F.concat(F.col("w")[F.col("i") - 1], F.lit("-"), F.col("w")[F.col("i")]).alias("text"))
    return ranked(words(spark, sf, asked, 10))


@query(
    "bm25_reads",
    f"""WITH {TOKENS}, {SENTENCES_SQL}, {bm25('sentences', 10)},
asked AS (SELECT DISTINCT query_id FROM lex),
df AS (SELECT phrase, count(*) AS df FROM wtf GROUP BY 1),
total AS (SELECT query_id, sum(df)::BIGINT AS postings FROM phrases JOIN asked USING (query_id) JOIN df USING (phrase) GROUP BY 1)
SELECT query_id::BIGINT AS query_id, postings, TRUE AS bounded FROM total""",
)
def bm25_reads_(spark, sf):
    """Postings of the phrases of every query that has results, and that no more than those are scored."""
    held = index(spark, sf)
    asked = sentences(spark, sf).select("query_id", "text")
    reads = bm25_reads(asked, held.postings, held.blocks, held.stats, 10)
    return reads.select("query_id", "postings", ((F.col("postings_read") <= F.col("postings")) & (F.col("blocks_read") <= F.col("blocks_held"))).alias("bounded"))


@query("bm25_phrase", f"WITH {TOKENS}, {TEXTS_SQL}, {bm25('texts', 50)} {_OUT} lex")
def bm25_phrase(spark, sf):
    """Quoted, hyphenated and repeated words: phrases, conjunction, repeats."""
    return ranked(words(spark, sf, texts(spark).drop("namespace")))


_FLAT = {"title": 1.0, "heading_path": 10.0, "body": 2.0, "tags": 1.0, "properties": 1.0}


@query("bm25_field_weights", f"WITH {TOKENS}, {TEXTS_SQL}, {bm25('texts', 20, weights=_FLAT)} {_OUT} lex")
def bm25_field_weights(spark, sf):
    return ranked(
        words(spark, sf, texts(spark).drop("namespace"), 20, replace(P, field_weights=_FLAT))
    )


@query("bm25_namespace", f"WITH {TOKENS}, {TEXTS_SQL}, {bm25('texts', 10, namespace=True)} {_OUT} lex")
def bm25_namespace(spark, sf):
    return ranked(words(spark, sf, texts(spark), 10))


_ALLVEC = """
allvec AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS ev FROM embeddings),
vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings)"""


def _self_knn(spark, sf, metric):
    v = table(spark, sf, "embeddings")
    held = v.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "embedding")
    return ranked(knn_topk(v.select(F.col("vec_id").alias("query_id"), "embedding"), held, 10, metric))


@query("knn_l2", f"WITH {_ALLVEC}, {knn('vq', 10, vectors='allvec')} {_OUT} vec")
def knn_l2(spark, sf):
    """Ten nearest vectors of every vector."""
    return _self_knn(spark, sf, "l2")


@query("knn_cosine", f"WITH {_ALLVEC}, {knn('vq', 10, metric='cosine', vectors='allvec')} {_OUT} vec")
def knn_cosine(spark, sf):
    return _self_knn(spark, sf, "cosine")


@query(
    "knn_blocks",
    f"WITH {_ALLVEC}, {knn('vq', 5, vectors='allvec')} {_OUT} vec",
)
def knn_blocks(spark, sf):
    """The block form, as a large query table takes it."""
    v = table(spark, sf, "embeddings")
    held = v.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "embedding")
    asked = v.select(F.col("vec_id").alias("query_id"), "embedding")
    return ranked(knn_topk(asked, held, 5, query_bytes=1 << 10, block_bytes=1 << 18))


@query(
    "knn_namespace",
    f"""WITH {DOCVEC}, vq AS (SELECT doc_id AS query_id, lang AS want, ev AS qv FROM docvec),
{knn('vq', 5, scope='v.lang = q.want')} {_OUT} vec""",
)
def knn_namespace(spark, sf):
    """Neighbours inside the namespace of the query."""
    held = vectors(spark, sf)
    asked = held.select(F.col("doc_id").alias("query_id"), "embedding", "namespace")
    return ranked(knn_topk(asked, held, 5))


_SENT_VEC = """
sq AS (SELECT query_id, item_id, s.text, embedding::DOUBLE[] AS qv
       FROM sentences s LEFT JOIN embeddings ON vec_id = item_id)"""
BOTH = f"{TOKENS}, {SENTENCES_SQL}, {_SENT_VEC}, {DOCVEC}, {bm25('sentences', 50)}, {knn('sq', 50)}"


def both_engines(spark, sf):
    asked = sentences(spark, sf)
    held = index(spark, sf)
    return words(spark, sf, asked.select("query_id", "text")), knn_topk(
        asked.select("query_id", "embedding"), held.vectors, P.candidate_k
    )


LINEAR = """
uni AS (
  SELECT query_id, doc_id, max(l) AS l, max(v) AS v FROM (
    SELECT query_id, doc_id, score AS l, NULL AS v FROM lex UNION ALL SELECT query_id, doc_id, NULL, score FROM vec)
  GROUP BY 1, 2
),
norm AS (
  SELECT query_id, doc_id,
         CASE WHEN max(l) OVER w > 0 THEN coalesce(l / max(l) OVER w, 0) ELSE 0 END AS lex_norm,
         CASE WHEN max(v) OVER w > 0 THEN coalesce(v / max(v) OVER w, 0) ELSE 0 END AS vec_norm
  FROM uni WINDOW w AS (PARTITION BY query_id)
)"""


@query(
    "linear_fusion",
    f"""WITH {BOTH}, {LINEAR}
SELECT query_id, doc_id, round(lex_norm, 6) AS lex_norm, round(vec_norm, 6) AS vec_norm,
       round(0.7::DOUBLE * lex_norm + 0.3::DOUBLE * vec_norm, 6) AS score FROM norm""",
)
def linear(spark, sf):
    lex, vec = both_engines(spark, sf)
    return linear_fusion(lex, vec, P.lexical_weight, P.vector_weight).select(
        "query_id",
        "doc_id",
        F.round("lex_norm", 6).alias("lex_norm"),
        F.round("vec_norm", 6).alias("vec_norm"),
        F.round("score", 6).alias("score"),
    )


LISTS = """
lists AS (
  SELECT query_id, doc_id, rank, 1.0::DOUBLE AS weight FROM lex
  UNION ALL SELECT query_id, doc_id, rank, 1.0 FROM vec
)"""


@query("rrf_fusion", f"WITH {BOTH}, {LISTS}, {rrf('lists')} {_OUT} fused WHERE rank < 10")
def rrf_both(spark, sf):
    lex, vec = both_engines(spark, sf)
    return ranked(hybrid_rrf(lex, vec, 10))


_STRONG = """
SELECT query_id::BIGINT AS query_id, round(top_score, 6) AS top_score, round(gap, 6) AS gap,
       top_score >= 0.85 AND round(gap, 9) >= 0.15 AS detected"""


@query(
    "strong_signal",
    f"""WITH {TOKENS}, {SENTENCES_SQL}, {bm25('sentences', 50)},
pair AS (SELECT query_id, max(CASE WHEN rank = 0 THEN score END) AS one, coalesce(max(CASE WHEN rank = 1 THEN score END), 0) AS two
         FROM lex GROUP BY 1)
{_STRONG} FROM (SELECT query_id, 1.0::DOUBLE AS top_score, 1.0::DOUBLE - two / one AS gap FROM pair)""",
)
def strong(spark, sf):
    lex = words(spark, sf, sentences(spark, sf).select("query_id", "text"))
    return strong_signal(lex).select(
        "query_id", F.round("top_score", 6).alias("top_score"), F.round("gap", 6).alias("gap"), "detected"
    )


@query(
    "strong_signal_normalized",
    f"""WITH pair AS (
  SELECT user_id AS query_id, max(CASE WHEN r = 1 THEN v END) AS one, coalesce(max(CASE WHEN r = 2 THEN v END), 0) AS two
  FROM (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY round(v, 9) DESC, event_id) AS r
        FROM (SELECT user_id, event_id, value / (SELECT max(value) FROM events) AS v FROM events))
  GROUP BY 1)
{_STRONG} FROM (SELECT query_id, one AS top_score, one - two AS gap FROM pair)""",
)
def strong_normalized(spark, sf):
    """Already normalised scores: the values of each user's events."""
    events = table(spark, sf, "events")
    top = events.agg(F.max("value")).scalar()
    scored = events.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"),
        F.lit(0).alias("chunk_index"), (F.col("value") / top).alias("score"),
    )
    return strong_signal(scored, normalized=True).select(
        "query_id", F.round("top_score", 6).alias("top_score"), F.round("gap", 6).alias("gap"), "detected"
    )


@query(
    "query_weights",
    f"""WITH {SENTENCES_SQL}, {TEXTS_SQL}, asked AS (
  SELECT query_id, text FROM sentences UNION ALL SELECT -query_id, text FROM texts)
SELECT query_id::BIGINT AS query_id, CASE WHEN x THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END AS lexical,
       CASE WHEN x THEN 0.15::DOUBLE ELSE 0.4::DOUBLE END AS vector
FROM (SELECT query_id, regexp_matches(text, '[A-Za-z]+-[0-9]+|"[^"]+"|[A-Za-z][A-Za-z0-9_]*[_./:][A-Za-z0-9_]+') AS x FROM asked)""",
)
def weights_by_query(spark, sf):
    asked = sentences(spark, sf).select("query_id", "text").unionByName(
        texts(spark).select((-F.col("query_id")).alias("query_id"), "text")
    )
    return asked.select("query_id", query_weights(F.col("text")).alias("w")).select("query_id", "w.*")


@query(
    "lexical_confidence",
    f"""WITH {TOKENS}, {SENTENCES_SQL}, {bm25('sentences', 50)}
SELECT query_id, round((one - coalesce(ten, 0)) / one, 6) AS confidence FROM (
  SELECT query_id, max(CASE WHEN rank = 0 THEN score END) AS one, max(CASE WHEN rank = 9 THEN score END) AS ten
  FROM lex GROUP BY 1)""",
)
def confidence(spark, sf):
    lex = words(spark, sf, sentences(spark, sf).select("query_id", "text"))
    return lexical_confidence(lex).withColumn("confidence", F.round("confidence", 6))


@query(
    "engine_overlap",
    f"""WITH {BOTH}
SELECT query_id, round(count(*) FILTER (n = 2) / count(*)::DOUBLE, 6) AS overlap
FROM (SELECT query_id, doc_id, count(*) AS n
      FROM (SELECT query_id, doc_id FROM lex UNION ALL SELECT query_id, doc_id FROM vec) GROUP BY 1, 2)
GROUP BY 1""",
)
def overlap(spark, sf):
    lex, vec = both_engines(spark, sf)
    return engine_overlap(lex, vec).withColumn("overlap", F.round("overlap", 6))


@query(
    "saturating_norm",
    f"""WITH {TOKENS}, {SENTENCES_SQL}, {bm25('sentences', 50)}
SELECT query_id, doc_id, round(score / (score + quantile_cont(score, 0.5) OVER (PARTITION BY query_id)), 6) AS norm
FROM lex""",
)
def saturating(spark, sf):
    lex = words(spark, sf, sentences(spark, sf).select("query_id", "text"))
    return saturating_norm(lex).select("query_id", "doc_id", F.round("norm", 6).alias("norm"))


_JUDGED = """
judged AS (SELECT query_id, doc_id, quality::DOUBLE AS grade FROM lex_all JOIN labels USING (doc_id) WHERE quality > 0)"""


@query(
    "recall_at_k",
    f"""WITH {TOKENS}, {SENTENCES_SQL}, {bm25('sentences', None, out='lex_all')}, {_JUDGED},
ideal AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(ord + 2)) AS ideal FROM (
  SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) - 1 AS ord FROM judged)
  WHERE ord < 10 GROUP BY 1),
hits AS (SELECT query_id, count(*) AS hits, min(rank) AS best, sum((pow(2, grade) - 1) / log2(rank + 2)) AS gain
  FROM lex_all JOIN judged USING (query_id, doc_id) WHERE rank < 10 GROUP BY 1),
per AS (SELECT coalesce(hits, 0) / n::DOUBLE AS recall, coalesce(1.0::DOUBLE / (best + 1), 0) AS mrr, coalesce(gain, 0) / ideal AS ndcg
  FROM (SELECT query_id, count(*) AS n FROM judged GROUP BY 1) JOIN ideal USING (query_id) LEFT JOIN hits USING (query_id))
SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM per""",
)
def recall_at_k(spark, sf):
    """Quality of the lexical ranking, with labelled good documents as judgments."""
    from notelake.operators.lexical import bm25_scores

    held = index(spark, sf)
    asked = sentences(spark, sf).select("query_id", "text")
    scored = bm25_scores(asked, held.postings, held.blocks, held.stats)
    judged = scored.join(table(spark, sf, "labels").filter("quality > 0"), "doc_id").select(
        "query_id", "doc_id", "chunk_index", F.col("quality").cast("double").alias("grade")
    )
    per = quality(top_k(scored, 10), judged, 10)
    return mean_quality(per).select(
        "queries", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")]
    )
