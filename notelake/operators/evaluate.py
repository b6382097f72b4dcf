"""Retrieval quality against judged queries, and per-query signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators.fusion import top_k


def quality(results: DataFrame, judged: DataFrame, k: int = 10, keys: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """Per query recall, reciprocal rank and nDCG at ``k``.

    ``results``: ``query_id, keys, rank`` (0-based); ``judged``: ``query_id, keys,
    grade`` (above 0 is relevant). Queries without a relevant row do not appear.
    """
    relevant = judged.filter("grade > 0")
    ideal_order = Window.partitionBy("query_id").orderBy(F.desc("grade"), *[F.asc(c) for c in keys])
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = (
        relevant.withColumn("_rn", F.row_number().over(ideal_order))
        .filter(F.col("_rn") <= k)
        .groupBy("query_id")
        .agg(F.sum(gain / F.log2(F.col("_rn") + 1)).alias("_ideal"))
    )
    totals = relevant.groupBy("query_id").agg(F.count("*").alias("_relevant"))
    hits = (
        results.filter(F.col("rank") < k)
        .join(relevant, ["query_id", *keys])
        .groupBy("query_id")
        .agg(
            F.count("*").alias("_hits"),
            F.min("rank").alias("_first"),
            F.sum(gain / F.log2(F.col("rank") + 2)).alias("_gain"),
        )
    )
    return (
        totals.join(ideal, "query_id")
        .join(hits, "query_id", "left")
        .select(
            "query_id",
            (F.coalesce("_hits", F.lit(0)) / F.col("_relevant")).alias("recall"),
            F.coalesce(1.0 / (F.col("_first") + 1), F.lit(0.0)).alias("mrr"),
            (F.coalesce("_gain", F.lit(0.0)) / F.col("_ideal")).alias("ndcg"),
        )
    )


def mean_quality(per_query: DataFrame) -> DataFrame:
    return per_query.agg(
        F.count("*").alias("queries"),
        F.avg("recall").alias("recall"),
        F.avg("mrr").alias("mrr"),
        F.avg("ndcg").alias("ndcg"),
    )


def query_weights(text: Column) -> Column:
    """Fusion weights by the look of a query: ids and quotes lean on words, prose less."""
    exact = text.rlike('[A-Za-z]+-\\d+|"[^"]+"|[A-Za-z]\\w*[_./:]\\w+')
    return F.struct(
        F.when(exact, 0.85).otherwise(0.6).alias("lexical"),
        F.when(exact, 0.15).otherwise(0.4).alias("vector"),
    )


def lexical_confidence(scored: DataFrame) -> DataFrame:
    """Gap between the best and the tenth lexical score, relative to the best."""
    best = top_k(scored, 10).groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("_one"),
        F.max(F.when(F.col("rank") == 9, F.col("score"))).alias("_ten"),
    )
    gap = F.when(
        F.col("_one") > 0, (F.col("_one") - F.coalesce("_ten", F.lit(0.0))) / F.col("_one")
    ).otherwise(0.0)
    return best.select("query_id", gap.alias("confidence"))


def engine_overlap(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """Jaccard overlap of the two candidate lists of a query."""
    marked = lexical.select("query_id", "doc_id", "chunk_index").unionByName(
        vector.select("query_id", "doc_id", "chunk_index")
    )
    return (
        marked.groupBy("query_id", "doc_id", "chunk_index")
        .agg(F.count("*").alias("_n"))
        .groupBy("query_id")
        .agg((F.count_if(F.col("_n") == 2) / F.count("*")).alias("overlap"))
    )


def saturating_norm(candidates: DataFrame) -> DataFrame:
    """``score / (score + median)`` over a query's candidates (a bounded list)."""
    median = F.percentile("score", 0.5).over(Window.partitionBy("query_id"))
    return candidates.withColumn("norm", F.col("score") / (F.col("score") + median))
