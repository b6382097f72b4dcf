"""Ranks, fusion of rankings, and the strong-signal test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.params import SearchParams

# Scores are compared at this many decimals, so that the order of a floating-point
# sum never decides a rank; ties go to the smaller (doc_id, chunk_index).
SCORE_DIGITS = 9


def score_order(score: str = "score") -> list[Column]:
    return [F.desc(F.round(score, SCORE_DIGITS)), F.asc("doc_id"), F.asc("chunk_index")]


def top_k(
    scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), score: str = "score"
) -> DataFrame:
    """Best ``k`` rows per query with a 0-based ``rank``.

    The planner limits every task to ``k`` rows per query before the exchange.
    """
    ranked = scored.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*score_order(score)))
    ).filter(F.col("_rn") <= k)
    return ranked.withColumn("rank", F.col("_rn") - 1).drop("_rn")


def ranks(scored: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """0-based rank per query, best score first."""
    order = Window.partitionBy(*keys).orderBy(*score_order())
    return scored.withColumn("rank", F.row_number().over(order) - 1)


def linear_fusion(
    lexical: DataFrame | None,
    vector: DataFrame | None,
    lexical_weight: float,
    vector_weight: float,
) -> DataFrame:
    """Weighted sum of the two scores, each divided by its maximum for the query.

    Either side may be None; a side whose maximum is not positive counts 0.
    Returns ``query_id, doc_id, chunk_index, lex_norm, vec_norm, score``.
    """
    sides = [
        df.select("query_id", "doc_id", "chunk_index", F.lit(side).alias("_side"), "score")
        for df, side in ((lexical, "lex"), (vector, "vec"))
        if df is not None
    ]
    both = (
        reduce(DataFrame.unionByName, sides)
        .groupBy("query_id", "doc_id", "chunk_index")
        .agg(
            F.max(F.when(F.col("_side") == "lex", F.col("score"))).alias("lex"),
            F.max(F.when(F.col("_side") == "vec", F.col("score"))).alias("vec"),
        )
    )
    per_query = Window.partitionBy("query_id")

    def norm(name: str) -> Column:
        top = F.max(name).over(per_query)
        return F.when(top > 0, F.coalesce(F.col(name) / top, F.lit(0.0))).otherwise(0.0)

    return both.select(
        "query_id",
        "doc_id",
        "chunk_index",
        norm("lex").alias("lex_norm"),
        norm("vec").alias("vec_norm"),
    ).withColumn(
        "score", F.lit(lexical_weight) * F.col("lex_norm") + F.lit(vector_weight) * F.col("vec_norm")
    )


def rrf_fusion(rankings: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of any number of rankings in one grouping.

    ``rankings``: ``query_id, doc_id, chunk_index, rank`` (0-based) and an optional
    ``weight``. A chunk whose best rank is 0 gains .05, ranks 1 and 2 gain .02.
    """
    weight = F.col("weight") if "weight" in rankings.columns else F.lit(1.0)
    fused = rankings.groupBy("query_id", "doc_id", "chunk_index").agg(
        F.sum(weight / (F.lit(rrf_k) + F.col("rank") + 1)).alias("_sum"),
        F.min("rank").alias("best_rank"),
    )
    bonus = (
        F.when(F.col("best_rank") == 0, 0.05).when(F.col("best_rank") <= 2, 0.02).otherwise(0.0)
    )
    return fused.select(
        "query_id", "doc_id", "chunk_index", "best_rank", (F.col("_sum") + bonus).alias("score")
    )


def hybrid_rrf(lexical: DataFrame, vector: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Fusion of one lexical and one vector ranking, best ``k`` per query."""
    lists = lexical.select("query_id", "doc_id", "chunk_index", "rank").unionByName(
        vector.select("query_id", "doc_id", "chunk_index", "rank")
    )
    return top_k(rrf_fusion(lists, rrf_k), k)


def strong_signal(
    scored: DataFrame,
    min_score: float = SearchParams.strong_min_score,
    min_gap: float = SearchParams.strong_min_gap,
    normalized: bool = False,
) -> DataFrame:
    """Per query: does the best lexical score stand clear of the second one?

    Scores are divided by the best one unless ``normalized``. Queries without a
    row do not appear; callers treat them as not detected.
    """
    best = top_k(scored, 2)
    pair = best.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("_one"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("_two"),
    )
    scale = F.lit(1.0) if normalized else F.col("_one")
    top = F.when(scale == 0, 0.0).otherwise(F.col("_one") / scale)
    second = F.when(scale == 0, 0.0).otherwise(F.coalesce(F.col("_two"), F.lit(0.0)) / scale)
    return pair.select("query_id", top.alias("top_score"), (top - second).alias("gap")).withColumn(
        "detected",
        (F.col("top_score") >= min_score) & (F.round("gap", SCORE_DIGITS) >= min_gap),
    )
