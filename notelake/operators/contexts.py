"""Descriptions attached to paths and inherited by everything below them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.paths import ancestors, normalize_path
from notelake.operators.sizing import broadcast_if_small


def upsert_contexts(contexts: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``virtual_path, description, at`` changes; the last one per path wins.

    An existing path keeps its ``created_at``.
    """
    fresh = changes.select(
        normalize_path(F.col("virtual_path")).alias("virtual_path"),
        "description",
        F.col("at").alias("created_at"),
        F.col("at").alias("updated_at"),
    )
    return (
        contexts.select("virtual_path", "description", "created_at", "updated_at")
        .unionByName(fresh)
        .groupBy("virtual_path")
        .agg(
            # Of changes of the same time the greatest description wins, so a repeated run gives the same.
            F.max(F.struct("updated_at", "description")).alias("_last"),
            F.min("created_at").alias("created_at"),
        )
        .select("virtual_path", "_last.description", "created_at", "_last.updated_at")
    )


def list_contexts(contexts: DataFrame) -> DataFrame:
    return contexts.orderBy("virtual_path")


def remove_contexts(contexts: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contexts left after removing ``virtual_path`` rows, and per path whether one existed."""
    gone = paths.select(normalize_path(F.col("virtual_path")).alias("virtual_path")).distinct()
    left = contexts.join(gone, "virtual_path", "left_anti")
    found = gone.join(
        contexts.select("virtual_path", F.lit(True).alias("removed")), "virtual_path", "left"
    ).select("virtual_path", F.coalesce("removed", F.lit(False)).alias("removed"))
    return left, found


def applicable_contexts(paths: DataFrame, contexts: DataFrame) -> DataFrame:
    """Contexts of every path and of its ancestors.

    ``paths``: distinct ``path``. Returns ``path, virtual_path, description, depth``
    (depth 0 is the path itself); deeper contexts are the more specific ones.
    """
    expanded = paths.select(
        "path",
        F.posexplode(ancestors(normalize_path(F.col("path")))).alias("depth", "virtual_path"),
    )
    held = broadcast_if_small(contexts.select("virtual_path", "description"))
    return expanded.join(held, "virtual_path").select("path", "virtual_path", "description", "depth")


def context_lines(paths: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per path the ``path: description`` lines, most specific first."""
    line = F.struct("depth", F.concat_ws(": ", "virtual_path", "description").alias("line"))
    return (
        applicable_contexts(paths, contexts)
        .groupBy("path")
        .agg(F.sort_array(F.collect_list(line)).alias("_lines"))
        .select("path", F.transform("_lines", lambda x: x["line"]).alias("contexts"))
    )
