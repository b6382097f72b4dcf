"""Namespaces: repository root, submodules, monorepo directories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.paths import ancestors, normalize_path
from notelake.functions.text import trim_ws
from notelake.params import NAMESPACE_PARENTS

# The submodule file format.
SECTION = '^\\[submodule\\s+"(.+)"\\]$'
KEY_VALUE = "^(\\w+)\\s*=\\s*(.+)$"

#: Names that travel to the tasks, at most (some 20 MB).
MAX_LISTED_NAMES = 200_000


def submodules(files: DataFrame) -> DataFrame:
    """Declared submodules of many repositories: ``repo, content`` to
    ``repo, section, name, path, url, branch``. Entries without path or url are dropped.
    """
    lines = files.select(
        "repo", F.posexplode(F.split("content", "\n")).alias("line_no", "_raw")
    ).withColumn("line", trim_ws(F.col("_raw")))
    order = Window.partitionBy("repo").orderBy("line_no")
    keyed = lines.withColumn(
        "section", F.sum(F.col("line").rlike(SECTION).cast("int")).over(order)
    ).filter("section > 0")
    key = F.regexp_extract("line", KEY_VALUE, 1)
    value = trim_ws(F.regexp_extract("line", KEY_VALUE, 2))
    last = lambda k: F.max_by(F.when(key == k, value), F.when(key == k, F.col("line_no")))
    return (
        keyed.groupBy("repo", "section")
        .agg(
            F.max(F.regexp_extract("line", SECTION, 1)).alias("name"),
            last("path").alias("path"),
            last("url").alias("url"),
            last("branch").alias("branch"),
        )
        .filter("path IS NOT NULL AND url IS NOT NULL")
    )


def list_namespaces(
    repos: DataFrame,
    declared: DataFrame,
    directories: DataFrame,
    parents: tuple[str, ...] = NAMESPACE_PARENTS,
) -> DataFrame:
    """``repo, name, kind, git_url``: the root, submodules that exist as a directory,
    and directories one level below a namespace parent.

    ``directories``: every ``repo, path`` of a directory.
    """
    root = repos.select("repo", F.lit("root").alias("name"), F.lit("root").alias("kind"), F.lit(None).cast("string").alias("git_url"))
    present = declared.join(directories, ["repo", "path"], "left_semi").select(
        "repo", F.col("path").alias("name"), F.lit("submodule").alias("kind"), F.col("url").alias("git_url")
    )
    pattern = f"^(?:{'|'.join(parents)})/[^/]+$"
    below = directories.filter(F.col("path").rlike(pattern)).select(
        "repo", F.col("path").alias("name"), F.lit("directory").alias("kind"), F.lit(None).cast("string").alias("git_url")
    )
    return root.unionByName(present).unionByName(below.distinct())


def directories_of(paths: DataFrame) -> DataFrame:
    """Every directory that holds a listed file: ``repo, path`` of files to directories."""
    return paths.select(
        "repo", F.explode(F.slice(ancestors(F.col("path")), F.lit(2), F.size(F.split("path", "/")))).alias("path")
    ).distinct()


def submodule_warnings(declared: DataFrame, directories: DataFrame) -> DataFrame:
    """One warning per declared submodule without a directory."""
    return declared.join(directories, ["repo", "path"], "left_anti").select(
        "repo",
        "path",
        F.concat(
            F.lit("declared submodule "),
            "path",
            F.lit(" has no directory; fetch it with git submodule update --init "),
            "path",
        ).alias("warning"),
    )


def with_namespace(docs: DataFrame, namespaces: DataFrame, path: str = "doc_path", default: str = "root") -> DataFrame:
    """Add the ``namespace`` of every row by its path: the deepest ancestor that is a name.

    Up to MAX_LISTED_NAMES names travel to the tasks, where a path asks for its ancestors from the deepest up. Only the
    path goes through that function; the rows, which may hold whole texts, stay where they are. More names than that
    are joined, and only with the paths.
    """
    names = namespaces.filter(F.col("name") != default).select("name").distinct()
    listed = [r.name for r in names.limit(MAX_LISTED_NAMES + 1).collect()]
    if len(listed) > MAX_LISTED_NAMES:
        assigned = assign_namespaces(docs.select(F.col(path).alias("path")).distinct(), namespaces, default)
        named = assigned.filter(F.col("namespace") != default).withColumnRenamed("path", "_path")
        out = docs.join(named, F.col(path) == F.col("_path"), "left").drop("_path")
        return out.withColumn("namespace", F.coalesce("namespace", F.lit(default)))
    known = docs.sparkSession.sparkContext.broadcast(frozenset(listed))

    def deepest(paths: pd.Series) -> pd.Series:
        names = known.value

        def find(at: str | None) -> str:
            while at:
                if at in names:
                    return at
                at = at.rpartition("/")[0]
            return default

        return paths.map(find, na_action=None)

    return docs.withColumn("namespace", F.pandas_udf(deepest, "string")(normalize_path(F.col(path))))


def assign_namespaces(paths: DataFrame, namespaces: DataFrame, default: str = "root") -> DataFrame:
    """Namespace of every ``path``: the longest namespace name that is an ancestor."""
    named = namespaces.filter(F.col("name") != default).select("name").distinct()
    hits = (
        paths.select("path", F.explode(ancestors(F.col("path"))).alias("name"))
        .join(named, "name")
        .groupBy("path")
        .agg(F.max_by("name", F.length("name")).alias("namespace"))
    )
    return paths.join(hits, "path", "left").withColumn(
        "namespace", F.coalesce("namespace", F.lit(default))
    )
