"""Note files, path listings, dirty-path lists and submodule files."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.markdown import normal_path, parse_notes
from notelake.functions.paths import first_folder
from notelake.functions.text import trim_ws
from notelake.params import VAULT_FOLDERS
from notelake.sources.files import folder_files, named_files

#: File systems whose folders are listed by ``sources.files``; others are listed by Spark, which hides names that begin with ``_`` or ``.``.
LISTED = ("file", "hdfs", "s3", "s3a", "gs", "gcs")


def _base(root: str) -> str:
    return root.rstrip("/").split("://")[-1].removeprefix("file:")


def _own(root: str) -> bool:
    return "://" not in root or root.split("://", 1)[0] in LISTED


def _relative(path, root: str):
    """Path below ``root``; the reader gives unescaped file URIs."""
    return normal_path(F.substring_index(path, f"{_base(root)}/", -1))


def list_notes(spark: SparkSession, root: str, folders: Iterable[str] | None = VAULT_FOLDERS) -> DataFrame:
    """Markdown files below ``root``: ``path, file_size, mtime_ms``; contents are not read.

    Hidden folders are skipped. ``folders`` restricts the first path segment; None takes all.
    """
    return _files(spark, root, folders, None, False).select("path", "file_size", "mtime_ms")


def read_notes(
    spark: SparkSession,
    root: str,
    folders: Iterable[str] | None = VAULT_FOLDERS,
    modified_since: datetime | None = None,
) -> DataFrame:
    """Markdown files with their text: ``path, file_size, mtime_ms, content``.

    With ``modified_since`` older files are listed but not read.
    """
    return _files(spark, root, folders, modified_since, True)


def read_changed_notes(
    spark: SparkSession,
    root: str,
    changed: DataFrame,
    folders: Iterable[str] | None = VAULT_FOLDERS,
) -> DataFrame:
    """The notes of ``changed`` (``path`` below ``root``), as from ``read_notes``; missing files have no row.

    However many there are, each file is opened by the task that has its name, and no other file is listed or opened.
    """
    if not _own(root):
        return read_notes(spark, root, folders).join(changed.select("path").distinct(), "path", "left_semi")
    return _within(named_files(spark, root, changed), folders)


def _within(files: DataFrame, folders: Iterable[str] | None) -> DataFrame:
    return files if folders is None else files.filter(first_folder(F.col("path")).isin(list(folders)))


def _files(spark: SparkSession, root: str, folders: Iterable[str] | None, since: datetime | None, contents: bool) -> DataFrame:
    if _own(root):
        since_ms = -1 if since is None else int(since.timestamp() * 1000)
        return _within(folder_files(spark, root, ".md", contents, since_ms), folders)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    if since is not None:
        listed = listed.filter(F.col("modificationTime") >= F.lit(since))
    files = listed.select(
        _relative(F.col("path"), root).alias("path"),
        F.col("length").alias("file_size"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
        F.decode("content", "UTF-8").alias("content"),
    )
    return _within(files, folders)


def catalogue(notes: DataFrame) -> DataFrame:
    """Document listing: path, title, hash, size (bytes and KB), mtime, frontmatter."""
    return parse_notes(notes).select(
        "doc_path",
        "title",
        "content_hash",
        "file_size",
        F.round(F.col("file_size") / 1024, 1).alias("size_kb"),
        "mtime_ms",
        "frontmatter",
    )


def clean_paths(lines: DataFrame, column: str = "value", root: str | None = None) -> DataFrame:
    """Distinct trimmed non-empty paths of a change list; with ``root`` absolute paths below it are cut to relative ones."""
    path = normal_path(trim_ws(F.col(column)))
    if root is not None:
        above = f"{_base(root)}/"
        path = F.when(path.startswith(above), F.substr(path, F.lit(len(above) + 1))).otherwise(path)
    return lines.select(path.alias("path")).filter("path <> ''").distinct()


def read_dirty_paths(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Changed paths from text files; a missing file or directory is an empty list."""
    lines = (
        spark.read.format("text").option("ignoreMissingFiles", True).load(path)
        if _exists(spark, path)
        else spark.createDataFrame([], "value string")
    )
    return clean_paths(lines, root=root)


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(path)
        return True
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def read_submodule_files(spark: SparkSession, folder: str) -> DataFrame:
    """Submodule files of many repositories: ``repo, content``.

    ``.gitmodules`` in a folder is that of the repository there; ``<repo>.gitmodules`` that of the named one.
    """
    name = F.substring_index("path", "/", -1)
    above = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    repo = F.when(name == ".gitmodules", above).otherwise(F.regexp_extract("path", "([^/]+)\\.gitmodules$", 1))
    if _own(folder):
        return folder_files(spark, folder, ".gitmodules").select(repo.alias("repo"), "content")
    texts = spark.read.option("pathGlobFilter", "*.gitmodules").text(folder, wholetext=True)
    return texts.select(F.regexp_extract(F.input_file_name(), "([^/]+)\\.gitmodules$", 1).alias("repo"), F.col("value").alias("content"))
