"""Files below a folder as Python data sources: all names, Spark's hidden ones too, opened in tasks.

Spark's own file index leaves out names that begin with ``_`` or ``.``. These readers list folders themselves:
the driver lists folders only until there are enough of them to deal out, tasks list the rest and open the files.
Any file system that pyarrow can open works (local or mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FILES = "path string, file_size long, mtime_ms long, content string"
_ARROW = pa.schema([("path", pa.string()), ("file_size", pa.int64()), ("mtime_ms", pa.int64()), ("content", pa.string())])
#: Folders that the driver lists at most, folders that are dealt out, and bytes of text in a batch.
MAX_LISTED, SLICES, BATCH_BYTES = 2_000, 64, 8 << 20
#: Bytes at the end of a growing file in which its last line break is looked for at once.
TAIL = 1 << 16


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    if "://" in root or root.startswith("file:"):
        system, path = fs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "file://", 1))
        return system, path.rstrip("/")
    return fs.LocalFileSystem(), root.rstrip("/")


def _children(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path)


def _hidden(folder: str) -> bool:
    return folder.rsplit("/", 1)[-1].startswith(".")


def _rows(system: fs.FileSystem, root: str, files: Iterator[fs.FileInfo], contents: bool) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for info in files:
        text = None
        if contents:
            with system.open_input_stream(info.path) as stream:
                text = stream.read().decode("utf-8", "replace")
        held.append((info.path[len(root) :].lstrip("/"), info.size, info.mtime_ns // 1_000_000, text))
        size += info.size if contents else 200
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


@dataclass
class _Folder(InputPartition):
    path: str
    deep: bool


class _FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", ".md")
        self.contents, self.since = options.get("contents", "true") == "true", int(options.get("since_ms", "-1"))
        self.slices = int(options.get("slices", SLICES))

    def partitions(self) -> list[InputPartition]:
        """Folders breadth first, until there are enough; what is below the last ones is listed by their tasks."""
        system, root = opened(self.root)
        listed, waiting = [], [root]
        while waiting and len(waiting) < self.slices and len(listed) < MAX_LISTED:
            folder = waiting.pop(0)
            listed.append(folder)
            waiting += [x.path for x in _children(system, folder) if x.type == fs.FileType.Directory and not _hidden(x.path)]
        return [_Folder(x, False) for x in listed] + [_Folder(x, True) for x in waiting]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.root)

        def files() -> Iterator[fs.FileInfo]:
            open_ = [partition.path]
            while open_:
                for x in _children(system, open_.pop()):
                    if x.type == fs.FileType.Directory:
                        if partition.deep and not _hidden(x.path):
                            open_.append(x.path)
                    elif x.path.endswith(self.suffix) and x.mtime_ns // 1_000_000 >= self.since:
                        yield x

        yield from _rows(system, root, files(), self.contents)


class FolderFiles(DataSource):
    """``path, file_size, mtime_ms, content`` of the files below ``path`` whose name ends in ``suffix``.

    Hidden folders are skipped, hidden names are not. Options: ``contents`` (``false``: null contents, no file is
    opened), ``since_ms`` (files changed at that time or later), ``slices`` (folders that are dealt out).
    """

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _FilesReader(self.options)


def folder_files(spark: SparkSession, root: str, suffix: str = ".md", contents: bool = True, since_ms: int = -1) -> DataFrame:
    spark.dataSource.register(FolderFiles)
    return spark.read.format("folder_files").option("suffix", suffix).option("contents", str(contents).lower()).option("since_ms", since_ms).load(root)


def named_files(spark: SparkSession, root: str, paths: DataFrame, suffix: str = ".md") -> DataFrame:
    """The files of ``paths`` (``path`` below ``root``) that exist, as from ``folder_files``: each is opened by the task
    that has its name. Paths that leave the folder, or lead through a hidden one, are none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        for batch in batches:
            wanted = []
            for path in batch.column("path").to_pylist():
                parts = path.split("/")
                if path.endswith(suffix) and not any(x in ("", "..") or x.startswith(".") for x in parts[:-1]):
                    wanted.append(f"{top}/{path}")
            found = system.get_file_info(wanted) if wanted else []
            yield from _rows(system, top, (x for x in found if x.type == fs.FileType.File), True)

    return paths.select("path").filter("path IS NOT NULL").distinct().mapInArrow(read, FILES)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _LinesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def initialOffset(self) -> dict:  # noqa: N802 - the interface's name
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """For each file the end of its last whole line."""
        system, root = opened(self.root)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else [x for x in _children(system, root) if x.type == fs.FileType.File] if info.type == fs.FileType.Directory else []
        return {x.path: self._whole(system, x) for x in files}

    def _whole(self, system: fs.FileSystem, info: fs.FileInfo) -> int:
        with system.open_input_file(info.path) as file:
            end = info.size
            while end:
                begin = max(0, end - TAIL)
                at = file.read_at(end - begin, begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The new bytes of every file; a file that became shorter was written anew and is read from its beginning."""
        out = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            begin = begin if begin <= stop else 0
            if stop > begin:
                out.append(_Range(path, begin, stop))
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        system, _ = opened(self.root)
        with system.open_input_file(partition.path) as file:
            data = file.read_at(partition.end - partition.start, partition.start)
        for line in data.decode("utf-8", "replace").split("\n")[:-1]:
            yield (line,)


class AppendedLines(DataSource):
    """Lines of a file, or of the files of a folder, that producers append to; a line is read once it is whole.

    The offset is the number of bytes consumed of every file, so a list that grows is read once and in parts.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _LinesReader(self.options)


def appended_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of ``value``, for ``streaming.changes``."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").load(path)


def write_files(rows: DataFrame, root: str) -> None:
    """Write one file per row of ``path, content`` below ``root``, from the tasks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        made = set()
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                folder = f"{top}/{path}".rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{top}/{path}") as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.select("path", F.col("content").cast("string").alias("content")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
