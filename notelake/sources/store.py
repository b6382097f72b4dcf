"""Versioned note index on Parquet.

A version is a set of table folders ``<root>/<table>/folder=<version>-<token>``. The state after a version is one
file, ``<root>/manifest/<version>.json``, that names every folder a reader opens; it is created only if no other
writer has created it, so of two writers that start from the same state one wins and the other starts over from
the new state. Folders carry a random token, so writers never touch each other's files.

Rows keep where they come from: ``origin`` is the version that first wrote a document and ``doc_no`` its number
there. A version that changes or deletes documents writes a bitmap of the numbers it hides, and per term how many
chunks it hides. Merging versions rewrites their visible rows into one folder and leaves those keys as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.postings import BUCKETS, build_postings, bucket_of, dealt, dealt_blocks, lexical_rows, lexical_sketch, packed_blocks
from notelake.operators.sizing import broadcast_if_small
from notelake.sources.workdir import SHUFFLES_REMOVED, settings

TABLES = ("docs", "chunks", "postings", "blocks", "lengths", "vectors")
#: Columns that readers are not shown.
INNER = {"docs": ("origin", "doc_no", "body", "body_offset", "tags_text", "properties_text"), "postings": ()}
#: Row groups of tables in buckets, of which a task fills one in each bucket at a time, and rows of their pages: a reader
#: of some terms opens the pages that hold them.
BUCKETED = {"parquet.block.size": 8 << 20, "parquet.page.row.count.limit": 4096}
#: A task has the files of all buckets open, so its rows are not sorted by bucket, which would take disk for a copy of them.
BUCKETS_OPEN = {"spark.sql.maxConcurrentOutputFileWriters": str(BUCKETS + 1)}
#: How often a writer starts over when others are faster, and how many versions of about the same size are merged.
ATTEMPTS, FANOUT = 10, 4


class Conflict(Exception):
    """Another writer has created the version."""


@dataclass(frozen=True)
class Version:
    """A folder that readers open: the versions it holds, and what is visible in it."""

    folder: str
    low: int
    high: int
    applied: int  # hidden rows of versions up to this one are not in the folder any more
    tables: tuple[str, ...]
    rows: int = 0
    tokens: int = 0


@dataclass(frozen=True)
class State:
    """What readers see after a version."""

    version: int = 0
    dimension: int | None = None
    live: tuple[Version, ...] = ()
    batches: dict = field(default_factory=dict)  # stream name to its last batch and the folder of the changes

    def having(self, table: str) -> list[Version]:
        return [v for v in self.live if table in v.tables]


@dataclass(frozen=True)
class NoteIndex:
    """Tables of an index as seen by readers."""

    docs: DataFrame
    chunks: DataFrame
    postings: DataFrame | None
    blocks: DataFrame | None
    lengths: DataFrame | None
    vectors: DataFrame | None
    gone: DataFrame | None = None
    version: int = 0
    dimension: int | None = None
    rows: int = 0
    tokens: int = 0

    @property
    def stats(self) -> DataFrame:
        """One row: number of chunks and of tokens, as counted when they were written."""
        return self.docs.sparkSession.createDataFrame([(self.rows, self.tokens)], "n_rows long, total_tokens long")


def _paths(spark: SparkSession, path: str):
    """Hadoop path, its file system and the JVM."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _manifests(spark: SparkSession, root: str) -> list[str]:
    at, fs, _ = _paths(spark, f"{root}/manifest")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(n for n in names if n.endswith(".json") and not n.startswith("."))


def read_state(spark: SparkSession, root: str) -> State:
    """The newest state; version 0 if there is no index."""
    names = _manifests(spark, root)
    if not names:
        return State()
    at, fs, jvm = _paths(spark, f"{root}/manifest/{names[-1]}")
    stream = fs.open(at)
    try:
        held = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    live = tuple(Version(**(v | {"tables": tuple(v["tables"])})) for v in held["live"])
    return State(held["version"], held["dimension"], live, held["batches"])


def commit(spark: SparkSession, root: str, state: State) -> None:
    """Make a state visible. Raises ``Conflict`` when its version exists."""
    text = json.dumps({"version": state.version, "dimension": state.dimension, "batches": state.batches, "live": [v.__dict__ for v in state.live]})
    temp, fs, jvm = _paths(spark, f"{root}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/{state.version:010d}.json")
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never = spark.sparkContext._gateway.new_array(kind, 1)
    never[0] = kind.NONE
    try:
        # A rename that never replaces: the file appears whole, and for one writer only.
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(temp), fs.makeQualified(final), never)
    except Py4JJavaError as error:
        fs.delete(temp, False)
        if "FileAlreadyExists" in str(error.java_exception):
            raise Conflict(f"version {state.version} of {root} exists") from None
        raise


def committed(spark: SparkSession, root: str, attempt: Callable[[State], State | None]) -> State:
    """Run ``attempt`` on the newest state and commit what it returns, again on a newer state if another writer was
    faster. ``None`` means there is nothing to commit."""
    for _ in range(ATTEMPTS):
        state = read_state(spark, root)
        new = attempt(state)
        if new is None:
            return state
        try:
            commit(spark, root, new)
            return new
        except Conflict:
            continue
    raise Conflict(f"{root} kept changing")


def new_folder(version: int) -> str:
    return f"{version}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, root: str, table: str, folder: str) -> DataFrame:
    """Write one table of a version and return what was written."""
    path = f"{root}/{table}/folder={folder}"
    parted = [c for c in ("bucket",) if c in df.columns]
    with settings(df.sparkSession, SHUFFLES_REMOVED | BUCKETS_OPEN):
        df.write.mode("overwrite").partitionBy(*parted).options(compression="zstd", **(BUCKETED if parted else {})).parquet(path)
    order = [c for c in df.columns if c not in parted] + parted
    return df.sparkSession.read.schema(df.select(*order).schema).parquet(path).select(*df.columns)


def remove_table(spark: SparkSession, root: str, table: str, folder: str) -> None:
    """Delete a table of a version that no state names."""
    at, fs, _ = _paths(spark, f"{root}/{table}/folder={folder}")
    fs.delete(at, True)


def write_lexical(chunks: DataFrame, root: str, folder: str) -> tuple[int, int]:
    """Postings, block bounds and lengths of written chunk rows; returns the number of chunks and of tokens.

    Postings are written where they are made, slice by slice in their order: a shuffle of them takes several times the
    disk of the texts.
    """
    rows = lexical_rows(chunks) if "text" in chunks.columns else chunks
    postings = build_postings(rows, marks=True)
    written = write_table(postings.withColumn("bucket", bucket_of(F.col("term"))), root, "postings", folder)
    total = write_lengths(written, root, folder)
    write_table(packed_blocks(written, total[1]), root, "blocks", folder)
    return total


def write_postings(postings: DataFrame, frequent: list[str], parts: int, root: str, folder: str) -> tuple[int, int]:
    """The same of postings that several versions hold, which are laid by term again."""
    written = write_table(dealt(postings, frequent, parts), root, "postings", folder)
    write_table(dealt_blocks(written, frequent, parts), root, "blocks", folder)
    return write_lengths(written, root, folder)


def write_lengths(written: DataFrame, root: str, folder: str) -> tuple[int, int]:
    marks = written.filter((F.col("bucket") == -1) & (F.col("term") == ""))
    lengths = write_table(marks.select("doc_id", "chunk_index", "n_tokens", "origin", "doc_no"), root, "lengths", folder)
    total = lengths.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    return total.rows, total.tokens


def _read(spark: SparkSession, root: str, table: str, live: list[Version]) -> DataFrame | None:
    paths = [f"{root}/{table}/folder={v.folder}" for v in live if table in v.tables]
    if not paths:
        return None
    # Several folders in one scan; the folder is not a column that readers need.
    return spark.read.option("basePath", f"{root}/{table}").parquet(*paths).drop("folder")


def _place(number: Column) -> tuple[Column, Column]:
    """Which bitmap a document number is in, and its bit."""
    return F.bitmap_bucket_number(number + 1), F.bitmap_bit_position(number + 1)


def hidden_bits(spark: SparkSession, root: str, state: State) -> DataFrame | None:
    """``origin, part, bits``: one bitmap per 32,768 document numbers that has any hidden document."""
    held = _read(spark, root, "deletes", list(state.live))
    return None if held is None else held.groupBy("origin", "part").agg(F.bitmap_or_agg("bits").alias("bits"))


def visible(spark: SparkSession, root: str, table: str, state: State, live: list[Version] | None = None) -> DataFrame | None:
    """Rows of a table whose documents no version has hidden."""
    df = _read(spark, root, table, list(state.live) if live is None else live)
    bits = hidden_bits(spark, root, state)
    if df is None or bits is None or "doc_no" not in df.columns:
        return df
    part, bit = _place(F.col("doc_no"))
    # A bit per document, so the texts need not be moved to meet them.
    bits = F.broadcast(bits.select(F.col("origin").alias("_origin"), F.col("part").alias("_part"), "bits"))
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    seen = F.col("bits").isNull() | (F.getbit(byte, (bit % 8).cast("int")) == 0)
    return df.join(bits, (F.col("origin") == F.col("_origin")) & (part == F.col("_part")), "left").filter(seen).drop("_origin", "_part", "bits")


def hidden_terms(spark: SparkSession, root: str, state: State) -> DataFrame | None:
    """``bucket, term, n``: hidden chunks per term that the block tables still count."""
    held = _read(spark, root, "gone", list(state.live))
    if held is None:
        return None
    counts = reduce(lambda x, y: x | y, (F.col("origin").between(v.low, v.high) & (F.col("by") > v.applied) for v in state.live))
    return held.filter(counts & (F.col("term") != "")).select("bucket", "term", "n")


def load_index(spark: SparkSession, root: str) -> NoteIndex:
    """The newest state as tables."""
    state = read_state(spark, root)
    if not state.version:
        raise ValueError(f"no index at {root}")

    def table(name: str) -> DataFrame | None:
        if name == "blocks":  # bounds, which hidden documents do not make wrong
            return _read(spark, root, name, list(state.live))
        df = visible(spark, root, name, state)
        return df if df is None else df.drop(*INNER.get(name, ("origin", "doc_no")))

    total = sum(v.rows for v in state.live), sum(v.tokens for v in state.live)
    return NoteIndex(*[table(t) for t in TABLES], hidden_terms(spark, root, state), state.version, state.dimension, *total)


def hide(spark: SparkSession, root: str, folder: str, state: State, doomed: DataFrame) -> tuple[tuple[Version, ...], list[str]]:
    """Write the bitmaps and term counts that hide the documents ``doc_id``.

    Returns the versions with what stays visible in them, and the names of the tables that were written.
    """
    version = state.version + 1
    doomed = broadcast_if_small(doomed.select("doc_id").distinct())
    found = visible(spark, root, "docs", state).join(doomed, "doc_id", "left_semi")
    part, bit = _place(F.col("doc_no"))
    bits = found.select("origin", part.alias("part"), bit.alias("bit")).groupBy("origin", "part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    write_table(bits, root, "deletes", folder)
    lost = visible(spark, root, "chunks", state).join(doomed, "doc_id", "left_semi")
    rows = lexical_rows(lost) if "tags_text" in lost.columns else lost.withColumnRenamed("text", "body")
    counts = build_postings(rows, marks=True).groupBy("origin", "term").agg(F.count("*").alias("n"), F.sum(F.when(F.col("term") == "", F.col("n_tokens")).otherwise(0)).alias("tokens"))
    gone = counts.select("origin", "term", "n", "tokens", F.lit(version).alias("by"), bucket_of(F.col("term")).alias("bucket"))
    written = write_table(gone, root, "gone", folder)
    # One row per version that loses chunks.
    less = {r.origin: (r.n, r.tokens) for r in written.filter((F.col("bucket") == -1) & (F.col("term") == "")).collect()}
    live = []
    for v in state.live:
        own = [x for origin, x in less.items() if v.low <= origin <= v.high]
        live.append(replace(v, rows=v.rows - sum(x[0] for x in own), tokens=v.tokens - sum(x[1] for x in own)))
    return tuple(live), ["deletes", "gone"]


def merge_versions(spark: SparkSession, root: str, state: State, chosen: list[Version]) -> State:
    """The state in which neighbouring versions are one folder of their visible rows."""
    version = state.version + 1
    folder, tables = new_folder(version), []
    low, high = chosen[0].low, chosen[-1].high
    for table in ("docs", "chunks", "vectors"):
        rows = visible(spark, root, table, state, chosen)
        if rows is not None:
            write_table(rows, root, table, folder)
            tables.append(table)
    total = (0, 0)
    postings = visible(spark, root, "postings", state, chosen)
    if postings is not None:
        chunks = visible(spark, root, "chunks", state, chosen)
        total = write_postings(postings, *lexical_sketch(lexical_rows(chunks) if "tags_text" in chunks.columns else chunks.withColumnRenamed("text", "body")), root, folder)
        tables += ["postings", "blocks", "lengths"]
    inside = F.col("origin").between(low, high)
    bits, gone = _read(spark, root, "deletes", chosen), _read(spark, root, "gone", chosen)
    if bits is not None and low > state.live[0].low:  # what they hide of other versions stays hidden
        write_table(bits.filter(~inside).groupBy("origin", "part").agg(F.bitmap_or_agg("bits").alias("bits")), root, "deletes", folder)
        tables.append("deletes")
    if gone is not None and low > state.live[0].low:
        write_table(gone.filter(~inside), root, "gone", folder)
        tables.append("gone")
    one = Version(folder, low, high, state.version, tuple(tables), *total)
    live = tuple(v for v in state.live if v.high < low) + (one,) + tuple(v for v in state.live if v.low > high)
    return replace(state, version=version, live=live)


def due(state: State, fanout: int = FANOUT) -> list[Version]:
    """The newest ``fanout`` or more neighbouring versions of about the same size, if there are so many.

    Sizes are compared by powers of ``fanout``, so a chunk is rewritten once per power and the number of folders
    grows with the logarithm of the number of chunks.
    """

    def tier(v: Version) -> int:
        n, t = max(v.rows, 1), 0
        while n >= fanout:
            n, t = n // fanout, t + 1
        return t

    end = len(state.live)
    while end:
        begin, highest = end - 1, tier(state.live[end - 1])
        while begin and tier(state.live[begin - 1]) <= highest:
            begin -= 1
        if end - begin >= fanout:
            return list(state.live[begin:end])
        end = begin
    return []


def compact_index(spark: SparkSession, root: str, fanout: int = FANOUT) -> State:
    """Merge versions until no ``fanout`` neighbours are of about the same size."""
    while True:
        merged = []

        def attempt(state: State, merged: list = merged) -> State | None:
            merged[:] = due(state, fanout)
            return merge_versions(spark, root, state, merged) if merged else None

        state = committed(spark, root, attempt)
        if not merged:
            return state


def vacuum_index(spark: SparkSession, root: str, older_ms: int, keep: int = 1) -> int:
    """Delete folders that none of the last ``keep`` states names and manifests before those, if they were last
    touched before ``older_ms`` (epoch milliseconds), which has to be before any running writer began. Returns how many."""
    names = _manifests(spark, root)
    state = read_state(spark, root)
    used = {v.folder for v in state.live} | {b["folder"] for b in state.batches.values()}
    for name in names[-keep:-1] if keep > 1 else []:
        at, fs, jvm = _paths(spark, f"{root}/manifest/{name}")
        stream = fs.open(at)
        held = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        used |= {v["folder"] for v in held["live"]} | {b["folder"] for b in held["batches"].values()}
    top, fs, _ = _paths(spark, root)
    done = 0
    for table in fs.listStatus(top):
        for part in fs.listStatus(table.getPath()):
            name = part.getPath().getName()
            old = name in names[:-keep] or name.startswith("folder=") and name[7:] not in used
            if old and part.getModificationTime() < older_ms:
                fs.delete(part.getPath(), True)
                done += 1
    return done


__all__ = ["BUCKETS", "Conflict", "NoteIndex", "State", "Version", "commit", "committed", "compact_index", "due", "hide", "load_index", "new_folder", "read_state", "remove_table", "vacuum_index", "visible", "write_lexical", "write_table"]
