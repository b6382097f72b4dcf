"""Lexical index tables: postings with positions, block bounds, chunk lengths, corpus statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import tokens
from notelake.params import FIELDS

CHUNK_KEY = ("doc_id", "chunk_index")
#: Documents of a block share the number without its last bits. A place is the field's number before the position.
BLOCK_BITS, PLACE_BITS = 5, 26
#: Folders that terms are dealt to, parts of a frequent term, share of the chunks that makes a term frequent,
#: one in how many chunks is looked at to find such terms, and how many of them there may be.
BUCKETS, SPREAD, FREQUENT, SAMPLE, MAX_FREQUENT = 16, 8, 0.25, 16, 1000
#: Tokens that a task groups at a time (a longer chunk on its own), and about how many it sorts: larger tables have more parts.
SLICE_TOKENS, PART_TOKENS = 1 << 19, 1 << 20
#: Postings whose block bounds a task packs at a time, and rows it gives back at a time.
PACK_ROWS, OUT_ROWS = 1 << 19, 1 << 16
POSTING = (
    "term string, doc_id long, chunk_index int, namespace string, n_tokens long, origin int, doc_no long, block long, "
    + ", ".join(f"tf_{f} int" for f in FIELDS)
    + ", places array<int>"
)


def lexical_rows(chunks: DataFrame) -> DataFrame:
    """The five lexical fields of every chunk, from chunk rows with document columns."""
    namespace = F.col("namespace") if "namespace" in chunks.columns else F.lit("root")
    return chunks.select(
        *CHUNK_KEY,
        namespace.alias("namespace"),
        "title",
        "heading_path",
        F.col("text").alias("body"),
        F.col("tags_text").alias("tags"),
        F.col("properties_text").alias("properties"),
        *[c for c in ("origin", "doc_no") if c in chunks.columns],
    )


def _with_tokens(rows: DataFrame) -> DataFrame:
    held = set(rows.columns)
    namespace = F.col("namespace") if "namespace" in held else F.lit("root")
    origin = F.col("origin") if "origin" in held else F.lit(0)
    number = F.col("doc_no") if "doc_no" in held else F.col("doc_id")
    fields = [(tokens(F.col(f)) if f in held else F.array().cast("array<string>")).alias(f"_{f}") for f in FIELDS]
    return rows.select(
        *CHUNK_KEY, namespace.alias("namespace"), origin.cast("int").alias("origin"), number.cast("long").alias("doc_no"), *fields
    )


def chunk_lengths(rows: DataFrame) -> DataFrame:
    """Tokens per chunk over all fields."""
    total = sum((F.size(f"_{f}") for f in FIELDS), F.lit(0))
    return _with_tokens(rows).select(*CHUNK_KEY, total.cast("long").alias("n_tokens"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of chunks and of tokens."""
    return lengths.agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens")
    )


def token_positions(rows: DataFrame) -> DataFrame:
    """One row per token: ``(term, doc_id, chunk_index, namespace, n_tokens, field, pos)``.

    The five token arrays are laid end to end and exploded once; the field and
    the position in it follow from the array sizes.
    """
    ends, total = [], F.lit(0)
    for f in FIELDS:
        total = total + F.size(f"_{f}")
        ends.append(total)
    laid = _with_tokens(rows).select(
        *CHUNK_KEY,
        "namespace",
        *[end.alias(f"_end{i}") for i, end in enumerate(ends)],
        F.concat(*[F.col(f"_{f}") for f in FIELDS]).alias("_all"),
    )
    exploded = laid.select(
        *CHUNK_KEY,
        "namespace",
        *[f"_end{i}" for i in range(len(FIELDS))],
        # Outer: a plain explode would infer a size filter and tokenise twice.
        F.posexplode_outer("_all").alias("_at", "term"),
    ).filter("term IS NOT NULL")
    field, start = F.lit(len(FIELDS) - 1), F.col(f"_end{len(FIELDS) - 2}")
    for i in range(len(FIELDS) - 2, -1, -1):
        inside = F.col("_at") < F.col(f"_end{i}")
        field = F.when(inside, i).otherwise(field)
        start = F.when(inside, F.col(f"_end{i - 1}") if i else F.lit(0)).otherwise(start)
    return exploded.select(
        "term",
        *CHUNK_KEY,
        "namespace",
        F.col(f"_end{len(FIELDS) - 1}").alias("n_tokens"),
        field.cast("tinyint").alias("field"),
        (F.col("_at") - start).cast("int").alias("pos"),
    )


def token_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_TOKENS) -> Iterator[pa.RecordBatch]:
    """The rows in order, at most ``limit`` tokens at a time; a row with more tokens comes alone."""
    for batch in batches:
        ends = np.cumsum(sum(np.diff(batch.column(f"_{f}").offsets.to_numpy()).astype(np.int64) for f in FIELDS)) if batch.num_rows else []
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def build_postings(rows: DataFrame, marks: bool = False) -> DataFrame:
    """One row per (term, chunk): token count per field, chunk length, places, and the block of the document.

    A place is ``field * 2^26 + position``; the places of a posting are in order. A chunk is one row, so its
    tokens are grouped where they are made and nothing is shuffled. The postings of a slice are in the order they are
    stored in: by bucket, term and block. With ``marks`` every chunk also has a row of the empty term, which carries
    the length of chunks without any token.
    """

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in token_slices(batches):
            n = batch.num_rows
            lists = [batch.column(f"_{f}") for f in FIELDS]
            sizes = np.stack([np.diff(x.offsets.to_numpy()) for x in lists], axis=1) if n else np.zeros((0, len(FIELDS)), np.int64)
            flat = pa.concat_arrays([pa.array([""]), *(x.flatten() for x in lists)]).dictionary_encode()
            codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)[1:]
            row, place = [], []
            for i in range(len(FIELDS)):
                own = np.repeat(np.arange(n), sizes[:, i])
                row.append(own)
                place.append((i << PLACE_BITS) + np.arange(len(own)) - np.repeat(np.cumsum(sizes[:, i]) - sizes[:, i], sizes[:, i]))
            row, place = np.concatenate(row), np.concatenate(place).astype(np.int32)
            if marks:
                row, place, codes = (np.concatenate(x) for x in ((np.arange(n), row), (np.full(n, -1, np.int32), place), (np.zeros(n, np.int64), codes)))
            numbers = batch.column("doc_no").to_numpy(zero_copy_only=False).astype(np.int64)
            terms = in_buckets(flat.dictionary)
            rows = np.lexsort((numbers, batch.column("origin").to_numpy(zero_copy_only=False)))
            key = inverse(terms)[codes] * n + inverse(rows)[row]
            by = np.argsort(key, kind="stable")
            key, place = key[by], place[by]
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            own = pa.array(rows[key[begin] % n] if n else rows)
            term = flat.dictionary.take(pa.array(terms[key[begin] // max(n, 1)]))
            field = np.where(place < 0, len(FIELDS), place >> PLACE_BITS)
            count = lambda i: np.add.reduceat(field == i, begin, dtype=np.int32) if len(begin) else np.zeros(0, np.int32)  # noqa: E731,B023
            kept = place >= 0
            ends = np.concatenate([[0], np.cumsum(np.add.reduceat(kept, begin, dtype=np.int64) if len(begin) else [])]).astype(np.int32)
            columns = [
                term, batch.column("doc_id").take(own), batch.column("chunk_index").take(own).cast(pa.int32()), batch.column("namespace").take(own),
                pa.array(sizes.sum(axis=1)).take(own), batch.column("origin").take(own), pa.array(numbers).take(own), pa.array(numbers >> BLOCK_BITS).take(own),
                *(pa.array(count(i)) for i in range(len(FIELDS))), pa.ListArray.from_arrays(pa.array(ends), pa.array(place[kept])),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in POSTING.split(", ")])

    return _with_tokens(rows).mapInArrow(group, POSTING)


def bucket_of(term: Column) -> Column:
    """Folder number of a term; -1 for the rows that only carry a chunk's length."""
    return F.when(term == "", -1).otherwise(F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def in_buckets(terms: pa.Array) -> np.ndarray:
    """The places of distinct terms, by bucket and term."""
    bucket = [zlib.crc32(t) % BUCKETS if t else -1 for t in terms.cast(pa.binary()).to_pylist()]
    return pc.sort_indices(pa.table({"bucket": bucket, "term": terms}), [("bucket", "ascending"), ("term", "ascending")]).to_numpy().astype(np.int64)


def inverse(order: np.ndarray) -> np.ndarray:
    """Where each place comes in an order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def lexical_sketch(rows: DataFrame) -> tuple[list[str], int]:
    """Terms found in at least FREQUENT of the chunks, or in as many as fill a quarter of a part, and in how many
    parts a bucket's terms are dealt; both by a fixed sample of the chunks."""
    some = rows.filter(F.pmod(F.xxhash64(*CHUNK_KEY), F.lit(SAMPLE)) == 0)
    words = _with_tokens(some).select(F.concat(*[F.col(f"_{f}") for f in FIELDS]).alias("_all"))
    said = words.select(F.explode(F.array_distinct("_all")).alias("term"))
    total = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_all")), F.lit(0)).alias("tokens")).first()
    top = said.agg(F.expr(f"approx_top_k(term, {MAX_FREQUENT}, {20 * MAX_FREQUENT})").alias("top")).first().top
    least = max(2, min(FREQUENT * total.n, PART_TOKENS / 4 / SAMPLE))
    return sorted(x.item for x in top or [] if x["count"] >= least), max(1, -(-total.tokens * SAMPLE // (BUCKETS * PART_TOKENS)))


def frequent_terms(rows: DataFrame) -> list[str]:
    """The terms that are dealt to several parts of their bucket."""
    return lexical_sketch(rows)[0]


def _part(frequent: list[str], parts: int) -> Column:
    """Part of a posting in its bucket. A small table splits the frequent terms only; a larger one also deals the others, by term."""
    often = F.col("term").isin(frequent) | (F.col("term") == "") if frequent else F.col("term") == ""
    other = F.lit(0) if parts == 1 else F.pmod(F.xxhash64("term"), F.lit(parts))
    return F.when(often, F.pmod(F.xxhash64("origin", "block"), F.lit(SPREAD if parts == 1 else parts))).otherwise(other).cast("int")


def dealt(postings: DataFrame, frequent: list[str], parts: int = 1) -> DataFrame:
    """Postings in the order they are stored in: by bucket, a frequent term in several parts by block, sorted by term.

    With ``parts`` above 1 every part of every bucket is a partition of its own, so what a task sorts does not grow with the table.
    """
    laid = postings.withColumn("bucket", bucket_of(F.col("term"))).withColumn("_part", _part(frequent, parts))
    if parts > 1:
        laid = laid.repartitionById((BUCKETS + 1) * parts, (F.col("bucket") + 1) * parts + F.col("_part"))
    else:
        laid = laid.repartition("bucket", "_part")
    return laid.sortWithinPartitions("bucket", "term", "origin", "block").drop("_part")


def dealt_blocks(postings: DataFrame, frequent: list[str], parts: int = 1) -> DataFrame:
    """Block bounds of stored postings, in their order. The rows are dealt once, as the postings were, and grouped where they arrive."""
    narrow = postings.select("bucket", "term", "origin", "block", *[f"tf_{f}" for f in FIELDS], "n_tokens", _part(frequent, parts).alias("_part"))
    narrow = narrow.filter("term <> ''")
    laid = narrow.repartition((BUCKETS + 1) * parts, "bucket", "_part") if parts > 1 else narrow.repartition("bucket", "_part")
    return term_blocks(laid).drop("_part").sortWithinPartitions("bucket", "term")


def packed_blocks(postings: DataFrame, tokens: int) -> DataFrame:
    """Block bounds of stored postings of about ``tokens`` tokens, as ``term_blocks`` has them, in their order.

    Every task bounds what it reads and packs the rows that go to one partition into a few compressed ones, so the
    shuffle moves a few bytes a row. Blocks that several tasks have read are put together where they arrive.
    """
    parts = max(1, -(-tokens // (BUCKETS * PART_TOKENS)))
    keys, most = ["bucket", "term", "origin", "block"], [f"most_{f}" for f in FIELDS]
    order = [(k, "ascending") for k in keys]

    def bounded(rows: pa.Table) -> pa.Table:
        made = rows.group_by(keys, use_threads=False).aggregate([("n", "sum"), *((m, "max") for m in most), ("least_tokens", "min")])
        return made.select([*keys, "n_sum", *(f"{m}_max" for m in most), "least_tokens_min"]).rename_columns([*keys, "n", *most, "least_tokens"])

    def packed(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = bounded(pa.Table.from_batches(rows))
        terms = made["term"].combine_chunks().dictionary_encode()
        part = np.array([zlib.crc32(t) // BUCKETS % parts for t in terms.dictionary.cast(pa.binary()).to_pylist()], np.int64)
        to = made["bucket"].to_numpy().astype(np.int64) * parts + part[terms.indices.to_numpy()]
        made = made.append_column("to", pa.array(to)).sort_by([("to", "ascending"), *order])
        to = made["to"].to_numpy()
        begin = np.flatnonzero(np.diff(to, prepend=-1))
        blobs = []
        for at, end in zip(begin, np.append(begin[1:], len(to)), strict=True):
            with pa.BufferOutputStream() as out:
                one = made.slice(at, end - at).drop_columns(["to"]).combine_chunks()
                # Blocks of a term rise: what is stored of them is by how much.
                block = one["block"].to_numpy()
                one = one.set_column(one.column_names.index("block"), "block", pa.array(np.diff(block, prepend=0)))
                with pa.ipc.new_stream(out, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(one)
                blobs.append(out.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(to[begin].astype(np.int32)), pa.array(blobs, pa.binary())], ["to", "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= PACK_ROWS:
                yield from packed(held)
                held = []
        if sum(x.num_rows for x in held):
            yield from packed(held)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for blob in (x for batch in batches for x in batch.column("rows")):
            one = pa.ipc.open_stream(blob.as_buffer()).read_all()
            held.append(one.set_column(one.column_names.index("block"), "block", pa.array(np.cumsum(one["block"].to_numpy()))))
        if held:
            yield from bounded(pa.concat_tables(held)).sort_by(order).combine_chunks().to_batches(OUT_ROWS)

    said = postings.filter("term <> ''").select(*keys, F.lit(1).cast("long").alias("n"), *[F.col(f"tf_{f}").alias(f"most_{f}") for f in FIELDS], F.col("n_tokens").alias("least_tokens"))
    laid = said.mapInArrow(pack, "to int, rows binary").repartitionById(BUCKETS * parts, "to")
    return laid.mapInArrow(unpack, said.schema)


def term_blocks(postings: DataFrame) -> DataFrame:
    """Per term and block of documents: postings, the most tokens of each field, and the shortest chunk."""
    most = [F.max(f"tf_{f}").alias(f"most_{f}") for f in FIELDS]
    keys = [c for c in ("bucket", "_part", "term", "origin", "block") if c in postings.columns]
    return postings.filter("term <> ''").groupBy(*keys).agg(F.count("*").alias("n"), *most, F.min("n_tokens").alias("least_tokens"))


def term_stats(postings: DataFrame) -> DataFrame:
    """Chunks per term."""
    return postings.filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
