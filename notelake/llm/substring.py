"""Repeated passages over a sparse de Bruijn graph of token k-mers.

A window of ``window`` words is represented by the least hash among its k-mers (k = 20 of 35 words). The
chosen k-mers are the edges of the graph; only those that occur twice or more are kept, because a repeated
window has a repeated representative. Neighbouring edges that always follow each other are compacted into
paths by joins on the edge hash: every occurrence of such a path carries the same words, so its inner
windows are repeated without looking at them one by one. The windows that reach beyond a path, at its
branches and at the ends of texts, are verified by 128-bit hashes of their words at their source coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm.common import WordHashes, hashed_words, owner, raw_texts, slices, stored, text_of, window_hashes

#: Odd multipliers of three independent hash functions.
EDGE, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
EDGES = "row long, doc_id long, content long, n_words long, whole string, edges array<struct<hash: long, pos: int>>"


def sliding(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """pick over values[i : i + n] for every i."""
    width = 1
    while width < n:
        step = min(width, n - width)
        values = pick(values[:-step], values[step:]) if len(values) > step else values[:0]
        width += step
    return values


def representatives(words: np.ndarray, starts: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k-mers that are the least of some window of their own text, and the hash of every k-mer."""
    hashes = np.maximum(window_hashes(words, k, EDGE), np.uint64(1))
    reach = window - k + 1
    least = sliding(hashes, reach, np.minimum)
    if not len(least):
        return np.empty(0, np.int64), hashes
    inside = np.arange(len(least)) + window <= starts[1:][owner(starts)[: len(least)]]
    least = np.where(inside, least, np.uint64(0))
    pad = np.zeros(reach - 1, np.uint64)
    best = sliding(np.concatenate([pad, least, pad]), reach, np.maximum)
    return np.flatnonzero(best == hashes), hashes


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def find_edges(docs: DataFrame, k: int, window: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in slices(batches):
            texts = [x.split() for x in raw_texts(batch)]
            words, starts = hashed_words(texts, table)
            at, hashes = representatives(words, starts, k, window)
            ends = np.searchsorted(at, starts).astype(np.int32)
            local = (at - starts[:-1][owner(starts)[at]]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(local)], ["hash", "pos"])
            n = pa.array(np.diff(starts))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("content"), n, pa.array([digest(x) for x in texts], pa.string()), pa.ListArray.from_arrays(pa.array(ends), pairs)], ["row", "doc_id", "content", "n_words", "whole", "edges"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("content"), "text").mapInArrow(make, EDGES)


def compacted(edges: DataFrame) -> DataFrame:
    """row and its repeated edges in order: pos, joined (the edge before is in the same path)."""
    every = edges.select("row", F.posexplode("edges").alias("nr", "edge")).select("row", "nr", "edge.*")
    # Written first: a join of two plain exchanges can split a very frequent edge over many tasks.
    twice = stored(every.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "twice")
    repeated = stored(every.join(twice, "hash"), "edges")
    order = Window.partitionBy("row").orderBy("nr")
    before, after = F.lag(F.struct("nr", "hash", "pos")).over(order), F.lead(F.struct("nr", "hash", "pos")).over(order)
    linked = repeated.withColumns({"b": before, "a": after}).select(
        "row", "nr", "hash", "pos",
        F.when(F.col("b.nr") == F.col("nr") - 1, F.xxhash64("b.hash", F.col("pos") - F.col("b.pos"))).alias("before"),
        F.when(F.col("a.nr") == F.col("nr") + 1, F.xxhash64("a.hash", F.col("a.pos") - F.col("pos"))).alias("after"),
    )
    one = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))
    degrees = linked.groupBy("hash").agg(one("before").alias("one_before"), one("after").alias("one_after"))
    degrees = stored(degrees.where("one_before or one_after"), "degrees")
    known = linked.select("row", "nr", "hash", "pos").join(degrees, "hash", "left")
    each = F.struct("nr", "pos", F.coalesce("one_before", F.lit(False)).alias("b"), F.coalesce("one_after", F.lit(False)).alias("a"))
    # At most the edges of one document.
    return known.groupBy("row").agg(F.array_sort(F.collect_list(each)).alias("steps"))


def path_windows(docs: DataFrame, k: int, window: int) -> DataFrame:
    """doc_id, text, steps -> rid, doc_id, text, inner [first, last] windows, open windows with 128-bit hashes."""
    pair = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    open_ = pa.list_(pa.struct([("start", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in slices(batches):
            texts = [x.split() for x in raw_texts(batch)]
            words, starts = hashed_words(texts, table)
            steps = batch.column("steps")
            flat = steps.flatten()
            own = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(steps).to_numpy(zero_copy_only=False))
            nr, pos = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("nr", "pos"))
            b, a = (flat.field(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("b", "a"))
            place = starts[own] + pos
            joined = np.zeros(len(nr), bool)
            joined[1:] = (own[1:] == own[:-1]) & (nr[1:] == nr[:-1] + 1) & a[:-1] & b[1:]
            head = np.flatnonzero(~joined)
            tail = np.append(head[1:], len(nr)) - 1
            first, last = place[head], place[tail] + k - window  # windows inside the path
            full = last >= first
            first, last, of = first[full], last[full], own[head][full]
            # Windows that hold a repeated edge, but for those inside a path and across the end of a text.
            cover = np.zeros(len(words) + window + 1, np.int64)
            low = np.maximum(starts[own], place + k - window)
            np.add.at(cover, low, 1)
            np.add.at(cover, place + 1, -1)
            inner = np.zeros(len(words) + window + 1, np.int64)
            np.add.at(inner, first, 1)
            np.add.at(inner, last + 1, -1)
            todo = np.flatnonzero((np.cumsum(cover)[: len(words)] > 0) & (np.cumsum(inner)[: len(words)] == 0))
            who = owner(starts)[todo]
            fits = todo + window <= starts[1:][who]
            todo, who = todo[fits], who[fits]
            h1, h2 = (window_hashes(words, window, x)[todo].view(np.int64) for x in (FIRST, SECOND))
            ends = lambda w: pa.array(np.concatenate([[0], np.cumsum(np.bincount(w, minlength=batch.num_rows))]).astype(np.int32))
            small = lambda x, w: pa.array((x - starts[w]).astype(np.int32))
            inside = pa.ListArray.from_arrays(ends(of), pa.StructArray.from_arrays([small(first, of), small(last, of)], ["first", "last"])).cast(pair)
            beyond = pa.ListArray.from_arrays(ends(who), pa.StructArray.from_arrays([small(todo, who), pa.array(h1), pa.array(h2)], ["start", "h1", "h2"])).cast(open_)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), inside, beyond], ["doc_id", "text", "inner", "beyond"])

    made = docs.mapInArrow(make, "doc_id long, text string, inner array<struct<first: int, last: int>>, beyond array<struct<start: int, h1: long, h2: long>>")
    return made.select(F.monotonically_increasing_id().alias("rid"), "*")


def cut_repeats(docs: DataFrame, window: int) -> DataFrame:
    """Text without the words of its repeated windows (inner ranges and verified starts)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, sizes, gone = [], [], []
            for text, inner, starts in zip(raw_texts(batch), batch.column("inner").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = text.split()
                cover = np.zeros(len(words) + 1, np.int64)
                for x in inner:
                    cover[x["first"]] += 1
                    cover[x["last"] + window] -= 1
                if starts:
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, np.array(starts) + window, -1)
                keep = np.cumsum(cover)[:-1] == 0
                kept.append(b" ".join(compress(words, keep.tolist())).decode("utf-8", "replace"))
                sizes.append(len(words))
                gone.append(len(words) - int(keep.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.mapInArrow(make, "doc_id long, n_words long, n_removed long, kept string")


def repeated_passages(docs: DataFrame, *, window: int = 35, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: documents with a repeated edge (doc_id, n_words, n_removed, kept text), and the others
    (doc_id, n_words, whole: the sha256 of their words).

    A word goes if a window over it also starts elsewhere, in the same document too. Texts shorter than a
    window, empty and null ones lose nothing. Repeated rows are copies of each other.
    """
    if not window / 2 < k <= window:
        raise ValueError("k must be over half the window, so that neighbouring edges overlap")
    docs = text_of(docs, id_col=id_col, text_col=text_col)
    edges = stored(find_edges(docs, k, window), "kmers")
    steps = stored(compacted(edges), "paths")
    others = edges.join(steps.select("row"), "row", "left_anti").select("doc_id", "n_words", "whole")
    # Rows of equal id and text have equal steps, so either finds its own.
    key = ["content", "id"]
    found = edges.select("row", "content", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id")).join(steps, "row").groupBy(*key).agg(F.first("steps").alias("steps"))
    keyed = docs.select(F.xxhash64("text").alias("content"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "doc_id", "text")
    parts = stored(path_windows(keyed.join(found, key).select("doc_id", "text", "steps"), k, window), "windows")
    beyond = parts.select("rid", F.explode("beyond").alias("w")).select("rid", "w.*")
    twice = stored(beyond.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "verified")
    starts = beyond.join(twice, ["h1", "h2"]).groupBy("rid").agg(F.collect_list("start").alias("starts"))
    return cut_repeats(parts.select("rid", "doc_id", "text", "inner").join(starts, "rid", "left").select("doc_id", "text", "inner", "starts"), window), others
