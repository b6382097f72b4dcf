"""Invertible Bloom lookup sketches of documents.

A text is a set of paragraph digests: paragraphs end at line ends and sentence ends, and long ones at words
chosen by their hash, so that an edit changes the paragraphs around it only. The sketch sums counts, digests
and checks into cells; the sketches of two versions subtract, and peeling single-digest cells recovers the
digests in which they differ. Where peeling gets stuck, both sketches are built anew with four times the cells.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import CACHE_WORDS, hashed_words, mixed, owner, slices, text_of

BASE_CELLS, GROW, HASHES = 18, 4, 3
STEP = 0x9E3779B97F4A7C15
CHECK = np.uint64(0xA5A5F00D5A5A0FF1)
#: Cells that are worked on at once.
CELLS_AT_ONCE = 1 << 19


class PieceWords(dict):
    """Word to its hash; the lowest bit is set on words that end a paragraph."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        last = word == b"\x00" or word[-1] in b".!?|" or value >> 60 < 2
        value = self[word] = (value & ~1) | last
        return value


def digests(texts: list[str], table: dict) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of the texts and where each text begins; equal paragraphs of a text are numbered."""
    words, starts = hashed_words([t.encode("utf-8", "replace").replace(b"\n", b" \x00 ").split() for t in texts], table)
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    own = owner(starts)
    ends = (words & np.uint64(1)).astype(bool)
    ends[starts[1:][np.diff(starts) > 0] - 1] = True
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    step = np.full(len(words) + 1, STEP, np.uint64)
    step[0] = 1
    power = np.cumprod(step)
    back = np.full(len(words) + 1, pow(STEP, -1, 1 << 64), np.uint64)
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:-1], dtype=np.uint64)])
    value = mixed((sums[last + 1] - sums[first]) * np.cumprod(back)[first] + (last - first).astype(np.uint64))
    of = own[first]
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    at = np.arange(len(value))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return mixed(value + nth.astype(np.uint64) * np.uint64(STEP)), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """One cell in each third of the sketch for every digest."""
    third = np.uint64(cells // HASHES)
    return np.stack([(mixed(keys ^ np.uint64((i + 1) * STEP & (1 << 64) - 1)) % third + np.uint64(i) * third).astype(np.int64) for i in range(HASHES)])


def sketches(keys: np.ndarray, of: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest sums and check sums, n by cells."""
    out = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
    for row in places(keys, cells):
        at = of * cells + row
        np.add.at(out[0], at, 1)
        np.add.at(out[1], at, keys)
        np.add.at(out[2], at, mixed(keys ^ CHECK))
    return tuple(x.reshape(n, cells) for x in out)


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of digests recovered from each difference, and whether nothing is left of it."""
    n, cells = count.shape
    count, key, check = count.ravel(), key.ravel(), check.ravel()
    found = np.zeros(n, np.int64)
    while True:
        single = np.flatnonzero(np.abs(count) == 1)
        minus = count[single] < 0
        value = np.where(minus, np.uint64(0) - key[single], key[single])
        sure = np.where(minus, np.uint64(0) - check[single], check[single]) == mixed(value ^ CHECK)
        single, value, sign = single[sure], value[sure], count[single[sure]]
        if not len(single):
            break
        of = single // cells
        order = np.lexsort((value, of))
        of, value, sign = of[order], value[order], sign[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
        of, value, sign = of[new], value[new], sign[new]
        np.add.at(found, of, 1)
        unsigned = sign.astype(np.uint64)
        for row in places(value, cells):
            at = of * cells + row
            np.subtract.at(count, at, sign)
            np.subtract.at(key, at, value * unsigned)
            np.subtract.at(check, at, mixed(value ^ CHECK) * unsigned)
    left = (count != 0) | (key != 0) | (check != 0)
    return found, ~left.reshape(n, cells).any(axis=1)


def some(keys: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the given texts, and their text's place in ``rows``."""
    n = starts[rows + 1] - starts[rows]
    begin = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return keys[begin + np.arange(int(n.sum()))], np.repeat(np.arange(len(rows)), n), n


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 - differing digests / all digests of each pair of texts; 1 for two texts without words."""
    total = np.diff(a[1]) + np.diff(b[1])
    differ = np.zeros(len(total), np.int64)
    todo, cells = np.arange(len(total)), BASE_CELLS
    while len(todo):
        stuck, width = [], max(1, CELLS_AT_ONCE // cells)
        for i in range(0, len(todo), width):
            rows = todo[i : i + width]
            ka, oa, _ = some(*a, rows)
            kb, ob, _ = some(*b, rows)
            sa, sb = sketches(ka, oa, len(rows), cells), sketches(kb, ob, len(rows), cells)
            found, whole = peel(*(x - y for x, y in zip(sa, sb, strict=True)))
            differ[rows[whole]] = found[whole]
            stuck.append(rows[~whole])
        todo, cells = np.concatenate(stuck), cells * GROW
        if cells > 64 * max(BASE_CELLS, int(total.max(initial=0))):  # two digests with equal sums: count them
            for i in todo:
                differ[i] = len(np.setxor1d(a[0][a[1][i] : a[1][i + 1]], b[0][b[1][i] : b[1][i + 1]]))
            break
    return np.where(total > 0, 1 - differ / np.maximum(total, 1), 1.0)


def as_text(keys: np.ndarray, starts: np.ndarray) -> list[str]:
    """The base sketches as strings: 16-bit counts, 64-bit digest sums and 32-bit check sums of the cells, base64."""
    n = len(starts) - 1
    count, key, check = sketches(keys, owner(starts), n, BASE_CELLS)
    parts = (count.astype("<u2"), key.astype("<u8"), check.astype("<u4"))
    raw = np.concatenate([x.view(np.uint8).reshape(n, -1) for x in parts], axis=1)
    return [base64.b64encode(x.tobytes()).decode() for x in raw]


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, copied, in runs of ascending doc_id (nulls first), each followed by the first row of the next run.

    The runs' bounds are approximate quantiles of the ids; the first id of each run is all that the driver reads.
    """
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bounds = sorted(set(keyed.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
    part = F.size(F.filter(F.array(*(F.lit(x) for x in bounds)), lambda x: x < F.col("key"))) if bounds else F.lit(0)
    heads = [r for r in keyed.groupBy(part.alias("part")).agg(F.min("key").alias("key")).orderBy("part").collect()]
    if not heads:
        return docs.select("doc_id", "text", F.lit(0).alias("part"), F.lit(False).alias("copied"))
    before = {r["key"]: heads[i - 1]["part"] for i, r in enumerate(heads)}
    first = keyed.where(F.col("doc_id").isin([x for x in before if x != -(1 << 63)]) | F.col("doc_id").isNull()).where(F.col("key").isin(list(before)))
    target = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("key"))
    both = keyed.select("doc_id", "text", "key", part.alias("part"), F.lit(False).alias("copied")).union(first.select("doc_id", "text", "key", target.alias("part"), F.lit(True).alias("copied")))
    return both.repartition(n // 4, "part").sortWithinPartitions("part", "copied", "key", F.xxhash64("text")).select("doc_id", "text", "part", "copied")


def fingerprint_edits(docs: DataFrame, *, share: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The edited text has its last n_chars // share code points replaced by the first as many (or all) of the
    next document by id, after the last those of the first. Null ids come first; equal ids are ordered by a
    hash of the text; a null text is empty. One document alone is its own next.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = PieceWords(), None
        for batch in slices(batches):
            batch = pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "text", "part", "copied")], ["doc_id", "text", "part", "copied"])
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = batch.slice(batch.num_rows - 1)
            texts = [x or "" for x in batch.column("text").to_pylist()]
            copied = batch.column("copied").to_numpy(zero_copy_only=False)
            # Copies end their run; a row's next is the next row.
            use = np.flatnonzero(~copied[:-1])
            if not len(use):
                continue
            quarter = [len(texts[i]) // share for i in use]
            edited = [texts[i][: len(texts[i]) - q] + texts[i + 1][:q] for i, q in zip(use, quarter, strict=True)]
            keys, starts = digests(texts, table)
            own, next_ = (some(keys, starts, rows) for rows in (use, use + 1))
            a, b = ((k, np.concatenate([[0], np.cumsum(n)])) for k, _, n in (own, next_))
            e = digests(edited, table)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(use)), pa.array([len(texts[i]) for i in use], pa.int64()), pa.array(edited, pa.string()), pa.array(as_text(*a)), pa.array(as_text(*e)), pa.array(likeness(a, e)), pa.array(likeness(a, b))],
                ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(text_of(docs, id_col=id_col, text_col=text_col)).mapInArrow(make, schema)
