"""Periodic runs of words by difference-cover extensions.

A run of period q and at least four periods agrees with itself, q words on, over 3 q words or more, so that
stretch holds a multiple of 3 q: the harmonic grid asks one extension to either side at every such multiple.
An extension compares the few words up to the next place where both positions are in a difference cover; from
there it is a range minimum over the sorted suffixes of the covered positions alone. Only texts in which some
pair gets that far are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import raw_texts, slices, text_of

#: Residues that a pair of positions reaches together within STEP words, whatever their distance.
STEP, COVER = 16, (0, 1, 2, 5, 8)
#: Grid points compared at once.
POINTS = 1 << 20
UNKNOWN = np.iinfo(np.int32).max
LEAST_LENGTH, LEAST_PERIODS = 6, 4


def cover_shifts() -> np.ndarray:
    """[i mod STEP, (j - i) mod STEP]: the least shift that brings i and j into the cover."""
    inside = np.isin(np.arange(STEP), COVER)
    reach = [[next(s for s in range(STEP) if inside[(i + s) % STEP] and inside[(i + gap + s) % STEP]) for gap in range(STEP)] for i in range(STEP)]
    return np.array(reach, np.int64)


class RangeMinimum:
    """Least value of values[lo : hi + 1] from tables of minima over powers of two."""

    def __init__(self, values: np.ndarray, longest: int):
        self.tables = [values]
        while 2 << len(self.tables) - 1 <= longest:
            last, half = self.tables[-1], 1 << len(self.tables) - 1
            self.tables.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last)

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.tables[k][lo[at]], self.tables[k][hi[at] - (1 << k) + 1])
        return out


class Extensions:
    """Common extensions of pairs of positions of the same text.

    ``words`` are the words of all texts, those of different texts different, each text followed by a word that
    is found nowhere else; ``owner`` is the text of a position, that word included.
    """

    shifts = cover_shifts()

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        self.words, self.owner = words, owner

    def lengths(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal; i < j."""
        out = np.zeros(len(i), np.int64)
        shift = self.shifts[i % STEP, (j - i) % STEP]
        open_ = np.arange(len(i))
        far = []
        for t in range(STEP):
            done = shift[open_] == t
            far.append(open_[done])
            open_ = open_[~done]
            same = self.words[i[open_] + t] == self.words[j[open_] + t]
            out[open_[~same]] = t
            open_ = open_[same]
        far = np.concatenate(far)
        if len(far):
            place, least = self.sampled(np.unique(self.owner[i[far]]))
            a, b = place[i[far] + shift[far]], place[j[far] + shift[far]]
            out[far] = shift[far] + least(np.minimum(a, b) + 1, np.maximum(a, b))
        return out

    def sampled(self, texts: np.ndarray) -> tuple[np.ndarray, RangeMinimum]:
        """Place of each covered position of these texts in the order of their suffixes, and their common beginnings."""
        wanted = np.zeros(int(self.owner.max()) + 2, bool)
        wanted[texts] = True
        order = np.flatnonzero(wanted[self.owner])
        order = order[np.isin(order % STEP, COVER)]
        longest = int(np.bincount(self.owner[order]).max())
        n = len(order)
        head, common, place = np.zeros(n, np.int64), np.full(n, UNKNOWN, np.int32), np.zeros(len(self.words), np.int64)
        tied, known = np.arange(n), 0
        while len(tied):
            if known < STEP:  # word by word
                key, least = self.words[order[tied] + known], None
            else:  # by the rank of what follows, twice as far each time
                place[order] = head
                key, least = place[order[tied] + known], RangeMinimum(common, longest)
            by = np.lexsort((key, head[tied]))
            order[tied], key, group = order[tied][by], key[by], head[tied]
            parted = (key[1:] != key[:-1]) & (group[1:] == group[:-1])
            at = np.flatnonzero(parted) + 1
            common[tied[at]] = known if least is None else known + least(key[at - 1] + 1, key[at])
            new = np.concatenate([[True], parted | (group[1:] != group[:-1])])
            head[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
            alone = new & np.concatenate([new[1:], [True]])
            tied = tied[~alone]
            known = known + 1 if known < STEP else 2 * known
        common[:1] = 0
        place[order] = np.arange(n)
        return place, RangeMinimum(np.where(common == UNKNOWN, 0, common), longest)


def grid(starts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and period of the grid points whose word comes again one period on."""
    tried = np.where(sizes >= LEAST_LENGTH, sizes // LEAST_PERIODS, 0)
    text = np.repeat(np.arange(len(sizes)), tried)
    period = np.arange(len(text)) - np.repeat(np.cumsum(tried) - tried, tried) + 1
    stride = (LEAST_PERIODS - 1) * period
    points = (sizes[text] - period + stride - 1) // stride
    ends, found, begin = np.cumsum(points), [], 0
    while begin < len(text):  # a period has at most a third of its text's words as points
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + POINTS, side="right")))
        n = points[begin:end]
        row = np.repeat(np.arange(begin, end), n)
        at = starts[text[row]] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * stride[row]
        same = words[at] == words[at + period[row]]
        found.append((text[row[same]], at[same], period[row[same]]))
        begin = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def runs(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of every run, by text, start and period."""
    table: dict[bytes, int] = {}
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    words, owner = np.full(int(sizes.sum()) + len(texts) + 1, -1, np.int64), np.full(int(sizes.sum()) + len(texts) + 1, len(texts), np.int64)
    for k, (text, at) in enumerate(zip(texts, starts.tolist(), strict=True)):
        words[at : at + len(text)] = np.fromiter((table.setdefault(w, len(table)) for w in text), np.int64, len(text)) + (k << 32)
        owner[at : at + len(text)] = k
    last = len(words) - 1
    sides = []
    for w, o, ends in ((words.copy(), owner.copy(), starts + sizes), (words[::-1].copy(), owner[::-1].copy(), last - starts + 1)):
        w[ends], o[ends] = (np.arange(len(texts)) << 32) + (1 << 31), np.arange(len(texts))
        sides.append(Extensions(w, o))
    text, at, period = grid(starts, sizes, sides[0].words)
    ahead = sides[0].lengths(at, at + period)
    behind = sides[1].lengths(last - (at + period - 1), last - (at - 1))
    start, length = at - behind - starts[text], ahead + behind + period
    keep = length >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * period)
    text, start, length, period = (x[keep] for x in (text, start, length, period))
    by = np.lexsort((period, length, start, text))
    text, start, length, period = (x[by] for x in (text, start, length, period))
    first = np.ones(len(text), bool)  # a multiple of the smallest period finds the same stretch again
    first[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = (x[first] for x in (text, start, length, period))
    by = np.lexsort((length, period, start, text))
    return tuple(x[by] for x in (text, start, length, period))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats after its first period."""
    if not found:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period in words, by start, then period), collapsed (text).

    One row per row of ``docs``, repeated rows and ids included. A run is a maximal stretch of at least
    LEAST_LENGTH words and LEAST_PERIODS smallest periods; words are split at ASCII white space. ``collapsed``
    keeps the first period of each run and all words outside runs, joined by one space. Null and empty texts
    and texts without words have no runs and an empty text. A text is one row and is read whole by one task;
    tables grow linearly with its words. Other columns are not read.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x.split() for x in raw_texts(batch)]
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, *one in zip(*(x.tolist() for x in runs(texts)), strict=True):
                found[k].append(tuple(one))
            kept = [collapsed(w, r) for w, r in zip(texts, found, strict=True)]
            listed = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(listed, pa.list_(run)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return text_of(docs, id_col=id_col, text_col=text_col).mapInArrow(find, "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def stretched(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text; every tenth id (by crc32 of its decimal form) repeats a beginning of its words to the end.

    Of n words, word i >= a becomes word a + (i - a) mod p, with a and p drawn from the id. Null ids and texts
    without words stay as they are.
    """
    text = F.col("text")
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    split = text_of(docs, id_col=id_col, text_col=text_col).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    g = F.floor(F.col("h") / 10)
    a, times = F.pmod(g, F.greatest(F.size(words), F.lit(1))).cast("int"), (3 + F.pmod(g, F.lit(8))).cast("int")
    n = F.size(words)
    p = (1 + F.floor((n - a) / times)).cast("int")
    made = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a))
    hit = (F.pmod(F.col("h"), F.lit(10)) == 0) & (n > 0)
    return split.select("doc_id", F.when(hit, F.array_join(made, " ")).otherwise(text).alias("text"))
