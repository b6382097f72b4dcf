"""Toxic spans by a linear-chain conditional random field over words.

Only documents carry labels, so word labels are found first: a small set of words and word beginnings that
hardly occur in clean documents and together explain the toxic ones (greedy set cover, so that words that
merely accompany others are not taken). The field learns from words labelled in this way, its marginals give
offending spans, and the highest marginal of a document, calibrated on documents kept from training, its score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import raw_texts, slices, text_of
from notelake.llm.crf import Emissions, pieces, posteriors, train

#: Labelled documents of either class that are learned from, at most; taken by a hash of the id. Characters of each, at most.
PER_CLASS, SAMPLE_CHARS = 1500, 20_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labelled_texts(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> list[tuple[str, int]]:
    """Distinct (text, toxic) of a bounded sample; documents labelled both ways count as toxic.

    One text of an id, the least by its hash, and SAMPLE_CHARS characters of it at most come to the driver.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    chosen = None
    for kind in (0, 1):
        part = one.where(F.col("_toxic") == kind).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    text = F.struct(F.xxhash64("text").alias("h"), F.left("text", F.lit(SAMPLE_CHARS)).alias("text"))
    rows = held.groupBy("_id", "_toxic").agg(F.min(text)["text"].alias("text")).select("text", "_toxic").distinct().collect()
    return sorted((r["text"], r["_toxic"]) for r in rows)


def beginnings(word: str) -> list[str]:
    """The word itself, and its beginnings of four letters and more."""
    return [word + "$", *(word[:i] for i in range(4, min(len(word), 9)))]


def seeds(rows: list[tuple[list[str], int]], *, least: int = 3, clean_share: float = 0.02) -> set[str]:
    """Words and beginnings that explain the toxic documents: greedy cover with at most ``clean_share`` clean hits."""
    clean, toxic = Counter(), defaultdict(set)
    for nr, (words, label) in enumerate(rows):
        found = {x for w in set(words) for x in beginnings(w)} if words else set()
        if label:
            for x in found:
                toxic[x].add(nr)
        else:
            clean.update(found)
    held = {x: d for x, d in toxic.items() if len(d) >= least and clean[x] <= clean_share * len(d)}
    out, explained = set(), set()
    while held:
        best = max(held, key=lambda x: (len(held[x]), len(x), x))
        if len(held[best]) < least:
            break
        out.add(best)
        explained |= held[best]
        held = {x: d - explained for x, d in held.items() if len(d - explained) >= least}
    return out


def proven(marks: set[str], held: list[tuple[set[str], int]], *, least_precision: float = 0.5) -> set[str]:
    """The seeds that are not contradicted by documents kept from the search: among those that hold a seed, at least
    ``least_precision`` are toxic. A seed that none of them holds stays."""
    hits = {x: [0, 0] for x in marks}
    for found, label in held:
        for x in found & marks:
            hits[x][int(label)] += 1
    return {x for x, (clean, toxic) in hits.items() if toxic >= least_precision * (clean + toxic)}


def learn_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
    """Weights, transitions and calibration (slope, offset) from labelled documents."""
    rows = labelled_texts(docs, labels, per_class=per_class)
    split = [([w for w in t.encode("utf-8", "replace").split()], y) for t, y in rows]
    fit = [x for i, x in enumerate(split) if i % 4]
    held = [x for i, x in enumerate(split) if i % 4 == 0]
    cores: dict[bytes, list[str]] = {w: [x for x in pieces(w) if x] for w in {w for words, _ in split for w in words}}
    marks = proven(seeds([([c for w in words for c in cores[w]], y) for words, y in fit]), [({x for w in words for c in cores[w] for x in beginnings(c)}, y) for words, y in held])
    bad = {w for w, c in cores.items() if any(not marks.isdisjoint(beginnings(x)) for x in c)}
    chains, tags, rng = [], [], np.random.default_rng(4)
    for words, label in fit:
        tag = np.array([label and w in bad for w in words], np.int64)
        near = np.flatnonzero(tag) // 32 if label else rng.integers(0, max(1, len(words) // 32), 6)
        for at in np.unique(near) * 32:
            if at + 32 <= len(words):
                chains.append(words[at : at + 32])
                tags.append(tag[at : at + 32])
            elif len(words):
                pad = (words[-32:] * 32)[:32]
                chains.append(pad)
                tags.append(np.resize(tag[-32:], 32))
    weights, transitions = train(chains, tags, 2, epochs=4)
    peak = _peaks([x for x, _ in held], weights, transitions)
    return weights, transitions, _calibrated(peak, np.array([y for _, y in held], float))


def _peaks(texts: list[list[bytes]], weights: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    at, _, starts = (e := Emissions(weights)).of(texts)
    return peaks(posteriors(e.rows[at].astype(float), starts, transitions)[:, 1], starts)


def peaks(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log odds of the highest marginal of each text; low for a text without words."""
    out = np.full(len(starts) - 1, 1e-6)
    full = np.diff(starts) > 0
    if full.any():
        out[full] = np.maximum.reduceat(p, starts[:-1][full])
    out = np.clip(out, 1e-6, 1 - 1e-6)
    return np.log(out / (1 - out))


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([(x * (y - p)).sum() - 0.1 * (a - 1), (y - p).sum() - 0.1 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(h, g)
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    return float(max(a, 1e-3)), float(b)


def score_toxicity(docs: DataFrame, weights: np.ndarray, transitions: np.ndarray, calibration: tuple[float, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_toxic and spans (start and end in code points, marginal) of the words tagged toxic.

    Null, empty and wordless texts score like a text whose every marginal is lowest, and have no spans. Repeated rows get equal results.
    """
    model = docs.sparkSession.sparkContext.broadcast((weights, transitions))  # 2 to the BITS rows
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(model.value[0])
        for batch in slices(batches, 2 << 20):
            raw = raw_texts(batch)
            at, word, starts = emissions.of([x.split() for x in raw])
            p = posteriors(emissions.rows[at].astype(float), starts, model.value[1])[:, 1]
            x = calibration[0] * peaks(p, starts) + calibration[1]
            hits = np.add.reduceat(np.append(p >= 0.5, 0), np.minimum(starts[:-1], len(p))) * (np.diff(starts) > 0)
            spans = [[] for _ in raw]
            for i in np.flatnonzero(hits):
                nr = word[starts[i] : starts[i + 1]] - word[starts[i]]  # the highest marginal of a word's positions
                own = np.zeros(nr[-1] + 1)
                np.maximum.at(own, nr, p[starts[i] : starts[i + 1]])
                spans[i] = [{"start": m.start(), "end": m.end(), "marginal": float(v)} for m, v in zip(WORD.finditer(raw[i].decode("utf-8", "replace")), own, strict=True) if v >= 0.5]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30)))), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)], ["doc_id", "score", "n_toxic", "spans"])

    return text_of(docs, id_col=id_col, text_col=text_col).mapInArrow(make, "doc_id long, score double, n_toxic long, spans array<struct<start: int, end: int, marginal: double>>")
