"""Mixing to target weights with soft domain membership.

A logistic classifier learned from labelled rows gives every document a posterior over the domains, from the mean
score of those of its words that two or more documents of the sample hold. Document rates r then minimise the squared
distance between the expected domain tokens, sum of r * tokens * posterior, and their targets, by projected gradient:
steps along the posterior add up and are
projected onto the bound. One grouped pass over the documents sums their tokens by rounded posterior; each step
is one aggregation of that table, and only the totals of the domains reach the driver. The gradient is scaled by
the inverse of the cross moments of the rows that are not at the bound, and halved where it overshoots, so few
steps are needed. Rates are rounded to copies by a hash of the document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import raw_texts, slices, stored, sums_by_text, text_of
from notelake.llm.language import labelled_texts

#: Labelled documents per domain that the classifier is trained on, at most.
PER_DOMAIN = 200
STEPS = 40
#: Posteriors are rounded to this fraction for the rate, which bounds the table that the steps read.
GRID = 100
#: Word scores are whole multiples of 1 / SCALE, so that sums over a text are exact in any order.
SCALE = 1 << 16
#: ASCII letters in lower case; all other ASCII characters end a word.
LETTERS = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
#: Above every CRC-32, the last key of a model.
NO_WORD = 1 << 32


def word_keys(text: bytes) -> np.ndarray:
    """CRC-32 of every run of letters."""
    words = text.translate(LETTERS).split()
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def learn_domains(labelled: DataFrame, domain: str, *, per_domain: int = PER_DOMAIN, epochs: int = 100) -> tuple[list[str], tuple[np.ndarray, np.ndarray]]:
    """Domain names and the model from labelled rows (doc_id, text and the domain column).

    The model: sorted word keys, and for each its scores for the domains and a last column of ones (the word counts).
    """
    rows = labelled_texts(labelled.select("doc_id", "text", F.col(domain).cast("string").alias("lang")), per_language=per_domain)
    domains = sorted({d for _, d in rows})
    n = max(1, len(domains))
    found = [np.unique(word_keys(t.encode("utf-8", "replace")), return_counts=True) for t, _ in rows]
    every = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in found)])
    keys, times = np.unique(every, return_counts=True)
    keys = np.append(keys[times > 1], NO_WORD)
    doc = np.repeat(np.arange(len(rows)), [len(k) for k, _ in found])
    count = np.concatenate([np.zeros(0), *(c for _, c in found)])
    at = np.searchsorted(keys, every)
    known = keys[at] == every
    at, doc, count = at[known], doc[known], count[known]
    value = count / np.maximum(np.bincount(doc, count, len(rows)), 1)[doc]
    tag = np.eye(n)[[domains.index(d) for _, d in rows]]
    scores, squares = np.zeros((len(keys), n)), np.full((len(keys), n), 1e-12)
    for _ in range(epochs if len(at) else 0):
        logits = np.stack([np.bincount(doc, value * scores[at, i], len(rows)) for i in range(n)], axis=1)
        miss = softmax(logits) - tag
        slope = np.stack([np.bincount(at, value * miss[doc, i], len(keys)) for i in range(n)], axis=1) / len(rows)
        squares += slope**2
        scores -= slope / np.sqrt(squares)
    whole = np.append(np.round(scores * SCALE), np.ones((len(keys), 1)), axis=1).astype(np.int64)
    whole[-1] = 0
    return domains, (keys, whole)


def memberships(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content, tokens (words) and posterior; even over the domains for a text without a learned word."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the words of the bounded sample

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, scores = sent.value
        for batch in slices(batches):
            texts = raw_texts(batch)
            words = [word_keys(x) for x in texts]
            every = np.concatenate(words)
            at = np.searchsorted(keys, every)
            at[keys[at] != every] = len(keys) - 1
            total = sums_by_text(scores[at], np.concatenate([[0], np.cumsum([len(x) for x in words], dtype=np.int64)]))
            share = softmax(total[:, :-1] / (np.maximum(total[:, -1:], 1) * SCALE))
            columns = [batch.column("doc_id"), batch.column("content"), pa.array([len(x.split()) for x in texts], pa.int64()), pa.array(share.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "tokens", "posterior"])

    plain = text_of(docs, id_col=id_col, text_col=text_col)
    return plain.select("doc_id", F.xxhash64("text").alias("content"), "text").mapInArrow(make, "doc_id long, content long, tokens long, posterior array<double>")


def cells(held: DataFrame, n: int) -> DataFrame:
    """Rows of ``held`` (tokens, posterior) grouped by the rounded posterior: cell and mass, the tokens of each domain.

    Rates depend on the cell alone, so sums over this table are the exact sums over all documents.
    """
    tokens = [F.sum(F.col("tokens") * F.col("posterior")[i]).alias(f"t{i}") for i in range(n)]
    made = held.withColumn("cell", cell_of(F.col("posterior"))).groupBy("cell").agg(*tokens)
    return made.select("cell", F.array(*(f"t{i}" for i in range(n))).alias("mass"))


def cell_of(posterior: Column) -> Column:
    return F.transform(posterior, lambda x: F.round(x * GRID) / GRID)


def rate_of(cell: Column, slope: np.ndarray, least: float) -> Column:
    """1 plus the summed steps, projected onto the bound."""
    steps = F.zip_with(cell, F.array(*(F.lit(float(x)) for x in slope)), lambda a, b: a * b)
    return F.greatest(F.lit(float(least)), F.aggregate(steps, F.lit(1.0), lambda a, b: a + b))


def fit_rates(held: DataFrame, share: np.ndarray, *, least: float = 0.0, keep_total: bool = True, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Slopes for ``rate_of`` from rows (tokens, posterior) and shares that sum to 1; and the miss against the present total.

    With ``keep_total`` the domain tokens aim at their share of the present total, otherwise at their share of
    whatever total the rates give, which leaves it free to grow.
    """
    n = len(share)
    table = stored(cells(held, n), "cells")

    def measured(slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each domain, and how they change with the slopes: cross moments of the cells that are not at the bound."""
        rate = rate_of(F.col("cell"), slope, least)
        rows = table.select(rate.alias("r"), (rate > least).alias("free"), "cell", "mass")
        sums = [F.sum(F.col("r") * F.col("mass")[i]) for i in range(n)]
        sums += [F.sum(F.when(F.col("free"), F.col("mass")[i] * F.col("cell")[j]).otherwise(0.0)) for i in range(n) for j in range(n)]
        got = np.array([x or 0.0 for x in rows.agg(*sums).first()])
        return got[:n], got[n:].reshape(n, n)

    def missed(got: np.ndarray) -> np.ndarray:
        return share * (now.sum() if keep_total else got.sum()) - got

    now = np.array([x or 0.0 for x in table.agg(*(F.sum(F.col("mass")[i]) for i in range(n))).first()])
    if now.sum() <= 0:
        return np.zeros(n), 0.0
    # Start: what rows of one domain alone would need.
    wanted = np.where(now > 0, share / np.maximum(now, 1e-9), 0.0)
    slope = wanted * (now.sum() if keep_total else 1 / wanted[wanted > 0].min(initial=1.0)) - 1
    size = 1.0
    got, moments = measured(slope)
    off = float(np.linalg.norm(missed(got)) / now.sum())
    for _ in range(steps):
        if off <= 1e-6 or size < 1e-3:
            break
        pull = moments if keep_total else moments - np.outer(share, moments.sum(axis=0))
        tried = slope + size * (np.linalg.pinv(pull, rcond=1e-9) @ missed(got))
        new_got, new_moments = measured(tried)
        new_off = float(np.linalg.norm(missed(new_got)) / now.sum())
        if new_off < off:
            slope, got, moments, off, size = tried, new_got, new_moments, new_off, min(1.0, 2 * size)
        else:
            size /= 2
    return slope, off


def mixed_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, domain: str = "lang", thin: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content, tokens, posterior, rate, copies for every row.

    With ``thin`` the expected tokens keep the present total. Without it no rate is under 1 and the total grows
    until the weights hold. Weights that the steps cannot meet (no tokens of a domain, or
    a share near 0 of a domain that may not be thinned) are left at the least miss found. A domain without a
    target has weight 0; weights are scaled to sum to 1. Without labelled rows or without words all rates are 1.
    Equal rows get equal results.
    """
    domains, model = learn_domains(labelled, domain)
    held = stored(memberships(docs, model, id_col=id_col, text_col=text_col), "memberships")
    share = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    rate = F.lit(1.0)
    if domains and share.sum() > 0:
        least = 0.0 if thin else 1.0
        rate = rate_of(cell_of(F.col("posterior")), fit_rates(held, share / share.sum(), least=least, keep_total=thin)[0], least)
    chance = F.pmod(F.xxhash64("doc_id", "content", F.lit(9)), F.lit(1 << 20)) / float(1 << 20)
    return held.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, domain: str = "lang", thin: bool = True) -> DataFrame:
    """The rows of ``docs``, each as often as its copies, with the same columns."""
    rates = mixed_rates(docs, labelled, targets, domain=domain, thin=thin)
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    copies = rates.select(key("doc_id").alias("_id"), F.col("content").alias("_content"), "copies").dropDuplicates(["_id", "_content"])
    rows = docs.select(F.struct("*").alias("_row"), key("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_content"))
    made = rows.join(copies, ["_id", "_content"]).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return made.select(*(F.col(f"_row.`{c}`") for c in docs.columns))
