"""Learned decision lists over document statistics.

Sequential covering: a rule is a conjunction of thresholds, grown by FOIL gain on two thirds of the
labelled rows and pruned back on the rest; the rows it covers are set aside and the next rule is learned,
until no rule is precise enough. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import WordHashes, hashed_words, mixed, owner, raw_texts, slices, sums_by_text, window_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lower", "n_marks", "n_same_next", "n_lines")
#: Labelled rows that the list is learned from, at most; taken by a hash of the id.
MAX_ROWS = 12_000
#: Text bytes whose words a task counts at once; the arrays of the words take many times as much.
COUNT_BYTES = 1 << 20


def _bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SPACE, SYMBOL, LOWER, MARK = _bytes(b" \t\n\x0b\x0c\r"), _bytes(b"#*$%&|<>"), _bytes(bytes(range(97, 123))), _bytes(b"!?")
TRAIL = _bytes(bytes(range(0x80, 0xC0)))
REPEAT_WINDOW = 8


def count_text(raw: list[bytes], table: dict) -> dict[str, np.ndarray]:
    """The counts of every text."""
    texts = [x.split() for x in raw]
    words, starts = hashed_words(texts, table)
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])
    of_bytes = lambda mask: sums_by_text(mask.astype(np.int32), ends).astype(np.int64)
    out = {"n_words": np.diff(starts), "word_chars": of_bytes(~(SPACE | TRAIL)[data]), "n_symbols": of_bytes(SYMBOL[data]), "n_lower": of_bytes(LOWER[data]), "n_marks": of_bytes(MARK[data])}
    own = owner(starts)
    same = np.zeros(len(words), np.int64)
    same[1:] = (words[1:] == words[:-1]) & (own[1:] == own[:-1])
    out["n_same_next"] = sums_by_text(same, starts)
    cover = np.zeros(len(words) + 1, np.int64)
    hashes = window_hashes(words, REPEAT_WINDOW, 0x9E3779B97F4A7C15)
    at = np.flatnonzero(np.arange(len(hashes)) + REPEAT_WINDOW <= starts[1:][own[: len(hashes)]])
    keys = mixed(hashes[at] + own[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    sorted_ = keys[order]
    twice = np.zeros(len(keys), bool)
    equal = sorted_[1:] == sorted_[:-1]
    twice[1:] |= equal
    twice[:-1] |= equal
    found = at[order[twice]]
    np.add.at(cover, found, 1)
    np.add.at(cover, found + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = sums_by_text((np.cumsum(cover)[:-1] > 0).astype(np.int64), starts)
    lines = [[y for y in x.split(b"\n") if y and not y.isspace()] for x in raw]
    out["n_lines"] = np.array([len(x) for x in lines], np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    return out


def with_counts(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of ``docs`` (all, if not given) and a struct ``counts``; a null text has no words."""
    keep = docs.columns if keep is None else keep
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), *([] if text_col in keep else [F.col(text_col).alias("text")]))
    at = f"c{keep.index(text_col)}" if text_col in keep else "text"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in slices((b.rename_columns(["text" if c == at else c for c in b.schema.names]) for b in batches), COUNT_BYTES):
            found = count_text(raw_texts(batch), table)
            counts = pa.StructArray.from_arrays([pa.array(found[c].astype(np.int64)) for c in COUNTS], list(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("text" if f"c{i}" == at else f"c{i}") for i in range(len(keep))] + [counts], [f"c{i}" for i in range(len(keep))] + ["counts"])

    kinds = dict(inner.dtypes)
    schema = ", ".join([f"c{i} {kinds[f'c{i}']}" for i in range(len(keep))] + [f"counts struct<{', '.join(f'{c}: long' for c in COUNTS)}>"])
    made = inner.mapInArrow(make, schema)
    return made.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), F.col("counts").alias("_counts"))


def features(counts: str = "_counts") -> dict[str, Column]:
    """Rates of the counts; all are 0 for a text without words."""
    c = lambda name: F.col(f"{counts}.{name}")
    rate = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    return {
        "words": c("n_words").cast("double"), "word_length": rate("word_chars", "n_words"), "symbol_rate": rate("n_symbols", "n_words"),
        "mark_rate": rate("n_marks", "n_words"), "lower_rate": rate("n_lower", "word_chars"), "same_rate": rate("n_same_next", "n_words"),
        "repeat_rate": rate("n_repeat_words", "n_words"), "line_copy_rate": rate("n_dup_lines", "n_lines"),
    }


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, *, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample of labelled documents, taken by a hash of the id."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = given.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", F.col("_label").alias("label"), "text")
    named = features()
    made = with_counts(held, keep=["doc_id", "label"]).select("doc_id", "label", *(v.alias(k) for k, v in named.items()))
    # One text of an id, whatever ids repeat: at most max_rows rows of numbers.
    rows = made.groupBy("doc_id", "label").agg(F.min(F.struct(*named)).alias("x")).select("doc_id", "label", "x.*").orderBy("doc_id").collect()
    return np.array([r[2:] for r in rows], float).reshape(-1, len(named)), np.array([r["label"] for r in rows], int)


Rule = list[tuple[str, str, float]]


def learn_list(x: np.ndarray, y: np.ndarray, names: list[str], *, target: int = 0, precision: float = 0.97, max_rules: int = 24, max_terms: int = 4, bins: int = 40) -> list[Rule]:
    """Ordered rules that cover rows labelled ``target``; empty without such rows."""
    grow = np.arange(len(y)) % 3 != 2
    goal, left, rules = y == target, np.ones(len(y), bool), []
    cuts = [np.unique(np.concatenate([np.quantile(x[:, j], np.linspace(0, 1, bins)), np.quantile(x[goal, j], np.linspace(0, 1, bins))])) if goal.any() else [] for j in range(x.shape[1])]

    def covers(rule: list[tuple[int, bool, float]], rows: np.ndarray) -> np.ndarray:
        for j, above, cut in rule:
            rows = rows & ((x[:, j] >= cut) if above else (x[:, j] < cut))
        return rows

    while len(rules) < max_rules:
        rows, rule = left & grow, []
        while len(rule) < max_terms and (rows & ~goal).any():
            p, n = (rows & goal).sum(), (rows & ~goal).sum()
            best = (0.0, None)
            for j, values in enumerate(cuts):
                at, neg = np.sort(x[rows & goal, j]), np.sort(x[rows & ~goal, j])
                below_p, below_n = np.searchsorted(at, values), np.searchsorted(neg, values)
                for above, p1, n1 in ((True, p - below_p, n - below_n), (False, below_p, below_n)):
                    gain = np.where(p1 > 0, p1 * (np.log2(np.maximum(p1, 1) / np.maximum(p1 + n1, 1)) - np.log2(max(p, 1) / (p + n))), 0)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), (j, above, float(values[gain.argmax()])))
            if best[1] is None:
                break
            rule.append(best[1])
            rows = covers(rule, left & grow)

        def worth(some: list) -> float:
            held = covers(some, left & ~grow)
            return ((held & goal).sum() - (held & ~goal).sum()) / max(1, held.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        held = covers(rule, left)
        hits = (held & goal).sum()
        unseen = covers(rule, left & ~grow)
        if not rule or hits < 5 or hits < precision * held.sum() or not unseen.any() or (unseen & goal).sum() < precision * unseen.sum():
            break
        rules.append([(names[j], ">=" if above else "<", cut) for j, above, cut in rule])
        left &= ~held
    return rules


def list_expression(rules: list[Rule], values: dict[str, Column]) -> Column:
    """CASE WHEN rule THEN its number ...; null if no rule holds."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        test = F.lit(True)
        for name, sign, cut in rule:
            test = test & ((values[name] >= cut) if sign == ">=" else (values[name] < cut))
        out = F.when(test, F.lit(i)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, *, keep: list[str] | None = None, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept columns, ``_counts``, ``_base_failed`` and ``_rule``: the number of the learned rule that rejects, or null.

    Base: under 20 words, or over 30 % of the words in repeated windows. Null and empty texts fail it.
    Without labelled rows no rule is learned. Kept columns may not have the names of the added ones.
    """
    x, y = labelled_rows(docs, labels, "quality", max_rows=max_rows, id_col=id_col, text_col=text_col)
    rules = learn_list(x, y, list(features()))
    made = with_counts(docs, keep=keep, text_col=text_col)
    n, repeats = F.col("_counts.n_words"), F.col("_counts.n_repeat_words")
    return made.withColumn("_base_failed", (n < 20) | (100 * repeats > 30 * n)).withColumn("_rule", list_expression(rules, features()))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that neither the base nor a learned rule rejects, unchanged, whatever their columns are called."""
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"given{i}") for i, c in enumerate(names)))
    of = lambda c: f"given{names.index(c)}"
    kept = judged(plain, labels, id_col=of("doc_id"), text_col=of("text")).where(~F.col("_base_failed") & F.col("_rule").isNull())
    return kept.select(*(F.col(f"given{i}").alias(c) for i, c in enumerate(names)))
