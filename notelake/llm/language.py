"""Language of words and documents in code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm.common import raw_texts, slices, sums_by_text, text_of
from notelake.llm.crf import Emissions, posteriors, train

#: Labelled documents per language that the field is trained on, at most; taken by a hash of the id. Characters of
#: each that are learned from, and languages that are learned (those with most documents), at most.
PER_LANGUAGE, SAMPLE_CHARS, MAX_LANGUAGES = 250, 20_000, 500


def labelled_texts(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """(text, lang) of a bounded sample of the documents with text and language, the same at every run.

    At most MAX_LANGUAGES * per_language texts of SAMPLE_CHARS characters come to the driver, whatever ids repeat.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("h", F.xxhash64("doc_id", "text"))
    # A first rank within salts bounds what meets in one task, however many documents a language has.
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("h"), F.lit(64))).orderBy("h")
    few = known.select("lang", "h").withColumn("nr", F.row_number().over(salted)).where(F.col("nr") <= per_language)
    few = few.withColumn("nr", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nr") <= per_language)
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).select("lang")
    chosen = few.join(F.broadcast(most), "lang").select("lang", "h").distinct()
    rows = known.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", F.left("text", F.lit(SAMPLE_CHARS)).alias("text")).dropDuplicates(["lang", "h"]).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))]


def switched(rows: list[tuple[str, str]], languages: list[str], *, seed: int = 2) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Tagged chains in which runs of 3 to 30 words of different documents follow each other."""
    rng = np.random.default_rng(seed)
    runs = []
    for text, lang in rows:
        words, at = text.encode("utf-8", "replace").split(), 0
        while at < len(words):
            n = int(rng.integers(3, 31))
            runs.append((words[at : at + n], languages.index(lang)))
            at += n
    order = rng.permutation(len(runs))
    return [runs[i][0] for i in order], [np.full(len(runs[i][0]), runs[i][1]) for i in order]


def learn_languages(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights and transitions learned from ``docs`` (doc_id, text, lang)."""
    rows = labelled_texts(docs, per_language=per_language)
    languages = sorted({lang for _, lang in rows})
    words, tags = switched(rows, languages)
    return languages, *train(words, tags, max(1, len(languages)))


def detect(docs: DataFrame, languages: list[str], weights: np.ndarray, transitions: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", word_tags: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, shares and, if asked for, word_tags (language of each word).

    shares are the mean marginals of the words with letters; lang_pred is the largest, the first of equal ones.
    ``und`` with score 0 if the text is null or empty, has no letter, or if no language was learned. Repeated
    rows get equal results.
    """
    model = docs.sparkSession.sparkContext.broadcast((weights, transitions))  # 2 to the BITS rows

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(model.value[0])
        for batch in slices(batches, 2 << 20):
            at, word, starts = emissions.of([x.split() for x in raw_texts(batch)])
            p = posteriors(emissions.rows[at].astype(float), starts, model.value[1])
            p[at == 0] = 0
            total = sums_by_text(p, starts)
            mass = total.sum(axis=1)
            share = total / np.maximum(mass, 1e-9)[:, None]
            best = share.argmax(axis=1)
            known = (mass > 1e-9) & bool(languages)
            lang = [languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            columns = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(known, share[np.arange(len(best)), best], 0.0)), pa.array(share.tolist(), pa.list_(pa.float64()))]
            if word_tags:
                first = np.flatnonzero(np.diff(word, prepend=-1))  # a long word is tagged as a whole, by the sum of its positions
                whole = np.add.reduceat(p, first) if len(first) else p
                tag = [languages[b] if any_ and languages else "und" for any_, b in zip(whole.sum(axis=1) > 0, whole.argmax(axis=1), strict=True)]
                begin = np.searchsorted(first, starts)
                columns.append(pa.array([tag[a:b] for a, b in zip(begin, begin[1:], strict=False)], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "shares", "word_tags"][: len(columns)])

    schema = "doc_id long, lang_pred string, score double, shares array<double>" + ", word_tags array<string>" * word_tags
    return text_of(docs, id_col=id_col, text_col=text_col).mapInArrow(make, schema)
