"""Shared folder, text batches and word hashes used by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.sources.workdir import SHUFFLES_REMOVED, settings, work_dir

#: Text bytes that a task works on at once, and entries of a word cache and of a cache of word hashes, which are
#: quickly made again (a cache that is full starts anew).
SLICE_BYTES, CACHE_WORDS, HASH_WORDS = 4 << 20, 300_000, 50_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a result that several steps read to the shared folder, and reads it back."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    with settings(spark, SHUFFLES_REMOVED):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes what ``stored`` wrote, when no later step reads it."""
    spark = table.sparkSession
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches whose ``text`` holds at most ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def hashed_words(texts: list[list[bytes]], table: dict) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts as one array of hashes, and where each text begins (one more entry: the end)."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
    return np.fromiter(map(table.__getitem__, chain.from_iterable(texts)), np.uint64, int(starts[-1])), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of words[i : i + k] for every i; ``base`` is odd and picks the hash function."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    step = np.full(len(words), base, np.uint64)
    step[0] = 1
    back = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(step), dtype=np.uint64)])
    return mixed((sums[k:] - sums[:-k]) * np.cumprod(back))


def owner(starts: np.ndarray) -> np.ndarray:
    """Index of the text each word belongs to."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def sums_by_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; texts may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[starts[1:]] - total[starts[:-1]]
