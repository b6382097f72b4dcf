"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

Every document is cut into pieces of at most ``capacity`` tokens. Only the number of pieces of each
length (at most ``capacity`` numbers) reaches the driver, which runs best fit, longest first, over the
counts. A plan row says: the pieces of this length with these ranks go to these sequences at this
offset. Pieces get their rank within their length from counts by (length, salt), so that a very
frequent length is spread over many tasks, and take their place by a join on length and rank.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm.common import raw_texts, slices, stored, text_of

#: Entries of each of a task's two caches (150 bytes each); one that is full starts anew.
CACHE_RUNS = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Texts that need no normalising besides lower case: white space, visible ASCII and precomposed Latin letters.
PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: How a run of their characters is divided: letters, single digits, contractions, other signs.
PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next free one."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in visible]
    return {x: chr(x) for x in visible} | {x: chr(256 + i) for i, x in enumerate(hidden)}


class Tokens(dict):
    """Run of lower-case characters to its ids, as little-endian unsigned 32-bit bytes.

    The tokenizer neither merges nor composes characters across ASCII white space, which it drops, so
    a run between white space has the same ids wherever it stands. Runs of plain texts are divided here
    and go to the model part by part, each part once; runs that are not plain go through the whole
    tokenizer.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.letters, self.parts = Tokenizer.from_str(vocabulary), byte_letters(), {}
        self.tokenize = self.tokenizer.model.tokenize

    def part(self, part: str) -> bytes:
        if (value := self.parts.get(part)) is None:
            if len(self.parts) >= CACHE_RUNS:
                self.parts.clear()
            found = self.tokenize(part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode())))
            value = self.parts[part] = array("I", [x.id for x in found]).tobytes()
        return value

    def __missing__(self, run: str) -> bytes:
        if len(self) >= CACHE_RUNS:
            self.clear()
        value = self[run] = self.part(run) if run.isalpha() else b"".join(map(self.part, PARTS.findall(run)))
        return value

    def ids(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, text.lower().split()))
        runs = text.encode("utf-8", "replace").split()
        if len(runs) == 1:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([self.ids(x.decode()) for x in runs])

    def of(self, texts: list[bytes]) -> list[bytes]:
        return [self.ids(x.decode("utf-8", "replace")) for x in texts]


def token_pieces(docs: DataFrame, vocabulary_path: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document's tokens are its ids and then ``end_id``; a null or empty text has that one token.
    Repeated rows are packed once each; a null id stays null.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file: one to two MB
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens.of(raw_texts(batch)), strict=True):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    stop = min(n, start + capacity)
                    rows.append((doc, piece, start, stop - start, zlib.crc32(memoryview(ids)[4 * start : 4 * stop])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_of(docs, id_col=id_col, text_col=text_col).mapInArrow(cut, PIECES)


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset) runs that place every counted piece.

    Sequences with equal free space are handled as one group, so the work and the number of runs depend
    on the capacity, not on the number of pieces.
    """
    runs, made = [], 0
    free: dict[int, list[tuple[int, int]]] = {}  # free space to (first sequence, sequences)
    spaces: list[int] = []

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = space // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for begin, width, take in ((first, full, each), (first + full, 1, rest)):
                if width and take:
                    for slot in range(take):
                        runs.append((length, rank, width, begin, capacity - space + slot * length))
                        rank, left = rank + width, left - width
                    put(space - take * length, begin, width)
            used = full + (rest > 0)
            put(space, first + used, n - used)
    return runs


def place_pieces(pieces: DataFrame, *, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces; sequences are gapless from offset 0."""
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = stored(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    # At most capacity times salts rows.
    dealt = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = dealt.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(plan_best_fit(counts, capacity), "length long, first_rank long, pieces long, first_sequence long, offset long")
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("local", local).join(before, ["length", "salt"]).withColumn("rank", F.col("local") + F.col("before"))
    # The plan's size is bounded by the capacity, whatever the number of pieces.
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("pieces")))
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, vocabulary_path: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Best-fit packing of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    An empty table gives no rows. Repeated rows and ties on length are placed like other rows.
    """
    return place_pieces(token_pieces(docs, vocabulary_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), capacity=capacity)


def sequence_ids(docs: DataFrame, packed: DataFrame, vocabulary_path: str, *, end_id: int = 1) -> DataFrame:
    """The token ids of each sequence (sequence_id, ids array) for documents with unique ids."""
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for batch in slices(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int32).tolist() + [end_id] for x in tokens.of(raw_texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    whole = text_of(docs).mapInArrow(encode, "doc_id long, ids array<int>")
    cut = packed.join(whole, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most capacity tokens
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(held, lambda x: x["ids"])).alias("ids"))
