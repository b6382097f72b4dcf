"""Exact nearest neighbours for a table of query vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators.fusion import SCORE_DIGITS, top_k

# Query matrices up to this size travel to the tasks; above it both sides are cut
# into blocks of at most this size and every pair of blocks meets in one group.
QUERY_BYTES = 64 << 20
BLOCK_BYTES = 64 << 20
# A large table is cut into this many blocks a side at most, so that a vector is copied that often at most,
# as long as the blocks stay within BLOCK_BYTES.
SIDE = 10
_OUT = "query_id long, doc_id long, chunk_index int, score double"
_NAMES = ["query_id", "doc_id", "chunk_index", "score"]
# Queries and vectors of one matrix product, and pairs that are measured at a time.
_ROWS, _COLUMNS, _PAIRS = 1024, 4096, 1 << 16


class _Block:
    """Queries of one scope, and the best k chunks of each so far: free places have the score -1."""

    def __init__(self, q: np.ndarray, mat: np.ndarray, k: int):
        self.q, self.mat, self.sq = q, mat, (mat**2).sum(1)
        self.reach = np.full(len(q), np.inf)
        self.score = np.full((len(q), k), -1.0)
        self.doc = np.full((len(q), k), np.iinfo(np.int64).max)
        self.chunk = self.doc.copy()


class _Best:
    """Best k chunks per query over the blocks seen so far. Queries of a scope meet the vectors of that scope only."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, scopes: np.ndarray, k: int, metric: str):
        self.ids, self.k, self.metric = ids, k, metric
        mat = self._prepare(np.asarray(mat, dtype=np.float64))
        codes, names = pd.factorize(scopes)
        order = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[order], np.arange(-1, len(names) + 1))
        self.blocks: dict[object, list[_Block]] = {}
        for name, begin, end in zip([None, *names], ends, ends[1:], strict=False):
            parts = (order[at : min(at + _ROWS, end)] for at in range(begin, end, _ROWS))
            self.blocks[name] = [_Block(q, mat[q], k) for q in parts]

    def _prepare(self, mat: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return mat
        norm = np.linalg.norm(mat, axis=1, keepdims=True)
        return mat / np.where(norm == 0, 1.0, norm)

    def _distance(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        square = np.empty(len(q))
        for at in range(0, len(q), _PAIRS):
            diff = q[at : at + _PAIRS] - x[at : at + _PAIRS]
            square[at : at + _PAIRS] = np.einsum("ij,ij->i", diff, diff)
        return square / 2.0 if self.metric == "cosine" else np.sqrt(square)

    def add(self, doc: np.ndarray, chunk: np.ndarray, x: np.ndarray, scopes: np.ndarray) -> None:
        codes, names = pd.factorize(scopes)
        order = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[order], np.arange(len(names) + 1))
        met = [(None, np.arange(len(x)))] + [(name, order[a:b]) for name, a, b in zip(names, ends, ends[1:], strict=False)]
        for name, rows in met:
            for at in range(0, len(rows) if self.blocks.get(name) else 0, _COLUMNS):
                some = rows[at : at + _COLUMNS]
                part = self._prepare(np.asarray(x[some], dtype=np.float64))
                sq = (part**2).sum(1)
                for block in self.blocks[name]:
                    self._block(block, doc[some], chunk[some], part, sq)

    def _block(self, block: _Block, doc, chunk, x, x_sq) -> None:
        """A matrix product finds who can be among the best k; those pairs are
        then measured exactly. The margin covers rounding of both."""
        top = max(block.sq.max(), x_sq.max())
        kind = np.float32 if 1e-20 < top < 1e30 else np.float64  # squares of other sizes do not fit single precision
        noise = 4 * (x.shape[1] + 8) * np.finfo(kind).eps * (block.sq + x_sq.max())
        # Squared distances less the query's own square, in one product.
        left = np.concatenate([-2.0 * block.mat, np.ones((len(block.q), 1))], axis=1).astype(kind)
        right = np.concatenate([x, x_sq[:, None]], axis=1).astype(kind)
        square = left @ right.T
        reach = block.reach.copy()
        fresh = np.flatnonzero(np.isinf(reach))
        if len(fresh) and square.shape[1] > self.k:
            near_sq = np.partition(square[fresh], self.k - 1, axis=1)[:, self.k - 1] + block.sq[fresh] + noise[fresh]
            near_sq = np.maximum(near_sq, 0.0)
            reach[fresh] = near_sq / 2.0 if self.metric == "cosine" else np.sqrt(near_sq)
        limit = reach + 1e-8 * (1.0 + np.where(np.isinf(reach), 0.0, reach)) ** 2
        limit = (2.0 * limit if self.metric == "cosine" else limit**2) + noise - block.sq
        limit = np.nextafter(limit.astype(kind), kind(np.inf))
        near, col = np.divmod(np.flatnonzero(square <= limit[:, None]), square.shape[1])
        if kind is np.float64:
            finite = np.isfinite(square[near, col])
            near, col = near[finite], col[finite]
        score = np.empty(len(near))
        for at in range(0, len(near), _PAIRS):
            part = slice(at, at + _PAIRS)
            score[part] = 1.0 / (1.0 + self._distance(block.mat[near[part]], x[col[part]]))
        # Of equal scores the smaller key counts: what comes behind the k-th stays out.
        rank, last = score.round(SCORE_DIGITS), block.score[:, -1].round(SCORE_DIGITS)[near]
        docs, chunks = doc[col].astype(np.int64), chunk[col].astype(np.int64)
        before = (docs < block.doc[near, -1]) | (docs == block.doc[near, -1]) & (chunks < block.chunk[near, -1])
        better = (rank > last) | (rank == last) & before
        if better.any():
            self._merge(block, near[better], docs[better], chunks[better], score[better])

    def _merge(self, block: _Block, near, doc, chunk, score) -> None:
        touched = np.unique(near)
        held = np.repeat(touched, self.k)
        q = np.concatenate([held, near])
        doc = np.concatenate([block.doc[touched].reshape(-1), doc])
        chunk = np.concatenate([block.chunk[touched].reshape(-1), chunk])
        score = np.concatenate([block.score[touched].reshape(-1), score])
        order = np.lexsort((chunk, doc, -score.round(SCORE_DIGITS), q))
        first = np.searchsorted(q[order], touched)
        best = order[first[:, None] + np.arange(self.k)]
        block.doc[touched], block.chunk[touched], block.score[touched] = doc[best], chunk[best], score[best]
        worst = block.score[touched, -1]
        block.reach[touched] = np.where(worst < 0, np.inf, 1.0 / np.where(worst > 0, worst, 1e-300) - 1.0)

    def table(self) -> pa.Table:
        parts = []
        for block in (b for blocks in self.blocks.values() for b in blocks):
            near, place = np.nonzero(block.score >= 0)
            columns = (self.ids[block.q[near]].astype(np.int64), block.doc[near, place], block.chunk[near, place].astype(np.int32), block.score[near, place])
            parts.append(pa.table([pa.array(c) for c in columns], names=_NAMES))
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.float64())], names=_NAMES)
        return pa.concat_tables([empty, *parts]).combine_chunks()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` numbers; a row of another length is an error."""
    other = column.filter(pc.not_equal(pc.list_value_length(column), dim))
    if len(other):
        raise ValueError(f"a vector has dimension {len(other[0])}, expected is {dim}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _sides(queries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    scope = F.col("namespace") if "namespace" in queries.columns else F.lit(None).cast("string")
    place = F.col("namespace") if "namespace" in vectors.columns else F.lit("root")
    # Fresh names on the query side: both tables may come from one DataFrame.
    q = queries.filter("embedding IS NOT NULL").select(
        F.col("query_id").alias("query_id"), F.col("embedding").alias("q_vec"), scope.alias("q_scope")
    )
    v = vectors.filter("embedding IS NOT NULL").select(
        "doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "embedding", place.alias("scope")
    )
    return q, v


def knn_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    metric: str = "l2",
    query_bytes: int = QUERY_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Nearest ``k`` chunks per query, ``score = 1 / (1 + distance)``.

    ``queries``: ``query_id, embedding`` and an optional ``namespace`` (only that
    namespace is searched); ``vectors``: ``doc_id, chunk_index, embedding`` and an
    optional ``namespace``. ``metric``: ``l2`` or ``cosine``.

    A query table counted to be small goes to every task of the vector scan, which
    keeps a running best k per query: the vectors are read once and not shuffled.
    A larger one is met block by block. Both forms are exact. Vectors of different
    lengths are an error.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    q, v = _sides(queries, vectors)
    first = q.select(F.size("q_vec").alias("dim")).first()
    row_bytes = 8 * (first.dim if first else 1)
    limit = max(1, query_bytes // row_bytes)
    held = q.limit(limit + 1).count()
    near = _knn_scan(q, v, k, metric, first.dim if first else 1) if held <= limit else _knn_blocks(q, v, k, metric, row_bytes // 8, block_bytes)
    return top_k(near, k)


def _knn_scan(q: DataFrame, v: DataFrame, k: int, metric: str, dim: int) -> DataFrame:
    rows = q.toArrow()
    held = q.sparkSession.sparkContext.broadcast(
        (
            rows["query_id"].to_numpy(),
            _matrix(rows["q_vec"].combine_chunks(), dim) if rows.num_rows else np.empty((0, 1)),
            np.array(rows["q_scope"].to_pylist(), dtype=object),
        )
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mat, scopes = held.value
        best = _Best(ids, mat, scopes, k, metric)
        for batch in batches:
            if batch.num_rows and len(ids):
                best.add(
                    batch["doc_id"].to_numpy(),
                    batch["chunk_index"].to_numpy(),
                    _matrix(batch["embedding"], dim),
                    np.array(batch["scope"].to_pylist(), dtype=object),
                )
        yield from best.table().to_batches()

    return v.mapInArrow(scan, _OUT)


def block_count(rows: int, row_bytes: int, block_bytes: int) -> int:
    """Blocks of a side: of ``block_bytes`` while there are at most SIDE of them, then larger ones, up to BLOCK_BYTES."""
    few = max(1, math.ceil(rows / max(1, block_bytes // row_bytes)))
    return min(few, max(SIDE, math.ceil(rows / max(1, BLOCK_BYTES // row_bytes))))


def _knn_blocks(q: DataFrame, v: DataFrame, k: int, metric: str, dim: int, block_bytes: int) -> DataFrame:
    q_blocks, v_blocks = (block_count(x.count(), 8 * dim, block_bytes) for x in (q, v))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = q.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks).cast("long"))).withColumn("_v", every(v_blocks))
    right = v.withColumn("_v", F.pmod(F.xxhash64("doc_id", "chunk_index"), F.lit(v_blocks).cast("long"))).withColumn("_q", every(q_blocks))

    def meet(qs: pa.Table, vs: pa.Table) -> pa.Table:
        queries, scopes = _matrix(qs["q_vec"].combine_chunks(), dim), np.array(qs["q_scope"].to_pylist(), dtype=object)
        best = _Best(qs["query_id"].to_numpy(), queries, scopes, k, metric)
        if qs.num_rows and vs.num_rows:
            places = np.array(vs["scope"].to_pylist(), dtype=object)
            best.add(vs["doc_id"].to_numpy(), vs["chunk_index"].to_numpy(), _matrix(vs["embedding"].combine_chunks(), dim), places)
        return best.table()

    return left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInArrow(meet, _OUT)


def check_dimension(vectors: DataFrame, dim: int) -> None:
    """Raise when any stored vector does not have ``dim`` numbers."""
    bad = vectors.filter(F.size("embedding") != dim).select(F.size("embedding").alias("n")).first()
    if bad is not None:
        raise ValueError(f"stored vectors have dimension {bad.n}, configured is {dim}")
