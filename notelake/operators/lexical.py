"""BM25 retrieval for a whole table of queries.

All phrases of a query have to match. Block tables say which blocks of documents hold a term and bound its
score there, so a query first meets blocks that hold all its phrases, then the postings of those blocks that
can reach its best results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.functions.text import query_phrases
from notelake.operators.fusion import SCORE_DIGITS, top_k
from notelake.operators.postings import BUCKETS, CHUNK_KEY, PLACE_BITS
from notelake.operators.sizing import pin_if_small, row_bound
from notelake.params import FIELDS, SearchParams
from notelake.sources.workdir import cut

#: Terms that are named to the scan, at most, and blocks per query that are scored to learn the score to beat.
MAX_TERM_LIST, FIRST_BLOCKS = 10_000, 8
BLOCK = ("origin", "block")
#: Sides that are dealt by block join there by phrase as well, so that scores are summed where they are made.
BY_BLOCK = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def phrases_of(queries: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Distinct phrases per query: ``keys, namespace, phrase, repeats, n_phrases``.

    ``phrase`` is the token array joined by spaces; ``repeats`` counts how often
    the query says it.
    """
    namespace = F.col("namespace") if "namespace" in queries.columns else F.lit(None).cast("string")
    said = queries.select(
        *keys,
        namespace.alias("namespace"),
        F.transform(query_phrases(F.col("text")), lambda p: F.array_join(p, " ")).alias("_all"),
    )
    return (
        said.withColumn("n_phrases", F.size(F.array_distinct("_all")))
        .select(*keys, "namespace", "n_phrases", F.explode("_all").alias("phrase"))
        .groupBy(*keys, "namespace", "n_phrases", "phrase")
        .agg(F.count("*").alias("repeats"))
    )


def distinct_questions(queries: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Phrases of the different questions, under a number ``_no`` of their own, and ``keys, _no``: who asks which.

    Questions of the same phrases in the same namespace are one, so each is answered once.
    """
    said = F.sort_array(F.collect_list(F.struct("phrase", "repeats"))).alias("_said")
    asked = phrases_of(queries, keys).groupBy(*keys, "namespace", "n_phrases").agg(said)
    question = ["namespace", "n_phrases", "_said"]
    by = asked.groupBy(*question).agg(F.collect_list(F.struct(*keys)).alias("_by"))
    held = cut(by.withColumn("_no", F.monotonically_increasing_id()))
    phrases = held.select("_no", "namespace", "n_phrases", F.explode("_said").alias("_p")).select("_no", "namespace", "n_phrases", "_p.phrase", "_p.repeats")
    return phrases, held.select("_no", F.explode("_by").alias("_q")).select("_q.*", "_no")


def phrase_terms(phrases: DataFrame) -> DataFrame:
    """Terms of each distinct phrase with their offset."""
    return (
        phrases.select("phrase")
        .distinct()
        .select("phrase", F.split("phrase", " ").alias("_terms"))
        .select(
            "phrase",
            F.size("_terms").alias("phrase_len"),
            F.posexplode("_terms").alias("offset", "term"),
        )
    )


def _weighted(weights: dict[str, float], prefix: str = "tf") -> Column:
    return sum((F.col(f"{prefix}_{f}") * F.lit(float(weights[f])) for f in FIELDS), F.lit(0.0))


def _listed(df: DataFrame, words: set[str] | None) -> DataFrame:
    """Rows of the given terms, all rows if there are too many. The scan opens the folders of their buckets and skips
    row groups by the terms. One SQL text is far quicker to build than one literal per word; tokens hold letters and
    numbers only, so nothing needs quoting."""
    if words is None or len(words) > MAX_TERM_LIST:
        return df
    if not words:
        return df.filter("false")
    if "bucket" in df.columns:
        df = df.filter(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})))
    return df.filter("term IN (" + ", ".join(f"'{w}'" for w in sorted(words)) + ")")


def match_several(postings: DataFrame, blocks: DataFrame, terms: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Chunks that hold a phrase of several tokens: ``phrase, doc_id, chunk_index, namespace, n_tokens, origin, block, wtf``.

    ``wtf`` is the field-weighted number of occurrences. Only blocks that hold every word of the phrase are read. The
    places of its words, each moved back by the word's offset, are intersected, the fewest first: what is left are
    the places where the phrase begins. Places of different fields are far apart, so no phrase crosses fields.
    """
    said = terms.filter("phrase_len > 1")
    words = said.select("phrase", "term").distinct()
    needed = words.groupBy("phrase").agg(F.count("*").alias("_words"))
    both = (
        blocks.join(words, "term").groupBy("phrase", *BLOCK).agg(F.count("*").alias("_n"))
        .join(needed, "phrase").filter("_n = _words").select("phrase", *BLOCK)
    )
    moved = F.transform("places", lambda p: p - F.col("offset"))
    held = [*CHUNK_KEY, "namespace", "n_tokens", *BLOCK]
    found = (
        postings.join(said, "term")
        .join(both, ["phrase", *BLOCK])
        .select("phrase", "phrase_len", *held, F.struct(F.size("places").alias("n"), moved.alias("at")).alias("_word"))
        .groupBy("phrase", "phrase_len", *held)
        .agg(F.sort_array(F.collect_list("_word")).alias("_words"))
        .filter(F.size("_words") == F.col("phrase_len"))
    )
    starts = F.aggregate(F.slice("_words", 2, 1 << 30), F.col("_words")[0]["at"], lambda at, w: F.array_intersect(at, w["at"]))
    field_weight = F.array(*[F.lit(float(weights[f])) for f in FIELDS])
    wtf = F.aggregate("_starts", F.lit(0.0), lambda total, s: total + F.get(field_weight, F.shiftright(s, PLACE_BITS)))
    return found.withColumn("_starts", starts).filter(F.size("_starts") > 0).select("phrase", *held, wtf.alias("wtf"))


def phrase_tree(phrases: list[str], numbers: dict[str, int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases as a tree of words: how many words there are, the steps (node * words + word, in order) and the nodes they
    lead to, and the phrase that ends at each node, or -1. Node 0 is the root."""
    steps, ends = {}, {}
    for i, phrase in enumerate(phrases):
        node = 0
        for word in phrase.split(" "):
            node = steps.setdefault(node * len(numbers) + numbers[word], len(steps) + 1)
        ends[node] = i
    keys, nodes = np.array(sorted(steps.items()), np.int64).T
    last = np.full(len(steps) + 1, -1, np.int64)
    last[list(ends)] = list(ends.values())
    return len(numbers), keys, nodes, last


def phrases_in(tree: tuple, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, phrase) of every phrase in a sequence of words at rising places."""
    width, keys, nodes, last = tree
    begin, node, length, firsts, found = np.arange(len(place)), np.zeros(len(place), np.int64), 0, [], []
    while len(begin):
        key = node * width + word[begin + length]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        on = keys[at] == key
        begin, node, length = begin[on], nodes[at[on]], length + 1
        ended = last[node] >= 0
        firsts.append(begin[ended])
        found.append(last[node[ended]])
        follow = np.minimum(begin + length, len(place) - 1)
        near = place[follow] == place[begin] + length
        begin, node = begin[near], node[near]
    return np.concatenate([np.zeros(0, np.int64), *firsts]), np.concatenate([np.zeros(0, np.int64), *found])


def scan_several(postings: DataFrame, phrases: list[str], weights: dict[str, float]) -> DataFrame:
    """The rows of ``match_several`` for phrases that are named one by one.

    Postings of their words are dealt by block and sorted by chunk, which lays the words of a chunk in order again;
    one pass over them finds all phrases, however many share a word.
    """
    words = sorted({w for p in phrases for w in p.split(" ")})
    tree = phrase_tree(phrases, {w: i for i, w in enumerate(words)})
    spark = postings.sparkSession
    named = pa.table({"term": pa.array(words), "word": pa.array(range(len(words)), pa.int32())})
    numbered = F.broadcast(spark.createDataFrame(named, "term string, word int"))
    shared = spark.sparkContext.broadcast((tree, phrases, [float(weights[f]) for f in FIELDS]))
    held = [*BLOCK, *CHUNK_KEY, "namespace", "n_tokens"]
    laid = postings.join(numbered, "term").select(*held, "word", "places").repartition(*BLOCK).sortWithinPartitions("origin", *CHUNK_KEY)

    def matches(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """Phrases in whole chunks; ``starts`` are the first rows of the chunks."""
        tree, phrases, weights = shared.value
        places = rows["places"].combine_chunks()
        size = np.diff(places.offsets.to_numpy())
        chunk = np.repeat(np.searchsorted(starts, np.arange(rows.num_rows), side="right") - 1, size)
        word = np.repeat(rows["word"].to_numpy().astype(np.int64), size)
        at = (chunk << 32) + places.flatten().to_numpy()  # chunks are far apart, so no phrase crosses them
        order = np.argsort(at, kind="stable")
        at, word = at[order], word[order]
        first, phrase = phrases_in(tree, at, word)
        weight = np.array(weights)[(at[first] & 0xFFFFFFFF) >> PLACE_BITS]
        pair, own = np.unique((at[first] >> 32) * len(phrases) + phrase, return_inverse=True)
        own_chunk, own_phrase = np.divmod(pair, len(phrases))
        of = rows.select(held).take(pa.array(starts[own_chunk])).combine_chunks()
        said = pa.array([phrases[i] for i in own_phrase.tolist()], pa.string())
        columns = [said, *(of[c].combine_chunks() for c in held), pa.array(np.bincount(own, weight, len(pair)).astype(np.float64))]
        return pa.RecordBatch.from_arrays(columns, ["phrase", *held, "wtf"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the chunk that the last batch ended in
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            new = np.zeros(rows.num_rows, bool)
            new[0] = True
            for c in ("origin", *CHUNK_KEY):
                value = rows[c].to_numpy()
                new[1:] |= value[1:] != value[:-1]
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield matches(rows.slice(0, starts[-1]), starts[:-1])
            rest = rows.slice(starts[-1])
        if rest is not None:
            yield matches(rest, np.zeros(1, np.int64))

    out = T.StructType([T.StructField("phrase", T.StringType()), *(laid.schema[c] for c in held), T.StructField("wtf", T.DoubleType())])
    return laid.mapInArrow(scan, out)


@dataclass(frozen=True)
class _Asked:
    """A table of queries prepared against an index."""

    questions: DataFrame  # keys, namespace, n_phrases, parts, number
    blocks: DataFrame  # keys, number, origin, block, bound, reads
    hits: DataFrame  # phrase, chunk key, namespace, n_tokens, origin, block, wtf
    part: Column  # score of one phrase in one chunk
    keys: tuple[str, ...]
    single: bool  # no question has several phrases


def _component(repeats: Column, idf: Column, wtf: Column, n_tokens: Column, average: float, params: SearchParams) -> Column:
    k1, b = params.bm25_k1, params.bm25_b
    return repeats * idf * (wtf * (k1 + 1)) / (wtf + k1 * (1 - b + b * n_tokens / F.lit(average)))


def _prepare(
    phrases: DataFrame,
    postings: DataFrame,
    blocks: DataFrame,
    stats: DataFrame,
    params: SearchParams,
    keys: tuple[str, ...],
    gone: DataFrame | None,
) -> _Asked:
    phrases, rows = pin_if_small(phrases)
    known = None if rows is None else set(rows["phrase"].to_pylist())
    words = None if known is None else {t for p in known for t in p.split(" ")}
    postings, blocks = _listed(postings, words), _listed(blocks, words)
    weights = params.field_weights
    counted = stats.first()
    average = (counted.total_tokens / counted.n_rows if counted.n_rows else 0.0) or 1.0

    own = [F.col("term").alias("phrase"), *BLOCK]
    bounds = blocks.select(*own, "n", _weighted(weights, "most").alias("wtf"), F.col("least_tokens").alias("n_tokens"))
    hits = postings.select(*own, *CHUNK_KEY, "namespace", "n_tokens", _weighted(weights).alias("wtf"))
    long = None if known is None else sorted(p for p in known if " " in p)
    if long is None or long:
        found = match_several(postings, blocks, phrase_terms(phrases), weights) if long is None else scan_several(postings, long, weights)
        several = cut(found)
        merged = several.groupBy("phrase", *BLOCK).agg(F.count("*").alias("n"), F.max("wtf").alias("wtf"), F.min("n_tokens").alias("n_tokens"))
        bounds, hits = bounds.unionByName(merged), hits.unionByName(several)
    said = phrases.select("phrase").distinct()
    if known is not None:
        said = F.broadcast(said)
    bounds = cut(bounds.join(said, "phrase", "left_semi"))

    # Chunks per phrase; hidden ones are counted out. Its weight is never below the floor.
    total = bounds.groupBy("phrase").agg(F.sum("n").alias("df"))
    if gone is not None:
        lost = _listed(gone, words).groupBy(F.col("term").alias("phrase")).agg(F.sum("n").alias("lost"))
        total = total.join(lost, "phrase", "left").select("phrase", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df")).filter("df > 0")
    df = F.col("df").cast("double")
    raw = F.log((F.lit(float(counted.n_rows)) - df + 0.5) / (df + 0.5))
    idf = total.withColumn("idf", F.when(raw <= 0, params.idf_floor).otherwise(raw))

    # One row per query with all its phrases, rarest first; a query with a phrase
    # that never occurs has no result and is gone here.
    asked = cut(
        phrases.withColumnRenamed("namespace", "_only")
        .join(idf, "phrase")
        .groupBy(*keys, "_only", "n_phrases")
        .agg(F.sort_array(F.collect_list(F.struct("df", "phrase", "repeats", "idf"))).alias("_parts"))
        .filter(F.size("_parts") == F.col("n_phrases"))
        .withColumn("_q", F.monotonically_increasing_id())
    )
    if known is not None:
        asked = F.broadcast(asked)
    # The rarest phrase names the blocks; the others are looked up in those.
    started = bounds.withColumnRenamed("phrase", "_rarest").join(asked, F.col("_rarest") == F.col("_parts")[0]["phrase"])
    part = _component(F.col("repeats"), F.col("idf"), F.col("wtf"), F.col("n_tokens"), average, params)
    single = rows is not None and all(n <= 1 for n in rows["n_phrases"].to_pylist())
    if single:
        only = F.col("_parts")[0]
        said = started.withColumns({"repeats": only["repeats"], "idf": only["idf"]})
        held = said.select(*keys, "_q", *BLOCK, part.alias("bound"), F.col("n").alias("reads"))
        return _Asked(asked, held, hits, part, keys, single)
    asked_blocks = started.select(*keys, "_q", "n_phrases", *BLOCK, F.explode("_parts").alias("_p")).select(
        *keys, "_q", "n_phrases", *BLOCK, "_p.phrase", "_p.repeats", "_p.idf"
    )
    held = (
        asked_blocks.join(bounds, ["phrase", *BLOCK])
        .groupBy(*keys, "_q", "n_phrases", *BLOCK)
        .agg(F.count("*").alias("_hit"), F.sum(part).alias("bound"), F.sum("n").alias("reads"))
        .filter("_hit = n_phrases")
        .drop("_hit", "n_phrases")
    )
    return _Asked(asked, held, hits, part, keys, single)


def _scored(asked: _Asked, chosen: DataFrame) -> DataFrame:
    """Scores of the chunks of the chosen (query, block) pairs that hold all phrases of the query.

    Where the pairs are too many to broadcast, they and the hits are dealt by block. A chunk lies in one block, so with
    BY_BLOCK nothing is shuffled after that.
    """
    keys = asked.keys
    wanted = chosen.select("_q", *BLOCK).join(asked.questions, "_q").select(*keys, "_only", "n_phrases", *BLOCK, F.explode("_parts").alias("_p")).select(
        *keys, "_only", "n_phrases", *BLOCK, "_p.phrase", "_p.repeats", "_p.idf"
    )
    if row_bound(wanted) is not None:
        hits, wanted = asked.hits, F.broadcast(wanted)
    else:
        hits, wanted = asked.hits.repartition(*BLOCK), wanted.repartition(*BLOCK)
    met = (
        hits.join(wanted, ["phrase", *BLOCK])
        .filter(F.col("_only").isNull() | (F.col("_only") == F.col("namespace")))
    )
    if asked.single:  # a chunk has one row of a phrase
        return met.select(*keys, *CHUNK_KEY, asked.part.alias("score"))
    return (
        met.groupBy(*BLOCK, *CHUNK_KEY, *keys, "n_phrases")
        .agg(F.count("*").alias("_hit"), F.sum(asked.part).alias("score"))
        .filter("_hit = n_phrases")
        .select(*keys, *CHUNK_KEY, "score")
    )


def bm25_scores(
    queries: DataFrame,
    postings: DataFrame,
    blocks: DataFrame,
    stats: DataFrame,
    params: SearchParams = SearchParams(),
    keys: tuple[str, ...] = ("query_id",),
    gone: DataFrame | None = None,
) -> DataFrame:
    """Score of every chunk that holds all phrases of a query.

    A query with a ``namespace`` only sees that namespace; document frequencies and the average length stay those
    of the whole corpus. ``gone`` counts the chunks per term that ``blocks`` still holds but readers do not see.
    """
    asked = _prepare(phrases_of(queries, keys), postings, blocks, stats, params, keys, gone)
    return _scored(asked, cut(asked.blocks))


def _passes(asked: _Asked, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The blocks scored first, their best results, and the other blocks that can still hold a better one.

    The blocks of the highest bounds come first. When they give k results, the k-th score is the one to beat.
    """
    keys = list(asked.keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("bound"), *BLOCK)
    held = cut(asked.blocks.withColumn("_nr", F.row_number().over(order)))
    head = held.filter(F.col("_nr") <= FIRST_BLOCKS)
    best = cut(top_k(_scored(asked, head), k, asked.keys), BY_BLOCK)
    beat = best.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("score").alias("_least")).filter(F.col("_n") >= k)
    rest = held.filter(F.col("_nr") > FIRST_BLOCKS).join(beat, keys, "left")
    close = F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - 10.0**-SCORE_DIGITS)
    return head, best, rest.filter(close)


def bm25_topk(
    queries: DataFrame,
    postings: DataFrame,
    blocks: DataFrame,
    stats: DataFrame,
    k: int | None = None,
    params: SearchParams = SearchParams(),
    keys: tuple[str, ...] = ("query_id",),
    gone: DataFrame | None = None,
) -> DataFrame:
    """Best ``k`` chunks per query by BM25: ``keys, doc_id, chunk_index, score, rank``."""
    k = k or params.candidate_k
    phrases, same = distinct_questions(queries, keys)
    asked = _prepare(phrases, postings, blocks, stats, params, ("_no",), gone)
    _, best, rest = _passes(asked, k)
    if not rest.isEmpty():
        best = cut(top_k(best.drop("rank").unionByName(_scored(asked, rest)), k, ("_no",)), BY_BLOCK)
    found = best.drop("rank").join(same, "_no").select(*keys, *CHUNK_KEY, "score")
    return top_k(found, k, keys)


def bm25_reads(
    queries: DataFrame,
    postings: DataFrame,
    blocks: DataFrame,
    stats: DataFrame,
    k: int | None = None,
    params: SearchParams = SearchParams(),
    keys: tuple[str, ...] = ("query_id",),
    gone: DataFrame | None = None,
) -> DataFrame:
    """Per query with results: blocks and postings of its phrases, how many hold all of them, and how many are scored."""
    asked = _prepare(phrases_of(queries, keys), postings, blocks, stats, params, keys, gone)
    head, best, rest = _passes(asked, k or params.candidate_k)
    found = best.select(*keys).unionByName(_scored(asked, rest).select(*keys)).distinct()
    df = F.aggregate("_parts", F.lit(0).cast("long"), lambda n, p: n + p["df"])
    seen = head.select(*keys, "_q", "reads").unionByName(rest.select(*keys, "_q", "reads"))
    seen = seen.join(asked.questions.select("_q", df.alias("df")), "_q")
    scored = seen.groupBy(*keys).agg(F.first("df").alias("postings"), F.count("*").alias("blocks_read"), F.sum("reads").alias("postings_read"))
    held = asked.blocks.groupBy(*keys).agg(F.count("*").alias("blocks_held"))
    return scored.join(held, list(keys)).join(found, list(keys)).select(*keys, "postings", "postings_read", "blocks_held", "blocks_read")
