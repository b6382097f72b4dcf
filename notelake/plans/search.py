"""Search for a table of queries: lexical, vector, hybrid and deep."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException, PythonException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators.cache import ResultCache, read_through
from notelake.operators.fusion import linear_fusion, rrf_fusion, hybrid_rrf, strong_signal, top_k
from notelake.operators.lexical import bm25_topk
from notelake.operators.lookup import attach_contexts, enrich_results
from notelake.operators.rerank import blend, cache_key, rerank_inputs
from notelake.operators.sizing import MAX_BROADCAST_ROWS, row_bound
from notelake.operators.vectors import knn_topk
from notelake.params import MODES, SearchParams
from notelake.sources.store import NoteIndex
from notelake.sources.workdir import cut

# queries (query_id, text, ...) to variants (query_id, variant_no from 1, text, embedding?)
Expander = Callable[[DataFrame], DataFrame]
# candidates (query_id, query_text, doc_id, chunk_index, rank, text) to
# scores (query_id, doc_id, chunk_index, score)
Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class SearchOutput:
    """Result rows, and one report row per query."""

    results: DataFrame
    report: DataFrame


def search(
    queries: DataFrame,
    index: NoteIndex,
    mode: str = "hybrid",
    params: SearchParams = SearchParams(),
    expander: Expander | None = None,
    scorer: Scorer | None = None,
    skip_expansion: bool = False,
    skip_reranking: bool = False,
    contexts: DataFrame | None = None,
    cache: ResultCache | None = None,
    strict: bool = False,
) -> SearchOutput:
    """Answer every query of a table.

    ``queries``: ``query_id, text`` and optionally ``embedding`` and ``namespace``.
    Engines that are missing degrade the mode, with a warning in the report; a
    query without an embedding is answered by words alone. The ranking is made
    once, for the results and the report. ``cache`` keeps what the expander and
    the scorer of a deep search return. With ``strict`` a model function that
    fails fails the search, for callers that read the results without the report.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "deep":
        ranked, report = _deep(
            queries, index, params, expander, scorer, skip_expansion, skip_reranking, cache, strict
        )
    else:
        ranked, report = _classic(queries, index, mode, params)
    asked = row_bound(queries.select("query_id"), MAX_BROADCAST_ROWS)
    bound = None if asked is None else asked * params.top_k
    results = enrich_results(ranked, index.chunks, index.docs, bound, params.snippet_chars)
    if contexts is not None:
        results = attach_contexts(results, contexts)
    return SearchOutput(results, report)


def _no_score() -> Column:
    return F.lit(None).cast("double")


def _ranked(df: DataFrame, rrf: Column, lex: Column, vec: Column) -> DataFrame:
    return df.select(
        "query_id", "doc_id", "chunk_index", "rank", "score",
        lex.cast("double").alias("lex_norm"), vec.cast("double").alias("vec_norm"),
        rrf.cast("double").alias("rrf_score"), _no_score().alias("rerank_score"),
    )


def _linear(lex: DataFrame | None, vec: DataFrame | None, params: SearchParams, mode: str) -> DataFrame:
    """Linear fusion; with one engine left the fusion weight of that engine stays."""
    wl = 0.0 if mode == "vec_only" else params.lexical_weight
    wv = 0.0 if mode == "bm25_only" else params.vector_weight
    fused = top_k(linear_fusion(lex, vec, wl, wv), params.top_k)
    return _ranked(fused, _no_score(), F.col("lex_norm"), F.col("vec_norm"))


def _words(queries: DataFrame, index: NoteIndex, params: SearchParams, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return bm25_topk(queries, index.postings, index.blocks, index.stats, params.candidate_k, params, keys, index.gone)


def _classic(
    queries: DataFrame, index: NoteIndex, mode: str, params: SearchParams
) -> tuple[DataFrame, DataFrame]:
    has_lex = index.postings is not None
    has_vec = index.vectors is not None and "embedding" in queries.columns
    warnings: list[str] = []
    if mode != "vec_only" and not has_lex:
        warnings.append("BM25 search failed: no lexical index")
        mode = "vec_only" if mode == "hybrid" else mode
    if mode != "bm25_only" and not has_vec:
        warnings.append("Vector search failed: no vectors")
        mode = "bm25_only" if mode == "hybrid" and has_lex else mode

    def words(q: DataFrame) -> DataFrame:
        return _words(q, index, params)

    def near(q: DataFrame) -> DataFrame:
        return knn_topk(q, index.vectors, params.candidate_k, params.metric)

    row_mode = F.lit(mode)
    row_warnings = F.array(*[F.lit(w) for w in warnings]).cast("array<string>")
    if (mode == "bm25_only" and not has_lex) or (mode == "vec_only" and not has_vec):
        empty = queries.select("query_id").filter("false").selectExpr(
            "query_id", "cast(null as bigint) doc_id", "cast(null as int) chunk_index",
            "cast(null as int) rank", "cast(null as double) score",
        )
        ranked = _ranked(empty, _no_score(), _no_score(), _no_score())
    elif mode == "bm25_only":
        ranked = _linear(words(queries), None, params, mode)
    elif mode == "vec_only":
        ranked = _linear(None, near(queries), params, mode)
    else:
        bare = F.col("embedding").isNull()
        full = queries.filter(~bare)
        lex, vec = words(full), near(full)
        if params.fusion == "rrf":
            fused = hybrid_rrf(lex, vec, params.top_k, params.rrf_k)
            ranked = _ranked(fused, F.col("score"), F.lit(0.0), F.lit(0.0))
        else:
            ranked = _linear(lex, vec, params, mode)
        poor = queries.filter(bare)
        if not poor.isEmpty():
            ranked = ranked.unionByName(_linear(words(poor), None, params, "bm25_only"))
        row_mode = F.when(bare, "bm25_only").otherwise("hybrid")
        row_warnings = F.when(
            bare, F.array(F.lit("Vector search failed: the query has no embedding"))
        ).otherwise(F.array().cast("array<string>"))
    ranked = cut(ranked)
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("total_candidates"))
    report = (
        queries.select("query_id", row_mode.alias("mode"), row_warnings.alias("warnings"))
        .join(counts, "query_id", "left")
        .withColumn("total_candidates", F.coalesce("total_candidates", F.lit(0)))
    )
    return ranked, report


def query_variants(
    queries: DataFrame, expanded: DataFrame | None, params: SearchParams = SearchParams()
) -> DataFrame:
    """The original texts (``variant_no`` 0) and at most ``max_variants`` of each query.

    Adds the weight each ranking of the variant has in the fusion.
    """
    extra = [c for c in ("embedding", "namespace") if c in queries.columns]
    original = queries.select(
        "query_id", F.lit(0).alias("variant_no"), "text", *extra,
        F.lit(params.original_weight).alias("weight"),
    )
    if expanded is None:
        return original
    order = Window.partitionBy("query_id").orderBy("variant_no")
    held = (
        expanded.withColumn("variant_no", F.row_number().over(order))
        .filter(F.col("variant_no") <= params.max_variants)
        .withColumn("weight", F.lit(params.variant_weight))
    )
    if "namespace" in extra and "namespace" not in held.columns:
        held = held.join(queries.select("query_id", "namespace"), "query_id")
    return original.unionByName(held.select(*[c for c in original.columns if c in held.columns]), True)


def expansion_gate(
    queries: DataFrame,
    signals: DataFrame,
    available: bool,
    user_skip: bool = False,
) -> DataFrame:
    """Per query whether expansion is skipped and the first reason why:
    the user's wish, a strong signal, or no expander."""
    reason = (
        F.when(F.lit(user_skip), "user_requested")
        .when(F.col("strong_signal"), "strong_signal_detected")
        .when(F.lit(not available), "llm_unavailable")
    )
    flags = queries.select("query_id").join(
        signals.select("query_id", F.col("detected").alias("strong_signal")), "query_id", "left"
    )
    return (
        flags.withColumn("strong_signal", F.coalesce("strong_signal", F.lit(False)))
        .withColumn("skip_reason", reason)
        .withColumn("skipped", F.col("skip_reason").isNotNull())
    )


def multi_query_lists(
    originals: DataFrame, variants: DataFrame | None, index: NoteIndex, params: SearchParams, first: DataFrame
) -> DataFrame:
    """Rankings of every variant by both engines, with their weights.

    ``first`` holds the lexical ranking of the original texts, which is not run again.
    """
    k = params.candidate_k
    cols = ["query_id", "doc_id", "chunk_index", "rank", "weight"]
    lists = first.withColumn("weight", F.lit(params.original_weight)).select(*cols)
    if variants is not None and index.postings is not None:
        keys = ("query_id", "variant_no")
        words = _words(variants, index, params, keys)
        lists = lists.unionByName(words.withColumn("weight", F.lit(params.variant_weight)).select(*cols))
    asked = originals if variants is None else originals.unionByName(variants, True)
    if index.vectors is not None and "embedding" in asked.columns:
        lists = lists.unionByName(_near_variants(asked, index, k, params).select(*cols))
    return lists


def _near_variants(asked: DataFrame, index: NoteIndex, k: int, params: SearchParams) -> DataFrame:
    """Nearest neighbours of every variant. A variant is one query to the engine, under a number of its own that is
    written down once."""
    named = cut(asked.withColumn("_list", F.monotonically_increasing_id()))
    near = knn_topk(named.drop("query_id").withColumnRenamed("_list", "query_id"), index.vectors, k, params.metric)
    owner = named.select("_list", "query_id", "weight")
    return near.withColumnRenamed("query_id", "_list").join(owner, "_list")


#: What Python workers say when the machine is at fault, not the function they run.
LACKS = ("MemoryError", "No space left on device")


def _failure(error: Exception, strict: bool) -> str:
    """First line of what a model function said. Other failures are raised again: a job that lacked disk or memory or
    lost its executors made no result, which must not look like the result of a search without the model."""
    job = isinstance(error, (PySparkException, Py4JError)) and not isinstance(error, PythonException)
    if strict or job or isinstance(error, MemoryError) or any(x in str(error) for x in LACKS):
        raise error
    return (str(error).strip().splitlines() or [type(error).__name__])[0][:200]


def _expanded(queries: DataFrame, expander: Expander, cache: ResultCache | None) -> DataFrame:
    """Variants of the open queries, each distinct text asked once when there is a cache."""
    if cache is None:
        return expander(queries)
    keyed = cut(queries.select("query_id", cache_key("expand", cache.model, F.col("text")).alias("cache_key")))
    item = "variant_no int, text string" + (", embedding array<double>" if "embedding" in queries.columns else "")

    def compute(ids: DataFrame) -> DataFrame:
        made = expander(queries.join(ids, "query_id", "left_semi"))
        made = made.withColumn("variant_no", F.col("variant_no").cast("int"))
        if "embedding" not in queries.columns:
            return made
        given = F.col("embedding").cast("array<double>") if "embedding" in made.columns else F.lit(None).cast("array<double>")
        return made.withColumn("embedding", given)

    out = read_through(keyed, compute, item, cache)
    if "embedding" in queries.columns:
        out = out.withColumn("embedding", F.col("embedding").cast(queries.schema["embedding"].dataType))
    return out


def _rescored(inputs: DataFrame, scorer: Scorer, cache: ResultCache | None) -> DataFrame:
    """Scores of the candidates; the same question about the same candidates is asked once when there is a cache."""
    cols = ["query_id", "doc_id", "chunk_index", "score"]
    if cache is None:
        return scorer(inputs).select(*cols)
    inputs = cut(inputs)
    ids = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "doc_id", "chunk_index"))), ",")
    asked = inputs.groupBy("query_id", "query_text").agg(ids.alias("ids"))
    keyed = cut(asked.select("query_id", cache_key("rerank", cache.model, F.concat("query_text", F.lit("::"), "ids")).alias("cache_key")))
    item = "doc_id long, chunk_index int, score double"
    return read_through(keyed, lambda some: scorer(inputs.join(some, "query_id", "left_semi")), item, cache).select(*cols)


def _deep(
    queries: DataFrame,
    index: NoteIndex,
    params: SearchParams,
    expander: Expander | None,
    scorer: Scorer | None,
    skip_expansion: bool,
    skip_reranking: bool,
    cache: ResultCache | None,
    strict: bool,
) -> tuple[DataFrame, DataFrame]:
    """Without one engine the other answers, and a model function that fails is left out; the report says so."""
    said: list[str] = []  # warnings that hold for every query
    # Lexical ranking of the original texts; it decides on expansion and is fused later.
    if index.postings is None:
        said.append("Initial BM25 search failed: no lexical index")
        first = queries.select("query_id").filter("false").selectExpr(
            "query_id", "cast(null as bigint) doc_id", "cast(null as int) chunk_index", "cast(null as double) score", "cast(null as int) rank"
        )
    else:
        first = cut(_words(queries, index, params))
    signals = strong_signal(first, params.strong_min_score, params.strong_min_gap)
    gate = cut(expansion_gate(queries, signals, expander is not None, skip_expansion))

    originals = query_variants(queries, None, params)
    variants = None
    if expander is not None and not skip_expansion:
        open_queries = queries.join(gate.filter("NOT skipped"), "query_id", "left_semi")
        try:
            both = query_variants(open_queries, _expanded(open_queries, expander, cache), params)
            variants = cut(both.filter("variant_no > 0"))
        except Exception as error:  # noqa: BLE001 - an expander may fail in any way
            said.append(f"Query expansion failed: {_failure(error, strict)}")

    lists = multi_query_lists(originals, variants, index, params, first)
    fused = cut(rrf_fusion(lists, params.rrf_k))
    # The first rerank_limit rows are scored; the rest of the ranking follows behind them.
    ranking = cut(top_k(fused, max(params.rerank_limit, params.top_k)).drop("best_rank"))
    best = ranking.filter(F.col("rank") < params.rerank_limit)

    scored = None
    ranked = _final(best.withColumn("rrf_score", F.col("score")), _no_score())
    if scorer is not None and not skip_reranking:
        inputs = rerank_inputs(best, index.chunks, params.rerank_chars).join(
            queries.select("query_id", F.col("text").alias("query_text")), "query_id"
        )
        try:
            scores = cut(_rescored(inputs, scorer, cache))
        except Exception as error:  # noqa: BLE001 - a scorer may fail in any way
            said.append(f"Re-ranking failed: {_failure(error, strict)}")
        else:
            scored = scores.select("query_id").distinct()
            mixed = blend(best.join(scored, "query_id", "left_semi"), scores, params)
            plain = best.join(scored, "query_id", "left_anti")
            ranked = _final(mixed, F.col("rerank_score")).unionByName(
                _final(plain.withColumn("rrf_score", F.col("score")), _no_score())
            )
    if params.top_k > params.rerank_limit:
        rest = ranking.filter(F.col("rank") >= params.rerank_limit)
        ranked = ranked.unionByName(_final(rest.withColumn("rrf_score", F.col("score")), _no_score()))
    ranked = cut(ranked.filter(F.col("rank") < params.top_k))
    report = _deep_report(gate, fused, variants, scored, scorer is not None, skip_reranking)
    return ranked, report.join(_deep_warnings(originals, variants, index, said), "query_id")


def _deep_warnings(originals: DataFrame, variants: DataFrame | None, index: NoteIndex, said: list[str]) -> DataFrame:
    """``query_id, warnings``: those of all queries, then per asked text the engines that could not answer it."""
    asked = originals if variants is None else originals.unionByName(variants, True)
    name = F.concat(F.lit(' failed for query "'), F.left("text", F.lit(50)), F.lit('": '))
    no_words = F.lit(index.postings is None)
    has_vectors = index.vectors is not None
    bare = F.col("embedding").isNull() if "embedding" in asked.columns else F.lit(True)
    why = F.when(F.lit(not has_vectors), "no vectors").otherwise("the query has no embedding")
    texts = F.filter(
        F.array(
            F.when(no_words, F.concat(F.lit("BM25 search"), name, F.lit("no lexical index"))),
            F.when(F.lit(not has_vectors) | bare, F.concat(F.lit("Vector search"), name, why)),
        ),
        lambda x: x.isNotNull(),
    )
    each = asked.select("query_id", F.struct("variant_no", texts.alias("texts")).alias("_one"))
    common = F.array(*[F.lit(x) for x in said]).cast("array<string>")
    per = F.flatten(F.sort_array(F.collect_list("_one"))["texts"])
    return each.groupBy("query_id").agg(F.concat(common, per).alias("warnings"))


def _final(df: DataFrame, rerank: Column) -> DataFrame:
    return df.select(
        "query_id", "doc_id", "chunk_index", "rank", "score",
        F.lit(0.0).alias("lex_norm"), F.lit(0.0).alias("vec_norm"),
        F.col("rrf_score").cast("double").alias("rrf_score"),
        rerank.cast("double").alias("rerank_score"),
    )


def _deep_report(
    gate: DataFrame,
    fused: DataFrame,
    variants: DataFrame | None,
    scored: DataFrame | None,
    has_scorer: bool,
    skip_reranking: bool,
) -> DataFrame:
    """Per query: candidates before the cut, variants, signals and skipped stages."""
    out = gate.join(
        fused.groupBy("query_id").agg(F.count("*").alias("total_candidates")), "query_id", "left"
    )
    texts = F.array().cast("array<string>")
    if variants is not None:
        said = variants.groupBy("query_id").agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("variant_no", "text"))), lambda x: x["text"]
            ).alias("expanded_queries")
        )
        out = out.join(said, "query_id", "left")
        texts = F.coalesce("expanded_queries", texts)
    applied = F.lit(False)
    if scored is not None:
        out = out.join(scored.withColumn("_scored", F.lit(True)), "query_id", "left")
        applied = F.coalesce("_scored", F.lit(False))
    rerank_reason = (
        F.lit("user_requested")
        if skip_reranking
        else F.lit(None if has_scorer else "llm_unavailable").cast("string")
    )

    def stage(name: str, skipped: Column, reason: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), skipped.alias("skipped"), reason.cast("string").alias("skip_reason")
        )

    none, no = F.lit(None).cast("string"), F.lit(False)
    return out.select(
        "query_id",
        F.lit("deep").alias("mode"),
        F.coalesce("total_candidates", F.lit(0)).alias("total_candidates"),
        texts.alias("expanded_queries"),
        "strong_signal",
        applied.alias("rerank_applied"),
        F.array(
            stage("initial_bm25", no, none),
            stage("strong_signal_check", no, none),
            stage("query_expansion", F.col("skipped"), F.col("skip_reason")),
            stage("multi_query_search", no, none),
            stage("rrf_fusion", no, none),
            stage("llm_reranking", rerank_reason.isNotNull(), rerank_reason),
            stage("position_aware_blending", ~applied, none),
            stage("enrichment", no, none),
        ).alias("stages"),
    )
