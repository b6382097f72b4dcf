"""Queries over the search modes, re-ranking and result shaping."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import tokens
from notelake.operators.cache import ResultCache
from notelake.operators.fusion import rrf_fusion, strong_signal, top_k
from notelake.operators.lookup import detail
from notelake.operators.rerank import (
    blend,
    cache_key,
    cache_merge,
    cache_misses,
    parse_indexed_scores,
    parse_scores,
    rerank_cache_text,
    rerank_inputs,
    response_variants,
    score_with,
)
from notelake.params import SearchParams
from notelake.plans.search import expansion_gate, search
from suite.blocks import DOCVEC, TOKENS, bm25, knn, rrf, tok
from suite.inputs import DOC_PATH_SQL, SENTENCES_SQL, index, new_dir, sentences, table
from suite.registry import query
from suite.retrieval import BOTH, LINEAR, LISTS, P, both_engines, ranked, words

_NOW = 1_700_000_000_000

_SHAPE = f"""
SELECT query_id, rank, doc_id, {DOC_PATH_SQL} AS doc_path, source AS title, lang AS heading_path, lang AS namespace,
       round(score, 6) AS score, round(lex_norm, 6) AS lex_norm, round(vec_norm, 6) AS vec_norm,
       CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS snippet,
       'src/' || source || '.ts' AS ref_code_paths
FROM ranked JOIN documents USING (doc_id)"""


def _cut(source: str, score: str, lex: str = "0.0::DOUBLE", vec: str = "0.0::DOUBLE", k: int = 10) -> str:
    return f"""
ranked AS (
  SELECT * FROM (
    SELECT query_id, doc_id, {score} AS score, {lex} AS lex_norm, {vec} AS vec_norm,
           row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, doc_id) - 1 AS rank
    FROM {source})
  WHERE rank < {k}
)"""


def shaped(results: DataFrame) -> DataFrame:
    return results.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "doc_path", "title",
        "heading_path", "namespace", F.round("score", 6).alias("score"),
        F.round("lex_norm", 6).alias("lex_norm"), F.round("vec_norm", 6).alias("vec_norm"),
        "snippet", F.array_join("ref_code_paths", ",").alias("ref_code_paths"),
    )


@query("search_hybrid", f"WITH {BOTH}, {LISTS}, {rrf('lists')}, {_cut('fused', 'score')} {_SHAPE}")
def search_hybrid(spark, sf):
    """Both engines, reciprocal rank fusion, enriched rows."""
    return shaped(search(sentences(spark, sf), index(spark, sf)).results)


_LIN = "(0.7::DOUBLE * lex_norm + 0.3::DOUBLE * vec_norm)"


@query(
    "search_linear",
    f"WITH {BOTH}, {LINEAR}, {_cut('norm', _LIN, 'lex_norm', 'vec_norm')} {_SHAPE}",
)
def search_linear(spark, sf):
    return shaped(search(sentences(spark, sf), index(spark, sf), params=replace(P, fusion="linear")).results)


_LEX_ONLY = """
one AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS lex_norm FROM lex)"""


@query(
    "search_bm25_only",
    f"""WITH {TOKENS}, {SENTENCES_SQL}, {bm25('sentences', 50)}, {_LEX_ONLY},
{_cut('one', '(0.7::DOUBLE * lex_norm)', 'lex_norm')} {_SHAPE}""",
)
def search_bm25_only(spark, sf):
    """One engine alone keeps its fusion weight."""
    return shaped(search(sentences(spark, sf), index(spark, sf), "bm25_only").results)


@query(
    "search_vec_only",
    f"""WITH {BOTH}, one AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS vec_norm FROM vec),
{_cut('one', '(0.3::DOUBLE * vec_norm)', vec='vec_norm')} {_SHAPE}""",
)
def search_vec_only(spark, sf):
    return shaped(search(sentences(spark, sf), index(spark, sf), "vec_only").results)


@query(
    "search_degraded",
    f"""WITH {TOKENS}, {SENTENCES_SQL}, {bm25('sentences', 50)}, {_LEX_ONLY},
{_cut('one', '(0.7::DOUBLE * lex_norm)', 'lex_norm')},
n AS (SELECT query_id, count(*) AS c FROM ranked GROUP BY 1)
SELECT query_id, 'bm25_only' AS mode, coalesce(c, 0) AS total_candidates,
       'Vector search failed: no vectors' AS warnings
FROM sentences LEFT JOIN n USING (query_id)""",
)
def search_degraded(spark, sf):
    """Report of a hybrid search over an index without vectors."""
    held = replace(index(spark, sf), vectors=None)
    report = search(sentences(spark, sf), held).report
    return report.select(
        "query_id", "mode", "total_candidates", F.array_join("warnings", "|").alias("warnings")
    )


# ---- deep search: first and last word of a sentence are its two variants ----


def variants(spark, sf):
    vec = table(spark, sf, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("_vec"))

    def expand(open_queries: DataFrame) -> DataFrame:
        word = F.split(F.trim("text"), " +")
        said = open_queries.select(
            "query_id",
            "item_id",
            F.posexplode(F.array(word[0], F.element_at(word, -1), F.lit("never used"))).alias("_p", "text"),
        )
        return said.join(vec, F.col("vec_id") == F.col("item_id") + F.col("_p") + 1).select(
            "query_id", (F.col("_p") + 1).alias("variant_no"), "text", F.col("_vec").alias("embedding")
        )

    return expand


def overlap_scores(inputs: DataFrame) -> DataFrame:
    """Share of the query's distinct tokens found in the candidate text."""
    asked = F.array_distinct(tokens(F.col("query_text")))
    found = F.array_intersect(asked, tokens(F.col("text")))
    return inputs.select(
        "query_id", "doc_id", "chunk_index", (F.size(found) / F.size(asked)).alias("score")
    )


_VARIANTS = f"""
first50 AS (SELECT * FROM lex),
pair AS (SELECT query_id, max(CASE WHEN rank = 0 THEN score END) AS one, coalesce(max(CASE WHEN rank = 1 THEN score END), 0) AS two
         FROM lex GROUP BY 1),
strong AS (SELECT query_id FROM pair WHERE round(1 - two / one, 9) >= 0.15),
open AS (SELECT * FROM sq WHERE query_id NOT IN (SELECT query_id FROM strong)),
word AS (SELECT query_id, item_id, string_split_regex(trim(text), ' +') AS w FROM open),
said2 AS (SELECT query_id, item_id, 1 AS variant_no, w[1] AS text FROM word
          UNION ALL SELECT query_id, item_id, 2, w[-1] FROM word),
variants AS (SELECT query_id * 10 + variant_no AS list_id, query_id, variant_no, s.text, embedding::DOUBLE[] AS qv
             FROM said2 s JOIN embeddings ON vec_id = item_id + variant_no),
{bm25('variants', 50, keys='list_id', out='vlex', prefix='v')},
{knn('variants', 50, keys='list_id', out='vvec')},
lists AS (
  SELECT query_id, doc_id, rank, 2.0::DOUBLE AS weight FROM lex
  UNION ALL SELECT query_id, doc_id, rank, 2.0 FROM vec
  UNION ALL SELECT list_id // 10, doc_id, rank, 1.0 FROM vlex
  UNION ALL SELECT list_id // 10, doc_id, rank, 1.0 FROM vvec
)"""

_RERANK = f"""
best AS (SELECT f.query_id, f.doc_id, f.score AS rrf, f.rank AS pos, s.text AS qt, substring(d.text, 1, 500) AS t
         FROM fused f JOIN sentences s USING (query_id) JOIN documents d USING (doc_id) WHERE f.rank < 20),
scored2 AS (SELECT *, len(list_intersect(list_distinct({tok('qt')}), {tok('t')}))::DOUBLE
                      / len(list_distinct({tok('qt')})) AS rel FROM best),
mixed AS (SELECT query_id, doc_id, pos, rrf, rel,
                 (CASE WHEN pos < 3 THEN 0.75::DOUBLE WHEN pos < 10 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) AS w,
                 rrf / max(rrf) OVER (PARTITION BY query_id) AS norm FROM scored2),
blended AS (SELECT query_id, doc_id, pos, rrf, rel, w * norm + (1 - w) * rel AS score FROM mixed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos, doc_id) - 1 AS rank FROM blended)"""


@query(
    "search_deep",
    f"""WITH {BOTH}, {_VARIANTS}, {rrf('lists')}, {_RERANK}
SELECT query_id, rank, doc_id, round(score, 6) AS score, round(rrf, 6) AS rrf_score, round(rel, 6) AS rerank_score
FROM ranked WHERE rank < 10""",
)
def search_deep(spark, sf):
    """Expansion behind the strong-signal gate, six rankings, re-ranking, blending."""
    out = search(
        sentences(spark, sf), index(spark, sf), "deep", expander=variants(spark, sf), scorer=overlap_scores, strict=True
    )
    return out.results.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
        *[F.round(c, 6).alias(c) for c in ("score", "rrf_score", "rerank_score")],
    )


# A cache answers by the text: equal texts get the variants of the first of them.
_VARIANTS_BY_TEXT = _VARIANTS.replace(
    "word AS (SELECT query_id, item_id,", "word AS (SELECT query_id, first_value(item_id) OVER (PARTITION BY text ORDER BY query_id) AS item_id,"
)


@query(
    "search_deep_cached",
    f"""WITH {BOTH}, {_VARIANTS_BY_TEXT}, {rrf('lists')}, {_RERANK}
SELECT query_id, rank, doc_id, round(score, 6) AS score, round(rrf, 6) AS rrf_score, round(rel, 6) AS rerank_score
FROM ranked WHERE rank < 10""",
)
def search_deep_cached(spark, sf):
    """A deep search a second time: its expander and its scorer are not asked again."""
    root = new_dir(spark, "cache")

    def never(rows):
        raise AssertionError("the cache has to answer")

    asked, held = sentences(spark, sf), index(spark, sf)
    search(asked, held, "deep", expander=variants(spark, sf), scorer=overlap_scores, cache=ResultCache(root, _NOW), strict=True)
    out = search(asked, held, "deep", expander=never, scorer=never, cache=ResultCache(root, _NOW + 3_000_000), strict=True)
    return out.results.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
        *[F.round(c, 6).alias(c) for c in ("score", "rrf_score", "rerank_score")],
    )


@query(
    "search_deep_degraded",
    f"""WITH {SENTENCES_SQL}, {DOCVEC},
sq AS (SELECT query_id, item_id, s.text, embedding::DOUBLE[] AS qv FROM sentences s LEFT JOIN embeddings ON vec_id = item_id),
{knn('sq', 50)}, n AS (SELECT query_id, count(*) AS c FROM vec GROUP BY 1)
SELECT query_id, 'deep' AS mode, coalesce(c, 0) AS total_candidates, FALSE AS strong_signal,
       'Initial BM25 search failed: no lexical index|BM25 search failed for query "' || substring(text, 1, 50) || '": no lexical index'
       || CASE WHEN qv IS NULL THEN '|Vector search failed for query "' || substring(text, 1, 50) || '": the query has no embedding' ELSE '' END AS warnings
FROM sq LEFT JOIN n USING (query_id)""",
)
def search_deep_degraded(spark, sf):
    """Report of a deep search over an index without words: vectors answer, and the report says so."""
    held = replace(index(spark, sf), postings=None, blocks=None)
    report = search(sentences(spark, sf), held, "deep").report
    return report.select("query_id", "mode", "total_candidates", "strong_signal", F.array_join("warnings", "|").alias("warnings"))


@query(
    "search_deep_top50",
    f"""WITH {BOTH}, {_VARIANTS}, {rrf('lists')}, {_RERANK}
SELECT query_id, rank, doc_id, round(score, 6) AS score, round(rrf, 6) AS rrf_score, round(rel, 6) AS rerank_score FROM ranked
UNION ALL
SELECT query_id, rank, doc_id, round(score, 6), round(score, 6), NULL FROM fused WHERE rank BETWEEN 20 AND 49""",
)
def search_deep_top50(spark, sf):
    """More results than are re-ranked: the rest of the fused ranking follows."""
    out = search(
        sentences(spark, sf), index(spark, sf), "deep", SearchParams(top_k=50, candidate_multiplier=1),
        expander=variants(spark, sf), scorer=overlap_scores, strict=True,
    )
    return out.results.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
        *[F.round(c, 6).alias(c) for c in ("score", "rrf_score", "rerank_score")],
    )


@query(
    "search_deep_report",
    f"""WITH {BOTH}, {_VARIANTS}, {rrf('lists')},
n AS (SELECT query_id, count(*) AS c FROM fused GROUP BY 1),
x AS (SELECT query_id, string_agg(text, '|' ORDER BY variant_no) AS v FROM variants GROUP BY 1)
SELECT s.query_id, 'deep' AS mode, coalesce(c, 0) AS total_candidates, coalesce(v, '') AS expanded_queries,
       s.query_id IN (SELECT query_id FROM strong) AS strong_signal, coalesce(c, 0) > 0 AS rerank_applied,
       CASE WHEN s.query_id IN (SELECT query_id FROM strong) THEN 'strong_signal_detected' END AS skip_reason
FROM sentences s LEFT JOIN n USING (query_id) LEFT JOIN x USING (query_id)""",
)
def search_deep_report(spark, sf):
    out = search(
        sentences(spark, sf), index(spark, sf), "deep", expander=variants(spark, sf), scorer=overlap_scores, strict=True
    )
    return out.report.select(
        "query_id", "mode", "total_candidates", F.array_join("expanded_queries", "|").alias("expanded_queries"),
        "strong_signal", "rerank_applied", F.col("stages")[2]["skip_reason"].alias("skip_reason"),
    )


@query(
    "expansion_gate",
    f"""WITH {TOKENS}, {SENTENCES_SQL}, {bm25('sentences', 50)},
pair AS (SELECT query_id, max(CASE WHEN rank = 0 THEN score END) AS one, coalesce(max(CASE WHEN rank = 1 THEN score END), 0) AS two
         FROM lex GROUP BY 1)
SELECT query_id, coalesce(round(1 - two / one, 9) >= 0.15, FALSE) AS strong_signal,
       CASE WHEN round(1 - two / one, 9) >= 0.15 THEN 'strong_signal_detected' ELSE 'llm_unavailable' END AS skip_reason,
       TRUE AS skipped
FROM sentences LEFT JOIN pair USING (query_id)""",
)
def gate(spark, sf):
    """Gate without an expander: a strong signal is named first."""
    asked = sentences(spark, sf).select("query_id", "text")
    return expansion_gate(asked, strong_signal(words(spark, sf, asked)), available=False)


@query(
    "rrf_multi_query",
    f"""WITH {BOTH}, {_VARIANTS}, {rrf('lists')}
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM fused WHERE rank < 10""",
)
def rrf_multi_query(spark, sf):
    """Up to six rankings per query, fused by weight; no re-ranking."""
    out = search(sentences(spark, sf), index(spark, sf), "deep", expander=variants(spark, sf), strict=True)
    return ranked(out.results)


# ---- re-ranking on its own ----

_RESPONSES = """
responses AS (
  SELECT conv_id AS query_id, turn,
         CASE turn % 4 WHEN 0 THEN '[{"id": ' || turn || ', "score": ' || s || '}, {"id": 999, "score": 0.5}]'
              WHEN 1 THEN 'Scores:' || chr(10) || '```json' || chr(10) || '[{"id": "' || turn || '", "score": ' || s || '}]' || chr(10) || '```'
              WHEN 2 THEN 'I think [{"id": ' || turn || ', "score": "high"}] fits'
              ELSE 'no scores: ' || turn END AS raw, s
  FROM (SELECT *, CASE WHEN length(text) % 5 = 0 THEN 1.5::DOUBLE WHEN length(text) % 5 = 1 THEN -0.3::DOUBLE
                       ELSE 0.25::DOUBLE END AS s FROM conversations)
)"""


def responses(spark, sf):
    """A scorer's answers, one per turn: plain, fenced, wrapped in prose, unreadable."""
    n = F.length("text") % 5
    score = F.when(n == 0, "1.5").when(n == 1, "-0.3").otherwise("0.25")
    turn = F.col("turn").cast("string")
    kind = F.col("turn") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit('[{"id": '), turn, F.lit(', "score": '), score, F.lit('}, {"id": 999, "score": 0.5}]')))
        .when(kind == 1, F.concat(F.lit('Scores:\n```json\n[{"id": "'), turn, F.lit('", "score": '), score, F.lit("}]\n```")))
        .when(kind == 2, F.concat(F.lit('I think [{"id": '), turn, F.lit(', "score": "high"}] fits')))
        .otherwise(F.concat(F.lit("no scores: "), turn))
    )
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), "turn", raw.alias("raw"))


@query(
    "rerank_parse",
    f"""WITH {_RESPONSES}
SELECT query_id, turn AS cand_id, CASE WHEN turn % 4 = 2 THEN 0.0::DOUBLE ELSE greatest(0, least(1, s)) END AS score
FROM responses WHERE turn % 4 <> 3""",
)
def rerank_parse(spark, sf):
    """Scores out of readable and half readable answers, known ids only, clamped."""
    raw = responses(spark, sf)
    return parse_scores(raw, raw.select("query_id", F.col("turn").alias("cand_id")))


@query(
    "rerank_indexed",
    """
SELECT conv_id AS query_id, turn AS cand_id,
       CASE WHEN turn % 3 = 0 THEN 0.0::DOUBLE ELSE least(1, length(text) / 100.0::DOUBLE) END AS score
FROM conversations WHERE turn % 3 <> 2""",
)
def rerank_indexed(spark, sf):
    """Scores by position; a position outside the candidates is dropped."""
    turns = table(spark, sf, "conversations")
    turn = F.col("turn").cast("string")
    item = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"index": '), turn, F.lit("}")))
        .when(F.col("turn") % 3 == 1, F.format_string('{"index": %d, "relevance_score": %s}', "turn", (F.length("text") / 100).cast("string")))
        .otherwise('{"index": -1, "relevance_score": 0.9}')
    )
    raw = turns.select(
        F.col("conv_id").alias("query_id"), F.concat(F.lit('{"results": ['), item, F.lit("]}")).alias("raw")
    )
    cands = turns.select(
        F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("rank"), F.col("turn").alias("cand_id")
    )
    return parse_indexed_scores(raw, cands).select("query_id", "cand_id", "score")


@query(
    "expand_parse",
    """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || '|' || role || ' again' ELSE '' END AS variants
FROM conversations""",
)
def expand_parse(spark, sf):
    """Expander answers: at most two variants, unreadable ones give none."""
    role = F.col("role")
    raw = F.when(
        F.col("turn") % 2 == 0,
        F.concat(F.lit('["'), role, F.lit('", "'), role, F.lit(' again", "third"]')),
    ).otherwise("none")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(response_variants(raw), "|").alias("variants")
    )


@query(
    "position_blend",
    f"""WITH {BOTH}, {LISTS}, {rrf('lists')}, {_RERANK}
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked""",
)
def position_blend(spark, sf):
    lex, vec = both_engines(spark, sf)
    lists = lex.select("query_id", "doc_id", "chunk_index", "rank").unionByName(
        vec.select("query_id", "doc_id", "chunk_index", "rank")
    )
    best = top_k(rrf_fusion(lists), P.rerank_limit).drop("best_rank")
    inputs = rerank_inputs(best, index(spark, sf).chunks).join(
        sentences(spark, sf).select("query_id", F.col("text").alias("query_text")), "query_id"
    )
    return ranked(blend(best, overlap_scores(inputs)))


def _cache(spark, sf):
    """Conversation texts of even turns, some of them expired."""
    return table(spark, sf, "conversations").filter("turn % 2 = 0").select(
        cache_key("expand", "small", F.col("text")).alias("cache_key"),
        F.col("role").alias("result_json"),
        (F.lit(_NOW) - F.col("turn") * 1_000_000).alias("created_at"),
    )


_KEY = "'expand:' || substring(sha256('expand:small:' || text), 1, 32)"


@query(
    "score_cache_miss",
    f"""
SELECT conv_id, turn, {_KEY} AS cache_key FROM conversations
WHERE {_KEY} NOT IN (SELECT {_KEY} FROM conversations WHERE turn % 2 = 0 AND turn * 1000000 <= 3600000)""",
)
def score_cache_miss(spark, sf):
    keyed = table(spark, sf, "conversations").select(
        "conv_id", "turn", cache_key("expand", "small", F.col("text")).alias("cache_key")
    )
    return cache_misses(keyed, _cache(spark, sf), _NOW)


@query(
    "score_cache_merge",
    f"""
SELECT cache_key, max(created_at)::BIGINT AS created_at FROM (
  SELECT {_KEY} AS cache_key, {_NOW} - turn * 1000000 AS created_at FROM conversations WHERE turn % 2 = 0
  UNION ALL SELECT {_KEY}, {_NOW} + turn FROM conversations)
GROUP BY 1""",
)
def score_cache_merge(spark, sf):
    fresh = table(spark, sf, "conversations").select(
        cache_key("expand", "small", F.col("text")).alias("cache_key"),
        F.lit("[]").alias("result_json"),
        (F.lit(_NOW) + F.col("turn")).alias("created_at"),
    )
    return cache_merge(_cache(spark, sf), fresh).select("cache_key", "created_at")


@query(
    "rerank_cache_key",
    """
SELECT conv_id, 'rerank:' || substring(sha256('rerank:scorer:' || conv_id || '::' || string_agg(turn::VARCHAR, ',' ORDER BY turn)), 1, 32) AS cache_key
FROM conversations GROUP BY conv_id""",
)
def rerank_cache_keys(spark, sf):
    """Key of a rerank call over the turn numbers of a conversation."""
    ids = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("ids"))
    text = rerank_cache_text(F.col("conv_id").cast("string"), F.col("ids"))
    return ids.select("conv_id", cache_key("rerank", "scorer", text).alias("cache_key"))


@query(
    "detail_brief",
    f"""WITH {TOKENS}, {SENTENCES_SQL}, {bm25('sentences', 50)}, {_LEX_ONLY}, {_cut('one', '(0.7::DOUBLE * lex_norm)', 'lex_norm')}
SELECT query_id, rank, doc_id, 0::BIGINT AS chunk_index, source AS title, {DOC_PATH_SQL} AS doc_path, round(score, 6) AS score
FROM ranked JOIN documents USING (doc_id)""",
)
def detail_brief(spark, sf):
    out = search(sentences(spark, sf), index(spark, sf), "bm25_only").results
    return detail(out, "brief").withColumns(
        {"score": F.round("score", 6), "rank": F.col("rank").cast("long"), "chunk_index": F.col("chunk_index").cast("long")}
    )


@query(
    "detail_normal",
    f"""WITH {BOTH}, {LINEAR}, {_cut('norm', _LIN, 'lex_norm', 'vec_norm')}
SELECT query_id, rank, doc_id, 0::BIGINT AS chunk_index, source AS title, {DOC_PATH_SQL} AS doc_path, lang AS heading_path,
       CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS snippet,
       round(score, 6) AS score, round(lex_norm, 6) AS lex_norm, round(vec_norm, 6) AS vec_norm
FROM ranked JOIN documents USING (doc_id)""",
)
def detail_normal(spark, sf):
    out = search(sentences(spark, sf), index(spark, sf), params=replace(P, fusion="linear")).results
    rounded = {c: F.round(c, 6) for c in ("score", "lex_norm", "vec_norm")}
    return detail(out, "normal").withColumns(
        {**rounded, "rank": F.col("rank").cast("long"), "chunk_index": F.col("chunk_index").cast("long")}
    )


_INSIDE = f"""{TOKENS}, {SENTENCES_SQL}, {DOCVEC},
inside AS (SELECT query_id, s.text, 'en' AS namespace, embedding::DOUBLE[] AS qv
           FROM sentences s LEFT JOIN embeddings ON vec_id = item_id),
{bm25('inside', 50, namespace=True)}, {knn('inside', 50, scope='v.lang = q.namespace')}"""


@query("search_namespace", f"WITH {_INSIDE}, {LISTS}, {rrf('lists')}, {_cut('fused', 'score')} {_SHAPE}")
def search_namespace(spark, sf):
    """Hybrid search inside one namespace: both engines filter before the cut."""
    asked = sentences(spark, sf).withColumn("namespace", F.lit("en"))
    return shaped(search(asked, index(spark, sf)).results)


def length_scores(question: str, texts: list[str]) -> list[float]:
    """A scorer function: longer candidates score higher, up to 1."""
    return [len(t) / 500 for t in texts]


@query(
    "rerank_function",
    f"""WITH {BOTH}, {LISTS}, {rrf('lists')}
SELECT query_id, doc_id, round(least(1, length(substring(text, 1, 500)) / 500.0::DOUBLE), 6) AS score
FROM fused JOIN documents USING (doc_id) WHERE rank < 20""",
)
def rerank_function(spark, sf):
    """A Python scorer over the candidates of each query, at most twenty per call."""
    lex, vec = both_engines(spark, sf)
    lists = lex.select("query_id", "doc_id", "chunk_index", "rank").unionByName(
        vec.select("query_id", "doc_id", "chunk_index", "rank")
    )
    best = top_k(rrf_fusion(lists), P.rerank_limit)
    inputs = rerank_inputs(best, index(spark, sf).chunks).join(
        sentences(spark, sf).select("query_id", F.col("text").alias("query_text")), "query_id"
    )
    scored = score_with(inputs.select("query_id", "query_text", "doc_id", "chunk_index", "text"), length_scores)
    return scored.select("query_id", "doc_id", F.round("score", 6).alias("score"))
