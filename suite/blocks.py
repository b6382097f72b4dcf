"""Oracle SQL building blocks."""

from __future__ import annotations

from notelake.params import FIELD_WEIGHTS


def tok(expr: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({expr})), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


TOKENS = f"""
tok AS MATERIALIZED (
  SELECT doc_id, lang, fld, unnest(l) AS term, unnest(range(len(l))) AS pos FROM (
    SELECT doc_id, lang, 0 AS fld, {tok('source')} AS l FROM documents
    UNION ALL SELECT doc_id, lang, 1, {tok('lang')} FROM documents
    UNION ALL SELECT doc_id, lang, 2, {tok('text')} FROM documents)
),
dl AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1),
corpus AS (
  SELECT (SELECT count(*) FROM documents)::DOUBLE AS n_rows,
         (SELECT count(*) FROM tok)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl
)"""


def bm25(
    source: str,
    k: int | None,
    keys: str = "query_id",
    namespace: bool = False,
    weights: dict[str, float] = FIELD_WEIGHTS,
    out: str = "lex",
    prefix: str = "",
) -> str:
    """CTEs that end in ``out(keys, doc_id, score, rank)``; needs ``TOKENS`` and ``source``."""
    p = prefix
    ns = "namespace" if namespace else "NULL::VARCHAR AS namespace"
    case = " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(weights.values()))
    cut = "" if k is None else f" WHERE rank < {k}"
    return f"""
{p}said AS (
  SELECT {keys}, {ns}, array_to_string(t, ' ') AS phrase, t
  FROM (SELECT {keys}, {'namespace,' if namespace else ''} {tok('p')} AS t
        FROM (SELECT {keys}, {'namespace,' if namespace else ''} unnest(string_split_regex(text, '\\s+')) AS p FROM {source}))
  WHERE len(t) > 0
),
{p}phrases AS (SELECT {keys}, namespace, phrase, count(*) AS repeats FROM {p}said GROUP BY ALL),
{p}need AS (SELECT {keys}, count(*) AS n_phrases FROM {p}phrases GROUP BY ALL),
{p}parts AS (
  SELECT phrase, len(t) AS phrase_len, unnest(t) AS term, unnest(range(len(t))) AS ofs
  FROM (SELECT DISTINCT phrase, t FROM {p}said)
),
{p}hit AS (
  SELECT phrase, doc_id, lang, fld, pos - ofs AS start
  FROM {p}parts JOIN tok USING (term)
  GROUP BY phrase, phrase_len, doc_id, lang, fld, pos - ofs HAVING count(*) = phrase_len
),
{p}wtf AS (
  SELECT phrase, doc_id, lang, sum(CASE fld {case} END) AS wtf FROM {p}hit GROUP BY ALL
),
{p}idf AS (
  SELECT phrase, CASE WHEN x <= 0 THEN 1e-6::DOUBLE ELSE x END AS idf FROM (
    SELECT phrase, ln((n_rows - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS x
    FROM (SELECT phrase, count(*)::DOUBLE AS df FROM {p}wtf GROUP BY 1), corpus)
),
{p}scored AS (
  SELECT {keys}, doc_id,
         sum(repeats * idf * (wtf * 2.2::DOUBLE)
             / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.n / avgdl))) AS score
  FROM {p}phrases JOIN {p}wtf USING (phrase) JOIN {p}idf USING (phrase)
  JOIN dl USING (doc_id) JOIN {p}need USING ({keys}), corpus
  WHERE {p}phrases.namespace IS NULL OR {p}phrases.namespace = lang
  GROUP BY {keys}, doc_id, n_phrases HAVING count(*) = n_phrases
),
{out} AS (
  SELECT * FROM (
    SELECT {keys}, doc_id, score,
           row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank
    FROM {p}scored){cut}
)"""


def knn(queries: str, k: int, keys: str = "query_id", scope: str = "TRUE", metric: str = "l2", out: str = "vec", vectors: str = "docvec") -> str:
    """CTE ``out(keys, doc_id, score, rank)`` over ``queries(keys, qv)``."""
    fn = "list_distance" if metric == "l2" else "list_cosine_distance"
    return f"""
{out} AS (
  SELECT * FROM (
    SELECT {keys}, doc_id, score,
           row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank
    FROM (SELECT {keys}, doc_id, 1.0::DOUBLE / (1.0::DOUBLE + {fn}(qv, ev)) AS score
          FROM {queries} q, {vectors} v WHERE qv IS NOT NULL AND {scope}))
  WHERE rank < {k}
)"""


DOCVEC = """
docvec AS (
  SELECT doc_id, lang, embedding::DOUBLE[] AS ev
  FROM embeddings JOIN documents ON vec_id = doc_id
)"""


def rrf(lists: str, out: str = "fused", k: int = 60) -> str:
    """CTE ``out(query_id, doc_id, score, rank)`` over ``lists(query_id, doc_id, rank, weight)``."""
    return f"""
{out} AS (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank
  FROM (
    SELECT query_id, doc_id,
           sum(weight / ({k}::DOUBLE + rank + 1))
           + CASE WHEN min(rank) = 0 THEN 0.05::DOUBLE WHEN min(rank) <= 2 THEN 0.02::DOUBLE ELSE 0 END AS score
    FROM {lists} GROUP BY 1, 2)
)"""
