import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.operators.fusion import linear_fusion, ranks, rrf_fusion, strong_signal, top_k
from notelake.operators.lexical import _prepare, bm25_scores, bm25_topk, distinct_questions, match_several, phrase_terms, phrases_of, scan_several
from notelake.operators.postings import build_postings, chunk_lengths, corpus_stats, term_blocks, term_stats, token_positions
from notelake.operators.vectors import BLOCK_BYTES, SIDE, block_count, check_dimension, knn_topk
from notelake.params import FIELD_WEIGHTS, SearchParams

ROWS = [
    (1, "Auth Service", "Auth", "Handles JWT token generation", "auth", "", "root"),
    (2, "User Guide", "Guide", "How to use the app", "", "", "services/a"),
    (3, "API", "API", "JWT validation endpoint for JIRA-1234", "", "category:architecture", "root"),
    (10, "OAuth notes", "x", "plain", "", "", "root"),
    (11, "Other", "x", "oauth oauth text of the same kind", "", "", "root"),
]


@pytest.fixture(scope="module")
def lexical(spark):
    rows = spark.createDataFrame(
        [(r[0], 0, *r[1:]) for r in ROWS],
        "doc_id long, chunk_index int, title string, heading_path string, body string, tags string,"
        " properties string, namespace string",
    )
    held = build_postings(rows)
    return held, term_blocks(held), corpus_stats(chunk_lengths(rows))


def ask(spark, lexical, text, namespace=None, **kw):
    q = spark.createDataFrame([(1, text, namespace)], "query_id long, text string, namespace string")
    rows = bm25_topk(q, *lexical, k=10, **kw).orderBy("rank").collect()
    return [r.doc_id for r in rows], [r.score for r in rows]


def test_conjunction_over_fields(spark, lexical):
    assert ask(spark, lexical, "JWT auth")[0] == [1]
    ids, scores = ask(spark, lexical, "JWT")
    assert set(ids) == {1, 3} and all(s > 0 for s in scores)


def test_title_beats_body(spark, lexical):
    assert ask(spark, lexical, "oauth")[0] == [10, 11]


def test_phrase_needs_adjacency(spark, lexical):
    assert ask(spark, lexical, "JIRA-1234")[0] == [3]
    assert ask(spark, lexical, "1234-JIRA")[0] == []
    assert ask(spark, lexical, "jwt-validation")[0] == [3]
    assert ask(spark, lexical, "oauth-oauth")[0] == [11]


def test_property_search_and_empty_queries(spark, lexical):
    assert ask(spark, lexical, "architecture")[0] == [3]
    assert ask(spark, lexical, "")[0] == []
    assert ask(spark, lexical, " -- ")[0] == []
    assert ask(spark, lexical, "nothere")[0] == []


def test_namespace_is_applied_before_the_cut(spark, lexical):
    assert ask(spark, lexical, "the", "services/a")[0] == [2]
    assert ask(spark, lexical, "the", "none")[0] == []


def plain_bm25(query, phrase_len=1):
    fields = [(8.0, 1), (4.0, 2), (1.0, 3), (2.0, 4), (3.0, 5)]
    words = lambda s: "".join(c if c.isalnum() else " " for c in s.lower()).split()
    lens = {r[0]: sum(len(words(r[i])) for _, i in fields) for r in ROWS}
    avg, n = sum(lens.values()) / len(ROWS), len(ROWS)
    scores = {}
    for r in ROWS:
        total = 0.0
        for term in query.split():
            wtf = lambda row: sum(w * words(row[i]).count(term) for w, i in fields)
            df = sum(1 for x in ROWS if wtf(x) > 0)
            idf = math.log((n - df + 0.5) / (df + 0.5))
            idf = idf if idf > 0 else 1e-6
            f = wtf(r)
            if f == 0:
                break
            total += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lens[r[0]] / avg))
        else:
            scores[r[0]] = total
    return scores


@pytest.mark.parametrize("query", ["jwt", "the", "jwt token", "oauth oauth", "x"])
def test_scores_match_the_formula(spark, lexical, query):
    q = spark.createDataFrame([(1, query)], "query_id long, text string")
    got = {r.doc_id: r.score for r in bm25_scores(q, *lexical).collect()}
    want = plain_bm25(query)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-12)


def test_large_query_tables_take_the_open_join(spark, lexical, monkeypatch):
    small = ask(spark, lexical, "jwt-validation endpoint")
    monkeypatch.setattr("notelake.operators.lexical.pin_if_small", lambda df: (df, None))
    assert ask(spark, lexical, "jwt-validation endpoint") == small
    assert ask(spark, lexical, "oauth")[0] == [10, 11]


def test_postings_layout(spark, lexical):
    row = lexical[0].filter("term = 'oauth' AND doc_id = 11").first()
    assert (row.tf_title, row.tf_body, row.n_tokens) == (0, 2, 9)
    assert [(p >> 26, p % (1 << 26)) for p in row.places] == [(2, 0), (2, 1)]
    assert term_stats(lexical[0]).filter("term = 'oauth'").first().df == 2


VECTORS = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.9, 0.1, 0.0, 0.0])]


def test_knn_small_case(spark):
    v = spark.createDataFrame([(d, 0, e) for d, e in VECTORS], "doc_id long, chunk_index int, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    rows = knn_topk(q, v, 3).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [1, 3, 2]
    assert rows[0].score == 1.0
    assert rows[2].score == pytest.approx(1 / (1 + math.sqrt(2)))
    check_dimension(v, 4)
    with pytest.raises(ValueError, match="dimension"):
        check_dimension(v, 5)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("blocks", [False, True])
def test_knn_matches_brute_force_with_many_copies(spark, metric, blocks):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(240, 8)).astype(np.float32)
    base[80:160] = base[5]  # a third of the table is one vector
    places = ["a" if i % 2 else "b" for i in range(240)]
    v = spark.createDataFrame(
        [(i, 0, base[i].tolist(), places[i]) for i in range(240)],
        "doc_id long, chunk_index int, embedding array<float>, namespace string",
    )
    scopes = [None if i % 3 else "a" for i in range(30)]
    q = spark.createDataFrame(
        [(i, base[i].tolist(), scopes[i]) for i in range(30)],
        "query_id long, embedding array<float>, namespace string",
    )
    sizes = {"query_bytes": 64, "block_bytes": 64 * 50} if blocks else {}
    got = knn_topk(q, v, 7, metric, **sizes).orderBy("query_id", "rank").collect()
    x = base.astype(float)
    for i in range(30):
        if metric == "l2":
            dist = np.sqrt(((x - x[i]) ** 2).sum(1))
        else:
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            dist = ((unit - unit[i]) ** 2).sum(1) / 2
        order = sorted(
            (j for j in range(240) if scopes[i] is None or places[j] == scopes[i]),
            key=lambda j: (-round(1 / (1 + dist[j]), 9), j),
        )[:7]
        mine = [r for r in got if r.query_id == i]
        assert [r.doc_id for r in mine] == order
        assert [r.score for r in mine] == pytest.approx([1 / (1 + dist[j]) for j in order], abs=1e-9)


def lists(spark, *rankings):
    rows = [
        (1, i, 0, rank, weight)
        for weight, ids in rankings
        for rank, i in enumerate(ids)
        if i is not None
    ]
    return spark.createDataFrame(rows, "query_id long, doc_id long, chunk_index int, rank int, weight double")


def test_rrf_values(spark):
    one = {r.doc_id: r.score for r in rrf_fusion(lists(spark, (1.0, [5, 6, 7, 8, 9]))).collect()}
    assert one[5] == pytest.approx(1 / 61 + 0.05)
    assert one[6] == pytest.approx(1 / 62 + 0.02)
    assert one[7] == pytest.approx(1 / 63 + 0.02)
    assert one[9] == pytest.approx(1 / 65)
    both = top_k(rrf_fusion(lists(spark, (1.0, [1, 2, 3]), (1.0, [1, 4, 2]))), 10).orderBy("rank").collect()
    assert both[0].doc_id == 1
    assert both[0].score == pytest.approx(2 / 61 + 0.05)
    heavy = {r.doc_id: r.score for r in rrf_fusion(lists(spark, (2.0, [1]), (1.0, [2]))).collect()}
    assert heavy[1] - heavy[2] == pytest.approx(1 / 61)
    ten = {r.doc_id: r.score for r in rrf_fusion(lists(spark, (1.0, [1])), 10).collect()}
    assert ten[1] == pytest.approx(1 / 11 + 0.05)


def scores(spark, pairs):
    return spark.createDataFrame(
        [(1, i, 0, float(s)) for i, s in pairs], "query_id long, doc_id long, chunk_index int, score double"
    )


def test_ranks_from_scores(spark):
    got = {r.doc_id: r["rank"] for r in ranks(scores(spark, [(10, 0.5), (20, 0.9), (30, 0.7)])).collect()}
    assert got == {20: 0, 30: 1, 10: 2}


def test_linear_fusion_values(spark):
    lex, vec = scores(spark, [(1, 100), (2, 50)]), scores(spark, [(1, 0.9), (2, 0.3)])
    got = {r.doc_id: r for r in linear_fusion(lex, vec, 0.7, 0.3).collect()}
    assert (got[1].lex_norm, got[1].vec_norm) == (1.0, 1.0)
    assert got[2].lex_norm == 0.5 and got[2].vec_norm == pytest.approx(1 / 3)
    part = {r.doc_id: r for r in linear_fusion(scores(spark, [(1, 5), (2, 3)]), scores(spark, [(1, 0.8), (3, 0.9)]), 0.7, 0.3).collect()}
    assert max(part.values(), key=lambda r: r.score).doc_id == 1
    assert part[3].lex_norm == 0 and part[2].vec_norm == 0
    alone = linear_fusion(lex, None, 0.7, 0.0).orderBy(F.desc("score")).collect()
    assert [r.score for r in alone] == pytest.approx([0.7, 0.35])
    zero = linear_fusion(scores(spark, [(1, 0)]), None, 0.7, 0.0).first()
    assert zero.score == 0


@pytest.mark.parametrize(
    ("values", "detected", "gap"),
    [
        ([10, 7, 3], True, 0.3),
        ([10, 9.5], False, 0.05),
        ([5], True, 1.0),
        ([0, 0], False, 0.0),
        ([100, 85], True, 0.15),
    ],
)
def test_strong_signal(spark, values, detected, gap):
    row = strong_signal(scores(spark, list(enumerate(values)))).first()
    assert row.detected is detected
    assert row.gap == pytest.approx(gap)


def test_strong_signal_on_normalised_scores(spark):
    row = strong_signal(scores(spark, [(1, 0.9), (2, 0.6)]), normalized=True).first()
    assert row.detected and row.gap == pytest.approx(0.3)
    assert not strong_signal(scores(spark, [(1, 0.7), (2, 0.1)]), normalized=True).first().detected
    assert strong_signal(scores(spark, [])).count() == 0


def test_a_vector_is_not_copied_once_per_small_block():
    assert block_count(600, 512, 1 << 18) == 2
    assert block_count(600_000, 512, 1 << 18) == SIDE
    assert block_count(10**8, 512, 1 << 18) * BLOCK_BYTES >= 10**8 * 512


def test_queries_meet_vectors_of_their_namespace_only(spark, monkeypatch):
    from notelake.operators import vectors

    rng, pairs = np.random.default_rng(8), []
    plain = vectors._Best._block
    monkeypatch.setattr(vectors._Best, "_block", lambda self, block, doc, *rest: (pairs.append(len(block.q) * len(doc)), plain(self, block, doc, *rest)))
    x = rng.normal(size=(900, 16)) + 300.0  # far from the origin, so that rounding of products matters
    x[100:140] = x[7]
    scopes = np.array([None if i % 90 == 0 else f"n{i % 9}" for i in range(900)], dtype=object)
    best = vectors._Best(np.arange(900), x, scopes, 4, "l2")
    for at in range(0, 900, 300):
        best.add(np.arange(900)[at : at + 300], np.zeros(900, int)[at : at + 300], x[at : at + 300], scopes[at : at + 300])
    assert sum(pairs) < 900 * 900 / 7
    got = {}
    for row in best.table().to_pylist():
        got.setdefault(row["query_id"], []).append((-round(row["score"], 9), row["doc_id"]))
    for i in range(900):
        inside = [j for j in range(900) if scopes[i] is None or scopes[j] == scopes[i]]
        score = [(-round(1 / (1 + float(np.sqrt(((x[j] - x[i]) ** 2).sum()))), 9), j) for j in inside]
        assert sorted(got[i]) == sorted(score)[:4]


def test_a_scan_finds_the_phrases_of_the_join(spark):
    rng = np.random.default_rng(5)
    said = lambda n: " ".join(rng.choice(list("abcd"), n))
    rows = [(d, d % 2, said(3), "x", said(int(rng.integers(0, 60))), "", "a b", "root" if d % 3 else None) for d in range(150)]
    names = "doc_id long, chunk_index int, title string, heading_path string, body string, tags string, properties string, namespace string"
    postings = build_postings(spark.createDataFrame(rows, names))
    phrases = ["a a", "a a a", "a b", "a b c d", "b", "b a", "d c b a d", "x a", "q a", "a q"]
    terms = phrase_terms(spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    cols = ["phrase", "doc_id", "chunk_index", "namespace", "n_tokens", "origin", "block", "wtf"]
    want = match_several(postings, term_blocks(postings), terms, FIELD_WEIGHTS).select(*cols)
    got = scan_several(postings, [p for p in phrases if " " in p], FIELD_WEIGHTS)
    assert got.select(*cols).schema.simpleString() == want.schema.simpleString()
    rows = sorted(map(str, want.collect()))
    assert sorted(map(str, got.select(*cols).collect())) == rows and len(rows) > 300
    # A few rows at a time: chunks go on in the next batch.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(str, scan_several(postings, [p for p in phrases if " " in p], FIELD_WEIGHTS).select(*cols).collect())) == rows
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_phrases_that_share_words_do_not_multiply_postings(spark, lexical):
    phrases = [f"oauth {w}" for w in ("oauth", "text", "notes", *"abcdefgh")]
    plan = scan_several(lexical[0], phrases, FIELD_WEIGHTS)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.phrase, r.doc_id) for r in plan.collect()) == [("oauth notes", 10), ("oauth oauth", 11), ("oauth text", 11)]


def test_equal_questions_are_answered_once(spark, lexical):
    asked = [(1, "jwt-validation  endpoint", None), (2, "endpoint JWT-validation", None), (3, "oauth", None), (4, "oauth oauth", None), (5, "oauth", "root"), (6, "..", None)]
    q = spark.createDataFrame(asked, "query_id long, text string, namespace string")
    phrases, same = distinct_questions(q, ("query_id",))
    number = {r.query_id: r._no for r in same.collect()}
    assert number[1] == number[2] and len(set(number.values())) == 4 and 6 not in number
    assert phrases.count() == 5
    rows = bm25_topk(q, *lexical, k=10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in rows] == [(1, 3, 0), (2, 3, 0), *((i, d, n) for i in (3, 4, 5) for n, d in enumerate((10, 11)))]
    assert rows[0].score == rows[1].score and rows[4].score == pytest.approx(2 * rows[2].score)


def test_one_phrase_a_question_takes_one_exchange_less(spark, lexical):
    asked = lambda *texts: phrases_of(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"), ("query_id",))
    single, several = (_prepare(asked(*t), *lexical, SearchParams(), ("query_id",), None) for t in (("jwt", "oauth", "jwt-validation"), ("jwt", "jwt api")))
    assert single.single and not several.single
    assert "_parts" not in single.blocks.columns + several.blocks.columns
    plans = [x.blocks._jdf.queryExecution().executedPlan().toString() for x in (single, several)]
    assert "Exchange hashpartitioning" not in plans[0] and "SortAggregate" not in plans[1]
    assert single.blocks.count() == 3
