from collections import Counter

import cases
import numpy as np
from pyspark.sql import functions as F
from test_fields import tongues

from notelake.llm.mixing import cell_of, fit_rates, learn_domains, memberships, mixed_documents, mixed_rates, rate_of


def frame(spark, extra=()):
    made = tongues(40)
    return cases.frame(spark, [*((i, t, lang, *[None] * 6) for i, (lang, t) in enumerate(made)), *extra])


def totals(rows):
    out = np.zeros(2)
    for r in rows:
        out += r["rate"] * r["tokens"] * np.array(r["posterior"])
    return out


def test_expected_tokens_match_the_targets(spark):
    docs = frame(spark, [(900, None, None, *[None] * 6), (901, "12 13", None, *[None] * 6), (None, "mi ta", None, *[None] * 6)])
    for thin in (True, False):
        rows = mixed_rates(docs, docs, {"aa": 3, "bb": 1}, thin=thin).collect()
        assert len(rows) == 83
        got = totals(rows)
        assert np.allclose(got / got.sum(), [0.75, 0.25], atol=1e-3)
        assert min(r["rate"] for r in rows) >= (0 if thin else 1)
        assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)


def test_rates_are_the_least_squares_solution(spark):
    rng = np.random.default_rng(5)
    p, n = rng.dirichlet([0.4] * 3, 200), rng.integers(1, 90, 200)
    held = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "tokens long, posterior array<double>")
    for share, least, keep in (([0.7, 0.29, 0.01], 0.0, True), ([0.34, 0.33, 0.33], 0.0, True), ([0.5, 0.3, 0.2], 1.0, False)):
        slope, off = fit_rates(held, np.array(share), least=least, keep_total=keep)
        rates = np.array([r[0] for r in held.select(rate_of(cell_of(F.col("posterior")), slope, least)).collect()])
        got = (rates * n) @ p
        assert rates.min() >= least and off < 1e-5
        assert np.abs(got / got.sum() - share).max() < 1e-3
        assert not keep or abs(got.sum() - n.sum()) < 1e-3 * n.sum()


def test_weights_that_cannot_be_met_come_near(spark):
    held = spark.createDataFrame([(10, [0.8, 0.2]), (30, [0.4, 0.6])], "tokens long, posterior array<double>")
    slope, off = fit_rates(held, np.array([1.0, 0.0]))
    rates = [r[0] for r in held.select(rate_of(cell_of(F.col("posterior")), slope, 0.0)).collect()]
    assert off < 0.25 and min(rates) >= 0 and rates[1] < 0.1


def test_rows_are_repeated_as_often_as_their_copies(spark):
    twin = (0, tongues(40)[0][1], "aa", *[None] * 6)
    docs = frame(spark, [twin, (None, None, None, *[None] * 6)])
    out = mixed_documents(docs, docs, {"aa": 3, "bb": 1}, thin=False)
    assert out.dtypes == docs.dtypes
    copies = {r["doc_id"]: r["copies"] for r in mixed_rates(docs, docs, {"aa": 3, "bb": 1}, thin=False).collect()}
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == Counter({k: v * (2 if k == 0 else 1) for k, v in copies.items()})
    assert min(got.values()) >= 1


def test_without_labels_or_rows(spark):
    docs = cases.frame(spark, [(1, "ab cd", None, *[None] * 6)])
    assert [r["copies"] for r in mixed_rates(docs, docs, {"aa": 1.0}).collect()] == [1]
    assert mixed_documents(cases.frame(spark, []), docs, {"aa": 1.0}).collect() == []


def test_held_out_documents_get_their_domain(spark):
    made = tongues(160)
    docs = cases.frame(spark, [(i, t, lang, *[None] * 6) for i, (lang, t) in enumerate(made)])
    domains, model = learn_domains(docs.where("doc_id % 2 = 0"), "lang")
    rows = memberships(docs.where("doc_id % 2 = 1"), model).collect()
    right = [domains[int(np.argmax(r["posterior"]))] == made[r["doc_id"]][0] for r in rows]
    assert len(rows) == len(made) // 2 and np.mean(right) > 0.97


def test_equal_texts_get_equal_posteriors_in_any_batch(spark):
    made = tongues(40)
    rows = [(i, made[i % len(made)][1], made[i % len(made)][0], *[None] * 6) for i in range(3 * len(made))]
    docs = cases.frame(spark, rows)
    model = learn_domains(docs, "lang")[1]
    got = {}
    for parts in (1, 7):
        for r in memberships(docs.repartition(parts), model).collect():
            got.setdefault(r["content"], set()).add(tuple(r["posterior"]))
    assert max(len(x) for x in got.values()) == 1
