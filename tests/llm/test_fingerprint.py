import random
from collections import Counter

import cases
import numpy as np
import pytest

from notelake.llm.fingerprint import PieceWords, digests, fingerprint_edits, likeness


def test_edits_match_brute_force(spark):
    data = [r for r in cases.rows() if r[0] is not None][:-2]
    got = {r["doc_id"]: r for r in fingerprint_edits(cases.frame(spark, data)).collect()}
    assert len(got) == len(data)
    texts = [r[1] or "" for r in data]
    for i, t in enumerate(texts):
        q, after = len(t) // 4, texts[(i + 1) % len(texts)]
        r = got[i]
        assert (r["n_chars"], r["edited"]) == (len(t), t[: len(t) - q] + after[:q])
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    by_text = {}
    for i, t in enumerate(texts):
        assert by_text.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert len(set(by_text.values())) >= len(by_text) - 1  # the two texts without words are alike
    assert got[0]["near_next"] == 1.0
    long = [i for i, t in enumerate(texts) if len(t) > 300 and t != "a " * 90]
    assert sum(got[i]["near_edited"] > 0.5 for i in long) > 0.9 * len(long)


@pytest.mark.parametrize("seed", range(4))
def test_peeling_recovers_the_exact_difference(seed):
    rng = random.Random(seed)
    texts = [[" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 3, 50, 4000]))) for _ in range(12)] for _ in range(2)]
    texts[1][:4] = [t[: len(t) // 2] for t in texts[0][:4]]
    a, b = (digests(x, PieceWords()) for x in texts)
    want = []
    for i in range(12):
        x, y = (Counter(k[s[i] : s[i + 1]].tolist()) for k, s in (a, b))
        n = x.total() + y.total()
        want.append(1 - ((x - y).total() + (y - x).total()) / n if n else 1.0)
    assert np.allclose(likeness(a, b), want)


def test_ties_nulls_and_repeated_rows(spark):
    got = fingerprint_edits(cases.frame(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in cases.rows())
    assert fingerprint_edits(cases.frame(spark, [])).collect() == []
    one = fingerprint_edits(cases.frame(spark, [(3, "a b. c d.", *[None] * 7)])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(3, 1.0)]
