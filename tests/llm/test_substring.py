import hashlib
import random
from collections import Counter

import cases
import pytest

from notelake.llm.substring import repeated_passages


def brute(data, window):
    texts = [(t or "").encode().split() for _, t, *_ in data]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = Counter()
    for (doc, *_), w in zip(data, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[(doc, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def found(frame, **kw):
    cut, whole = repeated_passages(frame, **kw)
    out = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in cut.collect())
    return out + Counter((r["doc_id"], r["n_words"], 0, r["whole"]) for r in whole.collect())


def test_matches_brute_force(spark):
    data = cases.rows()
    assert found(cases.frame(spark, data), window=35) == brute(data, 35)
    assert found(cases.frame(spark, []), window=35) == Counter()


@pytest.mark.parametrize("seed", range(6))
def test_random_overlaps(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(rng.choice([2, 6, 400]))]
    source = [rng.choice(words) for _ in range(400)]
    data = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(source))
            text += source[at : at + rng.randint(1, 60)] if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
        data.append((i, rng.choice([" ", "\n"]).join(text), *[None] * 7))
    for window, k in ((35, 20), (9, 5), (12, 12)):
        assert found(cases.frame(spark, data), window=window, k=k) == brute(data, window)
