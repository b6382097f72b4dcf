import hashlib
import random
import zlib

import cases
import pytest

from notelake.llm import query_runs
from notelake.llm.runs import Extensions, periodic_runs, runs, stretched


def brute(words):
    """Every run by its definition, one period after the other."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def damaged(doc, words):
    n = len(words)
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if doc is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            part = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 12))]
            words += (part * rng.randint(1, 9))[: rng.randint(1, 90)]
        texts.append([w.encode() for w in words])
    got = [[] for _ in texts]
    for k, s, n, q in zip(*(x.tolist() for x in runs(texts)), strict=True):
        got[k].append((s, n, q))
    assert got == [brute(t) for t in texts]


def test_long_periods_and_one_word():
    rng = random.Random(3)
    part = [str(rng.randrange(50)).encode() for _ in range(700)]
    texts = [part * 5 + part[:33], [b"a"] * 5000, [b"a", b"b"] * 900 + [b"a"] * 7, part]
    got = [[] for _ in texts]
    for k, s, n, q in zip(*(x.tolist() for x in runs(texts)), strict=True):
        got[k].append((s, n, q))
    assert got == [brute(t) for t in texts]


def test_cover_brings_every_pair_together():
    assert Extensions.shifts.shape == (16, 16) and Extensions.shifts.max() < 16


def test_operator_on_odd_rows(spark):
    data = cases.rows() + [(900 + i, "x y z " * i, *[None] * 7) for i in range(8)]
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(cases.frame(spark, data)).collect())
    want = []
    for doc, text, *_ in data:
        words = (text or "").encode().split()
        found = brute(words)
        want.append((str(doc), len(words), found, b" ".join(kept(words, found)).decode()))
    assert got == sorted(want)
    assert periodic_runs(cases.frame(spark, [])).collect() == []


def test_stretched(spark):
    data = cases.rows() + [(i, " ".join(f"w{i}_{k}" for k in range(i % 37)), *[None] * 7) for i in range(1000, 1400)]
    got = sorted((str(r["doc_id"]), r["text"].encode().split()) for r in stretched(cases.frame(spark, data)).collect())
    assert got == sorted((str(doc), damaged(doc, (text or "").encode().split())) for doc, text, *_ in data)


def test_query_matches_brute_force(spark, tmp_path):
    data = cases.rows() + [(i, " ".join(str(k * k % 11) for k in range(i % 83)), *[None] * 7) for i in range(2000, 2300)]
    cases.frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in query_runs.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc, text, *_ in data:
        words = damaged(doc, (text or "").encode().split())
        found = brute(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        of = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((doc, len(found), *of, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept(words, found))).hexdigest()))
    assert got == sorted(want, key=str)
