import itertools
import random
from collections import Counter

import cases
import numpy as np
import pytest

from notelake.llm.crf import LETTERS, Emissions, feature_ids, pieces, posteriors, train
from notelake.llm.language import detect, learn_languages
from notelake.llm.toxicity import learn_toxicity, proven, score_toxicity, seeds


@pytest.mark.parametrize("states", [2, 3])
def test_marginals_match_enumeration(states):
    rng = np.random.default_rng(states)
    lengths = [0, 1, 5, 0, 4, 7]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    scores, trans = rng.normal(size=(starts[-1], states)) * 2, rng.normal(size=(states, states))
    for block in (3, 256):
        got = posteriors(scores, starts, trans, block=block)
        for a, b in zip(starts, starts[1:]):
            want, total = np.zeros((b - a, states)), 0.0
            for path in itertools.product(range(states), repeat=b - a):
                w = np.exp(sum(scores[a + i, s] for i, s in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:])))
                total += w
                for i, s in enumerate(path):
                    want[i, s] += w
            assert np.allclose(got[a:b], want / total)


def test_training_learns_affixes_and_transitions():
    rng = random.Random(1)
    word = lambda end: ("".join(rng.choice("abcdef") for _ in range(4)) + end).encode()
    words, tags = [], []
    for _ in range(300):
        t = [rng.randrange(2)] * 16 + [rng.randrange(2)] * 16
        words.append([word("um" if x else "ix") for x in t])
        tags.append(np.array(t))
    weights, trans = train(words, tags, 2)
    assert trans[0, 0] + trans[1, 1] > trans[0, 1] + trans[1, 0]
    assert weights.shape[1] == 2 and np.abs(weights).max() > 0.1


def tongues(n, seed=4):
    rng = random.Random(seed)
    parts = {"aa": ["ko", "mi", "ta", "nu"], "bb": ["sch", "ung", "ein", "ver"]}
    return [(lang, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))) for lang in parts for _ in range(n)]


def test_language_of_held_out_documents_and_words(spark):
    made = tongues(60)
    data = [(i, t, lang if i % 3 else None, *[None] * 6) for i, (lang, t) in enumerate(made)]
    docs = cases.frame(spark, [*data, (900, None, "aa", *[None] * 6), (901, "12 !? --", "aa", *[None] * 6), (902, "", None, *[None] * 6), (903, made[0][1] + "\n" + made[-1][1], None, *[None] * 6), (None, "mi ta", None, *[None] * 6)])
    learned = learn_languages(docs)
    assert learned[0] == ["aa", "bb"]
    got = {r["doc_id"]: r for r in detect(docs, *learned, word_tags=True).collect()}
    assert all(got[i]["lang_pred"] == lang for i, (lang, _) in enumerate(made))
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[902]["score"] == 0
    tags = got[903]["word_tags"]
    first = len(made[0][1].split())
    assert Counter(tags[:first])["aa"] > 0.9 * first and Counter(tags[first:])["bb"] > 0.9 * (len(tags) - first)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_labels_or_rows(spark):
    docs = cases.frame(spark, [(1, "ab cd", None, *[None] * 6)])
    assert [tuple(r)[1:3] for r in detect(docs, *learn_languages(docs)).collect()] == [("und", 0.0)]
    empty = cases.frame(spark, [])
    assert detect(empty, *learn_languages(empty)).collect() == []


def spoken(n, seed=6):
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    bad = ["zorkel", "zorkels", "zorkeling", "quimp"]
    out = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(20, 80))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 3) * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        out.append((" ".join(words), int(toxic)))
    return out


def test_toxic_documents_and_spans(spark):
    made = spoken(400)
    data = [(i, t, *[None] * 7) for i, (t, _) in enumerate(made)]
    extra = [(900, "so zorkelish é QUIMP! yes", *[None] * 7), (901, None, *[None] * 7), (902, "", *[None] * 7), (None, "quimp", *[None] * 7)]
    docs = cases.frame(spark, [*data, *extra, data[0]])
    labels = spark.createDataFrame([*((i, 1, y) for i, (_, y) in enumerate(made) if i % 3), (None, 1, 1), (5, 1, None), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(docs, *learn_toxicity(docs, labels)).collect()}
    held = [i for i in range(len(made)) if i % 3 == 0]
    assert sum((got[i]["score"] >= 0.5) == bool(made[i][1]) for i in held) >= 0.97 * len(held)
    assert {(3, 12), (15, 21)} <= {(s["start"], s["end"]) for s in got[900]["spans"]}
    assert not any(got[i]["spans"] for i in held if not made[i][1] and got[i]["score"] < 0.5)
    assert got[901]["score"] == got[902]["score"] < 0.5 and got[901]["spans"] == []
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = cases.frame(spark)
    got = score_toxicity(docs, *learn_toxicity(docs, none)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in cases.rows())
    empty = cases.frame(spark, [])
    assert score_toxicity(empty, *learn_toxicity(empty, none)).collect() == []


def test_seeds_explain_documents_once():
    rows = [(["bad", "friend"], 1)] * 6 + [(["bad"], 1)] * 6 + [(["fine", "friendly"], 0)] * 30
    assert seeds(rows) == {"bad$"}


def test_seeds_have_to_hold_on_documents_kept_aside():
    marks = {"bad$", "chance$", "never$"}
    held = [({"bad$", "x"}, 1), ({"bad$"}, 1), ({"bad$"}, 0), ({"chance$"}, 0), ({"x"}, 0)]
    assert proven(marks, held) == {"bad$", "never$"}


def test_no_letter_of_a_long_word_is_left_out():
    long = "abcdefghij" * 6 + "zorkel"
    assert len(long) > LETTERS and feature_ids(long[:LETTERS]) not in [feature_ids(long[:39] + "y")]
    parts = pieces(long.encode())
    assert len(parts) > 1 and all(len(x) <= LETTERS for x in parts) and parts[-1].endswith("zorkel")
    assert all(any(long[i : i + 3] in x for x in parts) for i in range(len(long) - 2))
    assert pieces(b"https://" + b"a" * 30 + b".org/" + b"b" * 90)[:2] == ["https", "a" * 30]
    assert pieces(b"don't") == ["dont"] and pieces(b"12") == [""]
    emissions = Emissions(np.ones((1 << 17, 2), np.float32))
    at, word, starts = emissions.of([[b"a", long.encode(), b"b"], [], [b"7"]])
    assert word.tolist() == [0, *[1] * len(parts), 2, 3] and starts.tolist() == [0, len(parts) + 2, len(parts) + 2, len(parts) + 3] and at[-1] == 0
    other, _, _ = emissions.of([[("abcdefghij" * 6 + "angel").encode()]])
    assert other.tolist() != at[1 : 1 + len(parts)].tolist()


def test_an_insult_behind_the_fortieth_letter_is_found(spark):
    made = spoken(400)
    rows = [(i, t, *[None] * 7) for i, (t, _) in enumerate(made)]
    rows += [(900, "abcdefgh" * 7 + "-zorkel", *[None] * 7), (901, "abcdefgh" * 8, *[None] * 7)]
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(made)], "doc_id long, quality int, toxic int")
    docs = cases.frame(spark, rows)
    got = {r["doc_id"]: r for r in score_toxicity(docs, *learn_toxicity(docs, labels)).collect()}
    assert got[900]["score"] > 0.5 > got[901]["score"] and [(s["start"], s["end"]) for s in got[900]["spans"]] == [(0, 63)]


@pytest.mark.parametrize("n", [1, 14, 31, 33])
def test_few_words_are_learned(n):
    words = [[b"mi", b"ko"][i % 2] for i in range(n)]
    weights, _ = train([words], [np.arange(n) % 2], 2)
    scores = {w: weights[feature_ids(w.decode())].sum(axis=0) for w in set(words)}
    assert scores[b"mi"][0] > scores[b"mi"][1] and (n == 1 or scores[b"ko"][1] > scores[b"ko"][0])


def test_a_small_sample_predicts_its_languages(spark):
    docs = cases.frame(spark, [(1, "ko mi ta nu ko", "bb", *[None] * 6), (2, "schung ein ver", "aa", *[None] * 6), (2, "schung ein ver", "aa", *[None] * 6), (3, "ta nu", None, *[None] * 6)])
    got = {r["doc_id"]: r["lang_pred"] for r in detect(docs, *learn_languages(docs)).collect()}
    assert got == {1: "bb", 2: "aa", 3: "bb"}
