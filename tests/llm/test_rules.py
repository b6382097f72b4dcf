import random
import re
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from notelake.llm.common import WordHashes
from notelake.llm.rules import count_text, judged, kept_documents, learn_list

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {i + j for i in range(len(words) - 7) if at[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def labelled(spark, data, bad):
    rows = [(r[0], int(r[0] not in bad), 0) for r in data if r[0] is not None]
    return spark.createDataFrame([*rows, (None, 0, 0), (10**9, 0, 0), rows[0]] if rows else [], "doc_id long, quality int, toxic int")


def test_counts_match_brute_force(spark):
    data = [*cases.rows(), (500, "a b\na b\n a b\n#é|<x>! Ab\x85c d\n\n", *[None] * 7)]
    got = judged(cases.frame(spark, data), labelled(spark, data, set())).collect()
    want = Counter((r[0], *brute(r[1])) for r in data)
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r["_counts"][k] for k in keys)) for r in got) == want
    for r in got:
        c = r["_counts"]
        assert r["_base_failed"] == (c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"])


def test_repeats_are_counted_in_one_text_only():
    text = b"a b c d e f g h i"
    assert count_text([text, text, b""], WordHashes())["n_repeat_words"].tolist() == [0, 0, 0]


def test_learned_list_rejects_only_what_it_learned(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8)))
    data, bad = [], set()
    for i in range(600):
        words = [word() for _ in range(rng.randint(30, 120))]
        if i % 5 == 0:
            bad.add(i)
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + "###" for w in words]
        data.append((i, " ".join(words), *[None] * 7))
    docs = cases.frame(spark, data)
    kept = kept_documents(docs, labelled(spark, data, bad))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in data} - bad


def test_without_labels_only_the_base_rejects(spark):
    docs = cases.frame(spark)
    kept = {r["doc_id"] for r in kept_documents(docs, labelled(spark, [], set())).collect()}
    want = {r[0] for r in cases.rows() if (b := brute(r[1]))[0] >= 20 and 100 * b[4] <= 30 * b[0]}
    assert kept == want
    assert kept_documents(cases.frame(spark, []), labelled(spark, [], set())).collect() == []


def test_rules_need_precision():
    x = np.random.default_rng(1).random((500, 2))
    assert learn_list(x, np.arange(500) % 2, ["a", "b"]) == []
    assert learn_list(x, np.ones(500, int), ["a", "b"]) == []


def test_clashing_columns_keep_their_values(spark):
    names = ("_counts", "_id", "_label", "_rule", "_base_failed", "label", "counts", "c0", "given0")
    docs = cases.frame(spark).select("doc_id", "text", *(F.lit(7 + i).alias(c) for i, c in enumerate(names)))
    kept = kept_documents(docs, labelled(spark, cases.rows(), {0}))
    rows = kept.collect()
    assert kept.columns == docs.columns and rows and all(r[c] == 7 + i for r in rows for i, c in enumerate(names))


def test_words_are_counted_a_bounded_number_of_bytes_at_a_time(spark, monkeypatch):
    from notelake.llm import rules

    kept, seen = [], []
    docs = spark.createDataFrame([], "doc_id long, text string")
    with monkeypatch.context() as patched:
        patched.setattr(type(docs), "mapInArrow", lambda self, make, schema: kept.append(make) or spark.createDataFrame([], schema))
        rules.with_counts(docs)
    count = rules.count_text
    monkeypatch.setattr(rules, "count_text", lambda raw, table: seen.append([len(x) for x in raw]) or count(raw, table))
    texts = ["one two three " * 20_000] * 9 + ["word " * 400_000, "last"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["c0", "c1"])
    made = list(kept[0](iter([batch])))
    assert sum(b.num_rows for b in made) == len(texts) and [len(x) for x in texts] == sum(seen, [])
    assert all(sum(x) <= 1 << 20 or len(x) == 1 for x in seen)


def test_the_cache_of_word_hashes_is_small():
    table = WordHashes()
    words = [b"w%d" % i for i in range(60_000)]
    assert [table[x] for x in words[:3] * 2] == [xxhash.xxh64_intdigest(x) for x in words[:3] * 2]
    assert max(len(table) for x in words if table[x] is not None) <= 50_000
