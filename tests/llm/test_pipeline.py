import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
from test_rules import brute

from notelake.llm.packing import pack

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_follow_each_other(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, first = [], {}
    for i in range(160):
        lang, kind = rng.choice(["en", "en", "de", "fr", "es"]), i % 8
        text = " ".join({"en": "", "de": "ung", "fr": "eau", "es": "os"}[lang].join((word(), "")) for _ in range(rng.randint(60, 120)))
        if kind == 0:
            text = " ".join(w + "###" for w in text.split())
        if kind == 1 and i > 8:
            text, lang = rows[i - 6][1], rows[i - 6][2]
        if kind == 2:
            text += f" mail me{i}@host.example.com now"
        rows.append((i, text, lang, "s", len(text)))
    rows += [(200, "short text", "en", None, 2), (201, None, None, None, None)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    fine = {r[0] for r in rows if r[0] % 8 and (b := brute(r[1]))[0] >= 20 and 100 * b[4] <= 30 * b[0]}
    assert set(seen["quality rules"]) == fine
    for doc in sorted(fine):
        first.setdefault(rows[doc][1], doc)
    assert set(seen["near copies"]) == set(first.values())
    assert set(seen["personal data"]) == set(first.values())
    for doc, text in seen["personal data"].items():
        assert text == rows[doc][1].replace(f"me{doc}@host.example.com", "[EMAIL]")
    assert set(seen["mixing"]) == set(first.values())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, got)) == Counter(map(key, want))
