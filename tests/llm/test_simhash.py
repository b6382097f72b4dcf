import random
from collections import Counter

import cases
import xxhash

from notelake.llm.graph import components
from notelake.llm.simhash import close_fingerprints, near_copies, one_of_each, simhash_components, shingle_prefixes, shingle_ranks, simhash_pairs


def simhash(text, k=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in nodes}


def expected(data, radius, k=3):
    prints = {(d, t): simhash(t, k) for d, t, *_ in data}
    of = roots(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= radius)
    least = {}
    for (d, _), p in prints.items():
        if d is not None:
            least[of[p]] = min(d, least.get(of[p], d))
    return Counter((d, f"{prints[d, t]:016x}", least.get(of[prints[d, t]])) for d, t, *_ in data)


def test_components_match_all_pairs(spark):
    data = cases.rows()
    assert Counter(tuple(r) for r in simhash_components(cases.frame(spark, data)).collect()) == expected(data, 2)
    assert simhash_components(cases.frame(spark, [])).collect() == []


def test_crowded_blocks_lose_no_component(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = set(seeds)
    for _ in range(400):
        x = rng.choice([*prints]) if rng.random() < 0.3 else rng.choice(seeds)
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    want = roots({signed(x) for x in prints}, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    for crowd in (2, 1000):
        single = {tuple(sorted((r["a"], r["b"]))) for r in close_fingerprints(frame, radius=1, crowd=crowd).collect()}
        assert single == {(a, b) for a in want for b in want if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() == 1}
        links = close_fingerprints(frame, radius=2, crowd=crowd)
        got = {r["node"]: r["root"] for r in components(links).collect()}
        assert {x: got.get(x, x) for x in want} == want


def test_near_copies_by_lanes(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    data, group = [], {}
    for g in range(15):
        base = [rng.choice(words) for _ in range(rng.randint(150, 900))]
        for copy in range(1 + 50 * (g == 0) + rng.randint(0, 4)):
            w = list(base)
            for _ in range(len(w) // 120 if copy else 0):
                w[rng.randrange(len(w))] = rng.choice(words)
            group[len(data)] = g
            data.append((len(data), " ".join(w), *[None] * 7))
    found = near_copies(cases.frame(spark, data)).collect()
    first = {}
    for doc, g in group.items():
        first.setdefault(g, doc)
    assert {r["doc_id"]: r["component_id"] for r in found} == {d: first[g] for d, g in group.items()}
    kept = one_of_each(cases.frame(spark, data))
    assert kept.columns == cases.frame(spark, data).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values())


def test_near_copies_edge_cases(spark):
    kept = Counter(r["doc_id"] for r in one_of_each(cases.frame(spark)).collect())
    assert kept[None] == 2 and kept[0] == 1 and kept[1] == kept[2] == 0
    assert one_of_each(cases.frame(spark, [])).collect() == []


def shingle_set(text, k=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components_of(texts, similarity=0.8):
    sets = [shingle_set(t) for t in texts]
    return roots(range(len(texts)), lambda a, b: likeness(sets[a], sets[b]) >= similarity - 1e-12)


def found_components(spark, texts, **options):
    made = near_copies(cases.frame(spark, [(i, t, *[None] * 7) for i, t in enumerate(texts)]), **options)
    return {r["doc_id"]: r["component_id"] for r in made.collect()}


def test_near_copies_of_short_texts_all_meet(spark):
    rng, texts, close = random.Random(11), [], 0
    words = [f"w{i}" for i in range(3000)]
    while close < 120:  # pairs at 0.80 to 0.90 by one to four replaced words
        base = [rng.choice(words) for _ in range(rng.randint(9, 200))]
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.choice([-1, rng.randrange(len(copy))])] = rng.choice(words)
        if 0.8 <= likeness(shingle_set(" ".join(base)), shingle_set(" ".join(copy))) <= 0.9:
            texts += [" ".join(base), " ".join(copy)]
            close += 1
    assert found_components(spark, texts) == components_of(texts)


def test_chained_edits_in_crowded_keys(spark):
    rng, texts = random.Random(12), []
    words = [f"w{i}" for i in range(3000)]
    for length, copies in ((60, 90), (150, 60), (40, 70)):
        chain = [[rng.choice(words) for _ in range(length)]]
        while len(chain) < copies:  # each copy edits an earlier one, so the ends are far apart
            w = list(rng.choice(chain[-4:]))
            for _ in range(max(1, length // 60)):
                w[rng.randrange(length)] = rng.choice(words)
            chain.append(w)
        texts += [" ".join(w) for w in chain]
    rng.shuffle(texts)
    want = components_of(texts)
    assert 3 < len(set(want.values())) < len(texts) // 3
    for crowd in (2, 8, 1000):
        assert found_components(spark, texts, crowd=crowd) == want


def test_likeness_is_that_of_the_shingle_sets(spark):
    rng, texts, above, below = random.Random(13), [], 0, 0
    words = [f"w{i}" for i in range(3000)]
    while min(above, below) < 100:  # just above and just below 0.8
        base = [rng.choice(words) for _ in range(rng.randint(100, 400))]
        copy = list(base)
        for _ in range(rng.randint(1, 12)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        value = likeness(shingle_set(" ".join(base)), shingle_set(" ".join(copy)))
        if 0.68 <= value < 0.8 and below < 100 or 0.8 <= value < 0.83 and above < 100:
            texts += [" ".join(base), " ".join(copy)]
            above, below = above + (value >= 0.8), below + (value < 0.8)
    assert found_components(spark, texts) == components_of(texts)


def test_repeated_ids_are_judged_by_text(spark):
    rng = random.Random(14)
    a, b, c, d = ([f"w{rng.randrange(3000)}" for _ in range(120)] for _ in range(4))
    text, near = " ".join, lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, text(a)), (5, text(b)), (2, near(b)), (7, text(c)), (7, near(c)), (8, text(c)), (9, text(d)), (9, text(d))]
    kept = Counter((r["doc_id"], r["text"]) for r in one_of_each(cases.frame(spark, [(*r, *[None] * 7) for r in rows])).collect())
    assert kept[5, text(a)] == 1 and kept[5, text(b)] == 0 and kept[2, near(b)] == 1
    assert kept[7, text(c)] + kept[7, near(c)] == 1 and kept[8, text(c)] == 0
    assert kept[9, text(d)] == 1


def test_one_of_each_keeps_clashing_columns(spark):
    from pyspark.sql import functions as F

    names = ("gone", "_gone", "_text_gone", "content", "id", "row", "component_id", "many", "rows")
    docs = cases.frame(spark).select("doc_id", "text", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    made = one_of_each(docs)
    rows = made.collect()
    assert made.columns == docs.columns and all(r[c] == i for r in rows for i, c in enumerate(names))
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in one_of_each(cases.frame(spark)).collect())


def test_near_copies_are_proposed_by_simhash(spark):
    rng, texts = random.Random(15), []
    for _ in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(900)]
        texts += [" ".join(words), " ".join([*words, "end"])]
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate([*texts, "", None])], "doc_id long, text string, content long")
    prints = shingle_prefixes(frame, 5, 0.8, shingle_ranks(frame, 5)).cache()
    rows = {r["doc_id"]: r for r in prints.collect()}
    bits = lambda a, b: ((rows[a]["sim"] ^ rows[b]["sim"]) & (1 << 64) - 1).bit_count()
    near = {tuple(sorted((rows[i]["fp"], rows[i + 1]["fp"]))) for i in range(0, 60, 2) if bits(i, i + 1) <= 2}
    assert len(near) > 15
    assert {tuple(sorted((r["a"], r["b"]))) for r in simhash_pairs(prints).collect()} == near


def test_shingles_of_a_batch_take_bounded_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from notelake.llm import simhash

    class Tasks:  # runs the task function on a batch of its own
        def mapInArrow(self, make, schema):  # noqa: N802
            tracemalloc.start()
            out = pa.Table.from_batches(make(iter([batch])))
            self.peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return out

    rng = random.Random(16)
    words = [f"word{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 500))) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(range(4000), pa.int64()), pa.array(texts)], ["doc_id", "content", "text"])
    tasks = Tasks()
    rows = simhash.shingle_prefixes(tasks, 5, 0.8, np.zeros(simhash.BUCKETS, np.uint8)).to_pylist()
    assert tasks.peak < 32 << 20
    assert [r["n"] for r in rows] == [len(shingle_set(t)) for t in texts]
    for r, text in zip(rows[:50], texts, strict=False):
        hashes, _ = simhash.shingle_sets([text.encode()], 5, simhash.WordHashes())
        odd = np.bincount((hashes % np.uint64(simhash.PARITY)).astype(int), minlength=simhash.PARITY) % 2
        assert np.array_equal(np.unpackbits(np.array(r["parity"], np.int64).view(np.uint8)), odd)
