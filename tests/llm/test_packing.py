import random
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from notelake.llm.packing import pack, plan_best_fit, sequence_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text, tokenizer=Tokenizer.from_file(PATH)):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_every_token_has_a_place(spark, capacity):
    docs = cases.frame(spark)
    got = [r.asDict() for r in pack(docs, PATH, capacity=capacity).collect()]
    want = Counter()
    for doc, text, *_ in cases.rows():
        ids = ids_of(text)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4").tobytes()
            want[(doc, piece, start, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def best_fit(lengths, capacity):
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [x for x in free if x >= length]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - length)
        else:
            free.append(capacity - length)
    return len(free)


@pytest.mark.parametrize("seed", range(12))
def test_counts_pack_like_single_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 300])
    lengths = [min(capacity, max(1, int(rng.expovariate(6 / capacity)))) for _ in range(rng.randint(0, 700))]
    runs = plan_best_fit(Counter(lengths), capacity)
    ranks, used = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in runs:
        ranks[length] += range(rank, rank + n)
        for i in range(n):
            used[first + i].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in Counter(lengths).items()}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == best_fit(lengths, capacity)


def test_unusual_characters(spark):
    texts = ["İSTANBUL ΣΑΣ ΟΔΟΣ don't WE'LL 12.5€", "é ́x a b c\u0085d", "<|endoftext|> x<|startoftext|>y", "ﬁ Å Å 한글 힣 １２", "a\x0bb\x0cc\x1cd\x1fe"]
    docs = cases.frame(spark, [(i, t, *[None] * 7) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["ids_crc32"] for r in pack(docs, PATH).collect()}
    assert got == {i: zlib.crc32(np.array(ids_of(t), "<u4").tobytes()) for i, t in enumerate(texts)}


def test_sequences_and_empty(spark):
    data = [r for r in cases.rows() if r[0] is not None][:-2]
    docs = cases.frame(spark, data)
    packed = pack(docs, PATH, capacity=128)
    held = {r["sequence_id"]: r["ids"] for r in sequence_ids(docs, packed, PATH).collect()}
    for r in packed.collect():
        part = held[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    assert pack(cases.frame(spark, []), PATH).collect() == []
