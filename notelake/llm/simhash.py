"""SimHash near copies: fingerprints of word shingles, pigeonhole blocks, Hamming verification, components.

Fingerprints that differ in at most ``radius`` of 64 bits agree on two whole blocks of ``radius + 2``:
every pair of blocks is a join key of about 64 / (radius + 2) * 2 bits. A key that more than
``crowd`` different fingerprints share is not paired: its fingerprints meet on their one-bit variants
instead, which link exactly the pairs within two bits and make a bounded number of rows each.

Looser likeness (``near_copies``) is that of the shingle sets themselves. Sets whose SimHashes are close are proposed
as above. For the rest, in one order of all shingles, rare ones first, two like sets share one of their first shingles.
Pairs of either kind are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import WordHashes, hashed_words, mixed, owner, raw_texts, slices, stored, sums_by_text, text_of, window_hashes
from notelake.llm.graph import components

SEED, BASE = 42, 0x9E3779B97F4A7C15
#: Hash buckets of shingle counts and of picked texts, and the parts that counts are added in.
BUCKETS, PARTS = 1 << 20, 256
#: Bits that bound from below how much two shingle sets differ.
PARITY = 512
#: Leaders of a crowded key, each the least of one part of its sets.
LEADERS = 16
#: Text bytes whose shingles a task holds at once; a shingle takes many times the bytes of its words.
SHINGLE_BYTES = 1 << 20


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of k lower-cased words (of all words, if fewer), and where each text begins."""
    found, counts = [], []
    for text in texts:
        words = text.lower().split()
        line = b" ".join(words)
        ends = np.cumsum([len(x) + 1 for x in words]) - 1
        last = ends[min(k, len(words)) - 1 :].tolist() if words else []
        first = [0, *(ends[: len(last) - 1] + 1).tolist()] if last else []
        counts.append(len(last))
        found.extend([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(first, last, strict=True)])
    return np.array(found, np.uint64), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def simhashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bit i of a text is 1 if it is 1 in over half of the text's hashes."""
    out, n = np.zeros(len(starts) - 1, np.uint64), np.diff(starts)
    full = np.flatnonzero(n)
    if len(full):
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for octet in range(8):
            bits = np.unpackbits(octets[:, octet : octet + 1], axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int32)
            set_ = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little")[:, 0]
            out[full] |= set_.astype(np.uint64) << np.uint64(8 * octet)
    return out


def fingerprints(docs: DataFrame, *, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long). A text without words (null, empty) has fingerprint zero."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = simhashes(*shingle_hashes(raw_texts(batch), k))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "fp"])

    return text_of(docs, id_col=id_col, text_col=text_col).mapInArrow(make, "doc_id long, fp long")


def close_fingerprints(prints: DataFrame, *, radius: int = 2, crowd: int = 64) -> DataFrame:
    """Links (a, b) between the different fingerprints ``fp`` within ``radius`` bits (1 or 2).

    Of a crowded key, links within one bit are all there; within two they lead to the smallest fingerprint that
    shares a variant: no component is lost.
    """
    if radius not in (1, 2):
        raise ValueError("one-bit variants reach one or two bits")
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [a | b for a, b in combinations(blocks, 2)]
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x)
    keys = F.array(*(F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(signed(m)).alias("bits")) for i, m in enumerate(masks)))
    dealt = prints.select("fp").distinct().select("fp", F.explode(keys).alias("key")).select("fp", "key.*")
    held = dealt.groupBy("block", "bits").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(dealt.join(held, ["block", "bits"]), "blocks")
    few = shared.where(F.col("n") <= crowd)
    pairs = few.select("block", "bits", F.col("fp").alias("a")).join(few.select("block", "bits", F.col("fp").alias("b")), ["block", "bits"]).where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    flips = F.array(F.lit(0).cast("long"), *(signed(1 << i) for i in range(64)))
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    variants = crowded.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("variant"))
    if radius == 1:  # a variant that is a fingerprint itself is the link
        ends = crowded.select(F.col("fp").alias("b"))
        met = variants.join(ends, F.col("variant") == F.col("b")).where("fp > b")
    else:
        met = variants.join(variants.groupBy("variant").agg(F.min("fp").alias("b")), "variant").where((F.col("fp") != F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius))
    return pairs.select("a", "b").union(met.select(F.col("fp").alias("a"), "b")).distinct()


def with_components(prints: DataFrame, links: DataFrame) -> DataFrame:
    """prints (doc_id, fp) with component_id, the smallest doc_id of all fingerprints that the links connect."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    nodes = components(links)
    roots = first.join(nodes, first["fp"] == nodes["node"], "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return prints.join(roots.join(least, "root").select("fp", "component_id"), "fp")


def simhash_components(docs: DataFrame, *, k: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included).

    Null and empty texts share fingerprint zero and link like others; repeated rows stay; a component of
    null ids only has a null id. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, k=k, id_col=id_col, text_col=text_col), "prints")
    out = with_components(prints, close_fingerprints(prints, radius=radius))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: list[bytes], k: int, table: WordHashes, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of the runs of k lower-cased words (of all words, if fewer) of each text, and their text.

    The hashes of a text are ordered by the rank of their bucket, then by value.
    """
    words = [text.lower().split() for text in texts]
    hashed, starts = hashed_words([x + [b" "] * (k - len(x)) if 0 < len(x) < k else x for x in words], table)
    hashes, own = window_hashes(hashed, k, BASE), owner(starts)
    inside = own[: len(hashes)] == own[k - 1 :]
    hashes, own = hashes[inside], own[: len(hashes)][inside]
    order = np.lexsort((hashes, own)) if ranks is None else np.lexsort((hashes, ranks[bucket(hashes)], own))
    hashes, own = hashes[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], own[new]


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def parities(hashes: np.ndarray, own: np.ndarray, rows: int) -> np.ndarray:
    """Per text PARITY bits, each set if an odd number of the text's hashes fall on it; 1024 texts at a time."""
    out, place = np.zeros((rows, PARITY // 64), np.int64), own * PARITY + (hashes % np.uint64(PARITY)).astype(np.int64)
    for begin in range(0, rows, 1024):
        n = min(1024, rows - begin)
        some = place[slice(*np.searchsorted(own, [begin, begin + n]))] - begin * PARITY
        out[begin : begin + n] = np.packbits((np.bincount(some, minlength=n * PARITY) & 1).astype(np.uint8)).view(np.int64).reshape(n, -1)
    return out


def shingle_ranks(texts: DataFrame, k: int) -> np.ndarray:
    """How frequent the shingles of each of 2**20 hash buckets are, as eighths of a power of two.

    Any order of the shingles finds the same pairs; this one keeps passages of many texts out of the keys.
    """
    width = BUCKETS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, table = np.zeros(BUCKETS, np.int64), WordHashes()
        for batch in slices(batches, SHINGLE_BYTES):
            total += np.bincount(bucket(shingle_sets(raw_texts(batch), k, table)[0]), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in total.reshape(PARTS, width)])], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        rank = [np.minimum(8 * np.log2(1 + x), 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rank, pa.binary())], ["part", "ranks"])

    out = np.zeros((PARTS, width), np.uint8)
    made = texts.mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, ranks binary")
    for row in made.collect():  # PARTS rows
        out[row["part"]] = np.frombuffer(bytes(row["ranks"]), np.uint8)
    return out.reshape(-1)


def shingle_prefixes(texts: DataFrame, k: int, similarity: float, ranks: np.ndarray) -> DataFrame:
    """doc_id, content, fp (hash of the text's shingle set, zero if empty), sim (its SimHash), n (its size), keys (its first shingles), parity.

    Bit i of ``parity`` says whether an odd number of the shingles fall on i; where two texts differ in
    x bits, at least x shingles are in one of the sets only.

    Two sets of likeness s share at least s * n of the n shingles of either, so one of the first
    n - ceil(s * n) + 1 shingles of both, in any order that is the same for all texts.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in slices(batches, SHINGLE_BYTES):
            hashes, own = shingle_sets(raw_texts(batch), k, table, ranks)
            n = np.bincount(own, minlength=batch.num_rows)
            starts = np.concatenate([[0], np.cumsum(n)])
            fp = mixed(sums_by_text(mixed(hashes + np.uint64(SEED)), starts) + n.astype(np.uint64))
            first = np.where(n, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
            keys = hashes[np.arange(len(own)) - starts[own] < first[own]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first)]).astype(np.int32)), pa.array(keys.view(np.int64)))
            odd = parities(hashes, own, batch.num_rows).reshape(-1)
            parity = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (PARITY // 64)), pa.array(odd))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(fp.view(np.int64)), pa.array(simhashes(hashes, starts).view(np.int64)), pa.array(n.astype(np.int32)), lists, parity], ["doc_id", "content", "fp", "sim", "n", "keys", "parity"])

    return texts.mapInArrow(make, "doc_id long, content long, fp long, sim long, n int, keys array<long>, parity array<long>")


def met_pairs(left: DataFrame, right: DataFrame, similarity: float, use: Column) -> DataFrame:
    """Pairs (a, b) of fingerprints that share a key whose places leave room for the likeness."""
    a, b = (x.select("key", *(F.col(c).alias(f"{c}_{side}") for c in x.columns if c != "key")) for x, side in ((left, "a"), (right, "b")))
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = room >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6
    return a.join(b, "key").where(use & fits).select(F.greatest("fp_a", "fp_b").alias("a"), F.least("fp_a", "fp_b").alias("b")).distinct()


def simhash_pairs(prints: DataFrame, *, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of different sets ``fp`` whose SimHashes ``sim`` are linked: of each SimHash, every set with the least one,
    and the least ones of SimHashes within ``radius`` bits."""
    sets = stored(prints.where("fp <> 0").select("fp", "sim").distinct(), "sims")
    least = sets.groupBy("sim").agg(F.min("fp").alias("first"))
    same = sets.join(least, "sim").where("fp > first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    links = close_fingerprints(sets.select(F.col("sim").alias("fp")), radius=radius)
    ends = [least.select(F.col("sim").alias(x), F.col("first").alias(f"first_{x}")) for x in ("a", "b")]
    close = links.join(ends[0], "a").join(ends[1], "b").where("first_a <> first_b")
    return same.union(close.select(F.greatest("first_a", "first_b").alias("a"), F.least("first_a", "first_b").alias("b")))


def alike(pairs: DataFrame, texts: DataFrame, prints: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard likeness of ``similarity`` or more.

    Sets are made again, for one text of a fingerprint. The texts are picked by a bit map of fixed size
    over their ids, the join on the fingerprints does the rest.
    """
    pairs = stored(pairs, "pairs")
    wanted = stored(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), "wanted")
    slot = F.xxhash64("doc_id").bitwiseAND(F.lit(BUCKETS - 1)).alias("slot")
    one = prints.select("doc_id", "fp").join(wanted, "fp").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    picked = np.zeros(BUCKETS, bool)
    picked[one.select(slot).distinct().toArrow().column("slot").to_numpy()] = True  # at most BUCKETS rows
    held = np.packbits(picked)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, use = WordHashes(), np.unpackbits(held).astype(bool)
        for batch in batches:
            for some in slices([batch.filter(pa.array(use[batch.column("slot").to_numpy()]))], SHINGLE_BYTES):
                hashes, own = shingle_sets(raw_texts(some), k, table)
                n = np.bincount(own, minlength=some.num_rows)
                starts = np.concatenate([[0], np.cumsum(n)])
                fp = mixed(sums_by_text(mixed(hashes + np.uint64(SEED)), starts) + n.astype(np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), lists], ["fp", "set"])

    sets = texts.select("text", slot).mapInArrow(make, "fp long, set array<long>")
    sets = stored(sets.join(wanted, "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("fp").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return stored(both.where(shared >= similarity * (F.size("set_a") + F.size("set_b") - shared) - 1e-6).select("a", "b"), "alike")


def near_copies(docs: DataFrame, *, k: int = 5, similarity: float = 0.8, crowd: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content (hash of the text), fp, component_id of documents whose sets of k-word shingles have a Jaccard likeness of ``similarity`` or more.

    Equal sets are one class (``fp`` is their hash), found without links. Different sets are proposed by close
    SimHashes, and all others meet on the first shingles of either; every pair is checked on the sets. A key of more than ``crowd`` sets
    first links them to a few leaders, in three rounds; then members of different components meet, those
    outside the key's largest component with all others, unless their parities show that they differ too much. Pairs left out are in one component already, so the components are
    those of all pairs. Null and empty texts have no shingle, share fingerprint zero and are one class.
    """
    texts = text_of(docs, id_col=id_col, text_col=text_col).withColumn("content", F.xxhash64("text"))
    prints = stored(shingle_prefixes(texts, k, similarity, shingle_ranks(texts, k)), "prints")
    dealt = prints.dropDuplicates(["fp"]).select("fp", "n", F.posexplode("keys").alias("at", "key"))
    held = dealt.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = stored(dealt.join(held, "key"), "shared")
    few, many = (shared.where(x).drop("members") for x in (F.col("members") <= crowd, F.col("members") > crowd))
    pairs = simhash_pairs(prints).union(met_pairs(few, few, similarity, F.col("fp_a") > F.col("fp_b"))).distinct()
    if many.isEmpty():
        return with_components(prints.select("doc_id", "content", "fp"), alike(pairs, texts, prints, k, similarity))
    words = [F.col("parity")[i].alias(f"p{i}") for i in range(PARITY // 64)]
    parities = prints.join(many.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]).select("fp", *words)
    many = stored(many.join(parities, "fp"), "many")
    differ = sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(len(words))), F.lit(0))
    close = differ <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6

    def leaders(members: DataFrame, salt: int) -> DataFrame:
        order, rest = F.xxhash64("fp", F.lit(salt)), [c for c in members.columns if c != "key"]
        least = members.groupBy("key", F.pmod(order, F.lit(LEADERS)).alias("place")).agg(F.min_by(F.struct(*rest), order).alias("x"))
        return least.select("key", "x.*")

    pairs = pairs.union(met_pairs(many, leaders(many, 0), similarity, (F.col("fp_a") != F.col("fp_b")) & close)).distinct()
    links = alike(pairs, texts, prints, k, similarity)
    for salt in (1, 2, None):
        nodes = components(links)
        rooted = stored(many.join(nodes, many["fp"] == nodes["node"], "left").select(*many.columns, F.coalesce("root", "fp").alias("root")), "rooted")
        main = rooted.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
        apart = stored(rooted.join(main, "key"), "apart")
        other = (F.col("root_a") != F.col("root_b")) & close
        if salt is None:
            pairs = met_pairs(apart.where("root <> main"), apart, similarity, other & ((F.col("root_b") == F.col("main_b")) | (F.col("fp_a") > F.col("fp_b"))))
        else:
            pairs = met_pairs(apart.where("root <> main"), leaders(apart, salt), similarity, other)
        links = links.union(alike(pairs, texts, prints, k, similarity))
    return with_components(prints.select("doc_id", "content", "fp"), links)


def one_of_each(docs: DataFrame, *, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: of its smallest id, and of that id's texts the one of the least hash.

    Rows are told apart by id and text, so an id that is repeated with another text is judged for each text.
    Of repeated rows of the same id and text one stays. Rows with a null id stay. Columns keep their names and values.
    """
    found = stored(near_copies(docs, k=k, similarity=similarity, id_col=id_col, text_col=text_col), "found")
    first = found.where(F.col("doc_id") == F.col("component_id")).groupBy("component_id").agg(F.min("content").alias("first"))
    other = found.join(first, "component_id").where((F.col("doc_id") != F.col("component_id")) | (F.col("content") != F.col("first")))
    gone = other.select(F.col("doc_id").alias("gone"), F.col("content").alias("gone_text")).distinct()
    several = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("many"), F.col("content").alias("many_text")).agg(F.count("*").alias("rows")).where("rows > 1").drop("rows")
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("content"))
    left = given.join(gone, (F.col("id") == F.col("gone")) & (F.col("content") == F.col("gone_text")), "left_anti")
    repeated = (F.col("id") == F.col("many")) & (F.col("content") == F.col("many_text"))
    # Only repeated rows are grouped, and each task merges its own first.
    one = left.join(several, repeated, "left_semi").groupBy("id", "content").agg(F.first("row").alias("row"))
    return left.join(several, repeated, "left_anti").select("row.*").union(one.select("row.*"))
