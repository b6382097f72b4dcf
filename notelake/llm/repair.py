"""Conversation repair: cheapest edits to alternating roles, by min-plus transfer matrices over a shared grammar.

A row becomes one of twelve letters (initial of the role, fault). Conversations are strings of letters, cut into
blocks in turn order; equal blocks are one pattern. Re-Pair replaces the pairs that are frequent over all patterns
by rules. A rule has one matrix: for each pair of automaton states the least cost and the ASCII-least audit, a rope
over the ropes of its two parts. Patterns multiply the matrices of their few symbols once, whatever the number of
conversations they stand for; the blocks of a long conversation are multiplied partition by partition, then once more.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import stored

#: Fixed values of the repair: costs, roles that an edit may give, the least initials a row can have.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
INITIALS, LEGAL = "suao", ("su", "ua", "au")
#: Letters of a block, rounds of Re-Pair and rules per round.
BLOCK, ROUNDS, RULES = 1024, 6, 48
FIRST_RULE = 0xE000
#: States: nothing yet, after a system row, after user, after assistant. What an inserted row makes of them.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {BEGIN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: A kept row leads from the states to its own.
KEPT = {"s": ((BEGIN,), SYSTEM), "u": ((BEGIN, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT), "o": ((), None)}
PRIME, RADIX = (1 << 61) - 1, 1_000_003


class Rope:
    """A string as a tree of parts; parts are shared, and equal parts are skipped by their hashes."""

    __slots__ = ("code", "left", "right", "scale", "size", "text")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.size, self.scale = len(text), pow(RADIX, len(text), PRIME)
            self.code = 0
            for x in text.encode():
                self.code = (self.code * RADIX + x) % PRIME
        else:
            self.size, self.scale = left.size + right.size, left.scale * right.scale % PRIME
            self.code = (left.code * right.scale + right.code) % PRIME

    def __add__(self, other: Rope) -> Rope:
        return self if not other.size else other if not self.size else Rope("", self, other)

    def __lt__(self, other: Rope) -> bool:
        mine, its = [self], [other]
        while mine and its:
            a, b = mine.pop(), its.pop()
            if a is b or (a.size, a.code) == (b.size, b.code):
                continue
            if a.left is not None and (a.size >= b.size or b.left is None):
                mine += [a.right, a.left]
                its.append(b)
            elif b.left is not None:
                its += [b.right, b.left]
                mine.append(a)
            else:
                n = min(a.size, b.size)
                if a.text[:n] != b.text[:n]:
                    return a.text < b.text
                if a.size > n:
                    mine.append(Rope(a.text[n:]))
                if b.size > n:
                    its.append(Rope(b.text[n:]))
        return not mine and bool(its)

    def __str__(self) -> str:
        out, open_ = [], [self]
        while open_:
            x = open_.pop()
            if x.left is None:
                out.append(x.text)
            else:
                open_ += [x.right, x.left]
        return "".join(out)


class Transfer:
    """Cheapest edits of a stretch of rows from state to state, its outer initials and its illegal neighbours."""

    def __init__(self, cells: dict, first: str = "", last: str = "", illegal: int = 0):
        self.cells, self.first, self.last, self.illegal = cells, first, last, illegal

    def __mul__(self, other: Transfer) -> Transfer:
        cells: dict = {}
        for (p, r), (cost, audit) in self.cells.items():
            for q in range(4):
                more = other.cells.get((r, q))
                if more is None:
                    continue
                total, held = cost + more[0], cells.get((p, q))
                if held is None or total <= held[0]:
                    rope = audit + more[1]
                    if held is None or total < held[0] or rope < held[1]:
                        cells[p, q] = total, rope
        seam = bool(self.last and other.first) and self.last + other.first not in LEGAL
        return Transfer(cells, self.first or other.first, other.last or self.last, self.illegal + other.illegal + seam)

    def finished(self) -> tuple[int, str]:
        """Least cost and audit from the beginning to an accepted end."""
        ends = (self * Transfer(inserts())).cells
        return min(((cost, str(audit)) for (p, q), (cost, audit) in ends.items() if p == BEGIN and q in (BEGIN, ASSISTANT)))


def inserts() -> dict:
    """Rows inserted before the next row; a state that comes back is never cheaper."""
    cells = {}
    for p in range(4):
        q, n = p, 0
        while (p, q) not in cells:
            cells[p, q] = n * INSERT, Rope("I" * n)
            q, n = NEXT[q], n + 1
    return cells


def letter(initial: str, fault: int) -> str:
    """Fault 0: none, 1: truncated, 2: has to go."""
    return chr(ord("a") + 3 * INITIALS.index(initial) + fault)


def row_transfer(initial: str, fault: int) -> Transfer:
    edits = {(r, r): (DELETE, Rope("D")) for r in range(4)}
    if fault < 2:
        edits |= {(r, q): (REROLE + CUT * fault, Rope("R")) for r, q in NEXT.items()}
        before, own = KEPT[initial]
        edits |= {(r, own): (CUT * fault, Rope("K")) for r in before}
    made = Transfer(inserts()) * Transfer(edits)
    return Transfer(made.cells, initial, initial)


def terminals() -> dict[str, Transfer]:
    return {letter(i, f): row_transfer(i, f) for i in INITIALS for f in range(3)}


def rewritten(symbols: str, rules: list[tuple[str, str]]) -> str:
    for pair, symbol in rules:
        symbols = symbols.replace(pair, symbol)
    return symbols


def grammar(patterns: DataFrame, *, rounds: int = ROUNDS, width: int = RULES) -> list[tuple[str, str]]:
    """Rules (pair of symbols, new symbol), at most rounds * width, from the pair counts of all patterns.

    A round counts pairs in the executors and takes the most frequent ones that share no symbol.
    """
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        known = list(rules)

        def pairs(batches: Iterator[pa.RecordBatch], known: list = known) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for symbols, weight in zip(batch.column("symbols").to_pylist(), batch.column("weight").to_pylist(), strict=True):
                    short = rewritten(symbols, known)
                    for pair, n in Counter(map("".join, zip(short, short[1:], strict=False))).items():
                        total[pair] += n * weight
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])

        counted = patterns.select("symbols", "weight").mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        used: set[str] = set()
        for row in counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(4 * width).collect():
            pair = row["pair"]
            if not used & set(pair) and len(rules) < len(known) + width:
                rules.append((pair, chr(FIRST_RULE + len(rules))))
                used |= set(pair)
        if len(rules) == len(known):
            break
    return rules


def transfers(rules: list[tuple[str, str]]) -> dict[str, Transfer]:
    """One matrix per symbol, bottom-up."""
    known = terminals()
    for pair, symbol in rules:
        known[symbol] = known[pair[0]] * known[pair[1]]
    return known


def product(parts: Iterator[Transfer]) -> Transfer:
    out = next(parts)
    for part in parts:
        out = out * part
    return out


CELLS = "cost array<long>, audit array<string>, first string, last string, illegal long"
DONE = "least long, edits string"


def packed(t: Transfer) -> dict:
    flat = [t.cells.get((p, q)) for p in range(4) for q in range(4)]
    least, edits = t.finished()
    return {"cost": [x and x[0] for x in flat], "audit": [x and str(x[1]) for x in flat], "first": t.first, "last": t.last, "illegal": t.illegal, "least": least, "edits": edits}


def unpacked(row: dict) -> Transfer:
    flat = [(int(c), Rope(a)) if a is not None else None for c, a in zip(row["cost"], row["audit"], strict=True)]
    return Transfer({divmod(k, 4): x for k, x in enumerate(flat) if x}, row["first"], row["last"], int(row["illegal"]))


def evaluated(patterns: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """symbols, its matrix (CELLS) and its result if it is a whole conversation (DONE)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = transfers(rules)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                symbols = batch.column("symbols").slice(begin, 256).to_pylist()
                rows = [{"symbols": s, **packed(product(known[x] for x in rewritten(s, rules)))} for s in symbols]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("symbols", pa.string()), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("least", pa.int64()), ("edits", pa.string())]))

    return patterns.select("symbols").mapInArrow(work, f"symbols string, {CELLS}, {DONE}")


def folded(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One matrix per group, multiplied in order."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(order).to_dict("records")
        made = packed(product(unpacked(r) for r in rows))
        return pd.DataFrame([{k: rows[0][k] for k in keys} | made])

    kinds = dict(parts.dtypes)
    return parts.groupBy(*keys).applyInPandas(fold, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {CELLS}, {DONE}")


def blocks(letters: DataFrame, size: int) -> DataFrame:
    """ck, part, no, symbols: the letters of each conversation in order, in blocks of at most ``size``.

    Rows are dealt by ranges of their order, so a long conversation is many partitions' work and ``part`` and
    ``no`` keep its order.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ck, no, held, out = TaskContext.get().partitionId(), None, 0, "", []

        def flush() -> None:
            nonlocal no, held
            if held:
                out.append((ck, part, no, held))
                no, held = no + 1, ""

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist([dict(zip(("ck", "part", "no", "symbols"), x, strict=True)) for x in out], schema=pa.schema([("ck", pa.string()), ("part", pa.int32()), ("no", pa.int64()), ("symbols", pa.string())]))
            out.clear()
            return made

        for batch in batches:
            for key, first, again, copies in zip(*(batch.column(c).to_pylist() for c in ("ck", "letter", "again", "copies")), strict=True):
                if key != ck:
                    flush()
                    ck, no = key, 0
                held += first
                rest = copies - 1
                while True:
                    take = min(rest, size - len(held))
                    held, rest = held + again * take, rest - take
                    if len(held) < size:
                        break
                    flush()
                    if len(out) >= 4096:
                        yield batch_of()
            yield batch_of()
        flush()
        yield batch_of()

    order = ["ck", "turn", "role", "mark"]
    dealt = letters.repartitionByRange(*order).sortWithinPartitions(*order).select("ck", "letter", "again", "copies")
    return dealt.mapInArrow(cut, "ck string, part int, no long, symbols string")


def prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, ck (never null), turn, role, text, mark of the text; a null role or text is one space."""
    ck = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    out = rows.select(F.col(conv_col).alias("conv_id"), ck.alias("ck"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))
    return out.withColumn("mark", F.md5(F.col("text").cast("binary")))


def faults(rows: DataFrame) -> DataFrame:
    """One row per different (conversation, turn, role, text): its copies, first faults and letters."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    flags = rows.select("ck", "turn", "role", "mark", (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))
    merged = stored(flags.groupBy("ck", "turn", "role", "mark", "blank", "cut").agg(F.count("*").alias("copies")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    seen = merged.groupBy("ck", "role", "mark").agg(F.min(place).alias("earliest"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    known = merged.join(seen, ["ck", "role", "mark"], "left").withColumn("late", F.coalesce(place > F.col("earliest"), F.lit(False)))
    initial = F.substring("role", 1, 1)
    place_of = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank") | F.col("late"), 2).when(F.col("cut"), 1).otherwise(0)
    sign = lambda f: F.chr((ord("a") + 3 * place_of + f).cast("long"))
    counts = {
        "blank": F.when(F.col("blank"), F.col("copies")).otherwise(0),
        "duplicate": F.when(F.col("blank"), 0).when(F.col("late"), F.col("copies")).otherwise(F.col("copies") - 1),
        "truncated": F.when(F.col("blank") | F.col("late") | ~F.col("cut"), 0).otherwise(1),
    }
    return known.select("ck", "turn", "role", "mark", "copies", sign(fault).alias("letter"), sign(F.lit(2)).alias("again"), *(x.cast("long").alias(f"n_{k}") for k, x in counts.items()))


def reports(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """ck, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows."""
    letters = stored(faults(prepared(rows, conv_col, turn_col, role_col, text_col)), "letters")
    sums = [F.sum(f"n_{k}").alias(f"n_{k}") for k in ("blank", "duplicate", "truncated")]
    by_turn = letters.groupBy("ck", "turn").agg(*sums)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    counted = by_turn.groupBy("ck").agg(gaps, *(F.sum(f"n_{k}").alias(k) for k in ("blank", "duplicate", "truncated")))
    cut = stored(blocks(letters, block), "blocks")
    patterns = stored(cut.groupBy("symbols").agg(F.count("*").alias("weight")), "patterns")
    matrices = stored(evaluated(patterns, grammar(patterns)), "matrices")
    held = cut.groupBy("ck").agg(F.count("*").alias("n"), F.first("symbols").alias("symbols"))
    whole = held.where("n = 1").join(matrices.select("symbols", "illegal", "least", "edits"), "symbols").select("ck", "illegal", "least", "edits")
    pieces = cut.join(held.where("n > 1").select("ck"), "ck", "left_semi").join(matrices, "symbols")
    long_ = folded(folded(pieces, ["ck", "part"], "no"), ["ck"], "part").select("ck", "illegal", "least", "edits")
    edits = whole.union(long_)
    return counted.join(edits, "ck").select("ck", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("least").alias("cost"), F.col("edits").alias("audit"))


def edited(audit: str) -> Iterator[tuple[str, int]]:
    """Letters of an audit, one row of the conversation at a time: the inserted rows before it, then its own edit."""
    begin = 0
    for at, x in enumerate(audit):
        if x != "I":
            yield x, at - begin
            begin = at + 1
    yield "", len(audit) - begin


def repaired_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", original: DataFrame | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The report of every conversation, and the repaired rows in order.

    Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of the repaired
    ``role:text`` joined by newlines). Repaired rows: conv_id, place, edit (K, R or I), role, text.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the MD5 of their text. Null ids are a
    conversation, a null role or text is one space. Equal rows are counted before anything is dealt by
    conversation. Conversations of ``original`` without rows have zeros, an empty audit and the hash of nothing.
    An empty table gives no rows. The hash of a conversation is one sequential value: its rows stream through one
    task in order, and only the running hash is held.
    """
    done = reports(rows, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col, block=block)
    used = prepared(rows, conv_col, turn_col, role_col, text_col)
    ids = (prepared(original, conv_col, turn_col, role_col, text_col) if original is not None else used).groupBy("ck").agg(F.first("conv_id").alias("conv_id"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    heads = stored(ids.join(done, "ck", "left").select("conv_id", "ck", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit")), "heads")
    none: list[Column] = [F.lit(None).cast("long").alias(c) for c in counts]
    turns = used.select("conv_id", "ck", F.lit(1).alias("kind"), "turn", "role", "mark", "text", *none, F.lit("").alias("audit"))
    first = heads.select("conv_id", "ck", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("mark"), F.lit("").alias("text"), *counts, "audit")
    ordered = first.union(turns).repartition("ck").sortWithinPartitions("ck", "kind", "turn", "role", "mark").drop("turn", "mark")
    kind = dict(used.dtypes)["conv_id"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """("head", batch, row) and ("row", batch, row, edit, role, text) in order."""
        key, plan, state = None, iter(()), BEGIN
        for batch in batches:
            keys, kinds, roles, texts, audits = (batch.column(c).to_pylist() for c in ("ck", "kind", "role", "text", "audit"))
            for at, (ck, kind_, role, text) in enumerate(zip(keys, kinds, roles, texts, strict=True)):
                if not kind_:
                    key, plan, state = ck, edited(audits[at]), BEGIN
                    yield "head", batch, at, "", "", ""
                    if not audits[at].strip("I"):
                        continue
                    waiting = next(plan)
                    continue
                assert key == ck
                edit, before = waiting
                for _ in range(before):
                    state = NEXT[state]
                    yield "row", batch, at, "I", ROLE[state], ""
                if edit == "R":
                    state = NEXT[state]
                    yield "row", batch, at, "R", ROLE[state], text
                elif edit == "K":
                    state = KEPT[role[0]][1]
                    yield "row", batch, at, "K", role, text
                waiting = next(plan)
                if not waiting[0]:
                    for _ in range(waiting[1]):
                        state = NEXT[state]
                        yield "row", batch, at, "I", ROLE[state], ""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *counts, "audit"]
        held, value, began = [], hashlib.sha256(), False

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches([x for x, _ in held]).combine_chunks()
            made = table.append_column("repaired_sha256", pa.array([x for _, x in held], pa.string()))
            held.clear()
            return made.to_batches()[0]

        head = None
        for what, batch, at, _, role, text in stream(batches):
            if what == "head":
                if head is not None:
                    held.append((head, value.hexdigest()))
                head, value, began = batch.slice(at, 1).select(names), hashlib.sha256(), False
                if len(held) >= 1024:
                    yield out()
                continue
            value.update((("\n" if began else "") + f"{role}:{text}").encode())
            began = True
        if head is not None:
            held.append((head, value.hexdigest()))
            yield out()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = [], 0

        def out() -> pa.RecordBatch:
            ids_ = pa.concat_arrays([x[0] for x in held])
            made = pa.RecordBatch.from_arrays([ids_, *(pa.array([x[k] for x in held], t) for k, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string()), (4, pa.string())))], ["conv_id", "place", "edit", "role", "text"])
            held.clear()
            return made

        for what, batch, at, edit, role, text in stream(batches):
            if what == "head":
                place = 0
                continue
            held.append((batch.column("conv_id").slice(at, 1), place, edit, role, text))
            place += 1
            if len(held) >= 1024:
                yield out()
        if held:
            yield out()

    report = ordered.mapInArrow(digests, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string")
    return report, ordered.mapInArrow(listed, f"conv_id {kind}, place long, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults drawn by the CRC-32 of ``conv_id:turn``: some rows go, are emptied, lose
    their sentence ends, come twice or become the user's."""
    space = F.lit(" ")
    drawn = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    out = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), drawn.alias("drawn")).where("drawn <> 0")
    text = F.when(F.col("drawn") == 1, "").when(F.col("drawn") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("drawn") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("drawn") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")
