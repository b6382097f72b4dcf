import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from notelake.llm import query_repair
from notelake.llm.repair import Rope, damaged, grammar, product, repaired_conversations, rewritten, terminals, transfers

SCHEMA = "conv_id long, turn long, role string, text string, symbols string, part int, kind int, audit string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(symbols):
    """Least (cost, audit) per state, row by row; symbols are (initial, fault)."""
    follow = {0: 2, 1: 2, 2: 3, 3: 2}

    def closed(best):
        for _ in range(4):
            for p, (c, a) in list(best.items()):
                q, new = follow[p], (c + 3, a + "I")
                if q not in best or new < best[q]:
                    best[q] = new
        return best

    best = closed({0: (0, "")})
    for initial, fault in symbols:
        new = {}

        def offer(q, c, a, new=new):
            if q not in new or (c, a) < new[q]:
                new[q] = (c, a)

        for p, (c, a) in best.items():
            offer(p, c + 4, a + "D")
            if fault < 2:
                offer(follow[p], c + 3 + 3 * fault, a + "R")
                if initial == "s" and p == 0:
                    offer(1, c + 3 * fault, a + "K")
                if initial == "u" and p != 2:
                    offer(2, c + 3 * fault, a + "K")
                if initial == "a" and p == 2:
                    offer(3, c + 3 * fault, a + "K")
        best = closed(new)
    return min(best[p] for p in (0, 3) if p in best)


def brute(original, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in original}:
        turns = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, symbols, n = set(), [], [0, 0, 0]
        for _, _, role, text in turns:
            kind = 0 if not text.strip(SPACE) else 1 if (role, text) in seen else 2 if text.rstrip(SPACE)[-1] not in ".!?" else 3
            seen.add((role, text))
            if kind < 3:
                n[kind] += 1
            symbols.append((role[:1], 2 if kind < 2 else 1 if kind == 2 else 0))
        known = [r[1] for r in turns if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:], strict=False))
        cost, audit = cheapest(symbols)
        lines, state, at = [], 0, 0
        for x in audit:
            if x in "IR":
                state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            elif x == "K":
                state = {"s": 1, "u": 2, "a": 3}[turns[at][2][0]]
            if x != "D":
                role = turns[at][2] if x == "K" else {2: "user", 3: "assistant"}[state]
                lines.append((x, role, "" if x == "I" else turns[at][3]))
            at += x != "I"
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in lines).encode()).hexdigest()), lines
    return out


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(150):
        if rng.random() < 0.3:
            rows.append((conv, 0, "system", "Be kind."))
        for t in range(1, rng.randint(2, 9)):
            rows.append((conv, t * rng.choice([1, 1, 1, 2]), "user" if t % 2 else "assistant", rng.choice(["Yes.", "No", f"Say {rng.randrange(9)}!", "é?\n", "", " \t", "end. "])))
    rows += [(500, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["A.", "b", None, f"{t}."])) for t in range(700)]
    rows += [(501, 7, "user", "Same.")] * 300 + [(502, None, "user", "No turn."), (502, None, None, None), (None, 1, "user", "Null id."), (None, None, None, None), (None, 2, "assistant", "x" * 9000)]
    rows += [(503, None, "user", ""), (504, 5, "system", "Only."), (505, 3, "assistant", "Same turn."), (505, 3, "assistant", "Same turn too.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, "a") for r in rows], SCHEMA).repartition(5)


def as_rows(report):
    return {r["conv_id"]: tuple(r)[1:] for r in report.collect()}


def test_ropes_compare_like_strings():
    rng = random.Random(2)
    for _ in range(300):
        made = []
        for _ in range(2):
            rope, text = Rope(), ""
            for _ in range(rng.randint(1, 6)):
                part = "".join(rng.choice("DK") for _ in range(rng.randint(0, 3)))
                rope, text = (rope + Rope(part), text + part) if rng.random() < 0.5 else (Rope(part) + rope, part + text)
            made.append((rope, text))
            assert str(rope) == text
        assert (made[0][0] < made[1][0]) == (made[0][1] < made[1][1])


@pytest.mark.parametrize("seed", range(4))
def test_matrices_find_the_cheapest_edits(seed):
    rng, known = random.Random(seed), terminals()
    for _ in range(150):
        symbols = [(rng.choice("suao"), rng.randrange(3)) for _ in range(rng.randint(1, 14))]
        letters = [chr(ord("a") + 3 * "suao".index(i) + f) for i, f in symbols]
        assert product(known[x] for x in letters).finished() == cheapest(symbols)


def test_rules_change_no_result(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["dg", "dg", "adg", "f", "k"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    patterns = spark.createDataFrame([(t, 2) for t in set(texts)], "symbols string, weight long")
    rules = grammar(patterns, rounds=4, width=8)
    assert 4 <= len(rules) <= 32
    plain, made = terminals(), transfers(rules)
    for t in texts:
        short = rewritten(t, rules)
        assert len(short) < len(t) or len(t) < 4
        whole = product(made[x] for x in short)
        assert whole.finished() == product(plain[x] for x in t).finished()
        assert whole.illegal == product(plain[x] for x in t).illegal


def test_repair_matches_brute_force(spark):
    rows = conversations()
    for block in (5, 1024):
        report, listed = repaired_conversations(frame(spark, rows), block=block)
        plain = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
        want = brute(rows, plain)
        assert as_rows(report) == {k: v for k, (v, _) in want.items()}
    got = defaultdict(list)
    for r in sorted(listed.collect(), key=lambda r: r["place"]):
        got[r["conv_id"]].append((r["edit"], r["role"], r["text"]))
    assert got == {k: lines for k, (_, lines) in want.items() if lines}
    report, listed = repaired_conversations(frame(spark, []))
    assert report.collect() == [] and listed.collect() == []


def test_query_matches_brute_force(spark, tmp_path):
    rows = conversations(4) + [(c, t, "user" if t % 2 else "assistant", f"{c} {t}.") for c in range(1000, 1300) for t in range(3)] + [(2000 + c, 0, "user", "Gone.") for c in range(60)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(str, damaged(frame(spark, rows)).select("conv_id", "turn", "role", "text").collect())) == sorted(f"Row(conv_id={c!r}, turn={t!r}, role={r!r}, text={x!r})" for c, t, r, x in damage(rows))
    want = brute(rows, damage(rows))
    assert as_rows(query_repair.op13_conversation_repair(spark, str(tmp_path))) == {k: v for k, (v, _) in want.items()}
    assert any(v[0] == 0 and not v[6] for v, _ in want.values())
