import random
import re
from collections import Counter

import cases
import pytest
from pyspark.sql import functions as F

from notelake.llm.pii import FEATURES, boosted, find_personal_data, listed, redacted, thresholds, value

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for nr, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), nr, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def texts(n=400, seed=3):
    rng = random.Random(seed)
    bits = ["a.b@c.de", "x_%+-@a-b.c.d-e", "@", ".", "..", "a@b", "@x.y", "é", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.002.3.255", "4111 1111-1111 1111", "4111111111111112", "12", " ", "-", "+1 (415) 555-2671", "+49.30.1234567", "+", "(", "\n", "+1 ", "a@b.c_d@e.f", "0" * 15, "a@b-c@d.com", "😀", "5", "b@c.com.", "(988) 555-2485"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def data():
    return [*cases.rows(), *((1000 + i, t, *[None] * 7) for i, t in enumerate(texts())), (2000, "7" * 20000, *[None] * 7), (2001, "a" * 20000 + "." * 20000, *[None] * 7), (2002, "1.1." * 4000 + "+1-" * 3000, *[None] * 7), (2003, "q.w@e.rt, " * 300, *[None] * 7)]


def test_base_matches_the_patterns(spark, data):
    made = find_personal_data(cases.frame(spark, data)).select("doc_id", listed(F.col("base")).alias("b"), listed(F.col("spans")).alias("s")).collect()
    want = Counter((r[0], ",".join(base(r[1]))) for r in data)
    assert Counter((r["doc_id"], r["b"]) for r in made) == want
    for r in made:
        assert not Counter(filter(None, r["b"].split(","))) - Counter(filter(None, r["s"].split(",")))
    assert find_personal_data(cases.frame(spark, [])).collect() == []


def test_proposals_with_a_trusted_format_are_added(spark):
    rows = [(i, f"tel +1 (415) 555-{i:04d} or b{i}@c.de or 4111 1111 1111 1111", *[None] * 7) for i in range(40)]
    rows += [(50 + i, f"no 4111 1111 1111 {1112 + i}", *[None] * 7) for i in range(7)]
    rows += [(100, "call (988) 555-2485 now", *[None] * 7), (101, "me (at) home [dot] org", *[None] * 7), (102, "number 4111.1111.1111.1111 and 4111.1111.1111.1112", *[None] * 7)]
    made = {r["doc_id"]: r["s"] for r in find_personal_data(cases.frame(spark, rows)).select("doc_id", listed(F.col("spans")).alias("s")).collect()}
    assert made[100] == "phone:5:19" and made[101] == "email:0:22" and made[102] == "card:7:26"


def test_redaction_keeps_rows_and_columns(spark, data):
    docs = cases.frame(spark, data)
    out = redacted(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    assert len(rows) == len({r[0] for r in data if r[0] is not None})
    for doc, text, *_ in data:
        if doc is not None and doc < 1000:
            assert rows[doc] == text
    assert rows[2003] == "[EMAIL], " * 300


def test_plan_has_no_python(spark):
    plan = find_personal_data(cases.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_trees_learn_counts():
    counts = [(1 | 1 << 8, 50, 49), (1, 80, 2), (2, 30, 15)]
    trees = boosted(counts)
    score = [sum(value(t, c[0]) for t in trees) for c in counts]
    assert score[0] > score[2] > score[1]
    limits = thresholds(counts, trees, 0.9)
    assert score[1] < limits[0] <= score[0] and limits[1] == float("inf") and len(FEATURES) == 15
    assert boosted([]) == []


def test_phones_with_far_digits_are_base_spans(spark):
    rows = [(i, "call +" + gap.join("1234567890") + " now", *[None] * 7) for i, gap in enumerate(("......", " " * 9, "-" * 7, "(.) -.", "-"))]
    made = {r["doc_id"]: r["b"] for r in find_personal_data(cases.frame(spark, rows)).select("doc_id", listed(F.col("base")).alias("b")).collect()}
    assert made == {i: ",".join(base(t)) for i, t, *_ in rows} and all(x.startswith("phone:5:") for x in made.values())


def test_unproven_digit_runs_stay(spark):
    rows = [(i, f"tel +1 (415) 555-{i:04d} today", *[None] * 7) for i in range(60)]
    rows += [(100 + i, f"value 000768719910195{i % 10} in prose, number 00{i:014d}", *[None] * 7) for i in range(20)]
    rows += [(200, "call (988) 555-2485 now", *[None] * 7)]
    made = {r["doc_id"]: r["s"] for r in find_personal_data(cases.frame(spark, rows)).select("doc_id", listed(F.col("spans")).alias("s")).collect()}
    assert all("phone" not in made[100 + i] for i in range(20)) and made[200] == "phone:5:19"
    clean = {r["doc_id"]: r["text"] for r in redacted(cases.frame(spark, rows)).collect()}
    assert not any("[PHONE]" in clean[100 + i] for i in range(20)) and clean[200] == "call [PHONE] now"


def test_a_bad_tail_ends_the_search():
    counts = [(1 | 1 << 8, 200, 200), (1 | 1 << 9, 4, 0), (1 | 1 << 10, 12, 12)]
    trees = [(8, (9, 1.0, 2.0), 3.0)]
    limits = thresholds(counts, trees, 0.9)
    assert 2.0 < limits[0] <= 3.0


def test_additions_find_planted_obfuscations(spark):
    rng = random.Random(8)
    plain = [f"write to {rng.choice('abcdefg')}{i}.x@mail{i % 7}.org or call +1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{i:04d} soon" for i in range(150)]
    hidden = [(f"write to b{i}.y (at) mail{i % 5} [dot] org now", "email") for i in range(40)] + [(f"please call ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{i:04d} now", "phone") for i in range(40)]
    rows = [(i, t, *[None] * 7) for i, t in enumerate([*plain, *(t for t, _ in hidden)])]
    made = {r["doc_id"]: r["s"] for r in find_personal_data(cases.frame(spark, rows)).select("doc_id", listed(F.col("spans")).alias("s")).collect()}
    found = sum(kind in made[150 + i] for i, (_, kind) in enumerate(hidden))
    assert found >= 0.9 * len(hidden)


def test_clashing_columns_keep_their_values(spark):
    names = ("_b0", "_l1", "_base", "_loose", "_row", "_text", "_added", "bits", "fit")
    docs = cases.frame(spark, [(1, "mail a@b.de", *[None] * 7), (2, None, *[None] * 7)]).select("doc_id", "text", *(F.lit(7 + i).alias(c) for i, c in enumerate(names)))
    for made in (find_personal_data(docs).drop("base", "spans"), redacted(docs)):
        rows = made.collect()
        assert made.columns == docs.columns and len(rows) == 2 and all(r[c] == 7 + i for r in rows for i, c in enumerate(names))
