"""Personal data: generators propose spans, boosted trees and calibrated thresholds choose among them.

All expressions are DataFrame functions. Base spans follow fixed patterns and checks and always stay. Loose
generators propose further spans of the same kinds. A proposal that overlaps a base span of its kind is a
positive example; one that overlaps a match of its kind that failed its check, or lies in a long run of digits
that failed Luhn's, is a negative one; the others are no examples. Examples are counted by their format and context features over the whole table (the
features are yes or no, so there are few combinations). Gradient-boosted trees are fitted to the counts of two
thirds of the texts; on the others a threshold per kind is set where the precision stops to hold, group by group.
Proposals have to pass the checks of their kind as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. Possessive runs, and look-behinds that start a run once, keep them linear in the text;
#: \\G lets a match begin where the last one ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators with high recall, which may overlap the base and each other.
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|,)[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20._/-]?[0-9]{4}){2}[\x20._/-]?[0-9]{2,4}(?![0-9])"),
    ("phone", r"(?<![0-9])\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20./-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9])00[0-9](?:[\x20.-]?[0-9]){8,13}(?![0-9])"),
)
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
FOUND = "array<struct<start: int, end: int, match: string, before: string, after: string>>"


def found(text: Column, pattern: str, use: Column) -> Column:
    """All matches with their code point offsets and surroundings. Offsets add up the pieces between the matches."""
    pieces = F.split(text, pattern, -1)
    # Outside the lambda, where the pieces are made once for a text.
    steps = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), pieces.alias("before"), F.slice(pieces, 2, 1 << 30).alias("after")), lambda x: x["match"].isNotNull())

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["before"])
        end = start + F.char_length(x["match"])
        one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), F.right(x["before"], F.lit(24)).alias("before"), F.left(x["after"], F.lit(8)).alias("after"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))
    return F.when(use, F.aggregate(steps, start, step, lambda s: s["out"])).otherwise(F.array().cast(FOUND))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of 1 to 19 digits has the right check digit."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(number, i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(digit)

    return F.when(n.between(1, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def octets(match: Column) -> Column:
    return match.rlike(rf"^{OCTET}(?:[^0-9]+{OCTET}){{3}}$")


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": octets,
    "card": lambda m: F.when(F.length(digits(m)).between(14, 19), luhn(digits(m))).otherwise(F.lit(False)),
    "phone": lambda m: F.length(digits(m)).between(10, 15),
}


#: What a proposal has to pass where it differs: of mail addresses, only spelled-out separators add anything to the base.
PROPER: dict[str, Callable[[Column], Column]] = {"email": lambda m: m.rlike(r"[(\[](?:at|dot)[)\]]")}


def features(kind: str, x: Column) -> dict[str, Column]:
    """Format and context of a proposal, yes or no."""
    number = digits(x["match"])
    n = F.length(number)
    return {
        **{f"is_{k}": F.lit(k == kind) for k in KINDS},
        "digits_9": n >= 9, "digits_11": n >= 11, "digits_14": n >= 14, "digits_16": n >= 16,
        "luhn": luhn(number) if kind == "card" else F.lit(False),
        "octets": octets(x["match"]) if kind == "ip" else F.lit(False),
        "short_end": x["match"].rlike("[.)\\]]\\x20?[A-Za-z]{2,6}$"),
        # A spelled-out separator of a mail address or an IP says nothing about the address.
        "bracket": x["match"].contains("(") if kind == "phone" else F.lit(False),
        "word_before": x["before"].rlike("[\\p{L}\\p{N}_]$"),
        "word_after": x["after"].rlike("^[\\p{L}\\p{N}_]"),
        "cue": F.lower(x["before"]).rlike("(?:mail|tel|phone|call|fax|card|host|server|contact|ip)[^a-z]{0,4}$"),
    }


FEATURES = (*(f"is_{k}" for k in KINDS), "digits_9", "digits_11", "digits_14", "digits_16", "luhn", "octets", "short_end", "bracket", "word_before", "word_after", "cue")


def _apart(a: Column, b: Column) -> Column:
    return (a["end"] <= b["start"]) | (b["end"] <= a["start"])


def proposed(docs: DataFrame, text: str) -> DataFrame:
    """docs with ``_base`` (start, kind number, end) and ``_loose`` (with the bits of the features, ``known``, ``wrong`` and ``free``)."""
    t = F.col(text)
    number, at = t.rlike("[0-9].{0,5}[0-9]"), t.rlike("@|\\(at\\)|\\[at\\]")
    use = {"email": at, "ip": number, "card": number, "phone": number}
    made = docs.select("*", *(found(t, BASE[k], t.rlike("\\+[0-9]") if k == "phone" else use[k]).alias(f"_b{i}") for i, k in enumerate(KINDS)), *(found(t, p, use[k]).alias(f"_l{i}") for i, (k, p) in enumerate(LOOSE)))

    def checked(i: int, kind: str) -> Column:
        return F.transform(F.col(f"_b{i}"), lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"), VALID[kind](x["match"]).alias("ok"), (F.length(digits(x["match"])) >= 14).alias("long")))

    loose = [f"_l{i}" for i in range(len(LOOSE))]
    made = made.select(*docs.columns, F.array_sort(F.concat(*(checked(i, k) for i, k in enumerate(KINDS)))).alias("_checked"), *loose)
    kept = F.transform(F.filter("_checked", lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    made = made.select(*docs.columns, kept.alias("_base"), F.filter("_checked", lambda x: ~x["ok"]).alias("_failed"), *loose)

    def described(i: int, kind: str) -> Column:
        nr = KINDS.index(kind)

        def one(x: Column) -> Column:
            bits = F.lit(0)
            for bit, value in enumerate(features(kind, x).values()):
                bits = bits.bitwiseOR(F.when(value, F.lit(1 << bit)).otherwise(F.lit(0)))
            near = F.filter(F.col("_base"), lambda b: ~_apart(b, x))
            inside = lambda b: (b["kind"] == KINDS.index("card")) & b["long"] & (b["start"] <= x["start"]) & (x["end"] <= b["end"])
            wrong = F.exists("_failed", lambda b: ~_apart(b, x) & ((b["kind"] == nr) | inside(b)))
            return F.struct(x["start"].alias("start"), F.lit(nr).alias("kind"), x["end"].alias("end"), bits.alias("bits"), F.exists(near, lambda b: b["kind"] == nr).alias("known"), wrong.alias("wrong"), ((F.size(near) == 0) & PROPER.get(kind, VALID[kind])(x["match"])).alias("free"))

        return F.transform(F.col(f"_l{i}"), one)

    return made.select(*docs.columns, "_base", F.array_distinct(F.concat(*(described(i, k) for i, (k, _) in enumerate(LOOSE)))).alias("_loose"))


Tree = float | tuple[int, "Tree", "Tree"]


def boosted(counts: list[tuple[int, int, int]], *, rounds: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> list[Tree]:
    """Trees fitted to (feature bits, examples, positives) by Newton steps on the logistic loss."""
    margin = [0.0] * len(counts)
    trees: list[Tree] = []

    def grow(rows: list[int], left: int, grad: list[float], hess: list[float]) -> Tree:
        g, h = sum(grad[r] for r in rows), sum(hess[r] for r in rows)
        best = (1e-6, None)
        for bit in range(len(FEATURES) if left else 0):
            yes = [r for r in rows if counts[r][0] >> bit & 1]
            if yes and len(yes) < len(rows):
                gy, hy = sum(grad[r] for r in yes), sum(hess[r] for r in yes)
                gain = gy * gy / (hy + ridge) + (g - gy) ** 2 / (h - hy + ridge) - g * g / (h + ridge)
                best = max(best, (gain, bit), key=lambda x: x[0])
        if best[1] is None:
            return rate * g / (h + ridge)
        bit = best[1]
        return bit, grow([r for r in rows if not counts[r][0] >> bit & 1], left - 1, grad, hess), grow([r for r in rows if counts[r][0] >> bit & 1], left - 1, grad, hess)

    for _ in range(rounds if counts else 0):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        tree = grow(list(range(len(counts))), depth, [k - n * q for (_, n, k), q in zip(counts, p, strict=True)], [n * q * (1 - q) for (_, n, _), q in zip(counts, p, strict=True)])
        trees.append(tree)
        margin = [m + value(tree, c[0]) for m, c in zip(margin, counts, strict=True)]
    return trees


def value(tree: Tree, bits: int) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if bits >> tree[0] & 1 else tree[1]
    return tree


#: Examples that a step of the threshold is judged by, at least, and those that the last one may have.
STEP_ROWS, LAST_ROWS = 8, 3


def thresholds(counts: list[tuple[int, int, int]], trees: list[Tree], precision: float) -> list[float]:
    """For each kind the least score at and above which the precision holds in every step; infinite if nowhere.

    Scores are taken from the highest down, in steps of STEP_ROWS examples or more. The first step in which the
    precision does not hold ends the search, however good the steps above it are.
    """
    out = []
    for kind in range(len(KINDS)):
        groups: dict[float, list[int]] = {}
        for b, n, k in counts:
            if b >> kind & 1:
                held = groups.setdefault(sum(value(t, b) for t in trees), [0, 0])
                held[0], held[1] = held[0] + n, held[1] + k
        rows = sorted(groups.items(), reverse=True)
        best, n, hits = math.inf, 0, 0
        for i, (score_, (m, k)) in enumerate(rows):
            n, hits = n + m, hits + k
            if n < STEP_ROWS and i + 1 < len(rows) or n < LAST_ROWS:
                continue
            if hits < precision * n:
                break
            best, n, hits = score_ - 1e-9, 0, 0
        out.append(best)
    return out


def score(trees: list[Tree], bits: Column) -> Column:
    def column(tree: Tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        return F.when(bits.bitwiseAND(F.lit(1 << tree[0])) != 0, column(tree[2])).otherwise(column(tree[1]))

    out = F.lit(0.0)
    for tree in trees:
        out = out + column(tree)
    return out


def find_personal_data(docs: DataFrame, *, precision: float = 0.9, text_col: str = "text") -> DataFrame:
    """docs with ``base`` and ``spans``: arrays of (start, kind, end, name) by start, then kind; ends are exclusive.

    Base spans are all in ``spans``; added ones overlap no base span. Null and empty texts have none. Columns
    of the same names as the added ones are replaced, all others keep their names. A kind without enough examples
    adds nothing. Texts are dealt to fitting and calibration by a hash, so copies of a text are on one side.
    """
    keep = [c for c in docs.columns if c not in ("base", "spans")]
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    made = proposed(given, "_text")
    fitted = F.pmod(F.xxhash64("_text"), F.lit(3)) < 2
    seen = made.select(fitted.alias("fit"), F.explode("_loose").alias("x")).groupBy("fit", "x.bits").agg(F.count_if(F.col("x.known") | F.col("x.wrong")).alias("n"), F.count_if("x.known").alias("hits")).where("n > 0")
    rows = sorted((r["fit"], r["bits"], r["n"], r["hits"]) for r in seen.collect())  # at most two rows per combination of features
    trees = boosted([r[1:] for r in rows if r[0]])
    limits = thresholds([r[1:] for r in rows if not r[0]], trees, precision)
    least = F.array(*(F.lit(x) for x in limits))
    named = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1).alias("name"))
    added = F.filter(F.col("_loose"), lambda x: x["free"] & (score(trees, x["bits"]) >= F.get(least, x["kind"])))
    made = made.select("_row", F.transform("_base", named).alias("base"), F.transform(added, named).alias("_added"))
    spans = F.when(F.size("_added") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "_added")))
    return made.select("_row.*", "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"], x["end"])), ",")


def redacted(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with every span of the text replaced by its kind in brackets; a null text stays null."""
    given = F.coalesce("_given", F.lit(""))

    def step(state: Column, x: Column) -> Column:
        piece = F.concat(F.substr(given, state["at"] + 1, x["start"] - state["at"]), F.lit("["), F.upper(x["name"]), F.lit("]"))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.concat(state["out"], F.when(x["start"] >= state["at"], piece).otherwise(F.lit(""))).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substr(given, s["at"] + 1, F.char_length("_given"))))
    made = find_personal_data(docs.select(F.struct("*").alias("_all"), F.col(text_col).alias("_given")), text_col="_given")
    new = F.when(F.col("_given").isNull() | (F.size("spans") == 0), F.col("_given")).otherwise(clean)
    return made.select(*((new.alias(c) if c == text_col else F.col(f"_all.`{c}`")) for c in docs.columns))
