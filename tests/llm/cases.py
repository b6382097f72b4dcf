"""Small documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, lane long, length long, word string"


def rows(seed=7):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out, base, share = [], text(120), text(60)
    out += [base] * 3 + [base.upper(), base.replace(words[0], words[1])]
    for _ in range(12):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [text(30) + "\n" + share + " " + text(40) for _ in range(4)]
    out += [text(rng.randint(1, 200)) for _ in range(20)]
    out += ["", "   \n ", "one", "one two", "a " * 90, text(40) + " " + share + "\n" + share, text(6000), "x" * 5000, None]
    made = [(i, t, "en", "s", 1, 5, 6, 7, "w") for i, t in enumerate(out)]
    return [*made, (None, "null id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), made[0], made[-1]]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
