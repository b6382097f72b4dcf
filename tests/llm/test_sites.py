import random

import cases
import numpy as np
from pyspark.sql import functions as F

from notelake.llm.sites import shrunk, site_quality, spread


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def made():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8)))
    data, good = [], {}
    for i in range(600):
        host = rng.choice(["h1", "h1", "h1", "h2", "h3"])
        good[i] = rng.random() < {"h1": 0.9, "h2": 0.5, "h3": 0.1}[host]
        words = [word() + ("" if good[i] else "###") for _ in range(rng.randint(10, 50))]
        data.append((i, " ".join(words), rng.choice(["x", "y"]), host, *[None] * 5))
    return data, good


def test_posterior_follows_evidence_and_site(spark):
    data, good = made()
    docs = cases.frame(spark, [*data, (700, "", "x", "h9", *[None] * 5), (701, None, None, None, *[None] * 5), data[0]])
    labels = labelled(spark, [(i, int(y), 0) for i, y in good.items() if i % 2] + [(None, 1, 0)])
    got = site_quality(docs, labels, host=F.col("source"), path=F.concat_ws("/", "source", "lang")).collect()
    assert len(got) == len(data) + 3
    by = {r["doc_id"]: r for r in got}
    assert sum(by[i]["kept"] == y for i, y in good.items()) > 0.97 * len(good)
    site = {r["path"]: r["site_quality"] for r in got}
    assert site["h1/x"] > site["h2/x"] > site["h3/x"]
    assert by[701]["host"] == "" and all(0 <= r["score"] <= 1 for r in got)


def test_moments_match_a_direct_computation(spark):
    rng = np.random.default_rng(3)
    groups = [rng.normal(m, 0.1, n) for m, n in ((0.2, 40), (0.5, 3), (0.8, 200), (0.4, 1))]
    rows = [(len(g), float(g.mean()), float(((g - g.mean()) ** 2).sum()), 0.5) for g in groups]
    frame = spark.createDataFrame(rows, "n long, mean double, within double, center double")
    between, within = spread(frame)
    n = np.array([r[0] for r in rows])
    inside = sum(r[2] for r in rows) / (n.sum() - 4)
    q = sum(r[0] * (r[1] - 0.5) ** 2 for r in rows)
    assert np.isclose(within, inside) and np.isclose(between, (q - 3 * inside) / (n.sum() - (n**2).sum() / n.sum()))
    got = [r[0] for r in frame.select(shrunk(frame, between, within)).collect()]
    assert abs(got[3] - 0.5) < abs(rows[3][1] - 0.5) and np.isclose(got[2], rows[2][1], atol=0.01)


def test_without_labels_or_rows(spark):
    none = labelled(spark, [])
    kw = {"host": F.col("source"), "path": F.col("lang")}
    assert len(site_quality(cases.frame(spark), none, **kw).collect()) == len(cases.rows())
    assert site_quality(cases.frame(spark, []), none, **kw).collect() == []
