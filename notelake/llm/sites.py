"""Document quality by hierarchical empirical Bayes over hosts and paths.

A logistic classifier over text statistics gives each document's evidence. Mean evidence is grouped by path
and host; the spread between sites beyond what sampling explains, estimated by moments, decides how far a
site's mean is trusted: a host is shrunk toward the global mean, a path toward its host. A document's
posterior log odds are its own evidence plus what its site adds to the global mean.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import stored
from notelake.llm.rules import MAX_ROWS, features, labelled_rows, with_counts


def learn_classifier(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = MAX_ROWS) -> tuple[list[float], float]:
    """Weights and offset of a ridge logistic regression on the features; zeros without labelled rows."""
    x, y = labelled_rows(docs, labels, label, max_rows=max_rows)
    if not len(y):
        return [0.0] * x.shape[1], 0.0
    x[:, 0] = np.log1p(x[:, 0])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, z.T @ (y - p) - 0.5 * w), -2, 2)
    weights = w[:-1] / scale
    return [float(v) for v in weights], float(w[-1] - mean @ weights)


def log_odds(p: Column) -> Column:
    held = F.greatest(F.least(p, F.lit(1 - 1e-4)), F.lit(1e-4))
    return F.log(held / (1 - held))


def spread(groups: DataFrame) -> tuple[float, float]:
    """Variance between sites and within them, from (n, mean, within: sum of squares around the mean, center)."""
    r = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"), F.sum("within").alias("w"), F.sum(F.col("n") * (F.col("mean") - F.col("center")) ** 2).alias("q")).first()
    k, n = r["k"], r["n"] or 0
    if n <= k or k < 2:
        return 0.0, 1.0
    inside = max(r["w"], 0.0) / (n - k)
    return max(0.0, (r["q"] - (k - 1) * inside) / (n - r["nn"] / n)), max(inside, 1e-9)


def shrunk(groups: DataFrame, between: float, within: float) -> Column:
    trust = F.lit(between) / (F.lit(between) + F.lit(within) / F.col("n"))
    return F.col("center") + trust * (F.col("mean") - F.col("center"))


def site_quality(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, threshold: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """doc_id, host, path, evidence, site_quality, score, kept for every row.

    Null hosts and paths are a site of their own (empty name). A text without words has the evidence of its
    zero statistics. Ties and repeated rows get equal results; an empty table gives no rows.
    """
    weights, offset = learn_classifier(docs, labels)
    made = with_counts(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "text"), keep=["doc_id", "host", "path"])
    values = features() | {"words": F.log1p(F.col("_counts.n_words"))}
    linear = F.lit(offset)
    for w, v in zip(weights, values.values(), strict=True):
        linear = linear + F.lit(w) * v
    evidence = stored(made.select("doc_id", "host", "path", (1 / (1 + F.exp(-F.greatest(F.least(linear, F.lit(30.0)), F.lit(-30.0))))).alias("evidence")), "evidence")
    sums = F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") ** 2).alias("ss")
    paths = stored(evidence.groupBy("host", "path").agg(*sums), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    center = total["s"] / total["n"] if total["n"] else 0.5
    mean, within = F.col("s") / F.col("n"), F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))).select("host", "n", mean.alias("mean"), within.alias("within"), F.lit(center).alias("center"))
    hosts = stored(hosts.select("host", shrunk(hosts, *spread(hosts)).alias("center")), "hosts")
    below = paths.join(hosts, "host").select("host", "path", "n", mean.alias("mean"), within.alias("within"), "center")
    sites = stored(below.select("host", "path", shrunk(below, *spread(below)).alias("site_quality")), "sites")
    posterior = log_odds(F.col("evidence")) + log_odds(F.col("site_quality")) - log_odds(F.lit(center))
    scored = evidence.join(sites, ["host", "path"]).withColumn("score", 1 / (1 + F.exp(-posterior)))
    return scored.select("doc_id", "host", "path", "evidence", "site_quality", "score", (F.col("score") >= threshold).alias("kept"))
