"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Evidence: a logistic regression on simple features of the whole text (length, shares of upper-case
letters, symbols, digits and bars, share of different words), fitted on labelled rows outside the held-out
fold (`sample` documents at most, the only rows that reach the driver) and applied as a Column expression.

Sites: the evidence is summed by host and by path of a host.  A host's rate is shrunk towards the
global rate and a path's towards its host's, each by a prior strength that the method of moments takes from
the spread between groups: sparse or uniform groups move to their prior, large and distinct ones keep their own
rate.  A document's own evidence is taken out of its path before it is judged, and the odds of its evidence
are multiplied by `weight` times the log-odds that its path has over the global rate.

Sums combine before the shuffle, so a host with a third of all rows is one row per task; the table of paths
is stored and joined back as Spark's size limits allow, broadcast or sorted.  Texts are never shuffled.

Cases: null text is empty, a null host or path is a group of its own; a null doc_id is a row like others;
repeated rows are judged alike; without labels of both classes all evidence is the share of good labels
(one half without any); an empty table gives an empty result; other columns, whatever their names, are kept by
`accepted` and not read otherwise.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import named, only, packed, stored, table, unpacked
from .labelled import SAMPLE, logistic, training_rows

WORD = r"[\x20\x09-\x0D]+"
SHARES = [r"[A-ZÀ-Þ]", r"[#$%&*!@^~=<>{}\[\]\\]", r"[0-9]", r"\|"]
LIMIT = 1e6


def features(text: Column) -> list[Column]:
    whole = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(whole), F.lit(1))
    words = F.split(whole, WORD)
    shares = [F.sqrt(F.regexp_count(whole, F.lit(x)) / n) for x in SHARES]
    return [F.log1p(F.length(whole).cast("double")), *shares, F.size(F.array_distinct(words)) / F.size(words)]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[float]:
    """Weights of the features, the constant last."""
    rows = only(docs, doc_id="doc_id", text=text)
    known = training_rows(rows, labels, "quality", sample).select("label", F.array(*features(F.col("text"))).alias("x")).collect()
    y = np.array([r["label"] for r in known], float)
    width = len(SHARES) + 2
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return [0.0] * width + [math.log(share / (1 - share))]
    x = np.array([r["x"] for r in known])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = logistic((x - mean) / spread, y)
    return [*(w[:-1] / spread).tolist(), float(w[-1] - np.sum(w[:-1] * mean / spread))]


def evidence(text: Column, weights: list[float]) -> Column:
    """Probability that the text is good."""
    z = sum((f * F.lit(w) for f, w in zip(features(text), weights, strict=False)), F.lit(weights[-1]))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def _strength(mean: float, between: float | None) -> float:
    """Prior strength of a beta distribution with this mean and variance."""
    if not between or between <= 0:
        return LIMIT
    return min(LIMIT, max(1.0, mean * (1 - mean) / between - 1))


def _between(groups: DataFrame, rate: Column) -> float | None:
    """Variance of the groups' true rates: the spread of their means less what chance gives."""
    n, s = F.col("n"), F.col("s")
    seen = (s / n - rate) * (s / n - rate)
    chance = rate * (1 - rate) / n
    return groups.where("n > 1").agg((F.sum(n * (seen - chance)) / F.sum(n)).alias("v")).first()["v"]


def site_rates(scored: DataFrame) -> tuple[DataFrame, float]:
    """Of rows (host, path, evidence): host, path, n, s, host_rate, path_rate, strength; and the
    global rate."""
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s")), "paths")
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = total["s"] / total["n"] if total["n"] else 0.5
    mean = min(1 - 1e-6, max(1e-6, mean))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    a = _strength(mean, _between(hosts, F.lit(mean)))
    rates = hosts.select(F.col("host").alias("_host"), ((a * mean + F.col("s")) / (a + F.col("n"))).alias("host_rate"))
    joined = stored(paths.join(rates, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "rates")
    b = _strength(mean, _between(joined, F.col("host_rate")))
    rate = (b * F.col("host_rate") + F.col("s")) / (b + F.col("n"))
    return joined.select("host", "path", "n", "s", "host_rate", rate.alias("path_rate"), F.lit(b).alias("strength")), mean


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(p / (1 - p))


def _posterior(mean: float, weight: float) -> Column:
    """The document's probability with its path's rate, its own evidence left out of that."""
    p, b = F.col("evidence"), F.col("strength")
    rest = (b * F.col("host_rate") + F.greatest(F.col("s") - p, F.lit(0.0))) / (b + F.col("n") - 1)
    return 1 / (1 + F.exp(-(_logit(p) + weight * (_logit(rest) - math.log(mean / (1 - mean))))))


def judged(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", weight: float = 0.5, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """row, a struct of all columns of docs, and evidence, host_rate, path_rate, quality, kept."""
    weights = fit(docs, labels, sample=sample)
    rows = packed(docs, host=named(host), path=named(path), evidence=evidence(named("text"), weights))
    sites, mean = site_rates(stored(rows.select("host", "path", "evidence"), "evidence"))
    sites = sites.select(F.col("host").alias("at_host"), F.col("path").alias("at_path"), "n", "s", "host_rate", "path_rate", "strength")
    found = rows.join(sites, F.col("host").eqNullSafe(F.col("at_host")) & F.col("path").eqNullSafe(F.col("at_path")))
    return found.withColumn("quality", _posterior(mean, weight)).select(
        "row", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= threshold).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    return unpacked(judged(docs, labels, **how).where("kept"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    found = judged(docs, table(spark, folder, "labels"))
    return found.select("row.doc_id", "row.source", "row.lang", "evidence", "host_rate", "path_rate", "quality", "kept")
