"""URL filter: rules first, gradient-boosted trees on lexical features for all other URLs.

Rules are `host/path` beginnings with a verdict.  URLs that a rule fits are the labelled ones; the trees learn from all
of them.  Features are small whole numbers: length, path depth, share of digits, entropy of the characters, number of
query parameters, and for the host's last and last two labels how often they are labelled and blocked.
Those rates are shrunk, two labels towards one label and that towards one half, and for training come from the other
folds of the URLs, so that a URL's own label is not among its features.  Both classes weigh the same: how many URLs a
list of rules happens to block is no evidence about others.

Boosting: labelled URLs are grouped by their features once.  Each level of each tree is one grouped sum over these groups of
gradients and hessians by (node, feature, value), at most a few thousand rows, from which the driver picks the splits.
Gradients and leaf values are whole numbers of 2^-20, so sums do not depend on their order and equal tables
give equal trees.  A tree is applied as a Column expression.

Scale: only the URL is read; features are worked out once and stored.  All sums combine before the shuffle, a host with a
third of all rows is one row per task; rates are joined back with aggregated tables, broadcast or split where
Spark sees skew.  The number of passes over the groups is trees * depth, whatever the size.

Cases: a null URL or one without `://` has empty host and path and is judged by its features (a null has
those of an empty text); repeated rows are judged alike; without labelled URLs of both classes the trees move all scores
towards the one that there is, without any all scores are one half; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import string
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import only, stored, table

RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]
FEATURES = ["length", "depth", "digits", "entropy", "parameters", "label_rate", "domain_rate", "domain_seen"]
FOLDS = 5
PRIOR = 10.0
UNIT = 1 << 20
LAMBDA, LEAST = 1.0, 1.0
MOST_BIN = 255


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]], result: int = 1) -> Column:
    """The longest rule that fits (result 1) or its verdict (result 0), null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule[1].partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, rule[result]).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits per character: equal characters stand together once sorted, their runs are the counts."""
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(text, "")), ""), F.lit(r"(?s)((.)\2*+)"), F.lit(1))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.log2(n) - F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + F.length(r) * F.log2(F.length(r).cast("double"))) / n


def _bin(value: Column) -> Column:
    """Whole numbers; rounding first keeps values that mean a boundary on its upper side."""
    return F.least(F.lit(MOST_BIN), F.greatest(F.lit(0), F.floor(F.round(value, 9)))).cast("int")


def _filled(text: Column, by: str) -> Column:
    return F.size(F.filter(F.split(text, by), lambda x: x != ""))


def lexical(url: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    n = F.length(text).cast("double")
    parameters = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    return {
        "length": _bin(8 * F.log2(n + 1)), "depth": _bin(_filled(path, "/").cast("double")),
        "digits": _bin(64 * F.regexp_count(text, F.lit("[0-9]")) / F.greatest(n, F.lit(1.0))), "entropy": _bin(16 * _entropy(text)),
        "parameters": _bin(_filled(parameters, "&").cast("double")),
    }


def described(rows: DataFrame, rules: list[tuple[str, str]], key: str, url: str) -> DataFrame:
    """key, host, path, rule, blocked (by the rule; null if none fits), fold, the host's ends and lexical features."""
    parts = only(rows, key=key, url=url).select("key", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    return stored(parts.select(
        "key", "host", "path", rule_for(host, path, rules).alias("rule"), (rule_for(host, path, rules, 0) == "block").alias("blocked"),
        F.pmod(F.crc32(F.coalesce(F.col("url"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int").alias("fold"),
        F.substring_index(host, ".", -1).alias("label"), F.substring_index(host, ".", -2).alias("domain"),
        *[c.alias(name) for name, c in lexical(F.col("url"), path).items()],
    ), "urls")


def weights(labelled: DataFrame) -> tuple[float, float]:
    """What an allowed and a blocked URL weigh, so that both classes weigh the same."""
    seen = labelled.agg(F.count("*").alias("n"), F.count(F.when(F.col("blocked"), 1)).alias("b")).first()
    a, b = seen["n"] - seen["b"], seen["b"]
    return (seen["n"] / (2 * a) if a else 1.0, seen["n"] / (2 * b) if b else 1.0)


def suffix_counts(labelled: DataFrame, by: str) -> DataFrame:
    """Per suffix the arrays a and b: allowed and blocked URLs outside each fold, and of all folds last."""
    sides = {"a": ~F.col("blocked"), "b": F.col("blocked")}
    counts = [F.count(F.when(side & (F.col("fold") != k), 1)).alias(f"{name}{k}") for name, side in sides.items() for k in range(FOLDS + 1)]
    sums = labelled.groupBy(F.col(by).alias(f"_{by}")).agg(*counts)
    return stored(sums.select(f"_{by}", *[F.array(*[f"{name}{k}" for k in range(FOLDS + 1)]).alias(f"{by}_{name}") for name in sides]), "suffixes")


def with_rates(rows: DataFrame, counts: dict[str, DataFrame], weigh: tuple[float, float], fold: Column) -> DataFrame:
    """Add the suffix features; fold chooses the counts, FOLDS those of all URLs."""
    joined = rows
    for by, table_of in counts.items():
        joined = joined.join(table_of, F.col(by) == F.col(f"_{by}"), "left").drop(f"_{by}")

    def rate(by: str, prior: Column) -> Column:
        a, b = (F.coalesce(F.get(f"{by}_{name}", fold), F.lit(0)) * F.lit(w) for name, w in zip("ab", weigh, strict=True))
        return (PRIOR * prior + b) / (PRIOR + a + b)

    label = rate("label", F.lit(0.5))
    seen = sum(F.coalesce(F.get(f"domain_{name}", fold), F.lit(0)) for name in "ab")
    return joined.withColumns({
        "label_rate": _bin(64 * label), "domain_rate": _bin(64 * rate("domain", label)), "domain_seen": _bin(2 * F.log2(seen + F.lit(1.0))),
    }).drop("label_a", "label_b", "domain_a", "domain_b")


class Tree:
    """A complete tree: node i has the children 2i + 1 (feature at most the threshold) and 2i + 2; values, in units of 2^-20,
    stand for the nodes below the last level.  A node that is not split sends all to the first child."""

    def __init__(self, depth: int):
        self.depth = depth
        self.feature = [0] * ((1 << depth) - 1)
        self.threshold = [MOST_BIN] * len(self.feature)
        self.value = [0] * (len(self.feature) + (1 << depth))

    def split(self, node: int, best: tuple | None, rate: float) -> None:
        if best is not None:
            self.feature[node], self.threshold[node] = FEATURES.index(best[1]), best[2]
        for child, sums in zip((2 * node + 1, 2 * node + 2), best[3:] if best else (None, None), strict=True):
            self.value[child] = self.value[node] if sums is None else round(-rate * sums[0] / (sums[1] + LAMBDA) * UNIT)

    def literal(self) -> str:
        """The tree as a value in SQL: plans of all passes are alike, so that their code is compiled once."""
        arrays = {"f": self.feature, "t": self.threshold, "v": self.value}
        return f"named_struct({', '.join(f"'{name}', array({', '.join(map(str, items))})" for name, items in arrays.items())})"

    def applied(self, node: int = 0) -> Column:
        """The value of a row as a compiled expression."""
        if node >= len(self.feature):
            return F.lit(self.value[node])
        low, high = self.applied(2 * node + 1), self.applied(2 * node + 2)
        return F.when(F.col(FEATURES[self.feature[node]]) <= self.threshold[node], low).otherwise(high)


def _reached(tree: str, levels: int) -> str:
    """SQL for the node that features x reach after some levels."""
    if not levels:
        return "0"
    return f"aggregate(sequence(1, {levels}), 0, (at, _) -> 2 * at + 1 + int(x[{tree}.f[at]] > {tree}.t[at]))"


def probability(trees: list[Tree]) -> Column:
    return 1 / (1 + F.exp(-sum((t.applied() for t in trees), F.lit(0)).cast("long") / F.lit(float(UNIT))))


def best_split(counts: dict[str, dict[int, tuple[int, int]]]) -> tuple | None:
    """Of one node's sums (gradient, hessian) by feature and value: gain, feature, threshold, sums of both sides."""
    best = None
    for feature in FEATURES:
        values = sorted(counts[feature].items())
        g_all, h_all = (sum(v[i] for _, v in values) / UNIT for i in (0, 1))
        g = h = 0
        for (value, (dg, dh)), (next_value, _) in itertools.pairwise(values):
            g, h = g + dg, h + dh
            gl, hl = g / UNIT, h / UNIT
            gr, hr = g_all - gl, h_all - hl
            if min(hl, hr) < LEAST:
                continue
            gain = gl * gl / (hl + LAMBDA) + gr * gr / (hr + LAMBDA) - g_all * g_all / (h_all + LAMBDA)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, feature, (value + next_value) // 2, (gl, hl), (gr, hr))
    return best


def boosted(cells: DataFrame, weigh: tuple[float, float], trees: int, depth: int, rate: float) -> list[Tree]:
    """Trees from groups of equal features, a of whose URLs are allowed and b blocked."""
    weight = f"(a * {weigh[0]!r}D + b * {weigh[1]!r}D)"
    grown: list[Tree] = []
    for _ in range(trees):
        before = f"array({', '.join(t.literal() for t in grown)})" if grown else "cast(array() as array<struct<f:array<int>,t:array<int>,v:array<int>>>)"
        so_far = f"aggregate({before}, 0, (m, tree) -> m + tree.v[{_reached('tree', depth)}])"
        tree = Tree(depth)
        for level in range(depth):
            sums = cells.selectExpr("a", "b", f"array({', '.join(FEATURES)}) as x").selectExpr(
                "a", "b", "x", f"transform(array({tree.literal()}), tree -> {_reached('tree', level)})[0] as node", f"1 / (1 + exp(-{so_far} / {UNIT}D)) as p"
            ).selectExpr(
                "node", f"cast(round(({weight} * p - b * {weigh[1]!r}D) * {UNIT}) as long) as g",
                f"cast(round({weight} * p * (1 - p) * {UNIT}) as long) as h", "posexplode(x) as (feature, value)",
            ).groupBy("node", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            by_node = defaultdict(lambda: defaultdict(dict))
            for r in sums.collect():
                by_node[r["node"]][FEATURES[r["feature"]]][r["value"]] = (r["g"], r["h"])
            for node in range((1 << level) - 1, (2 << level) - 1):
                tree.split(node, best_split(by_node[node]) if node in by_node else None, rate)
        grown.append(tree)
    return grown


class Model:
    """What is learned from the rows of `described` whose column blocked is not null."""

    def __init__(self, rows: DataFrame, trees: int = 10, depth: int = 3, rate: float = 0.5):
        labelled = rows.where("blocked IS NOT NULL")
        self.weigh = weights(labelled)
        self.counts = {by: suffix_counts(labelled, by) for by in ("label", "domain")}
        cells = with_rates(labelled, self.counts, self.weigh, F.col("fold")).groupBy(*FEATURES).agg(
            F.count(F.when(~F.col("blocked"), 1)).alias("a"), F.count(F.when(F.col("blocked"), 1)).alias("b"))
        self.trees = boosted(stored(cells, "cells"), self.weigh, trees, depth, rate)

    def scored(self, rows: DataFrame) -> DataFrame:
        return with_rates(rows, self.counts, self.weigh, F.lit(FOLDS)).withColumn("score", probability(self.trees))


def judged(rows: DataFrame, rules: list[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", threshold: float = 0.5, **how) -> DataFrame:
    """key, host, path, rule, verdict and score, the trees' probability of a block."""
    urls = described(rows, rules, key, url)
    block = F.coalesce(F.col("blocked"), F.col("score") >= threshold)
    return Model(urls, **how).scored(urls).select(
        F.col("key").alias(key), "host", "path", "rule", F.when(block, "block").otherwise("allow").alias("verdict"), "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "pages"))
