"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Token counts of cells (source, language, topic) are raked: a cell's raked tokens are its own times one factor for
each of its values, and in turn each dimension's factors are set so that its marginals are the targets, until no factor
changes by more than `tolerance`.  The ratio of a cell's raked to its own tokens is the weight of its documents.  A document
is then kept with probability c * weight, by comparing the probability with a hash of its id.

Targets that no weights can meet (monolingual sources, say) make the factors swing for ever.  Once the largest change stops
shrinking, steps are halved on the scale of logarithms.  That converges to one answer: the weights with the least sum of their
divergence from the tokens and their marginals' divergences from the targets.  `marginals` says how far off each is;
`strict` makes it an error.

The default c is the inverse of the largest weight when the cells of largest weight are set aside that together hold at most
`short` of the raked tokens: these keep all their documents and fall short of their targets by at most that share of the
sample, so that a tiny source does not rule the sample's size.  Where `keep` is given, c is such that the expected tokens are
that share of all, and probabilities are cut at 1: cells that would need repeated documents fall short of their targets.

Targets are tables (value, share), or by default the shares of the table itself raised to a power below
one, which gives small sources and languages more and large ones less.  Values without tokens are left out
and shares rescaled.  The topic is the column `topic` where the table has one, else the form of the text.

Everything is grouped sums and joins with the sums, which combine before the shuffle, so a source with a third
of all rows does not meet in one task.  Cells are stored once, and the table of factors, one row per value, after
each cycle; the plan of a cycle is always the same.  Spark broadcasts them if their size allows.  The driver sees one row per cycle.

Cases: null source, language, topic or text count as empty strings; documents without tokens keep with
probability 1 and weigh nothing; a null doc_id is hashed as such; repeated rows are drawn alike; an empty
table gives an empty result; other columns, whatever their names, are kept by `mixed` and not read otherwise.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import named, packed, stored, table, unpacked

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.8, "lang": 0.9, "topic": 1.0}
GRID = 24
PATIENCE, LEAST_GAIN = 3, 0.9  # cycles after which the largest change must have fallen to less than this part
SHORT = 0.001


def topic_of(text: Column) -> Column:
    """A rule for tables without a topic: form of the text."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table").when(F.length(text) < 500, "short")
        .when(F.length(text) < 5000, "article").otherwise("long")
    )


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def cell_of(docs: DataFrame) -> dict[str, Column]:
    """The dimensions of the rows of docs."""
    own = next((c for c in docs.columns if c.lower() == "topic"), None)
    columns = {"source": named("source"), "lang": named("lang"), "topic": topic_of(F.coalesce(named("text"), F.lit(""))) if own is None else named(own)}
    return {d: F.coalesce(c.cast("string"), F.lit("")) for d, c in columns.items()}


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, tokens."""
    return docs.select(
        named("doc_id").alias("doc_id"), *[c.alias(d) for d, c in cell_of(docs).items()], token_count(F.coalesce(named("text"), F.lit(""))).alias("tokens")
    )


def default_targets(cells: DataFrame, powers: dict[str, float] = POWERS) -> dict[str, DataFrame]:
    return {d: cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(powers[d])).alias("share")) for d in powers}


def _start(cells: DataFrame, targets: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The cells all of whose values have targets; dimension, value, goal (the tokens it should have) and factor 1."""
    shares = {d: given.groupBy(d).agg(F.sum("share").alias("share")).where("share > 0") for d, given in targets.items()}
    for d in shares:
        cells = cells.join(shares[d].select(d), d, "left_semi")
    cells = stored(cells, "cells")
    here = [shares[d].join(cells.select(d).distinct(), d, "left_semi").select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "share") for d in shares]
    here = stored(functools.reduce(DataFrame.union, here), "targets")
    whole = here.groupBy("dimension").agg(F.sum("share").alias("whole"))
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    return cells, stored(here.join(whole, "dimension").select(
        "dimension", "value", (F.col("share") * total / F.col("whole")).alias("goal"), F.lit(1.0).alias("factor")), "factors")


def _of(factors: DataFrame, d: str) -> DataFrame:
    return factors.where(F.col("dimension") == d).select(F.col("value").alias(d), "goal", "factor")


def _with_factors(cells: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    """cells with raked, the tokens times the factors."""
    raked = F.col("tokens").cast("double")
    for d, table_of in factors.items():
        cells = cells.join(table_of.select(d, F.col("factor").alias(f"by_{d}")), d)
        raked = raked * F.col(f"by_{d}")
    return cells.withColumn("raked", raked).drop(*[f"by_{d}" for d in factors])


def _cycle(cells: DataFrame, factors: DataFrame, dimensions: list[str], power: float) -> DataFrame:
    """factors after each dimension has been set once, and by how much each changed."""
    now, rows = {d: _of(factors, d) for d in dimensions}, []
    for d in dimensions:
        sums = _with_factors(cells, {o: f for o, f in now.items() if o != d}).groupBy(d).agg(F.sum("raked").alias("sum"))
        new = F.pow(F.col("goal") / F.col("sum"), F.lit(power))
        now[d] = now[d].join(sums, d).select(d, "goal", new.alias("factor"), F.abs(new / F.col("factor") - 1).alias("change"))
        rows.append(now[d].select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "goal", "factor", "change"))
    return functools.reduce(DataFrame.union, rows)


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-4, cycles: int = 100, strict: bool = False) -> DataFrame:
    """cells (dimensions and tokens) with raked: tokens scaled to the targets' shares, or as near as the targets allow."""
    cells, factors = _start(cells, targets)
    changes, power = [], 1.0
    for _ in range(cycles):
        factors = stored(_cycle(cells, factors, list(targets), power), "factors")
        changes.append(factors.agg(F.max("change")).first()[0])
        if changes[-1] is None or changes[-1] < tolerance:
            break
        if power == 1.0 and len(changes) > PATIENCE and changes[-1] > LEAST_GAIN * changes[-1 - PATIENCE]:
            power = 0.5
            if strict:
                break
    if strict and changes and changes[-1] is not None and changes[-1] >= tolerance:
        raise ValueError(f"raking is off by {changes[-1]:.3g}: the targets cannot be met with these cells, or only more slowly")
    raked = stored(_with_factors(cells, {d: _of(factors, d) for d in targets}), "raked")
    sums = raked.agg(F.sum(F.col("tokens").cast("double")).alias("tokens"), F.sum("raked").alias("raked")).first()
    return raked.withColumn("raked", F.col("raked") * ((sums["tokens"] or 1.0) / (sums["raked"] or 1.0)))


def largest_weight(raked: DataFrame, short: float) -> float:
    """The least weight such that the cells above it hold at most `short` of the raked tokens, from above to
    within a part of the range of weights; 1 without cells."""
    weight = F.col("raked") / F.col("tokens")
    bounds = raked.agg(F.min(weight).alias("low"), F.max(weight).alias("high"), F.sum("raked").alias("all")).first()
    low, high = bounds["low"], bounds["high"]
    for _ in range(4 if low is not None and low < high else 0):
        steps = [low * (high / low) ** (i / GRID) for i in range(GRID)] + [high]
        sums = raked.agg(*[F.coalesce(F.sum(F.when(weight > w, F.col("raked"))), F.lit(0.0)) for w in steps]).first()
        first = next(i for i, above in enumerate(sums) if above <= short * bounds["all"])
        low, high = steps[max(0, first - 1)], steps[first]
    return high or 1.0


def calibrate(raked: DataFrame, keep: float) -> float:
    """The factor c with sum(tokens * min(1, c * weight)) = keep * sum(tokens)."""
    bounds = raked.agg(F.min(F.col("tokens") / F.col("raked")).alias("low"), F.max(F.col("tokens") / F.col("raked")).alias("high")).first()
    if bounds["low"] is None:
        return 1.0
    low, high = bounds["low"] * keep / 2, bounds["high"]
    for _ in range(4):
        steps = [low * (high / low) ** (i / GRID) for i in range(GRID + 1)]
        sums = raked.agg(F.sum("tokens"), *[F.sum(F.least(F.col("tokens").cast("double"), F.col("raked") * c)) for c in steps]).first()
        over = next((i for i, s in enumerate(sums[1:]) if s >= keep * sums[0]), GRID)
        low, high = steps[max(0, over - 1)], steps[over]
    return high


def uniform(doc_id: Column) -> Column:
    """A number from 0 to 1 from the hash of the id."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("none")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 48)


def marginals(cells: DataFrame, tokens: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """dimension, value, target and expected share of each marginal: cells with probability, and their tokens."""
    both = tokens.join(cells.select(*DIMENSIONS, "probability"), list(DIMENSIONS), "left").withColumn("drawn", F.col("tokens") * F.coalesce("probability", F.lit(0.0)))
    out = None
    for d, given in (targets or default_targets(tokens)).items():
        here = given.groupBy(d).agg(F.sum("share").alias("share")).where("share > 0")
        sums = both.groupBy(d).agg(F.sum("drawn").alias("drawn")).join(here, d, "left")
        whole = sums.agg(F.sum("share").alias("_share"), F.sum("drawn").alias("_drawn"))
        rows = sums.crossJoin(whole).select(
            F.lit(d).alias("dimension"), F.col(d).alias("value"), (F.coalesce("share", F.lit(0.0)) / F.col("_share")).alias("target"),
            (F.col("drawn") / F.col("_drawn")).alias("expected"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float | None = None, **how) -> DataFrame:
    """Cells with weight and probability."""
    return _cells(marked(docs), targets, keep, **how)


def _cells(rows: DataFrame, targets: dict[str, DataFrame] | None, keep: float | None, short: float = SHORT, **how) -> DataFrame:
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "cells")
    raked = rake(cells, targets or default_targets(cells), **how)
    weight = F.col("raked") / F.col("tokens")
    c = 1 / largest_weight(raked, short) if keep is None else calibrate(raked, keep)
    return stored(raked.select(*DIMENSIONS, weight.alias("weight"), F.least(F.lit(1.0), weight * c).alias("probability")), "weights")


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float | None = None, **how) -> DataFrame:
    """The rows of docs that are drawn, with their columns."""
    cells = probabilities(docs, targets, keep, **how).drop("weight")
    some = F.rlike(F.coalesce(named("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    rows = packed(docs, **cell_of(docs), some=some, place=uniform(named("doc_id"))).join(cells, list(DIMENSIONS), "left")
    return unpacked(rows.where(~F.col("some") | (F.col("place") < F.coalesce("probability", F.lit(0.0)))))


def drawn(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float | None = None, **how) -> DataFrame:
    """One row per row of docs: doc_id, dimensions, tokens, weight, probability, kept."""
    rows = stored(marked(docs), "marked")
    found = rows.join(_cells(rows, targets, keep, **how), list(DIMENSIONS), "left")
    chance = F.when(F.col("tokens") == 0, 1.0).otherwise(F.coalesce("probability", F.lit(0.0)))
    return found.select(
        "doc_id", *DIMENSIONS, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), chance.alias("probability"),
        (uniform(F.col("doc_id")) < chance).alias("kept"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return drawn(table(spark, folder, "documents"))
