"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value calibration.

Model.  A token counts as its lower-case word and, if longer, as the stem of its first `stem` letters.
The log-odds of a unit in toxic against clean documents have a Dirichlet prior proportional to the unit's
frequency in both; a unit is used if its log-odds differ from zero by `z_least` deviations and by `least`.  A token scores
its word's log-odds, else its stem's, less a constant; any other token scores minus that constant, so the
expected score of clean text is negative.

Search.  All maximal scoring segments of a text in one pass over its positive tokens (Ruzzo and Tompa).  A
segment of score S among n tokens has the extreme-value probability 1 - exp(-K n exp(-lambda S)); lambda
solves E exp(lambda s) = 1 over the tokens of clean documents and K is the maximum-likelihood value on
their best segments.  Toxic words of clean documents come in clusters, so the number of segments of score S or more
is a negative binomial count with mean k n exp(-l S), where l, k and the shape a are fitted on all segments of clean
documents above their median.  The r best segments together have the probability that such a count reaches r at
the r-th score (a geometric series bounds the tail from above), times r (r + 1) for the choice of r.  A document's
evidence is lambda S - log(K n) of its best segment, and the logarithm by which the best r is less probable than
the best segment alone; its score is a logistic function of that, fitted on segments that the other half's
model gave.  Segments are reported that have a probability below `level` alone or together with all better ones.

Fitting reads labelled rows outside the held-out fold, `sample` documents at most, and keeps `terms` units
at most; everything else covers whole texts of all documents.  Only the text is scored.

Cases: null or empty text has no tokens, no segments and the score of S = 0; repeated rows get equal scores;
a null doc_id is scored and not held out; without labels of both classes no unit is used and all documents
score the share of toxic labels; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import only, stored, table
from .labelled import SAMPLE, fold, logistic, training_rows

STEM = 4
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"
COST = 0.1
PRIOR = 200.0
CACHE = 1 << 19
SEGMENTS = "doc_id long, passages array<struct<first_word: int, last_word: int, score: double, p_value: double, passage: string>>"


class _Scores(dict):
    """Token -> score; a token as it stands in a text is looked up once."""

    def __init__(self, units: dict[str, float], stem: int):
        super().__init__()
        self.units, self.stem = units, stem

    def __missing__(self, token: str) -> float:
        word = token.lower().strip(EDGES)
        value = self.units.get(word)
        if value is None and len(word) > self.stem:
            value = self.units.get(word[: self.stem] + "*")
        value = -COST if value is None else value - COST
        if len(self) >= CACHE:
            self.clear()
        self[token] = value
        return value


def _units(batches: Iterator[pa.RecordBatch], stem: int) -> Iterator[pa.RecordBatch]:
    """Numbers of documents with a word or stem, by half and label."""
    counts: dict = {}
    for batch in batches:
        for text, label, half in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), batch.column("fold").to_pylist(), strict=True):
            words = {token.lower().strip(EDGES) for token in (text or "").split()}
            for unit in words | {word[:stem] + "*" for word in words if len(word) > stem}:
                key = (unit, 2 * (half > 0) + label)
                counts[key] = counts.get(key, 0) + 1
        if len(counts) > CACHE:
            yield _counted(counts)
            counts = {}
    yield _counted(counts)


def _counted(counts: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "unit": pa.array([k[0] for k in counts], pa.string()), "kind": pa.array([k[1] for k in counts], pa.int32()),
        "n": pa.array(list(counts.values()), pa.int64()),
    })


def log_odds(y1, n1, y0, n0, prior: float = PRIOR):
    """Log-odds with a Dirichlet prior, half an occurrence and `prior` ones in the unit's overall
    share, and z."""
    a = 0.5 + prior * (y1 + y0) / (n1 + n0)
    delta = F.log((y1 + a) / (n1 + prior - y1)) - F.log((y0 + a) / (n0 + prior - y0))
    return delta, delta / F.sqrt(1 / (y1 + a) + 1 / (y0 + a))


def fit_units(units: DataFrame, kinds: tuple, z_least: float, least: float, terms: int) -> dict[str, float]:
    """Significant units of the given (clean, toxic) kinds; `terms` at most, the surest first."""
    clean, toxic = [sum((F.coalesce(F.col(f"k{k}"), F.lit(0)) for k in some), F.lit(0.0)) for some in kinds]
    rows = units.select("unit", toxic.alias("y1"), clean.alias("y0")).where("y1 + y0 >= 2")
    totals = rows.agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0")).first()
    if not totals["n1"] or not totals["n0"]:
        return {}
    delta, z = log_odds(F.col("y1"), F.lit(totals["n1"]), F.col("y0"), F.lit(totals["n0"]))
    sure = rows.select("unit", delta.alias("delta"), z.alias("z")).where((F.abs("z") >= z_least) & (F.abs("delta") >= least))
    return {r["unit"]: r["delta"] for r in sure.orderBy(F.desc(F.abs("z")), "unit").limit(terms).collect()}


def maximal_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments: (score, first, last) in order of place."""
    sums = np.cumsum(scores)
    kept: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, nearest with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, first = float(sums[i]) - float(scores[i]), float(sums[i]), i
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= right:
                kept.append((left, right, first, i, j))
                break
            left, first, j_next = kept[j][0], kept[j][2], kept[j][4]
            del kept[j:]
            j = j_next
    return [(right - left, first, last) for left, right, first, last, _ in kept]


def _segments_of(tokens: list[str], scores: _Scores) -> list[tuple[float, int, int]]:
    """All maximal segments of a text; none without a positive token.  A token that repeats the one
    before it counts as any other word: it does not stand there independently, as the probabilities assume."""
    values = np.fromiter(map(scores.__getitem__, tokens), float, len(tokens))
    if not len(values) or values.max() <= 0:
        return []
    values[[i for i in np.flatnonzero(values > 0).tolist() if i and tokens[i] == tokens[i - 1]]] = -COST
    return maximal_segments(values)


def joint(best: np.ndarray, n: int, tail: tuple[float, float, float]) -> np.ndarray:
    """log of the probability of the r best segments together, r = 1, 2, ..., of falling scores, without the
    factor for the choice of r; 0 where that many are expected."""
    lam, k, shape = tail
    r = np.arange(1, len(best) + 1)
    mean = k * max(n, 1) * np.exp(-lam * best)
    share = mean / (mean + shape)
    ratio = share * np.maximum(1.0, (shape + r) / (r + 1))
    log_share = math.log(k * max(n, 1)) - lam * best - np.log(mean + shape)
    first = np.cumsum(np.log((shape + r - 1) / r)) + shape * np.log(shape / (mean + shape)) + r * log_share
    fits = (mean < r) & (ratio < 1)
    return np.where(fits, np.minimum(first - np.log1p(-np.where(fits, ratio, 0.0)), 0.0), 0.0)


def _choices(m: int) -> np.ndarray:
    r = np.arange(1, m + 1)
    return np.log(r * (r + 1.0))


def evidence(scores: list[float], n: int, lam: float, k: float, tail: tuple[float, float, float]) -> float:
    """lambda S - log(K n) of the best segment and what the others add."""
    best = np.sort(np.array(scores, float))[::-1]
    if not len(best):
        return -math.log(k * max(n, 1))
    together = joint(best, n, tail)
    added = together[0] - (together + _choices(len(best))).min()
    return lam * float(best[0]) - math.log(k * max(n, 1)) + max(0.0, float(added))


def _cross(batches: Iterator[pa.RecordBatch], models, stem: int) -> Iterator[pa.RecordBatch]:
    """Scores of the segments of the training rows under the other half's model, and token scores of
    clean ones as counts (label -1, score in hundredths as n, the count as the only segment)."""
    scores = [_Scores(m, stem) for m in models.value]
    seen: Counter = Counter()
    for batch in batches:
        rows = []
        for text, label, half in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), batch.column("fold").to_pylist(), strict=True):
            other, tokens = scores[half == 0], (text or "").split()
            rows.append((label, len(tokens), [x[0] for x in _segments_of(tokens, other)]))
            if not label:
                seen.update(round(other[t] * 100) for t in tokens)
        yield _rows(rows)
    yield _rows([(-1, k, [float(v)]) for k, v in seen.items()])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    label, n, best = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"label": pa.array(label, pa.int32()), "n": pa.array(n, pa.int64()), "best": pa.array(best, pa.list_(pa.float64()))})


def _evidences(batches: Iterator[pa.RecordBatch], **model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [evidence(best, n, **model) for best, n in zip(batch.column("best").to_pylist(), batch.column("n").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.float64())], names=["label", "evidence"])


def solve_lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E exp(lambda s) = 1; 1 where no score is positive."""
    if not len(values) or values.max() <= 0:
        return 1.0
    share = weights / weights.sum()
    low, high = 1e-3, 1e-3
    while share @ np.exp(np.clip(high * values, None, 500)) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if share @ np.exp(np.clip(mid * values, None, 500)) < 1 else (low, mid)
    return high


def fit_tail(clean: DataFrame, lam: float, k: float) -> tuple[float, float, float]:
    """l, k and the shape of the counts of segments in clean documents (columns n and best); lambda, K
    and 1 where there are fewer than 30 segments."""
    each = clean.select(F.explode("best").alias("s"))
    found = each.agg(F.count("*").alias("m"), F.expr("percentile(s, 0.5)").alias("s")).first()
    if found["m"] < 30:
        return lam, k, 1.0
    over = clean.select(F.greatest(F.col("n"), F.lit(1)).cast("double").alias("n"), F.filter("best", lambda s: s >= found["s"]).alias("best"))
    over = over.select("n", F.size("best").cast("double").alias("c"), F.aggregate("best", F.lit(0.0), lambda t, s: t + s - found["s"]).alias("excess"))
    sums = over.agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("excess").alias("excess")).first()
    rate, slope = sums["c"] / sums["n"], sums["c"] / max(sums["excess"], 1e-9)
    mean = F.col("n") * rate
    spread = over.agg(F.sum((F.col("c") - mean) ** 2 - mean).alias("more"), F.sum(mean ** 2).alias("square")).first()
    slope = min(slope, 64.0)
    return slope, rate * math.exp(slope * found["s"]), spread["square"] / max(spread["more"], 1e-3 * spread["square"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = 50_000, z_least: float = 3.3, least: float = 2.0, stem: int = STEM) -> dict:
    """The model: units, lambda, K, the counts' tail, and the logistic function of the evidence."""
    spark = docs.sparkSession
    rows = stored(training_rows(only(docs, doc_id="doc_id", text="text"), labels, "toxic", sample).select("text", "label", "fold"), "training")
    counts = rows.mapInArrow(partial(_call, _units, {"stem": stem}), "unit string, kind int, n long")
    units = stored(counts.groupBy("unit").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).cast("double").alias(f"k{k}") for k in range(4)]), "units")
    halves = [fit_units(units, ((0,), (1,)), z_least, least, terms), fit_units(units, ((2,), (3,)), z_least, least, terms)]
    whole = fit_units(units, ((0, 2), (1, 3)), z_least, least, terms)
    crossed = stored(rows.mapInArrow(partial(_call, _cross, {"models": spark.sparkContext.broadcast(halves), "stem": stem}), "label int, n long, best array<double>"), "crossed")
    tokens = crossed.where("label = -1").groupBy("n").agg(F.sum(F.col("best")[0]).alias("w")).collect()
    lam = solve_lambda(np.array([r["n"] / 100 for r in tokens]), np.array([r["w"] for r in tokens], float))
    spent = F.greatest(F.col("n"), F.lit(1)) * F.exp(-lam * F.coalesce(F.array_max("best"), F.lit(0.0)))
    clean = crossed.where("label = 0").agg(F.count("*").alias("n"), F.sum(spent).alias("sum")).first()
    k = clean["n"] / max(1e-12, clean["sum"]) if clean["n"] else 1.0
    tail = fit_tail(crossed.where("label = 0"), lam, k)
    scored = crossed.where("label >= 0").mapInArrow(partial(_call, _evidences, {"lam": lam, "k": k, "tail": tail}), "label int, evidence double").collect()
    y, x = (np.array([r[c] for r in scored], float) for c in ("label", "evidence"))
    clean = y == 0
    model = {"units": whole, "lambda": lam, "k": k, "tail": tail, "slope": 0.0, "constant": -30.0, "stem": stem}
    if clean.any() and not clean.all():
        share = (y.sum() + 1) / (len(y) + 2)
        targets = np.where(clean, 1 / (clean.sum() + 2), (y.sum() + 1) / (y.sum() + 2))
        slope, constant = logistic(x[:, None], targets, 1e-3)
        model |= {"slope": float(slope), "constant": float(constant)} if slope > 0 else {"constant": math.log(share / (1 - share))}
    elif len(y):
        model["constant"] = 30.0 if y.all() else -30.0
    return model


def _probability(model: dict, tokens: list[str], scores: _Scores) -> float:
    found = evidence([x[0] for x in _segments_of(tokens, scores)], len(tokens), model["lambda"], model["k"], model["tail"])
    x = model["slope"] * found + model["constant"]
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    scores = _Scores(model["units"], model["stem"])
    for batch in batches:
        found = [_probability(model, (t.as_py() or "").split(), scores) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])


def _segments(batches: Iterator[pa.RecordBatch], model, level: float) -> Iterator[pa.RecordBatch]:
    model = model.value
    scores = _Scores(model["units"], model["stem"])
    kinds = [("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64()), ("passage", pa.string())]
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            tokens = (text or "").split()
            listed = _segments_of(tokens, scores)
            order = sorted(range(len(listed)), key=lambda i: -listed[i][0])
            together = joint(np.array([listed[i][0] for i in order]), len(tokens), model["tail"]) + _choices(len(order))
            least = dict(zip(order, np.exp(np.minimum.accumulate(together[::-1])[::-1]).tolist(), strict=True))
            rows.append([])
            for i, (score, first, last) in enumerate(listed):
                p = min(least[i], -math.expm1(-model["k"] * len(tokens) * math.exp(-model["lambda"] * score)))
                if p < level:
                    rows[-1].append((first, last, score, p, " ".join(tokens[first : last + 1])))
        found = [[dict(zip([n for n, _ in kinds], x, strict=True)) for x in some] for some in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.struct(kinds)))], names=["doc_id", "passages"])


def _call(work, how, batches):
    return work(batches, **how)


def scored(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(partial(_call, _score, {"model": shared}), "doc_id long, score double")
    return found.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def listed(docs: DataFrame, model: dict, level: float = 0.01) -> DataFrame:
    """One row per row of docs: doc_id and all its significant passages, in order of place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_call, _segments, {"model": shared, "level": level}), SEGMENTS)


def passages(docs: DataFrame, model: dict, level: float = 0.01) -> DataFrame:
    """Every significant passage: place in words, score, probability (its own or, if smaller, that of a group
    of best passages it belongs to) and text."""
    return listed(docs, model, level).select("doc_id", F.inline("passages"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scored(docs, fit(docs, table(spark, folder, "labels")))


def passages_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return listed(docs, fit(docs, table(spark, folder, "labels")))
