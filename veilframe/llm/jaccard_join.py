"""Components of documents with similar sets of word shingles: size-aware heavy-light join.

A document's set holds its distinct runs of `k` words (A-Z lowered).  Two sets of sizes s and t have
Jaccard similarity p/100 or more exactly if they share c(s, t) = ceil(p (s + t) / (100 + p)) elements.

Light sets, up to a boundary size: enumerate all subsets of c(s, t) elements for each size t that can
match.  Two sets meet in a subset exactly if they are similar, so a meeting is a link, and linking each
member to the smallest of the other size connects all of them without emitting their pairs.  Heavier
sets: scan inverted lists.  Elements are ordered by an approximate document frequency (a sketch of fixed
size, so the order is common to all; rarer first), and only the first s - ceil(p s / 100) + 1 elements are
listed, of which similar sets share one.  The boundary is the size with the smallest estimated cost,
from the numbers of sets by size (up to 64) and the subsets and list entries they would make.

Equal sets become one before anything is joined.  In a list of up to 8 members all pairs in reach are
compared.  In a longer one every member is first compared with the most central one (the one whose other elements
are listed most); lists whose members are then in one component are finished, so a large group of near copies
costs one comparison for each.  For the others all pairs of members in different components are compared that can reach the overlap by size, by their places in the
list (the meeting counts where it can be the pair's first) and by the difference of their parity bitmaps of 256 and 1,024 bits; lists longer than `block` are cut into blocks for that.  No cap is set on lists or partners.
Pairs of larger sets must also agree by bitmaps of a bit or two for each element before their sets move.  Comparisons are on whole sets of 64-bit shingle
hashes.

The sketch bounds how long a list can be.  Entries of lists that it shows to be at most 4 / 2^20 of all
elements (and 1,000) long are counted where one shuffle by token brings them together; other lists are
counted first and joined, which Spark splits where a key is hot.

Cases: fewer words than k are one shingle, the whole sequence; null, empty or blank text has no
shingles and its own component; rows with the same doc_id are one node; a null doc_id has a null
component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import hashing as hs
from .common import only, packed, stored, table, text_buffers, unpacked
from .components import components

CELLS, PART = 1 << 20, 1 << 11
SMALL = 64
SHORT_LIST = 8  # members; all pairs in reach of such a list are compared at once
LIST_COST = 4.0  # of one entry of an inverted list, in subsets
BITS = [f"b{i}" for i in range(4)]
BOUNDED = 1000  # entries of a list, beside 4 / 2^20 of all elements, that one shuffle may bring together
NARROW = 256  # bits of BITS; larger sets have a bitmap of their own size as well
WIDE = [f"w{i}" for i in range(16)]  # of sets larger than NARROW, where lists are compared member by member
ID_BITS = 1 << 24
SETS = "doc_id long, n long, d1 long, d2 long, " + ", ".join(f"{b} long" for b in BITS + WIDE) + ", odd binary, cold int, prefix array<long>, subsets array<struct<key:long,side:int>>"


def overlap(s: int, t: int, p: int) -> int:
    return -(-p * (s + t) // (100 + p))


def partners(s: int, p: int) -> range:
    return range(-(-p * s // 100), 100 * s // p + 1)


def subset_sizes(s: int, boundary: int, p: int) -> list[tuple[int, int]]:
    """(t, c) for the sizes t whose pairs with s are found by subsets."""
    return [(t, overlap(s, t, p)) for t in partners(s, p) if min(s, t) <= boundary and overlap(s, t, p) <= min(s, t)]


def choose_boundary(sizes: list[int], p: int) -> int:
    """The size with the smallest cost; sizes[s] is the number of sets of s elements."""
    best, least = 0, math.inf
    for x in range(len(sizes) * p // 100):
        light = sum(n * sum(math.comb(s, c) for _, c in subset_sizes(s, x, p)) for s, n in enumerate(sizes) if s and n)
        heavy = sum(n * LIST_COST * (s - -(-p * s // 100) + 1) for s, n in enumerate(sizes) if s > x)
        if light + heavy < least:
            best, least = x, light + heavy
    return best


def _doc_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Place in the batch and sorted distinct shingle hashes of each document."""
    data, offsets = text_buffers(batch.column("text"))
    for i, j in hs.pieces(offsets):
        starts, ends, counts = hs.word_places(data, offsets[i : j + 1])
        words = hs.word_hashes(data, starts, ends, lower=True)
        a, _, owner = hs.run_hashes(words, counts, k)
        cuts = np.searchsorted(owner, np.arange(j - i + 1))
        place = 0
        for d, n in enumerate(counts.tolist()):
            if n >= k:
                yield i + d, np.unique(a[cuts[d] : cuts[d + 1]])
            elif n:
                whole = hs.run_hashes((words[0][place : place + n], words[1][place : place + n]), np.array([n]), n)[0]
                yield i + d, hs.mixed(whole + np.uint64(n))
            else:
                yield i + d, np.zeros(0, np.uint64)
            place += n


def _count(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sketch of document frequencies, in parts, and numbers of sets by size (part -1)."""
    cells, sizes = np.zeros(CELLS, np.int64), np.zeros(SMALL + 1, np.int64)
    for batch in batches:
        for _, found in _doc_sets(batch, k):
            np.add.at(cells, (found & np.uint64(CELLS - 1)).astype(np.int64), 1)
            if len(found) <= SMALL:
                sizes[len(found)] += 1
    if cells.any() or sizes.any():
        rows = [(-1, hs.small(sizes))] + [(i // PART, hs.small(cells[i : i + PART])) for i in range(0, CELLS, PART)]
        yield pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int32()), "body": pa.array([r[1] for r in rows], pa.binary())})


def _add(part: pa.Table) -> pa.Table:
    total = sum(hs.unpacked(x.as_py()) for x in part.column("body"))
    counts = np.diff(total, prepend=np.uint64(0)).astype(np.int64) - part.num_rows
    return pa.table({"part": part.column("part")[:1], "body": pa.array([counts.tobytes()], pa.binary())})


def _parities(mixed: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap in bytes: whether an odd number of elements falls on each of the bits, a power of two."""
    place = ((mixed >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8))


def _sets(batches: Iterator[pa.RecordBatch], k: int, p: int, boundary: int, cells, most: float) -> Iterator[pa.RecordBatch]:
    cells = cells.value
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        rows = []
        for d, found in _doc_sets(batch, k):
            n = len(found)
            mixed = hs.mixed(found)
            prefix, subsets, cold = [], [], 0
            if n and ids[d] is not None:
                if 100 * n // p > boundary:
                    often = cells[(found & np.uint64(CELLS - 1)).astype(np.int64)]
                    first = np.lexsort((mixed, often))[: n - -(-p * n // 100) + 1]
                    prefix, cold = found[first].view(np.int64), int((often[first] <= most).sum())
                for t, c in subset_sizes(n, boundary, p):
                    salt = np.uint64((min(n, t) * 1_000_003 + max(n, t)) & 0xFFFFFFFF)
                    side = 0 if n == t else 1 if n < t else 2
                    left = np.array(list(itertools.combinations(range(n), n - c)), np.int64).reshape(math.comb(n, c), n - c)
                    sums = mixed.sum(dtype=np.uint64) - mixed[left].sum(axis=1, dtype=np.uint64)
                    keys = hs.mixed(sums ^ hs.mixed(np.array([salt])))
                    subsets += [{"key": key, "side": side} for key in keys.view(np.int64).tolist()]
            d1 = int(mixed.sum(dtype=np.uint64).view(np.int64))
            d2 = int(hs.mixed(mixed ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64))
            odd = _parities(mixed, 1 << (n - 1).bit_length()).tobytes() if n > NARROW else None
            wide = _parities(mixed, 64 * len(WIDE)).view(np.int64).tolist() if n > NARROW else [0] * len(WIDE)
            rows.append((ids[d], n, d1, d2, *_parities(mixed, NARROW).view(np.int64).tolist(), *wide, odd, cold, prefix, subsets))
        kinds = [pa.int64()] * (4 + len(BITS + WIDE)) + [pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("key", pa.int64()), ("side", pa.int32())]))]
        names = ["doc_id", "n", "d1", "d2", *BITS, *WIDE, "odd", "cold", "prefix", "subsets"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names=names)


def _full(batches: Iterator[pa.RecordBatch], k: int, wanted) -> Iterator[pa.RecordBatch]:
    """Whole sets of the documents whose place is marked for either side, with the marks."""
    sides = wanted.value
    for batch in batches:
        place = batch.column("place").to_numpy(zero_copy_only=False).astype(np.int64)
        marks = [(side[place >> 3] >> (place & 7) & 1).astype(bool) for side in sides]
        either = marks[0] | marks[1]
        some = pa.Table.from_batches([batch]).filter(pa.array(either)).combine_chunks()
        if some.num_rows:
            sets = [found.view(np.int64) for _, found in _doc_sets(some, k)]
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id").combine_chunks(), *[pa.array(m[either]) for m in marks], pa.array(sets, pa.list_(pa.int64()))],
                names=["doc_id", "in_a", "in_b", "shingles"],
            )


def _call(work, how, part):
    return work(part, **how)


def _needed(p: int) -> Column:
    return F.ceil(p * (F.col("an") + F.col("bn")) / F.lit(100.0 + p) - F.lit(1e-9))


def _in_reach(p: int) -> Column:
    """Whether sets of sizes an and bn that meet at places ap and bp of their orders can reach the overlap with this
    as their first common element: by size, and as the overlap must lie at and after both places.  Similar sets
    have a first common element, so each of their pairs is in reach at one token at least."""
    s, t, c = F.col("an"), F.col("bn"), _needed(p)
    return (100 * F.least(s, t) >= p * F.greatest(s, t)) & (s - F.col("ap") >= c) & (t - F.col("bp") >= c)


def _near(p: int, bits: list[str] = BITS) -> Column:
    """Whether the bitmaps allow it.  A bit holds the parity of the elements that fall on it, so the
    sets differ by as many elements as bits differ at least."""
    differ = sum((F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))) for b in bits), F.lit(0))
    return differ <= F.col("an") + F.col("bn") - 2 * _needed(p)


def _near_wide(p: int) -> Column:
    """The same with the wide bitmaps, which only sets larger than NARROW have."""
    return (F.least("an", "bn") <= NARROW) | _near(p, WIDE)


def _facts(classes: DataFrame, x: str) -> DataFrame:
    return classes.select(F.col("rep").alias(x), F.col("n").alias(f"{x}n"), *[F.col(b).alias(f"{x}_{b}") for b in BITS])


def _places(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(ID_BITS)) + 1


def _marks(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids; bucket i holds the places from 32768 (i - 1) + 1 to 32768 i."""
    place = ids.select(_places(F.col("id")).alias("place"))
    found = place.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(ID_BITS // 8, np.uint8)
    for r in found.collect():
        start = 4096 * (r["bucket"] - 1)
        bits[start : start + len(r["bits"])] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def _differ(x: pd.Series, y: pd.Series) -> pd.Series:
    """Differing bits of two bitmaps, the longer one folded to the length of the other; 0 without both."""
    out = np.zeros(len(x), np.int64)
    for i, (u, v) in enumerate(zip(x, y, strict=True)):
        if u is not None and v is not None:
            size = min(len(u), len(v))
            u, v = (np.bitwise_xor.reduce(np.frombuffer(w, np.uint8).reshape(-1, size)) for w in (u, v))
            out[i] = np.bitwise_count(u ^ v).sum()
    return pd.Series(out)


def _close(pairs: DataFrame, classes: DataFrame, p: int) -> DataFrame:
    """The pairs that the bitmaps of the sets' own sizes allow."""
    for x in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("rep").alias(x), F.col("n").alias(f"{x}n"), F.col("odd").alias(f"{x}_odd")), x)
    differ = F.pandas_udf(_differ, "long")("a_odd", "b_odd")
    return pairs.withColumn("differ", differ).where(F.col("differ") <= F.col("an") + F.col("bn") - 2 * _needed(p)).select("a", "b")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, k: int, p: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar.

    Which documents are on either side of a pair goes to the tasks as two bitmaps of hashed ids, of fixed
    size; they let all of them through and few others, so that texts of other documents are neither hashed
    nor shuffled, and sets move only for the sides on which they are needed.
    """
    pairs = stored(_close(stored(pairs.distinct(), "met"), classes, p), "pairs")
    sides = [_marks(pairs.select(F.col(x).alias("id"))) for x in ("a", "b")]
    shared = rows.sparkSession.sparkContext.broadcast(sides)
    placed = rows.where("doc_id IS NOT NULL").select("doc_id", "text", (_places(F.col("doc_id")) - 1).alias("place"))
    sets = stored(placed.mapInArrow(partial(_call, _full, {"k": k, "wanted": shared}), "doc_id long, in_a boolean, in_b boolean, shingles array<long>"), "shingles")
    both = F.size(F.array_intersect("x", "y"))
    united = F.size("x") + F.size("y") - both
    left = sets.where("in_a").select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.where("in_b").select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return stored(pairs.join(left, "a").join(right, "b").where(100 * both >= p * united).select("a", "b"), "similar")


def similar_components(docs: DataFrame, k: int = 3, p: int = 90, key: str = "doc_id", text: str = "text", block: int = 2048) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    rows = only(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    counted = rows.select("text").mapInArrow(partial(_call, _count, {"k": k}), "part int, body binary")
    parts = {r["part"]: np.frombuffer(bytes(r["body"]), np.int64) for r in counted.groupBy("part").applyInArrow(_add, "part int, body binary").collect()}
    boundary = choose_boundary(parts.pop(-1, np.zeros(SMALL + 1)).tolist(), p)
    cells = np.concatenate([parts[i] for i in sorted(parts)]) if parts else np.zeros(CELLS, np.int64)
    how = {"k": k, "p": p, "boundary": boundary, "cells": spark.sparkContext.broadcast(cells), "most": BOUNDED + 4 * float(cells.mean())}
    # Made twice, once with the lists for the classes and once without: cheaper than storing both.
    made = rows.mapInArrow(partial(_call, _sets, how), SETS)
    sets = stored(made.select("doc_id", "n", "d1", "d2"), "sets")

    classes = stored(made.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("subsets").alias("subsets"),
        F.first("odd").alias("odd"), F.first("cold").alias("cold"), *[F.first(b).alias(b) for b in BITS + WIDE]
    ), "classes")
    links = _light(classes).unionByName(_heavy(rows, classes, k, p, block))
    # A document id can stand on several rows, with several sets.
    same = sets.where("n > 0 AND doc_id IS NOT NULL").join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"]).select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b")
    )
    found = components(links.unionByName(same.where("a <> b")))
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def _light(classes: DataFrame) -> DataFrame:
    """Links from subsets: the members of one size with the smallest of the other."""
    met = classes.select("rep", F.explode("subsets").alias("s")).select("rep", "s.key", "s.side")
    least = met.groupBy("key").agg(
        F.min(F.when(F.col("side") != 2, F.col("rep"))).alias("low"), F.min(F.when(F.col("side") != 1, F.col("rep"))).alias("high"), F.count("*").alias("m")
    ).where("m > 1 AND low IS NOT NULL AND high IS NOT NULL")
    other = F.when(F.col("side") == 1, F.col("high")).otherwise(F.col("low"))
    return met.join(least, "key").select(F.col("rep").alias("a"), other.alias("b")).where("a <> b").distinct()


def _heavy(rows: DataFrame, classes: DataFrame, k: int, p: int, block: int) -> DataFrame:
    """Links from inverted lists."""
    entries = classes.select("rep", "n", "cold", F.posexplode("prefix").alias("pos", "token"))
    entries = entries.select("token", "rep", (F.shiftleft("n", 24) + F.col("pos")).alias("place"), (F.col("pos") < F.col("cold")).alias("is_cold"))
    bounded, others = entries.where("is_cold").drop("is_cold"), entries.where("NOT is_cold").drop("is_cold")
    bounded = bounded.withColumn("m", F.count("*").over(Window.partitionBy("token"))).where("m > 1")
    others = others.join(others.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"), "token")
    listed = stored(bounded.unionByName(others).select(
        "token", "rep", F.shiftright("place", 24).alias("n"), (F.col("place") % (1 << 24)).alias("pos"), "m"
    ), "listed")

    def side(members: DataFrame, x: str, *more: Column) -> DataFrame:
        return members.select("token", F.col("rep").alias(x), F.col("n").alias(f"{x}n"), F.col("pos").alias(f"{x}p"), *more)

    short, long_ = listed.where(F.col("m") <= SHORT_LIST), listed.where(F.col("m") > SHORT_LIST)
    pairs = side(short, "a").join(side(short, "b"), "token").where((F.col("a") > F.col("b")) & _in_reach(p)).select("a", "b")

    central = long_.groupBy("rep").agg((F.sum("m") / F.first("n")).alias("central"))
    ranked = long_.join(central, "rep").select("token", F.struct("central", (-F.col("rep")).alias("least"), "n", "pos").alias("member"))
    best = ranked.groupBy("token").agg(F.max("member").alias("best")).select(
        "token", (-F.col("best.least")).alias("b"), F.col("best.n").alias("bn"), F.col("best.pos").alias("bp")
    )
    stars = side(long_, "a").join(best, "token").where((F.col("a") != F.col("b")) & _in_reach(p)).select("a", "b")
    both = pairs.unionByName(stars).distinct().join(_facts(classes, "a"), "a").join(_facts(classes, "b"), "b").where(_near(p))
    links = _verified(both.select("a", "b"), rows, classes, k, p)

    part = F.coalesce("component", "rep").alias("part")
    labelled = stored(long_.drop("m").join(components(links), F.col("rep") == F.col("node"), "left").select("token", "rep", "n", "pos", part), "labelled")
    open_ = labelled.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("m")).where("low < high")
    open_ = open_.select("token", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    rest = stored(labelled.join(open_, "token").join(classes.select("rep", *BITS, *WIDE), "rep"), "open")

    def marked(x: str, i: Column) -> DataFrame:
        return side(rest, x, i.alias("i"), F.col("part").alias(f"{x}part"), *[F.col(b).alias(f"{x}_{b}") for b in BITS + WIDE])

    left = marked("a", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    right = marked("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = left.join(right, ["token", "i"]).where((F.col("apart") < F.col("bpart")) & _in_reach(p) & _near(p) & _near_wide(p))
    return links.unionByName(_verified(others.select("a", "b"), rows, classes, k, p))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, p: int = 90) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest doc_id, nulls last, then
    any one.  Rows are told apart by a number in a stored copy, so repeated and null ids are linked row by row."""
    rows = stored(packed(docs, place=F.monotonically_increasing_id()), "rows")
    texts = rows.select("place", F.col("row").getField(text).alias("text"))
    found = similar_components(texts, k, p, "place").select(F.col("doc_id").alias("place"), F.col("component_id").alias("part"))
    id_ = F.col("row").getField(key)
    keep = rows.select("place", F.struct(id_.isNull(), id_.alias("id"), "place").alias("order")).join(found, "place").groupBy("part").agg(F.min("order").alias("best"))
    return unpacked(rows.join(keep.select("best.place"), "place", "left_semi"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return similar_components(table(spark, folder, "documents"))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) g FROM t),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id root FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT t.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(r.root) component_id FROM t JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY t.doc_id
"""
