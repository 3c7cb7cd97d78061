"""Vector codes against plain Python over whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from veilframe.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, vector string, _label string"
MOST = (1 << 63) - 1


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def expected(rows):
    """Counted list of results; rows are (vec_id, vector, label) that take part, vectors of one length."""
    rows = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = len(rows[0][1]) // 4
    cut = [[v[p * step : (p + 1) * step] for p in range(4)] for _, v, _ in rows]
    books = [[parts[p] for parts in cut[:256]] for p in range(4)]

    def nearest(p, part):
        return min((apart(part, e), i) for i, e in enumerate(books[p]))

    for _ in range(4):
        assigned = [[nearest(p, parts[p])[1] for parts in cut] for p in range(4)]
        for p in range(4):
            for e in set(assigned[p]):
                mine = [parts[p] for parts, a in zip(cut, assigned[p], strict=True) if a == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, _, label), parts in zip(rows, cut, strict=True):
        found = [nearest(p, parts[p]) for p in range(4)]
        out.append([i, "".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), MOST), label, digest])
    total = {label: min(sum(o[2] for o in out if o[3] == label), MOST) for label in {o[3] for o in out}}
    return sorted(((i, code, error, total[label], digest) for i, code, error, label, digest in out), key=repr)


def coded(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, vc.compressed(frame).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("n, step, grain", [(400, 3, 8), (300, 2, 2), (5, 1, 4)])
def test_codes_with_ties_and_rows_that_take_no_part(spark, n, step, grain):
    pick = random.Random(n)
    good = [(pick.choice([None, *range(n)]), [pick.randrange(-grain, grain) / 1024 + pick.random() / 4096 for _ in range(4 * step)],
             pick.choice([None, 1, 2])) for _ in range(n)]
    good += good[:9]
    bad = [(1, None, 1), (2, [None] * 4 * step, 1), (3, [math.nan] * 4 * step, None), (4, [math.inf, *[0.0] * (4 * step - 1)], 2),
           (n, [0.0] * (4 * step + 1), 1), (n, [0.0] * 8 * step, 1), (0, [], 1), (0, [1e300] * 4 * step, 1)]
    assert coded(spark, good + bad) == expected(good)


def test_numbers_of_any_size_and_empty_tables(spark):
    pick = random.Random(1)
    rows = [(i, [pick.choice([0.0, 1.5, -3e9, 4e9, 2.0**50, -(2.0**51)]) + pick.random() for _ in range(8)], i % 2) for i in range(280)]
    assert coded(spark, rows) == expected(rows)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []


def test_boxes_hold_the_nearest_entry():
    """The masks are the entries of the box, and search equals measuring all entries."""
    rng = np.random.default_rng(0)
    entries = rng.integers(-50, 50, (256, 4))
    rows = rng.integers(-300, 300, (500, 4))
    book = vc.Slices(entries)
    bits = np.unpackbits(book.inside(rows, np.full(500, 90)).view(np.uint8).reshape(500, -1), axis=1, bitorder="little")
    assert (bits.astype(bool) == (np.abs(rows[:, None] - entries).max(axis=2) <= 90)).all()
    all_apart = ((rows[:, None] - entries) ** 2).sum(axis=2)
    found, error = book.nearest(rows)
    assert (found == all_apart.argmin(axis=1)).all() and (error == all_apart.min(axis=1)).all()
