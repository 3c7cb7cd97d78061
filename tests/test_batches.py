"""Texts worked on in batches: the same results as pattern by pattern and row by row, at a small part of the tries."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import plain
from test_detect import CASES, ODD, generated_texts
from test_tokens import entity_lists, span
from veilframe.functions import fixed_values as fv, sweep
from veilframe.functions.types import ENTRY, SPAN
from veilframe.operators import detect as d, tokens as t, validate as v
from veilframe.plans import flows


def in_force(threshold):
    return tuple((i, *rule) for i, rule in enumerate(fv.PATTERNS) if rule[1] >= threshold)


def swept(texts, threshold=0.7):
    rows = sweep.spans(pa.array([x if x is None or isinstance(x, bytes) else x.encode() for x in texts], pa.binary()), in_force(threshold))
    return [None if row is None else [tuple(s.values()) for s in row] for row in rows.to_pylist()]


def test_a_sweep_finds_what_each_pattern_finds():
    """Generated matches of all patterns, alone, in a row and next to each other in a batch, and in other scripts."""
    texts = [x for x in generated_texts() if not any(0xD800 <= ord(c) < 0xE000 for c in x)]
    texts += [x for x, _ in CASES] + [x.swapcase() for x, _ in CASES] + ODD
    texts += [" ".join(texts[i::97]) for i in range(97)]
    texts += ["Привет мир a@b.it", "保険 INS-123456 東京 €5", "ΑΒΓ 12/11/2020", "K@k.it", "YA1234567", "passaporto:\n", "12/1", "1/2020", "", "@", "x"]
    for threshold in (0.0, 0.7):
        got = swept(texts, threshold)
        for text, found in zip(texts, got):
            assert found is None and any(len(x) >= sweep.RUN for x in text.split(" ")) or found == plain.spans(text, threshold), repr(text)
        assert sum(found is None for found in got) < len(texts) / 20


def test_what_a_sweep_leaves():
    """Nulls, bytes that are no text and long runs are left to the scans; a neighbour in the batch is not."""
    long = [" " * 40, "x" * 40, "1." * 20]
    rows = [None, b"\xff a@b.it", *(f"a{x}b" for x in long), "a@b.it", "x" * 39 + " 1"]
    got = swept(rows)
    assert [found is None for found in got] == [True] * 5 + [False] * 2 and len(got[5]) == 1


def test_few_places_are_tried():
    """Labels and shapes of eight characters leave a few tries for each find, not one for each pattern and word."""
    text = " ; ".join(x for x, _ in CASES if "  " not in x) + " parola comune senza dati" * 40
    sweeper = sweep._Sweeper(in_force(0.7))
    codes = np.concatenate([[10], np.minimum([ord(x) for x in text], sweep.TABLE), [10] * sweep.WIDTH])
    tried = sum(map(len, sweeper._places(codes).values()))
    assert tried < 5 * len(plain.spans(text)) and tried < len(text) / 4


def test_checksums_of_batches():
    rng = random.Random(2)
    for name, check in sweep.CHECKS.items():
        values = ["".join(rng.choice("0123456789AZ -") for _ in range(rng.randint(0, 28))) for _ in range(300)]
        values += ["4532015112830366", "4532 0151-12830366", "02182080396", "IT60X0542811101000000123456", "it60 x054 2811 1010 0000 0123 456", "RSSMRA80A01H501U", "rssmra80a01h501u", "²²"]
        assert [check(x) for x in values] == [plain.passes(name, x) for x in values]


def test_detection_in_batches_and_by_scans(spark):
    """A text that the sweep leaves has the spans of the scans; its neighbours those of the sweep."""
    texts = ["a@b.it " + "x" * 50, "c@d.it", None, "", "Passaporto: YA1234567 " + "1." * 30, f"x{d.MARK} a@b.it"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    frame = d.with_rule_spans(rows)
    assert "swept(" in frame._jdf.queryExecution().analyzed().toString() and frame.columns == ["i", "text", "spans"]
    got = {r.i: [tuple(s) for s in r.spans] for r in frame.collect()}
    assert got == {i: plain.spans(x) if x else [] for i, x in enumerate(texts)}
    assert "swept(" not in d.with_rule_spans(rows, types=["EMAIL", "IP"])._jdf.queryExecution().analyzed().toString()


def test_anonymising_and_checking_in_batches(spark):
    """Both ways give the same rows, also for those that a batch leaves."""
    cases = list(entity_lists(random.Random(8)))
    word = lambda a, b, value, type_="ORG": span(a, b, value, type_)
    cases += [("ΑΣ x", [word(0, 2, "ΑΣ")]), ("€5 $", [word(0, 2, "€5")]), ("ab", [word(1, 2, "b"), word(0, 1, "a")]), ("abc", [word(0, 2, "ab"), word(1, 3, "bc")]),
              ("a", [word(0, 1, None)]), ("a", None), (None, []), (None, [word(0, 1, "a")]), ("a b", [word(0, 1, "a", None)]), ("[ORG_009] a", [word(10, 11, "a")]), ("", [])]
    rows = spark.createDataFrame([(i, x, e) for i, (x, e) in enumerate(cases)], f"i int, text string, entities array<{SPAN}>").repartition(3)
    both = [{r.i: r for r in v.check_anonymised(t.anonymise(rows, many=many), many=many).collect()} for many in (False, True)]
    assert both[0] == both[1] and len(both[0]) == len(cases)
    maps = [("[a_001] [A_001] [B_002]", [("[A_001]", "x")]), ("x y", [("[A_001]", "x"), ("[A_002]", None), (None, "y")]), ("ß", [("[Ä_001]", "ß")]), ("a", None), (None, [("[A_001]", "x")]), ("a", [("[A_001]", "")]), ("y" * 40, [("[A_001]", "y" * 35)])]
    made = spark.createDataFrame([(i, *m) for i, m in enumerate(maps)], f"i int, anonymized_text string, entity_map array<{ENTRY}>")
    both = [{r.i: r.validation for r in v.check_anonymised(made, many=many).collect()} for many in (False, True)]
    assert both[0] == both[1]


def test_flows_work_in_batches_where_many_rules_are_in_force(spark):
    rows = spark.createDataFrame([(1, "Mail a@b.it, Tel. +39 333 1234567")], "i int, text string")
    plan = lambda frame: frame._jdf.queryExecution().analyzed().toString()
    for flow, names in ((flows.anonymise_only, ("swept(", "anonymised_batch(", "errors_batch(")), (flows.redacted, ("swept(", "anonymised_batch("))):
        assert all(name in plan(flow(rows)) for name in names)
        assert not any(name in plan(flow(rows, types=["EMAIL"])) for name in names)
    assert flows.anonymise_only(rows).first().anonymized_text == "Mail [EMAIL_001], Tel. [PHONE_001]"
    assert flows.anonymise_only(rows).select(F.col("validation.is_valid")).first()[0]
