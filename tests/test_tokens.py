import random
import time

from pyspark.sql import functions as F

import plain
from conftest import SF_SMALL
from veilframe.functions import lookup, substrings, text as tx
from veilframe.functions.arrays import pieces
from veilframe.operators import joins, restore as r, tokens as t, validate as v, validate as vd
from veilframe.operators.detect import detect
from veilframe.operators.resolve import resolve
from veilframe.functions.types import ENTRY, SPAN


def span(start, end, value, type_, confidence=0.9, source="rule", ord_=0):
    return (start, end, value, type_, confidence, source, ord_)


def resolved(spark, lists):
    rows = spark.createDataFrame(list(enumerate(lists)), f"i int, s array<{SPAN}>")
    got = rows.select("i", resolve(F.col("s")).alias("s")).collect()
    return [[tuple(x) for x in row.s] for row in sorted(got)]


def test_boost_and_overlap_cases(spark):
    agree = [span(0, 14, "x", "EMAIL", 0.90), span(0, 14, "x", "EMAIL", 0.85, "presidio", 1)]
    high = [span(0, 9, "x", "EMAIL", 0.97), span(0, 9, "x", "EMAIL", 0.97, "spacy", 1)]
    nested = [span(0, 17, "a", "ADDR", 0.8), span(12, 17, "c", "CAP", 0.9)]
    chain = [span(0, 10, "a", "ADDR"), span(5, 8, "b", "CAP"), span(10, 20, "c", "CAP")]
    earliest = [span(5, 30, "b", "ADDR"), span(0, 10, "a", "CAP")]
    got = resolved(spark, [agree, high, nested, chain, earliest, []])
    assert [len(x) for x in got] == [1, 1, 1, 2, 1, 0]
    assert abs(got[0][0][4] - 0.95) < 1e-9 and got[1][0][4] == 0.99
    assert got[2][0][3] == "ADDR" and got[4][0][:2] == (0, 10)
    assert got == [plain.resolve(x) for x in [agree, high, nested, chain, earliest, []]]


def random_spans(rng, n, width):
    out = []
    for i in range(n):
        start = rng.randrange(width)
        out.append(span(start, start + rng.randrange(1, 9), "v", rng.choice(["A", "B"]),
                        rng.choice([0.7, 0.8, 0.85]), rng.choice(["rule", "spacy", "gliner"]), i))
    return out


def test_resolve_against_plain(spark):
    rng = random.Random(3)
    lists = [random_spans(rng, n, w) for n in (1, 5, 40) for w in (10, 60) for _ in range(25)]
    lists.append(random_spans(rng, 1500, 4000))
    assert resolved(spark, lists) == [plain.resolve(x) for x in lists]


def entity_lists(rng):
    for n in (0, 1, 2, 7, 30, 700):
        for _ in range(12 if n < 100 else 1):
            text, entities, at = "", [], 0
            for _ in range(n):
                gap = rng.choice(["", " ", "é😀 ", "[PERSON_001] ", "word. "])
                value = rng.choice(["Mario", " mario ", "ANNA", "x@y.it", "a\\1", "3", "Ünal", "😀"]) + (
                    str(rng.randrange(n)) if rng.random() < 0.5 else "")
                at += len(gap)
                entities.append(span(at, at + len(value), value, rng.choice(["PERSON", "EMAIL", "ORG"])))
                text += gap + value
                at += len(value)
            yield text + rng.choice(["", " end"]), entities


def test_numbering_splicing_validation_and_restore(spark):
    cases = list(entity_lists(random.Random(5)))
    rows = spark.createDataFrame(
        [(i, text, e) for i, (text, e) in enumerate(cases)],
        f"i int, text string, entities array<{SPAN}>").repartition(8)
    done = v.check_anonymised(t.anonymise(rows))
    back = r.restore(done)
    final = back.withColumn("final", v.restored_result(F.col("rehydrated_text"), F.col("entity_map")))
    for row in final.collect():
        text, entities = cases[row.i]
        anonymised, mapping = plain.anonymise(text, entities)
        assert row.anonymized_text == anonymised
        assert [tuple(e) for e in row.entity_map] == list(mapping.items())
        assert row.validation.errors == plain.check_anonymised(anonymised, mapping)
        assert row.validation.is_valid == (not row.validation.errors)
        restored = plain.restore(anonymised, mapping)
        assert row.rehydrated_text == restored
        assert row.final.errors == plain.check_restored(restored, mapping)


def test_token_rules(spark):
    text = "Mario Rossi e Luigi Verdi, mario rossi"
    entities = [span(0, 11, "Mario Rossi", "PERSON"), span(14, 25, "Luigi Verdi", "PERSON"),
                span(27, 38, "mario rossi", "ORG")]
    rows = spark.createDataFrame([(text, entities)], f"text string, entities array<{SPAN}>")
    row = t.redact(t.highlight(t.anonymise(rows))).first()
    assert row.anonymized_text == "[ORG_001] e [PERSON_001], [ORG_001]"
    assert [tuple(e) for e in row.entity_map] == [("[ORG_001]", "Mario Rossi"), ("[PERSON_001]", "Luigi Verdi")]
    assert row.highlighted_text == (
        "{Mario Rossi|PERSON:0.90} e {Luigi Verdi|PERSON:0.90}, {mario rossi|ORG:0.90}")
    assert row.redacted_text == "[REDACTED] e [REDACTED], [REDACTED]"
    assert rows.select(tx.token(F.lit("ORG"), F.lit(1000))).first()[0] == "[ORG_1000]"


RESTORE = [
    ("[ORG_0011] e [ORG_001]", [("[ORG_001]", "Acme"), ("[ORG_0011]", "Globex")], "Globex e Acme"),
    ("[person_001] [Person_001]x", [("[PERSON_001]", "Ann")], "Ann Annx"),
    ("a [X_001] b", [("[X_001]", r"C:\1\g<name> $1")], r"a C:\1\g<name> $1 b"),
    ("[A_001][B_001]", [("[A_001]", "[B_001]"), ("[B_001]", "z")], "[B_001]z"),
    ("nothing", [("[A_001]", "x")], "nothing"),
    ("[A_002] stays", [("[A_001]", "x")], "[A_002] stays"),
    ("[A_001]", [], "[A_001]"),
]


def test_restore_cases(spark):
    rows = spark.createDataFrame(RESTORE, f"text string, entity_map array<{ENTRY}>, want string")
    got = rows.select("want", r.restored(F.col("text"), F.col("entity_map")).alias("a"),
                      r.restored_any_keys(F.col("text"), F.col("entity_map")).alias("b")).collect()
    for row in got:
        assert row.a == row.want and row.b == row.want
    free = spark.createDataFrame([("Foo foobar", [("foo", "1"), ("foobar", "2")])],
                                 f"t string, m array<{ENTRY}>")
    assert free.select(r.restored_any_keys(F.col("t"), F.col("m"))).first()[0] == "1 2"


def test_large_map_restores(spark):
    entries = [(f"[PERSON_{i:03d}]", f"Name {i}") for i in range(1, 20001)]
    text = " ".join(f"[PERSON_{i:03d}]" for i in range(1, 5001))
    rows = spark.createDataFrame([(text, entries)], f"t string, m array<{ENTRY}>")
    got = rows.select(r.restored(F.col("t"), F.col("m"))).first()[0]
    assert got == " ".join(f"Name {i}" for i in range(1, 5001))


def test_table_forms(spark):
    texts = spark.createDataFrame(
        [(1, "a", "[PERSON_001] [person_002]"), (2, "a", "[X_001]"), (3, "b", "resto: [PERSON_1000]"), (4, "c", "-")],
        "id int, scope string, response string")
    mapping = spark.createDataFrame([("a", "[PERSON_001]", "Ann"), ("a", "[PERSON_002]", "Bob"),
                                     ("b", "[PERSON_1000]", "Cy")], "scope string, token string, value string")
    got = {x.id: x.rehydrated_text for x in r.restore_from_table(texts, mapping, "scope", "id").collect()}
    assert got == {1: "Ann Bob", 2: "[X_001]", 3: "resto: Cy", 4: "-"}
    unknown = v.unknown_tokens(texts, mapping, "scope", text="response").collect()
    assert [x.token for x in unknown] == ["[X_001]"]
    errors = {x.token: x.error for x in v.leftover_tokens(texts, mapping, "scope", text="response").collect()}
    assert errors["[X_001]"] == "Placeholder inventato dall'LLM: [X_001]"
    assert errors["[PERSON_1000]"] == "Token non sostituito nella risposta finale: [PERSON_1000]"


def test_hot_key_join(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"))
    per_key = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = joins.join_hot_keys(rows, per_key, "k", hot_rows=500)
    want = rows.join(per_key, "k", "left")
    assert got.count() == 5000 and got.exceptAll(want.select(got.columns)).count() == 0


def test_round_trip_over_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    done = r.restore(v.check_anonymised(t.anonymise(detect(docs))))
    for row in done.collect():
        entities = plain.resolve(plain.spans(row.text))
        anonymised, mapping = plain.anonymise(row.text, entities)
        assert row.anonymized_text == anonymised
        assert dict(map(tuple, row.entity_map)) == mapping
        assert row.rehydrated_text == plain.restore(anonymised, mapping)


def test_gate(spark):
    rows = spark.createDataFrame([("Mario lavora", [("[PERSON_001]", "Mario")]), ("[PERSON_001]", [("[PERSON_001]", "Mario")])],
                                 f"anonymized_text string, entity_map array<{ENTRY}>")
    passed, held = v.gate(v.check_anonymised(rows))
    assert passed.count() == 1
    row = held.first()
    assert row.validation.errors == ["Dato originale trapelato nel testo anonimizzato: 'Mario'"] and row.reason


def test_leaks_by_signature(spark, monkeypatch):
    """The signature finds what a search for each value finds, at ends of pieces and for values of all lengths."""
    rng = random.Random(11)
    letters = "ab é😀1"
    rows = []
    for i in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        values = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(25)] + [None]
        values += [text[j:j + rng.randint(1, 12)] for j in range(0, len(text), 17)]
        rows.append((i, text, [(f"[X_{n:03d}]", v) for n, v in enumerate(values)]))
    rows += [(100, "", [("[X_001]", "a"), ("[X_002]", "")]), (101, "abc", []), (102, None, [("[X_001]", "a")])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, entries array<struct<token:string,value:string>>")
    monkeypatch.setattr(vd, "FEW", -1)
    monkeypatch.setattr(vd, "PIECE", 7)
    got = {r.doc_id: r.leaks for r in docs.select("doc_id", vd.leaked_values(F.col("text"), F.col("entries")).alias("leaks")).collect()}
    for i, text, entries in rows:
        want = [v for _, v in entries if v is not None and text is not None and v in text]
        assert (got[i] or []) == want, (text, entries)
    mapping = docs.select((F.col("doc_id") % 2).alias("scope"), F.explode("entries").alias("e")).select("scope", "e.token", "e.value")
    texts = docs.select("doc_id", (F.col("doc_id") % 2).alias("scope"), "text")
    for most in (7, 20_000):
        found = sorted(map(tuple, vd.leaks_of_table(texts, mapping, "scope", key="doc_id", text="text", most=most).collect()))
        told = {(i % 2, v) for i, _, entries in rows for _, v in entries if v is not None}
        assert found == sorted((i % 2, i, v) for i, text, _ in rows if text is not None for s, v in told if s == i % 2 and v in text)


def test_leaks_of_a_table_in_one_pass(spark):
    """No row holds a scope's values; values of all lengths, some across the borders of slices, and rows that repeat."""
    long = "".join(chr(97 + i * i % 23) for i in range(700)) + "è€😀fine"
    values = ["", "x", "€", "bad", "è€😀f", "abcdefg", "abcdefgh", "abcdefghi", long, long[350:650], "nowhere to be found", None]
    texts = [(1, "u", long), (1, "u", long), (7, "u", "y" * (substrings.SLICE - 100) + long), (None, "u", "zabcdefghz €"), (2, "w", "bad"), (3, "u", None), (4, None, "bad"), (5, "u", ""), (6, "u", "aabcdefg")]
    mapping = spark.createDataFrame([("u", "t", v) for v in values] + [("w", "t", "bad"), (None, "t", "bad")], "scope string, token string, value string")
    docs = spark.createDataFrame(texts, "doc_id int, scope string, text string")
    leaks = vd.leaks_of_table(docs, mapping, "scope", key="doc_id", text="text")
    want = [("u", i, v) for i, s, t in texts if s == "u" and t is not None for v in values if v is not None and v in t] + [("w", 2, "bad")]
    assert sorted(map(repr, map(tuple, leaks.collect()))) == sorted(map(repr, want))
    assert "collect_list" not in leaks._jdf.queryExecution().optimizedPlan().toString()


def test_leak_check_of_a_large_map_is_linear(spark):
    """20,000 values against a text of a million characters."""
    values = [f"Nome{i * 7919 % 1000003:07d}x" for i in range(20_000)]
    text = " ".join(f"parola{i % 997} [PERSON_{i % 900:03d}]" for i in range(46_000)) + " ".join(values[::4000])
    docs = spark.createDataFrame([(1, text, [("[X_001]", v) for v in values])], "doc_id int, text string, entries array<struct<token:string,value:string>>")
    start = time.perf_counter()
    leaks = docs.select(vd.leaked_values(F.col("text"), F.col("entries")).alias("leaks")).first().leaks
    assert len(text) > 900_000 and leaks == values[::4000]
    assert time.perf_counter() - start < 30


def test_short_and_long_ways_agree(spark):
    """Few entities, tokens and spans are searched through, many are folded or merged."""
    cases = list(entity_lists(random.Random(9)))
    rows = spark.createDataFrame([(e,) for _, e in cases], f"e array<{SPAN}>")
    for row in rows.select(t._numbered_by_search(F.col("e")).alias("a"), t._numbered_by_groups(F.col("e")).alias("b")).collect():
        assert row.a == row.b
    asked, known = ["[A_001]", "[a_001]", "[B_002]", "[Ç_003]"], [("[A_001]", "1"), (None, "2"), ("[a_001]", None), ("[ç_003]", "3")]
    pairs = spark.createDataFrame([(asked, known), ([], known), (asked, [])], f"t array<string>, m array<{ENTRY}>")
    for case in (True, False):
        both = [look(F.col("t"), F.col("m"), case).alias(look.__name__) for look in (lookup._walked, lookup._merged)]
        for row in pairs.select(*both).collect():
            assert row._walked == row._merged
    lists = [random_spans(random.Random(n), n, 3 * n) for n in (127, 128, 129, 300)]
    assert resolved(spark, lists) == [plain.resolve(x) for x in lists]


def test_pieces_of_short_and_long_lists(spark):
    """However many cuts, the pieces are those between them."""
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 15, 16, 17, 64, 65, 700):
        text = "".join(rng.choice("aé😀 ") for _ in range(3 * n + 1))
        cuts = [0, *sorted(rng.randrange(len(text) + 1) for _ in range(n)), len(text)]
        rows = spark.createDataFrame([(text, cuts)], "t string, c array<int>")
        got = rows.select(pieces(F.col("t"), F.col("c")).alias("p")).first().p
        assert got == [text[a:b] for a, b in zip(cuts, cuts[1:])]


def test_numbering_searches_no_lists(spark):
    """A search that ends early leaves its loop by an exception, which costs more than the search: few entities are
    numbered without."""
    rows = spark.createDataFrame([([span(0, 1, "a", "A"), span(2, 3, " A", "B"), span(4, 5, "b", "A"), span(6, 7, "", "B")],)], f"e array<{SPAN}>")
    numbered = rows.select(t._numbered_by_search(F.col("e")).alias("n"))
    assert "array_position" not in numbered._jdf.queryExecution().analyzed().toString()
    got = numbered.first().n
    assert got.tokens == ["[B_002]", "[B_002]", "[A_001]", "[B_001]"]
    assert [tuple(e) for e in got.entries] == [("[B_001]", ""), ("[A_001]", "b"), ("[B_002]", "a")]
