import random

from pyspark.sql import functions as F

import plain
from veilframe.functions import text as tx
from veilframe.functions.types import HIT, SPAN
from veilframe.operators import chunk as c, columns as col, outside as o, report as rep


def chunk_texts():
    rng = random.Random(11)
    yield "first paragraph here\n\nsecond paragraph", 30
    yield "A" * 18 + " [PERSON_001] coda BBBB", 20
    tokens = " ".join(f"word{i} [EMAIL_{i:03d}]" for i in range(1, 60))
    for limit in (15, 25, 37, 50, 80, 123):
        yield tokens, limit
    yield " " * 50, 10
    yield "", 10
    yield "x" * 95, 10
    yield "[DRIVING_LICENSE_001]" * 4, 12
    for _ in range(150):
        bits = ["a", "bb ", ". ", "\n\n", " ", "[A_001]", "[", "]", "[LONG_TYPE_1234]", "é😀", "\t", "[x_001]"]
        yield "".join(rng.choice(bits) for _ in range(rng.randrange(80))), rng.randrange(1, 40)


def test_chunks_against_plain(spark):
    by_limit = {}
    for i, (text, limit) in enumerate(chunk_texts()):
        by_limit.setdefault(limit, []).append(text)
    for limit, texts in by_limit.items():
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
        got = {r.i: r.c for r in rows.select("i", c.chunks(F.col("t"), limit).alias("c")).collect()}
        for i, text in enumerate(texts):
            assert got[i] == plain.chunks(text, limit), (text, limit)
    assert c._chunks("ab", 0) == ["ab"]


def test_prompts_and_demo_response(spark):
    rows = spark.createDataFrame([("aaaa bbbb cccc",), ("short",)], "anonymized_text string")
    got = c.respond(c.with_prompts(rows, template="Say {x}: {document}", limit=9)).collect()
    assert got[1].prompts == ["Say {x}: short"]
    assert got[0].prompts == ["[Parte 1 di 2]\n\nSay {x}: aaaa", "[Parte 2 di 2]\n\nSay {x}: bbbb cccc"]
    assert got[0].llm_response_anonymized.count("[DEMO") == 2
    assert "Say {x}: short" in got[1].llm_response_anonymized
    loud = c.respond(c.with_prompts(rows, limit=9), lambda ps: [p.upper() for p in ps]).collect()
    assert loud[1].llm_response_anonymized == "ANALIZZA IL SEGUENTE TESTO:\n\nSHORT"
    assert spark.range(1).select(tx.apply_template("no place", F.lit("x"))).first()[0] == "no place"


HEADERS = {
    "Email_Address": "EMAIL", "cognome": "PERSON", "conto corrente": "IBAN", "CodFisc": "CF",
    "phone_number": "PHONE", "totale_euro": "AMOUNT", "residenza": "ADDR", "id": None,
    "quantita": None, "colore": None, "description": "IP", "hotel": "PHONE", "cvv": "CARD",
    "vat": "PIVA", " Data-Nascita ": "DATE", "numero targa": "PLATE",
}


def test_headers(spark):
    rows = spark.createDataFrame([(h,) for h in HEADERS], "column string")
    assert {r.column: r.type for r in col.classify_headers(rows).collect()} == HEADERS
    names = spark.range(1).select(col.sensitive_columns(F.array(F.lit("Email"), F.lit("colore"))))
    assert names.first()[0] == {"Email": "EMAIL"}
    table = spark.createDataFrame([("a", None), ("b", 1)], "nome string, qta int")
    assert [tuple(r) for r in col.profile_columns(table, "t").collect()] == [
        ("t", "nome", 2, "PERSON"), ("t", "qta", 1, None)]


TEXT = "El paciente Rubén Castaño viajó a Zamora\nATTENZIONE: BIC Mario Rossi\nNome : x"


def hit(value, label, engine="spacy", score=None, text=TEXT):
    start = text.index(value)
    return (engine, label, start, start + len(value), score)


def cleaned(spark, hits, **options):
    rows = spark.createDataFrame([(TEXT, hits)], f"text string, hits array<{HIT}>")
    spans = rows.select(o.spans_of_hits(F.col("text"), F.col("hits"), **options)).first()[0]
    for s in spans:
        assert TEXT[s.start:s.end] == s.value
    return [(s.value, s.type, s.confidence, s.source) for s in spans]


def test_clean_up_of_hits(spark):
    got = cleaned(spark, [
        hit("El paciente Rubén Castaño viajó", "PER"),
        hit("Zamora\nATTENZIONE", "LOC"),
        hit("ATTENZIONE", "PER"), hit("ATTENZIONE:", "ORG"), hit("BIC", "ORG"), hit("Nome", "PER"),
        hit("  " if "  " in TEXT else " ", "PER"), hit("paciente", "MISC"),
        hit(" Mario Rossi", "Person", "gliner", 0.91), hit("Mario Rossi", "person", "gliner", 0.5),
        hit("Mario Rossi", "PERSON", "presidio", 0.8), hit("a Zamora", "GPE"), hit("El paciente", "PER"),
    ])
    assert got == [
        ("Rubén Castaño", "PERSON", 0.85, "spacy"), ("Zamora", "LOC", 0.85, "spacy"),
        ("Mario Rossi", "PERSON", 0.91, "gliner"), ("Mario Rossi", "PERSON", 0.8, "presidio"),
        ("Zamora", "LOC", 0.85, "spacy"),
    ]
    assert cleaned(spark, [hit("Zamora", "LOC")], threshold=0.9) == []
    assert cleaned(spark, [hit("Zamora", "LOC")], types=[]) == []
    assert len(cleaned(spark, [hit("Zamora", "LOC")], types=["LOC"])) == 1


def test_rules_and_hits_together(spark):
    docs = spark.createDataFrame([(1, "Scrivi a a.b@c.it oggi, Anna"), (2, "niente")], "doc_id long, text string")
    hits = spark.createDataFrame(
        [(1, "presidio", "EMAIL_ADDRESS", 9, 17, 0.9, 0), (1, "presidio", "EMAIL_ADDRESS", 9, 17, 0.8, 1),
         (1, "spacy", "PER", 24, 28, None, 2)],
        "doc_id long, engine string, label string, start int, end int, score double, place int")
    rows = {r.doc_id: r.entities for r in o.detect_with_hits(o.attach_hits(docs, hits)).collect()}
    assert [(e.value, e.type, e.confidence, e.source) for e in rows[1]] == [
        ("a.b@c.it", "EMAIL", 0.99, "rule"), ("Anna", "PERSON", 0.85, "spacy")]
    assert rows[2] == []
    own = o.recognise(docs, lambda t: [{"engine": "spacy", "label": "PER", "start": 0, "end": 6, "score": None}])
    assert [e.value for e in o.detect_with_hits(own).first().entities] == ["Scrivi", "a.b@c.it"]


def test_reports(spark):
    spans = spark.createDataFrame(
        [(1, 0, 3, "abc", "EMAIL", 0.9, "rule", 0), (1, 4, 7, "x" * 70, "EMAIL", 0.7, "spacy", 0),
         (2, 0, 1, "z", "IP", 0.85, None, 0)], f"doc_id int, {SPAN[7:-1].replace(':', ' ').replace(',', ', ')}")
    stats = {r.type: r for r in rep.type_stats(spans).collect()}
    assert stats["EMAIL"].n == 2 and abs(stats["EMAIL"].percent - 200 / 3) < 1e-9
    assert abs(stats["EMAIL"].avg_confidence - 0.8) < 1e-9
    assert {r.type: r.n for r in rep.type_counts(spans).collect()} == {"EMAIL": 2, "IP": 1}
    big = spark.range(20001).select(F.lit("s").alias("scope"), F.col("id").cast("string").alias("token"))
    assert rep.mapping_guard(big, "scope").first().entries == 20001
    assert rep.mapping_guard(big.limit(20000), "scope").count() == 0
    assert {r.source: r.n for r in rep.source_stats(spans).collect()} == {"rule": 2, "spacy": 1}
    assert len(rep.dry_run(spans, "doc_id").where("type = 'EMAIL'").collect()[1].shown) == 60
    docs = spark.createDataFrame(
        [("a.txt", [(0, 1, "v", "IP", 0.9, "rule", 0), (2, 3, "w", "EMAIL", 0.9, "rule", 0)], "t" * 101),
         ("a.txt", [], "t" * 101), ("b.txt", [], "short")], f"source string, entities array<{SPAN}>, text string")
    got = {r.source: (r.documents, r.entities, r.summary) for r in rep.batch_report(docs).collect()}
    assert got == {"a.txt": (2, 2, "EMAIL:1, IP:1"), "b.txt": (1, 0, "")}
    assert rep.silent_documents(docs).count() == 1
    counts = docs.select(rep.entity_type_counts(F.col("entities")).alias("c")).first().c
    assert [tuple(x) for x in counts] == [("EMAIL", 1), ("IP", 1)]
    payload = docs.select(rep.entity_payload(F.col("entities")).alias("p")).first().p
    assert "value" not in payload[0].asDict()


def test_small_expressions(spark):
    one = spark.range(1)
    assert one.select(tx.safe_path(F.lit("/api/session/abc/x"))).first()[0] == "/api/session/<id>"
    assert one.select(tx.safe_path(F.lit("/api/other"))).first()[0] == "/api/other"
    left = F.expr("timestamp '2024-01-01 00:00:10.9'"), F.expr("timestamp '2024-01-01 00:00:00'")
    assert one.select(tx.seconds_left(*left)).first()[0] == 10
    assert one.select(tx.seconds_left(left[1], left[0])).first()[0] == 0
    values = [0.125, 0.845, 0.9, 0.99499, 0.0005]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in rows.select(tx.rounded(F.col("v"), 2)).collect()] == [round(v, 2) for v in values]
