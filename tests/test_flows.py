import random
from collections import deque

import pytest
from pyspark.sql import functions as F

import plain
from conftest import SF_SMALL
from veilframe.functions.types import HIT
from veilframe.operators import admission as a
from veilframe.plans import flows
from veilframe.plans.queries import QUERIES
from veilframe.streaming import streams

SAMPLE = ("Il cliente CF RSSMRA80A01H501U ha telefono +39 333 1234567\n"
          "Scrivere a mario.rossi@example.com, IBAN IT60X0542811101000000123456\n"
          "Importo: €2.350,00 del 15 marzo 2022, Via Roma, 15")


def plain_admission(rows, limit, window):
    queues, out = {}, {}
    for key, at, rid in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        q = queues.setdefault(key, deque())
        while q and q[0] < at - window:
            q.popleft()
        if len(q) >= limit:
            out[rid] = (False, max(1, int((q[0] + window - at) / 1e6) + 1))
        else:
            q.append(at)
            out[rid] = (True, 0)
    return out


def requests(spark, rows):
    made = spark.createDataFrame(rows, "key string, at bigint, request_id bigint")
    return made.select("key", F.timestamp_micros("at").alias("ts"), "request_id").repartition(5)


@pytest.mark.parametrize("limit,window", [(1, 1), (2, 60), (5, 10), (50, 30)])
def test_admission_against_plain(spark, limit, window):
    rng = random.Random(limit)
    rows = []
    for key in "abcdef":
        at = rng.randrange(10**9)
        for _ in range(600 if key == "a" else 120):
            at += rng.choice([0, 1, 10**5, 10**6, 10**7, window * 10**6, window * 10**6 + 1, 10**9 * (key == "f")])
            rows.append((key, at, len(rows)))
    got = a.admit(requests(spark, rows), max_requests=limit, window_seconds=window).collect()
    assert len(got) == len(rows)
    assert {r.request_id: (r.admitted, r.retry_after) for r in got} == plain_admission(rows, limit, window * 10**6)


def test_admission_example(spark):
    rows = [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("b", 2, 3)]
    got = a.admit(requests(spark, rows), max_requests=2).orderBy("request_id").collect()
    assert [r.admitted for r in got] == [True, True, False, True] and got[2].retry_after == 60
    with pytest.raises(ValueError):
        a.admit(requests(spark, rows), max_requests=0)


def test_admission_on_events(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    got = a.admit(events, "user_id", "ts", "event_id", 3, 86400).collect()
    rows = [(r.user_id, r.at, r.event_id) for r in events.select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id").collect()]
    assert {r.event_id: (r.admitted, r.retry_after) for r in got} == plain_admission(rows, 3, 86400 * 10**6)
    assert not all(r.admitted for r in got)


def run(stream, name, checkpoint):
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    assert query.awaitTermination(300)
    return stream.sparkSession.table(name).collect()


def test_streams_equal_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    source = spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet").parquet(SF_SMALL)
    query = streams.write_stream(streams.anonymise_stream(source), str(tmp_path / "o"), str(tmp_path / "c"))
    assert query.awaitTermination(300)
    columns = ["doc_id", "anonymized_text", "entity_map"]
    batch = flows.anonymise_only(docs).select(columns)
    stream = spark.read.parquet(str(tmp_path / "o")).select(columns)
    assert sorted(stream.collect()) == sorted(batch.collect())


def test_admission_stream(spark, tmp_path):
    rng = random.Random(2)
    rows, at = [], 10**12
    for i in range(300):
        at += rng.choice([1, 10**6, 3 * 10**6])
        rows.append((rng.choice("ab"), at, i))
    for part in range(3):
        requests(spark, rows[part * 100:part * 100 + 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p={part}"))
    schema = requests(spark, rows).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/p=*"))
    got = admitted(spark, source, tmp_path, 4, 10)
    want = plain_admission(rows, 4, 10**7)
    assert sorted((r.request_id, r.key, r.ts.timestamp(), r.admitted, r.retry_after) for r in got) == sorted(
        (i, k, t / 1e6, *want[i]) for k, t, i in rows)


def admitted(spark, source, folder, most, seconds):
    query = streams.admit_stream(source, str(folder / "verdicts"), str(folder / "state"), max_requests=most, window_seconds=seconds)
    query.awaitTermination()
    return streams.read_admitted(spark, str(folder / "verdicts")).collect()


def test_admission_stream_of_one_key_nulls_and_late_requests(spark, tmp_path):
    """A key over many Arrow batches in no order; requests without a key; requests that come late."""
    rng = random.Random(5)
    rows = [("hot", 10**12 + i * 3000, i) for i in range(33_000)] + [(None, 10**12, 50_000 + i) for i in range(10)]
    rng.shuffle(rows)
    late = [("late", 10**12 - 10**9, 60_000), ("hot", 10**12 - 10**9, 60_001)]
    for part, some in enumerate([rows, late]):
        requests(spark, some).coalesce(1).write.parquet(str(tmp_path / f"in/p={part}"))
    source = spark.readStream.schema(requests(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/p=*"))
    got = {r.request_id: (r.admitted, r.retry_after) for r in admitted(spark, source, tmp_path, 20, 1)}
    assert len(got) == len(rows) + len(late)
    named = [r for r in rows if r[0]]
    want = plain_admission(sorted(named, key=lambda r: r[1:]), 20, 10**6)
    assert all(got[i] == tuple(want[i]) for _, _, i in named)
    assert all(got[i] == (True, 0) for k, _, i in rows if k is None)
    assert got[60_000] == (True, 0) and got[60_001][0] in (True, False)


def test_session_expiry_stream(spark, tmp_path):
    made = lambda rows: spark.createDataFrame(rows, "session_id string, at bigint").select(
        "session_id", F.timestamp_micros(F.col("at") * 1000000).alias("created_at"), F.lit("v").alias("value"))
    parts = [
        [("s1", 100), ("s1", 100), ("s2", 105), (None, 101)], [("s3", 200), ("old", 20), ("old", 20)], [("s2", 105), ("s1", 100), ("s3", 200)],
        [("s4", 400), ("s3", 200), ("none", None)], [("s1", 100)], [("s5", 405), ("s4", 400)],
    ]
    for i, rows in enumerate(parts):
        made(rows).coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    source = spark.readStream.schema(made([("x", 1)]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/p=*"))
    streams.expire_stream(source, str(tmp_path / "out"), str(tmp_path / "state"), ttl_seconds=10).awaitTermination()
    got = {r.session_id: (r.entity_count, r.late_entries) for r in streams.read_expired(spark, str(tmp_path / "out")).collect()}
    assert got == {"s1": (4, 2), "s2": (2, 1), "s3": (3, 0), "old": (2, 2), "none": (1, 1), None: (1, 0)}
    held = spark.read.parquet(str(tmp_path / "state/held=5")).collect()
    assert sorted((r.session_id, r.entity_count) for r in held) == [("s4", 2), ("s5", 1)]
    assert sum(n for n, _ in got.values()) + sum(r.entity_count for r in held) == sum(map(len, parts))


def test_process(spark):
    docs = spark.createDataFrame([(1, SAMPLE), (2, "niente di niente"), (3, "il n. +39 333 1234567 e [X_001]")], "doc_id int, text string")
    rows = {r.doc_id: r for r in flows.process(docs, limit=0, responder=lambda ps: [p.lower() for p in ps]).collect()}
    first = rows[1]
    assert {e.type for e in first.detected_entities} >= {"CF", "PHONE", "EMAIL", "IBAN", "AMOUNT", "DATE", "ADDR"}
    assert "mario.rossi@example.com" not in first.anonymized_text
    assert "mario.rossi@example.com" in first.final_response and "RSSMRA80A01H501U" in first.final_response
    assert first.validation.anonymization.is_valid and first.validation.rehydration.is_valid
    assert first.stopped is None and rows[2].final_response.endswith("niente di niente")
    assert rows[3].stopped and rows[3].final_response is None and rows[3].llm_response_anonymized is None
    assert rows[3].validation.anonymization.errors == ["Token sconosciuto nel testo anonimizzato: [X_001]"]
    anyway = flows.process(docs.where("doc_id = 3"), stop_on_error=False).first()
    assert anyway.stopped is None and "+39 333 1234567" in anyway.final_response
    assert anyway.validation.rehydration.errors == ["Placeholder inventato dall'LLM: [X_001]"]


def test_process_demo_round_trip(spark):
    docs = spark.createDataFrame([(1, SAMPLE)], "doc_id int, text string")
    row = flows.process(docs).first()
    assert "Anteprima testo ricevuto" in row.final_response and "[" + "EMAIL_001]" in row.llm_response_anonymized
    entities = plain.resolve(plain.spans(SAMPLE))
    assert row.anonymized_text == plain.anonymise(SAMPLE, entities)[0]
    assert row.entity_map == plain.anonymise(SAMPLE, entities)[1]


def test_outputs(spark):
    docs = flows.anonymise_only(spark.createDataFrame([(1, SAMPLE)], "doc_id int, text string"))
    public = flows.public_output(docs, "doc_id").first()
    assert "entity_map" not in public.asDict() and "value" not in public.entities[0].asDict()
    assert public.entity_count == len(public.entities)
    assert flows.stateless_output(docs, "doc_id").first().mapping["[EMAIL_001]"] == "mario.rossi@example.com"
    assert flows.highlighted(docs.select("text"), types=["EMAIL"]).first().highlighted_text.count("{") == 1
    assert flows.redacted(docs.select("text"), types=["EMAIL"]).first().redacted_text.count("[REDACTED]") == 1


def test_flows_replace_recogniser_hits(spark):
    """Highlighting, redaction and the stream's row work use hits, and types filter them by any name."""
    text = "Rita Longo lavora per Vela Srl, r.l@vela.example"
    hits = [("spacy", "PER", 0, 10, None), ("spacy", "ORG", 22, 30, None)]
    docs = spark.createDataFrame([(1, text, hits)], f"doc_id int, text string, hits array<{HIT}>")
    assert flows.redacted(docs).first().redacted_text == "[REDACTED] lavora per [REDACTED], [REDACTED]"
    shown = flows.highlighted(docs).first().highlighted_text
    assert shown.startswith("{Rita Longo|PERSON:") and "{Vela Srl|ORG:" in shown
    assert streams.anonymise_stream(docs).first().anonymized_text == flows.anonymise_only(docs).first().anonymized_text
    found = lambda types: {e.type for e in flows.anonymise_only(docs, types=types).first().entities}
    assert found(["ORGANIZATION"]) == found("ORG") == {"ORG"}
    assert found("ORG,EMAIL") == {"ORG", "EMAIL"} and "ORG" not in found([])


def test_deep_json_is_no_failure(spark):
    from veilframe.sources import files

    rows = spark.createDataFrame([("[" * 100_000 + "]" * 100_000,), ('{"a": 1}',)], "j string")
    assert [r[0] for r in rows.select(files.flat_json(F.col("j"))).collect()] == [None, "a: 1"]


@pytest.mark.parametrize("name,table", [("stream_anonymise", "documents"), ("stream_admission", "events")])
def test_streams_of_a_folder_of_part_files(spark, tmp_path, name, table):
    """A table may be one file or a folder of part files; a stream of either has the same rows."""
    spark.read.parquet(f"{SF_SMALL}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(map(tuple, QUERIES[name](spark, SF_SMALL).collect()))
