import hmac
import io
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from veilframe.operators import report, sessions as s
from veilframe.operators.detect import detect
from veilframe.operators.tokens import anonymise
from veilframe.sources import files as f, mapping as m, sinks as k
from veilframe.sources.mapping_log import MappingLog

def later(seconds):
    return F.expr(f"timestamp '2024-01-01 00:00:00' + interval '{seconds}' second")


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as parts:
        parts.writestr("word/document.xml", (
            '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
            f"<w:body>{body}</w:body></w:document>"))
    return out.getvalue()


def paragraph(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def cell(text, extra=""):
    return f"<w:tc><w:tcPr>{extra}</w:tcPr>{paragraph(text)}</w:tc>"


DOCX = docx(
    paragraph("Uno") + paragraph("  ")
    + "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:tbl><w:tr>" + cell("X") + cell("X") + cell("Y") + "</w:tr><w:tr>"
    + cell("", '<w:vMerge/>') + cell("Z", '<w:gridSpan w:val="2"/>') + "</w:tr></w:tbl>" + paragraph("Fine"))

FILES = {
    "bom.txt": ("﻿ciao\r\nmondo\rfine".encode("utf-8"), "ciao\nmondo\nfine"),
    "nfd.TXT": ("café".encode("utf-8"), "café"),
    "win.txt": ("prezzo 5€ “ok”".encode("cp1252"), "prezzo 5€ “ok”"),
    "latin.txt": (b"caff\xe8 \x81", "caffè \x81"),
    "a.json": (json.dumps({"nome": "Anna", "x": {"email": "a@b.it", "n": None, "l": [1, "", True, {"k": 1.5}]}}).encode(),
               "nome: Anna\nemail: a@b.it\n1\nTrue\nk: 1.5"),
    "b.json": (b"[]", "[]"), "c.json": (b'"solo"', "solo"), "n.json": (b"null", "null"),
    "t.csv": (b"Nome,Email,qta\nAnna,a@b.it,1\nBob,,2\n", "Nome: Anna | Email: a@b.it | qta: 1\nNome: Bob | qta: 2"),
    "d.docx": (DOCX, "Uno\na\tb\nFine\nX | Y\nX | Z"),
}


def test_formats(spark):
    rows = spark.createDataFrame([(n, bytearray(c)) for n, (c, _) in FILES.items()], "filename string, content binary")
    got = {r.source: r for r in f.file_documents(rows).collect()}
    for name, (_, want) in FILES.items():
        assert got[name].text == want and got[name].error is None, (name, got[name])
    assert got["t.csv"].metadata.sensitive_columns == {"Nome": "PERSON", "Email": "EMAIL"}
    assert got["t.csv"].metadata.rows == 2 and got["t.csv"].metadata.columns == ["Nome", "Email", "qta"]


def test_bad_files_keep_their_row(spark):
    rows = spark.createDataFrame([("x.exe", bytearray(b"1")), ("y.json", bytearray(b"{")), ("z.txt", bytearray(b"")),
                                  ("noext", bytearray(b"q"))], "filename string, content binary")
    got = {r.source: r for r in f.upload_documents(rows).collect()}
    assert got["x.exe"].error == "Formato non supportato: .exe" and got["x.exe"].text is None
    assert got["y.json"].error.startswith("JSONDecodeError") and got["z.txt"].error == "empty"
    assert got["noext"].error == "Formato non supportato: "


def test_folder(spark, tmp_path):
    for name, (content, _) in FILES.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "skip.md").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text("no")
    got = f.file_documents(f.read_files(spark, str(tmp_path))).collect()
    assert sorted(os.path.basename(r.source) for r in got) == sorted(FILES)
    docs = anonymise(detect(f.file_documents(f.read_files(spark, str(tmp_path)))))
    out = str(tmp_path / "out")
    k.write_anonymised(docs, out)
    names = {r.file for r in spark.read.parquet(out).collect()}
    assert {"bom_anon.txt", "a_anon.txt", "t_anon.txt"} <= names
    k.write_anonymised(docs.where("source like '%t.csv'"), str(tmp_path / "texts"), as_text=True)
    assert "[EMAIL_001]" in spark.read.text(str(tmp_path / "texts"), wholetext=True).first().value
    k.write_json(docs.select("source", "entities"), str(tmp_path / "deep" / "json"))
    assert spark.read.json(str(tmp_path / "deep" / "json")).count() == len(FILES)


def test_folder_by_line(spark, tmp_path):
    """Lines of text files add up to the files, whatever their encoding; each file is counted once and no row holds a whole one."""
    more = {"empty.txt": (b"", ""), "mix.txt": ("uno è\r\n10.0.0.1\n".encode("cp1252") + b"due 4\n", "uno è\n10.0.0.1\ndue 4\n")}
    for name, (content, _) in (FILES | more).items():
        (tmp_path / name).write_bytes(content)
    got = f.file_documents(f.read_lines(spark, str(tmp_path)))
    whole = f.file_documents(f.read_files(spark, str(tmp_path)))
    assert sorted(r.source for r in got.where("first").collect()) == sorted(r.source for r in whole.collect())
    for r in whole.collect():
        lines = [x.text for x in got.where(F.col("source") == r.source).collect()]
        assert sorted("".join(lines).split("\n")) in (sorted(r.text.split("\n")), sorted((r.text + "\n").split("\n"))), r.source
    counted = report.batch_report(detect(got, types=["IP", "EMAIL"]), "source", "first").collect()
    assert {r.documents for r in counted} == {1} and sorted(map(tuple, counted)) == sorted(map(tuple, report.batch_report(detect(whole, types=["IP", "EMAIL"])).collect()))


def test_rows_and_json_column(spark, tmp_path):
    (tmp_path / "r.csv").write_text('CAP,Nome\n00100,"Anna ""A"" B"\n,Bob\n')
    rows = f.serialised_rows(f.csv_rows(spark, str(tmp_path / "r.csv")))
    assert [r.text for r in rows.collect()] == ['CAP: 00100 | Nome: Anna "A" B', "Nome: Bob"]
    js = spark.createDataFrame([('{"b": 1, "a": [2, {"c": null}]}',), ("{",), (None,)], "j string")
    assert [r[0] for r in js.select(f.flat_json(F.col("j"))).collect()] == ["b: 1\n2", None, None]


def test_mapping_round_trip(spark, tmp_path):
    mapping = spark.createDataFrame([(1, "[A_001]", "Anna"), (2, "[A_001]", "è€")], "doc_id int, token string, value string")
    plain, sealed = str(tmp_path / "p"), str(tmp_path / "s")
    m.save_mapping(mapping, plain)
    assert sorted(m.load_mapping(spark, plain).collect()) == sorted(mapping.collect())
    m.save_mapping(mapping, sealed, "segreto")
    m.save_mapping(mapping, sealed, "segreto", mode="append")
    stored = spark.read.parquet(sealed)
    assert stored.select("save").distinct().count() == 2
    assert stored.where(F.col("value").cast("string").contains("Anna")).count() == 0
    assert sorted(m.load_mapping(spark, sealed, "segreto").distinct().collect()) == sorted(mapping.collect())
    with pytest.raises(Exception, match="AES"):
        m.load_mapping(spark, sealed, "sbagliata").collect()
    rows, header = m.encrypted(mapping, "segreto")
    plan = rows._jdf.queryExecution().toString() + header._jdf.queryExecution().toString()
    assert "segreto" not in plan and "X'" not in plan.replace("X'01'", "").replace("X'7C'", "").replace("X''", "")
    assert m.load_mapping(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="AES"):
        m.decrypted(rows, header.where("false"), "segreto").collect()


def test_keys_of_saves(spark, tmp_path, monkeypatch):
    """One slow derivation however many saves; a new passphrase leaves the mapping alone; values cannot change places."""
    path = str(tmp_path / "m")
    made = []
    slow = m.derived_key
    monkeypatch.setattr(m, "derived_key", lambda *given: made.append(given) or slow(*given))
    for i in range(4):
        m.save_mapping(spark.createDataFrame([(i, "[A_001]", f"v{i}")], "doc_id int, token string, value string"), path, "uno", mode="append")
    made.clear()
    assert sorted(r.value for r in m.load_mapping(spark, path, "uno").collect()) == ["v0", "v1", "v2", "v3"]
    assert len(made) == 1
    files = sorted(os.listdir(path))
    m.change_passphrase(spark, path, "uno", "due")
    assert sorted(os.listdir(path)) == files
    assert m.load_mapping(spark, path, "due").count() == 4
    with pytest.raises(Exception, match="AES"):
        m.load_mapping(spark, path, "uno").collect()
    rows, header = spark.read.parquet(path), m._last_ring(spark, path)[1]
    with pytest.raises(Exception, match="AES"):
        m.decrypted(rows.withColumn("doc_id", F.col("doc_id") + 1), header, "due").collect()


def test_expanded_keys(spark):
    """HKDF's expansion against hmac."""
    from veilframe.functions.hidden import expanded, hmac_blocks

    key, info = os.urandom(32), b"some information"
    row = spark.createDataFrame([(bytearray(hmac_blocks(key)), bytearray(info))], "k binary, i binary")
    assert bytes(row.select(expanded(F.col("k"), F.col("i"))).first()[0]) == hmac.new(key, info + b"\x01", "sha256").digest()


def test_log_of_versions(spark, tmp_path):
    """Snapshots against a dict, appends with repeated and changed tokens, compaction, a second session's view; no shuffle
    of the mapping."""
    rng = random.Random(4)
    log = MappingLog(spark, str(tmp_path / "log"), "doc_id", buckets=4, passphrase="segreto", most_versions=6)
    assert log.snapshot().count() == 0 and log.compact() == 0
    now, then = {}, {}
    for i in range(5):
        rows = [(rng.choice([1, 2, 3, None]), f"[A_{rng.randint(1, 6):03d}]", rng.choice([f"v{i}", f"w{i}", None])) for _ in range(12)]
        made = log.append(spark.createDataFrame(rows, "doc_id int, token string, value string"))
        latest = {}
        for d, t, v in rows:
            if d is None:
                continue
            latest[d, t] = max(filter(None, [latest.get((d, t)), v]), default=None)
        now.update(latest)
        then[made] = dict(now)
        if i == 2:
            log.compact()
    again = MappingLog(spark.newSession(), str(tmp_path / "log"), "doc_id", buckets=4, passphrase="segreto")
    for known in spark.catalog.listTables():
        if known.name.startswith("mapping_"):
            spark.sql(f"DROP TABLE {known.name}")
    for view, seen in ((again, then), (log, {max(then): now})):
        for version, want in seen.items():
            got = {(r.doc_id, r.token): r.value for r in view.snapshot(version).collect()}
            assert got == want
    assert spark.read.parquet(str(tmp_path / "log" / "mapping_*")).where(F.col("value").cast("string").rlike("^[vw][0-9]$")).count() == 0
    plain = MappingLog(spark, str(tmp_path / "plain"), "doc_id", buckets=4)
    for i in range(3):
        plain.append(spark.createDataFrame([(d, "[A_001]", f"x{i}{d}") for d in range(i, 20)], "doc_id int, token string, value string"))
    plain.compact()
    plan = plain.snapshot()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plain.append(spark.createDataFrame([(3, "[A_001]", "x23"), (4, "[C_001]", "new")], "doc_id int, token string, value string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = plain._answers(plain.snapshot().select("doc_id", "token"), None)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan
    texts = spark.createDataFrame([(i, i % 25, "a [a_001] b [B_001]") for i in range(100)], "k int, doc_id int, response string")
    for hot_rows in (2, 1000):
        got = {r.k: r.rehydrated_text for r in plain.restored(texts, "k", hot_rows=hot_rows).collect()}
        assert got == {i: f"a {f'x{min(2, i % 25)}{i % 25}' if i % 25 < 20 else '[a_001]'} b [B_001]" for i in range(100)}


def test_merge(spark):
    old = spark.createDataFrame([("s", "[A_001]", "x"), ("s", "[A_002]", "y")], "scope string, token string, value string")
    new = spark.createDataFrame([("s", "[A_001]", "z")], "scope string, token string, value string")
    assert sorted(map(tuple, m.merged(old, new, "scope").collect())) == [("s", "[A_001]", "z"), ("s", "[A_002]", "y")]


def test_sessions(spark):
    mapping = spark.createDataFrame([(1, "[A_001]", "Anna"), (1, "[A_002]", "Bob"), (2, "[A_001]", "Cy")],
                                    "doc_id int, token string, value string")
    made = s.create_sessions(mapping, "doc_id", later(0), 10)
    assert sorted(made.collect()) == sorted(made.collect())
    ids = {r.doc_id: r.session_id for r in made.collect()}
    assert len(set(ids.values())) == 2 and len(ids[1]) == 64
    assert s.live(made, later(10)).count() == 3 and s.live(made, later(10.001)).count() == 0
    state = {r.session_id: r for r in s.status(made, later(3.5)).collect()}
    assert state[ids[1]].entity_count == 2 and state[ids[1]].expires_in == 6
    assert s.active_count(made, later(0)).first().active == 2
    kept, removed = s.evict(made, later(11))
    assert kept.count() == 0 and removed.first().removed == 2
    texts = spark.createDataFrame([("a", ids[1], "[A_002] [a_001]"), ("b", "nope", "[A_001]")],
                                  "id string, session_id string, response string")
    good, missed = s.restore_with_sessions(texts, made, later(0), "id")
    assert good.first().rehydrated_text == "Bob Anna" and [r.id for r in missed.collect()] == ["b"]
    left = s.delete(made, spark.createDataFrame([(ids[1],)], "session_id string"))
    assert [r.doc_id for r in left.collect()] == [2]
    with pytest.raises(ValueError):
        s.create_sessions(mapping, "doc_id", later(0), 0)
