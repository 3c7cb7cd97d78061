"""The registered queries: every operator over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import checks, text as tx
from ..functions.arrays import running
from ..functions.hidden import with_keys
from ..functions.settle import settled
from ..functions.types import HIT
from ..operators import admission, chunk, columns, outside, report, restore as rs, sessions
from ..operators import tokens as tk, validate as vd
from ..operators.detect import detect, explode_spans
from ..sources import files, mapping as mp, sinks
from ..sources.mapping_log import MappingLog
from ..streaming import streams
from . import flows
from .forms import GATE_FIELDS, WEAK_FIELDS, forms
from .tables import documents, spread, stream_of, table

EMAIL = ["EMAIL"]
EXACT = 0.95
# Rows of orders, customers or events that a task writes out and searches.
ORDERS_EACH = 50_000
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _anonymised(spark: SparkSession, folder: str) -> DataFrame:
    return flows.anonymise_only(documents(spark, folder))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's checkpoint folder, or under its warehouse if none is set;
    both are shared by driver and executors."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(root, f"{name}-{os.urandom(8).hex()}")


def _stored(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Write rows once and read them back, where several branches need them."""
    folder = _scratch(spark, name)
    rows.write.parquet(folder)
    return spark.read.parquet(folder)


def _stored_parts(spark: SparkSession, folder: str, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Anonymised texts and the mapping, as two tables kept apart; detection runs once.  Values are on disk under a key
    that only this session has."""
    key = {"now": os.urandom(32)}
    done = _anonymised(spark, folder) if done is None else done
    texts = done.select("doc_id", "anonymized_text", "entity_map", F.lit("now").alias("batch"))
    sealed = F.transform("entity_map", lambda e: F.struct(e["token"].alias("token"), F.aes_encrypt(e["value"], F.col("_key")).alias("value")))
    kept = _stored(spark, with_keys(texts, key, "batch").select("doc_id", "anonymized_text", sealed.alias("entity_map"), "batch"), "anonymised")
    mapping = with_keys(tk.mapping_table(kept, "doc_id", "batch"), key, "batch")
    return kept.select("doc_id", "anonymized_text"), mapping.select("doc_id", "token", F.aes_decrypt("value", "_key").cast("string").alias("value"))


# ---- detection ---------------------------------------------------------------------------


def entity_stats(spark, folder):
    """All types over all documents: number, share and confidence per type."""
    stats = report.type_stats(explode_spans(detect(documents(spark, folder)), "doc_id"))
    shown = [tx.rounded(F.col(c), 6).alias(c) for c in ("avg_confidence", "percent")]
    return stats.select("type", "n", "min_confidence", "max_confidence", *shown)


def email_by_lang(spark, folder):
    found = explode_spans(detect(documents(spark, folder, "lang", "text"), types=EMAIL), "lang")
    return found.groupBy("lang").agg(F.count("*").alias("n"))


def _spans(documents_: DataFrame, key: str, threshold: float, types: list[str], text: str = "text"):
    found = explode_spans(detect(documents_, text, threshold, types), key)
    return found.select(key, *_long("start", "end"), "value", "type", "confidence")


def ip_spans(spark, folder):
    return _spans(documents(spark, folder), "doc_id", 0.85, ["IP"])


def card_luhn(spark, folder):
    return _spans(documents(spark, folder), "doc_id", EXACT, ["CARD"])


def url_in_pages(spark, folder):
    pages = spread(table(spark, folder, "pages").select("page_id", "html"))
    return _spans(pages, "page_id", 0.8, ["URL"], "html")


def page_addresses(spark, folder):
    pages = spread(table(spark, folder, "pages").select("page_id", "url"))
    return _spans(pages, "page_id", 0.8, ["URL"], "url")


def bic_in_conversations(spark, folder):
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text"
    )
    return _spans(spread(turns), "turn_id", 0.72, ["BIC"])


def date_spans(spark, folder):
    """Dates in orders written out as text with all their columns, one document per row."""
    orders = table(spark, folder, "orders")
    dated = orders.withColumn("o_orderdate", F.date_format("o_orderdate", "dd/MM/yyyy"))
    rows = files.serialised_rows(dated, keep=("o_orderkey",))
    return _spans(spread(rows, ORDERS_EACH), "o_orderkey", EXACT, ["DATE"])


def amount_spans(spark, folder):
    """Labelled amounts in orders written out as text with all their columns; the value has three digits at most
    before a separator, so a longer number is cut."""
    orders = table(spark, folder, "orders")
    rows = files.serialised_rows(orders.withColumnRenamed("o_totalprice", "importo"), keep=("o_orderkey",))
    return _spans(spread(rows, ORDERS_EACH), "o_orderkey", 0.8, ["AMOUNT"])


def phone_and_ids(spark, folder):
    """Labelled numbers of customers in four languages, several types in one text."""
    digits = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    customers = table(spark, folder, "customer").select(
        "c_custkey",
        F.concat(
            F.lit("Passaporto: YA"), digits, F.lit(" Tel. +39 333 "), digits,
            F.lit(" SSN: 123-45-"), F.right(digits, F.lit(4)), F.lit(" Matricola: "), digits,
            F.lit(" Numéro fiscal: FR"), digits, F.lit("890 Server 10.0.0."),
            (F.col("c_custkey") % 256).cast("string"),
        ).alias("text"),
    )
    return _spans(
        spread(customers, ORDERS_EACH), "c_custkey", 0.85, ["PASSPORT", "PHONE", "TAX_ID", "EMPLOYEE_ID", "IP"]
    )


def checksum_candidates(spark, folder):
    """Card, IBAN, VAT and fiscal-code checks over numbers made from order keys."""
    key = F.col("o_orderkey")
    pad = lambda number, width: F.lpad(number.cast("string"), width, "0")
    return spread(table(spark, folder, "orders"), ORDERS_EACH).select(
        "o_orderkey",
        checks.luhn(F.concat(F.lit("4"), pad(key * 7919, 15))).alias("card_ok"),
        checks.iban(
            F.concat(F.lit("IT"), pad(key % 97, 2), F.lit("X05428"), pad(key * 31, 17))
        ).alias("iban_ok"),
        checks.piva(pad(key * 104729, 11)).alias("piva_ok"),
        checks.fiscal_code(
            F.concat(F.lit("RSSMRA"), pad(key % 100, 2), F.lit("A01H"), pad(key % 1000, 3),
                     F.char(key % 26 + 65))
        ).alias("cf_ok"),
    )


def silent_docs(spark, folder):
    found = detect(documents(spark, folder))
    return report.silent_documents(found).select("doc_id", _long_length("text"))


def _long_length(text: str) -> Column:
    return F.length(text).cast("bigint").alias("n_chars")


def size_guard(spark, folder):
    checked = report.size_guard(table(spark, folder, "documents").select("lang", "text"))
    return checked.groupBy("lang", "refused").agg(F.count("*").alias("n"))


def dry_run(spark, folder):
    found = explode_spans(detect(documents(spark, folder)), "doc_id")
    listed = report.dry_run(found, "doc_id")
    return listed.select("doc_id", "value", "type", "confidence", "source", *_long("start", "end"), "shown")


# ---- reports -----------------------------------------------------------------------------


def batch_report(spark, folder):
    found = detect(documents(spark, folder, "source", "text"))
    return report.batch_report(found, "source")


def _agreeing_hits(spark, folder) -> DataFrame:
    """Recogniser hits made from the documents: the IPv4 addresses, found again, and each e-mail
    reported twice."""
    docs = documents(spark, folder)
    ips = explode_spans(detect(docs, threshold=0.85, types=["IP"]), "doc_id").select(
        "doc_id", F.lit("gliner").alias("engine"), F.lit("IP address").alias("label"),
        "start", "end", F.lit(0.9).alias("score"), F.lit(0).alias("place"),
    )
    mails = explode_spans(detect(docs, types=EMAIL), "doc_id").select(
        "doc_id", F.lit("presidio").alias("engine"), F.lit("EMAIL_ADDRESS").alias("label"),
        "start", "end", F.lit(0.8).alias("score"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("place"),
    )
    return _stored(spark, ips.unionByName(mails), "hits")


def source_stats(spark, folder):
    """Rules and recogniser hits together: agreement lifts the recogniser above the rule."""
    docs = outside.attach_hits(documents(spark, folder), _agreeing_hits(spark, folder))
    found = outside.detect_with_hits(docs, types=["EMAIL", "IP"])
    spans = explode_spans(found, "doc_id")
    stats = report.source_stats(spans.where(F.col("type").isin("EMAIL", "IP")))
    return stats.select("source", "n", tx.rounded(F.col("percent"), 6).alias("percent"))


def boosted_spans(spark, folder):
    docs = outside.attach_hits(documents(spark, folder), _agreeing_hits(spark, folder))
    found = outside.detect_with_hits(docs, threshold=0.75, types=["EMAIL", "IP"])
    spans = explode_spans(found, "doc_id")
    return spans.select(
        "doc_id", *_long("start", "end"), "type", tx.rounded(F.col("confidence"), 3).alias("confidence"), "source"
    )


def ranked_types(spark, folder):
    """The report by type in its order."""
    stats = report.type_stats(explode_spans(detect(documents(spark, folder)), "doc_id"))
    return report.in_order(stats, "type").select(*_long("place"), "type", "n")


def rejected_hits(spark, folder):
    """Hits of recognisers on every e-mail, card number and IP address: a quarter agree with the rules, the others are too weak,
    of a type that was not asked for, or have an unknown label."""
    docs = documents(spark, folder)
    kind = F.pmod(F.col("start") + F.col("doc_id"), F.lit(4))
    label = F.when(F.col("type") == "EMAIL", "EMAIL_ADDRESS").when(F.col("type") == "CARD", "CREDIT_CARD").otherwise("IP_ADDRESS")
    hits = explode_spans(detect(docs, threshold=0.75, types=["EMAIL", "CARD", "IP"]), "doc_id").select(
        "doc_id", F.when(kind == 2, "gliner").when(kind == 3, "spacy").otherwise("presidio").alias("engine"),
        F.when(kind == 2, "organization").when(kind == 3, "UNKNOWN").otherwise(label).alias("label"), "start", "end",
        F.when(kind == 1, 0.3).when(kind == 2, 0.9).otherwise(0.8).alias("score"), F.lit(0).alias("place"),
    )
    found = outside.detect_with_hits(outside.attach_hits(docs, _stored(spark, hits, "hits")), threshold=0.75, types="email, CARD ,IP_ADDRESS,ip")
    spans = explode_spans(found, "doc_id")
    return spans.select("doc_id", *_long("start", "end"), "value", "type", tx.rounded(F.col("confidence"), 3).alias("confidence"), "source")


def long_links(spark, folder):
    """Links longer than reports show, one per document, made of its first words."""
    slug = F.regexp_replace(F.left("text", F.lit(150)), "[^A-Za-z0-9]+", "-")
    links = documents(spark, folder).select("doc_id", F.concat(F.lit("Vedi https://docs.example/"), slug).alias("text"))
    listed = report.dry_run(explode_spans(detect(links, types=["URL"]), "doc_id"), "doc_id")
    return listed.select("doc_id", "value", "shown", *_long("start", "end"))


def size_limits(spark, folder):
    """Texts that are empty, too long or neither, by language, and scopes with too many mapping entries."""
    repeated = F.repeat("text", F.ceil(F.lit(100_001) / F.greatest(F.length("text"), F.lit(1))).cast("int"))
    kind = F.pmod("doc_id", F.lit(5))
    docs = documents(spark, folder, "doc_id", "lang", "text")
    sized = docs.withColumn("text", F.when(kind == 0, repeated).when(kind == 1, "").when(kind == 2, F.lit(None)).otherwise(F.col("text")))
    texts = report.size_guard(sized).groupBy(F.col("lang").alias("scope"), "refused").agg(F.count("*").alias("n"))
    entries = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("scope"), F.lit("").alias("token"))
    large = report.mapping_guard(entries, "scope").select("scope", F.lit("too many entries").alias("refused"), F.col("entries").alias("n"))
    return texts.unionByName(large)


def recogniser_clean_up(spark, folder):
    """All pairs of neighbouring words of conversations as if a recogniser had called them names."""
    turns = spread(
        table(spark, folder, "conversations").select(
            F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text", F.split("text", " ", -1).alias("words")
        )
    )
    placed = "struct<start:int,end:int,word:string>"
    words = running(
        F.col("words"), F.lit(0), lambda at, w: at + F.length(w) + 1,
        lambda at, w: F.array(F.struct(at.alias("start"), (at + F.length(w)).alias("end"), w.alias("word")).cast(placed)), placed,
    )
    pairs = F.arrays_zip(F.slice("placed", 1, F.greatest(F.size("placed") - 1, F.lit(0))).alias("a"),
                         F.slice("placed", 2, F.greatest(F.size("placed") - 1, F.lit(0))).alias("b"))
    whole = lambda p: p["a"]["word"].rlike(r"^\S+\z") & p["b"]["word"].rlike(r"^\S+\z")
    hit = lambda p: F.struct(
        F.lit("spacy").alias("engine"), F.lit("PER").alias("label"), p["a"]["start"].alias("start"),
        p["b"]["end"].alias("end"), F.lit(None).cast("double").alias("score"),
    ).cast(HIT)
    hits = settled(turns, placed=words).withColumn("hits", F.transform(F.filter(pairs, whole), hit))
    spans = hits.select("turn_id", F.inline_outer(outside.spans_of_hits("text", "hits")))
    return spans.where(F.col("start").isNotNull()).select(
        "turn_id", *_long("start", "end"), "value", "type", "confidence"
    )


# ---- tokens, restoring, checks -----------------------------------------------------------


def anonymized_text(spark, folder):
    return _anonymised(spark, folder).select("doc_id", "anonymized_text")


def token_mapping(spark, folder):
    return tk.mapping_table(_anonymised(spark, folder), "doc_id")


def sealed_mapping(spark, folder):
    """The mapping, saved under a passphrase in two parts and opened under a new passphrase."""
    path = _scratch(spark, "mapping")
    _, mapping = _stored_parts(spark, folder)
    for part in (0, 1):
        mp.save_mapping(mapping.where(F.col("doc_id") % 2 == part), path, "parola segreta", mode="append")
    mp.change_passphrase(spark, path, "parola segreta", "altra parola")
    return mp.load_mapping(spark, path, "altra parola")


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, MappingLog]:
    """Anonymised texts, and their mapping in a sealed log of four versions: version k holds the documents
    with doc_id % 4 of k - 1 and more, its values marked with k.  After the third the log is compacted."""
    done, mapping = _stored_parts(spark, folder)
    log = MappingLog(spark, _scratch(spark, "log"), "doc_id", buckets=8, passphrase="parola segreta")
    for k in range(1, 5):
        log.append(mapping.where(F.pmod("doc_id", F.lit(4)) >= k - 1).withColumn("value", F.concat("value", F.lit(f"#{k}"))))
        if k == 3:
            log.compact()
    return done, log


def mapping_versions(spark, folder):
    """The mapping as of the second version and as of the last."""
    _, log = _versions(spark, folder)
    second = log.snapshot(2).withColumn("as_of", F.lit("second"))
    return second.unionByName(log.snapshot().withColumn("as_of", F.lit("last")))


def restore_from_log(spark, folder):
    """Texts restored from the latest values in the log."""
    done, log = _versions(spark, folder)
    return log.restored(done.withColumnRenamed("anonymized_text", "response"), "doc_id").select("doc_id", "rehydrated_text")


def merged_mapping(spark, folder):
    """An older and a newer mapping of the same documents; the newer value stays."""
    _, newer = _stored_parts(spark, folder)
    older = newer.withColumn("value", F.lit("old")).unionByName(
        newer.select("doc_id", F.lit("[OLD_001]").alias("token"), "value")
    )
    return mp.merged(older.dropDuplicates(["doc_id", "token"]), newer, "doc_id").select(
        "doc_id", "token",
        F.when(F.col("token") != "[OLD_001]", F.col("value")).alias("value"),
    )


def highlighted_text(spark, folder):
    return flows.highlighted(documents(spark, folder)).select("doc_id", "highlighted_text")


def redacted_text(spark, folder):
    return flows.redacted(documents(spark, folder)).select("doc_id", "redacted_text")


def restore_roundtrip(spark, folder):
    back = flows.rehydrate_only(_anonymised(spark, folder).drop("validation"))
    return back.select("doc_id", "rehydrated_text", F.col("validation.is_valid").alias("is_valid"))


def restore_from_table(spark, folder):
    """Anonymised texts joined with the separate mapping table and restored, tokens in lower
    case as a responder may send them."""
    done, mapping = _stored_parts(spark, folder)
    texts = done.select("doc_id", F.lower("anonymized_text").alias("response"))
    scoped = texts.withColumn("scope", F.col("doc_id"))
    back = rs.restore_from_table(scoped, mapping.withColumnRenamed("doc_id", "scope"), "scope", "doc_id")
    return back.select("doc_id", "rehydrated_text")


def unknown_tokens(spark, folder):
    """Tokens of the anonymised texts that a mapping without the first tokens does not hold."""
    done, mapping = _stored_parts(spark, folder)
    partial = mapping.where(~F.col("token").endswith("001]"))
    return vd.unknown_tokens(done, partial, "doc_id").select("doc_id", *_long("place"), "token")


def leftover_tokens(spark, folder):
    """The same texts as if they were final: every token is left over or invented."""
    done, mapping = _stored_parts(spark, folder)
    partial = mapping.where(~F.col("token").endswith("001]"))
    left = vd.leftover_tokens(done, partial, "doc_id", text="anonymized_text")
    return left.select("doc_id", *_long("place"), "token", "error")


def leak_check(spark, folder):
    """Values of the map looked for in the anonymised and in the original text."""
    done = _anonymised(spark, folder)
    leaks = vd.anonymised_result("text", "entity_map")
    return done.select(
        "doc_id",
        F.col("validation.is_valid").alias("anonymized_ok"),
        F.size(leaks.getField("errors")).cast("bigint").alias("leaks_in_original"),
    )


def table_leaks(spark, folder):
    """Values replaced in any document of a language that stand in clear in a document of that language, looked
    for in the original texts with the mapping kept apart."""
    done = _stored(spark, flows.anonymise_only(documents(spark, folder, "doc_id", "lang", "text")).select("lang", "entity_map"), "mapped")
    texts = documents(spark, folder, "doc_id", "lang", "text")
    return vd.leaks_of_table(texts, tk.mapping_table(done, "lang"), "lang", key="doc_id", text="text")


def gate_report(spark, folder):
    """How many texts may be sent on, by language."""
    done = flows.anonymise_only(documents(spark, folder, "lang", "text"))
    return report.validity(done, "lang")


# ---- labelled texts with all types ---------------------------------------------------------


def form_spans(spark, folder):
    """Every pattern's finds in the labelled texts of customers."""
    return _spans(forms(spark, folder), "doc_id", 0.7, None)


def form_weak_spans(spark, folder):
    """The types that only a lower threshold finds."""
    return _spans(forms(spark, folder, WEAK_FIELDS), "doc_id", 0.6, None)


def form_anonymized(spark, folder):
    done = flows.anonymise_only(forms(spark, folder))
    return done.select("doc_id", "anonymized_text", F.col("validation.is_valid").alias("is_valid"))


def form_mapping(spark, folder):
    return tk.mapping_table(flows.anonymise_only(forms(spark, folder)), "doc_id")


def form_redacted(spark, folder):
    return flows.redacted(forms(spark, folder)).select("doc_id", "redacted_text")


def form_highlighted(spark, folder):
    return flows.highlighted(forms(spark, folder)).select("doc_id", "highlighted_text")


def form_restored(spark, folder):
    back = flows.rehydrate_only(flows.anonymise_only(forms(spark, folder)).drop("validation"))
    return back.select("doc_id", "rehydrated_text", F.col("validation.is_valid").alias("is_valid"))


def form_gate(spark, folder):
    """Texts that may be sent on and texts held back, by nation."""
    nations = table(spark, folder, "customer").select(F.col("c_custkey").alias("doc_id"), "c_nationkey")
    done = flows.anonymise_only(forms(spark, folder, GATE_FIELDS)).select("doc_id", "validation")
    return report.validity(done.join(nations, "doc_id"), "c_nationkey")


def session_restore(spark, folder):
    """Answers restored through sessions of one day, opened today, yesterday (in their last second) or
    the day before (expired: no text)."""
    now = F.expr("timestamp '2024-01-25 00:00:00'")
    opened = now - F.make_interval(days=(F.col("doc_id") % 3).cast("int"))
    done, mapping = _stored_parts(spark, folder, flows.anonymise_only(forms(spark, folder, GATE_FIELDS)))
    held = sessions.create_sessions(mapping, "doc_id", opened, 86_400)
    asked = done.select("doc_id", F.col("anonymized_text").alias("response"))
    asked = asked.join(held.select("doc_id", "session_id").distinct(), "doc_id")
    back, missed = sessions.restore_with_sessions(asked, held.drop("doc_id"), now, "doc_id")
    return back.select("doc_id", "rehydrated_text").unionByName(
        missed.select("doc_id", F.lit(None).cast("string").alias("rehydrated_text"))
    )


def form_processed(spark, folder):
    """The whole flow: answers with the values back in place, or the reason why a text was not sent."""
    return flows.process(forms(spark, folder, GATE_FIELDS)).select("doc_id", "final_response", "stopped")


# ---- prompts -----------------------------------------------------------------------------


def chunks(spark, folder):
    cut = chunk.chunk(documents(spark, folder), "text", 2000)
    return chunk.explode_chunks(cut, "doc_id").select("doc_id", *_long("part", "parts"), "chunk")


def chunk_prompts(spark, folder):
    made = chunk.with_prompts(documents(spark, folder), "text", limit=2000)
    rows = made.select("doc_id", F.posexplode_outer("prompts").alias("part", "prompt"))
    return rows.where(F.col("prompt").isNotNull()).select("doc_id", *_long("part"), "prompt")


def processed(spark, folder):
    done = flows.process(documents(spark, folder), limit=2000)
    return done.select(
        "doc_id", "llm_response_anonymized",
        F.size("detected_entities").cast("bigint").alias("entity_count"),
        F.col("validation.anonymization.is_valid").alias("sent"),
    )


# ---- columns, rows, files ----------------------------------------------------------------


def column_classification(spark, folder):
    """Every column of every table: how many values it holds and what its name announces."""
    return columns.profile_tables({t: table(spark, folder, t) for t in TABLES})


def row_serialize(spark, folder):
    return files.serialised_rows(table(spark, folder, "customer"), keep=("c_custkey",))


def json_flatten(spark, folder):
    events = spread(table(spark, folder, "events").select("event_id", "props"), ORDERS_EACH)
    return events.select("event_id", files.flat_json(F.col("props")).alias("text"))


def file_documents(spark, folder):
    """Documents as text files and conversation turns as JSON files, read back by suffix."""
    texts = table(spark, folder, "documents").select(
        F.concat("doc_id", F.lit(".txt")).alias("filename"), F.encode("text", "UTF-8").alias("content")
    )
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", F.concat("turn", F.lit(".json"))).alias("filename"),
        F.encode(F.to_json(F.struct("role", "text")), "UTF-8").alias("content"),
    )
    read = files.file_documents(spread(texts.unionByName(turns)))
    return read.select("source", "text", F.col("metadata.type").alias("format"), "error")


def upload_report(spark, folder):
    """Documents as uploads: good ones, too large ones, empty ones, ones without content, wrong and missing suffixes."""
    kind = F.pmod("doc_id", F.lit(6))
    suffix = F.when(kind == 1, ".TXT").when(kind == 2, ".exe").when(kind == 5, "").otherwise(".txt")
    content = F.when(kind == 3, F.encode(F.lit(""), "UTF-8")).when(kind != 4, F.encode("text", "UTF-8"))
    uploads = documents(spark, folder).select(F.concat("doc_id", suffix).alias("filename"), content.alias("content"))
    return files.upload_documents(uploads, most_bytes=4000).select("source", "text", "error")


def folder_report(spark, folder):
    """Documents as text files, one per language and source, beside files of another kind: entities per file, files in
    order of their paths.  Files are read and searched by line, so that no task holds a whole one."""
    path = _scratch(spark, "folder")
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    dealt = docs.repartition("lang", "source").sortWithinPartitions("lang", "source", "doc_id").drop("doc_id")
    dealt.write.partitionBy("lang", "source").text(path)
    docs.write.mode("append").partitionBy("lang", "source").parquet(path)
    # None of the patterns in force crosses lines.
    read = files.file_documents(files.read_lines(spark, f"{path}/*/*"))
    found = detect(read, threshold=0.75, types=["EMAIL", "CARD", "IP"])
    counted = report.batch_report(found, "source", "first")
    name = F.regexp_extract("source", "(lang=[^/]*/source=[^/]*)/[^/]*$", 1)
    return report.in_order(counted, "source").select(*_long("place", "documents", "entities"), "summary", name.alias("file"))


def written_results(spark, folder):
    """Anonymised texts and their entities, written as files with a manifest and as JSON, read back and checked."""
    done = _anonymised(spark, folder).withColumn("source", F.concat(F.lit("in/"), F.floor(F.col("doc_id") / 2).cast("string"), F.when(
        F.col("doc_id") % 2 == 0, ".txt").otherwise(".csv")))
    out = _scratch(spark, "results")
    sinks.write_results(done, out)
    sinks.write_json(done.select("source", F.size("entities").alias("entities")), f"{out}/json")
    told = spark.read.schema("source string, entities bigint").json(f"{out}/json")
    return sinks.read_results(spark, out).join(told, "source").select("source", "file", "anonymized_text", "ok", "entities")


def safe_outputs(spark, folder):
    """What may leave the system: entities without their values; and the map for clients that keep it."""
    done = _anonymised(spark, folder)
    public = flows.public_output(done, "doc_id")
    shown = F.transform("entities", lambda e: F.format_string("%s:%d-%d:%.3f", e["type"], e["start"], e["end"], e["confidence"]))
    held = flows.stateless_output(done, "doc_id").select("doc_id", F.size("mapping").alias("mapping_size"))
    return public.join(held, "doc_id").select(
        "doc_id", *_long("entity_count", "mapping_size"), F.array_join(shown, " ").alias("payload"),
        F.lit(",".join(f.name for f in public.schema["entities"].dataType.elementType.fields)).alias("fields"),
    )


def normalised_text(spark, folder):
    """Documents in decomposed spelling (a letter and a mark for ü and é), normalised again."""
    docs = documents(spark, folder)
    split = F.replace("text", F.lit("\u00fc"), F.lit("u\u0308"))
    split = F.replace(split, F.lit("\u00e9"), F.lit("e\u0301"))
    return files.text_documents(docs.withColumn("text", split))


def safe_paths(spark, folder):
    """Request paths of events with the session id hidden, counted."""
    path = F.when(
        F.col("event_type") == "view", F.concat(F.lit("/api/session/"), F.col("user_id"))
    ).otherwise(F.concat(F.lit("/api/"), F.col("event_type")))
    paths = table(spark, folder, "events").select(tx.safe_path(path).alias("path"))
    return paths.groupBy("path").agg(F.count("*").alias("n"))


# ---- sessions, admission, streams --------------------------------------------------------

DAY = 86_400


def session_ttl(spark, folder):
    """One session per user, made of the user's events, looked at on 25 January 2024."""
    events = table(spark, folder, "events")
    made = events.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("created"))
    entries = events.select("user_id", F.col("event_id").cast("string").alias("token")).join(made, "user_id")
    now = F.expr("timestamp '2024-01-25 00:00:00'")
    held = sessions.create_sessions(entries, "user_id", F.col("created"), 7 * DAY)
    alive = sessions.status(held, now).select("session_id", "entity_count", "expires_in")
    owners = held.select("session_id", "user_id").distinct()
    return alive.join(owners, "session_id").select("user_id", *_long("entity_count", "expires_in"))


def session_counts(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("token"), "user_id", F.col("ts").cast("timestamp").alias("ts")
    )
    now = F.expr("timestamp '2024-01-25 00:00:00'")
    per_event = sessions.create_sessions(events, "token", F.col("ts"), 7 * DAY)
    _, removed = sessions.evict(per_event, now)
    active = sessions.active_count(per_event, now)
    gone = removed.select(F.lit("removed").alias("sessions"), F.col("removed").alias("n"))
    return gone.unionByName(active.select(F.lit("active").alias("sessions"), F.col("active").alias("n")))


def session_expiry_stream(spark, folder):
    """A session per user and day, opened by its first event; entries arrive in four parts whose times
    overlap, so most of them come after their session has been reported."""
    events = table(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"))
    opened = events.groupBy("user_id", "day").agg(F.min("ts").alias("created_at"))
    entries = _stored(spark, events.join(opened, ["user_id", "day"]).select(
        F.concat_ws("/", "user_id", "day").alias("session_id"), "created_at", (F.col("event_id") % 4).alias("part")
    ), "entries")
    arrivals, files_each = _scratch(spark, "arrivals"), spark.sparkContext.defaultParallelism
    for part in range(4):
        entries.where(F.col("part") == part).drop("part").repartition(files_each).write.parquet(f"{arrivals}/part={part}")
    source = spark.readStream.schema(entries.drop("part").schema).option("maxFilesPerTrigger", files_each).parquet(f"{arrivals}/part=*")
    out, state = _scratch(spark, "expired"), _scratch(spark, "state")
    streams.expire_stream(source, out, state, 7 * DAY).awaitTermination()
    parts = F.split("session_id", "/")
    return streams.read_expired(spark, out).select(
        parts[0].cast("bigint").alias("user_id"), parts[1].alias("day"), "entity_count", F.unix_seconds("expires_at").alias("expires_at")
    )


def admission_of_events(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    done = admission.admit(events, "user_id", "ts", "event_id", 3, DAY)
    return done.select("event_id", "user_id", "admitted", *_long("retry_after"))


def stream_anonymise(spark, folder):
    """The documents as a stream, anonymised into Parquet, read back."""
    source = stream_of(spark, folder, "documents")
    out, state = _scratch(spark, "anonymised"), _scratch(spark, "state")
    rows = streams.anonymise_stream(source.select("doc_id", "text"), tasks=spark.sparkContext.defaultParallelism)
    streams.write_stream(rows.select("doc_id", "anonymized_text"), out, state).awaitTermination()
    return spark.read.parquet(out)


def stream_admission(spark, folder):
    """The events as a stream; every request with its verdict."""
    requests = stream_of(spark, folder, "events").select("event_id", "user_id", "ts")
    out, state = _scratch(spark, "admitted"), _scratch(spark, "state")
    streams.admit_stream(requests, out, state, "user_id", "ts", "event_id", 3, DAY).awaitTermination()
    done = streams.read_admitted(spark, out)
    return done.select("event_id", "user_id", "admitted", *_long("retry_after"))


QUERIES = {
    f.__name__: f
    for f in [
        form_spans, form_weak_spans, form_anonymized, form_mapping, form_redacted, form_highlighted, form_restored, form_gate,
        form_processed, session_restore,
        entity_stats, email_by_lang, ip_spans, card_luhn, url_in_pages, page_addresses,
        bic_in_conversations, date_spans, amount_spans, phone_and_ids, checksum_candidates,
        silent_docs, size_guard, dry_run, batch_report, source_stats, boosted_spans,
        recogniser_clean_up, anonymized_text, token_mapping, sealed_mapping, merged_mapping, mapping_versions, restore_from_log,
        highlighted_text, redacted_text, restore_roundtrip, restore_from_table, unknown_tokens,
        leftover_tokens, leak_check, table_leaks, gate_report, chunks, chunk_prompts, processed,
        ranked_types, rejected_hits, long_links, size_limits, upload_report, folder_report, written_results, safe_outputs,
        column_classification, row_serialize, json_flatten, file_documents, normalised_text,
        safe_paths, session_ttl, session_counts, session_expiry_stream, admission_of_events, stream_anonymise,
        stream_admission,
    ]
}
