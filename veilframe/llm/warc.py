"""WARC archives with a two-level capture index.

Archives: each task writes its rows as records, one gzip member each, to a file in the shared folder.
Of records with equal payloads of `min_bytes` at least, that with the smallest page_id is the response
and the others are revisits that name it.  A file's name is new for each attempt at a task, and its
index rows carry that name, so a repeated task leaves a spare file and never a wrong reference.

Index: captures are sorted by (reversed-host URL key, page_id) over range partitions, which may cut
through a host or one URL.  Each partition is a shard: a file of gzip blocks of `block_lines` lines, and a
directory file with the first key and the place of each block.  The driver holds one line per shard
(at most the number of partitions), never a line per block.

Look-up: keys are sorted over range partitions; a task searches the shards' first keys, then the shard's
directory, both by bisection, range-reads the block and searches it.  Records found are sorted by file and
place and range-read; length and digest are taken from the payload that was read.  A revisit has no payload:
its response is read in the same pass and joined by page_id, the length taken from there.

Cases: null payloads are empty; a null URL has an empty key and no target header; a null page_id is a row
like others (its key sorts first, nothing refers to it unless it is alone); repeated rows are
separate records; empty tables give an empty index and result; other columns are not read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import os
import urllib.parse
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import only, sha256_of, shared_folder, stored, table

NO_ID = -(1 << 63)
CAPTURES = "urlkey string, page_id long, file string, offset long, length long"
SHARDS = "file string, first_key binary, first_id long, blocks long, lines long, directory_bytes long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
FILE_BYTES = 1 << 30


def url_key(url: Column) -> Column:
    """Host reversed at its dots, then port and path: http://a.example.com/x -> com,example,a)/x"""
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/:?#]*)([^#]*)"
    host = F.lower(F.regexp_extract(url, parts, 1))
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(url, parts, 2)), F.lit(""))


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", "2024-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))))))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if first is not None:
        head += [("WARC-Refers-To", _urn(first)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        payload = b""
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = _open(folder)
    out, name, place = None, "", 0
    try:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or place >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, place = f"pages-{os.urandom(12).hex()}.warc.gz", 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                body = gzip.compress(_record(r["page_id"], r["url"], (r["payload"] or "").encode(), r["digest"], r["first"]), 1, mtime=0)
                out.write(body)
                rows.append((r["urlkey"], r["page_id"], name, place, len(body)))
                place += len(body)
            yield _batch(CAPTURES, rows)
    finally:
        if out is not None:
            out.close()


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 100, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the records; one capture per row: urlkey, page_id, file, offset, length."""
    rows = only(pages, page_id=key, url=url, payload=payload).withColumn("page_id", F.col("page_id").cast("long")).withColumn(
        "digest", sha256_of(F.coalesce("payload", F.lit("")))
    ).withColumn("urlkey", url_key(F.col("url")))
    long_ones = rows.where(F.octet_length("payload") >= min_bytes)
    firsts = stored(long_ones.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    joined = rows.join(firsts, "digest", "left")
    revisits = (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    named = joined.select("page_id", "url", "urlkey", "payload", "digest", F.when(revisits, F.col("first")).alias("first"))
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    return stored(named.mapInArrow(partial(_call, _write, {"folder": folder}), CAPTURES), "captures")


def _shard(batches: Iterator[pa.RecordBatch], folder: str, block_lines: int) -> Iterator[pa.RecordBatch]:
    files, root = _open(folder)
    name, place, lines, directory, first, total = f"shard-{os.urandom(12).hex()}", 0, [], [], None, 0
    out = None

    def flush():
        nonlocal place, lines
        body = zlib.compress(json.dumps(lines).encode(), 6)
        out.write(body)
        directory.append((lines[0][0], lines[0][1], place, len(body)))
        place += len(body)
        lines = []

    try:
        for batch in batches:
            for key, page, file, offset, length in zip(*(batch.column(n).to_pylist() for n in ("urlkey", "page_id", "file", "offset", "length")), strict=True):
                if out is None:
                    out, first = files.open_output_stream(f"{root}/{name}.cdx", compression=None), (key.encode(), NO_ID if page is None else page)
                lines.append((key, NO_ID if page is None else page, file, offset, length))
                total += 1
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
    finally:
        if out is not None:
            out.close()
    if first:
        body = zlib.compress(json.dumps(directory).encode(), 6)
        with files.open_output_stream(f"{root}/{name}.dir", compression=None) as to:
            to.write(body)
        yield _batch(SHARDS, [(name, *first, len(directory), total, len(body))])


def build_index(captures: DataFrame, folder: str, block_lines: int = 3000) -> list[tuple[bytes, int, str]]:
    """Write shards and directories; the first key of each shard, in order."""
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    ordered = captures.repartitionByRange("urlkey", F.col("page_id").asc_nulls_first()).sortWithinPartitions("urlkey", F.col("page_id").asc_nulls_first())
    shards = stored(ordered.mapInArrow(partial(_call, _shard, {"folder": folder, "block_lines": block_lines}), SHARDS), "shards")
    return sorted((bytes(r["first_key"]), r["first_id"], r["file"]) for r in shards.collect())


class _Index:
    """Reads shards through the directory; keeps the last directory and the last block."""

    def __init__(self, folder: str, shards: list):
        self.files, self.root = _open(folder)
        self.shards, self.firsts = shards, [x[:2] for x in shards]
        self.directory: tuple = (None, [], [])
        self.block: tuple = (None, [], [])

    def _directory(self, k: int):
        if self.directory[0] != k:
            with self.files.open_input_stream(f"{self.root}/{self.shards[k][2]}.dir", compression=None) as f:
                rows = json.loads(zlib.decompress(f.read()))
            self.directory = (k, [(r[0].encode(), r[1]) for r in rows], rows)
        return self.directory[1:]

    def _block(self, k: int, i: int):
        if self.block[0] != (k, i):
            _, _, place, length = self._directory(k)[1][i]
            with self.files.open_input_file(f"{self.root}/{self.shards[k][2]}.cdx") as f:
                lines = json.loads(zlib.decompress(f.read_at(length, place)))
            self.block = ((k, i), [(r[0].encode(), r[1]) for r in lines], lines)
        return self.block[1:]

    def find(self, key: tuple[bytes, int]) -> Iterator[list]:
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.shards)):
            if self.firsts[k] > key:
                return
            firsts, _ = self._directory(k)
            for i in range(max(0, bisect.bisect_left(firsts, key) - 1), len(firsts)):
                if firsts[i] > key:
                    return
                keys, lines = self._block(k, i)
                at = bisect.bisect_left(keys, key)
                while at < len(keys) and keys[at] == key:
                    yield lines[at]
                    at += 1


def _find(batches: Iterator[pa.RecordBatch], folder: str, shards: list) -> Iterator[pa.RecordBatch]:
    index = _Index(folder, shards)
    for batch in batches:
        found = []
        for key, page in zip(batch.column("urlkey").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
            for line in index.find((key.encode(), NO_ID if page is None else page)):
                found.append((key, page, *line[2:]))
        yield _batch(CAPTURES, found)


def look_up(keys: DataFrame, folder: str, shards: list) -> DataFrame:
    """Captures of the keys (urlkey, page_id), found through the index."""
    order = [F.col("urlkey"), F.col("page_id").asc_nulls_first()]
    asked = keys.select("urlkey", "page_id").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    return asked.mapInArrow(partial(_call, _find, {"folder": folder, "shards": shards}), CAPTURES)


def _parse(record: bytes) -> tuple[dict, bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _number(urn: str) -> int | None:
    value = urn[len("<urn:page:") : -1]
    return None if value == "none" else int(value)


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = _open(folder)
    name, source = None, None
    for batch in batches:
        rows = []
        for file, offset, length in zip(*(batch.column(n).to_pylist() for n in ("file", "offset", "length")), strict=True):
            if file != name:
                name, source = file, files.open_input_file(f"{root}/{file}")
            fields, payload = _parse(gzip.decompress(source.read_at(length, offset)))
            digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
            first = _number(fields["WARC-Refers-To"]) if kind == "revisit" else None
            rows.append((_number(fields["WARC-Record-ID"]), len(payload) if kind == "response" else None, digest, kind, first, fields.get("WARC-Target-URI")))
        yield _batch(READ, rows)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records of the captures, range-read; revisits get the length of their response."""
    near = captures.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    records = stored(near.mapInArrow(partial(_call, _read, {"folder": folder}), READ), "records")
    # Only responses that are referred to are needed; a few more do no harm and need no join.
    lengths = records.where((F.col("record_type") == "response") & F.col("page_id").isNotNull()).groupBy(
        F.col("page_id").alias("_first"), F.col("payload_digest").alias("_digest")
    ).agg(F.max("payload_bytes").alias("_bytes"))
    needed = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("_first")).distinct()
    lengths = lengths.join(needed, "_first", "left_semi")
    joined = records.join(lengths, (F.col("refers_to") == F.col("_first")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "target_uri"
    )


def _call(work, how, batches):
    return work(batches, **how)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives and index, look every page up, read its record back."""
    spark = pages.sparkSession
    archives, index = shared_folder(spark, "warc"), shared_folder(spark, "cdx")
    captures = write_archives(pages, archives)
    shards = build_index(captures, index)
    keys = pages.select(url_key(F.col("url")).alias("urlkey"), F.col("page_id").cast("long").alias("page_id"))
    return read_records(look_up(keys, index, shards), archives)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "pages")).drop("target_uri")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha256(coalesce(html, '')) payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END refers_to FROM f
"""
