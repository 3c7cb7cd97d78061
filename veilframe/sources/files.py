"""Files and uploads as a table of documents: text, CSV, JSON and DOCX by suffix.

Plain text is decoded inside the JVM.  The other formats have no reader for "one file, one
text", so their bytes, and only theirs, go to small parsers in Python.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv, text as tx
from ..functions.settle import settled
from ..operators.columns import sensitive_columns

# Windows-1252 gives these characters to the bytes 80 to 9F; the five bytes it
# leaves out make a file Latin-1.
CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
LATIN_ONLY = r"[\x81\x8d\x8f\x90\x9d]"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PARSED = "struct<text:string,columns:array<string>,rows:bigint,error:string>"


def decoded(content: Column, encoding: Column | None = None) -> Column:
    """Bytes as text: UTF-8 without its mark, else Windows-1252, else Latin-1; line ends as \\n.  ``encoding`` names that of
    the file where the bytes are a part of one."""
    as_utf8 = F.regexp_replace(content.cast("string"), "^\ufeff", "")
    as_latin = F.decode(content, "ISO-8859-1")
    as_windows = F.when(as_latin.rlike(LATIN_ONLY), as_latin).otherwise(
        F.translate(as_latin, CP1252_BYTES, CP1252_CHARS)
    )
    text = F.when(F.is_valid_utf8(content.cast("string")), as_utf8).otherwise(as_windows)
    if encoding is not None:
        windows = F.translate(as_latin, CP1252_BYTES, CP1252_CHARS)
        text = F.when(encoding == "UTF-8", content.cast("string")).when(encoding == "ISO-8859-1", as_latin).otherwise(windows)
    return F.regexp_replace(text, "\r\n?", "\n")


def _flat(value, key: str | None = None) -> Iterator[str]:
    """Lines of a JSON value: ``key: scalar`` in objects, the bare scalar elsewhere."""
    if isinstance(value, dict):
        for name, item in value.items():
            yield from _flat(item, name)
    elif isinstance(value, list):
        for item in value:
            yield from _flat(item)
    elif value is not None and str(value).strip():
        yield str(value) if key is None else f"{key}: {value}"


def json_lines(content: str) -> str:
    """The lines of a JSON text; with none to show, the value itself, indented."""
    value = json.loads(content)
    if not isinstance(value, (dict, list)) and value is not None:
        return str(value)
    return "\n".join(_flat(value)) or json.dumps(value, ensure_ascii=False, indent=2)


def _parse_json(content: bytes) -> dict:
    return {"text": json_lines(content.decode("utf-8"))}


def _parse_csv(content: bytes) -> dict:
    """One line per record, empty cells left out; numbers are read as such over whole columns."""
    table = pd.read_csv(io.BytesIO(content))
    names, cells = [str(c) for c in table.columns], table.to_numpy()
    shown = ~pd.isna(cells)
    lines = []
    for record, filled in zip(cells, shown):
        lines.append(" | ".join([f"{names[i]}: {record[i]}" for i in filled.nonzero()[0]]))
    return {"text": "\n".join(lines), "columns": names, "rows": len(lines)}


def _paragraph(node) -> str:
    signs = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(
        (part.text or "") if part.tag == f"{_W}t" else signs.get(part.tag, "")
        for run in node.iter(f"{_W}r")
        for part in run
    )


def _table_lines(table) -> Iterator[str]:
    above: dict[int, str] = {}
    for row in table.findall(f"{_W}tr"):
        place, shown, current = 0, [], {}
        for cell in row.findall(f"{_W}tc"):
            span = cell.find(f"{_W}tcPr/{_W}gridSpan")
            merge = cell.find(f"{_W}tcPr/{_W}vMerge")
            text = "\n".join(_paragraph(p) for p in cell.findall(f"{_W}p")).strip()
            if merge is not None and merge.get(f"{_W}val", "continue") == "continue":
                text = above.get(place, text)
            width = int(span.get(f"{_W}val")) if span is not None else 1
            current.update(dict.fromkeys(range(place, place + width), text))
            place += width
            if text and (not shown or shown[-1] != text):
                shown.append(text)
        above = current
        if shown:
            yield " | ".join(shown)


def _parse_docx(content: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        body = ElementTree.fromstring(parts.read("word/document.xml")).find(f"{_W}body")
    lines = [t for p in body.findall(f"{_W}p") if (t := _paragraph(p)).strip()]
    for table in body.findall(f"{_W}tbl"):
        lines += _table_lines(table)
    return {"text": "\n".join(lines)}


_PARSERS: dict[str, Callable[[bytes], dict]] = {
    ".json": _parse_json, ".csv": _parse_csv, ".docx": _parse_docx,
}


def _parsed(suffix: str, content: bytes | None) -> dict:
    empty = {"text": None, "columns": None, "rows": None, "error": None}
    if content is None:
        return empty
    try:
        return empty | _PARSERS[suffix](bytes(content))
    except Exception as problem:  # a bad file becomes a row with its error, not a failed job
        return empty | {"error": f"{type(problem).__name__}: {problem}"}


def _any_case(suffixes: Iterable[str]) -> str:
    names = ",".join(s[1:] for s in suffixes)
    return "*.{" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in names) + "}"


def _whole(spark: SparkSession, path: str, suffixes: Iterable[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", _any_case(suffixes)).load(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The supported files of one folder, not its subfolders, as (filename, content)."""
    return _whole(spark, path, fv.SUPPORTED_SUFFIXES).select(F.col("path").alias("filename"), "content")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same with text files line by line, as (filename, content, encoding, first), so that no row holds a whole one.

    Every file has one row marked as ``first``; for text files that row is empty and the lines follow, in no order, each with
    its end.  The encoding is that of the file; a line alone may fit another.
    """
    spaced = spark.read.option("pathGlobFilter", _any_case([".txt"])).option("lineSep", "\n").text(path)
    # As binaryFile names its files; the names are the same strings.
    lines = spaced.select(F.regexp_replace("_metadata.file_path", "^file:///", "file:/").alias("filename"), F.col("value").cast("binary").alias("content"))
    bad = lines.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("filename").distinct()
    latin = F.max(F.decode("content", "ISO-8859-1").rlike(LATIN_ONLY))
    told = lines.join(bad, "filename", "left_semi").groupBy("filename").agg(F.when(latin, "ISO-8859-1").otherwise("windows-1252").alias("encoding"))
    rows = lines.join(told, "filename", "left").select(
        "filename", F.concat("content", F.lit(b"\n")).alias("content"), F.coalesce("encoding", F.lit("UTF-8")).alias("encoding"), F.lit(False).alias("first")
    )
    heads = _whole(spark, path, [".txt"]).select(F.col("path").alias("filename"), F.lit(b"").alias("content"))
    others = _whole(spark, path, [s for s in fv.SUPPORTED_SUFFIXES if s != ".txt"]).select(F.col("path").alias("filename"), "content")
    return rows.unionByName(heads.unionByName(others).withColumns({"encoding": F.lit("UTF-8"), "first": F.lit(True)}))


def suffix_of(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(?s)[^/.][^/]*?(\.[^./]+)\z", 1))


def file_documents(files: DataFrame) -> DataFrame:
    """Files or uploads (filename, content) as documents.

    Columns: ``source``, ``text`` (NFC), ``metadata`` and ``error``.  The content is never
    taken for a path.  A file that cannot be read keeps its row, with the error.  Rows of ``read_lines`` keep their mark.
    """
    by_line = {"encoding", "first"} <= set(files.columns)

    @F.pandas_udf(_PARSED)
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for suffixes, contents in batches:
            rows = [_parsed(s, c) for s, c in zip(suffixes, contents)]
            yield pd.DataFrame(rows, dtype=object)

    suffix = F.col("suffix")
    named = files.withColumn("suffix", suffix_of(F.col("filename")))
    for_parser = F.when(suffix.isin(*_PARSERS), F.col("content"))
    read = settled(named, parsed=parse(suffix, for_parser))
    text = F.when(suffix == ".txt", decoded(F.col("content"), F.col("encoding") if by_line else None)).otherwise(F.col("parsed.text"))
    error = F.when(
        ~suffix.isin(".txt", *_PARSERS), F.format_string(fv.UNSUPPORTED_FORMAT_ERROR, suffix)
    ).otherwise(F.col("parsed.error"))
    names = F.col("parsed.columns")
    metadata = F.struct(
        F.when(suffix != ".txt", F.translate(suffix, ".", "")).alias("type"),
        names.alias("columns"),
        F.col("parsed.rows").alias("rows"),
        F.when(names.isNotNull(), sensitive_columns(names)).alias("sensitive_columns"),
    )
    return read.select(
        F.col("filename").alias("source"),
        tx.nfc(text).alias("text"),
        metadata.alias("metadata"),
        error.alias("error"),
        *(["first"] if by_line else []),
    )


def upload_documents(uploads: DataFrame, most_bytes: int = fv.MAX_UPLOAD_BYTES) -> DataFrame:
    """Uploads (filename, content) within the size limit; others keep a row with an error."""
    size = F.coalesce(F.length("content"), F.lit(0))
    refusal = F.when(size > most_bytes, "too large").when(size == 0, "empty")
    checked = uploads.withColumn("refusal", refusal)
    good = file_documents(checked.where(F.col("refusal").isNull()))
    bad = checked.where(F.col("refusal").isNotNull())
    return good.unionByName(
        bad.select(F.col("filename").alias("source"), F.col("refusal").alias("error")),
        allowMissingColumns=True,
    )


def flat_json(content: Column) -> Column:
    """A JSON column as ``key: value`` lines, keys in their order; malformed or
    too deeply nested JSON gives null."""

    def lines(text: str | None) -> str | None:
        try:
            return None if text is None else json_lines(text)
        except (ValueError, RecursionError):  # malformed, or nested deeper than the parser goes
            return None

    @F.pandas_udf("string")
    def flatten(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lines)

    return flatten(content)


def text_documents(table: DataFrame, text: str = "text") -> DataFrame:
    """Any table with a text column as documents: the text in NFC."""
    return settled(table, **{text: tx.nfc(F.col(text))})


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file row by row.  All columns are strings, so no value changes its spelling."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def serialised_rows(table: DataFrame, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row as one document ``column: value | column: value``, nulls left out."""
    named = [
        F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string")) for c in columns or table.columns
    ]
    return table.select(*keep, F.concat_ws(" | ", *named).alias("text"))
