"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass
Viterbi search.

The automaton reads a text once; at each place it follows the output links to every piece that ends there and
relaxes the best score of a segmentation up to that place.  The result is the segmentation with the highest sum of
piece scores (of equal sums, the one with the longer last piece at each place), the encoding of a unigram model.
Model files with merge ranks instead of log-probabilities (scores 0, -1, -2 ...) get the score -log(rank + 2), a
frequency by Zipf's law, so that sums can be compared; ids then differ from those of merging in some words.

No piece holds a space mark after another character, so a text falls apart before each run of space marks and the
search runs once per different part; a bounded cache keeps the results.  Otherwise the whole text is one part.

Characters without a piece become their UTF-8 bytes' pieces, or the unknown piece if the model has none.
Decoding joins the pieces' bytes and drops the space that encoding puts first.

Cases: null and empty texts have no ids; decoding returns the text with every U+2581 as a space, exactly,
if the model has byte pieces; repeated rows get equal ids; ids may be null; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import only, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE = 400_000
PARTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def load(path: str = MODEL) -> dict:
    """Pieces, scores and special ids of a model file; read on the driver and sent to tasks."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = {i for i in ids if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)}
    names = [model.id_to_piece(i) for i in ids]
    scores = [model.get_score(i) for i in ids]
    if all(float(s).is_integer() for s in scores):
        scores = [-math.log(2 - s) for s in scores]
    return {
        "pieces": {names[i]: (i, scores[i]) for i in ids if i not in special},
        "bytes": [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(model.is_byte(i) for i in ids) else None,
        "unknown": model.unk_id(), "size": len(names),
    }


class Encoder(dict):
    """Part of a text -> its ids as bytes of int32."""

    def __init__(self, model: dict):
        super().__init__()
        self.pieces, self.bytes, self.unknown = model["pieces"], model["bytes"], model["unknown"]
        self.lowest = min((s for _, s in self.pieces.values()), default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for name, (i, score) in self.pieces.items():
            self.automaton.add_word(name, (len(name), score, i))
        self.automaton.make_automaton()
        self.separable = not any(SPACE in name.lstrip(SPACE) for name in self.pieces)
        self.table = [b""] * model["size"]
        for name, (i, _) in self.pieces.items():
            self.table[i] = name.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes or ()):
            self.table[i] = bytes([b])

    def best(self, part: str) -> list[int]:
        n = len(part)
        score, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
        place, pieces = 0, self.pieces

        def settle(to: int):
            """Places up to `to` have all their pieces; a character without one may stand alone."""
            nonlocal place
            while place < to:
                place += 1
                if part[place - 1] not in pieces and score[place - 1] + self.lowest > score[place]:
                    score[place], back[place] = score[place - 1] + self.lowest, (1, -1)

        for end, (length, value, i) in self.automaton.iter(part) if len(pieces) else ():
            settle(end)
            total = score[end + 1 - length] + value
            if total > score[end + 1]:
                score[end + 1], back[end + 1] = total, (length, i)
        settle(n)
        out, at = [], n
        while at:
            length, i = back[at]
            if i >= 0:
                out.append(i)
            elif self.bytes is None:
                out.append(self.unknown)
            else:
                out.extend(self.bytes[b] for b in reversed(part[at - 1].encode()))
            at -= length
        return out[::-1]

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.best(part), np.int32).tobytes()
        if len(part) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        marked = SPACE + text.replace(" ", SPACE)
        return np.frombuffer(b"".join(map(self.__getitem__, PARTS.findall(marked) if self.separable else [marked])), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode(errors="replace")[1:]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _encode(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(model.value)
    for batch in _slices(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = [encoder.encode(t) for t in texts]
        same = [encoder.decode(a) == t.replace(SPACE, " ") for a, t in zip(ids, texts, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(a) for a in ids], pa.int64()), _lists(ids), pa.array(same, pa.bool_())],
            names=["doc_id", "n_tokens", "token_ids", "round_trip"],
        )


def _decode(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(model.value)
    for batch in _slices(batches):
        texts = [encoder.decode(np.array(x or [], np.int32)) for x in batch.column("token_ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _call(work, how, batches):
    return work(batches, **how)


def encoded(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, token_ids and whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    rows = only(docs, doc_id="doc_id", text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_call, _encode, {"model": shared}), "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, token_ids)."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))
    return only(rows, doc_id="doc_id", token_ids="token_ids").mapInArrow(partial(_call, _decode, {"model": shared}), "doc_id long, text string")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"))
