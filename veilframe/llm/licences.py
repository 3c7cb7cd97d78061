"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Texts and templates become words of letters and digits (A-Z lowered, other ASCII signs count as spaces).  The
inverted index holds the winnowed fingerprints of long templates: of each `window` consecutive hashes of `gram`
words the smallest, so that any run of gram + window - 1 words in common shares one.  Templates whose `coverage`
allows changes that leave shorter runs have all their fingerprints in it, of as many words as such a run has at
least, and all of a document's are looked up.  Its hits on one template, grouped by place and diagonal, give regions; a local alignment in a
band of `band` words around the region's diagonals gives the matched words and their span.  Matches that cover
`coverage` of the template's words are reported, each place once per template, and where matches of several templates
overlap only the one with the most matched words.  The words that name a licence (`NAMING`) must stand in a match without
a change, so that CC BY-ND or version 3.0 is not taken for CC BY 4.0.

The index depends on the templates alone and goes to every task; documents are read in one pass without a shuffle.

Cases: null, empty or short texts have no matches; templates without words are never found; repeated rows are reported each; a null doc_id stays null; an empty table or no
templates give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import hashing as hs
from .common import only, table, text_buffers

# Public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        'shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY '
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
}
NAMING = {
    "MIT-notice": "MIT",
    "Apache-2.0-line": "Apache License, Version 2.0",
    "GPL-3.0-line": "GNU General Public License, version 3",
    "GPL-3.0-or-later": "the GNU General Public License as",
    "LGPL-2.1-or-later": "Lesser General Public License",
    "LGPL-3.0-or-later": "Lesser General Public License",
    "AGPL-3.0-or-later": "Affero General Public License",
    "MPL-2.0": "Mozilla Public License",
    "all-rights-reserved": "All rights reserved",
} | {name: "CC " + name[3:] for name in TEMPLATES if name.startswith("CC-")}
RESULT = "doc_id long, license string, start long, end long, first_word long, last_word long, matched long, coverage double"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _sign in range(128):
    if not chr(_sign).isalnum():
        _FOLD[_sign] = 32


def _words(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and hashes of the words of documents, with their numbers."""
    low, high = int(offsets[0]), int(offsets[-1])
    folded = _FOLD[data[low:high]]
    starts, ends, counts = hs.word_places(folded, offsets - low)
    return starts + low, ends + low, hs.word_hashes(folded, starts, ends)[0], counts


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window, the last of equal ones; all if there are fewer."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views, axis=1))


def _grams(words: np.ndarray, gram: int) -> np.ndarray:
    return hs.run_hashes((words, words), np.array([len(words)]), gram)[0]


def shortest_run(length: int, coverage: float) -> int:
    """Equal words in a row that a match has at least, when words are replaced as coverage allows."""
    least = max(1, math.ceil(coverage * length - 1e-9))
    return -(-least // (length - least + 1))


def _hashes(text: str) -> np.ndarray:
    return _words(*text_buffers(pa.array([text])))[2]


def index(templates: dict[str, str], gram: int, window: int, coverage: float = 0.8, naming: dict[str, str] = NAMING) -> dict:
    """Words of each template, its naming words, and the inverted index: sorted fingerprints with
    template and place."""
    words, entries, every = [], [], set()
    for name, text in templates.items():
        w = _hashes(text)
        words.append((name, w))
        run = shortest_run(len(w), coverage) if len(w) else 0
        size = min(gram, run)
        if size:
            grams = _grams(w, size)
            dense = run < gram + window - 1
            if dense:
                every.add(size)
            entries += [(size, int(grams[i]), len(words) - 1, i) for i in (range(len(grams)) if dense else winnow(grams, window).tolist())]
    sizes = {}
    for size in sorted({e[0] for e in entries}):
        some = sorted(e[1:] for e in entries if e[0] == size)
        sizes[size] = (np.array([e[0] for e in some], np.uint64), np.array([e[1:] for e in some], np.int64))
    named = [_hashes(naming[name]) if name in naming else None for name in templates]
    return {"words": words, "named": named, "sizes": sizes, "every": every, "window": window}


def align(doc: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int, int]:
    """Best local alignment (match 2, other steps -1) with places doc - template within `band` of the
    diagonal: score, matched words, first and last place in doc."""
    best, row_before = (0, 0, 0, -1), {}
    for j in range(len(template)):
        row = {}
        for i in range(max(0, j + diagonal - band), min(len(doc), j + diagonal + band + 1)):
            score, matched, first = row_before.get(i - 1, (0, 0, i))
            cell = (score + 2, matched + 1, first if score else i) if doc[i] == template[j] else (score - 1, matched, first)
            for other in (row_before.get(i), row.get(i - 1)):
                if other is not None and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            if cell[0] > 0:
                row[i] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], i)
        row_before = row
    return best


def _regions(places: np.ndarray, diagonals: np.ndarray, length: int, band: int) -> list[tuple[int, int, int]]:
    """Hits of one template in one document as (lowest diagonal, highest diagonal, first place)."""
    found: list[list[int]] = []
    for place, diagonal in sorted(zip(places.tolist(), diagonals.tolist(), strict=True)):
        for region in reversed(found):
            if place - region[2] > length + band:
                continue
            if region[0] - band <= diagonal <= region[1] + band:
                region[0], region[1] = min(region[0], diagonal), max(region[1], diagonal)
                break
        else:
            found.append([diagonal, diagonal, place])
    return [tuple(r) for r in found]


def _holds(words: np.ndarray, run: np.ndarray | None) -> bool:
    if run is None or not len(run):
        return True
    return len(words) >= len(run) and bool((np.lib.stride_tricks.sliding_window_view(words, len(run)) == run).all(axis=1).any())


def scan_words(words: np.ndarray, made: dict, band: int, coverage: float) -> list[tuple[int, int, int, int, float]]:
    """Matches in one document's words: template, first and last word, matched words, coverage."""
    hits = []
    for size, (known, where) in made["sizes"].items():
        if len(words) < size:
            continue
        grams = _grams(words, size)
        picked = np.arange(len(grams)) if size in made["every"] else winnow(grams, made["window"])
        low, high = np.searchsorted(known, grams[picked]), np.searchsorted(known, grams[picked], "right")
        for k in np.flatnonzero(high > low).tolist():
            hits += [(int(t), int(picked[k]), int(picked[k]) - int(p)) for t, p in where[low[k] : high[k]]]
    out = []
    for t in sorted({h[0] for h in hits}):
        template = made["words"][t][1]
        some = np.array([h[1:] for h in hits if h[0] == t])
        for low, high, _ in _regions(some[:, 0], some[:, 1], len(template), band):
            # Notices that follow one another share a region: what is left of a match and right of it is searched again.
            todo = [(max(0, low - band), min(len(words), high + len(template) + band))]
            while todo:
                start, stop = todo.pop()
                part = words[start:stop]
                if len(part) < coverage * len(template):
                    continue
                _, matched, first, last = align(part, template, (low + high) // 2 - start, band + (high - low + 1) // 2)
                if matched >= coverage * len(template):
                    todo += [(start, start + first), (start + last + 1, stop)]
                    if _holds(part[first : last + 1], made["named"][t]):
                        out.append((t, start + first, start + last, matched, matched / len(template)))
    kept: list = []
    for m in sorted(out, key=lambda m: (-m[3], -m[4], m[1], m[0])):
        if all(m[2] < o[1] or m[1] > o[2] for o in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[1])


def _scan(batches: Iterator[pa.RecordBatch], made, band: int, coverage: float) -> Iterator[pa.RecordBatch]:
    made = made.value
    every = np.unique(np.concatenate([known for known, _ in made["sizes"].values()])) if made["sizes"] else np.zeros(0, np.uint64)
    fields = [x.split() for x in RESULT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        data, offsets = text_buffers(batch.column("text"))
        rows = []
        for i, j in hs.pieces(offsets):
            starts, ends, words, counts = _words(data, offsets[i : j + 1])
            cuts = np.append(0, np.cumsum(counts))
            likely = np.zeros(j - i, bool)
            for size in made["sizes"]:
                grams, _, owner = hs.run_hashes((words, words), counts, size)
                likely[owner[np.isin(grams, every)]] = True
            for d in np.flatnonzero(likely).tolist():
                for t, first, last, matched, share in scan_words(words[cuts[d] : cuts[d + 1]], made, band, coverage):
                    low = int(offsets[i + d])
                    chars = [int(np.count_nonzero((data[low : int(x)] & 0xC0) != 0x80)) for x in (starts[cuts[d] + first], ends[cuts[d] + last])]
                    rows.append((ids[i + d], made["words"][t][0], *chars, first, last, matched, share))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _call(work, how, batches):
    return work(batches, **how)


def scan(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, gram: int = 3, window: int = 2, band: int = 4, coverage: float = 0.8,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per match: doc_id, license, start and end in characters, first_word, last_word,
    matched (words) and coverage of the template."""
    made = docs.sparkSession.sparkContext.broadcast(index(templates, gram, window, coverage))
    rows = only(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_call, _scan, {"made": made, "band": band, "coverage": coverage}), RESULT)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))
