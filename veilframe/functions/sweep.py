"""All rules over a batch of texts in one sweep, for many rules at once.

Tables of 64-bit masks say which rules may have a match that begins at a place: one look-up for the character before it
and for each of the first WIDTH characters, and a bit for each way a rule can begin.  All are derived from the patterns.
Only at the places that are left a pattern is tried; it decides by itself.  Characters beyond the tables are taken to
fit every class that is not a list of characters.  A text with runs of characters that patterns repeat without limit is left to the caller.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from re import _constants as c, _parser

import numpy as np
import pyarrow as pa

from . import fixed_values as fv

WIDTH = 8
# Masks of so many first characters are looked up at every place, the others where these leave a bit.
EVERYWHERE = 3
# Code points below have entries of their own.
TABLE = 0x2200
# Characters of text that are swept at once.
SLICE = 1 << 17
SEPARATOR = "\n"
RUN = 40
# What patterns repeat without limit: white space and signs between a label and its value, letters, digits.
RUNS = [r"[\s.:#nNº°]", r"[^\W\d_]|['’]", r"[0-9.]"]

_CATEGORIES = {c.CATEGORY_DIGIT: r"\d", c.CATEGORY_SPACE: r"\s", c.CATEGORY_WORD: r"\w",
               c.CATEGORY_NOT_DIGIT: r"\D", c.CATEGORY_NOT_SPACE: r"\S", c.CATEGORY_NOT_WORD: r"\W"}
_REPEATS = (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT)


@functools.cache
def _fitting(pattern: str, ignore_case: bool) -> np.ndarray:
    """Which characters a pattern of one character fits; the last entry is for all beyond the table."""
    fits = np.zeros(TABLE + 1, bool)
    found = re.findall(f"(?s:{pattern})", "".join(map(chr, range(TABLE))), re.IGNORECASE if ignore_case else 0)
    fits[[ord(x) for x in found]] = True
    fits[TABLE] = bool(re.search(r"\\[wWdDsS]|\[\^", pattern))
    return fits


def _one(op, given) -> str | None:
    """A node that fits one character, as a pattern."""
    if op is c.LITERAL:
        return re.escape(chr(given))
    if op is c.NOT_LITERAL:
        return f"[^{re.escape(chr(given))}]"
    if op is c.ANY:
        return "[^\\n]"
    if op is not c.IN:
        return None
    out = []
    for kind, value in given:
        if kind is c.NEGATE:
            out.append("^")
        elif kind is c.RANGE:
            out.append("-".join(re.escape(chr(x)) for x in value))
        else:
            out.append(_CATEGORIES[value] if kind is c.CATEGORY else re.escape(chr(value)))
    return f"[{''.join(out)}]"


# What a pattern may begin with: by the number of characters that are known of it, WIDTH at most, which ones fit each place.
_Front = dict[int, list[np.ndarray]]


def _either(*fronts: _Front) -> _Front:
    out: _Front = {}
    for front in fronts:
        for n, sets in front.items():
            out[n] = [a | b for a, b in zip(out[n], sets)] if n in out else sets
    return out


def _then(first: _Front, second: _Front) -> _Front:
    whole = {WIDTH: first[WIDTH]} if WIDTH in first else {}
    for n, sets in first.items():
        if n < WIDTH:
            whole = _either(whole, *({min(n + m, WIDTH): (sets + more)[:WIDTH]} for m, more in second.items()))
    return whole


def _front(items, ignore_case: bool) -> _Front:
    front: _Front = {0: []}
    for op, given in items:
        single = _one(op, given)
        if single is not None:
            step = {1: [_fitting(single, ignore_case)]}
        elif op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            continue
        elif op is c.SUBPATTERN:
            _, added, removed, body = given
            step = _front(body, (ignore_case or bool(added & c.SRE_FLAG_IGNORECASE)) and not removed & c.SRE_FLAG_IGNORECASE)
        elif op is c.BRANCH:
            step = _either(*(_front(body, ignore_case) for body in given[1]))
        elif op in _REPEATS:
            least, most, body = given
            once, so_far = _front(body, ignore_case), {0: []}
            step = {}
            for n in range(min(most, max(least, WIDTH)) + 1):
                if n >= least:
                    step = _either(step, so_far)
                so_far = _then(so_far, once)
        else:
            raise ValueError(f"no front is known of {op}")
        front = _then(front, step)
        if min(front) == WIDTH:
            break
    return front


def _sets(front: _Front) -> list[np.ndarray]:
    """The characters that fit each of the first WIDTH places; all, where a match may have ended."""
    every = np.ones(TABLE + 1, bool)
    return [
        every if min(front) <= k else functools.reduce(np.logical_or, [sets[k] for n, sets in front.items() if n > k])
        for k in range(WIDTH)
    ]


def _ways(items, ignore_case: bool) -> Iterator[tuple[list, bool]]:
    """The alternatives that a pattern begins with, each with what follows them."""
    items = list(items)
    at = next((i for i, (op, _) in enumerate(items) if op not in (c.AT, c.ASSERT, c.ASSERT_NOT)), 0)
    op, given = items[at]
    if op is c.SUBPATTERN and not given[1] and not given[2]:
        yield from _ways([*items[:at], *given[-1], *items[at + 1:]], ignore_case)
    elif op is c.BRANCH:
        for body in given[1]:
            yield from _ways([*items[:at], *body, *items[at + 1:]], ignore_case)
    else:
        yield items, ignore_case


class _Sweeper:
    """The rules of one query, ready to be swept over texts."""

    def __init__(self, rules: tuple[tuple[int, str, float, str], ...]):
        self.rules = rules
        self.tries = [re.compile(pattern, re.IGNORECASE) for *_, pattern in rules]
        self.groups = ["v" if "v" in pattern.groupindex else 0 for pattern in self.tries]
        self.runs = [self._run(pattern) for *_, pattern in rules]
        self.wild = [_fitting(run, False) for run in RUNS]
        lanes = [(i, before, sets) for i, rule in enumerate(rules) for before, sets in self._lanes(rule[-1])]
        self.words = []
        for begin in range(0, len(lanes), 64):
            tables = np.zeros((WIDTH + 1, TABLE + 1), np.uint64)
            some = lanes[begin:begin + 64]
            for bit, (_, before, sets) in enumerate(some):
                for table, fits in zip(tables, [before, *sets]):
                    table[fits] |= np.uint64(1 << bit)
            owned: dict[int, int] = {}
            for bit, (i, *_) in enumerate(some):
                owned[i] = owned.get(i, 0) | 1 << bit
            self.words.append((tables, {i: np.uint64(mask) for i, mask in owned.items()}))

    @staticmethod
    def _lanes(pattern: str) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """For each way to begin: what may stand before a match, and at its first places."""
        word, every = _fitting(r"\w", False), np.ones(TABLE + 1, bool)
        beyond = np.arange(TABLE + 1) == TABLE
        seen = set()
        for items, ignore_case in _ways(_parser.parse(pattern, re.IGNORECASE), True):
            before, edge = every, False
            for op, given in items:
                if op is c.AT and given is c.AT_BOUNDARY:
                    edge = True
                elif op is c.ASSERT_NOT and given[0] < 0 and len(given[1]) == 1 and _one(*given[1][0]):
                    before = before & (~_fitting(_one(*given[1][0]), ignore_case) | beyond)
                elif op not in (c.AT, c.ASSERT, c.ASSERT_NOT):
                    break
            sets = _sets(_front(items, ignore_case))
            sides = [(before & (~word | beyond), sets[0] & word), (before & word, sets[0] & (~word | beyond))] if edge else [(before, sets[0])]
            for side, first in sides:
                key = (side.tobytes(), first.tobytes(), *(s.tobytes() for s in sets[1:]))
                if first.any() and key not in seen:
                    seen.add(key)
                    yield side, [first, *sets[1:]]

    @staticmethod
    def _run(pattern: str) -> tuple[np.ndarray, np.ndarray] | None:
        """For a pattern that begins with a run of one class and a character out of the class: both."""
        items = [(op, given) for op, given in _parser.parse(pattern, re.IGNORECASE) if op is not c.AT]
        if len(items) < 2 or items[0][0] is not c.MAX_REPEAT or len(items[0][1][2]) != 1:
            return None
        inside, after = _one(*items[0][1][2][0]), _one(*items[1])
        if not items[0][1][0] or inside is None or after is None:
            return None
        inside, after = _fitting(inside, True), _fitting(after, True)
        return None if (inside & after)[:TABLE].any() or inside[ord(SEPARATOR)] else (inside, after)

    def _places(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """Where each rule may begin.  ``codes`` have a separator before them and WIDTH after."""
        n = len(codes) - WIDTH - 1
        found: dict[int, list[np.ndarray]] = {}
        for tables, owned in self.words:
            masks = tables[0].take(codes[:n])
            for k in range(EVERYWHERE):
                masks &= tables[k + 1].take(codes[k + 1:k + 1 + n])
            at = np.flatnonzero(masks)
            masks = masks[at]
            for k in range(EVERYWHERE, WIDTH):
                masks &= tables[k + 1].take(codes[at + (k + 1)])
                left = masks != 0
                at, masks = at[left], masks[left]
            for i, mask in owned.items():
                places = at[(masks & mask) != 0]
                if len(places):
                    found.setdefault(i, []).append(places)
        out = {}
        for i, several in found.items():
            places = several[0] if len(several) == 1 else np.unique(np.concatenate(several))
            if self.runs[i]:
                inside, after = self.runs[i]
                outside = np.flatnonzero(~inside.take(codes[1:]) | (codes[1:] == TABLE))
                places = places[after.take(codes[1:].take(outside[np.searchsorted(outside, places)]))]
            out[i] = places
        return out

    def finds(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray, str]:
        """Which texts are left to others; the finds (start, end, rule) in the joined text; where texts begin in it; it."""
        joined = SEPARATOR.join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        codes = np.full(len(joined) + WIDTH + 1, ord(SEPARATOR), np.int64)
        np.minimum(np.frombuffer(joined.encode("utf-32-le"), np.uint32), TABLE, out=codes[1:len(joined) + 1], casting="unsafe")
        left_out = np.zeros(len(texts), bool)
        for fits in self.wild:
            # A separator ends a run also where its kind is in the class.
            stops = ~fits.take(codes[1:len(joined) + 1])
            stops[begins[1:-1] - 1] = True
            ends = np.concatenate([[-1], np.flatnonzero(stops), [len(joined)]])
            long = ends[:-1][np.diff(ends) > RUN]
            left_out[np.searchsorted(begins, long + 1, "right") - 1] = True
        out = []
        for i, places in sorted(self._places(codes).items()):
            owner = np.searchsorted(begins, places, "right") - 1
            kept = ~left_out[owner] if left_out.any() else slice(None)
            match, group, last = self.tries[i].match, self.groups[i], 0
            check = CHECKS.get(self.rules[i][1])
            for at, stop in zip(places[kept].tolist(), (begins[owner + 1] - 1)[kept].tolist()):
                if at >= last:
                    m = match(joined, at, stop)
                    if m:
                        last = m.end()
                        if check is None or check(m[group]):
                            out.append((*m.span(group), i))
        return left_out, out, begins, joined


def _digits(value: str) -> str:
    return "".join(x for x in value if x in "0123456789")


def _luhn(digits: str) -> bool:
    turned = digits[::-1]
    return (sum(map(int, turned[::2])) + sum(int("0246813579"[int(x)]) for x in turned[1::2])) % 10 == 0


def _card(value: str) -> bool:
    digits = _digits(value)
    return len(digits) >= 13 and _luhn(digits)


def _piva(value: str) -> bool:
    digits = _digits(value)
    return len(digits) == 11 and _luhn(digits)


def _iban(value: str) -> bool:
    clean = "".join(value.split()).upper()
    return bool(re.fullmatch("[A-Z0-9]{5,}", clean)) and int("".join(str(int(x, 36)) for x in clean[4:] + clean[:4])) % 97 == 1


def _fiscal_code(value: str) -> bool:
    code = value.upper()
    if len(code) != 16:
        return False
    total = 0
    for i, x in enumerate(code[:15]):
        place = ord(x) - 48 if "0" <= x <= "9" else ord(x) - 55 if "A" <= x <= "Z" else None
        if place is not None:
            total += (place - 10 if place >= 10 else place) if i % 2 else (fv.FISCAL_ODD_DIGITS + fv.FISCAL_ODD_LETTERS)[place]
    return chr(total % 26 + 65) == code[15]


CHECKS = {"CARD": _card, "IBAN": _iban, "CF": _fiscal_code, "PIVA": _piva}

_sweeper = functools.cache(_Sweeper)


def _decoded(raw: bytes | None) -> str | None:
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        if size > SLICE:
            yield begin, i
            begin, size = i, 0
        size += len(text or "")
    yield begin, len(texts)


def spans(texts: pa.Array, rules: tuple[tuple[int, str, float, str], ...]) -> pa.Array:
    """The spans of each text (binary, UTF-8), as they leave detection; null where the text is null, cannot be read or is
    left to others."""
    sweeper = _sweeper(rules)
    decoded = [_decoded(raw) for raw in texts.to_pylist()]
    absent, counts = np.zeros(len(decoded), bool), np.zeros(len(decoded), np.int64)
    starts, ends, ranks, values = [], [], [], []
    for begin, end in _slices(decoded):
        some = decoded[begin:end]
        left_out, finds, begins, joined = sweeper.finds([t or "" for t in some])
        absent[begin:end] = left_out | np.array([t is None for t in some], bool)
        if finds:
            start, stop, rule = np.array(finds, np.int64).T
            owner = np.searchsorted(begins, start, "right") - 1
            order = np.lexsort((start, rule, owner))
            start, stop, rule, owner = start[order], stop[order], rule[order], owner[order]
            counts[begin:end] = np.bincount(owner, minlength=end - begin)
            values += [joined[a:b] for a, b in zip(start.tolist(), stop.tolist())]
            starts.append(start - begins[owner])
            ends.append(stop - begins[owner])
            ranks.append(rule)
    whole = lambda parts: np.concatenate(parts or [np.zeros(0, np.int64)])
    rank = pa.array(whole(ranks))
    fields = {
        "start": pa.array(whole(starts).astype(np.int32)), "end": pa.array(whole(ends).astype(np.int32)),
        "value": pa.array(values, pa.string()),
        "type": pa.array([r[1] for r in rules], pa.string()).take(rank),
        "confidence": pa.array([r[2] for r in rules], pa.float64()).take(rank),
        "source": pa.array(["rule"] * len(rank), pa.string()),
        "ord": pa.array([r[0] for r in rules], pa.int32()).take(rank),
    }
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    rows = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets), rows, mask=pa.array(absent))
