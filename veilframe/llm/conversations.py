"""Conversation structure repair: generalised LR parsing of role sequences with weighted edits.

Roles follow a grammar over their initials (s, u, a): nothing, or pairs of user and assistant after at most
one system row.  `Automaton` builds the LR(0) states of that grammar; a parser's stacks are nodes (state,
node below) of one shared graph, so equal stacks are one node.  Each row moves every stack top by the actions
delete, keep and rerole, and between rows an insert may shift a row that is missing; reductions follow at
once.  Tops that are equal after a row are merged by their least (cost, audit), the audit being the edits'
initials so far.  The grammar is left recursive: a state has one stack below it, so at most one top per
state is alive, whatever the length of a conversation.  Of two audits of equal cost at one top
neither is a beginning of the other (they would differ by inserts, which cost), hence the ASCII-least whole audit
has ASCII-least beginnings and merging loses nothing.

Scale: rows move once, by conversation, and each task reads its sorted conversations as a stream.  Where all
live tops agree on the edits so far, these are applied: the text goes into the running hash and the rows are
forgotten, so a conversation of any length needs memory for the rows since the last agreement (and its audit, one
byte per edit).  What must be remembered of all rows is which (role, text) came earlier; for conversations of
more than `long` rows that is found beforehand by grouping digests, which combines before the shuffle and splits
such a conversation over many tasks.  Its hash and its audit are chains, so the last step reads one conversation in
one task.

Cases: a null role or text counts as one space (such a text is blank) and so does a null in the crc32 key; rows
with null conv_id are one conversation; rows of equal turn are ordered by role and the text's SHA-256, repeated
rows are duplicates of the first; an empty or unknown role has to be rerolled or deleted; conversations that lose all
rows keep one result row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import only, stored, table

GRAMMAR = [("C", ""), ("C", "T"), ("T", "sua"), ("T", "ua"), ("T", "Tua")]
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
LONG = 4096
BLOCK = 256
SPACES = " \t\n\v\f\r"
SCHEMA = (
    "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Automaton:
    """LR(0) states of a grammar whose symbols are single characters, the first rule's head being the
    start; `shift` gives the stack after a terminal and all reductions that follow."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules, self.start = rules, rules[0][0]
        self.states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.nodes: list[tuple[int, int]] = []
        self._ids: dict[tuple[int, int], int] = {}
        self.root = self._node(self._state({(i, 0) for i, (head, _) in enumerate(rules) if head == self.start}), -1)
        self.shift = functools.cache(self._shift)
        self.accepts = functools.cache(self._accepts)

    def _state(self, kernel: set) -> int:
        items = set(kernel)
        while True:
            heads = {body[at] for i, at in items for body in [self.rules[i][1]] if at < len(body)}
            more = {(i, 0) for i, (head, _) in enumerate(self.rules) if head in heads} - items
            if not more:
                break
            items |= more
        key = frozenset(items)
        if key not in self.states:
            self.states[key] = len(self.items)
            self.items.append(key)
        return self.states[key]

    def _node(self, state: int, below: int) -> int:
        if (state, below) not in self._ids:
            self._ids[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self._ids[state, below]

    def _goto(self, node: int, symbol: str) -> int | None:
        kernel = {(i, at + 1) for i, at in self.items[self.nodes[node][0]] if self.rules[i][1][at : at + 1] == symbol}
        return self._node(self._state(kernel), node) if kernel else None

    def _done(self, node: int) -> list[tuple[str, str]]:
        return [self.rules[i] for i, at in self.items[self.nodes[node][0]] if at == len(self.rules[i][1])]

    def _shift(self, node: int, terminal: str) -> tuple[int, ...]:
        """The stacks after a terminal: all that reductions give, without those that can only reduce."""
        first = self._goto(node, terminal)
        found, todo = [], [first] if first is not None else []
        while todo:
            top = todo.pop()
            if top in found:
                continue
            found.append(top)
            for head, body in self._done(top):
                if body and head != self.start:
                    base = top
                    for _ in body:
                        base = self.nodes[base][1]
                    todo.append(self._goto(base, head))
        live = [n for n in found if any(at < len(self.rules[i][1]) for i, at in self.items[self.nodes[n][0]])]
        return tuple(live)

    def _accepts(self, node: int) -> bool:
        state, below = self.nodes[node]
        whole = any(head == self.start and len(body) == (0 if below < 0 else 1) for head, body in self._done(node))
        return whole and (below < 0 or below == self.root)


AUTOMATON = Automaton(GRAMMAR)
WRITABLE = sorted(ROLES)


def _merge(tops: dict, node: int, cost: int, audit: str) -> bool:
    if node not in tops or (cost, audit) < tops[node]:
        tops[node] = (cost, audit)
        return True
    return False


def _with_inserts(tops: dict) -> dict:
    todo = list(tops)
    while todo:
        node = todo.pop()
        cost, audit = tops[node]
        for role in WRITABLE:
            for after in AUTOMATON.shift(node, role):
                if _merge(tops, after, cost + INSERT, audit + "I"):
                    todo.append(after)
    return tops


def _step(tops: dict, initial: str, fault: str) -> dict:
    """The tops after one row; fault is '' or the row's first fault."""
    after: dict = {}
    short = CUT_SHORT if fault == "t" else 0
    for node, (cost, audit) in tops.items():
        _merge(after, node, cost + DELETE, audit + "D")
        if fault in ("b", "d"):
            continue
        for to in AUTOMATON.shift(node, initial):
            _merge(after, to, cost + short, audit + "K")
        for role in WRITABLE:
            for to in AUTOMATON.shift(node, role):
                _merge(after, to, cost + REROLE + short, audit + "R")
    return _with_inserts(after)


def _best(tops: dict) -> tuple[int, str]:
    return min(weight for node, weight in tops.items() if AUTOMATON.accepts(node))


@functools.lru_cache(1 << 16)
def cheapest(shape: tuple[tuple[str, str], ...]) -> tuple[int, str]:
    """(cost, audit) of a whole short conversation, given as its rows' (initial, fault)."""
    tops = _with_inserts({AUTOMATON.root: (0, "")})
    for initial, fault in shape:
        tops = _step(tops, initial, fault)
    return _best(tops)


class Repair:
    """One conversation, row by row in its order."""

    def __init__(self):
        self.seen: set[bytes] = set()
        self.rows: list[tuple[str, str]] = []
        self.shape: list[tuple[str, str]] = []
        self.tops: dict | None = None
        self.audit: list[str] = []
        self.stack, self.written, self.hash = AUTOMATON.root, False, hashlib.sha256()
        self.low = self.high = self.before = self.place = None
        self.turns = 0
        self.n = dict.fromkeys(COUNTS, 0)

    def add(self, turn: int | None, role: str, text: str, known: bool | None) -> None:
        """known: whether (role, text) came at an earlier place, None if that is to be remembered here."""
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if known is None:
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            known = digest in self.seen
            self.seen.add(digest)
        known = known or self.place == (turn, role, text)
        self.place = (turn, role, text)
        last = text.rstrip(SPACES)[-1:]
        fault = "b" if not last else "d" if known else "" if last in ".!?" else "t"
        initial = role[:1]
        if fault:
            self.n[{"b": "blank", "d": "duplicate", "t": "truncated"}[fault]] += 1
        if self.before is not None:
            self.n["illegal"] += self.before + initial not in LEGAL
        self.before = initial
        self.rows.append((role, text))
        self.shape.append((initial, fault))
        if len(self.rows) >= BLOCK:
            self._advance()

    def _advance(self) -> None:
        """Parse the rows that wait and apply the edits on which all tops agree."""
        tops = self.tops or _with_inserts({AUTOMATON.root: (0, "")})
        for initial, fault in self.shape:
            tops = _step(tops, initial, fault)
        self.shape = []
        agreed = os.path.commonprefix([audit for _, audit in tops.values()])
        self._apply(agreed)
        self.tops = {node: (cost, audit[len(agreed):]) for node, (cost, audit) in tops.items()}

    def _apply(self, audit: str) -> None:
        self.audit.append(audit)
        at = 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else self.rows[at]
            at += edit != "I"
            if edit == "D":
                continue
            choices = WRITABLE if edit in "IR" else [role[:1]]
            letter = next(c for c in choices if AUTOMATON.shift(self.stack, c))
            self.stack = AUTOMATON.shift(self.stack, letter)[0]
            line = f"{ROLES[letter] if edit in 'IR' else role}:{text}"
            self.hash.update(("\n" + line if self.written else line).encode())
            self.written = True
        del self.rows[:at]

    def result(self) -> dict:
        if self.tops is None:
            self.n["cost"], rest = cheapest(tuple(self.shape))
        else:
            self._advance()
            self.n["cost"], rest = _best(self.tops)
        self._apply(rest)
        self.n["gaps"] = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.n | {"audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose rows come in order, one after another."""
    now, repair, kind = None, None, None
    out: list[dict] = []

    def batch(rows: list[dict]) -> pa.RecordBatch:
        names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
        kinds = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    for b in batches:
        kind = b.schema.field("conv_id").type
        columns = [b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "copies", "known")]
        for conv, turn, role, text, copies, known in zip(*columns, strict=True):
            if repair is None or conv != now:
                if repair is not None:
                    out.append({"conv_id": now} | repair.result())
                now, repair = conv, Repair()
            for _ in range(copies):
                repair.add(turn, role, text, known)
        if len(out) >= 1024:
            yield batch(out)
            out = []
    if repair is not None:
        out.append({"conv_id": now} | repair.result())
    if out:
        yield batch(out)


def _said(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies: 0 for a dropped row, 2 for a repeated one."""
    fate = F.pmod(F.crc32(F.concat_ws(":", _said(F.col("conv_id")), _said(F.col("turn"))).cast("binary")), F.lit(20))
    text = _said(F.col("text"))
    return only(rows, conv_id="conv_id", turn="turn", role="role", text="text").withColumn("fate", fate).select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(F.col("fate") == 4, "user").otherwise(_said(F.col("role"))).alias("role"),
        F.when(F.col("fate") <= 1, "").when(F.col("fate") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"),
    )


def repaired(rows: DataFrame, long: int = LONG) -> DataFrame:
    """Per conversation its faults and cheapest repair; rows are conv_id, turn, role, text, copies (how often the
    row stands there, 0 for a conversation that must appear without it)."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long)
    large = stored(sizes.select(F.col("conv_id").alias("_large")), "large")
    is_large = F.col("conv_id").eqNullSafe(F.col("_large"))
    marked = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    few = marked.join(large, is_large, "left_anti").withColumn("known", F.lit(None).cast("boolean"))
    many = marked.join(large, is_large, "left_semi")
    first = many.where("copies > 0").groupBy(
        F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")
    ).agg(F.min(place).alias("_first"))
    many = many.join(
        first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left"
    ).withColumn("known", F.coalesce(~F.col("_first").eqNullSafe(place), F.lit(False))).drop("_c", "_r", "_d", "_first")
    ready = few.unionByName(many).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    kind = dict(rows.dtypes)["conv_id"]
    return ready.select("conv_id", "turn", "role", "text", "copies", "known").mapInArrow(_repaired, SCHEMA.format(kind=kind))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(damaged(table(spark, folder, "conversations")))


def _add(weight: str, cost: str, edit: str) -> str:
    return f"printf('%08d', CAST(left({weight}, 8) AS INT) + {cost}) || substr({weight}, 9) || '{edit}'"


SQL = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k FROM conversations),
fated AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(k, lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, range(8)), lambda t, i:
  CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END))), 4294967295) % 20 AS fate FROM keyed),
alive AS (SELECT conv_id, turn, copy, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, (VALUES (1), (2)) c(copy) WHERE fate <> 0 AND (copy = 1 OR fate = 3)),
placed AS (SELECT *, left(role, 1) AS r, right(regexp_replace(text, '[ 	-]+$', ''), 1) AS last,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM alive),
judged AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM placed),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '00000000' AS e, CAST(NULL AS VARCHAR) AS s, '00000003I' AS u, '00000006II' AS a FROM stats
  UNION ALL
  SELECT conv_id, i, e, s, least(u, {_add("e", "3", "I")}, {_add("s", "3", "I")}, {_add("a", "3", "I")}),
    least(a, {_add("least(u, " + _add("e", "3", "I") + ", " + _add("s", "3", "I") + ")", "3", "I")}) FROM (
    SELECT j.conv_id, j.i, {_add("e", "4", "D")} AS e,
      least({_add("s", "4", "D")}, CASE WHEN fault NOT IN ('b', 'd') AND r = 's' THEN {_add("e", "p", "K")} END) AS s,
      least({_add("u", "4", "D")}, CASE WHEN fault IN ('b', 'd') THEN NULL
        WHEN r = 'u' THEN least({_add("e", "p", "K")}, {_add("s", "p", "K")}, {_add("a", "p", "K")})
        ELSE least({_add("e", "p + 3", "R")}, {_add("s", "p + 3", "R")}, {_add("a", "p + 3", "R")}) END) AS u,
      least({_add("a", "4", "D")}, CASE WHEN fault IN ('b', 'd') THEN NULL
        WHEN r = 'a' THEN {_add("u", "p", "K")} ELSE {_add("u", "p + 3", "R")} END) AS a
    FROM walk w JOIN (SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS p FROM judged) j
      ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1)),
ended AS (SELECT w.conv_id, least(e, a) AS w FROM walk w JOIN stats t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i),
edits AS (SELECT conv_id, k, substr(w, 8 + k, 1) AS edit FROM (SELECT conv_id, w, unnest(range(1, length(w) - 7)) AS k FROM ended)),
lines AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i FROM edits),
kept AS (SELECT l.conv_id, l.k, l.edit, j.role, j.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY k) AS nth,
  first_value(CASE WHEN l.edit = 'K' AND j.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id ORDER BY k) AS sys_
  FROM lines l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i AND l.edit <> 'I' WHERE l.edit <> 'D'),
told AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - sys_) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
  chr(10) ORDER BY k) AS said FROM kept GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(w, 8) AS BIGINT), 0) AS cost,
  coalesce(substr(w, 9), '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
