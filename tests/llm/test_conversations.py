"""Conversation repair against an enumeration of all edit lists, with damage worked out by zlib."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from veilframe.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, known string, digest string"
WHITE = " \t\n\v\f\r"


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)


def every_repair(faults, initials):
    """(cost, audit) over all lists of edits with at most two inserts in each gap."""
    n, best = len(faults), None
    for edits in itertools.product("DKua", repeat=n):
        if any(f in "bd" and e != "D" for f, e in zip(faults, edits) if f):
            continue
        for gaps in itertools.product(("", "I", "II"), repeat=n + 1):
            roles, audit, cost = "", "", 0
            for i in range(n + 1):
                for _ in gaps[i]:
                    roles += "u" if roles[-1:] in ("", "s", "a") else "a"
                    audit, cost = audit + "I", cost + 3
                if i < n:
                    e = edits[i]
                    roles += "" if e == "D" else initials[i] if e == "K" and initials[i] else "?" if e == "K" else e
                    audit += "R" if e in "ua" else e
                    cost += {"D": 4, "K": 0}.get(e, 3) + (3 if faults[i] == "t" and e != "D" else 0)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def expected(rows):
    out, damaged = {}, list(damage(rows))
    for conv in {r[0] for r in rows}:
        here = sorted((r for r in damaged if r[0] == conv),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in here:
            last = text.strip(WHITE)[-1:]
            faults.append("b" if not last else "d" if (role, text) in seen else "" if last in ".!?" else "t")
            seen.add((role, text))
        initials = [r[2][:1] for r in here]
        cost, audit = every_repair(faults, initials)
        lines, at = [], 0
        roles = ""
        for e in audit:
            if e == "I":
                roles += "u" if roles[-1:] in ("", "s", "a") else "a"
                lines.append({"u": "user:", "a": "assistant:"}[roles[-1]])
                continue
            role, text = here[at][2:]
            at += 1
            if e == "D":
                continue
            if e == "R":
                roles += "u" if roles[-1:] in ("", "s", "a") else "a"
                role = {"u": "user", "a": "assistant"}[roles[-1]]
            else:
                roles += role[0]
            lines.append(f"{role}:{text}")
        turns = [r[1] for r in here if r[1] is not None]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def odd_rows():
    pick = random.Random(7)
    roles = ["system", "user", "assistant", "tool", "", None, "used"]
    texts = ["Yes.", "No! \n", "cut", "", None, " \t", "é?", "Yes.", "x" * 5000 + "."]
    rows = []
    for conv in [*range(160), None]:
        for _ in range(pick.randint(1, 4)):
            rows.append((conv, pick.choice([None, 0, 1, 2, 3, 9]), pick.choice(roles), pick.choice(texts)))
    return rows


@pytest.mark.parametrize("long", [conversations.LONG, 2])
def test_repairs_equal_all_edit_lists(spark, long):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    got = conversations.repaired(conversations.damaged(frame), long).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r
    assert conversations.repaired(conversations.damaged(frame.limit(0)), long).count() == 0


def test_long_conversations_in_blocks(spark, monkeypatch):
    """A conversation of thousands of rows, parsed at once and in blocks, local and with digests found beforehand."""
    pick = random.Random(3)
    rows = [(1, t, pick.choice(["user", "assistant", "assistant", "system"]), pick.choice(["a.", "b", f"c{t}.", f"d{t}"])) for t in range(3000)]
    rows += [(2, None, "user", "same.")] * 2000
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    some = [sorted(map(tuple, conversations.repaired(conversations.damaged(frame), long).collect())) for long in (10_000, 100)]
    assert some[0] == some[1] and some[0][1][3] == len(list(damage(rows[3000:]))) - 1
    whole = conversations.Repair()
    monkeypatch.setattr(conversations, "BLOCK", 10_000)
    for _, turn, role, text in damage(rows[:3000]):
        whole.add(turn, role, text, None)
    result = whole.result()
    assert tuple(result[n] for n in conversations.COUNTS) == some[0][0][1:7] and result["audit"] == some[0][0][7]
    assert result["repaired_sha256"] == some[0][0][8]


def test_states_of_the_grammar():
    """One stack per state, pairs after at most one system row."""
    a = conversations.AUTOMATON
    for text in map("".join, itertools.chain.from_iterable(itertools.product("sua", repeat=n) for n in range(6))):
        tops = {a.root}
        for c in text:
            tops = {t for top in tops for t in a.shift(top, c)}
        assert any(map(a.accepts, tops)) == bool(re.fullmatch("(s?(ua)+)?", text)), text
    states = [state for state, _ in a.nodes]
    assert len(states) == len(set(states))
