"""Conversation repair against a recursion over whole audits, and in blocks of a few turns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from parley.llm import structure

BLANKS = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(BLANKS)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) with every edit tried from every turn and last initial; the rest of an audit depends on these two alone."""
    marks = faults(rows)

    @lru_cache(None)
    def rest(i, state, inserted):
        options = []
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text = rows[i]
            c, a, x = rest(i + 1, state, 0)
            options.append((c + 4, "D" + a, x))
            if marks[i] not in "bd":
                more = 3 if marks[i] == "t" else 0
                for cost, edit, new in ((0, "K", role), (3, "R", "user"), (3, "R", "assistant")):
                    if state + new[:1] in ("s", "u", "su", "ua", "au") and len(new):
                        c, a, x = rest(i + 1, new[:1], 0)
                        options.append((c + cost + more, edit + a, (f"{new}:{text}", *x)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if state + new[0] in ("u", "su", "ua", "au"):
                    c, a, x = rest(i, new[0], inserted + 1)
                    options.append((c + 3, "I" + a, (f"{new}:", *x)))
        return min(options) if options else (10**9, "", ())

    return rest(0, "", 0)


def report(rows):
    """Expected columns but the id; ``rows``: (turn, role, text) in order."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    own = tuple((r, t) for _, r, t in rows)
    marks, turns = faults(own), [n for n, *_ in rows if n is not None]
    cost, audit, lines = cheapest(own)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def told(df):
    return {r["conv_id"]: tuple(r[1:]) for r in df.collect()}


def drawn(seed, n, most):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(draw.randrange(1, most)):
            if draw.random() < 0.9:
                rows.append((conv, turn, draw.choice(["user", "user", "assistant", "assistant", "system", "tool"]), draw.choice(["Yes.", "No!", "cut", " ", "Why? ", f"turn {turn}.", f"turn {turn}"])))
    return rows


@pytest.mark.parametrize("bits", [10, 1])
def test_against_recursion(spark, monkeypatch, bits):
    monkeypatch.setattr(structure, "BLOCK_BITS", bits)
    rows = drawn(11, 150, 9)
    found = structure.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    by = defaultdict(list)
    for c, *r in rows:
        by[c].append(tuple(r))
    assert told(found.report()) == {c: report(r) for c, r in by.items()}
    left = defaultdict(list)
    for r in found.turns().orderBy("conv", "seq", "k").collect():
        left[r["conv"]].append((r["role"], r["text"], r["edit"]))
    for c, own in left.items():
        assert GRAMMAR.fullmatch("".join(r[0][0] for r in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in own).encode()).hexdigest() == report(by[c])[-1]


def test_a_conversation_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(structure, "BLOCK_BITS", 4)
    draw = random.Random(2)
    rows = [(1, i, draw.choice(["user", "assistant", "system", "tool"]), f"text {i % 1500}" + draw.choice([".", "", " \n"])) for i in range(2000)] + drawn(3, 20, 6)
    rows = [(c + 5 if i >= 2000 else c, *r) for i, (c, *r) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    found = structure.Repair(docs)
    assert found.segments.filter("conv = 1").count() > 100
    by = defaultdict(list)
    for c, *r in rows:
        by[c].append(tuple(r))
    small = told(found.report())
    assert {c: v for c, v in small.items() if c != 1} == {c: report(r) for c, r in by.items() if c != 1}
    monkeypatch.setattr(structure, "BLOCK_BITS", 12)
    assert told(structure.Repair(docs.coalesce(1)).report()) == small


def test_damage_and_edges(spark):
    schema = "conv_id long, turn long, role string, text string, plan string, code string"
    rows = [(None, 1, "user", "A."), (None, None, None, None), (None, 2, "assistant", "B"), (7, None, "user", "x"), (7, None, "user", "x"), (8, 0, "", "Role without a name."), (9, 1, "user", "long text. " * 100_000), (9, 1, "user", ""), (10, 4, "user", "B?"), (10, 2, "system", "A.")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = told(structure.Repair(docs).report())
    assert got[None] == report([(None, " ", " "), (1, "user", "A."), (2, "assistant", "B")])
    assert got[7] == report([(None, "user", "x"), (None, "user", "x")]) and got[7][1:3] == (0, 1)
    assert got[8][5:7] == (4, "D") and got[10] == report([(2, "system", "A."), (4, "user", "B?")]) and got[10][0] == 1
    assert structure.Repair(docs.limit(0)).report().count() == 0
    hurt = structure.damaged(docs)
    expected = []
    for c, n, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        expected += [(c, n, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    assert sorted(map(repr, map(tuple, hurt.collect()))) == sorted(map(repr, expected))
    everyone = spark.createDataFrame([(None,), (7,), (99,)], "conv_id long")
    assert told(structure.Repair(docs).report(everyone))[99] == report([])


def test_damage_draws_every_kind(spark):
    rows = [(c, n, "assistant", "Well. Yes!") for c in range(60) for n in range(5)]
    hurt = structure.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    kinds = {(r["role"], r["text"]) for r in hurt}
    assert kinds == {("assistant", "Well. Yes!"), ("assistant", ""), ("assistant", "Well Yes"), ("user", "Well. Yes!")} and len({tuple(r) for r in hurt}) < len(hurt)
