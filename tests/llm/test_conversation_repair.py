"""Conversation repair against a search over (row, grammar state) with whole audit strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from brute import LONG

from runforge.llm import conversation_repair as cr
from runforge.llm import queries
from runforge.llm.common import table

SF001 = "/root/testdata/sf0.001"
FIELDS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation's rows."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    seen, fault = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    goes = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def best(i, state, inserts):
        """Cheapest (cost, audit, lines) that end well; at most three inserts in a row."""
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def then(cost, edit, line, rest):
            if rest is not None:
                ways.append((cost + rest[0], edit + rest[1], line + rest[2]))

        new = {"u": "user", "a": "assistant"}
        if inserts < 3:
            for x in "ua":
                if (state, x) in goes:
                    then(2, "I", (new[x] + ":",), best(i, goes[state, x], inserts + 1))
        if i < len(rows):
            _, role, text = rows[i]
            then(3, "D", (), best(i + 1, state, 0))
            if fault[i] in ("", "truncated"):
                more = fault[i] == "truncated"
                if (state, role[:1]) in goes:
                    then(more, "K", (f"{role}:{text}",), best(i + 1, goes[state, role[:1]], 0))
                for x in "ua":
                    if (state, x) in goes:
                        then(2 + more, "R", (f"{new[x]}:{text}",), best(i + 1, goes[state, x], 0))
        return min(ways) if ways else None

    for i in range(len(rows), 0, -200):
        best(i, 0, 0)
    cost, audit, lines = best(0, 0, 0)
    return (gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(df, broken, rows, broken_rows):
    want = {c: plain([]) for c, *_ in rows}
    of = defaultdict(list)
    for r in broken_rows:
        of[r[0]].append(r)
    want.update({c: plain(x) for c, x in of.items()})
    got = cr.repair(df, broken).collect()
    assert len(got) == len(want)
    assert {r[0]: tuple(r)[1:] for r in got} == want


def made(n, seed):
    rng = random.Random(seed)
    texts = ["Good day.", "And you?", "cut off", " ", "", "Yes! \n", "é 漢 🙂.", "No", None]
    roles = ["user", "assistant", "system", "tool", "u", "student", "", None]
    rows = []
    for c in range(n):
        for k in range(rng.randrange(0, 12)):
            rows.append((c, rng.choice([k, k, k, k, None, 2 * k, 3]), rng.choice(roles[:2] if rng.random() < 0.7 else roles),
                         rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.randrange(40)}."))
    return rows + [(None, 0, "user", "Null id."), (None, 0, "assistant", "Null id."), (n, None, None, None), (n + 1, 5, "user", LONG)]


@pytest.mark.parametrize("bits", [12, 2, 0])
def test_odd_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(cr, "CHUNK_BITS", bits)
    rows = made(120, bits)
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "'x' as c", "1 as chunk", "2 as n", "3 as no", "'a' as audit", "4 as cost").repartition(5)
    check(df, df, rows, rows)
    check(df, cr.damage(df), rows, damaged(rows))


def test_query_on_the_small_table(spark):
    rows = [tuple(r) for r in table(spark, SF001, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, SF001).collect()}
    of = defaultdict(list)
    for r in damaged(rows):
        of[r[0]].append(r)
    assert got == {c: plain(of[c]) for c in {r[0] for r in rows}}


def test_one_long_conversation(spark, monkeypatch):
    """Of 3,000 rows in many chunks, a third of them one repeated row, and the repaired turns as a table."""
    monkeypatch.setattr(cr, "CHUNK_BITS", 6)
    rng = random.Random(5)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice([f"T{k}.", f"T{k}", "Same."])) for k in range(2000)]
    rows += [(1, 7, "user", "Same again.")] * 1000
    df = spark.createDataFrame(rows, FIELDS).repartition(4)
    import sys
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20000)
    try:
        check(df, df, rows, rows)
    finally:
        sys.setrecursionlimit(limit)
    placed = cr.placed(df, "conv_id", "turn", "role", "text")
    turns = sorted(map(tuple, cr.repaired_turns(placed, cr.decisions(placed)).select("chunk", "place", "role", "text").collect()))
    text = "\n".join(f"{r}:{x}" for _, _, r, x in turns)
    assert hashlib.sha256(text.encode()).hexdigest() == cr.repair(df, df).first()["repaired_sha256"]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, _, r, _ in turns))


def test_no_rows(spark):
    none = spark.createDataFrame([], FIELDS)
    assert cr.repair(none, none).count() == 0
    some = spark.createDataFrame([(1, 1, "user", "x")], FIELDS)
    assert tuple(cr.repair(some, none).first()) == (1, *plain([]))


def test_suffixes_are_solved_once():
    """Equal suffixes of neighbours share nodes; the minimised automaton stays small."""
    rng = random.Random(1)
    sigs = sorted({"".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(1, 30))) for _ in range(2000)}, key=lambda s: s[::-1])
    automaton, steps = cr.Suffixes(), 0
    step = automaton.step

    def counted(*a):
        nonlocal steps
        steps += 1
        return step(*a)

    automaton.step = counted
    for sig, nodes in zip(sigs, automaton.suffixes(automaton.end(), iter(sigs))):
        assert len(nodes) == len(sig) + 1
    assert steps == len({s[k:] for s in sigs for k in range(len(s))})
    assert len(automaton.known) < 500
