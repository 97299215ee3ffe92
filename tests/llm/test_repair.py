"""Operator 12 against a plain search over edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from paperloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, fault string, dropped int"
SOLID = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
FULL = {"s": "system", "u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, edits, lines) by trying all edits; rows: (role, text, fault)."""

    @cache
    def go(i, last, inserts):
        out = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        add = lambda cost, letter, line, rest: out.append((cost + rest[0], letter + rest[1], line + rest[2])) if rest else None
        for x in [x for x in NEXT[last] if x != "s"]:
            if inserts:
                add(5, "I", (f"{FULL[x]}:",), go(i, x, inserts - 1))
            if i < len(rows) and rows[i][2] in (None, "truncated"):
                add(1 + 5 * bool(rows[i][2]), "R", (f"{FULL[x]}:{rows[i][1]}",), go(i + 1, x, inserts))
        if i < len(rows):
            role, text, fault = rows[i]
            add(2, "D", (), go(i + 1, last, inserts))
            if fault in (None, "truncated") and role[:1] and role[:1] in NEXT[last]:
                add(5 * bool(fault), "K", (f"{role}:{text}",), go(i + 1, role[:1], inserts))
        return min(out, default=None)

    return go(0, "", 4)


def judged(rows):
    """(role, text, fault) of a conversation's rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        solid = SOLID.findall(text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain(conversations):
    want = {}
    for conv, rows in conversations.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        known = judged(rows)
        cost, audit, lines = cheapest(known)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(known))
        count = [sum(f == k for _, _, f in known) for k in ("blank", "duplicate", "truncated")]
        want[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return want


def harmed(rows):
    """The contract's damage, plainly."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        say = lambda x: " " if x is None else str(x)
        role, text, k = say(role), say(text), zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        own = out.setdefault(conv, [])
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    got = repair.summaries(repair.edits(repair.damaged(df))).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return df, {r["conv_id"]: tuple(r)[1:] for r in got}


def test_as_all_edits_tried(spark):
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "umpire", "s", "Assistant"]
    texts = ["Yes.", "No!", "Why?", "cut off", " \t\n", None, "", "Yes. \n", "é.", "x" * 5000 + "."]
    rows = [(c if c else None, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in range(150) for _ in range(rng.randrange(1, 8))]
    rows += rows[:40]  # repeated rows
    rows += [(1000 + c, t, ("system", "user", "assistant")[(t + 2) % 2 + 1 if t else 0], f"Turn {t} of {c}.") for c in range(200) for t in range(6)]
    df, got = made(spark, rows)
    want = plain(harmed(rows))
    assert any(w[6] == "" for w in want.values()) and {x for w in want.values() for x in w[6]} == set("DKR")  # a deletion is always cheaper than an insertion
    assert got == want
    lines = {}
    for r in sorted(repair.repaired(repair.damaged(df)).collect(), key=lambda r: r["place"]):
        assert r["place"] == len(lines.setdefault(r["conv_id"], []))
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in got} == {c: w[-1] for c, w in want.items()}


def test_long_conversations_and_none(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]
    df, got = made(spark, rows)
    n = sum(len(r) for r in harmed(rows).values())
    assert got[1][5] > 0 and len(got[1][6].replace("I", "")) == n
    a = repair.Automaton()
    for symbols in itertools.product(range(12), repeat=4):
        state = 0
        for s in symbols:
            state = a.step(state, s)[0]
    assert len(a.vectors) < 200  # the table stays small
    assert made(spark, [])[1] == {}


def test_edits_read_off_are_the_cheapest():
    kinds = [(r, "t.", f) for r in ("s", "u", "a", "x") for f in (None, "truncated", "blank")]
    for rows in itertools.chain(itertools.product(kinds, repeat=2), random.Random(1).choices(list(itertools.product(kinds, repeat=3)), k=400)):
        a, state, total, arcs = repair.Automaton(), 0, 0, []
        for role, _, fault in reversed(rows):
            symbol = "suax".index(role) * 3 + {None: repair.OK, "truncated": repair.CUT, "blank": repair.GONE}[fault]
            state, least, arc = a.step(state, symbol)
            total += least
            arcs.append(arc)
        q, audit = 0, ""
        for arc in reversed(arcs):
            part = arc.split(" ")[q]
            audit, q = audit + part[:-1], int(part[-1])
        assert (total + a.vectors[state][0], audit + repair.END_EDITS[q]) == cheapest(rows)[:2]
