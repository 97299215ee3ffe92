"""Repair of conversation structure at least cost (operator 12).

A repaired conversation has the role initials ``(s?(ua)+)?``, a pattern of four states. Its rows are kept
(0), given the other role (1), deleted (2; always if blank or a duplicate), or an empty row is inserted
(5); a truncated row that is not deleted adds 5. From each state one role only can be added, so a string
of edits fixes the repaired rows.

The weighted automaton of all edits is determinised as it is needed: read from the last row on, the
costs to go from the four states form a vector; less its least entry it is one state of the
deterministic automaton, found in a table of transitions by (state, symbol of the row), computed on a
miss. A scan of the table thus gives costs. Each transition holds, for every state of the pattern, the
ASCII-least edits along tight arcs (those whose cost is the difference of the costs to go), so a walk back
from the first row reads off the edits, the least of all cheapest ones.

Rows are shuffled once, by conversation, and sorted within partitions, last rows first for the scan and
first rows first for the walk; both stream, and hold one state. A conversation is the work of one task, as
its digest is one value of all its rows in order; sorts of long ones spill.

Defined results: a null role or text is one space, a null turn comes first, a null conversation id is a
conversation; rows of one turn are ordered by role, then text; of equal rows the first is the original;
very long texts are read whole; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, tune

DELETE, INSERT, RETITLE, TRUNCATED = 2, 5, 1, 5
#: The pattern's states: nothing yet, after s, after u, after a. The role each needs next, and the state after it.
NEEDS, THEN, DONE = ("user", "user", "assistant", "user"), (2, 2, 3, 2), (True, False, False, True)
SPACE = "\t\n\x0b\x0c\r "
INITIALS = "sua"
OK, CUT, GONE = 0, 1, 2
END_EDITS = ("", "II", "I", "")


def after(state: int, initial: str) -> int | None:
    """The pattern's state after a row with this role initial, if it allows one."""
    if initial == "s":
        return 1 if state == 0 else None
    return THEN[state] if initial and initial == NEEDS[state][0] else None


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in THEN:
        costs = [min(c, INSERT + costs[THEN[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


class Automaton:
    """Costs to go, determinised lazily. State 0 is the end of a conversation; symbol: 3 * initial + kind of row."""

    END = _with_inserts([0 if d else 10**6 for d in DONE])

    def __init__(self):
        self.vectors, self.number = [self.END], {self.END: 0}
        self.table: list[dict[int, tuple[int, int, str]]] = [{}]

    def step(self, state: int, symbol: int) -> tuple[int, int, str]:
        """(state before the row, cost taken out, edits by the pattern's state)."""
        hit = self.table[state].get(symbol)
        if hit is None:
            hit = self.table[state][symbol] = self._build(self.vectors[state], symbol)
        return hit

    def _build(self, rest: tuple[int, ...], symbol: int) -> tuple[int, int, str]:
        initial, kind = "sua "[symbol // 3], symbol % 3
        extra = TRUNCATED if kind == CUT else 0
        arcs: list[list[tuple[str, int, int]]] = []
        for q in range(4):
            own = [("D", DELETE + rest[q], q)]
            if kind != GONE:
                q2 = after(q, initial)
                own += [("K", extra + rest[q2], q2)] if q2 is not None else []
                own += [("R", RETITLE + extra + rest[THEN[q]], THEN[q])]
            arcs.append(own)
        costs = _with_inserts([min(c for _, c, _ in own) for own in arcs])
        edits = []
        for start in range(4):
            q, done = start, ""
            while not done or done[-1] == "I":
                tight = [a for a in arcs[q] if a[1] == costs[q]]
                if INSERT + costs[THEN[q]] == costs[q]:
                    tight.append(("I", costs[q], THEN[q]))
                letter, _, q = min(tight)
                done += letter
            edits.append(f"{done}{q}")
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append({})
        return self.number[vector], least, " ".join(edits)


def damaged(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of each row, damaged by a hash of its place; ``dropped`` rows keep their conversation's place."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = table.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.col("harm") == 0, F.when(F.col("harm") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("dropped"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``dropped``) with ``copy`` (the number among equal ones), ``fault`` and ``symbol``."""
    dealt = rows.repartition(partitions(rows.sparkSession), "conv_id")
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn"))
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(F.col("copy") > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    kind = F.when(F.col("fault").isNull(), OK).when(F.col("fault") == "truncated", CUT).otherwise(GONE)
    initial = F.instr(F.lit(INITIALS), F.nullif(F.left("role", F.lit(1)), F.lit("")))
    place = F.when(F.coalesce(initial, F.lit(0)) == 0, len(INITIALS)).otherwise(initial - 1)
    return dealt.withColumn("copy", F.row_number().over(same)).withColumn("fault", fault).withColumn("symbol", (place * 3 + kind).cast("int"))


def _order(down: bool) -> list[Column]:
    columns = ["conv_id", "turn", "role", "text", "copy"]
    return [F.desc_nulls_last(c) for c in columns] if down else [F.asc_nulls_first(c) for c in columns]


@cache
def _arcs(text: str) -> list[tuple[str, int]]:
    """(edits, state after them) of each state, as ``Automaton`` writes them."""
    return [(x[:-1], int(x[-1])) for x in text.split(" ")]


def edits(rows: DataFrame) -> DataFrame:
    """Every row and insertion in order, conversations one after another within partitions: conv_id, turn,
    ``first`` (of its conversation), dropped, fault, initial (before repair; null for insertions), edit (null
    for dropped rows), role and text (repaired), cost (of the whole conversation, at its first row)."""
    tune(rows.sparkSession)
    faulty = faults(rows)
    kind = faulty.schema["conv_id"].dataType.simpleString()
    turn = faulty.schema["turn"].dataType.simpleString()

    def scan(batches):
        automaton, state, total, conv, started = Automaton(), 0, 0, None, False
        for b in batches:
            costs, arcs = [], []
            for c, dropped, symbol in zip(*(b.column(n).to_pylist() for n in ("conv_id", "dropped", "symbol")), strict=True):
                if not started or c != conv:
                    state, total, conv, started = 0, 0, c, True
                arc = None
                if not dropped:
                    state, least, arc = automaton.step(state, symbol)
                    total += least
                costs.append(total + automaton.vectors[state][0])
                arcs.append(arc)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(costs, pa.int64()), pa.array(arcs, pa.string())], names=[*b.schema.names, "cost", "arcs"])

    scanned = faulty.sortWithinPartitions(*_order(down=True)).mapInArrow(scan, f"conv_id {kind}, turn {turn}, role string, text string, dropped boolean, copy int, fault string, symbol int, cost long, arcs string")

    names = ["conv_id", "turn", "first", "dropped", "fault", "initial", "edit", "role", "text", "cost"]

    def walk(batches):
        state, conv, started, types = 0, None, False, None
        out: list[tuple] = []

        def closing():
            q = state
            for _ in END_EDITS[state]:
                out.append((conv, None, False, False, None, None, "I", NEEDS[q], "", None))
                q = THEN[q]

        def batch():
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            types = [b.schema.field("conv_id").type, b.schema.field("turn").type, pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
            for c, turn_, role, text, dropped, fault, cost, arcs in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "dropped", "fault", "cost", "arcs")), strict=True):
                new = not started or c != conv
                if new:
                    if started:
                        closing()
                    state, conv, started = 0, c, True
                if dropped:
                    out.append((c, turn_, new, True, None, None, None, None, None, cost if new else None))
                    continue
                letters, end = _arcs(arcs)[state]
                q = state
                for letter in letters:
                    own = letter != "I"
                    here = {"D": None, "K": role}.get(letter, NEEDS[q])
                    out.append((c, turn_ if own else None, new, False, fault if own else None, role[:1] if own else None, letter, here, (text if own else "") if letter != "D" else None, cost if new else None))
                    new = False
                    q = THEN[q] if letter == "I" else q
                state = end
            if out:
                yield batch()
        if started:
            closing()
            if out:
                yield batch()

    schema = f"conv_id {kind}, turn {turn}, first boolean, dropped boolean, fault string, initial string, edit string, role string, text string, cost long"
    return scanned.sortWithinPartitions(*_order(down=False)).mapInArrow(walk, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I)."""
    kept = edits(rows).filter("edit IN ('K', 'R', 'I')")
    kind = kept.schema["conv_id"].dataType.simpleString()

    def number(batches):
        conv, place, started = None, 0, False
        for b in batches:
            places = []
            for c in b.column("conv_id").to_pylist():
                if not started or c != conv:
                    conv, place, started = c, 0, True
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(places, pa.int64()), *(b.column(n) for n in ("role", "text", "edit"))], names=["conv_id", "place", "role", "text", "edit"])

    return kept.mapInArrow(number, f"conv_id {kind}, place long, role string, text string, edit string")


def summaries(edited: DataFrame) -> DataFrame:
    """One row a conversation, read from the rows of ``edits``: gaps, faults, illegal pairs, cost, audit and digest."""
    kind = edited.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches):
        out, now, conv_type = [], None, None

        def close():
            turns, n = now["turns"], now["faults"]
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            out.append((now["conv"], gaps, n["blank"], n["duplicate"], n["truncated"], now["illegal"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest()))

        def batch():
            columns = list(zip(*out, strict=True))
            types = [conv_type, *[pa.int64()] * len(counts), pa.string(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", *counts, "audit", "repaired_sha256"])

        for b in batches:
            conv_type = b.schema.field("conv_id").type
            for conv, turn, first, dropped, fault, initial, edit, role, text, cost in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first:
                    if now:
                        close()
                        if len(out) >= 1000:
                            yield batch()
                    now = {"conv": conv, "turns": None, "faults": dict.fromkeys(("blank", "duplicate", "truncated"), 0), "illegal": 0, "cost": cost, "audit": [], "sha": hashlib.sha256(), "some": False, "last": None}
                if dropped:
                    continue
                now["audit"].append(edit)
                if edit != "I":
                    if turn is not None:
                        least, most, n = now["turns"] or (turn, turn, 0)
                        now["turns"] = (least, turn, n + (n == 0 or turn != most))
                    if fault:
                        now["faults"][fault] += 1
                    now["illegal"] += now["last"] is not None and now["last"] + initial not in ("su", "ua", "au")
                    now["last"] = initial
                if edit != "D":
                    now["sha"].update((("\n" if now["some"] else "") + f"{role}:{text}").encode())
                    now["some"] = True
        if now:
            close()
            yield batch()

    return edited.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string")


def op12_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged by the contract's rule and repaired."""
    return summaries(edits(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def _sql() -> str:
    """The same by a recursion over rows from the last, with the least (cost, edits, lines) from each state; crc32 by its table's rule."""
    arc = lambda cost, letter, to, line="[]::VARCHAR[]": f"{{'c': {cost} + {to}.c, 'a': '{letter}' || {to}.a, 'l': {line} || {to}.l}}"
    none = "{'c': 1000000, 'a': '', 'l': []::VARCHAR[]}"
    end = lambda c, a, lines: f"{{'c': {c}, 'a': '{a}', 'l': {lines}::VARCHAR[]}}"
    keep = {0: "CASE i WHEN 's' THEN 1 WHEN 'u' THEN 2 END", 1: "CASE i WHEN 'u' THEN 2 END", 2: "CASE i WHEN 'a' THEN 3 END", 3: "CASE i WHEN 'u' THEN 2 END"}
    own = []
    for q in range(4):
        kept = " ".join(f"WHEN 'v{t}' THEN {arc('x', 'K', f'v{t}', '[line]')}" for t in (1, 2, 3))
        moved = arc("1 + x", "R", f"v{THEN[q]}", f"['{NEEDS[q]}:' || text]")
        own.append(f"least({arc(2, 'D', f'v{q}')}, CASE WHEN gone THEN {none} ELSE least({moved}, coalesce(CASE 'v' || ({keep[q]}) {kept} END, {none})) END) AS w{q}")
    insert = lambda q, to: arc(5, "I", to, f"['{NEEDS[q]}:']")
    return f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, n)) AS t),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS b FROM conversations),
k AS (SELECT h.* EXCLUDE (b), xor(4294967295, list_reduce(b, lambda c, x: xor(t[xor(c % 256, x) + 1], c // 256), 4294967295)) % 20 AS k FROM h, tab),
d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS o FROM k),
f AS (SELECT *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS copy FROM d),
g AS (SELECT *, left(role, 1) AS i, CASE WHEN bare = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM f),
p AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY r) || i NOT IN ('su', 'ua', 'au') AS bad FROM g),
s AS (SELECT conv_id, (coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn))::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM p GROUP BY conv_id),
w AS (SELECT DISTINCT conv_id, n + 1 AS r, {end(0, '', '[]')} AS v0, {end(10, 'II', "['user:', 'assistant:']")} AS v1, {end(5, 'I', "['assistant:']")} AS v2, {end(0, '', '[]')} AS v3 FROM g
UNION ALL SELECT conv_id, r, least(w0, {insert(0, f"least(w2, {insert(2, 'w3')})")}), least(w1, {insert(1, f"least(w2, {insert(2, 'w3')})")}), least(w2, {insert(2, 'w3')}), least(w3, {insert(3, 'w2')})
FROM (SELECT conv_id, r, {', '.join(own)} FROM (SELECT w.conv_id, g.r, v0, v1, v2, v3, i, text, role || ':' || text AS line, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS x FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.r = w.r - 1)))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0)::BIGINT AS cost,
coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN (SELECT * FROM w WHERE r = 1) w ON w.conv_id IS NOT DISTINCT FROM c.conv_id"""


OP12_SQL = _sql()
