"""Large manuscripts and bibliographies read in splits: several tasks a file, rows as if it had been read whole.

Spark's text source cuts a file into byte ranges that begin and end with lines, on any file system that it reads. Lines
get their numbers from the line counts of the splits before.

A bibliography is a sequence of blocks, each of which ends where its braces close, as its quotes and
escapes have it; so whether a split begins within a block, and how deep, depends on all before it. Each split is
scanned once without knowing that: what blocks it has if it begins outside of any; and, for each state of quotes, where
it goes down by 1, 2, ... braces, and how deep and quoted it ends. With these few numbers of each split
(``_Split``) the driver tells in one walk where the outside begins in each. Only if a block that the scan took for
one turns out to hold that place, which stray marks can bring about, is a split scanned again from there. A block that
spans splits is put together from its pieces.

Defined results: a file reads as if it ended with a line end; an empty file has no lines and no entries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _fields, months, with_fields

#: Splits of which one row each may be broadcast; bytes of @string blocks that may.
MOST_SPLITS, MACRO_BYTES = 200_000, 8 << 20
_MARK, _BEGIN = re.compile(r'\\.|["{}]', re.S), re.compile(r"@\s*(\w+)\s*\{")


def split_lines(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """(file_path, split, line), lines of a split in order within one partition; ``split`` is where it begins in its file."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return text.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str | list[str], glob: str = "*.tex") -> DataFrame:
    """(file_path, line_number, line) of all lines, from 1, without a shuffle of the lines."""

    def number(batches):
        at, n = None, 0
        for b in batches:
            numbers = []
            for here in zip(b.column("file_path").to_pylist(), b.column("split").to_pylist(), strict=True):
                n = n + 1 if here == at else 1
                at = here
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], names=[*b.schema.names, "n"])

    lines = split_lines(spark, path, glob).mapInArrow(number, "file_path string, split long, line string, n long")
    before = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.groupBy("file_path", "split").agg(F.max("n").alias("count"))
    starts = ends.select("file_path", "split", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    few = ends.limit(MOST_SPLITS + 1).count() <= MOST_SPLITS
    out = lines.join(F.broadcast(starts) if few else starts, ["file_path", "split"])
    return out.select("file_path", (F.col("before") + F.col("n")).cast("int").alias("line_number"), "line")


# Bibliographies -------------------------------------------------------------------------------------


def _close(text: str, at: int, depth: int, quoted: bool) -> tuple[int | None, int, bool]:
    """Where ``depth`` open braces are closed (None: not here), and the depth and quotes at the end."""
    for m in _MARK.finditer(text, at):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return m.end(), 0, quoted
    return None, depth, quoted


def _blocks(text: str, at: int) -> Iterator[tuple[int, int | None, int, bool]]:
    """(start, end, depth, quoted) of the blocks from ``at`` on; the last may have no end, but the state it is left in."""
    while (m := _BEGIN.search(text, at)) is not None:
        end, depth, quoted = _close(text, m.end(), 1, False)
        yield m.start(), end, depth, quoted
        if end is None:
            return
        at = end


def _falls(text: str, quoted: bool) -> tuple[list[int], int, bool]:
    """Places after which a split is 1, 2, ... braces below where it began; its change of depth, and its quotes at the end."""
    falls, depth = [], 0
    for m in _MARK.finditer(text):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if -depth > len(falls):
                falls.append(m.end())
    return falls, depth, quoted


def _texts(batches) -> Iterator[tuple[str, int, str]]:
    """(file, split, text) of each split; memory holds one split."""
    at, lines = None, []
    for b in batches:
        for path, split, line in zip(b.column("file_path").to_pylist(), b.column("split").to_pylist(), b.column("line").to_pylist(), strict=True):
            if (path, split) != at:
                if at is not None:
                    yield *at, "".join(lines)
                at, lines = (path, split), []
            lines.append(line + "\n")
    if at is not None:
        yield *at, "".join(lines)


_SPLIT = "file_path string, split long, falls0 array<int>, net0 int, quoted0 boolean, falls1 array<int>, net1 int, quoted1 boolean, near array<struct<start: int, end: int>>, open boolean, depth int, quoted boolean"


def _scan(begins: dict | None = None):
    """A row of numbers for each split. ``begins``: only these splits, scanned for blocks from a place on."""

    def run(batches):
        for path, split, text in _texts(batches):
            if begins is not None and (path, split) not in begins:
                continue
            at = begins[path, split] if begins else 0
            plain, quoted = _falls(text, False), _falls(text, True)
            reach = max([*plain[0], *quoted[0]], default=-1)
            near, last = [], None
            for last in _blocks(text, at):
                if last[0] < reach:
                    near.append({"start": last[0], "end": len(text) if last[1] is None else last[1]})
            is_open = last is not None and last[1] is None
            row = (path, split, *plain, *quoted, near, is_open, last[2] if is_open else 0, last[3] if is_open else False)
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, row, strict=True))], schema=_SCHEMA)

    return run


_NAMES = [x.split(" ")[0] for x in re.split(r", (?=\w+ )(?![^<]*>)", _SPLIT)]
_SCHEMA = pa.schema([
    ("file_path", pa.string()), ("split", pa.int64()), ("falls0", pa.list_(pa.int32())), ("net0", pa.int32()), ("quoted0", pa.bool_()),
    ("falls1", pa.list_(pa.int32())), ("net1", pa.int32()), ("quoted1", pa.bool_()), ("near", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ("open", pa.bool_()), ("depth", pa.int32()), ("quoted", pa.bool_()),
])


def _walk(rows: list, again: dict) -> tuple[dict, dict]:
    """Where the outside begins in each split (None: nowhere), and the splits that must be scanned from there."""
    begins, unsure = {}, {}
    path, state = None, None  # state: (depth, quoted) within a block
    for r in rows:
        here = (r["file_path"], r["split"])
        if r["file_path"] != path:
            path, state = r["file_path"], None
        at = 0
        if state is not None:
            q = int(state[1])
            if len(r[f"falls{q}"]) < state[0]:
                begins[here] = None
                state = (state[0] + r[f"net{q}"], r[f"quoted{q}"])
                continue
            at = r[f"falls{q}"][state[0] - 1]
        begins[here] = at
        if here in again and again[here]["at"] == at:
            r = again[here]["row"]
        elif any(b["start"] < at < b["end"] for b in r["near"]):
            unsure[here] = at
            return begins, unsure  # what follows in this file depends on it
        state = (r["depth"], r["quoted"]) if r["open"] else None
    return begins, unsure


def _begins(lines: DataFrame) -> dict:
    """Where the outside begins in each split, by (file, split)."""
    rows = [r.asDict(recursive=True) for r in lines.mapInArrow(_scan(), _SPLIT).orderBy("file_path", "split").collect()]  # one small row a split
    again: dict = {}
    while True:
        begins, unsure = _walk(rows, again)
        if not unsure:
            return begins
        for r in lines.mapInArrow(_scan(unsure), _SPLIT).collect():
            here = (r["file_path"], r["split"])
            again[here] = {"at": unsure[here], "row": r.asDict(recursive=True)}


def blocks_of_files(spark: SparkSession, path: str | list[str], glob: str = "*.bib") -> DataFrame:
    """(file_path, split, at, text) of every @ block of all files; ``split`` and ``at`` order those of a file."""
    lines = split_lines(spark, path, glob)
    begins = spark.sparkContext.broadcast(_begins(lines))

    def cut(batches):
        known = begins.value
        ordered = sorted(known)
        place = {k: i for i, k in enumerate(ordered)}
        for path, split, text in _texts(batches):
            at, out = known[path, split], []
            head = len(text) if at is None else at
            if head:  # belongs to the block that the last split with an outside leaves open
                i = place[path, split] - 1
                while known[ordered[i]] is None:
                    i -= 1
                out.append((path, ordered[i][1], None, split, text[:head]))
            for start, end, _, _ in _blocks(text, head) if at is not None else ():
                out.append((path, split, start, None if end is not None else split, text[start:end]))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["file_path", "split", "at", "piece", "text"])

    found = lines.mapInArrow(cut, "file_path string, split long, at long, piece long, text string")
    whole = found.filter("piece IS NULL").select("file_path", "split", "at", "text")
    # The last block that begins in a split, in pieces: few, as each is at a border of splits.
    pieces = found.filter("piece IS NOT NULL").groupBy("file_path", "split").agg(F.max("at").alias("at"), F.sort_array(F.collect_list(F.struct("piece", "text"))).alias("p"))
    return whole.unionByName(pieces.select("file_path", "split", "at", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))


def split_bib_entries(spark: SparkSession, path: str | list[str], glob: str = "*.bib") -> DataFrame:
    """What ``bib_entries`` gives for whole files, with large ones read by several tasks. ``entry_ord`` numbers entries from 0."""
    found = blocks_of_files(spark, path, glob)
    kind = F.lower(F.regexp_extract("text", r"(?U)^@\s*(\w+)", 1))
    macros = found.filter(kind == "string").select("file_path", "split", "at", "text")
    size = macros.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MACRO_BYTES:
        raise ValueError(f"{size} bytes of @string blocks are more than {MACRO_BYTES}")
    texts: dict[str, list] = {}
    for r in macros.orderBy("file_path", "split", "at").collect():  # bounded above
        texts.setdefault(r["file_path"], []).append(((r["split"], r["at"]), r["text"]))
    shared = spark.sparkContext.broadcast(texts)

    def inner(text: str) -> str:
        return text[text.index("{") + 1 : -1]

    def parse(batches):
        known = shared.value
        tables: dict = {}  # (file, macros before) to their values
        for b in batches:
            out = []
            for path, split, at, text in zip(*(b.column(n).to_pylist() for n in ("file_path", "split", "at", "text")), strict=True):
                body = inner(text)
                key, comma, rest = body.partition(",") if "," in text[text.index("{") :] else (None, "", "")
                if key is None or not key.strip():
                    continue
                before = sum(place < (split, at) for place, _ in known.get(path, ()))
                if (path, before) not in tables:
                    strings = months()
                    for _, macro in known.get(path, ())[:before]:
                        strings.update(_fields(inner(macro), strings))
                    tables[path, before] = strings
                out.append((path, split, at, key.strip(), re.match(r"@\s*(\w+)", text)[1].lower(), list(_fields(rest, tables[path, before]).items())))
            if out:
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["file_path", "split", "at", "key", "entry_type", "raw_entry"])

    entries = found.filter(~kind.isin("string", "comment", "preamble"))
    rows = entries.mapInArrow(parse, "file_path string, split long, at long, key string, entry_type string, raw_entry map<string,string>")
    counts = rows.groupBy("file_path", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file_path", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("file_path", "split").orderBy("at"))
    numbered = rows.withColumn("_n", place - 1).join(starts, ["file_path", "split"]).withColumn("entry_ord", (F.col("before") + F.col("_n")).cast("int"))
    return with_fields(numbered)
