"""Citations and their use: extraction, context, and the joins with the bibliography."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import comment_lookbehind, normalize_whitespace, some, strip

BEFORE, AFTER, SENTENCES, BUDGET = 9, 10, 2, 1000


def extract(lines: DataFrame) -> DataFrame:
    """One row for each key of each citation: line-local, comments cut, keys trimmed, empty keys dropped."""
    text = comment_lookbehind(some("line"))
    pair = F.arrays_zip(F.regexp_extract_all(text, F.lit(P.CITE), 1).alias("command"), F.regexp_extract_all(text, F.lit(P.CITE), 2).alias("keys"))
    # The cheap test keeps most lines from the pattern.
    found = lines.filter(_cites(F.col("line"))).select("*", F.posexplode(pair).alias("match_ord", "m"))
    keyed = found.select(*lines.columns, "match_ord", F.col("m.command").alias("command"), F.posexplode(F.split("m.keys", ",")).alias("key_ord", "key"))
    return keyed.withColumn("key", strip(F.col("key"))).filter("key != ''").withColumnRenamed("line", "raw_line")


def clean_context(c: Column) -> Column:
    c = F.regexp_replace(c, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", "")
    return normalize_whitespace(F.regexp_replace(c, r"[{}]", ""))


def _sentences(c: Column) -> Column:
    """Sentences of a clean text, whose white space is single spaces."""
    return F.filter(F.split(c, r" (?<=[.!?] )"), lambda s: s != "")


def _with_contexts(rows: DataFrame) -> DataFrame:
    """Keeps two sentences of each of the clean windows ``_before`` and ``_after`` beside the line."""
    near = F.reverse(F.slice(F.reverse(_sentences(F.col("_before"))), 1, SENTENCES))
    out = rows.withColumn("context_before", F.array_join(near, " ")).withColumn("context_after", F.array_join(F.slice(_sentences(F.col("_after")), 1, SENTENCES), " "))
    full = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (F.col("context_before"), clean_context(some("line")), F.col("context_after"))])
    return out.withColumn("full_context", full).drop("_before", "_after")


def _windows(lines: DataFrame) -> DataFrame:
    order = Window.partitionBy("file_path").orderBy("line_number")
    join = lambda w: F.array_join(F.collect_list("line").over(w), " ")
    return lines.withColumn("_before", join(order.rowsBetween(-BEFORE, -1))).withColumn("_after", join(order.rowsBetween(1, AFTER)))


def _cleaned(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: clean_context(F.col(c)) for c in ("_before", "_after")})


def contexts(lines: DataFrame) -> DataFrame:
    """Two sentences from the nine lines before, the line itself, two from the ten after; comments stay in."""
    return _with_contexts(_cleaned(_windows(lines)))


def _cites(line: Column) -> Column:
    return F.contains(F.lower(line), F.lit("\\cite"))


def cited_contexts(lines: DataFrame) -> DataFrame:
    """The citations of ``extract`` with their contexts. Only lines that cite keep their windows and are cleaned, once for all their keys."""
    return extract(_with_contexts(_cleaned(_windows(lines).filter(_cites(F.col("line"))))))


def cited_in_texts(texts: DataFrame) -> DataFrame:
    """``cited_contexts`` of texts (file_path, lines: an array, null lines empty) that have a row each.

    A line is cleaned once instead of in each of the windows that hold it. That is the same, as white space ends a
    command, unless a command's bracket stays open at the end of a line: such texts' windows are cleaned whole. Each
    line that cites takes its own windows only, so work grows with the lines of a text. Texts are dealt by their
    names first, as a file's row groups may be few.
    """
    held = texts.repartition("file_path").select("file_path", F.transform("lines", some).alias("lines"))
    open_ = F.exists("lines", lambda x: x.rlike(r"\\[a-zA-Z]+\*?\[[^\]]*\z"))
    held = held.select("file_path", "lines", F.transform("lines", clean_context).alias("clean"), open_.alias("open"))

    def window(start: Column, n: Column) -> Column:
        whole = clean_context(F.array_join(F.slice("lines", start, n), " "))
        return F.when(F.col("open"), whole).otherwise(F.array_join(F.filter(F.slice("clean", start, n), lambda x: x != ""), " "))

    def place(i: Column) -> Column:
        first = F.greatest(i - BEFORE, F.lit(1))
        return F.struct(i.alias("line_number"), F.element_at("lines", i).alias("line"), window(first, i - first).alias("_before"), window(i + 1, F.lit(AFTER)).alias("_after"))

    numbers = F.when(F.size("lines") > 0, F.sequence(F.lit(1), F.size("lines")))
    citing = F.transform(F.filter(numbers, lambda i: _cites(F.element_at("lines", i))), place)
    return extract(_with_contexts(held.select("file_path", F.explode(citing).alias("at")).select("file_path", "at.*")))


def usage(entries: DataFrame, citations: DataFrame) -> DataFrame:
    """Entries with is_used, usage_count and first line; citations are summed, map side first, before the join."""
    per_key = citations.groupBy("key").agg(F.count("*").alias("usage_count"), F.min("line_number").alias("first_usage_line"))
    out = entries.join(per_key, "key", "left")
    return out.withColumn("usage_count", F.coalesce("usage_count", F.lit(0).cast("long"))).withColumn("is_used", F.col("usage_count") > 0)


def usage_lines(entries: DataFrame, citations: DataFrame) -> DataFrame:
    """(key, file_path, line_number, n) of every line that cites an entry, a row each: a key that many lines cite is many rows."""
    per_line = citations.groupBy("key", "file_path", "line_number").agg(F.count("*").alias("n"))
    return per_line.join(entries.select("key").distinct(), "key", "left_semi")


def by_key(entries: DataFrame, key) -> DataFrame:
    """The entry of a key; of several the first read."""
    order = [c for c in ("file_path", "entry_ord") if c in entries.columns]
    found = entries.filter(F.col("key") == F.lit(key))
    return (found.orderBy(*order) if order else found).limit(1)


def missing(entries: DataFrame, citations: DataFrame) -> DataFrame:
    return citations.select("key").distinct().join(entries.select("key"), "key", "left_anti")


def unused(entries: DataFrame, citations: DataFrame) -> DataFrame:
    return entries.join(citations.select("key"), "key", "left_anti")


def used(entries: DataFrame, citations: DataFrame) -> DataFrame:
    return entries.join(citations.select("key"), "key", "left_semi")


def _within_budget(rows: DataFrame, budget: int, order: tuple[str, ...]) -> DataFrame:
    """Of each key's rows in a partition those before which at most ``budget`` characters stand there: no other can count.

    What stands before a row in its partition stands before it in the whole, so a row beyond the budget here is
    beyond it there; and the row that overruns it is kept, which ends the list. Rows stream in order, without a shuffle.
    """
    n = rows.columns.index("full_context")

    def run(batches):
        last, spent = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.schema.get_field_index("key"))
            size = pc.fill_null(pc.utf8_length(b.column(n)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.ones(b.num_rows, bool)
            new[1:] = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, b.num_rows - 1)), True).to_numpy(zero_copy_only=False)
            if last is not None and keys[0].as_py() == last:
                new[0] = False
            before = np.cumsum(size) - size
            start = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), -1))
            before = np.where(start < 0, before + spent, before - before[np.maximum(start, 0)])
            yield b.filter(pa.array(before <= budget))
            last, spent = keys[b.num_rows - 1].as_py(), int(before[-1] + size[-1])

    return rows.sortWithinPartitions("key", *order).mapInArrow(run, rows.schema)


def combined_context(citations: DataFrame, budget: int = BUDGET, least: int = 100, order: tuple[str, ...] = ("file_path", "line_number")) -> DataFrame:
    """Contexts of a key in order while they fit the budget; the first that does not is cut if enough room is left.

    Each partition first drops what cannot fit, so a key moves about ``budget`` characters from each partition,
    however many contexts it has. A null context is empty.
    """
    columns = [F.col("key"), *[F.col(c) for c in order], some("full_context").alias("full_context")]
    kept = _within_budget(citations.select(*columns), budget, order)
    w = Window.partitionBy("key").orderBy(*order)
    n = F.length("full_context")
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = budget - before
    # A context that did not fit ends the list, so only rows whose predecessors all fit are kept.
    rows = kept.withColumn("_room", room).withColumn("_fits", n <= room)
    rows = rows.withColumn("_open", F.coalesce(F.min("_fits").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))).filter("_open AND (_fits OR _room > %d)" % least)
    piece = F.when(F.col("_fits"), F.col("full_context")).otherwise(F.concat(F.expr("left(full_context, _room)"), F.lit("...")))
    pieces = rows.withColumn("_at", F.row_number().over(w)).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_at", piece.alias("t")))).alias("p"))
    return pieces.select("key", F.array_join(F.transform("p", lambda x: x["t"]), "\n---\n").alias("combined"))


def is_preprint() -> Column:
    """An arXiv id, or a preprint word in the venue (of some entry types also in the type)."""
    venue = F.lower(F.concat_ws(" ", "journal", "booktitle", "publisher"))
    typed = F.lower("entry_type").isin("techreport", "unpublished", "misc")
    words = "|".join(w.replace(".", r"\.") for w in P.PREPRINT)
    return (some("arxiv_id") != "") | venue.rlike(words) | (typed & F.lower("entry_type").rlike(words))


def preprint_ratio(used_entries: DataFrame, threshold: float = 0.5) -> DataFrame:
    ratio = F.count_if("is_preprint") / F.nullif(F.count("*"), F.lit(0))
    return used_entries.agg(F.count("*").alias("n_used"), F.count_if("is_preprint").alias("n_preprints"), ratio.alias("ratio"), F.coalesce(ratio > threshold, F.lit(False)).alias("warn"))
