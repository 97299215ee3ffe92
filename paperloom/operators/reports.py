"""Report aggregates, line grouping and Markdown output."""

from __future__ import annotations

import bisect
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import percent, rule_name, some
from ..sources import entry_ranges
from ..sources.writers import Report

LOW_SCORE = 2


def severity_counts(findings: DataFrame, with_passed: bool = True) -> DataFrame:
    rows = findings if with_passed else findings.filter(~F.col("passed"))
    return rows.groupBy("severity").agg(F.count("*").alias("n"))


def rule_counts(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("passed")).groupBy(rule_name(F.col("message")).alias("rule_name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_name")


def checker_counts(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("passed")).groupBy("checker_name").agg(F.count("*").alias("n"))


def bibliography_summary(entries: DataFrame) -> DataFrame:
    """Counts over entries with is_used, issues (array) and scores (array)."""
    troubled = (F.size("issues") > 0) | F.exists("scores", lambda s: s <= LOW_SCORE)
    return entries.agg(
        F.count("*").alias("total"), F.count_if(F.col("is_match") & ~troubled).alias("verified"), F.count_if(troubled).alias("with_issues"),
        F.count_if("is_used").alias("used"), F.count_if(~F.col("is_used")).alias("unused"),
    )


def issue_counts(entries: DataFrame, duplicates: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
    """Entries by kind of issue, each entry once a kind, unused ones (where is_used is known), and the numbers of
    duplicate groups and missing entries, if given. Kinds without any are left out."""
    kinds = {"Title Mismatch": "Title mismatch", "Author Mismatch": "Author mismatch", "Year Mismatch": "Year mismatch", "Unable to Verify": "Unable"}
    holds = lambda p: F.exists("issues", lambda i: F.startswith(i, F.lit(p)))
    hits = [F.when(holds(p), name) for name, p in kinds.items()]
    hits.append(F.when(F.exists("scores", lambda s: s <= LOW_SCORE), "Low Relevance"))
    if "is_used" in entries.columns:
        hits.append(F.when(~F.col("is_used"), "Unused Entry"))
    out = entries.select(F.explode(F.array_compact(F.array(*hits))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    for name, table in (("Duplicate Group", duplicates), ("Missing Entry", missing)):
        if table is not None:
            out = out.unionByName(table.agg(F.lit(name).alias("issue"), F.count("*").alias("n")).filter("n > 0"))
    return out


#: A block of more lines is shown by its first and last lines.
SHOWN_LINES, FIRST_LINES, LAST_LINES = 10, 5, 3


def shortened(lines: list[str]) -> str:
    if len(lines) <= SHOWN_LINES:
        return "\n".join(lines)
    return "\n".join([*lines[:FIRST_LINES], "  [...]", *lines[-LAST_LINES:]])


def block_ranges(text: str) -> list[tuple[int, int, str]]:
    """(start line, end line, environment) of all blocks by start; ties in the order of the list."""
    ends = [m.start() for m in re.finditer("\n", text)]
    at = lambda i: bisect.bisect_left(ends, i) + 1
    found = [(at(m.start()), at(m.end()), e) for e in P.BLOCK_ENVS if f"\\begin{{{e}}}" in text for m in re.finditer(rf"\\begin\{{{re.escape(e)}\}}.*?\\end\{{{re.escape(e)}\}}", text, re.S)]
    return sorted(found, key=lambda b: b[0])


def blocks(docs: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.column("file_path").to_pylist(), b.column("content").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                rows += [(path, i, *r, shortened(lines[r[0] - 1 : r[1]])) for i, r in enumerate(block_ranges(text or ""))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["file_path", "block_ord", "start_line", "end_line", "block_type", "block_text"])

    return docs.select("file_path", "content").mapInArrow(run, "file_path string, block_ord int, start_line int, end_line int, block_type string, block_text string")


def held_by_blocks(findings: DataFrame, blocks_: DataFrame) -> DataFrame:
    """``findings`` with ``b``, the earliest block of their file that holds their line (null if none does).

    A block that ends no later than one that begins before it is never the earliest, so only those count that
    reach further than all before. Their ends rise with their starts: a line's block is the first that ends there
    or later, if it has begun. Lines and ends of a file are one run from its last line up, with the
    block seen last as state, so work is linear in both.
    """
    text = F.col("block_text") if "block_text" in blocks_.columns else F.lit(None).cast("string").alias("block_text")
    block = F.struct("start_line", "end_line", "block_type", text)
    earlier = Window.partitionBy("file_path").orderBy("start_line", "block_ord").rowsBetween(Window.unboundedPreceding, -1)
    reach = blocks_.withColumn("_reach", F.coalesce(F.max("end_line").over(earlier), F.lit(0))).filter("end_line > _reach")
    ends = reach.select("file_path", F.col("end_line").alias("_at"), F.lit(1).alias("_kind"), block.alias("_block"))
    found = findings.select("file_path", F.col("line_number").alias("_at"), F.lit(0).alias("_kind"), F.struct(*findings.columns).alias("_f"))
    rows = found.unionByName(ends, allowMissingColumns=True)
    upward = Window.partitionBy("file_path").orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("b", F.last("_block", ignorenulls=True).over(upward)).filter("_kind = 0")
    return near.select("_f.*", F.when(F.col("b.start_line") <= F.col("_at"), F.col("b")).alias("b"))


def grouped_findings(findings: DataFrame, blocks_: DataFrame) -> DataFrame:
    """Findings with a line, under the earliest block that holds it or else their line."""
    rows = held_by_blocks(findings.filter(~F.col("passed") & F.col("line_number").isNotNull()), blocks_)
    rows = rows.withColumn("group_line", F.coalesce("b.start_line", "line_number"))
    item = F.struct("line_number", "severity", "message")
    return rows.groupBy("file_path", "group_line", F.col("b.block_type").alias("block_type"), F.col("b.end_line").alias("end_line")).agg(F.sort_array(F.collect_list(item)).alias("issues"), F.coalesce(F.first("b.block_text"), F.min("line_content")).alias("line_content"))


def clean_bib(text: str, used: set[str]) -> str:
    """A bibliography without the entries that are not used; directives and entries without a comma stay."""
    out, at = [], 0
    for start, end, kind, key in entry_ranges(text):
        if kind in ("string", "preamble", "comment") or key is None or key in used:
            continue
        out.append(text[at:start])
        at = end + len(re.match(r"[ \t]*\n?", text[end:])[0])
    return "".join(out) + text[at:]


def only_used(files: DataFrame, entries: DataFrame, citations: DataFrame) -> DataFrame:
    """(file_path, content) of bibliographies without the entries that nothing cites."""
    import pyarrow as pa

    kept = entries.join(citations.select("key").distinct(), "key", "left_semi").groupBy("file_path").agg(F.collect_set("key").alias("keys"))
    rows = files.select("file_path", "content").join(kept, "file_path", "left")

    def run(batches):
        for b in batches:
            texts = [clean_bib(t or "", set(k or ())) for t, k in zip(b.column("content").to_pylist(), b.column("keys").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file_path"), pa.array(texts, pa.string())], names=["file_path", "content"])

    return rows.mapInArrow(run, "file_path string, content string")


DISCLAIMER = "> **Note:** This report was made by a program. It may report what is right and miss what is wrong; check each point before you change anything."
HEADINGS = {"error": "Critical Errors", "warning": "Warnings", "info": "Suggestions"}


def _name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def quality_report(report: Report, findings: DataFrame, made: str, venue: dict | None = None) -> None:
    """The venue's limits, counts, then findings by severity with their places, contents and suggestions, in file and line order."""
    counts = {r["severity"]: r["n"] for r in severity_counts(findings, with_passed=False).collect()}  # three rows
    report.lines("# Quality Report", "", f"Generated: {made}", "", DISCLAIMER, "")
    if venue:
        report.lines(f"**Venue:** {venue['name']}", f"**Page limit:** {venue['review']} (review) / {venue['final']} (final)")
        report.lines(*([f"**Required sections:** {', '.join(venue['sections'])}"] if venue.get("sections") else []), "")
    if not counts:
        report.lines("No issues found.")
        return
    report.lines("| Severity | Count |", "|---|---|", *(f"| {HEADINGS[s]} | {counts[s]} |" for s in HEADINGS if s in counts), "")
    for severity, heading in HEADINGS.items():
        some_line = F.when(F.coalesce("line_number", F.lit(0)) != 0, F.concat(F.lit(", line "), F.col("line_number").cast("string"))).otherwise("")
        content = F.when(F.lit(severity == "error") & (some("line_content") != ""), F.concat(F.lit("  - `"), F.substring("line_content", 1, 80), F.lit("`")))
        advice = F.when(some("suggestion") != "", F.concat(F.lit("  - *"), "suggestion", F.lit("*")))
        text = F.concat_ws("\n", F.concat(F.lit("- "), "message"), F.concat(F.lit("  - `"), _name_of(F.col("file_path")), F.lit("`"), some_line), content, advice)
        rows = findings.filter((F.col("severity") == severity) & ~F.col("passed")).select("file_path", "line_number", "rule_id", "message", text.alias("text"))
        fold = severity == "info"
        report.rows(rows, [f"## {heading}", "", *(["<details>", ""] if fold else [])], ["", "</details>", ""] if fold else [""])


def bibliography_report(report: Report, summary: dict, sections: dict[str, DataFrame | None], made: str) -> None:
    """Header, note, summary table, and the sections that have rows. A check that did not run shows N/A.

    ``sections``: missing (key), duplicates (keys, score, reason), unused (key, title), issues (key, issues).
    """
    show = lambda k: "N/A" if summary.get(k) is None else str(summary[k])
    report.lines("# Bibliography Validation Report", "", f"Generated: {made}", "", DISCLAIMER, "", "| Metric | Value |", "|---|---|")
    report.lines(*(f"| {k.replace('_', ' ')} | {show(k)} |" for k in ("total", "verified", "with_issues", "used", "unused", "missing", "duplicate_groups")))
    key = F.concat(F.lit("- `"), "key", F.lit("`"))
    texts = {
        "missing": ("Missing Bibliography Entries", lambda t: t.select("key", key.alias("text"))),
        "duplicates": ("Duplicate Entries", lambda t: t.select((-F.col("score")).alias("o"), "keys", F.concat(F.lit("- "), F.array_join("keys", ", "), F.lit(": "), "reason", F.lit(" ("), percent(F.col("score"), 1), F.lit(")")).alias("text"))),
        "unused": ("Unused Entries", lambda t: t.select("key", F.concat(key, F.lit(": *"), some("title"), F.lit("*")).alias("text"))),
        "issues": ("Metadata and Relevance Issues", lambda t: t.select("key", F.concat(key, F.lit(": "), F.array_join("issues", "; ")).alias("text"))),
    }
    found = [report.rows(text(sections[name]), ["", f"## {heading}", ""]) for name, (heading, text) in texts.items() if sections.get(name) is not None]
    if not any(found):
        report.lines("", "No critical issues found.")
    report.lines("")


def preprint_section(report: Report, r: dict) -> None:
    share = "N/A" if r["ratio"] is None else f"{r['ratio']:.1%}"
    report.lines("", "## Preprints", "", f"{r['n_preprints']} of {r['n_used']} used entries ({share}){'; above the threshold' if r['warn'] else ''}", "")


def verified_section(report: Report, rows: DataFrame, minimal: bool = False) -> None:
    """Entries that a source confirms (key, title, source, confidence, scores); ``minimal`` leaves out titles and confidence."""
    marks = F.when(F.size("scores") > 0, F.concat(F.lit(", relevance "), F.array_join(F.transform("scores", lambda s: F.concat(s.cast("string"), F.lit("/5"))), " "))).otherwise("")
    more = F.lit("") if minimal else F.concat(F.lit(": "), some("title"), F.lit(" ("), "source", F.lit(", "), percent(F.col("confidence"), 1), marks, F.lit(")"))
    report.lines("", "## Verified")
    report.rows(rows.select("key", F.concat(F.lit("- `"), "key", F.lit("`"), more).alias("text")))
    report.lines("")


def line_report(report: Report, findings: DataFrame, blocks_: DataFrame, made: str) -> None:
    """Findings by file and line or block, in order, with the counts of their file; each finding is shown once."""
    rows = findings.filter(~F.col("passed") & F.col("line_number").isNotNull())
    counts = F.concat_ws(" | ", *(F.count_if(F.col("severity") == s).cast("string") for s in HEADINGS))
    heads = rows.groupBy("file_path").agg(counts.alias("counts"))
    head = F.concat(F.lit("\n## "), _name_of(F.col("file_path")), F.lit("\n\n| Errors | Warnings | Suggestions |\n|---|---|---|\n| "), "counts", F.lit(" |"))
    heads = heads.select("file_path", F.lit(0).alias("group_line"), F.lit(0).alias("end_line"), head.alias("text"))
    place = F.when(F.col("block_type").isNotNull(), F.format_string("Lines %d-%d (%s)", "group_line", "end_line", "block_type")).otherwise(F.format_string("Line %d", "group_line"))
    shown = F.when(some("line_content") != "", F.concat(F.array_join(F.transform(F.split("line_content", "\n"), lambda x: F.concat(F.lit("    "), x)), "\n"), F.lit("\n")))
    issues = F.array_join(F.transform("issues", lambda i: F.concat(F.lit("- **"), i["severity"], F.lit("** (line "), i["line_number"].cast("string"), F.lit(") "), i["message"])), "\n")
    text = F.concat_ws("\n", F.concat(F.lit("\n### "), place, F.lit("\n")), shown, issues)
    body = grouped_findings(findings, blocks_).select("file_path", "group_line", F.coalesce("end_line", F.lit(0)).alias("end_line"), text.alias("text"))
    report.lines("# Line-by-Line Report", "", f"Generated: {made}")
    if not report.rows(heads.unionByName(body)):
        report.lines("", "No issues found.")
