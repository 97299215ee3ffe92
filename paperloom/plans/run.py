"""A full audit: read manuscripts and bibliographies, run the enabled checks, write reports and clean bibliographies."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import duplicate_authors, for_comparison, some
from ..operators import citations as C
from ..operators import duplicates as find
from ..operators import lookup, reports, rules, verify
from ..operators.shared import ensure_checkpoint_dir, stored
from ..sources import bib_entries, lines_of, read_bytes, read_texts
from ..sources.settings import VENUES, Settings
from ..sources.writers import Report, filesystem, merge_files, write_files


@dataclass
class Audit:
    """The tables of a run; None where the check is off."""

    tex: DataFrame
    bib: DataFrame
    entries: DataFrame
    citations: DataFrame
    findings: DataFrame
    usage: DataFrame | None = None
    missing: DataFrame | None = None
    duplicates: DataFrame | None = None
    verified: DataFrame | None = None
    preprints: DataFrame | None = None
    relevance: DataFrame | None = None


def _source(spark: SparkSession, settings: Settings, one: str, glob: str, read=read_texts) -> DataFrame:
    """Files of the input folder but those that an earlier run wrote, or the one named file."""
    if not settings.input_dir:
        return read(spark, settings.path(one), "*")
    written = Path(settings.path(settings.output_dir)).resolve().as_uri().replace("file://", "file:")
    return read(spark, settings.path(settings.input_dir), glob).filter(~F.startswith("file_path", F.lit(written + "/")))


def audit(spark: SparkSession, settings: Settings, catalogue: DataFrame | None = None, scorer=None) -> Audit:
    """Plans of all enabled checks. Metadata needs a ``catalogue``, relevance also a ``scorer`` (see ``operators.lookup``)."""
    tex, bib = _source(spark, settings, settings.tex, "*.tex"), _source(spark, settings, settings.bib, "*.bib")
    for files, kind in ((tex, ".tex"), (bib, ".bib")):
        if files.select("file_path").limit(1).count() == 0:
            raise FileNotFoundError(f"no {kind} files found in {settings.path(settings.input_dir) or settings.path(settings.tex if kind == '.tex' else settings.bib)}")
    lines = lines_of(tex)
    # Entries are numbered by place, without a global order: the hash of (file, place) names them.
    entries = bib_entries(bib).withColumn("entry_id", F.xxhash64("file_path", "entry_ord"))
    cited = C.extract(lines)
    out = Audit(tex, bib, entries, cited, rules.findings(tex, settings.checkers))
    if settings.check_usage:
        out.usage, out.missing = C.usage(entries, cited), C.missing(entries, cited)
    if settings.check_preprint_ratio:
        out.preprints = C.preprint_ratio(C.used(entries, cited).withColumn("is_preprint", C.is_preprint()), settings.preprint_warning_threshold)
    if settings.check_duplicates:
        out.duplicates = duplicates(entries)
    if catalogue is not None and (settings.check_metadata or settings.check_relevance):
        ready = lookup.prepared(catalogue)
        found = lookup.lookups(entries, ready, settings.workflow or None)
        if settings.check_metadata:
            out.verified = verify.cascade(entries, found)
        if settings.check_relevance and scorer is not None:
            places = C.cited_contexts(lines).select("file_path", "line_number", "key", "full_context")
            asked = places.join(entries.select("key", "entry_id"), "key")
            out.relevance = lookup.relevance(asked, lookup.abstracts(entries, found, ready), scorer)
    return out


def duplicates(entries: DataFrame) -> DataFrame:
    """Duplicate groups by key: (keys, score, reason). Input order is that of files by path, then place."""
    # Row numbers of range-dealt, sorted rows rise in input order; they are stored before use, as another run may deal anew.
    ensure_checkpoint_dir(entries.sparkSession)
    dealt = entries.repartitionByRange("file_path", "entry_ord").sortWithinPartitions("file_path", "entry_ord")
    rows = dealt.select(F.monotonically_increasing_id().alias("ord"), "key", for_comparison(F.col("title")).alias("title"), duplicate_authors(some("author")).alias("authors")).checkpoint()
    groups, members = find.groups(rows)
    keyed = members.join(rows.select("ord", "key"), "ord").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("ord", "key"))).alias("m"))
    return groups.join(keyed, "anchor").select(F.col("m.key").alias("keys"), "score", "reason").orderBy(F.desc("score"), "keys")


def _place(path: str, root: str) -> Path:
    """Where a file goes below the output folder: its path below the input folder, else its name."""
    own = Path(unquote(urlparse(path).path))
    try:
        return own.relative_to(Path(root).resolve()) if root else Path(own.name)
    except ValueError:
        return Path(own.name)


def write(result: Audit, settings: Settings, made: str | None = None) -> dict[str, str]:
    """Reports, clean bibliographies and copies of the inputs in the output folder; names to paths.

    Executors write all of it (``sources.writers``): each file of the input once, in one job for all of a kind, and
    each report from sorted part files. Copies are the bytes of the inputs; files of subfolders keep their folders.
    """
    spark = result.tex.sparkSession
    out = settings.path(settings.output_dir)
    made = made or datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    written = {}

    def report(name: str, fill) -> None:
        own = Report(spark, out, name)
        try:
            fill(own)
            written[name] = own.close()
        finally:
            own.drop()

    rows = stored(entry_rows(result))
    findings = stored(result.findings)
    summary = reports.bibliography_summary(rows).first().asDict()
    if result.usage is None:
        summary["used"] = summary["unused"] = None
    if result.verified is None:
        summary["verified"] = None
    duplicate_rows = stored(result.duplicates) if result.duplicates is not None else None
    summary["missing"] = result.missing.count() if result.missing is not None else None
    summary["duplicate_groups"] = duplicate_rows.count() if duplicate_rows is not None else None
    sections = {
        "missing": result.missing,
        "duplicates": duplicate_rows,
        "unused": rows.filter(~F.col("is_used")) if result.usage is not None else None,
        "issues": rows.filter("size(issues) > 0"),
    }

    def bibliography(own: Report) -> None:
        reports.bibliography_report(own, summary, sections, made)
        if result.preprints is not None:
            reports.preprint_section(own, result.preprints.first().asDict())
        if result.verified is not None:
            reports.verified_section(own, rows.filter("is_match"), settings.minimal_verified)
        own.lines("---", f"Made on {made}")

    venue = next(({"name": v[1], "review": v[3], "final": v[4], "sections": v[5]} for v in VENUES if v[0] == settings.template), None)
    report("bibliography_report.md", bibliography)
    report("latex_quality_report.md", lambda own: reports.quality_report(own, findings, made, venue))
    report("line_by_line_report.md", lambda own: reports.line_report(own, findings, reports.blocks(result.tex), made))
    root = settings.path(settings.input_dir) if settings.input_dir else ""
    used = C.used(result.entries, result.citations).groupBy("file_path").agg(F.collect_set("key").alias("keys"))
    bib = _source(spark, settings, settings.bib, "*.bib", read_bytes).join(used, "file_path", "left")
    write_files(_source(spark, settings, settings.tex, "*.tex", read_bytes), out, lambda row: [(str(_place(row["file_path"], root)), row["content"])])

    def both(row: dict):
        place = _place(row["file_path"], root)
        clean = reports.clean_bib(row["content"].decode("utf-8", "replace"), set(row["keys"] or ()))
        return [(str(place), row["content"]), (str(place.with_name(f"{place.stem}_only_used.bib")), clean.encode("utf-8"))]

    clean = write_files(bib, out, both).filter(F.endswith("place", F.lit("_only_used.bib")))
    _, folder = filesystem(out)
    written |= {r["place"]: f"{folder}/{r['place']}" for r in clean.select("place").toLocalIterator()}
    if clean.count() > 1:
        merge_files(clean, out, "merged_only_used.bib")
        written["merged_only_used.bib"] = f"{folder}/merged_only_used.bib"
    return written


def entry_rows(result: Audit) -> DataFrame:
    """One row for each entry with its verdicts: is_used, is_match, source, issues and relevance scores."""
    rows = (result.usage if result.usage is not None else result.entries.withColumn("is_used", F.lit(False))).select("entry_id", "key", "title", "is_used")
    none: Column = F.array().cast("array<string>")
    if result.verified is None:
        rows = rows.withColumns({"is_match": F.lit(False), "source": F.lit(""), "confidence": F.lit(0.0), "issues": none})
    else:
        rows = rows.join(result.verified.select("entry_id", "is_match", "source", "confidence", "issues"), "entry_id", "left")
    if result.relevance is None:
        return rows.withColumn("scores", F.array().cast("array<int>"))
    scores = result.relevance.groupBy("entry_id").agg(F.sort_array(F.collect_set("relevance_score")).alias("scores"))  # six values at most
    return rows.join(scores, "entry_id", "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<int>")))
