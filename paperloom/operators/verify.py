"""Metadata comparison and the prioritized lookup over catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import author_similarity, percent, some, title_similarity


def compare(pairs: DataFrame, *, bib: str = "b_", found: str = "f_") -> DataFrame:
    """Adds the comparison columns. Titles and author lists (title, authors) are normalized already."""
    b, f = (lambda c: F.col(bib + c)), (lambda c: F.col(found + c))
    df = pairs.withColumn("title_similarity", title_similarity(b("title"), f("title"))).withColumn("author_similarity", author_similarity(b("authors"), f("authors")))
    year = F.trim(some(b("year"))) == some(f("year"))
    df = df.withColumns({"title_match": F.col("title_similarity") >= P.TITLE_MATCH, "author_match": F.col("author_similarity") >= P.AUTHOR_MATCH, "year_match": year})
    confidence = 0.5 * F.col("title_similarity") + 0.3 * F.col("author_similarity") + 0.2 * F.when(F.col("year_match"), 1.0).otherwise(0.5)
    both_years = (some(b("year")) != "") & (some(f("year")) != "")
    issues = F.array(
        F.when(~F.col("title_match"), F.concat(F.lit("Title mismatch (similarity: "), percent(F.col("title_similarity")), F.lit(")"))),
        F.when(~F.col("author_match"), F.concat(F.lit("Author mismatch (similarity: "), percent(F.col("author_similarity")), F.lit(")"))),
        F.when(both_years & ~F.col("year_match"), F.concat(F.lit("Year mismatch: bib="), b("year"), F.lit(", "), F.col("source"), F.lit("="), f("year"))),
    )
    return df.withColumns({"is_match": F.col("title_match") & F.col("author_match"), "confidence": confidence, "issues": F.array_compact(issues)})


def cascade(entries: DataFrame, compared: DataFrame, entry: str = "entry_id") -> DataFrame:
    """The first matching step's row of each entry, else that of the highest confidence (earliest step on
    ties), else an `unable` row. ``compared`` has step_ord; maxima are taken before any join."""
    rank = F.struct(
        F.col("is_match").alias("m"),
        F.when(F.col("is_match"), -F.col("step_ord")).alias("first"),
        F.col("confidence").alias("c"),
        (-F.col("step_ord")).alias("o"),
    )
    best = compared.groupBy(entry).agg(F.max_by(F.struct("source", "step_ord", "is_match", "confidence", "issues"), rank).alias("r"))
    out = entries.select(entry).join(best, entry, "left").select(entry, "r.*")
    none = F.col("source").isNull()
    return out.withColumns(
        {
            "issues": F.when(none, F.array(F.lit("Unable to find this paper in any data source"))).otherwise(F.col("issues")),
            "is_match": F.coalesce("is_match", F.lit(False)),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "source": F.coalesce("source", F.lit("unable")),
        }
    )
