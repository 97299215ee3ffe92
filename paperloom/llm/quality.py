"""Line-first quality cleaning (operator 1), on DataFrame functions only.

Every line with a word is judged alone by three rules; failing lines go, and a document that loses
more than ``max_loss`` of its word characters is rejected. Before that, the base rule rejects
documents of few words and those mostly made of repeated three-word windows.

Defined results: a null text has no words and is rejected; an empty text likewise; very long texts and
lines are judged whole; repeated rows are judged alike, each for itself; other columns, whatever their
names, are passed through untouched by ``clean``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, packed

#: A line with a word.
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: A line closes with one of these, perhaps inside quotes or brackets.
CLOSED = r"""[.!?:;…。！？]["'”’)\]]*[\x20\x09-\x0D]*$"""
SHOUT = r"[!?]{2,}"
SEPARATOR = r"\x20[|»>·•]"
#: Phrases of site furniture, in lower case. A line fails if its phrases make up FURNITURE_SHARE percent of
#: its characters or more: a line that mentions one in passing is prose, whatever its length.
FURNITURE_SHARE = 8
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use of cookies",
    "enable javascript", "click here", "subscribe to our newsletter", "sign up for", "log in to", "powered by", "lorem ipsum",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "cliquez ici",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "klicken sie hier",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "haga clic aquí",
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _furnished(text: Column) -> Column:
    """Whether the phrases make up too much of ``text``. Most lines hold none and are not measured."""

    def share(t: Column) -> Column:
        some = reduce(lambda a, b: a | b, [t.contains(p) for p in BOILERPLATE])
        chars = reduce(lambda a, b: a + b, [F.when(t.contains(p), F.size(F.split(t, re.escape(p))) - 1).otherwise(0) * len(p) for p in BOILERPLATE])
        return some & (100 * chars >= FURNITURE_SHARE * F.length(t))

    return _let(F.lower(text), share)


def line_fails(line: Column, seen: Column) -> dict[str, Column]:
    """The verdict of each rule on one line that has a word.

    ``seen`` says which marks its document holds at all (see ``marks``); a line of a document without
    a mark is not searched for it.
    """
    words = F.size(F.split(F.trim(line), WORD_GAP))
    symbols, shouts = seen["symbols"] & (F.regexp_count(line, F.lit(SYMBOLS)) * 4 > words), seen["shouts"] & (F.regexp_count(line, F.lit(SHOUT)) >= 3)
    return {
        "punctuation": ~line.rlike(CLOSED) | symbols | shouts,
        "navigation": seen["separators"] & (F.regexp_count(line, F.lit(SEPARATOR)) >= 3),
        "boilerplate": _furnished(line),
    }


def marks(text: Column) -> Column:
    """Which marks of the line rules a text holds anywhere, by plain substring search."""
    holds = lambda *marks: reduce(lambda a, b: a | b, [text.contains(m) for m in marks])
    return F.struct(
        text.rlike(SYMBOLS).alias("symbols"),
        holds("!!", "!?", "?!", "??").alias("shouts"),
        holds("|", "»", ">", "·", "•").alias("separators"),
    )


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that the text holds twice or more, the first time included.

    Windows are compared by a 64-bit hash within their document. Sorted hashes show which occur again;
    a few of those are looked up one by one, and for many the sorted (hash, position) pairs put equal
    windows side by side, so this takes n log n steps for any number of repeats.
    """
    n, none = F.size(words), F.lit(0).cast("long")
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(n - 2, F.lit(0)))

    def twice(p: Column) -> Column:
        same = F.filter(p, lambda x, j: ((j > 0) & (x["h"] == F.get(p, j - 1)["h"])) | F.coalesce(x["h"] == F.get(p, j + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, none, lambda a, x: a + x.cast("long"))

    def few(h: Column, again: Column) -> Column:
        at = F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i).otherwise(-1))
        return _let(F.filter(at, lambda i: i >= 0), covered)

    def many(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(pairs, lambda p: _let(twice(p), covered))

    def count(h: Column) -> Column:
        unique = F.size(F.array_distinct(h)) == F.size(h)
        again = _let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, j: (j > 0) & (x == F.get(s, j - 1)))))
        return F.when(unique, none).otherwise(_let(again, lambda a: F.when(F.size(a) <= 16, few(h, a)).otherwise(many(h))))

    return F.when(n >= 3, _let(hashes, count)).otherwise(none)


def judge(docs: DataFrame, text: str = "text", *, min_words: int = 50, max_repeat: int = 50, max_loss: int = 50) -> DataFrame:
    """``docs`` with the columns ``q_*``: counts, base verdict, kept text and verdict."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, WORD_GAP), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(HAS_WORD))

    def fails(x: Column) -> Column:
        f = line_fails(x, F.col("q_marks"))
        return f["punctuation"] | f["navigation"] | f["boilerplate"]

    df = docs.withColumns({"q_words": words, "q_lines": lines, "q_marks": marks(t)})
    df = df.withColumns(
        {
            "q_word_chars": word_chars(F.col("q_words")),
            "q_symbols": F.when(F.col("q_marks.symbols"), F.regexp_count(t, F.lit(SYMBOLS))).otherwise(0).cast("long"),
            "q_n_words": F.size("q_words").cast("long"),
            "q_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "q_repeat_words": repeat_words(F.col("q_words")),
            "q_kept_lines": F.filter("q_lines", lambda x: ~fails(x)),
        }
    )
    df = df.withColumns(
        {
            "q_failed": (F.col("q_n_words") < min_words) | (100 * F.col("q_repeat_words") > max_repeat * F.col("q_n_words")),
            "q_removed_lines": (F.size("q_lines") - F.size("q_kept_lines")).cast("long"),
            "q_text": F.array_join("q_kept_lines", "\n"),
        }
    )
    left = word_chars(F.split("q_text", WORD_GAP))
    df = df.withColumn("q_kept_chars", F.when(F.col("q_removed_lines") == 0, F.col("q_word_chars")).otherwise(left))
    enough = 100 * F.col("q_kept_chars") >= (100 - max_loss) * F.col("q_word_chars")
    return df.withColumn("q_kept", ~F.col("q_failed") & enough).drop("q_words", "q_lines", "q_kept_lines", "q_marks")


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The kept documents with their failing lines removed; same columns as ``docs``."""
    # The random column keeps the filter above the projections; pushed below them, it would repeat their expressions.
    df = judge(packed(docs, docs["text"].alias("text")), **limits).withColumn("q_stay", F.rand(1)).filter("q_kept AND q_stay >= 0")
    new = {"text": F.col("q_text"), "n_chars": F.length("q_text").cast("long")}
    return df.select(*(new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select(
        "doc_id",
        F.col("q_n_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat_words").alias("n_repeat_words"),
        F.col("q_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"),
        F.col("q_removed_lines").alias("n_removed_lines"),
        F.col("q_kept_chars").alias("kept_chars"),
    )


_PHRASES = " + ".join(f"""{len(p)} * (len(string_split(lower(x), '{p.replace("'", "''")}')) - 1)""" for p in BOILERPLATE)
_W = r"[\x20\x09-\x0D]"
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
lw AS (SELECT r, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
j AS (SELECT r, x, len(array_to_string(w, '')) AS c,
  NOT regexp_matches(x, '[.!?:;\x{{2026}}\x{{3002}}\x{{FF01}}\x{{FF1F}}]["''\x{{201D}}\x{{2019}})\]]*{_W}*$')
  OR 4 * len(regexp_extract_all(x, '[#*$%&|<>]')) > len(w)
  OR len(regexp_extract_all(x, '[!?][!?]+')) >= 3
  OR len(regexp_extract_all(x, '\x20[|\x{{BB}}>\x{{B7}}\x{{2022}}]')) >= 3
  OR 100 * ({_PHRASES}) >= {FURNITURE_SHARE} * length(x) AND ({_PHRASES}) > 0 AS bad FROM lw),
s AS (SELECT r, count(*) - count(DISTINCT x) AS dup, count(*) FILTER (bad) AS removed, coalesce(sum(c) FILTER (NOT bad), 0) AS kept FROM j GROUP BY r),
a AS (SELECT d.doc_id, len(w.w) AS n_words, len(array_to_string(w.w, '')) AS word_chars, len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS n_symbols,
  coalesce(s.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(s.removed, 0) AS n_removed_lines, coalesce(s.kept, 0) AS kept_chars
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN s USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= 50 * word_chars AS kept,
  n_removed_lines::BIGINT AS n_removed_lines, kept_chars::BIGINT AS kept_chars FROM a
"""
