"""Scalar text functions as Column expressions; regular expressions are prefixed for Unicode classes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

U, UI = "(?U)(?d)", "(?U)(?d)(?i)"


def some(c) -> Column:
    """Missing text is empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_latex(c: Column) -> Column:
    for command in P.UNWRAPPED:
        c = F.regexp_replace(c, rf"\\{command}\{{([^}}]*)\}}", "$1")
    c = F.regexp_replace(c, r"\\href\{[^}]*\}\{([^}]*)\}", "$1")
    for accent in P.ACCENTS:
        c = F.regexp_replace(c, accent, "$1")
    for mark, char in P.LATEX_CHARS:
        c = F.replace(c, F.lit(mark), F.lit(char))
    return F.regexp_replace(c, r"[{}]", "")


#: Characters that decomposition leaves, by their ASCII spelling.
_SPELLED = {"ß": "ss", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "þ": "th", "ð": "d", "ı": "i", "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "..."}
#: Greek and Cyrillic small letters in the order of their alphabets; capitals begin with a capital.
_ALPHABETS = {
    "αβγδεζηθικλμνξοπρσςτυφχψω": "a b g d e z e th i k l m n x o p r s s t u ph kh ps o",
    "абвгдежзиклмнопрстуфхцчшщъыьэюяіјљњџєґ": "a b v g d e zh z i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia i j lj nj dzh ie g",
}
for _letters, _spellings in _ALPHABETS.items():
    _small = dict(zip(_letters, _spellings.split(" "), strict=True))
    _SPELLED |= {k.upper(): v.capitalize() for k, v in _small.items() if k != "ς"} | _small


def normalize_unicode(c: Column) -> Column:
    """Compatibility decomposition and ASCII spelling; other scripts are dropped. The one Arrow function here,
    used only for texts with a character outside ASCII."""
    @F.pandas_udf("string")
    def ascii_(texts: pd.Series) -> pd.Series:
        import unicodedata

        def one(t):
            t = "".join(_SPELLED.get(x, x) for x in unicodedata.normalize("NFKD", t))
            return t.encode("ascii", "ignore").decode()

        return texts.map(one, na_action="ignore")

    return ascii_(c)


def normalize_whitespace(c: Column) -> Column:
    # Single spaces, which most white space is, are left alone.
    return F.trim(F.regexp_replace(c, r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w\s]", "")


def for_comparison(c: Column, unicode: bool = True) -> Column:
    c = normalize_latex(some(c))
    c = _ascii_where_needed(c) if unicode else c
    return remove_punctuation(normalize_whitespace(F.lower(c)))


def _ascii_where_needed(c: Column) -> Column:
    """``normalize_unicode``, whose Python sees a text only if it has a character outside ASCII."""
    foreign = F.octet_length(c) != F.length(c)
    return F.when(foreign, normalize_unicode(F.when(foreign, c))).otherwise(c)


def author_name(c: Column) -> Column:
    """One name as "first last", of ASCII letters already."""
    c = normalize_whitespace(normalize_latex(c))
    c = F.regexp_replace(c, r"(?U)^([^,]*),\s*(.*)$", "$2 $1")
    return strip(remove_punctuation(F.lower(strip(c))))


def author_list(c: Column) -> Column:
    """Names of an `A and B` list. The whole list is transliterated at once, which leaves its marks as they are."""
    return F.filter(F.transform(F.split(_ascii_where_needed(some(c)), r"(?iU)\s+and\s+"), author_name), lambda x: x != "")


def author_names(c: Column) -> Column:
    """The normalized names of an array of names; empty ones go."""
    joined = _ascii_where_needed(F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\n"))
    return F.filter(F.transform(F.split(joined, "\n"), author_name), lambda x: x != "")


def duplicate_authors(c: Column) -> Column:
    """The duplicate finder's own reading of a list: parts between `` and ``, white space unified, no part
    turned around; then each is normalized like a title. Empty parts go before that."""
    parts = F.filter(F.transform(F.split(_ascii_where_needed(some(c)), " and "), normalize_whitespace), lambda x: x != "")
    return F.transform(parts, lambda x: for_comparison(x, unicode=False))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    share = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((a == "") | (b == ""), 0.0).when(F.size(F.array_union(x, y)) == 0, 1.0).otherwise(share)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def title_similarity(a: Column, b: Column) -> Column:
    """Token similarity, lifted by edit similarity for titles below the length limit."""
    return F.when(F.length(a) < P.LEVENSHTEIN_BELOW, F.greatest(jaccard(a, b), levenshtein_similarity(a, b))).otherwise(jaccard(a, b))


def names_match(a: Column, b: Column) -> Column:
    x, y = (F.filter(F.split(n, r"(?U)\s+"), lambda w: w != "") for n in (a, b))
    first = lambda w: F.get(w, F.lit(0))
    last = lambda w: F.get(w, F.size(w) - 1)
    return F.coalesce((last(x) == last(y)) | (first(x) == last(y)) | (last(x) == first(y)), F.lit(False))


def author_similarity(a: Column, b: Column) -> Column:
    """Mean over the first list of its best match in the second."""
    best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: F.when(x == y, 1.0).when(names_match(x, y), 1.0).otherwise(jaccard(x, y)))))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(mean)


def arxiv_id(c: Column, found: list[str] = P.ARXIV_ID, flags: str = "") -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, flags + p, 1), F.lit("")) for p in found], F.lit(""))


def comment_lookbehind(c: Column) -> Column:
    """C1: a percent sign not right after a backslash starts a comment."""
    return F.regexp_replace(c, r"(?d)(?<!\\)%.*$", "")


def comment_parity(c: Column) -> Column:
    """C2: a percent sign after an even run of backslashes starts a comment."""
    return F.regexp_replace(c, r"(?ds)(?<!\\)((?:\\\\)*)%.*$", "$1")


def is_comment_line(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*%")


def percent(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def label_type(label: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in P.LABEL_TYPES.items() for x in kv])
    return F.when(F.contains(label, F.lit(":")), F.coalesce(F.element_at(kinds, F.lower(F.split_part(label, F.lit(":"), F.lit(1)))), F.lit("label"))).otherwise("label")


def rule_name(message: Column) -> Column:
    """Display name of a finding: the first known phrase it holds, else the message without its variable parts."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(message, r"\(.*?\)", ""), r"'.*?'", ""), r"(?U)\d+", "")
    cases = F.when(F.lit(False), "")
    for phrase, name in P.RULE_NAMES:
        cases = cases.when(F.contains(message, F.lit(phrase)), name)
    return cases.otherwise(strip(F.split_part(plain, F.lit(":"), F.lit(1))))


def search_title(c: Column) -> Column:
    return normalize_whitespace(F.regexp_replace(c, r"(?U)[^\w\s]", " "))


def strip_doi(c: Column) -> Column:
    return F.regexp_replace(c, r"^https?://doi\.org/", "")
