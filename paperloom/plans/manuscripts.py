"""Manuscripts made of the documents table: each starts with one of a few passages that are known to raise
certain findings, and goes on with the document's whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

#: Passages and what the rules must say about each: (checker, rule, severity, line, message, line content, suggestion).
_ADD_T, _MOVE_T = "Add \\caption{} before \\begin{tabular}", "Move \\caption{} before \\begin{tabular}"
_ADD_F, _MOVE_F = "Add \\caption{} after \\includegraphics", "Move \\caption{} after \\includegraphics"
_ONE, _SEE = "\\label{fig:one} \\label{eq:two} \\label{three}", "see \\ref{tab:none} and \\autoref{eq:two, sec:gone}"
_CITED = "words \\cite{a} and more \\citep{b}"
_AI, _LEFT, _LATEX = "Remove AI-generated conversational text", "Replace placeholder with actual content or remove", "Convert to LaTeX formatting or remove if unintentional"
_RECENT = "Consider if there's more recent work on this topic"
PASSAGES: list[tuple[str, list[tuple]]] = [
    (
        "\\begin{table}\nx\n\\end{table}\n\\begin{table}\n\\begin{tabular}{l}a\\end{tabular}\n\\caption{late}\n\\end{table}\n\\begin{figure}\ny\n\\end{figure}\n"
        "\\begin{figure*}\n  \\caption{early}\n\\includegraphics{z}\n\\end{figure*}\n% \\begin{table}\n% \\end{table}",
        # A caption's line is that of its place counted from the begin of its environment, so it may be the one before.
        [
            ("caption", "R1", "warning", 1, "Table environment missing caption", None, _ADD_T),
            ("caption", "R2", "error", 5, "Table caption should be placed ABOVE the table content", "\\begin{tabular}{l}a\\end{tabular}", _MOVE_T),
            ("caption", "R3", "warning", 8, "Figure environment missing caption", None, _ADD_F),
            ("caption", "R4", "error", 11, "Figure caption should be placed BELOW the figure content", "\\begin{figure*}", _MOVE_F),
        ],
    ),
    (
        f"{_ONE}\n  {_SEE}\n\\newcommand{{\\x}}{{\\ref{{inner}} \\ref{{#1}}}}\n% \\label{{fig:dead}} \\ref{{fig:dead}}\n\\appendix\n\\label{{app:proof}}\n\\label{{fig:later}}",
        [
            ("reference", "R5", "warning", 1, "Unreferenced figure: 'fig:one'", _ONE, "Add \\ref{fig:one} or \\autoref{fig:one} where appropriate"),
            ("reference", "R5", "info", 1, "Unreferenced label: 'three'", _ONE, "Add \\ref{three} or \\autoref{three} where appropriate"),
            ("reference", "R5", "info", 6, "Unreferenced appendix: 'app:proof'", "\\label{app:proof}", "Add \\ref{app:proof} or \\autoref{app:proof} where appropriate"),
            ("reference", "R5", "warning", 7, "Unreferenced figure: 'fig:later'", "\\label{fig:later}", "Add \\ref{fig:later} or \\autoref{fig:later} where appropriate"),
            ("reference", "R6", "error", 2, "Reference to undefined label: 'tab:none'", _SEE, "Add \\label{tab:none} to the target element or fix the reference"),
            ("reference", "R6", "error", 2, "Reference to undefined label: 'sec:gone'", _SEE, "Add \\label{sec:gone} to the target element or fix the reference"),
            ("reference", "R7", "warning", 6, "Appendix section 'app:proof' is not referenced in main text", None, "Add a reference to this appendix section in the main text"),
        ],
    ),
    (
        f"{_CITED}\ntext~\\citet{{c}} % late \\cite{{d}}\ntea & milk AT&amp;T \\&\n$a & b$ and \\begin{{tabular}}c & d\\end{{tabular}}\nend.\n\n\n\nNext.",
        [
            ("formatting", "R8", "info", 1, "Citation without non-breaking space", _CITED, "Use ~ before \\cite (e.g., 'text~\\cite{key}')"),
            ("formatting", "R8", "info", 1, "Citation without non-breaking space", _CITED, "Use ~ before \\cite (e.g., 'text~\\cite{key}')"),
            ("formatting", "R9", "info", None, "Mixed citation styles detected: parenthetical, textual, plain", None, "Consider using consistent citation style throughout"),
            ("formatting", "R10", "info", 5, "Multiple blank lines (3 consecutive blank lines)", "end.\n> blank line ⚠️\n> blank line ⚠️\n> blank line ⚠️\nNext.", "Reduce to single blank line or use \\vspace"),
            ("formatting", "R11", "warning", 3, "Unescaped & outside tabular/math environment", "tea & milk AT&amp;T \\&", "Use \\& to escape"),
        ],
    ),
    (
        "\\begin{equation}\na\n\\end{equation} where b\n\\begin{equation}a.\\end{equation}\n\\begin{align*}c,\\end{align*}\n$x$ and \\(y\\)",
        [
            ("equation", "R12", "info", 3, "Equation may need punctuation (sentence continues after)", None, "Add comma or period inside equation if it ends a clause"),
            ("equation", "R13", "info", None, "Mixed equation numbering: 2 numbered, 2 unnumbered", None, "Consider consistent numbering strategy"),
            ("equation", "R14", "info", None, "Mixed inline math: $1 \\$...\\$ and 1 \\(...\\)", None, "Use consistent inline math delimiters throughout"),
        ],
    ),
    (
        "As an AI language model we help\nTODO: fill [insert name here]\n# Heading\n**bold** words\n\\begin{verbatim}\nTODO: quoted\n\\end{verbatim}\n% TODO: comment\n- item one\n- item $x$",
        [
            ("ai_artifacts", "R15", "error", 1, "AI self-reference detected", "As an AI language model we help", _AI),
            ("ai_artifacts", "R16", "warning", 2, "Placeholder text: '[insert name here]'", "TODO: fill [insert name here]", _LEFT),
            ("ai_artifacts", "R16", "warning", 2, "TODO comment: 'TODO: fill [insert name here]'", "TODO: fill [insert name here]", _LEFT),
            ("ai_artifacts", "R17", "info", 3, "Possible Markdown header in LaTeX", "# Heading", _LATEX),
            ("ai_artifacts", "R17", "info", 4, "Possible Markdown bold in LaTeX", "**bold** words", _LATEX),
            ("ai_artifacts", "R17", "info", 9, "Possible Markdown bullet point in LaTeX", "- item one", _LATEX),
        ],
    ),
    (
        "There are many models\n  It is shown\nIt is shown clearly in order to go\n% There are comments\ndue to the fact that results",
        [
            ("sentence", "R18", "info", 1, "Weak start with 'There is/are'", "There are many models", None),
            ("sentence", "R18", "info", 3, "Weak start with 'It is'", "It is shown clearly in order to go", None),
            ("sentence", "R19", "info", 3, "Hedging language: 'clearly'", None, "Unsupported assertion - consider citing or removing"),
            ("sentence", "R20", "info", 3, "Redundant phrase: 'in order to'", None, "Use 'to' instead of 'in order to'"),
            ("sentence", "R20", "info", 5, "Redundant phrase: 'due to the fact that'", None, "Use 'because' instead"),
        ],
    ),
    (
        "color and colour, re-use and reuse, BERT and Bert, a well-known well known thing % grey gray",
        [
            ("consistency", "R21", "warning", None, "Inconsistent spelling: color, colour", None, "Use 'color' consistently throughout"),
            ("consistency", "R22", "info", None, "Inconsistent hyphenation: 're-use' vs 'reuse'", None, "Choose one form and use it consistently"),
            ("consistency", "R23", "info", None, "Inconsistent capitalization: 'BERT', 'Bert'", None, "Use consistent capitalization for technical terms"),
        ],
    ),
    (
        "We use Foo Bar Baz here.\nThen FBB works, see Old New Mix and ONM again\nQRS first.\nQuick Red Sun (QRS) later and GPU too and \\ref{XYZ} as well\nXerox Yard Zoo",
        [
            ("reference", "R6", "error", 4, "Reference to undefined label: 'XYZ'", "Quick Red Sun (QRS) later and GPU too and \\ref{XYZ} as well", "Add \\label{XYZ} to the target element or fix the reference"),
            ("acronym", "R24", "warning", 2, "Acronym 'FBB' used without definition (possible full form: 'Foo Bar Baz')", None, "Define on first use: 'Foo Bar Baz (FBB)'"),
            ("acronym", "R25", "warning", 3, "Acronym 'QRS' used before definition", None, "Move definition before first use"),
        ],
    ),
    ("50 % of all\nsome 10% and 20 percent\n% 5 % more\n\\label{x} 7 %", [("reference", "R5", "info", 4, "Unreferenced label: 'x'", "\\label{x} 7 %", "Add \\ref{x} or \\autoref{x} where appropriate")]),
    (
        "Smith (1990) said et al thing\nas shown [1] here\nsee (Smith et al., 2010) there\n\\newcommand{\\a}[1]{(Doe, 2011)}\n\\cite{x} [2] (Lee, 2012)\nagain 1990 and 1985 % 1980",
        [
            ("citation_quality", "R28", "info", 1, "Citation from 1990 (36 years old)", None, _RECENT),
            ("citation_quality", "R28", "info", 6, "Citation from 1985 (41 years old)", None, _RECENT),
            ("citation_quality", "R28", "info", 6, "Citation from 1980 (46 years old)", None, _RECENT),
            ("citation_quality", "R29", "warning", 1, "'et al' should be 'et al.'", None, "Add period after 'et al.'"),
            ("citation_quality", "R30", "info", 2, "Numeric citation style detected", None, "Consider author-year style for better readability"),
            ("citation_quality", "R31", "warning", 3, "Appears to be hardcoded citation instead of \\cite", "see (Smith et al., 2010) there", "Use \\cite{} for proper bibliography management"),
        ],
    ),
    (
        "% see github.com/me\ncode at github.com/me now\n\\section{Acknowledgments}\nour previous work says\n\\author{Jane {A.} Doe Smith}",
        [
            ("anonymization", "R33", "warning", 1, "GitHub profile URL in comment (could be revealed when compiling)", "% see github.com/me", "Remove or anonymize URL even in comments"),
            ("anonymization", "R34", "error", 2, "GitHub profile URL may reveal author identity", "code at github.com/me now", "Replace with anonymized URL or remove for review"),
            ("anonymization", "R35", "warning", 3, "Acknowledgments section found - should be commented out for review", None, "Comment out acknowledgments with % for anonymous submission"),
            ("anonymization", "R36", "warning", 4, "Potentially self-revealing citation pattern", "our previous work says", "Rephrase to avoid revealing authorship (e.g., 'Prior work shows...')"),
            ("anonymization", "R37", "error", 5, "Author field may contain real names", None, "Replace with 'Anonymous' or use anonymization command"),
        ],
    ),
    ("\\usepackage[final]{venue}\nsee github.com/me", [("anonymization", "R32", "info", None, "Document appears to be camera-ready version (not checking anonymization)", None, None)]),
    ("Nothing to find here.", []),
]
#: What the number rules say when they read percent signs before comments are cut, by passage.
WITH_SIGNS = [
    (8, "R26", 1, "Space before percent sign"),
    (9, "R26", 6, "Space before percent sign"),
    (8, "R27", None, "Mixed percentage notation: both '%' and 'percent' used"),
]


def sql_value(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values() -> str:
    rows = [(k, checker, rule, severity, line, message, content, advice) for k, (_, found) in enumerate(PASSAGES) for checker, rule, severity, line, message, content, advice in found]
    return ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows)


def _line_rules() -> str:
    """SELECTs of the findings that single lines (f, ln, line, live) of texts raise, by the same fixed patterns."""
    beside = {r"(?!\*)": "(?:[^*]|$)", r"(?<!\*)": "(?:^|[^*])", "(?!`)": "(?:[^`]|$)", "(?<!`)": "(?:^|[^`])", r"\w": r"[\p{L}\p{M}\p{N}_]"}

    def text(pattern: str) -> str:
        for ours, theirs in beside.items():
            pattern = pattern.replace(ours, theirs)
        return sql_value(pattern)

    def row(checker, rule, severity, message, content, advice, when) -> str:
        return f"SELECT f, '{checker}' AS c, '{rule}' AS r, '{severity}' AS s, ln AS l, {message} AS m, {content} AS t, {advice} AS a FROM live WHERE {when}"

    weak = " ".join(f"WHEN regexp_matches(live, {text(x)}, 'i') THEN {sql_value(name)}" for x, name in P.WEAK)
    out = [row("sentence", "R18", "info", f"CASE {weak} END", "left(trim(line), 80)", "NULL", f"CASE {weak} END IS NOT NULL")]
    for rule, title, patterns, chars in (("R19", "Hedging language", P.HEDGING, 30), ("R20", "Redundant phrase", P.REDUNDANT, 999)):
        for x, advice in patterns:
            message = f"'{title}: ' || chr(39) || left(regexp_extract(live, {text(x)}, 0, 'i'), {chars}) || chr(39)"
            out.append(row("sentence", rule, "info", message, "NULL", sql_value(advice), f"regexp_matches(live, {text(x)}, 'i')"))
    for x, name in P.MARKDOWN:
        when = f"regexp_matches(live, {text(x)})"
        when += " AND NOT contains(live, '$')" if name in ("Markdown bullet point", "Markdown italic") else ""
        when += r" AND NOT regexp_matches(live, '[-+]\d')" if name == "Markdown bullet point" else ""
        out.append(row("ai_artifacts", "R17", "info", sql_value(f"Possible {name} in LaTeX"), "left(trim(line), 100)", sql_value(_LATEX), when))
    return "\nUNION ALL ".join(out)


#: Every finding on every manuscript, as SQL over the documents table: those of its passage, and those that the
#: document's lines raise. An ampersand counts outside comments, and outside the stretch from the first dollar
#: sign to the last (texts have them three at a time, which opens and closes formulas throughout).
FINDINGS_SQL = rf"""WITH texts AS (SELECT 'doc' || doc_id || '.tex' AS f, doc_id % {len(PASSAGES)} AS k, coalesce(text, '') AS x FROM documents),
starts(k, n) AS (VALUES {", ".join(f"({k}, {p.count(chr(10)) + 1})" for k, (p, _) in enumerate(PASSAGES))}),
cut AS (SELECT f, n, string_split(x, chr(10)) AS y, instr(x, '$') AS first, length(x) - instr(reverse(x), '$') + 1 AS last FROM texts JOIN starts USING (k)),
numbered AS (SELECT f, n, y, first, CASE WHEN first = 0 THEN 0 ELSE last END AS last, unnest(range(1, len(y) + 1)) AS i FROM cut),
lines AS (SELECT f, n + i AS ln, y[i] AS line, first, last, sum(length(y[i]) + 1) OVER (PARTITION BY f ORDER BY i) - length(y[i]) - 1 AS before FROM numbered),
live AS (SELECT *, regexp_replace(line, '%.*', '') AS live FROM lines WHERE NOT regexp_matches(line, '^\s*%')),
amp AS (SELECT f, ln, line, unnest(list_filter(range(1, length(live) + 1), lambda j: live[j] = '&' AND NOT regexp_matches(line[j:], '^&[a-zA-Z]+;') AND (first = 0 OR before + j < first OR before + j > last))) AS j FROM live WHERE contains(live, '&')),
found AS ({_line_rules()}
UNION ALL SELECT f, 'formatting', 'R11', 'warning', ln, 'Unescaped & outside tabular/math environment', left(trim(line), 100), 'Use \& to escape' FROM amp
UNION ALL SELECT f, c, r, s, l, m, t, a FROM texts JOIN (VALUES {_values()}) AS v(k, c, r, s, l, m, t, a) USING (k))
SELECT f AS file_path, c AS checker_name, r AS rule_id, r = 'R32' AS passed, s AS severity, l::INT AS line_number, m AS message, t AS line_content, a AS suggestion FROM found"""


def manuscripts(spark, sf_dir: str) -> DataFrame:
    """(file_path, content) of all documents: a passage, then the whole text."""
    passages = F.array(*(F.lit(p) for p, _ in PASSAGES))
    head = F.element_at(passages, (F.col("doc_id") % len(PASSAGES) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.format_string("doc%d.tex", "doc_id").alias("file_path"), F.concat_ws("\n", head, F.coalesce("text", F.lit(""))).alias("content"))
