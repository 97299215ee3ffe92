"""Queries over the star-schema tables. Those hold neither TeX nor BibTeX, so the operators run on inputs
derived from their columns (line items cite parts, orders hold labels, documents are lines) and on real text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import sources as S
from ..functions import text as T
from ..operators import citations as C
from ..operators import duplicates, lookup, rules, titles, verify
from ..operators import reports as R
from ..operators.shared import made_once
from ..sources.settings import settings_of, venues
from . import manuscripts as M

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bib(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_name", "p_type", "p_brand", "p_size")


def cites(spark, d) -> DataFrame:
    """Every line item cites twice its part's number: parts of odd number are never cited, and half of the cited keys are missing."""
    return table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("key"), F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("line_number"))


@query("""SELECT p_partkey AS key, count(l_partkey) AS usage_count, count(l_partkey) > 0 AS is_used, min(l_linenumber)::INT AS first_usage_line
FROM part LEFT JOIN lineitem ON l_partkey * 2 = p_partkey GROUP BY p_partkey""")
def usage_per_entry(spark, d):
    return C.usage(bib(spark, d), cites(spark, d)).select("key", "usage_count", "is_used", F.col("first_usage_line").cast("int").alias("first_usage_line"))


@query("SELECT DISTINCT l_partkey * 2 AS key FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT p_partkey FROM part)")
def missing_keys(spark, d):
    return C.missing(bib(spark, d), cites(spark, d))


@query("SELECT p_partkey AS key, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey * 2 FROM lineitem)")
def unused_entries(spark, d):
    return C.unused(bib(spark, d), cites(spark, d)).select("key", "p_name")


@query("SELECT p_partkey AS key, p_name FROM part WHERE p_partkey IN (SELECT l_partkey * 2 FROM lineitem)")
def used_entries(spark, d):
    return C.used(bib(spark, d), cites(spark, d)).select("key", "p_name")


@query("SELECT p_partkey AS key, p_name FROM part WHERE p_partkey = 42")
def entry_by_key(spark, d):
    return C.by_key(bib(spark, d), 42).select("key", "p_name")


def _published(spark, d) -> DataFrame:
    """Parts as entries: their kind, journal and arXiv id follow from their size."""
    n = F.col("p_size")
    venue = F.when(n % 5 == 0, "CoRR, arXiv Preprint").when(n % 5 == 1, "Journal of Parts").when(n % 5 == 2, "Tech. Report 7").otherwise("")
    kind = F.when(n % 7 == 0, "techreport").when(n % 7 == 1, "misc").otherwise("article")
    return bib(spark, d).withColumns({"journal": venue, "booktitle": F.lit(""), "publisher": F.lit(""), "entry_type": kind, "arxiv_id": F.when(n % 11 == 0, "2301.00001").otherwise("")})


_PREPRINT = "p_size % 5 IN (0, 2) OR p_size % 7 = 0 OR p_size % 11 = 0"


@query(f"SELECT p_partkey AS key, {_PREPRINT} AS is_preprint FROM part")
def preprint_entries(spark, d):
    return _published(spark, d).select("key", C.is_preprint().alias("is_preprint"))


@query(f"""WITH u AS (SELECT {_PREPRINT} AS x FROM part WHERE p_partkey IN (SELECT l_partkey * 2 FROM lineitem))
SELECT count(*) AS n_used, count(*) FILTER (x) AS n_preprints, (count(*) FILTER (x)) / nullif(count(*), 0)::DOUBLE AS ratio, coalesce((count(*) FILTER (x)) / nullif(count(*), 0)::DOUBLE > 0.5, false) AS warn FROM u""")
def preprint_share(spark, d):
    return C.preprint_ratio(C.used(_published(spark, d), cites(spark, d)).withColumn("is_preprint", C.is_preprint()))


@query("""SELECT l_orderkey AS file_path, l_linenumber::INT AS line_number, 'k' || k AS key, o::INT AS key_ord FROM lineitem, LATERAL (VALUES (l_partkey, 0), (l_suppkey, 1)) AS v(k, o)""")
def citation_extraction(spark, d):
    line = F.concat(F.lit("word \\citep[see][p. 3]{k"), "l_partkey", F.lit(" , k"), "l_suppkey", F.lit(",} end % \\cite{no}"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("line_number"), line.alias("line"))
    return C.extract(lines).select("file_path", "line_number", "key", "key_ord")


def _cited_texts(spark, d) -> DataFrame:
    """All documents by lines, with a command in front of each line and a citation in every fifth."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    cite = lambda n: F.when(n % 5 == 2, F.format_string("\\citep[see]{k%d, both} ", n)).otherwise("")
    marked = F.transform(lines, lambda line, at: F.concat(F.lit("\\emph{A}  b. "), cite(at + 1), line))
    return table(spark, d, "documents").select(F.format_string("doc%d.tex", "doc_id").alias("file_path"), marked.alias("lines"))


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '\\[a-zA-Z]+\*?(\[[^\]]*\])?', '', 'g'), '[{{}}]', '', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH d AS (SELECT 'doc' || doc_id || '.tex' AS f, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT f, n, '\emph{{A}}  b. ' || CASE WHEN n % 5 = 2 THEN '\citep[see]{{k' || n || ', both}} ' ELSE '' END || x[n] AS line FROM (SELECT f, x, unnest(range(1, len(x) + 1)) AS n FROM d)),
w AS (SELECT f, n, line, coalesce(string_agg(line, ' ') OVER (PARTITION BY f ORDER BY n ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(line, ' ') OVER (PARTITION BY f ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), '') AS a FROM l),
s AS (SELECT f, n, {_CLEAN.format('line')} AS t, list_filter(string_split(regexp_replace({_CLEAN.format('b')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS b, list_filter(string_split(regexp_replace({_CLEAN.format('a')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS a FROM w WHERE n % 5 = 2),
c AS (SELECT f, n, t, array_to_string(b[greatest(1, len(b) - 1):], ' ') AS b, array_to_string(a[:2], ' ') AS a FROM s)
SELECT f AS file_path, n::INT AS line_number, k AS key, b AS context_before, a AS context_after, concat_ws(' ', nullif(b, ''), nullif(t, ''), nullif(a, '')) AS full_context FROM c, LATERAL (VALUES ('k' || n), ('both')) AS v(k)""")
def citation_contexts(spark, d):
    return C.cited_in_texts(_cited_texts(spark, d)).select("file_path", "line_number", "key", "context_before", "context_after", "full_context")


def all_findings(spark, d) -> DataFrame:
    return rules.findings(M.manuscripts(spark, d), as_of=2026)


@query(M.FINDINGS_SQL)
def manuscript_findings(spark, d):
    return all_findings(spark, d)


@query(f"""SELECT 'doc' || doc_id || '.tex' AS file_path, r AS rule_id, l::INT AS line_number, m AS message
FROM documents JOIN (VALUES {", ".join("(" + ", ".join(map(M.sql_value, r)) + ")" for r in M.WITH_SIGNS)}) AS v(k, r, l, m) ON doc_id % {len(M.PASSAGES)} = k""")
def percent_notation(spark, d):
    return rules.findings(M.manuscripts(spark, d), ["number"], intent=True).select("file_path", "rule_id", "line_number", "message")


@query(f"SELECT severity, count(*) AS n FROM ({M.FINDINGS_SQL}) GROUP BY severity")
def severity_totals(spark, d):
    return R.severity_counts(all_findings(spark, d))


@query(f"SELECT checker_name, count(*) AS n FROM ({M.FINDINGS_SQL}) WHERE NOT passed GROUP BY checker_name")
def checker_totals(spark, d):
    return R.checker_counts(all_findings(spark, d))


#: Display names of the messages raised; those of messages without a name of their own, less their variable parts.
_NAMES = r"""('R1', 'Table environment missing caption'), ('R2', 'Table caption should be placed ABOVE the table content'), ('R3', 'Figure environment missing caption'), ('R4', 'Figure caption should be placed BELOW the figure content'),
('R6', 'Reference to undefined label'), ('R7', 'Unreferenced Appendix'), ('R8', 'Missing Non-breaking Space (~)'), ('R9', 'Mixed Citation Styles'), ('R10', 'Multiple Blank Lines'), ('R11', 'Unescaped Special Character'),
('R12', 'Equation may need punctuation'), ('R13', 'Mixed equation numbering'), ('R14', 'Mixed Math Notation'), ('R15', 'AI self-reference detected'),
('R19', 'Hedging/Vague Language'), ('R20', 'Redundant Phrasing'), ('R21', 'Spelling Inconsistency'), ('R22', 'Hyphenation Inconsistency'), ('R23', 'Inconsistent capitalization'),
('R24', 'Acronym  used without definition'), ('R25', 'Acronym  used before definition'), ('R28', 'Old Citation (10+ years)'), ('R29', 'should be'), ('R30', 'Numeric citation style detected'),
('R31', 'Appears to be hardcoded citation instead of \cite'), ('R33', 'GitHub profile URL in comment'), ('R34', 'GitHub profile URL may reveal author identity'), ('R35', 'Acknowledgments section found - should be commented out for review'),
('R36', 'Potentially self-revealing citation pattern'), ('R37', 'Author field may contain real names')"""


@query(f"""SELECT coalesce(v.name, CASE WHEN message LIKE 'Unreferenced figure%' THEN 'Unreferenced Figure' WHEN message LIKE 'Unreferenced label%' THEN 'Unreferenced Label' WHEN message LIKE 'Unreferenced appendix%' THEN 'Unreferenced appendix'
WHEN message LIKE '%bullet point%' THEN 'Markdown Bullet Point' WHEN message LIKE '%Markdown bold%' THEN 'Markdown Bold' WHEN message LIKE '%Markdown header%' THEN 'Possible Markdown header in LaTeX'
WHEN message LIKE 'Weak start%' THEN 'Weak Sentence Starter' WHEN message LIKE 'TODO comment%' THEN 'TODO comment' WHEN message LIKE 'Placeholder text%' THEN 'Placeholder text' END) AS rule_name, count(*) AS n
FROM ({M.FINDINGS_SQL}) f LEFT JOIN (VALUES {_NAMES}) AS v(rule, name) ON v.rule = f.rule_id WHERE NOT passed GROUP BY 1""")
def rule_display_names(spark, d):
    return R.rule_counts(all_findings(spark, d))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a ' WHEN 1 THEN 'a \\% b' WHEN 2 THEN 'a \\\\% b' ELSE 'ab' END AS c1, CASE doc_id % 4 WHEN 0 THEN 'a ' WHEN 1 THEN 'a \\% b' WHEN 2 THEN 'a \\\\' ELSE 'ab' END AS c2 FROM documents""")
def comment_classes(spark, d):
    texts = F.array(F.lit("a % b"), F.lit("a \\% b"), F.lit("a \\\\% b"), F.lit("ab"))
    line = F.element_at(texts, (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.comment_lookbehind(line).alias("c1"), T.comment_parity(line).alias("c2"))


_PAIR = "SELECT p_partkey, lower(p_name) AS a, replace(lower(p_name), 'a', 'e') || CASE WHEN p_size % 3 = 0 THEN ' x' ELSE '' END AS b FROM part"


@query(f"""WITH p AS ({_PAIR}), t AS (SELECT *, list_distinct(list_filter(string_split(a, ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(b, ' '), lambda x: x <> '')) AS y FROM p)
SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 9) AS jaccard, round(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 9) AS edit FROM t""")
def string_similarity(spark, d):
    p = _perturbed(spark, d)
    return p.select("p_partkey", F.round(T.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"), F.round(T.levenshtein_similarity(F.col("a"), F.col("b")), 9).alias("edit"))


def _perturbed(spark, d):
    a = F.lower("p_name")
    return table(spark, d, "part").select("p_partkey", "p_size", a.alias("a"), F.concat(F.replace(a, F.lit("a"), F.lit("e")), F.when(F.col("p_size") % 3 == 0, " x").otherwise("")).alias("b"))


def _compared(spark, d):
    """Sources: step k knows the parts with p_partkey % (k + 2) = 0, with a typo in odd steps; authors agree in even ones."""
    p = _perturbed(spark, d)
    steps = p.withColumn("step_ord", F.explode(F.array(*[F.lit(k) for k in range(4)]))).filter("p_partkey % (step_ord + 2) = 0")
    odd = F.col("step_ord") % 2 == 1
    pairs = steps.select(
        F.col("p_partkey").alias("entry_id"), "step_ord", F.concat(F.lit("s"), "step_ord").alias("source"),
        F.col("a").alias("b_title"), F.when(odd, F.col("b")).otherwise(F.col("a")).alias("f_title"),
        F.array(F.lit("ann lee"), F.lit("bo chen")).alias("b_authors"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a lee"), F.lit("b chen"))).otherwise(F.array(F.lit("cy dow"))).alias("f_authors"),
        F.lit("2020").alias("b_year"), F.when(F.col("p_size") % 5 == 0, "2020").otherwise("2019").alias("f_year"),
    )
    return p, verify.compare(pairs)


_COMPARED = f"""p AS (SELECT q.*, p_size FROM ({_PAIR}) q JOIN part USING (p_partkey)), s AS (SELECT p_partkey AS entry_id, k AS step_ord, p_size, a, CASE WHEN k % 2 = 1 THEN b ELSE a END AS f FROM p, (VALUES (0), (1), (2), (3)) AS v(k) WHERE p_partkey % (k + 2) = 0),
u AS (SELECT *, list_distinct(list_filter(string_split(a, ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(f, ' '), lambda x: x <> '')) AS y FROM s),
j AS (SELECT *, CASE WHEN length(a) < 100 THEN greatest(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 1 - levenshtein(a, f) / greatest(length(a), length(f))::DOUBLE) ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END AS t, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END AS au FROM u),
c AS (SELECT entry_id, step_ord, 's' || step_ord AS source, t, au, t >= 0.8 AND au >= 0.6 AS is_match, 0.5 * t + 0.3 * au + 0.2 * CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE 0.5 END AS confidence FROM j)"""


@query(f"""WITH {_COMPARED} SELECT entry_id, source, round(t, 9) AS title_similarity, round(au::DOUBLE, 9) AS author_similarity, is_match, round(confidence, 9) AS confidence FROM c""")
def metadata_comparison(spark, d):
    _, c = _compared(spark, d)
    return c.select("entry_id", "source", F.round("title_similarity", 9).alias("title_similarity"), F.round("author_similarity", 9).alias("author_similarity"), "is_match", F.round("confidence", 9).alias("confidence"))


@query(f"""WITH {_COMPARED}, r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY is_match DESC, CASE WHEN is_match THEN step_ord END, confidence DESC, step_ord) AS k FROM c)
SELECT p_partkey AS entry_id, coalesce(source, 'unable') AS source, coalesce(is_match, false) AS is_match, coalesce(round(confidence, 9), 0) AS confidence FROM part LEFT JOIN r ON entry_id = p_partkey AND k = 1""")
def lookup_cascade(spark, d):
    p, c = _compared(spark, d)
    best = verify.cascade(p.select(F.col("p_partkey").alias("entry_id")), c)
    return best.select("entry_id", "source", "is_match", F.round("confidence", 9).alias("confidence"))


def _entries(spark, d):
    """Parts as entries: titles of their name and type among words that all have, authors of their brand."""
    title = F.concat(F.lit("{A} Study of "), "p_name", F.lit("s: \\textbf{Parts} in "), "p_type", F.lit(" Supply"))
    author = F.concat(F.lit("Lee, "), "p_brand", F.lit("  and M{\\\"u}ller, J{\\'e}r{\\^o}me "), "p_brand")
    columns = [F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("key")]
    raw = table(spark, d, "part").select(*columns, title.alias("raw_title"), author.alias("raw_authors"))
    return duplicates.normalized(raw, T.for_comparison(F.col("raw_title")), T.duplicate_authors(F.col("raw_authors")))


#: Classes of equal titles and brands, and all pairs of them: names of a brand hold those of a brand that it begins with.
_CLASSES = """p AS (SELECT p_partkey AS n, 'a study of ' || lower(p_name) || 's parts in ' || lower(p_type) || ' supply' AS title, p_brand AS brand FROM part),
k AS (SELECT min(n) AS c, max(n) AS last, count(*) AS n, title, brand, list_distinct(string_split(title, ' ')) AS w FROM p GROUP BY title, brand),
x AS (SELECT a.c AS i, b.c AS j, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE AS t, CASE WHEN a.brand = b.brand THEN 1.0 WHEN starts_with(a.brand, b.brand) OR starts_with(b.brand, a.brand) THEN 0.5 ELSE 0.0 END::DOUBLE AS au, b.c < a.last AS turn
FROM k a JOIN k b ON a.c < b.c OR a.c = b.c AND a.n > 1),
l AS (SELECT i, j, t, turn AND i < j AS turn, CASE WHEN t >= 0.85 THEN t ELSE 0.7 * t + 0.3 * au END AS score FROM x),
e AS (SELECT * FROM l WHERE score >= 0.8)"""


@query(f"WITH {_CLASSES} SELECT i, j, round(score, 9) AS score, CASE WHEN turn THEN round(score, 9) END AS back, round(t, 9) AS title_score FROM e")
def duplicate_pairs(spark, d):
    """All similar classes, each by its least entry."""
    links, _ = duplicates.similar_classes(_entries(spark, d))
    return links.select("i", "j", *[F.round(c, 9).alias(c) for c in ("score", "back", "title_score")])


@query(f"WITH {_CLASSES} SELECT p.n AS ord, c AS cls FROM p JOIN k USING (title, brand)")
def duplicate_classes(spark, d):
    """The class of every entry."""
    return duplicates.classes(_entries(spark, d))[0].select("ord", "cls")


#: Groups by a scan in order: the first class left takes those left that are similar to it.
_GROUPS = f"""WITH RECURSIVE {_CLASSES}, near AS (SELECT c, list(o) AS o FROM (SELECT i AS c, j AS o FROM e UNION SELECT j, i FROM e) GROUP BY c),
scan AS (SELECT NULL::BIGINT AS c, NULL::BIGINT[] AS took, (SELECT list(c ORDER BY c) FROM near) AS left_
UNION ALL SELECT s.left_[1], list_intersect(s.left_, near.o), list_filter(s.left_[2:], lambda v: NOT list_contains(near.o, v)) FROM scan s JOIN near ON near.c = s.left_[1]),
m AS (SELECT DISTINCT scan.c AS anchor, k.c AS cls, k.n FROM scan JOIN k ON list_contains(took, k.c) OR k.c = scan.c),
g AS (SELECT anchor FROM m GROUP BY anchor HAVING sum(n) > 1)"""


@query(f"""{_GROUPS} SELECT a.anchor, (SELECT sum(n) FROM m WHERE m.anchor = a.anchor)::BIGINT AS size, round(sum(score * z) / sum(z), 9) AS score,
CASE WHEN sum(t * z) / sum(z) >= 0.95 THEN 'Nearly identical titles' WHEN sum(t * z) / sum(z) >= 0.85 THEN 'Very similar titles' ELSE 'Similar titles and authors' END AS reason
FROM (SELECT a.anchor, l.score, l.t, CASE WHEN a.cls = b.cls THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END AS z FROM m a JOIN m b ON a.anchor = b.anchor AND a.cls <= b.cls JOIN l ON l.i = a.cls AND l.j = b.cls) a JOIN g USING (anchor) GROUP BY a.anchor""")
def duplicate_groups(spark, d):
    found, _ = duplicates.groups(_entries(spark, d))
    return found.withColumn("score", F.round("score", 9))


@query(f"{_GROUPS} SELECT anchor, p.n AS ord FROM m JOIN g USING (anchor) JOIN k ON k.c = cls JOIN p USING (title, brand)")
def duplicate_members(spark, d):
    """The members of every group, a row each."""
    return duplicates.group_members(_entries(spark, d)).select("anchor", "ord")


def _label_lines(spark, d):
    """Every order as a label and every line item as a reference."""
    file, line = (lambda k: (F.col(k) % 100).cast("string").alias("file_path")), (lambda k: F.col(k).cast("int").alias("line_number"))
    labels = table(spark, d, "orders").select(file("o_orderkey"), line("o_orderkey"), F.concat(F.lit("\\label{fig:"), "o_custkey", F.lit("}")).alias("line"))
    refs = table(spark, d, "lineitem").select(file("l_orderkey"), line("l_orderkey"), F.concat(F.lit("see \\ref{fig:"), "l_suppkey", F.lit("}")).alias("line"))
    return labels.unionByName(refs)


_LABELS = "SELECT (o_orderkey % 100)::VARCHAR AS file_path, 'fig:' || o_custkey AS key, max(o_orderkey)::INT AS line_number FROM orders GROUP BY 1, 2"
_REFS = "SELECT (l_orderkey % 100)::VARCHAR AS file_path, 'fig:' || l_suppkey AS key, min(l_orderkey)::INT AS line_number FROM lineitem GROUP BY 1, 2"


@query(f"SELECT a.* FROM ({_LABELS}) a ANTI JOIN ({_REFS}) b USING (file_path, key)")
def unreferenced_labels(spark, d):
    return rules.file_findings(_label_lines(spark, d), ["reference"]).filter("rule_id = 'R5'").select("file_path", F.regexp_extract("message", "'(.*)'", 1).alias("key"), "line_number")


@query(f"SELECT a.* FROM ({_REFS}) a ANTI JOIN ({_LABELS}) b USING (file_path, key)")
def undefined_references(spark, d):
    return rules.file_findings(_label_lines(spark, d), ["reference"]).filter("rule_id = 'R6'").select("file_path", F.regexp_extract("message", "'(.*)'", 1).alias("key"), "line_number")


@query("""SELECT l_orderkey::VARCHAR AS file_path, CASE WHEN l_linenumber BETWEEN 2 AND 4 THEN 2 ELSE l_linenumber END::INT AS group_line, count(*) AS n FROM lineitem GROUP BY ALL""")
def findings_by_block(spark, d):
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("file_path"), F.col("l_linenumber").cast("int").alias("line_number"), F.lit(False).alias("passed"), F.lit("info").alias("severity"), F.lit("m").alias("message"), F.lit("c").alias("line_content"))
    blocks = found.select("file_path").distinct().select("file_path", F.lit(0).alias("block_ord"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"), F.lit("figure").alias("block_type"))
    return R.grouped_findings(found, blocks).select("file_path", "group_line", F.size("issues").cast("long").alias("n"))


@query("""WITH w AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(regexp_replace(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' Softmax' ELSE '' END || ' softmax', '%[^\\n]*', '', 'g'), '(?i)\\b' || term || '\\b'))) AS f
FROM documents, (VALUES ('transformer'), ('attention'), ('bert'), ('gpt'), ('lstm'), ('cnn'), ('rnn'), ('encoder'), ('decoder'), ('embedding'), ('softmax'), ('sigmoid'), ('relu')) AS v(term))
SELECT 'doc' || doc_id || '.tex' AS file_path, 'Inconsistent capitalization: ' || array_to_string(list_transform(f, lambda x: chr(39) || x || chr(39)), ', ') AS message FROM w WHERE len(f) > 1""")
def capitalization_forms(spark, d):
    """All terms in whole texts, a third of which write one of them in two ways."""
    tail = F.concat(F.when(F.col("doc_id") % 3 == 0, " Softmax").otherwise(""), F.lit(" softmax"))
    docs = table(spark, d, "documents").select(F.format_string("doc%d.tex", "doc_id").alias("file_path"), F.concat(F.coalesce("text", F.lit("")), tail).alias("content"))
    return rules.document_findings(docs, ["consistency"]).filter("rule_id = 'R23'").select("file_path", "message")


@query("SELECT p_partkey, p_name AS title, ['Ann ' || p_brand, 'Lee'] AS authors, CASE WHEN p_size % 2 = 0 THEN (1990 + p_size % 30)::VARCHAR ELSE '2001' END AS year, '10.1/' || p_partkey AS doi FROM part")
def crossref_parsing(spark, d):
    online = F.when(F.col("p_size") % 2 == 0, F.format_string('"published-online": {"date-parts": [[%d, 1]]}', 1990 + F.col("p_size") % 30)).otherwise('"created": {"date-parts": [[2001]]}')
    body = F.format_string('{"status": "ok", "message": {"items": [{"title": [], "DOI": "none"}, {"title": ["%s"], "author": [{"given": "Ann", "family": "%s"}, {"family": "Lee"}, {"given": "Solo"}], "DOI": "10.1/%d", %s}]}}', "p_name", "p_brand", "p_partkey", online)
    return table(spark, d, "part").select("p_partkey", S.crossref_items(body)[0].alias("r")).select("p_partkey", "r.title", "r.authors", "r.year", "r.doi")


@query("SELECT p_partkey, 'k' || p_partkey AS key, 'article' AS entry_type, p_name AS title, 'Lee, Ann and Chen, Bo' AS author, (1990 + p_size % 30)::VARCHAR AS year, 'March' AS month, '2301.0' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS arxiv_id FROM part")
def bibtex_parsing(spark, d):
    month = F.lit("mar")
    body = F.format_string('@string{v = "Venue"}\n@Article{k%d,\n  title = {%s},\n  author = "Lee, Ann and Chen, Bo",\n  year = %d, month = %s, journal = v # { Letters},\n  eprint = {2301.0%s}\n}\n@comment{x}\n', "p_partkey", "p_name", 1990 + F.col("p_size") % 30, month, F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"))
    files = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file_path"), body.alias("content"))
    return S.bib_entries(files).select(F.col("file_path").cast("long").alias("p_partkey"), "key", "entry_type", "title", "author", "year", F.element_at("raw_entry", "month").alias("month"), "arxiv_id")


@query("""SELECT p_partkey, 'ann ' || lower(p_brand_) AS first, 'bo chen' AS second FROM (SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9_ ]', '', 'g') AS p_brand_ FROM part)""")
def author_lists(spark, d):
    names = T.author_list(F.concat(F.col("p_brand"), F.lit(", {Ann}  AND Bo \\textbf{Chen}")))
    return table(spark, d, "part").select("p_partkey", F.element_at(names, 1).alias("first"), F.element_at(names, 2).alias("second"))


@query("""WITH c AS (SELECT l_suppkey AS key, l_orderkey, l_linenumber, repeat('x', 100 + (l_partkey % 150)::INT) AS t FROM lineitem),
s AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY key ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
f AS (SELECT *, coalesce(bool_and(length(t) <= 1000 - before) OVER (PARTITION BY key ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS open FROM s)
SELECT key, string_agg(CASE WHEN length(t) <= 1000 - before THEN t ELSE left(t, (1000 - before)::INT) || '...' END, chr(10) || '---' || chr(10) ORDER BY l_orderkey, l_linenumber) AS combined
FROM f WHERE open AND (length(t) <= 1000 - before OR 1000 - before > 100) GROUP BY key""")
def combined_contexts(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("line_number"), F.repeat(F.lit("x"), (100 + F.col("l_partkey") % 150).cast("int")).alias("full_context"))
    return C.combined_context(c)


@query("""SELECT count(*) AS total, count(*) FILTER (p_size % 3 = 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0) AS verified, count(*) FILTER (p_size % 5 = 0 OR p_size % 7 = 0) AS with_issues,
count(*) FILTER (p_size % 2 = 0) AS used, count(*) FILTER (p_size % 2 <> 0) AS unused FROM part""")
def bibliography_totals(spark, d):
    return R.bibliography_summary(_reported(spark, d))


@query("""SELECT 'Title Mismatch' AS issue, count(*) AS n FROM part WHERE p_size % 5 = 0 UNION ALL SELECT 'Low Relevance', count(*) FROM part WHERE p_size % 7 = 0
UNION ALL SELECT 'Unused Entry', count(*) FROM part WHERE p_size % 2 <> 0 UNION ALL SELECT 'Duplicate Group', count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)
UNION ALL SELECT 'Missing Entry', count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT p_partkey FROM part)""")
def issue_totals(spark, d):
    same_name = table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1")
    return R.issue_counts(_reported(spark, d), same_name, C.missing(bib(spark, d), cites(spark, d)))


def _reported(spark, d):
    n = F.col("p_size")
    empty = F.array().cast("array<string>")
    return table(spark, d, "part").select(
        (n % 3 == 0).alias("is_match"), (n % 2 == 0).alias("is_used"),
        F.when(n % 5 == 0, F.array(F.lit("Title mismatch (similarity: 1.00%)"))).otherwise(empty).alias("issues"),
        F.when(n % 7 == 0, F.array(F.lit(2))).otherwise(F.array(F.lit(4))).alias("scores"),
    )


@query("""SELECT p_partkey AS entry_id, CASE WHEN p_partkey % 7 = 0 THEN 'arxiv' WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN 'crossref' WHEN p_partkey % 5 = 0 THEN 'dblp' WHEN p_partkey % 3 = 0 THEN 'crossref' ELSE 'no match' END AS source FROM part""")
def catalogue_lookup(spark, d):
    """Parts are entries, some with an arXiv id or a DOI; one catalogue knows every third part, others every
    fifth by another spelling, and every seventh by its id."""
    p, key = table(spark, d, "part"), F.col("p_partkey")
    doi, arxiv = F.concat(F.lit("10.1/"), key), F.format_string("2301.%05d", key)
    title = F.concat("p_name", F.lit(" "), F.md5(key.cast("string")))
    entries = p.select(key.alias("entry_id"), title.alias("title"), F.lit("Lee, Ann and M{\\\"u}ller, Bo").alias("author"), F.lit("2020").alias("year"), F.when(F.col("p_size") % 2 == 0, doi).otherwise("").alias("doi"), F.when(key % 7 == 0, arxiv).otherwise("").alias("arxiv_id"))
    hit = [key.alias("rank"), F.array(F.lit("Ann Lee"), F.lit("Bo Müller")).alias("authors"), F.lit("2020").alias("year"), F.lit("").alias("abstract")]
    none = F.lit("")
    crossref = p.filter("p_partkey % 3 = 0").select(F.lit("crossref").alias("source"), title.alias("title"), F.concat(F.lit("https://doi.org/"), doi).alias("doi"), none.alias("arxiv_id"), *hit)
    dblp = p.filter("p_partkey % 5 = 0").select(F.lit("dblp").alias("source"), F.concat(F.lit("{"), F.upper(title), F.lit("}.")).alias("title"), none.alias("doi"), none.alias("arxiv_id"), *hit)
    by_id = p.filter("p_partkey % 7 = 0").select(F.lit("arxiv").alias("source"), title.alias("title"), none.alias("doi"), F.concat(arxiv, F.lit("v2")).alias("arxiv_id"), *hit)
    best = verify.cascade(entries, lookup.lookups(entries, crossref.unionByName(dblp).unionByName(by_id)))
    return best.select("entry_id", F.when(F.col("is_match"), F.col("source")).otherwise("no match").alias("source"))


#: Titles by source as (divisor of the parts it knows, pieces in front of and between their columns).
_KNOWN = {"crossref": (2, "The {p_name} by {p_brand}"), "dblp": (3, "{p_type} {p_name} of size {p_size} made by {p_brand}"), "arxiv": (5, "On {p_name}s: {p_type} supply")}
_ASKED = "{p_type} {p_name} made by {p_brand}, size {p_size}"


def _pieces(pattern: str) -> list[tuple[bool, str]]:
    """(is a column, text) of a title pattern."""
    return [(i % 2 == 1, x) for i, x in enumerate(re.split(r"\{(\w+)\}", pattern)) if x]


def _raw(pattern: str):
    return F.concat(*[F.col(x).cast("string") if column else F.lit(x) for column, x in _pieces(pattern)]).alias("raw")


def _said(rows: DataFrame, title: str) -> DataFrame:
    """``rows`` with the normalized ``title`` of raw ones, made once for all rows that have it."""
    return made_once(rows, "raw", T.for_comparison(F.col("raw")), title).drop("raw")


def _words_sql(pattern: str) -> str:
    whole = " || ".join(f"{x}::VARCHAR" if column else f"'{x}'" for column, x in _pieces(pattern))
    return f"list_distinct(list_filter(string_split(regexp_replace(lower({whole}), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> ''))"


@query(f"""WITH t AS ({" UNION ALL ".join(f"SELECT '{s}' AS source, p_partkey AS rank, {_words_sql(x)} AS y FROM part WHERE p_partkey % {k} = 0" for s, (k, x) in _KNOWN.items())}),
q AS (SELECT min(p_partkey) AS q, {_words_sql(_ASKED)} AS x FROM part GROUP BY x), u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY source, list_sort(y) ORDER BY rank) <= 3),
s AS (SELECT q, source, rank, len(list_intersect(x, y)) AS o, len(x) AS n, len(y) AS m FROM q, u), b AS (SELECT q, source, rank, o / (n + m - o)::DOUBLE AS similarity FROM s WHERE o > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY similarity DESC, rank) AS place FROM b WHERE similarity >= 0.25)
SELECT p.p_partkey AS question, r.source, r.rank, r.place::INT AS place, round(similarity, 9) AS similarity FROM r JOIN q USING (q) JOIN part p ON {_words_sql(_ASKED)} = q.x WHERE place <= 3""")
def title_search(spark, d):
    """The best three titles that each of three catalogues has for every part's."""
    p = table(spark, d, "part")
    theirs = None
    for source, (k, pattern) in _KNOWN.items():
        known = p.filter(F.col("p_partkey") % k == 0).select(F.lit(source).alias("source"), F.col("p_partkey").alias("rank"), _raw(pattern))
        theirs = known if theirs is None else theirs.unionByName(known)
    index = titles.title_index(_said(theirs, "_title").withColumn("id", F.xxhash64("source", "rank")))
    asked = _said(p.select("p_partkey", _raw(_ASKED)), "title").select("p_partkey", "title", F.explode(F.array(*map(F.lit, _KNOWN))).alias("source"))
    found = titles.search(asked.withColumn("question", F.struct("p_partkey", "source")), index, hits=3).filter(F.col("similarity") >= titles.BOUNDS[-1])
    return found.select(F.col("question.p_partkey").alias("question"), "question.source", "rank", "place", F.round("similarity", 9).alias("similarity"))


@query("""SELECT p_partkey, s AS source, CASE s WHEN 'dblp' THEN p_name ELSE p_name || '.' END AS title, CASE s WHEN 'dblp' THEN ['Ann Lee'] ELSE ['Ann Lee', 'Bo ' || p_brand] END AS authors, (1990 + p_size % 30)::VARCHAR AS year,
CASE s WHEN 'arxiv' THEN 'about ' || p_name WHEN 'openalex' THEN 'we see we ' || p_size WHEN 'semantic_scholar' THEN 'short' ELSE '' END AS abstract FROM part, (VALUES ('arxiv'), ('semantic_scholar'), ('dblp'), ('openalex')) AS v(s)""")
def provider_parsing(spark, d):
    p, year = table(spark, d, "part"), 1990 + F.col("p_size") % 30
    atom = F.format_string('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2301.00001v1</id><title>%s.</title><published>%d-01-02</published><summary> about\n %s</summary><author><name>Ann Lee</name></author><author><name> Bo %s </name></author></entry></feed>', "p_name", year, "p_name", "p_brand")
    s2 = F.format_string('{"data": [{"title": "%s.", "authors": [{"name": "Ann Lee"}, {"name": ""}, {"name": "Bo %s"}], "year": %d, "abstract": "short", "citationCount": 3}]}', "p_name", "p_brand", year)
    dblp = F.format_string('{"result": {"hits": {"hit": [{"info": {"title": "%s.", "year": "%d", "authors": {"author": {"text": "Ann Lee"}}}}]}}}', "p_name", year)
    alex = F.format_string('{"results": [{"title": "%s.", "publication_year": %d, "doi": "https://doi.org/10.1/x", "authorships": [{"author": {"display_name": "Ann Lee"}}, {"author": {"display_name": "Bo %s"}}], "abstract_inverted_index": {"we": [0, 2], "see": [1], "%d": [3]}}]}', "p_name", year, "p_brand", "p_size")
    out = None
    for source, records in (("arxiv", S.atom_entries(atom)), ("semantic_scholar", S.semantic_scholar_papers(s2)), ("dblp", S.dblp_hits(dblp)), ("openalex", S.openalex_works(alex))):
        r = p.select("p_partkey", F.lit(source).alias("source"), F.get(records, F.lit(0)).alias("r"))
        abstract = F.lit("") if source == "dblp" else F.col("r.abstract")
        rows = r.select("p_partkey", "source", "r.title", "r.authors", "r.year", abstract.alias("abstract"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT p_partkey, p_name AS title, 'A Lee, B Chen' AS authors, CASE WHEN p_size % 2 = 0 THEN (1990 + p_size % 30)::VARCHAR ELSE '' END AS year, CASE WHEN p_size % 3 = 0 THEN p_size ELSE 0 END::INT AS citation_count FROM part""")
def scholar_parsing(spark, d):
    n = F.col("p_size")
    byline = F.when(n % 2 == 0, F.format_string("A Lee, B Chen… - Journal, %d - site.org", 1990 + n % 30)).otherwise("A Lee, B Chen... - site.org")
    footer = F.when(n % 3 == 0, F.format_string("Save Cite Cited by %d Related", n)).otherwise("Save Cite")
    r = S.scholar_result(F.concat(F.lit("[PDF][B] "), "p_name"), byline, footer)
    return table(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.*")


@query("""SELECT p_partkey, CASE WHEN p_size > 10 THEN 'l1' || chr(10) || 'l2' || chr(10) || 'l3' || chr(10) || 'l4' || chr(10) || 'l5' || chr(10) || '  [...]' || chr(10) || 'l' || (p_size - 2) || chr(10) || 'l' || (p_size - 1) || chr(10) || 'l' || p_size
ELSE array_to_string(list_transform(range(1, p_size + 1), lambda x: 'l' || x), chr(10)) END AS shown FROM part""")
def long_blocks(spark, d):
    """Blocks of as many lines as a part's size, as the line report shows them."""
    lines = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda x: F.concat(F.lit("l"), x))
    body = F.concat(F.lit("\\begin{figure}"), F.array_join(lines, "\n"), F.lit("\\end{figure}"))
    docs = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file_path"), body.alias("content"))
    shown = F.regexp_replace("block_text", r"\\(begin|end)\{figure\}", "")
    return R.blocks(docs).select(F.col("file_path").cast("long").alias("p_partkey"), shown.alias("shown"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 0 ELSE p_size % 5 END AS relevance_score, p_size % 3 = 0 AS is_relevant, CASE WHEN p_size % 3 = 2 THEN '' ELSE p_name END AS explanation, p_size % 3 = 2 AS failed FROM part""")
def scorer_answers(spark, d):
    n = F.col("p_size") % 3
    body = F.when(n == 0, F.format_string('Sure: {"relevance_score": "%d", "is_relevant": "Yes", "explanation": "%s"} done', F.col("p_size") % 5, "p_name"))
    body = body.when(n == 1, F.format_string('{"relevance_score": %d, "is_relevant": false, "explanation": "%s"}', F.col("p_size") % 5, "p_name")).otherwise("I cannot say")
    v = table(spark, d, "part").select("p_partkey", S.llm_verdict(body).alias("v"))
    return v.select("p_partkey", "v.relevance_score", "v.is_relevant", "v.explanation", F.col("v.error").isNotNull().alias("failed"))


@query(r"""WITH p AS (SELECT *, p_partkey % 4 AS k FROM part) SELECT p_partkey, 'On ' || p_name || ' of some ' || p_type || 's' AS search_title, 'see ' || p_name || ' and ' || p_type AS clean_context, '10.1/' || p_partkey AS strip_doi,
'a \% ' || p_name || ' ' AS comment_parity, lower(p_type) || ' muller' AS author_name, 'Grosse Ore - ' || p_name AS normalize_unicode, 'the grosse of ' || lower(p_name) AS for_comparison,
CASE k WHEN 0 THEN 'Hedging/Vague Language' WHEN 1 THEN 'Redundant Phrasing' ELSE p_name || ' found' END AS rule_name, CASE k WHEN 0 THEN 'figure' WHEN 1 THEN 'table' ELSE 'label' END AS label_type,
CASE k WHEN 0 THEN 'hep-th/99' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') WHEN 1 THEN '2301.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') ELSE '' END AS arxiv_id, (p_size // 10)::VARCHAR || '.' || (p_size % 10) || '%' AS percent FROM p""")
def scalar_functions(spark, d):
    """Text functions over all parts, a column each."""
    k, five = F.col("p_partkey") % 4, F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0")
    said = lambda pattern, *columns: F.format_string(pattern, *columns)
    some_id = F.when(k == 0, F.concat(F.lit("see hep-th/99"), five)).when(k == 1, F.concat(F.lit("arXiv:2301."), five)).otherwise(F.col("p_name"))
    message = F.when(k == 0, F.concat(F.lit("Hedging language: "), "p_name")).when(k == 1, F.concat(F.lit("Redundant phrase: "), "p_name")).otherwise(F.concat("p_name", F.lit(" found (3 times): "), "p_type"))
    label = F.when(k == 0, "FIG:x").when(k == 1, "tab:y").when(k == 2, "other:z").otherwise(F.col("p_name"))
    return table(spark, d, "part").select(
        "p_partkey",
        T.search_title(said("On: %s--of (some) %ss!", "p_name", "p_type")).alias("search_title"),
        C.clean_context(said("see \\citep[p. 3]{%s}  and \\emph{%s}", "p_name", "p_type")).alias("clean_context"),
        T.strip_doi(said("https://doi.org/10.1/%d", "p_partkey")).alias("strip_doi"),
        T.comment_parity(said("a \\%% %s %% cut", "p_name")).alias("comment_parity"),
        T.author_name(said("M{\\\"u}ller, %s.", "p_type")).alias("author_name"),
        T.normalize_unicode(said("Größe Øre – %s", "p_name")).alias("normalize_unicode"),
        T.for_comparison(said("The \\textbf{Größe}  of {%s}!", "p_name")).alias("for_comparison"),
        T.rule_name(message).alias("rule_name"), T.label_type(label).alias("label_type"), T.arxiv_id(some_id).alias("arxiv_id"),
        T.percent(F.col("p_size") / 1000, 1).alias("percent"),
    )


@query("""SELECT p_partkey, ['ann ' || p_partkey, 'grosse bo'] AS duplicate_authors, ['ann ' || p_partkey, 'bo grosse'] AS authors FROM part""")
def author_fields(spark, d):
    """The same list read for comparison and for duplicates, where no name is turned around."""
    people = F.format_string("Ann  %d and Größe, Bo", "p_partkey")
    return table(spark, d, "part").select("p_partkey", T.duplicate_authors(people).alias("duplicate_authors"), T.author_list(people).alias("authors"))


@query("""SELECT r_name AS workflow, n_name AS step, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey % 3, n_nationkey) - 1)::INT AS place
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0""")
def workflow_steps(spark, d):
    """A workflow document for each region, whose steps are its nations, loaded again."""
    step = F.struct("n_nationkey", F.struct(F.col("n_name").alias("name"), (F.col("n_nationkey") % 4 != 0).alias("enabled"), (F.col("n_nationkey") % 3).alias("priority")).alias("s"))
    steps = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    documents = steps.select("r_name", F.to_json(F.struct(F.col("r_name").alias("name"), F.col("steps.s").alias("steps"))).alias("text"))
    loaded = F.udf(lambda text: [s["name"] for s in S.load_workflow(text)], "array<string>")
    return documents.select(F.col("r_name").alias("workflow"), F.posexplode(loaded("text")).alias("place", "step")).select("workflow", "step", "place")


@query("""SELECT n_name AS nation, CASE WHEN n_nationkey % 3 = 0 THEN 'acl' ELSE '' END AS template, 'base/' || n_name AS input_path, (10 - n_nationkey % 2 - (n_nationkey % 3 <> 0)::INT)::INT AS n_checkers,
CASE WHEN n_nationkey % 2 = 0 THEN ['dblp', 'openalex'] ELSE ['openalex'] END AS workflow, n_nationkey % 5 = 0 AS minimal, n_nationkey / 100.0::DOUBLE AS threshold FROM nation""")
def settings_documents(spark, d):
    """A settings document for each nation, loaded: what it turns off, its steps, and its folder below a base."""
    k = F.col("n_nationkey")
    said = F.format_string(
        "files: {input_dir: '%s'}\ntemplate: %s\nsubmission: {anonymization: false, caption: %s, number: %s}\nworkflow:\n- {name: dblp, enabled: %s}\n- {name: openalex}\noutput: {minimal_verified: %s}\nbibliography: {preprint_warning_threshold: %s}\n",
        "n_name", F.when(k % 3 == 0, "acl").otherwise("''"), *[F.when(x, "true").otherwise("false") for x in (k % 2 == 0, k % 3 == 0, k % 2 == 0, k % 5 == 0)], (k / 100).cast("string"),
    )

    @F.udf("template string, input_path string, n_checkers int, workflow array<string>, minimal boolean, threshold double")
    def loaded(text: str):
        import yaml

        s = settings_of(yaml.safe_load(text), "base")
        return s.template, s.path(s.input_dir), len(s.checkers), s.workflow, s.minimal_verified, s.preprint_warning_threshold

    return table(spark, d, "nation").select(F.col("n_name").alias("nation"), loaded(said).alias("s")).select("nation", "s.*")


@query("""SELECT p_partkey::VARCHAR AS file_path, '@string{v = "V"}' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '@article{k' || p_partkey || ', title = {' || p_name || '}}' || chr(10) ELSE '' END || '@comment{x}' || chr(10) AS content FROM part""")
def only_used_bibliographies(spark, d):
    body = F.format_string('@string{v = "V"}\n@article{k%d, title = {%s}}\n@comment{x}\n', "p_partkey", "p_name")
    files = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file_path"), body.alias("content"))
    cited = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("k"), "p_partkey").alias("key"))
    return R.only_used(files, S.bib_entries(files), cited)


_VENUES = """('acl','Natural Language Processing',8,9),('emnlp','Natural Language Processing',8,9),('naacl','Natural Language Processing',8,9),('cvpr','Computer Vision',8,8),
('iccv','Computer Vision',8,8),('eccv','Computer Vision',14,14),('neurips','Machine Learning',9,10),('icml','Machine Learning',8,9),('iclr','Machine Learning',10,10)"""


@query(f"""WITH v AS (SELECT *, row_number() OVER (ORDER BY venue) - 1 AS k FROM (VALUES {_VENUES}) AS v(venue, field, review, camera)), d AS (SELECT doc_id % 9 AS k, ceil(n_chars / 1000.0) AS pages FROM documents)
SELECT venue, field, count(*) AS n, count(*) FILTER (pages > review) AS too_long_to_review, count(*) FILTER (pages > camera) AS too_long FROM v JOIN d USING (k) GROUP BY venue, field""")
def venue_presets(spark, d):
    """Which documents, dealt to the venues in turn, keep to their page limits at 1,000 characters a page."""
    presets = venues(spark).withColumn("k", F.row_number().over(Window.orderBy("venue")) - 1)  # nine rows
    docs = table(spark, d, "documents").select((F.col("doc_id") % 9).alias("k"), F.ceil(F.col("n_chars") / 1000).alias("pages"))
    over = lambda limit: F.count_if(F.col("pages") > F.col(limit))
    return docs.join(F.broadcast(presets), "k").groupBy("venue", "field").agg(F.count("*").alias("n"), over("page_limit_review").alias("too_long_to_review"), over("page_limit_camera").alias("too_long"))


def flagship(spark, sf_dir: str) -> DataFrame:
    """Which entries are used, how often, and where first."""
    return usage_per_entry(spark, sf_dir)
