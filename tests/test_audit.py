import re

import pytest
from pyspark.sql import functions as F

from paperloom import sources as S
from paperloom.functions import text as T
from paperloom.operators import citations as C
from paperloom.operators import reports as R
from paperloom.operators import duplicates, rules, verify


def scalar(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "file_path string, content string")


def found(spark, names, *texts, **options):
    d = docs(spark, *texts)
    return sorted((r.file_path, r.rule_id, r.line_number) for r in rules.findings(d, names, as_of=2026, **options).collect())


def test_similarity(spark):
    assert scalar(spark, T.jaccard, "a b", "b c") == pytest.approx(1 / 3)
    assert scalar(spark, T.jaccard, "", "a") == 0.0
    assert scalar(spark, T.levenshtein_similarity, "", "") == 1.0
    assert scalar(spark, T.levenshtein_similarity, "abc", "abd") == pytest.approx(2 / 3)
    assert scalar(spark, T.levenshtein_similarity, "", "a") == 0.0


def test_names(spark):
    assert scalar(spark, T.author_name, "Doe, Jane") == "jane doe"
    assert scalar(spark, T.author_list, "Doe, Jane AND Roe, R.") == ["jane doe", "r roe"]
    assert scalar(spark, T.names_match, "jane doe", "j doe") is True
    assert scalar(spark, T.names_match, "jane doe", "") is False
    assert scalar(spark, lambda c: T.for_comparison(c), "The \\textbf{Größe} of {X}") == "the grosse of x"


def test_arxiv_ids(spark):
    files = docs(spark, "@misc{a, eprint={2301.00001v1}}\n@misc{b, note={hep-th/9901001}}\n@misc{c, url={https://arxiv.org/pdf/2301.00001.pdf}}\n@misc{d, title={x}}")
    assert [r.arxiv_id for r in S.bib_entries(files).orderBy("entry_ord").collect()] == ["2301.00001v1", "hep-th/9901001", "2301.00001", ""]


def test_bib_scanner():
    text = '@string{v = "V"}\n@comment{c}\n@a{k1, title={A {nested} \\{ b}, journal=v # " X"}\n@b{k2}\n@c{k3, year=2001}\n'
    assert [(k, t, f) for k, t, f in S.parse_bib(text)] == [("k1", "a", {"title": "A {nested} \\{ b", "journal": "V X"}), ("k3", "c", {"year": "2001"})]
    assert R.clean_bib(text, {"k1"}) == text.replace("@c{k3, year=2001}\n", "")


CITES = ["see \\citep[see][p.3]{a, b}", "\\Citet{c} and \\cite*{d}", "\\parencite{e} \\nocite{f}", "text % \\cite{g}", "text \\% \\cite{g}", "\\cite{h,", "\\cite{,j}"]


def test_citations(spark):
    rows = C.extract(S.lines_of(docs(spark, "\n".join(CITES)))).orderBy("line_number", "match_ord", "key_ord").collect()
    assert [(r.line_number, r.key) for r in rows] == [(1, "a"), (1, "b"), (2, "c"), (2, "d"), (5, "g"), (7, "j")]


def test_usage(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    c = spark.createDataFrame([("a", 3), ("a", 9), ("z", 4)], "key string, line_number int")
    assert {r.key: (r.is_used, r.usage_count, r.first_usage_line) for r in C.usage(e, c).collect()} == {"a": (True, 2, 3), "b": (False, 0, None), "c": (False, 0, None)}
    assert [r.key for r in C.missing(e, c).collect()] == ["z"]
    assert sorted(r.key for r in C.unused(e, c).collect()) == ["b", "c"]


def test_cascade(spark):
    rows = [("m", 2, "s2", True, 0.85), ("m", 3, "s3", True, 0.99), ("n", 2, "s2", False, 0.5), ("n", 4, "s4", False, 0.7), ("t", 1, "s1", False, 0.5), ("t", 2, "s2", False, 0.5)]
    c = spark.createDataFrame(rows, "entry_id string, step_ord int, source string, is_match boolean, confidence double").withColumn("issues", F.array().cast("array<string>"))
    out = verify.cascade(spark.createDataFrame([(x,) for x in "mntu"], "entry_id string"), c)
    assert {r.entry_id: r.source for r in out.collect()} == {"m": "s2", "n": "s4", "t": "s1", "u": "unable"}


def test_duplicate_groups_against_plain_scan(spark):
    import random

    rng, words = random.Random(3), [f"w{i}" for i in range(14)]
    rows = []
    for i in range(60):
        title = rng.sample(words, rng.randint(3, 7)) if i % 3 or not rows else [*rows[-1][1].split()[:-1], rng.choice(words)]
        authors = [rng.choice(["a", "b", "c", "ab"]) for _ in range(rng.randint(0, 3))]
        rows.append((i, " ".join(dict.fromkeys(title)), authors, f"k{rng.randint(0, 50)}"))

    def jac(a, b):
        a, b = set(a.split()), set(b.split())
        return len(a & b) / len(a | b) if a and b else 0.0

    def score(x, y):
        t = jac(x[1], y[1])
        if t >= 0.85:
            return t
        near = lambda p, q: p == q or p in q or q in p or jac(p, q) >= 0.8
        a = sum(any(near(p, q) for q in y[2]) for p in x[2]) / len(set(x[2]) | set(y[2])) if x[2] and y[2] else 0.0
        return 0.7 * t + 0.3 * a

    want, taken = [], set()
    for i, x in enumerate(rows):
        if x[3] in taken:
            continue
        group = [i]
        for y in rows[i + 1 :]:
            if y[3] not in taken and score(x, y) >= 0.8:
                group.append(y[0])
                taken.add(y[3])
        if len(group) > 1:
            taken.add(x[3])
            want.append(group)
    e = spark.createDataFrame(rows, "ord long, title string, authors array<string>, key string")
    assert sorted(r.members for r in duplicates.duplicate_groups(e).collect()) == sorted(want)


RULES = [
    (["caption"], "\\begin{table}x\\end{table}\n\\begin{figure}\\caption{c}\\includegraphics{x}\\end{figure}", {"R1", "R4"}),
    (["caption"], "% \\begin{table}x\\end{table}", set()),
    (["reference"], "\\label{fig:x}\n\\ref{fig:y}\n\\appendix\n\\label{app:z}", {"R5", "R6", "R7"}),
    (["formatting"], "word \\cite{a}\n\\citep{a} \\citet{b}\n\n\n\n\nb & c", {"R8", "R9", "R10", "R11"}),
    (["formatting"], "$a & b$ \\begin{tabular}a & b\\end{tabular} AT&amp;T", set()),
    (["equation"], "\\begin{equation}a\\end{equation} where\n\\begin{equation}a.\\end{equation}\n$x$ and \\(y\\)", {"R12", "R13", "R14"}),
    (["ai_artifacts"], "As an AI language model\nTODO: fix\n**bold**", {"R15", "R16", "R17"}),
    (["ai_artifacts"], "\\begin{verbatim}\nTODO: x\n\\end{verbatim}\n% TODO: x", set()),
    (["sentence"], "There are many\nclearly\nin order to", {"R18", "R19", "R20"}),
    (["consistency"], "re-use and reuse, BERT and Bert, color and colour", {"R21", "R22", "R23"}),
    (["acronym"], "We use Foo Bar Baz here.\nThen FBB works", {"R24"}),
    (["acronym"], "FBB wins.\nFoo Bar Baz (FBB)", {"R25"}),
    (["acronym"], "We use Foo Bar Baz here.\nThen $a FBB$, \\ref{FBB}, [FBB], a/FBB, \\FBB, (FBB).", set()),
    (["acronym"], "Graph Pool Unit work.\nThe GPU works", set()),
    (["number"], "50 % x and 50\\% and 50 percent", set()),
    (["citation_quality"], "Smith (1990)\net al (\nas shown [1]\n(Smith et al., 2010)", {"R28", "R29", "R30", "R31"}),
    (["anonymization"], "camera-ready", {"R32"}),
    (["anonymization"], "% github.com/me\ngithub.com/me\n\\section{Acknowledgments}\nour previous work\n\\author{Jane Doe}", {"R33", "R34", "R35", "R36", "R37"}),
]


@pytest.mark.parametrize("names,text,want", RULES)
def test_rules(spark, names, text, want):
    assert {r for _, r, _ in found(spark, names, text)} == want


def test_every_finding_of_every_passage(spark):
    from paperloom.plans import manuscripts as M

    got = rules.findings(docs(spark, *(p for p, _ in M.PASSAGES)), as_of=2026).collect()
    want = [(f"d{k}", *f) for k, (_, found) in enumerate(M.PASSAGES) for f in found]
    key = lambda rows: sorted(map(repr, rows))
    assert key((r.file_path, r.checker_name, r.rule_id, r.severity, r.line_number, r.message, r.line_content, r.suggestion) for r in got) == key(want)
    assert {r.rule_id for r in got if r.passed} == {"R32"}
    assert {f"R{i}" for i in range(1, 38)} - {r.rule_id for r in got} == {"R26", "R27"}
    with pytest.raises(ValueError):
        rules.findings(docs(spark, "x"), ["nothing"])


def test_needles():
    known = {r"\bin order to\b": ["in order to"], r"a(b|cd)?e+f": ["a"], r"(?:foo|ba[rz])\s+x": ["ba", "foo"], r"[abc]*": [], r"(x|)y?": [], r"(?<!\*)\*\*(?!q)": ["**"], r"ab{0,2}c{2}dd": ["dd"], r"\x41bc|\[d\]": ["[d]", "bc"], r"(?i:ab|c)d": ["ab", "c"]}
    assert {p: sorted(rules.needles(p)) for p in known} == {p: sorted(w) for p, w in known.items()}


@pytest.mark.parametrize("text", ["a\n\\begin{verbatim}\nb\n\\end{verbatim}\nc", "\\begin{minted}\nx\n\\begin{raw} \\end{raw}\ny\n\\end{minted}\n\\end{raw}\nz", "\\begin{comment}\na\nb", "", "a\n\nb\n"])
def test_verbatim_blocks_against_a_plain_scan(spark, text):
    names, inside, want = "verbatim|lstlisting|minted|comment|raw|filecontents|tcolorbox", False, []
    for n, line in enumerate(text.split("\n"), 1):
        if re.search(rf"\\begin\{{({names})\*?\}}", line):
            inside = True
        elif re.search(rf"\\end\{{({names})\*?\}}", line):
            inside = False
        elif not inside:
            want.append(n)
    rows = rules.marked_lines(docs(spark, text)).collect()
    assert [r.line_number for r in rows if not r.quoted] == want and [r.line for r in rows] == text.split("\n")


def test_accents_and_duplicate_authors(spark):
    assert scalar(spark, T.author_list, "M{\\\"u}ller, J{\\'e}r{\\^o}me and Øster, Å.") == ["jerome muller", "a oster"]
    assert scalar(spark, lambda c: T.author_names(F.array(c, F.lit(""))), "Jérôme Müller") == ["jerome muller"]
    assert scalar(spark, T.duplicate_authors, "Lee,  Ann and  and Größe, Bo") == ["lee ann", "grosse bo"]
    assert scalar(spark, T.duplicate_authors, "") == []


def test_other_alphabets(spark):
    texts = {"Größe Øre – ﬁn…": "Grosse Ore - fin...", "Чайковский, Щука": "Chaikovskii, Shchuka", "Ένα θέμα ψυχής": "Ena thema psukhes", "Æsir Łódź": "AEsir Lodz", "中 x": " x"}
    assert {t: scalar(spark, T.normalize_unicode, t) for t in texts} == texts


def test_comment_classes(spark):
    assert scalar(spark, T.comment_lookbehind, "x \\\\% y") == "x \\\\% y"
    assert scalar(spark, T.comment_parity, "x \\\\% y") == "x \\\\"


def test_providers(spark):
    assert scalar(spark, lambda c: S.inverted_abstract(F.from_json(c, "map<string,array<int>>")), '{"b":[1],"a":[0,2]}') == "a b a"
    got = scalar(spark, S.llm_verdict, 'text {"relevance_score":"4","is_relevant":"yes","explanation":"x"}')
    assert (got.relevance_score, got.is_relevant, got.explanation, got.error) == (4, True, "x", None)
    got = scalar(spark, S.llm_verdict, "no json")
    assert (got.relevance_score, got.is_relevant) == (0, False) and got.error
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2301.00001v1</id><title>A\n  b</title><published>2023-01-01</published><author><name>X Y</name></author></entry></feed>'
    got = scalar(spark, S.atom_entries, feed)[0]
    assert (got.arxiv_id, got.title, got.authors, got.year) == ("2301.00001v1", "A b", ["X Y"], "2023")
    hit = '{"result":{"hits":{"hit":[{"info":{"title":"T.","year":"2020","authors":{"author":{"text":"A"}}}}]}}}'
    assert scalar(spark, S.dblp_hits, hit)[0].asDict() == {"title": "T", "authors": ["A"], "year": "2020", "doi": None}


def test_blocks(spark):
    text = "a\n\\begin{figure}\nb\n\\end{figure}\nc"
    assert R.block_ranges(text) == [(2, 4, "figure")]
    rows = [("d0", 3, False, "info", "m", "x"), ("d0", 5, False, "info", "m", "y"), ("d0", None, False, "info", "m", "z")]
    f = spark.createDataFrame(rows, "file_path string, line_number int, passed boolean, severity string, message string, line_content string")
    out = R.grouped_findings(f, R.blocks(docs(spark, text))).collect()
    assert sorted((r.group_line, r.block_type) for r in out) == [(2, "figure"), (5, None)]


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert not set(e.oracle_sql()) - set(e.queries())
    assert all(re.fullmatch(r"\w+", n) for n in e.queries())
