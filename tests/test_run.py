import json

import pytest
from pyspark.sql import functions as F

from paperloom import streaming
from paperloom.__main__ import main
from paperloom.operators import lookup, verify
from paperloom.plans import run
from paperloom.sources import settings as S

TEX = "\\documentclass{article}\nThere are many models \\cite{lee20, gone}.\nMore on them \\citep{chen21}. In order to see.\n\\begin{figure}\n\\includegraphics{a}\n\\end{figure}\n"
BIB = """@article{lee20, title = {Deep Models of Text}, author = {Lee, Ann and Chen, Bo}, year = 2020, eprint = {2001.00001}}
@article{chen21, title = {Sparse Attention for Long Text}, author = {Chen, Bo}, year = {2021}, doi = {10.1/x}}
@article{other, title = {Deep models of text}, author = {Ann Lee and Bo Chen}, year = {2020}}
@comment{kept}
"""
CATALOGUE = [
    ("arxiv", 1, "Deep Models of Text", ["Ann Lee", "Bo Chen"], "2020", None, "2001.00001v2", "We study models."),
    ("crossref", 1, "Another Paper", ["Cy Dow"], "1999", "https://doi.org/10.1/X", None, None),
    ("dblp", 2, "Sparse attention, for long text", ["Bo Chen"], "2022", None, None, "later"),
    ("dblp", 1, "Sparse Attention for Long Text", ["Bo Chen"], "2021", None, None, "Attention."),
    (None, None, None, None, None, None, None, None),
]
SCHEMA = "source string, rank int, title string, authors array<string>, year string, doi string, arxiv_id string, abstract string"


@pytest.fixture
def project(tmp_path):
    (tmp_path / "a.tex").write_text(TEX)
    (tmp_path / "refs.bib").write_text(BIB)
    (tmp_path / "config.yaml").write_text("files: {input_dir: ., output_dir: out}\ntemplate: acl\nbibliography: {check_relevance: true}\nsubmission: {number: false}\n")
    return tmp_path


def test_settings(project):
    s = S.load_settings(S.find_settings(str(project / "x" / "y")) if (project / "x" / "y").mkdir(parents=True) is None else "")
    assert s.template == "acl" and s.check_relevance and "number" not in s.checkers and len(s.checkers) == 10 and s.path("b") == str(project / "b")
    assert S.settings_of(None) == S.Settings() and S.settings_of({"workflow": [{"name": "dblp"}, {"name": "x", "enabled": False}]}).workflow == ["dblp"]
    with pytest.raises(ValueError):
        S.Settings(template="nowhere")
    assert main(["--init", str(project / "new.yaml")]) == 0 and S.load_settings(str(project / "new.yaml")).input_dir == "." and main(["--list-venues"]) == 0


def test_lookup_and_relevance(spark):
    entries = spark.createDataFrame(
        [(1, "Deep Models of Text", "Lee, Ann and Chen, Bo", "2020", "", "2001.00001", ""), (2, "Sparse Attention for Long Text", "Chen, Bo", "2021", "10.1/x", "", ""), (3, None, None, None, None, None, "own"), (4, "Unknown", "X", "", "", "", "")],
        "entry_id long, title string, author string, year string, doi string, arxiv_id string, abstract string",
    )
    catalogue = spark.createDataFrame(CATALOGUE, SCHEMA)
    found = lookup.lookups(entries, catalogue)
    got = {(r["entry_id"], r["step_ord"]): r for r in found.collect()}
    # The first entry is asked by its id alone; by title step 3 finds one for it that shares a word, which does not match.
    assert set(got) == {(1, 0), (2, 1), (2, 3)} and got[2, 3]["is_match"] and got[2, 3]["f_year"] == "2021" and not got[2, 1]["is_match"]
    titles = lookup.lookups(entries, catalogue, ["dblp"]).collect()
    assert {r["entry_id"]: r["is_match"] for r in titles} == {1: False, 2: True}
    _, asked = lookup.staged(entries, catalogue)
    # All steps whose source has records and whose key an entry has, until one matches.
    assert sorted((r["step"], r["entry_id"]) for r in asked.collect()) == [("arxiv_id", 1), ("arxiv_title", 4), ("crossref_doi", 2), ("crossref_title", 4), ("dblp", 2), ("dblp", 4)]
    best = {r["entry_id"]: (r["source"], r["is_match"]) for r in verify.cascade(entries, found).collect()}
    assert best == {1: ("arxiv", True), 2: ("dblp", True), 3: ("unable", False), 4: ("unable", False)}
    accents = spark.createDataFrame([(9, "Un modèle", "M{\\\"u}ller, J{\\'e}r{\\^o}me", "2020", "", "", "")], entries.schema)
    same = spark.createDataFrame([("dblp", 1, "Un modele", ["Jérôme Müller"], "2020", None, None, None)], SCHEMA)
    assert [(r["is_match"], r["author_similarity"]) for r in lookup.lookups(accents, same).collect()] == [(True, 1.0)]
    known = lookup.abstracts(entries, found)
    assert {r["entry_id"]: r["abstract"] for r in known.collect()} == {1: "We study models.", 2: "Attention.", 3: "own"}
    contexts = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "entry_id long, full_context string")

    def scorer(pairs):
        return [json.dumps({"relevance_score": 4, "is_relevant": True, "explanation": c + a}) if c == "a" else "no" for c, a in pairs]

    scored = {r["entry_id"]: (r["relevance_score"], r["score_label"], r["error"] is None) for r in lookup.relevance(contexts, known, scorer).collect()}
    assert scored == {1: (4, "Relevant", True), 2: (0, "Unknown", False)}


def test_full_run(spark, project):
    s = S.load_settings(str(project / "config.yaml"))
    result = run.audit(spark, s, spark.createDataFrame(CATALOGUE, SCHEMA), lambda pairs: ['{"relevance_score": 5, "is_relevant": true}'] * len(pairs))
    for _ in range(2):  # what the first run wrote is not read by the second
        names = run.write(result, s, "now")
    out = project / "out"
    assert {"bibliography_report.md", "latex_quality_report.md", "line_by_line_report.md", "refs_only_used.bib"} == set(names)
    clean = (out / "refs_only_used.bib").read_text()
    assert "lee20" in clean and "chen21" in clean and "other" not in clean and "@comment" in clean
    report = (out / "bibliography_report.md").read_text()
    assert "| total | 3 |" in report and "| missing | 1 |" in report and "`gone`" in report and "lee20, other" in report and "1 of 2 used" in report and "relevance 5/5" in report
    lines = (out / "line_by_line_report.md").read_text()
    assert "### Line 2" in lines and "### Lines 4-6 (figure)" in lines and "ACL 2025" in (out / "latex_quality_report.md").read_text()
    assert result.tex.count() == 1 and (out / "a.tex").read_text() == TEX
    quality = (out / "latex_quality_report.md").read_text()
    assert "## Critical Errors" not in quality and "## Warnings" in quality and "<details>" in quality and "Add \\caption{} after" in quality
    assert "## Unused Entries" in report and "`other`" in report and "N/A" not in report
    assert "\\begin{figure}" in lines


def test_copies_are_bytes_and_folders_stay(spark, tmp_path):
    raw = b"@article{a, title = {T}}\r\n@article{b, title = {\xff}}\r\n"
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "refs.bib").write_bytes(raw)
        (tmp_path / folder / "main.tex").write_bytes(b"text \\cite{a}\r\n")
    s = S.settings_of({"files": {"input_dir": str(tmp_path), "output_dir": str(tmp_path / "out")}})
    names = run.write(run.audit(spark, s), s, "now")
    for folder in ("x", "y"):
        assert (tmp_path / "out" / folder / "refs.bib").read_bytes() == raw
        assert (tmp_path / "out" / folder / "main.tex").read_bytes() == b"text \\cite{a}\r\n"
        clean = (tmp_path / "out" / folder / "refs_only_used.bib").read_bytes()
        assert clean.startswith(b"@article{a, title = {T}}\r\n") and b"@article{b" not in clean
    assert "merged_only_used.bib" in names
    empty = S.settings_of({"files": {"input_dir": str(tmp_path / "out" / "nothing"), "output_dir": str(tmp_path / "o")}})
    (tmp_path / "out" / "nothing").mkdir()
    with pytest.raises(FileNotFoundError):
        run.audit(spark, empty)


def test_workflow_round_trip(tmp_path):
    from paperloom import sources

    sources.save_workflow([{"name": "dblp"}, {"name": "openalex", "enabled": False}, {"name": "arxiv_id"}], str(tmp_path / "w" / "w.json"))
    assert [(s["name"], s["priority"]) for s in sources.load_workflow((tmp_path / "w" / "w.json").read_text())] == [("dblp", 0), ("arxiv_id", 2)]


def test_prompt():
    text = lookup.prompt("some {context}", "an abstract")
    assert "some {context}" in text and "an abstract" in text and '"relevance_score": <1-5 integer>' in text and "{{" not in text


def test_streams(spark, project):
    docs = streaming.watch(spark, str(project))
    q = streaming.usage_so_far(docs).writeStream.format("memory").queryName("used").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["key"]: r["usage_count"] for r in spark.table("used").collect()} == {"lee20": 1, "gone": 1, "chen21": 1}
    q = streaming.into_table(docs, str(project / "found"), str(project / "at")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(project / "found")).filter(F.col("rule_id") == "R3").count() == 1
    table = spark.createDataFrame([("a.tex", TEX)], "file_path string, content string")
    assert {r["rule_id"] for r in streaming.line_findings(table, ["sentence"]).collect()} == {"R18", "R20"}
    assert {r["rule_id"] for r in streaming.line_findings(table).collect()} == {"R8", "R18", "R20"}
