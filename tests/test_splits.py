"""Files read in splits against the same files read whole."""

import random

import pytest

from paperloom import sources as S
from paperloom.sources import splits

PARTS = [
    '@article{{k{i},\n  title = {{Some {{Nested}} title {i}}},\n  author = "Lee, Ann and Chen, Bo",\n  journal = v{j},\n  year = {i}, month = mar\n}}\n',
    '@string{{v{j} = "Venue {i}" # {{ of Parts}}}}\n',
    "@comment{{ @article{{inner{i}, title = {{x}}}} }}\n",
    "text between @ entries {{ and }} a stray \" mark {i}\n",
    "@misc{{esc{i}, note = {{a \\{{ brace, a \\\" mark}}, title = {{T {i}\n over lines {{deep {{er}}}}}}}}\n",
    "@book{{nocomma{i}}}\n",
    "@inproceedings{{long{i}, abstract = {{{long}}}, title = {{L}}}}\n",
]


def made(rng, n, odd):
    out = []
    for i in range(n):
        part = PARTS[rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6])]
        out.append(part.format(i=i, j=i % 4, long="\n".join(f"line {k} of {{text}}" for k in range(rng.choice([2, 60])))))
        if odd and i == n // 2:
            out.append('@misc{odd, title = {a " quote},\n')  # its quote takes what follows in
    return "".join(out)


def rows(df):
    names = ["file_path", "entry_ord", "key", "entry_type", "title", "author", "year", "journal", "arxiv_id"]
    return sorted((tuple(r[n] for n in names), sorted(r["raw_entry"].items())) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_bibliographies(spark, tmp_path, small_splits):
    rng = random.Random(11)
    for k in range(4):
        (tmp_path / f"f{k}.bib").write_text(made(rng, 80, odd=k == 3), encoding="utf-8")
    (tmp_path / "empty.bib").write_text("")
    (tmp_path / "windows.bib").write_bytes(made(rng, 30, False).replace("\n", "\r\n").encode())
    whole = rows(S.bib_entries(S.read_texts(spark, str(tmp_path), "*.bib")))
    got = rows(splits.split_bib_entries(spark, str(tmp_path)))
    normal = lambda found: [((r[0].replace("file:///", "file:/"), *r[1:]), raw) for r, raw in found]
    assert len(whole) > 150 and normal(got) == normal(whole)
    lines = splits.split_lines(spark, str(tmp_path / "f0.bib"))
    assert lines.select("split").distinct().count() > 3  # several tasks read one file


def test_a_block_over_many_splits(spark, tmp_path, small_splits):
    text = "@misc{a, title = {x}}\n@misc{big, note = {" + "\n".join("@fake{line %d}" % i for i in range(600)) + "}}\n@misc{b, title = {y}}\n"
    (tmp_path / "big.bib").write_text(text)
    got = splits.split_bib_entries(spark, str(tmp_path)).collect()
    assert [(r["entry_ord"], r["key"]) for r in sorted(got, key=lambda r: r["entry_ord"])] == [(0, "a"), (1, "big"), (2, "b")]
    assert {r["key"]: r["raw_entry"] for r in got}["big"] == S.parse_bib(text)[1][2]


def test_states_against_plain_scans():
    """The walk over any cut of a text finds where a scan of the whole is outside."""
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["@a{", "{", "}", '"', "\\", "x", "\n", "@b{k,}"]) for _ in range(60))
        text = text.replace("\\", "\\x") + "\n"
        cuts = sorted(rng.sample(range(1, len(text)), 4))
        cuts = [c for c in cuts if text[c - 1] != "\\"]
        pieces = [(a, text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        if any("@" in t[-2:] for _, t in pieces[:-1]):
            continue  # splits end with lines
        numbers = {}

        def scanned(a, piece, at=0):
            plain, quoted = splits._falls(piece, False), splits._falls(piece, True)
            reach = max([*plain[0], *quoted[0]], default=-1)
            found = list(splits._blocks(piece, at))
            last = found[-1] if found and found[-1][1] is None else None
            row = ("f", a, *plain, *quoted, [{"start": s, "end": len(piece) if e is None else e} for s, e, _, _ in found if s < reach], last is not None, last[2] if last else 0, last[3] if last else False)
            return dict(zip(splits._NAMES, row, strict=True))

        numbers = [scanned(a, p) for a, p in pieces]
        again = {}
        while True:
            begins, unsure = splits._walk(numbers, again)
            if not unsure:
                break
            for here, at in unsure.items():
                again[here] = {"at": at, "row": scanned(here[1], dict(pieces)[here[1]], at)}
        got = [a + s for a, p in pieces if begins["f", a] is not None for s, *_ in splits._blocks(p, begins["f", a])]
        assert got == [s for s, *_ in S.entry_ranges(text)], text


def test_lines(spark, tmp_path, small_splits):
    text = "\n".join(f"line {i} \\cite{{k{i}}}" for i in range(400))
    (tmp_path / "a.tex").write_text(text + "\n")
    (tmp_path / "b.tex").write_text("one\n\nthree\n")
    got = sorted((r["file_path"][-5:], r["line_number"], r["line"]) for r in splits.numbered_lines(spark, str(tmp_path)).collect())
    assert got == sorted([("a.tex", i + 1, x) for i, x in enumerate(text.split("\n"))] + [("b.tex", 1, "one"), ("b.tex", 2, ""), ("b.tex", 3, "three")])
