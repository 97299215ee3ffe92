"""Readers: manuscripts, bibliographies, provider responses and configuration."""

from __future__ import annotations

import json
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import arxiv_id, normalize_whitespace, some, strip

BIB_FIELDS = ["title", "author", "year", "abstract", "url", "doi", "journal", "booktitle", "publisher", "pages", "volume", "number"]


def read_bytes(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """(file_path, content) of all matching files, as bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return raw.select(F.col("path").alias("file_path"), "content")


def read_texts(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """(file_path, content) of all matching files, invalid UTF-8 replaced and line ends unified."""
    return read_bytes(spark, path, glob).withColumn("content", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(file_path, line_number, line), lines from 1."""
    return docs.select("file_path", F.posexplode(F.split("content", "\n", -1)).alias("at", "line")).select("file_path", (F.col("at") + 1).alias("line_number"), "line")


def closing_brace(text: str, at: int) -> int:
    """Where the brace that is open at ``at`` closes; without one, the last character."""
    depth = 1
    for m in re.compile("[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return max(at, len(text) - 1)


def entry_ranges(text: str) -> list[tuple[int, int, str, str | None]]:
    """(start, end, type, key) of each @ block: braces nest, a backslash skips a character, quotes toggle."""
    out, at = [], 0
    while (m := re.compile(r"@\s*(\w+)\s*\{").search(text, at)) is not None:
        depth, quoted, i = 1, False, m.end()
        while i < len(text) and depth:
            c = text[i]
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c == "{") - (c == "}")
            i += 1
        comma = text.find(",", m.end(), i)
        out.append((m.start(), i, m[1].lower(), text[m.end() : comma].strip() if comma >= 0 else None))
        at = max(i, m.end())
    return out


def _fields(body: str, strings: dict[str, str]) -> dict[str, str]:
    """Field values of an entry body: braced, quoted, bare, joined by #."""
    out, at, n = {}, 0, len(body)
    while (m := re.compile(r"([A-Za-z_][\w:-]*)\s*=\s*").search(body, at)) is not None:
        value, i = "", m.end()
        while i < n:
            c = body[i]
            if c in '{"':
                depth, j = 0, i
                while j < n:
                    if body[j] == "\\":
                        j += 2
                        continue
                    depth += (body[j] == "{") - (body[j] == "}")
                    if (c == "{" and depth == 0) or (c == '"' and depth == 0 and j > i and body[j] == '"'):
                        break
                    j += 1
                value, i = value + body[i + 1 : j], j + 1
            else:
                word = re.compile(r"[^\s,#]*").match(body, i)
                value, i = value + strings.get(word[0].lower(), word[0]), word.end()
            rest = re.compile(r"\s*#\s*").match(body, i)
            if not rest:
                break
            i = rest.end()
        out.setdefault(m[1].lower(), re.sub(r"\s*\n\s*", " ", value).strip())
        comma = body.find(",", i)
        at = comma + 1 if comma >= 0 else n
    return out


def months() -> dict[str, str]:
    """The macros that every bibliography may use."""
    return dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), "January February March April May June July August September October November December".split(), strict=True))


def parse_bib(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(key, entry type, fields) in order; @string macros are filled in, @comment and @preamble left out."""
    out, strings = [], months()
    for start, end, kind, key in entry_ranges(text):
        inner = text[text.index("{", start) + 1 : end - 1]
        if kind == "string":
            strings.update(_fields(inner, strings))
        elif kind not in ("comment", "preamble") and key:
            out.append((key, kind, _fields(inner[inner.index(",") + 1 :], strings)))
    return out


def bib_entries(files: DataFrame) -> DataFrame:
    """One row for each entry of (file_path, content): named fields (absent: empty), arXiv id and the raw map."""

    def parse(batches):
        for b in batches:
            rows = [(path, i, *e) for path, text in zip(b.column("file_path").to_pylist(), b.column("content").to_pylist(), strict=True) for i, e in enumerate(parse_bib(text or ""))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
            columns[4] = [list(d.items()) for d in columns[4]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["file_path", "entry_ord", "key", "entry_type", "raw_entry"])

    rows = files.select("file_path", "content").mapInArrow(parse, "file_path string, entry_ord int, key string, entry_type string, raw_entry map<string,string>")
    return with_fields(rows)


def with_fields(rows: DataFrame) -> DataFrame:
    raw = lambda f: F.coalesce(F.element_at("raw_entry", F.lit(f)), F.lit(""))
    found = F.coalesce(
        *[F.nullif(x, F.lit("")) for x in (arxiv_id(raw("eprint")), arxiv_id(raw("arxiv")), arxiv_id(raw("url"), P.ARXIV_URL, "(?i)"), F.when(F.lower(raw("journal")).contains("arxiv"), arxiv_id(raw("journal"))), arxiv_id(raw("note")))],
        F.lit(""),
    )
    return rows.select("file_path", "entry_ord", "key", "entry_type", *[raw(f).alias(f) for f in BIB_FIELDS], found.alias("arxiv_id"), "raw_entry")


# Provider responses: projections of JSON, XML and HTML onto title, authors, year, abstract.
_CROSSREF = "status string, message struct<items: array<struct<title: array<string>, author: array<struct<given: string, family: string>>, DOI: string, publisher: string, `container-title`: array<string>, abstract: string, URL: string, `published-print`: struct<`date-parts`: array<array<int>>>, `published-online`: struct<`date-parts`: array<array<int>>>, created: struct<`date-parts`: array<array<int>>>>>>"


def crossref_items(body: Column) -> Column:
    """Array of results; items without a title and authors without a family name are dropped."""
    items = F.from_json(body, _CROSSREF)["message"]["items"]

    def one(x: Column) -> Column:
        people = F.filter(F.coalesce(x["author"], F.array()), lambda a: some(a["family"]) != "")
        year = lambda k: F.get(F.get(x[k]["date-parts"], F.lit(0)), F.lit(0)).cast("string")
        return F.struct(
            F.get(x["title"], F.lit(0)).alias("title"),
            F.transform(people, lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))).alias("authors"),
            F.coalesce(year("published-print"), year("published-online"), year("created"), F.lit("")).alias("year"),
            some(x["DOI"]).alias("doi"),
            some(x["abstract"]).alias("abstract"),
        )

    return F.filter(F.transform(F.coalesce(items, F.array()), one), lambda r: some(r["title"]) != "")


def semantic_scholar_papers(body: Column) -> Column:
    data = F.from_json(body, "data array<struct<title: string, authors: array<struct<name: string>>, year: int, abstract: string, paperId: string, citationCount: int, url: string>>")["data"]
    names = lambda x: F.filter(F.transform(F.coalesce(x["authors"], F.array()), lambda a: a["name"]), lambda n: some(n) != "")
    return F.transform(F.coalesce(data, F.array()), lambda x: F.struct(some(x["title"]).alias("title"), names(x).alias("authors"), some(x["year"].cast("string")).alias("year"), x["abstract"].alias("abstract"), x["citationCount"].alias("citation_count")))


def dblp_hits(body: Column) -> Column:
    """Authors may be a list or one object; one trailing period of the title goes."""
    shape = "result struct<hits: struct<hit: array<struct<info: struct<title: string, year: string, venue: string, url: string, doi: string, authors: struct<author: {}>>>>>>"
    many = F.from_json(body, shape.format("array<struct<text: string>>"))["result"]["hits"]["hit"]
    one = F.from_json(body, shape.format("struct<text: string>"))["result"]["hits"]["hit"]

    def hit(x: Column, i: Column) -> Column:
        single = F.get(one, i)["info"]["authors"]["author"]["text"]
        names = F.coalesce(F.filter(x["info"]["authors"]["author"]["text"], lambda a: a.isNotNull()), F.array())
        names = F.when(F.size(names) > 0, names).when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.regexp_replace(some(x["info"]["title"]), r"\.$", "").alias("title"), names.alias("authors"), some(x["info"]["year"]).alias("year"), F.nullif(x["info"]["doi"], F.lit("")).alias("doi"))

    return F.transform(F.coalesce(many, F.array()), hit)


def inverted_abstract(index: Column) -> Column:
    """Text of a map from words to positions; a later word takes a position that two claim."""
    words = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " ")


def openalex_works(body: Column) -> Column:
    data = F.from_json(body, "results array<struct<title: string, publication_year: int, doi: string, cited_by_count: int, authorships: array<struct<author: struct<display_name: string>>>, abstract_inverted_index: map<string, array<int>>>>")["results"]
    return F.transform(
        F.coalesce(data, F.array()),
        lambda x: F.struct(
            some(x["title"]).alias("title"),
            F.filter(F.transform(F.coalesce(x["authorships"], F.array()), lambda a: a["author"]["display_name"]), lambda n: some(n) != "").alias("authors"),
            some(x["publication_year"].cast("string")).alias("year"),
            F.when(x["abstract_inverted_index"].isNotNull(), inverted_abstract(x["abstract_inverted_index"])).otherwise("").alias("abstract"),
            F.regexp_replace(some(x["doi"]), r"^https?://doi\.org/", "").alias("doi"),
        ),
    )


def atom_entries(body: Column) -> Column:
    """arXiv entries of an Atom feed as an array; malformed XML gives none."""
    plain = F.regexp_replace(body, r'\sxmlns(:\w+)?="[^"]*"|(?<=[</])\w+:', "")
    parts = F.regexp_extract_all(plain, F.lit(r"(?s)<entry>(.*?)</entry>"), 1)
    first = lambda x, tag: normalize_whitespace(F.regexp_extract(x, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return F.transform(
        parts,
        lambda x: F.struct(
            F.regexp_extract(first(x, "id"), r"/abs/(.*)$", 1).alias("arxiv_id"),
            first(x, "title").alias("title"),
            F.regexp_extract_all(x, F.lit(r"(?s)<name>\s*(.*?)\s*</name>"), 1).alias("authors"),
            first(x, "summary").alias("abstract"),
            F.regexp_extract(first(x, "published"), r"^(\d{4})", 1).alias("year"),
            F.regexp_extract_all(x, F.lit(r'<category[^>]*term="([^"]*)"'), 1).alias("categories"),
        ),
    )


def scholar_result(title: Column, byline: Column, footer: Column) -> Column:
    """Title without its kind in brackets, authors (one comma-separated string), year and citations of a result."""
    people = F.regexp_replace(F.split_part(byline, F.lit(" - "), F.lit(1)), "…|\\.\\.\\.", "")
    return F.struct(
        strip(F.regexp_replace(title, r"^\s*(?:\[[^\]]*\]\s*)+", "")).alias("title"),
        strip(people).alias("authors"),
        F.regexp_extract(byline, r"\b((?:19|20)\d{2})\b", 1).alias("year"),
        F.coalesce(F.nullif(F.regexp_extract(footer, r"Cited by (\d+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("citation_count"),
    )


def scholar_page(body: Column) -> Column:
    """The results of a result page as an array; a page without any gives none."""
    blocks = F.regexp_extract_all(some(body), F.lit(r'(?s)<div class="gs_ri">(.*?)(?=<div class="gs_ri">|\z)'), 1)
    words = lambda x: normalize_whitespace(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "&nbsp;|\u00a0", " "))
    part = lambda x, tag, name: words(F.regexp_extract(x, rf'(?s)<{tag}[^>]*class="{name}[^"]*"[^>]*>(.*?)</{tag}>', 1))
    return F.filter(F.transform(blocks, lambda x: scholar_result(part(x, "h3", "gs_rt"), part(x, "div", "gs_a"), part(x, "div", "gs_fl"))), lambda r: r["title"] != "")


def llm_verdict(body: Column) -> Column:
    """Score, relevance and error of a scorer's answer: its first flat object, else the whole text."""
    flat = F.regexp_extract(some(body), r"(?s)\{[^{}]*\}", 0)
    got = F.from_json(F.when(flat != "", flat).otherwise(body), "relevance_score string, is_relevant string, explanation string")
    ok = got.isNotNull() & F.coalesce(got["relevance_score"], got["is_relevant"], got["explanation"]).isNotNull()
    score = F.coalesce(F.expr("try_cast(1 as int)") * F.when(got["relevance_score"].rlike(r"^\s*-?\d+\s*$"), F.trim(got["relevance_score"]).cast("int")), F.lit(0))
    return F.struct(F.when(ok, score).otherwise(0).alias("relevance_score"), F.when(ok, F.lower(some(got["is_relevant"])).isin("true", "yes", "1")).otherwise(False).alias("is_relevant"), some(got["explanation"]).alias("explanation"), F.when(~ok, "unparsable response").alias("error"))


def load_workflow(text: str) -> list[dict]:
    """Steps of a workflow document, enabled ones by priority."""
    steps = [{"enabled": True, "priority": i} | s for i, s in enumerate(json.loads(text)["steps"])]
    return sorted((s for s in steps if s["enabled"]), key=lambda s: s["priority"])


def save_workflow(steps: list[dict], path: str, name: str = "custom", description: str = "") -> None:
    """Write a workflow document, the steps in their order."""
    place = Path(path)
    place.parent.mkdir(parents=True, exist_ok=True)
    rows = [{"enabled": True} | s | {"priority": i} for i, s in enumerate(steps)]
    place.write_text(json.dumps({"name": name, "description": description, "steps": rows}, indent=2), encoding="utf-8")
