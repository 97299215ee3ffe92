"""Lookups of the verification steps in catalogues or at services, abstracts, and relevance scores by a scorer of the caller's choice."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import author_list, author_names, for_comparison, jaccard, search_title, some, strip_doi
from ..sources import atom_entries, crossref_items, dblp_hits, llm_verdict, openalex_works, scholar_page, semantic_scholar_papers
from .answers import POLICIES, Answers, Policy, ask
from .shared import stored
from .titles import TitleIndex, search, title_index
from .verify import compare

# The source that each step asks and by what, the preferred key first.
STEPS = {
    "arxiv_id": ("arxiv", ["arxiv_id"]),
    "crossref_doi": ("crossref", ["doi"]),
    "semantic_scholar": ("semantic_scholar", ["doi", "title"]),
    "dblp": ("dblp", ["title"]),
    "openalex": ("openalex", ["doi", "title"]),
    "arxiv_title": ("arxiv", ["title"]),
    "crossref_title": ("crossref", ["title"]),
    "google_scholar": ("scholar", ["title"]),
}


def _keys() -> dict[str, Column]:
    """Key of each kind, empty where the column is: ids without prefix or version, titles normalized."""
    arxiv = F.regexp_replace(F.lower(some("arxiv_id")), r"^arxiv:|v\d+$", "")
    return {"arxiv_id": arxiv, "doi": F.lower(strip_doi(some("doi"))), "title": F.col("_title")}


def _normal(df: DataFrame, authors: Column) -> DataFrame:
    return df.withColumns({"_title": for_comparison(F.col("title")), "_authors": authors})


#: arXiv's title search counts only above this similarity; the other sources' first result counts.
LEAST_SIMILAR = 0.5


@dataclass
class Catalogue:
    """A catalogue made ready: its records (id, source, r), the first record of each identifier, and its titles."""

    records: DataFrame
    known: DataFrame
    titles: TitleIndex
    sources: set[str]

    def find(self, asked: DataFrame, step: str, source: str, kind: str) -> DataFrame:
        """``asked`` with the record ``r`` that the source has for the key of this kind; entries without one are left out."""
        if kind != "title":
            held = self.known.filter((F.col("source") == source) & (F.col("kind") == kind)).select("key", "r")
            return asked.join(held, F.col(f"keys.{kind}") == F.col("key")).drop("key")
        questions = asked.select(F.col("entry_id").alias("question"), F.lit(source).alias("source"), F.col("b_title").alias("title"))
        best = search(questions, self.titles)
        best = best.filter(F.col("similarity") > LEAST_SIMILAR) if step == "arxiv_title" else best
        return asked.join(best.select(F.col("question").alias("entry_id"), "id").join(self.records.select("id", "r"), "id").drop("id"), "entry_id")


#: Results of arXiv's title search that are compared.
FEED_HITS = 3


@dataclass
class Services:
    """The services themselves, asked by a transport through a table of answers (``operators.answers``).

    The transport gets (source, kind, payload): an identifier, or a title without its marks, and returns the
    service's own response. A step that a service does not answer finds nothing.
    """

    answers: Answers
    send: Callable[[str, str, str], tuple[int, str]]
    policies: dict[str, Policy] = field(default_factory=lambda: POLICIES)

    @property
    def sources(self) -> set[str]:
        return set(self.policies)

    def find(self, asked: DataFrame, step: str, source: str, kind: str) -> DataFrame:
        key = F.col(f"keys.{kind}")
        payload = F.col("searched") if kind == "title" else key
        requests = asked.select(F.lit(source).alias("source"), F.lit(kind).alias("kind"), key.alias("key"), payload.alias("payload"))
        got = ask(requests, self.answers, self.send, self.policies)
        records = got.select("key", F.posexplode(responses(source, kind, F.col("body"))).alias("place", "x"))
        hits = FEED_HITS if step == "arxiv_title" else 1
        authors = F.transform(F.split("x.authors", ","), F.trim) if source == "scholar" else F.col("x.authors")
        rows = records.filter(F.col("place") < hits).select("key", "place", F.col("x.title").alias("title"), authors.alias("authors"), F.col("x.year").alias("year"), F.col("x.abstract").alias("abstract"))
        r = F.struct(for_comparison(F.col("title")).alias("f_title"), author_names(F.col("authors")).alias("f_authors"), F.col("year").alias("f_year"), "abstract")
        met = asked.join(rows.select("key", "place", r.alias("r")), key == F.col("key")).withColumn("alike", jaccard(F.col("b_title"), F.col("r.f_title")) if hits > 1 else F.lit(1.0))
        best = met.filter(F.col("alike") > LEAST_SIMILAR).groupBy("entry_id").agg(F.max_by("r", F.struct("alike", -F.col("place"))).alias("r"))
        return asked.join(best, "entry_id")


def responses(source: str, kind: str, body: Column) -> Column:
    """The records of a service's response as an array of (title, authors, year, abstract). A response to an
    identifier is one record where one to a title is a list."""
    one = kind != "title"
    wrapped = lambda before, x, after: F.concat(F.lit(before), x, F.lit(after))
    parsed = {
        "arxiv": lambda: atom_entries(body),
        "crossref": lambda: crossref_items(wrapped('{"message": {"items": [', F.get_json_object(body, "$.message"), "]}}") if one else body),
        "semantic_scholar": lambda: semantic_scholar_papers(wrapped('{"data": [', body, "]}") if one else body),
        "dblp": lambda: dblp_hits(body),
        "openalex": lambda: openalex_works(wrapped('{"results": [', body, "]}") if one else body),
        "scholar": lambda: scholar_page(body),
    }[source]()
    abstract = (lambda x: F.lit("")) if source in ("dblp", "scholar") else (lambda x: some(x["abstract"]))
    return F.transform(parsed, lambda x: F.struct(x["title"].alias("title"), x["authors"].alias("authors"), x["year"].alias("year"), abstract(x).alias("abstract")))


def prepared(catalogue: DataFrame, sources: set[str] | None = None) -> Catalogue:
    """``catalogue``: source, rank (order of its hits), title, authors (array), year, doi, arxiv_id, abstract.

    Records are normalized once. ``sources`` are those that steps may ask (default: of all steps); a source
    without a record is left out, so that its steps ask nothing.
    """
    wanted = sources if sources is not None else {source for source, _ in STEPS.values()}
    theirs = _normal(catalogue.filter(F.col("source").isin(*wanted)), author_names(F.col("authors")))
    answer = F.struct(F.col("_title").alias("f_title"), F.col("_authors").alias("f_authors"), F.col("year").alias("f_year"), "abstract")
    theirs = theirs.select("source", "rank", "_title", answer.alias("r"), F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in _keys().items() if k != "title"]).alias("o"))
    # The authors of a scholar record without any are one empty name, which is not an empty list.
    nobody = (F.col("source") == "scholar") & (F.size("r.f_authors") == 0)
    theirs = theirs.withColumn("r", F.when(nobody, F.col("r").withField("f_authors", F.array(F.lit("")))).otherwise(F.col("r")))
    theirs = stored(theirs.withColumn("id", F.xxhash64("source", "rank", F.to_json("r"), F.to_json("o"))))
    identified = theirs.select("source", "rank", "r", F.explode("o").alias("o")).select("source", "rank", "r", "o.*").filter("key != ''")
    known = stored(identified.groupBy("source", "kind", "key").agg(F.min_by("r", F.struct("rank", F.to_json("r"))).alias("r")))
    records = theirs.filter("_title != ''").dropDuplicates(["id"])
    index = title_index(records.select("source", "id", "rank", "_title"))
    there = {row["source"] for row in theirs.select("source").distinct().collect()}  # of the steps' few sources
    return Catalogue(stored(records.select("id", "source", "r")), known, index, there)


def _asked(entries: DataFrame) -> DataFrame:
    """Entries made ready: entry_id, b_title and b_authors (normalized), b_year, keys by kind, the title to search for."""
    mine = _normal(entries, author_list(some("author")))
    keys = F.struct(*[c.alias(k) for k, c in _keys().items()]).alias("keys")
    return mine.select("entry_id", F.col("_title").alias("b_title"), F.col("_authors").alias("b_authors"), F.col("year").alias("b_year"), keys, search_title(some("title")).alias("searched"))


def answers(asked: DataFrame, catalogue: Catalogue | Services, step: str) -> DataFrame:
    """What a step finds for entries made ready: their columns, source and the record ``r``. By the first identifier
    that finds something, else by the best title."""
    source, kinds = STEPS[step]
    rest, found = asked, []
    for kind in kinds:
        got = catalogue.find(rest.filter(F.col(f"keys.{kind}") != ""), step, source, kind)
        if len(kinds) > 1:
            got = stored(got)
            rest = rest.join(got.select("entry_id"), "entry_id", "left_anti")
        found.append(got)
    return reduce(DataFrame.unionByName, found).withColumn("source", F.lit(source))


def staged(entries: DataFrame, catalogue: DataFrame | Catalogue | Services, steps: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The compared result of each step that finds something, for ``verify.cascade``, and what each step was asked
    (step_ord, step, entry_id).

    ``entries``: entry_id, title, author (joined by "and"), year, doi, arxiv_id. Steps are run one after
    another, each for those entries only that no step before has matched. Unknown steps are ignored.
    """
    wanted = [(i, s) for i, s in enumerate(steps or P.WORKFLOW) if s in STEPS]
    if not wanted:
        raise ValueError("no known step")
    ready = prepared(catalogue, {STEPS[s][0] for _, s in wanted}) if isinstance(catalogue, DataFrame) else catalogue
    left = stored(_asked(entries))
    compared, asked = [], []
    for i, step in wanted:
        source, kinds = STEPS[step]
        if source not in ready.sources:
            continue
        now = left.filter(F.col(f"keys.{kinds[-1]}") != "")  # steps that ask by title need one
        asked.append(now.select(F.lit(i).alias("step_ord"), F.lit(step).alias("step"), "entry_id"))
        found = answers(now, ready, step).select("entry_id", F.lit(i).alias("step_ord"), "source", "b_title", "b_authors", "b_year", "r.*")
        compared.append(stored(compare(found)))
        left = stored(left.join(compared[-1].filter("is_match").select("entry_id"), "entry_id", "left_anti"))
        if left.isEmpty():
            break
    if not compared:
        none = answers(left.limit(0), ready, wanted[0][1]).select("entry_id", F.lit(0).alias("step_ord"), "source", "b_title", "b_authors", "b_year", "r.*")
        compared, asked = [compare(none)], [left.limit(0).select(F.lit(0).alias("step_ord"), F.lit("").alias("step"), "entry_id")]
    return reduce(DataFrame.unionByName, compared), reduce(DataFrame.unionByName, asked)


def lookups(entries: DataFrame, catalogue: DataFrame | Catalogue | Services, steps: list[str] | None = None) -> DataFrame:
    """The compared results of ``staged``."""
    return staged(entries, catalogue, steps)[0]


def abstracts(entries: DataFrame, compared: DataFrame, catalogue: Catalogue | Services | None = None) -> DataFrame:
    """(entry_id, abstract): the bibliography's own, else that of the first step that found one, else what arXiv has
    by id or title, if a catalogue is given; entries without are left out."""
    has = compared.filter(some("abstract") != "").groupBy("entry_id").agg(F.min_by("abstract", "step_ord").alias("found"))
    own = F.nullif(some("abstract"), F.lit(""))
    known = entries.select("entry_id", own.alias("own")).join(has, "entry_id", "left").select("entry_id", F.coalesce("own", "found").alias("abstract"))
    if catalogue is not None and "arxiv" in catalogue.sources:
        known = stored(known)
        lacking = stored(_asked(entries).join(known.filter("abstract IS NULL"), "entry_id", "left_semi"))
        by = [answers(lacking, catalogue, s).filter(some("r.abstract") != "").select("entry_id", F.struct(F.lit(i).alias("o"), "r.abstract").alias("a")) for i, s in enumerate(("arxiv_id", "arxiv_title"))]
        more = by[0].unionByName(by[1]).groupBy("entry_id").agg(F.min("a.o").alias("o"), F.min_by("a.abstract", "a.o").alias("more"))
        known = known.join(more, "entry_id", "left").select("entry_id", F.coalesce("abstract", "more").alias("abstract"))
    return known.filter("abstract IS NOT NULL")


def prompt(context: str, abstract: str) -> str:
    """What a language model is asked about a citing context; its answer is read by ``sources.llm_verdict``."""
    return P.RELEVANCE_PROMPT.format(context=context, abstract=abstract)


def relevance(contexts: DataFrame, known: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[str]], kept: Answers | None = None, name: str = "scorer") -> DataFrame:
    """Score each citing context (entry_id, full_context, others) against its entry's abstract.

    ``scorer`` takes a batch of (context, abstract) and returns answers as text, one each; it runs on the
    executors. A batch that fails is asked again one by one. An answer that cannot be read, or a scorer that fails,
    gives score 0 and an error; so does an empty context or abstract, which is not asked. Equal questions
    are asked once; with ``kept``, answers of the scorer of this ``name`` are kept, and only failures asked again.
    """
    missing = (some("full_context") == "") | (some("abstract") == "")
    key = F.sha2(F.to_json(F.struct("full_context", "abstract")), 256)
    rows = stored(contexts.join(known, "entry_id").withColumn("_key", F.when(~missing, key)))
    new = rows.filter("_key IS NOT NULL").select(F.col("_key").alias("key"), "full_context", "abstract").dropDuplicates(["key"])
    if kept is not None:
        mine = (F.col("source") == "scorer") & (F.col("kind") == name)
        new = new.join(kept.good().filter(mine).select("key"), "key", "left_anti")
    got = new.mapInArrow(_scored(scorer), "key string, body string, error string")
    kind = [F.lit("scorer").alias("source"), F.lit(name).alias("kind")]
    got = stored(got.select(*kind, "key", F.lit(None).cast("int").alias("status"), "body", "error", F.lit(1).alias("tries"), F.lit(False).alias("closed")))
    answered = got
    if kept is not None:
        kept.add(got)
        answered = kept.good().filter(mine).withColumn("error", F.lit(None).cast("string")).unionByName(got.filter("error IS NOT NULL"), allowMissingColumns=True)
    out = rows.join(answered.select(F.col("key").alias("_key"), "body", F.col("error").alias("_failed")), "_key", "left")
    labels = F.create_map(*[F.lit(x) for pair in enumerate(P.SCORE_LABELS, 1) for x in pair])
    v = llm_verdict(F.col("body"))
    why = F.when(F.col("_key").isNull(), "Missing context or abstract for evaluation").otherwise(F.coalesce("_failed", v["error"]))
    verdict = F.struct(v["relevance_score"].alias("relevance_score"), v["is_relevant"].alias("is_relevant"), F.when(F.col("_key").isNull(), "Missing context or abstract").otherwise(v["explanation"]).alias("explanation"), why.alias("error"))
    label = F.coalesce(F.element_at(labels, F.col("v.relevance_score")), F.lit("Unknown")).alias("score_label")
    return out.withColumn("v", verdict).select(*contexts.columns, "v.*", label)


def _scored(scorer):
    def ask_all(batches):
        for b in batches:
            pairs = list(zip(b.column("full_context").to_pylist(), b.column("abstract").to_pylist(), strict=True))
            try:
                bodies, errors = scorer(pairs), [None] * len(pairs)
                if len(bodies) != len(pairs):
                    raise ValueError("not one answer for each question")
            except Exception:  # a failing service marks its rows, it does not end the run
                bodies, errors = [], []
                for pair in pairs:
                    try:
                        (body,), error = scorer([pair]), None
                    except Exception as e:
                        body, error = None, str(e) or type(e).__name__
                    bodies.append(body)
                    errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(bodies, pa.string()), pa.array(errors, pa.string())], names=["key", "body", "error"])

    return ask_all
