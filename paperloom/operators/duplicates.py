"""Fuzzy duplicates of a bibliography: similar pairs and greedy groups, on classes of equal entries.

Entries of one normalized title and author list are one class, named by its least ord, so a title that many
entries share costs one row. Similarity joins and groups work on classes; entries come back at the end, as
rows of (anchor, member). No step gathers a key, a component or a group in one task.

Input everywhere: ord (unique), key, title (normalized), authors (normalized list); a null title or key is empty,
a null list has no authors. Empty titles are similar to none by title; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import jaccard, tokens
from .shared import join_spread, pairs_by_key, stored

#: Titles must share this at least, unless an author is repeated.
TITLE_SHARE = (P.DUPLICATE_PAIR - 0.3) / 0.7 - 1e-9


def _authors_match(x: Column, y: Column) -> Column:
    return (x == y) | F.contains(x, y) | F.contains(y, x) | (jaccard(x, y) >= 0.8)


def author_similarity(a: Column, b: Column) -> Column:
    """Share of the first list's authors that match any of the second, of all distinct authors; may exceed 1."""
    hits = F.size(F.filter(a, lambda x: F.exists(b, lambda y: _authors_match(x, y))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(hits / F.size(F.array_union(a, b)))


def _score(t: Column, authors: Column) -> Column:
    return F.when(t >= P.DUPLICATE_TITLE, t).otherwise(0.7 * t + 0.3 * authors)


def normalized(raw: DataFrame, title: Column, authors: Column) -> DataFrame:
    """The columns of ``raw`` but raw_title and raw_authors, with ``title`` and ``authors`` made of these two.

    They are made once for each distinct pair of raw values, however many entries have it: that takes most of the time."""
    pair = ["raw_title", "raw_authors"]
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = stored(raw.select(*pair).distinct().repartition(parts, *pair).select(*[F.col(c).alias(f"known_{c}") for c in pair], title.alias("title"), authors.alias("authors")))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in pair])
    return raw.join(known, same).select(*[c for c in raw.columns if c not in pair], "title", "authors")


# Similar pairs --------------------------------------------------------------------------------------


def classes(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ord, key, cls) of every entry, and of every class: cls, last (its greatest ord), n, words (of its title), authors,
    share (what another title must share with it at least if it comes first)."""
    title, authors = F.coalesce("title", F.lit("")).alias("title"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors")
    key = F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key")
    held = stored(entries.select("ord", key, title, authors))
    kinds = stored(held.groupBy("title", "authors").agg(F.min("ord").alias("cls"), F.max("ord").alias("last"), F.count("*").alias("n")))
    members = stored(held.join(kinds.select("title", "authors", "cls"), ["title", "authors"]).select("ord", "key", "cls"))
    repeats = F.size("authors") / F.greatest(F.lit(1), F.size(F.array_distinct("authors")))
    share = (P.DUPLICATE_PAIR - 0.3 * F.greatest(F.lit(1.0), repeats)) / 0.7 - 1e-9
    return members, stored(kinds.select("cls", "last", "n", tokens(F.col("title")).alias("words"), "authors", share.alias("share")))


def _title_score(x: Column, y: Column) -> Column:
    """Jaccard similarity of two sets of words; empty ones are like none."""
    common = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(common / (F.size(x) + F.size(y) - common))


def _title_pairs(titles: DataFrame) -> DataFrame:
    """(x, y, title_score), x < y, of the pairs of titles (t, words, share) that share enough for any of their classes.

    Titles share TITLE_SHARE of their words at least; then they share a word among the rarest
    |x| - ceil(|x| * share) + 1 of each, and pairs meet on those, where what is left of both after the
    word can still reach the bound. If the first entry repeats authors, its author share may exceed 1, and
    the bound on its title is less: the longer prefix of such a title meets all words of others.
    """
    posted = titles.select("t", "share", F.size("words").alias("n"), F.explode("words").alias("w"))
    frequency = posted.groupBy("w").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("t").orderBy("often", "w"))
    placed = stored(posted.join(frequency, "w").withColumn("p", place).select("t", "w", "n", "p", "share"))
    prefix = lambda share: F.col("p") <= F.col("n") - F.ceil(F.col("n") * share) + 1
    met = pairs_by_key(placed.filter(prefix(F.lit(TITLE_SHARE))).drop("share"), "w", "t")
    close = (F.col("n_i") >= F.col("n_j") * TITLE_SHARE) & (F.col("n_j") >= F.col("n_i") * TITLE_SHARE)
    # Words shared from here on, at most, against those that the similarity needs.
    close &= 1 + F.least(F.col("n_i") - F.col("p_i"), F.col("n_j") - F.col("p_j")) >= TITLE_SHARE / (1 + TITLE_SHARE) * (F.col("n_i") + F.col("n_j")) - F.least("p_i", "p_j") + 1
    found = met.filter(close).select(F.col("t_i").alias("x"), F.col("t_j").alias("y"))
    # Lists that repeat a name are rare; their joins are planned where there are any.
    if _least_share(titles) < TITLE_SHARE - 1e-6:
        odd = placed.filter((F.col("share") < TITLE_SHARE - 1e-6) & prefix(F.greatest("share", F.lit(1e-9))))
        wide = join_spread(odd.select("w", F.col("t").alias("x"), F.col("n").alias("nx"), "share"), placed.select("w", F.col("t").alias("y"), F.col("n").alias("ny")), "w")
        wide = wide.filter("x != y AND nx >= ny * share AND ny >= nx * share")
        found = found.unionByName(wide.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
    a, b = (titles.select(F.col("t").alias(k), F.col("words").alias(f"words_{k}"), F.col("share").alias(f"share_{k}")) for k in "xy")
    scored = found.distinct().join(a, "x").join(b, "y").withColumn("title_score", _title_score(F.col("words_x"), F.col("words_y")))
    return scored.filter(F.col("title_score") >= F.least("share_x", "share_y")).select("x", "y", "title_score")


def _least_share(rows: DataFrame) -> float:
    least = rows.agg(F.min("share")).first()[0]
    return TITLE_SHARE if least is None else least


def _candidates(kinds: DataFrame) -> DataFrame:
    """(i, j, title_score), i < j, of all classes that may be similar: those of similar titles, which are paired once for all
    classes that have them, and those with like authors where even titles without a common word may do."""
    named = kinds.select("cls", F.sort_array("words").alias("words"), "share")
    titles = stored(named.groupBy("words").agg(F.min("cls").alias("t"), F.min("share").alias("share")))
    of = stored(named.join(titles.select("words", "t"), "words").select("t", "cls"))
    pairs = stored(_title_pairs(titles.filter(F.size("words") > 0)))
    met = join_spread(pairs.withColumnRenamed("x", "t"), of.withColumnRenamed("cls", "x"), "t").drop("t")
    met = join_spread(met.select(F.col("y").alias("t"), "x", "title_score"), of.withColumnRenamed("cls", "y"), "t").select("x", "y", "title_score")
    same = pairs_by_key(of.join(titles.filter(F.size("words") > 0), "t", "left_semi"), "t", "cls")
    met = met.unionByName(same.select(F.col("cls_i").alias("x"), F.col("cls_j").alias("y"), F.lit(1.0).alias("title_score")))
    # Few titles may stand for many classes: what they grow to is dealt anew before authors are compared.
    out = met.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "title_score").repartition(int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")), "i", "j")
    if _least_share(kinds) > 0:
        return out
    words = kinds.select("cls", "words")
    like = _by_author(kinds).select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).distinct().join(out.select("i", "j"), ["i", "j"], "left_anti")
    like = like.join(words.select(F.col("cls").alias("i"), F.col("words").alias("a")), "i").join(words.select(F.col("cls").alias("j"), F.col("words").alias("b")), "j")
    return out.unionByName(like.select("i", "j", _title_score(F.col("a"), F.col("b")).alias("title_score")))


def _by_author(k: DataFrame) -> DataFrame:
    """(x, y) where any title may do for x, one of its authors is like one of y's, and y has few enough.

    Like names are equal, or one holds the other, or they share words. If one holds another, its parts of
    three letters (or the other's length, if less) hold the other's first; so names meet on parts and words.
    """
    names = k.select("cls", F.size("authors").alias("own"), F.size(F.array_distinct("authors")).alias("distinct"), (F.col("share") <= 0).alias("odd"), F.explode(F.array_distinct("authors")).alias("name"))
    size = F.length("name")
    cut = lambda k: F.when(size >= k, F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.concat(F.lit(f"{k}:"), F.substring("name", i, F.lit(k)))))
    words = F.transform(tokens(F.col("name")), lambda w: F.concat(F.lit("w:"), w))
    parts = F.flatten(F.array_compact(F.array(F.array(F.lit("0:")), cut(1), cut(2), cut(3), words)))
    first = F.concat(F.least(F.lit(3), size).cast("string"), F.lit(":"), F.substring("name", 1, 3))
    known = names.groupBy("name").agg(F.bool_or("odd").alias("odd"))
    whole = known.select("name", "odd", F.explode(F.array_distinct(parts)).alias("part"))
    begin = known.select("name", "odd", F.explode(F.array_distinct(F.concat(F.array(first), words))).alias("part"))
    asks = lambda t: t.filter("odd").select(F.col("name").alias("a"), "part")
    told = lambda t: t.select(F.col("name").alias("b"), "part")
    met = join_spread(asks(whole), told(begin), "part").select("a", "b").unionByName(join_spread(asks(begin), told(whole), "part").select("a", "b")).distinct()
    like = met.filter(_authors_match(F.col("a"), F.col("b")))
    mine = names.filter("odd").select(F.col("cls").alias("x"), "own", F.col("name").alias("a")).join(like, "a")
    theirs = names.select(F.col("cls").alias("y"), F.col("distinct").alias("few"), F.col("name").alias("b"))
    return join_spread(mine, theirs, "b").filter("x != y AND few < own").select("x", "y").distinct()


def class_links(kinds: DataFrame) -> DataFrame:
    """(i, j, score, back, title_score), i <= j, of similar classes: ``score`` of an entry of i before one of j,
    ``back`` of one of j before one of i (null where too low or there is none). A class that is similar to itself has i = j."""
    columns = ("cls", "last", "authors", "share")
    x, y = (kinds.select(*[F.col(c).alias(p + c) for c in columns]) for p in ("x_", "y_"))
    pairs = _candidates(kinds).join(x, F.col("i") == F.col("x_cls")).join(y, F.col("j") == F.col("y_cls"))
    itself = kinds.filter("n > 1").withColumn("title_score", _title_score(F.col("words"), F.col("words")))
    itself = itself.select(F.col("cls").alias("i"), F.col("cls").alias("j"), "title_score", *[F.col(c).alias(p + c) for p in ("x_", "y_") for c in columns])
    # Titles first: most pairs end there, before authors are compared.
    pairs = pairs.select(itself.columns).unionByName(itself).filter(F.col("title_score") >= F.least("x_share", "y_share"))
    enough = lambda s: F.when(s >= P.DUPLICATE_PAIR, s)
    there = _score(F.col("title_score"), author_similarity(F.col("x_authors"), F.col("y_authors")))
    back = _score(F.col("title_score"), author_similarity(F.col("y_authors"), F.col("x_authors")))
    scored = pairs.withColumn("score", enough(there)).withColumn("back", F.when((F.col("i") < F.col("j")) & (F.col("j") < F.col("x_last")), enough(back)))
    return scored.filter("score IS NOT NULL OR back IS NOT NULL").select("i", "j", "score", "back", "title_score")


def similar_classes(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``class_links`` and (ord, key, cls) of all entries: all links, of which copies need no row each."""
    members, kinds = classes(entries)
    return class_links(kinds), members


def similar_pairs(entries: DataFrame) -> DataFrame:
    """(i, j, score, title_score), i < j, of all pairs of entries with score at least the threshold: as many rows as there are such pairs."""
    links, members = similar_classes(entries)
    i, j = (members.select(F.col("cls").alias(f"c{k}"), F.col("ord").alias(k)) for k in "ij")
    links = links.select(F.col("i").alias("ci"), F.col("j").alias("cj"), "score", "title_score").unionByName(links.filter("back IS NOT NULL").select(F.col("j").alias("ci"), F.col("i").alias("cj"), F.col("back").alias("score"), "title_score"))
    return links.filter("score IS NOT NULL").join(i, "ci").join(j, "cj").filter("i < j").select("i", "j", "score", "title_score")


# Groups ---------------------------------------------------------------------------------------------


def group_members(entries: DataFrame) -> DataFrame:
    """(anchor, ord, cls) of the greedy groups in input order, the anchors among them."""
    links, members = similar_classes(entries)
    return _grouped(stored(links), members)


def _grouped(links: DataFrame, members: DataFrame) -> DataFrame:
    """In the order of ord, an entry whose key is free is an anchor and takes, of each free key, the first later
    entry similar to it; these keys are taken then, and its own if there was any.

    Rounds over tables. Of a class only its first free entry can take anything, as later ones reach no more. It is
    an anchor once no undecided class with an earlier one reaches its class, or a key that it shares with
    other entries. Anchors block all later entries of what they reach; an entry's anchor is the first of all that
    reach it. If an anchor's own key is shared, it also waits for all earlier ones that reach what it reaches,
    as it takes its own key only if something is left for it. Classes that are first among their neighbours decide
    in one round, which gives what a scan in order gives.
    """
    edges = links.filter("score IS NOT NULL").select(F.col("i").alias("c"), F.col("j").alias("d"))
    edges = stored(edges.unionByName(links.filter("back IS NOT NULL").select(F.col("j").alias("c"), F.col("i").alias("d"))))
    reached = edges.select(F.col("c").alias("cls")).unionByName(edges.select(F.col("d").alias("cls"))).distinct()
    units = members.join(reached, "cls", "left_semi").groupBy("cls", "key").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count("*").alias("n"))
    several = units.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key", F.lit(True).alias("common"))
    units = stored(units.join(several, "key", "left").select("cls", "key", "lo", "hi", F.coalesce("common", F.lit(False)).alias("common")))
    some_common = not units.filter("common").isEmpty()
    a_class, a_key = (lambda c: F.concat(F.lit("class "), F.col(c).cast("string")).alias("r")), F.concat(F.lit("key "), F.col("key")).alias("r")
    starts = edges.select(F.col("c").alias("cls")).distinct()
    free = units.join(starts, "cls", "left_semi").select("cls", "key", "lo", "common")
    need, reach = starts.select(F.col("cls").alias("c"), a_class("cls")), edges.select("c", a_class("d"))
    if some_common:
        own = free.filter("common").select(F.col("cls").alias("c"), a_key)
        need, reach = need.unionByName(own), reach.unionByName(own)
        reach = reach.unionByName(edges.join(units.filter("common").select(F.col("cls").alias("d"), "key"), "d").select("c", a_key)).distinct()
    need, reach, free = stored(need), stored(reach), stored(free)
    anchors, owned = [], []
    while not free.isEmpty():
        best = F.min_by(F.struct(F.col("lo").alias("anchor"), "key", "common"), "lo").alias("s")
        open_ = free.groupBy(F.col("cls").alias("c")).agg(best).select("c", "s.*")
        first = reach.join(open_, "c").groupBy("r").agg(F.min("anchor").alias("first"))
        before = lambda table, open_=open_, first=first: table.join(open_, "c").join(first, "r").filter("first < anchor").select("c")
        waits = before(need)
        if some_common:
            waits = waits.unionByName(before(reach, open_.filter("common")))
        anchors.append(stored(open_.join(waits, "c", "left_anti")))
        hit = anchors[-1].join(edges, "c").groupBy(F.col("d").alias("cls")).agg(F.min("anchor").alias("a"))
        left = free.join(anchors[-1].select(F.col("c").alias("cls")), "cls", "left_anti").join(hit, "cls", "left").filter("a IS NULL OR common OR lo < a").drop("a")
        if some_common:
            owned.append(stored(_with_members(anchors[-1], reduce(DataFrame.unionByName, anchors), reduce(DataFrame.unionByName, owned) if owned else None, edges, units)))
            taken = units.filter("common").join(hit, "cls").filter("hi > a").select("key", "a").unionByName(owned[-1].select("key", "a"))
            left = left.join(taken.groupBy("key").agg(F.min("a").alias("a")), "key", "left").filter("a IS NULL OR NOT common OR lo < a").drop("a")
        free = stored(left.select("cls", "key", "lo", "common"))
    if not anchors:
        return members.limit(0).select(F.col("ord").alias("anchor"), "ord", "cls")
    anchors = reduce(DataFrame.unionByName, anchors)
    took = _taken(anchors, reduce(DataFrame.unionByName, owned) if owned else None, edges, units)
    rows = members.join(took.filter("NOT common").select("cls", "key", "a"), ["cls", "key"])
    if some_common:
        # A key that several entries have: the first of them in any class that the anchor reaches.
        shared_keys = took.filter("common").select("key", "a").distinct().join(anchors.select(F.col("anchor").alias("a"), "c"), "a").join(edges, "c").select("key", "a", F.col("d").alias("cls"))
        rows = rows.unionByName(members.join(shared_keys, ["cls", "key"]))
    found = rows.filter("ord > a").groupBy("a", "key").agg(F.min_by(F.struct("ord", "cls"), "ord").alias("m")).select(F.col("a").alias("anchor"), "m.ord", "m.cls")
    heads = anchors.select("anchor", F.col("anchor").alias("ord"), F.col("c").alias("cls")).join(found.select("anchor"), "anchor", "left_semi")
    return found.unionByName(heads)


def _taken(anchors: DataFrame, owned: DataFrame | None, edges: DataFrame, units: DataFrame) -> DataFrame:
    """(cls, key, common, a) of the units whose key an anchor ``a`` takes: the first that reaches one of the key's units before its last
    entry. A key that an anchor took as its own before that is left out."""
    first = anchors.join(edges, "c").groupBy(F.col("d").alias("cls")).agg(F.min("anchor").alias("a"))
    cover = units.join(first, "cls").filter("a < hi").select("cls", "key", "common", "a")
    if owned is None:
        return cover
    own = owned.groupBy("key").agg(F.min("a").alias("mine"))
    shared_keys = cover.filter("common").groupBy("key").agg(F.min("a").alias("a")).join(own, "key", "left").filter("mine IS NULL OR a <= mine").select("key", "a")
    return cover.filter("NOT common").unionByName(units.filter("common").select("cls", "key", "common").join(shared_keys, "key").select("cls", "key", "common", "a"))


def _with_members(new: DataFrame, anchors: DataFrame, owned: DataFrame | None, edges: DataFrame, units: DataFrame) -> DataFrame:
    """(key, a) of the anchors among ``new`` whose own key is shared and that take something."""
    mine = new.filter("common").select(F.col("key").alias("own"), F.col("anchor").alias("a"))
    none = owned if owned is not None else mine.limit(0).select(F.col("own").alias("key"), "a")
    return _taken(anchors, none, edges, units).select("a").distinct().join(mine, "a").select(F.col("own").alias("key"), "a")


def groups(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row a group (anchor, size, score, reason), and its members (anchor, ord).

    The score is the mean over all pairs of members in order. It is taken from pairs of classes with
    the number of entries of each; only where the score of two classes depends on which comes first are
    their entries counted in order.
    """
    members, kinds = classes(entries)
    found = stored(_grouped(stored(class_links(kinds)), members))
    held = found.groupBy("anchor", "cls").agg(F.count("*").alias("n"))
    text = kinds.select("cls", "words", "authors")
    met = pairs_by_key(held, "anchor", "cls")
    same = held.filter("n > 1").select("anchor", F.col("cls").alias("cls_i"), F.col("n").alias("n_i"), F.col("cls").alias("cls_j"), F.lit(0).cast("long").alias("n_j"))
    x, y = (text.select(F.col("cls").alias(f"cls_{s}"), F.col("words").alias(f"words_{s}"), F.col("authors").alias(f"authors_{s}")) for s in "ij")
    both = met.select(same.columns).unionByName(same).join(x, "cls_i").join(y, "cls_j").withColumn("t", _title_score(F.col("words_i"), F.col("words_j")))
    there = _score(F.col("t"), author_similarity(F.col("authors_i"), F.col("authors_j")))
    back = _score(F.col("t"), author_similarity(F.col("authors_j"), F.col("authors_i")))
    pairs = F.when(F.col("cls_i") == F.col("cls_j"), F.col("n_i") * (F.col("n_i") - 1) / 2).otherwise(F.col("n_i") * F.col("n_j"))
    both = stored(both.select("anchor", "cls_i", "cls_j", "t", there.alias("there"), back.alias("back"), pairs.alias("pairs")))
    uneven = both.filter("there != back").select("anchor", "cls_i", "cls_j")
    either = lambda s: uneven.join(found.withColumnRenamed("cls", f"cls_{s}"), ["anchor", f"cls_{s}"]).select("anchor", "cls_i", "cls_j", "ord", F.lit(s == "i").alias("i"))
    before = Window.partitionBy("anchor", "cls_i", "cls_j").orderBy("ord")
    rows = either("i").unionByName(either("j")).withColumn("seen", F.count(F.when(F.col("i"), 1)).over(before))
    first = rows.filter("NOT i").groupBy("anchor", "cls_i", "cls_j").agg(F.sum("seen").alias("first"))
    total = both.join(first, ["anchor", "cls_i", "cls_j"], "left").withColumn("first", F.coalesce("first", "pairs"))
    means = total.groupBy("anchor").agg(
        (F.sum(F.col("there") * F.col("first") + F.col("back") * (F.col("pairs") - F.col("first"))) / F.sum("pairs")).alias("score"),
        (F.sum(F.col("t") * F.col("pairs")) / F.sum("pairs")).alias("t"),
    )
    reason = F.when(F.col("t") >= 0.95, "Nearly identical titles").when(F.col("t") >= 0.85, "Very similar titles").otherwise("Similar titles and authors")
    sizes = found.groupBy("anchor").agg(F.count("*").alias("size"))
    return means.join(sizes, "anchor").select("anchor", "size", "score", reason.alias("reason")), found.select("anchor", "ord")


def duplicate_groups(entries: DataFrame) -> DataFrame:
    """(anchor, members, score, reason), best score first, as reports show groups: each with the list of its members."""
    found, members = groups(entries)
    lists = members.groupBy("anchor").agg(F.sort_array(F.collect_list("ord")).alias("members"))
    return found.join(lists, "anchor").select("anchor", "members", "score", "reason").orderBy(F.desc("score"), "anchor")
