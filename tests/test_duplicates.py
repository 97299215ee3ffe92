"""Duplicates against a plain scan, and at sizes where pairs of entries would not do."""

import random
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import duplicates as D
from paperloom.operators import shared

SCHEMA = "ord long, title string, authors array<string>, key string"


def jac(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a and b else 0.0


def score(x, y):
    t = jac(x[1], y[1])
    if t >= 0.85:
        return t, t
    near = lambda p, q: p == q or p in q or q in p or jac(p, q) >= 0.8
    a = sum(any(near(p, q) for q in y[2]) for p in x[2]) / len(set(x[2]) | set(y[2])) if x[2] and y[2] else 0.0
    return 0.7 * t + 0.3 * a, t


def scan(rows):
    out, taken = {}, set()
    for i, x in enumerate(rows):
        if x[3] in taken:
            continue
        group = [x]
        for y in rows[i + 1 :]:
            if y[3] not in taken and score(x, y)[0] >= 0.8:
                group.append(y)
                taken.add(y[3])
        if len(group) > 1:
            taken.add(x[3])
            met = [score(a, b) for k, a in enumerate(group) for b in group[k + 1 :]]
            mean = lambda k: sum(m[k] for m in met) / len(met)
            reason = "Nearly identical titles" if mean(1) >= 0.95 else "Very similar titles" if mean(1) >= 0.85 else "Similar titles and authors"
            out[x[0]] = ([g[0] for g in group], round(mean(0), 9), reason)
    return out


def made(seed, n=70, keys=50):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(13)]
    for i in range(n):
        old = rng.choice(rows)[1].split() if rows else []
        title = old if old and i % 4 == 0 else [*old[:-1], rng.choice(words)] if old and i % 4 == 1 else rng.sample(words, rng.randint(0, 7))
        authors = [rng.choice(["ann a", "b", "c d", "ann", "ab"]) for _ in range(rng.choice([0, 1, 1, 2, 3, 4]))]
        rows.append((10 * i + 3, " ".join(dict.fromkeys(title)), authors, rng.choice(["", f"k{rng.randint(0, keys)}", f"own{i}"])))
    return rows


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(shared, "BLOCK_ROWS", 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_a_plain_scan(spark, small_blocks, seed):
    rows = made(seed)
    e = spark.createDataFrame(rows, SCHEMA)
    pairs = {(r.i, r.j): round(r.score, 9) for r in D.similar_pairs(e).collect()}
    assert pairs == {(x[0], y[0]): round(score(x, y)[0], 9) for k, x in enumerate(rows) for y in rows[k + 1 :] if score(x, y)[0] >= 0.8}
    want = scan(rows)
    assert len(want) > 5
    assert {r.anchor: (r.members, round(r.score, 9), r.reason) for r in D.duplicate_groups(e).collect()} == want


def test_equal_titles_and_a_word_in_all(spark):
    """100,000 equal titles in one group, and a word that all titles have."""
    n = 100_000
    same = spark.range(n).select(F.col("id").alias("ord"), F.lit("introduction to all").alias("title"), F.array(F.lit("ann")).alias("authors"), F.col("id").cast("string").alias("key"))
    rest = spark.range(n, n + 6000).select(F.col("id").alias("ord"), F.format_string("all x%d y%d z%d", "id", F.col("id") % 3000, F.col("id") % 1500).alias("title"), F.array(F.lit("bo")).alias("authors"), F.col("id").cast("string").alias("key"))
    began = time.time()
    groups, members = D.groups(same.unionByName(rest))
    assert [tuple(r) for r in groups.collect()] == [(0, n, 1.0, "Nearly identical titles")]
    assert members.select(F.count("*"), F.countDistinct("ord"), F.max("ord")).first()[:] == (n, n, n - 1)
    assert time.time() - began < 60


def test_blocks_keep_all_pairs_and_bound_a_key(spark, small_blocks):
    rows = spark.range(20).select(F.col("id").alias("cls"), F.when(F.col("id") < 14, "hot").otherwise(F.col("id").cast("string")).alias("w"))
    got = sorted((r.cls_i, r.cls_j) for r in shared.pairs_by_key(rows, "w", "cls").collect())
    assert got == [(i, j) for i in range(14) for j in range(i + 1, 14)]


def test_entries_are_normalized_once(spark):
    """One scan of the input whatever is made of it."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(t):
        seen.add(1)
        return t

    e = spark.createDataFrame(made(3, 30), SCHEMA).withColumn("title", noted("title"))
    D.groups(e)[0].collect()
    assert seen.value <= 2 * 30  # a checkpoint counts and writes


def test_nulls_and_none(spark):
    rows = [(0, None, None, None), (1, None, ["a", "a", "a"], "x"), (2, "", ["a"], None), (3, "t u v", None, "y"), (4, "t u v", [], "y"), (5, "t u v", [], "y")]
    want = scan([(o, t or "", a or [], k or "") for o, t, a, k in rows])
    assert want and {r.anchor: r.members for r in D.duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == {a: w[0] for a, w in want.items()}
    assert D.duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chains(spark):
    """Each title is like the next only: rounds settle what is first among its neighbours."""
    rows = [(i, " ".join(f"c{k}" for k in range(i, i + 14)), [], f"k{i}") for i in range(24)]
    got = {r.anchor: r.members for r in D.duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {a: w[0] for a, w in scan(rows).items()}
