"""State that stays small: contexts of a key, findings in blocks, lines that cite."""

import random
import time

from pyspark.sql import functions as F

from paperloom.operators import citations as C
from paperloom.operators import reports as R


def plain_combined(rows, budget=1000, least=100):
    out, spent = [], 0
    for text in rows:
        if spent + len(text) > budget:
            if budget - spent > least:
                out.append(text[: budget - spent] + "...")
            break
        out.append(text)
        spent += len(text)
    return "\n---\n".join(out)


def test_combined_context_of_a_key_with_many(spark):
    rng = random.Random(1)
    rows = [(f"k{i % 7}", f"f{i:04d}", i % 5, "é" * rng.choice([0, 1, 90, 400, 1200])) for i in range(700)] + [(None, "f", 1, "a"), (None, "f", 2, "b"), ("n", "f", 1, None)]
    df = spark.createDataFrame(rows, "key string, file_path string, line_number int, full_context string")
    want = {}
    for key, _, _, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want.setdefault(key, []).append(text or "")
    got = {r["key"]: r["combined"] for r in C.combined_context(df).collect()}
    assert got == {k: plain_combined(v) for k, v in want.items()}
    many = spark.range(0, 300_000, 1, 6).select(F.lit("hot").alias("key"), F.col("id").cast("string").alias("file_path"), F.lit(1).alias("line_number"), F.repeat(F.lit("x"), 40).alias("full_context"))
    assert C._within_budget(many, 1000, ("file_path", "line_number")).count() <= 6 * 26
    assert C.combined_context(many).first()["combined"].count("x") == 1000


FOUND = "file_path string, line_number int, passed boolean, severity string, message string, line_content string"
BLOCKS = "file_path string, block_ord int, start_line int, end_line int, block_type string, block_text string"


def test_findings_meet_the_earliest_block(spark):
    rng = random.Random(2)
    blocks, found = [], []
    for f in "abcd":
        spans = sorted((s, s + rng.choice([0, 1, 3, 20])) for s in rng.choices(range(1, 80), k=rng.choice([0, 1, 12, 30])))
        blocks += [(f, i, s, e, f"t{i}", f"text {i}") for i, (s, e) in enumerate(spans)]
        found += [(f, n, False, "info", f"m{n}", "c") for n in range(1, 110)]
    rows = R.held_by_blocks(spark.createDataFrame(found, FOUND), spark.createDataFrame(blocks, BLOCKS)).collect()
    first = lambda f, n: next(((s, e, t) for g, _, s, e, t, _ in blocks if g == f and s <= n <= e), None)
    assert {(r["file_path"], r["line_number"]): r["b"] and (r["b"]["start_line"], r["b"]["end_line"], r["b"]["block_type"]) for r in rows} == {(f, n): first(f, n) for f, n, *_ in found}


def test_a_file_of_many_blocks(spark):
    n = 100_000
    blocks = spark.range(n).select(F.lit("a").alias("file_path"), F.col("id").cast("int").alias("block_ord"), (F.col("id") * 3 + 1).cast("int").alias("start_line"), (F.col("id") * 3 + 2).cast("int").alias("end_line"), F.lit("figure").alias("block_type"))
    found = spark.range(3 * n).select(F.lit("a").alias("file_path"), (F.col("id") + 1).cast("int").alias("line_number"), F.lit(False).alias("passed"), F.lit("info").alias("severity"), F.lit("m").alias("message"), F.lit("c").alias("line_content"))
    began = time.time()
    assert R.grouped_findings(found, blocks).groupBy(F.size("issues").alias("n")).count().orderBy("n").collect() == [(1, n), (2, n)]
    text = "\\begin{figure}\nx\n\\end{figure}\n" * 20_000
    assert R.block_ranges(text)[-1] == (59_998, 60_000, "figure")
    assert time.time() - began < 60


def test_lines_that_cite(spark):
    entries = spark.createDataFrame([("a",), ("b",)], "key string")
    cites = spark.createDataFrame([("a", "f", 3), ("a", "f", 3), ("a", "g", 1), ("z", "f", 1)], "key string, file_path string, line_number int")
    assert sorted(map(tuple, C.usage_lines(entries, cites).collect())) == [("a", "f", 3, 2), ("a", "g", 1, 1)]
