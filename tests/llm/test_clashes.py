"""Operators that return whole documents keep columns that are named like their own."""

import pytest

from paperloom.llm import decontaminate, minhash, mixing, quality, sharding, simhash

INNER = ["doc", "q_kept", "q_text", "q_stay", "_row", "_words", "_used", "_text", "_taken", "_fp", "fp", "keys", "root", "node", "rank", "size", "block", "k", "d_items", "d_hit", "key", "pair", "_kept", "least", "before", "target"]
GOOD = " ".join(f"Plain{i} words{i} that{i} stay{i} as{i} they{i} are{i}." for i in range(12))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"Number{i} {GOOD}" if i != 3 else GOOD.replace("Plain", f"Other{i}"), f"s{i % 2}", *(f"{c}{i}" for c in INNER)) for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in INNER))


STAGES = {
    "quality": lambda spark, docs: quality.clean(docs),
    "minhash": lambda spark, docs: minhash.dedup(docs),
    "simhash": lambda spark, docs: simhash.dedup(docs),
    "decontaminate": lambda spark, docs: decontaminate.remove(docs, spark.createDataFrame([(1, "nothing like it at all")], "item_id long, text string")),
    "mixing": lambda spark, docs: mixing.mixed(docs),
    "sharding": lambda spark, docs: sharding.sharded(docs),
}


@pytest.mark.parametrize("stage", STAGES)
def test_columns_of_the_caller_stay(spark, clashing, stage):
    out = STAGES[stage](spark, clashing)
    assert out.columns[: len(clashing.columns)] == clashing.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in INNER)
    assert STAGES[stage](spark, clashing.limit(0)).count() == 0


def test_input_shards_are_kept(spark, clashing):
    docs = clashing.selectExpr("doc_id", "text", "source", "doc_id AS shard", "doc_id AS Slot", "1 AS input_shard")
    out = sharding.sharded(docs)
    assert out.columns == ["doc_id", "text", "source", "input_shard_", "input_Slot", "input_shard", "shard", "slot"]
    assert all(r["input_shard_"] == r["doc_id"] and r["input_shard"] == 1 for r in out.collect())
