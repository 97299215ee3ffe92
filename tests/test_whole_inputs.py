import pytest

from paperloom.plans import QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["unreferenced_labels", "undefined_references"])
def test_label_queries_read_all_rows(spark, name):
    pick = lambda t, o, k: {(str(r[o] % 100), f"fig:{r[k]}") for r in spark.read.parquet(f"{D}/{t}.parquet").select(o, k).collect()}
    labels, refs = pick("orders", "o_orderkey", "o_custkey"), pick("lineitem", "l_orderkey", "l_suppkey")
    want = labels - refs if name == "unreferenced_labels" else refs - labels
    assert want and sorted((r["file_path"], r["key"]) for r in QUERIES[name](spark, D).collect()) == sorted(want)


def test_entry_queries_read_all_citations(spark):
    cited = {2 * r[0] for r in spark.read.parquet(f"{D}/lineitem.parquet").select("l_partkey").collect()}
    parts = {r[0] for r in spark.read.parquet(f"{D}/part.parquet").select("p_partkey").collect()}
    assert sorted(r["key"] for r in QUERIES["used_entries"](spark, D).collect()) == sorted(parts & cited)
    assert sorted(r["key"] for r in QUERIES["unused_entries"](spark, D).collect()) == sorted(parts - cited)
