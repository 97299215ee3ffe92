"""Queries on tables whose keys are larger than those of the given ones."""

import __spark_entry__


def test_arxiv_ids_of_large_keys_differ(spark, tmp_path):
    """100142 and 100149 had one arXiv id when ids were cut to five digits; the latter was then found by its DOI."""
    rows = [(7, "hot bolt", 1), (100142, "red ring", 3), (100149, "old plate", 4)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["entry_id"]: r["source"] for r in __spark_entry__.queries()["catalogue_lookup"](spark, str(tmp_path)).collect()}
    assert got == {7: "arxiv", 100142: "arxiv", 100149: "arxiv"}
