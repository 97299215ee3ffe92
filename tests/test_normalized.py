from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import duplicates
from paperloom.plans import QUERIES


def test_titles_are_normalized_once_for_all_entries_that_have_them(spark):
    rows = [(i, str(i), (f"Title {i % 3}", None)[i % 4 == 3], "Lee, Ann" if i % 2 else None) for i in range(200)]
    raw = spark.createDataFrame(rows, "ord long, key string, raw_title string, raw_authors string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def title(text):
        calls.add(1)
        return text and text.lower()

    got = duplicates.normalized(raw, title("raw_title"), F.split("raw_authors", ", "))
    assert got.columns == ["ord", "key", "title", "authors"]
    want = [(o, k, t and t.lower(), a and a.split(", ")) for o, k, t, a in rows]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert calls.value == len({r[2:] for r in rows})


def test_title_search_normalizes_each_title_once(spark, monkeypatch, tmp_path):
    """60 parts of one name, brand, type and size are asked for three times each, and known to three sources."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def plain(t):
        calls.add(1)
        return t.lower().replace(",", "").replace(":", "")

    monkeypatch.setattr(text, "for_comparison", plain)
    parts = [(i, "hot bolt", "Brand#1", "LARGE", 7) for i in range(60)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["title_search"](spark, str(tmp_path)).collect()
    assert sorted({r["question"] for r in found}) == list(range(60)) and len(found) == 60 * 6
    assert calls.value == 4
