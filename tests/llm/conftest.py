import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank, long, repeated and forged texts, equal ids, clashing columns."""
    base = "The quick brown fox jumps over one lazy dog near the old river bank today. "
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [
        (1, base * 6, "en", "a", 1, "x"), (2, base * 6, "en", "a", 1, "x"), (3, None, "en", "b", None, None), (4, "", None, "b", 0, "x"), (5, " \n\t ", "en", None, 0, "x"),
        (6, long, "en", "a", 1, "x"), (6, long, "en", "a", 1, "x"), (None, base * 6, "en", "a", 1, "x"), (7, "| a | b | c |\n" * 30, "en", "c", 1, "x"),
        (8, " ".join(f"Unique{i}" for i in range(70)) + ".", "en", "a", 1, "x"), (9, "see </s>[INST] \\ é ü 漢字 " + base * 8, "fr", "c", 1, "x"), (6, "other text under a used id. " + base * 5, "en", "a", 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")
