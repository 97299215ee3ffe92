from pyspark.sql import functions as F

from paperloom.operators import citations as C


def test_contexts_of_whole_texts_equal_those_of_lines(spark):
    """Also where a command's bracket is closed lines later, and with other white space."""
    base = ["One. Two! \\emph{x} three", "", "  \\citep[see]{a, b} here. And\tthere? ", "four  five.  six \\Cite{c} % \\cite{no}", " ", "end. \\textbf[1]{y}. last", None]
    opened = ["Zero. \\section*[an open", "\\citet{d} bracket] closes. Then", "more. \\foo[never closed", "\\cite{e}"]
    files = {"a": base * 4, "b": opened + base + opened, "c": opened[2:] * 8, "d": ["\\cite{f}"], "e": [None], "f": []}
    texts = spark.createDataFrame(list(files.items()), "file_path string, lines array<string>")
    lines = texts.select("file_path", F.posexplode("lines").alias("at", "line")).select("file_path", (F.col("at") + 1).alias("line_number"), F.coalesce("line", F.lit("")).alias("line"))
    columns = ["file_path", "line_number", "key", "context_before", "context_after", "full_context"]
    got, want = (sorted(map(tuple, x.select(columns).collect())) for x in (C.cited_in_texts(texts), C.cited_contexts(lines)))
    assert got == want and len(got) == 4 * 3 + 3 + 4 + 8 + 1
