"""Files and reports that executors write: order, failed and repeated tasks, and jobs that do not grow with files."""

import os

import pytest
from pyspark.sql import functions as F

from paperloom.sources import writers as W


def test_report_in_order(spark, tmp_path):
    folder = f"file://{tmp_path}"
    report = W.Report(spark, folder, "r.md")
    report.lines("# Head")
    rows = spark.range(5000).repartition(7).select(F.col("id").alias("o"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"))
    assert report.rows(rows, ["before"], ["after"]) == 5000
    assert report.rows(rows.limit(0), ["never"], ["never"]) == 0
    report.lines("end")
    assert report.close() == f"{tmp_path}/r.md"
    assert (tmp_path / "r.md").read_text().split("\n") == ["# Head", "before", *(f"row {i}" for i in range(5000)), "after", "end", ""]
    assert os.listdir(tmp_path) == ["r.md"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/out"

    def made(row):
        if row["id"] == 3:
            raise ValueError("broken")
        return [(f"{row['id']}.txt", b"x")]

    with pytest.raises(Exception, match="broken"):
        W.write_files(spark.range(5), folder, made)
    assert not [n for n in os.listdir(tmp_path / "out") if not n.endswith(".txt")]
    fs, _ = W.filesystem(folder)

    def cut():
        yield b"half"
        raise OSError("gone")

    with pytest.raises(OSError):
        W.put(fs, f"{tmp_path}/out/whole", cut())
    assert not [n for n in os.listdir(tmp_path / "out") if n.startswith("whole")]
    report = W.Report(spark, folder, "bad.md")
    with pytest.raises(Exception, match="boom"):
        report.rows(spark.range(3).select("id", F.raise_error(F.lit("boom")).cast("string").alias("text")))
    report.drop()
    assert not [n for n in os.listdir(tmp_path / "out") if "bad" in n]


def test_a_repeated_task_writes_the_same(spark, tmp_path):
    folder = f"file://{tmp_path}"
    twice = spark.range(4).select((F.col("id") % 2).alias("id")).repartition(4)
    manifest = W.write_files(twice, folder, lambda row: [(f"d/{row['id']}.txt", b"abc"[: row["id"] + 1])])
    assert sorted(os.listdir(tmp_path / "d")) == ["0.txt", "1.txt"] and (tmp_path / "d" / "1.txt").read_bytes() == b"ab"
    assert {tuple(r) for r in manifest.collect()} == {("d/0.txt", 1), ("d/1.txt", 2)}
    assert W.merge_files(manifest.distinct(), folder, "all.txt") == 5 and (tmp_path / "all.txt").read_bytes() == b"a\nab\n"


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"files-{n}", "")
        W.write_files(spark.range(n), f"file://{tmp_path}/{n}", lambda row: [(f"{row['id']}.txt", b"x")])
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"files-{n}"))

    assert jobs(2) == jobs(60) <= 2 and len(os.listdir(tmp_path / "60")) == 60
