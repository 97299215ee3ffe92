"""Manuscripts as a stream: rules and citations of files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import citations, rules
from ..sources import lines_of


def watch(spark: SparkSession, folder: str, glob: str = "*.tex", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (file_path, content), each file once."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("file_path"), F.regexp_replace("value", "\r\n?", "\n").alias("content"))


def line_findings(docs: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Findings of the line rules, stateless: works on streams and tables."""
    return rules.line_findings(docs, enabled)


def citation_stream(docs: DataFrame) -> DataFrame:
    return citations.extract(lines_of(docs))


def usage_so_far(docs: DataFrame) -> DataFrame:
    """Uses of each key over all files seen; state holds one row a key."""
    return citation_stream(docs).groupBy("key").agg(F.count("*").alias("usage_count"), F.approx_count_distinct("file_path").alias("about_files"))


def into_table(docs: DataFrame, path: str, checkpoint: str, enabled: list[str] | None = None):
    """All rules on each micro-batch of files, appended to a Parquet table; one folder a batch, so a repeated batch leaves no copies."""

    def batch(rows: DataFrame, number: int) -> None:
        rules.findings(rows, enabled).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
