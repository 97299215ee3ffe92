"""Proportional stratified interleaving (operator 8).

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is
(2 * rank + 1) / (2 * rows of its source). Sorting all rows by that fraction interleaves the sources
in proportion, and cutting the order into equal runs gives every shard the mixture of the whole
table, with row counts at most one apart.

Only light rows (keys, size, checksum) are ranked; both orders use range partitioning with summed
offsets, so a source that holds a third of all rows is spread over many tasks. The table of sources is
broadcast only if its counted rows are few.

Defined results: null text has size 8 and checksum 0; null source is a source of its own; very long
texts count as one row; equal rows take neighbouring ranks in any order; an empty table gives no rows.
``sharded`` keeps all columns of its input; one named shard or slot is kept as input_shard or input_slot
(with more underscores at its end while that name is taken).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, ranked, sized, stored


def interleaved(rows: DataFrame, source: str, shuffle: list[str], seed: int) -> DataFrame:
    """``rows`` with ``rank``: their place in the proportional interleaving of the sources."""
    keep = rows.columns
    rows = rows.withColumn("_seeded", F.xxhash64(F.lit(seed), *[F.col(c) for c in shuffle]))
    first = ranked(rows, [source, "_seeded", *shuffle])
    bounds = first.groupBy(source).agg(F.min("rank").alias("_from"), F.count("*").alias("_rows")).withColumnRenamed(source, "_source")
    bounds = stored(bounds, "bounds")
    joined = first.join(sized(bounds), first[source].eqNullSafe(bounds["_source"]))
    at = (2 * (F.col("rank") - F.col("_from")) + 1).cast("decimal(38,0)")
    placed = joined.withColumn("_fraction", (at.cast("double")) / (2 * F.col("_rows")).cast("double")).withColumn("_tie", F.xxhash64(F.lit(seed), source))
    return ranked(placed.drop("rank", "_from", "_source", "_rows"), ["_fraction", "_tie", "_seeded", *shuffle]).select(*keep, "rank")


def assign(rows: DataFrame, source: str = "source", shuffle: list[str] | None = None, *, shards: int = 24, seed: int = 17) -> DataFrame:
    """``rows`` with ``shard`` and its gapless ``slot``; keeps every row once."""
    shuffle = shuffle or [c for c in rows.columns if c != source]
    keep = rows.columns
    placed = interleaved(rows, source, shuffle, seed)
    total = placed.count()
    # Shard k starts at row ceil(k * total / shards), so counts differ by at most one.
    shard = F.expr(f"(rank * {shards}) div {max(total, 1)}")
    start = F.expr(f"(({max(total, 1)} * _shard) + {shards - 1}) div {shards}")
    return placed.withColumn("_shard", shard).select(*keep, F.col("_shard").cast("int").alias("shard"), (F.col("rank") - start).cast("long").alias("slot"))


def sharded(docs: DataFrame, *, shards: int = 24, seed: int = 17) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``. Rows are numbered once, ranked without their texts, and joined back."""
    base = stored(packed(docs, F.monotonically_increasing_id().alias("_row")), "numbered")
    rows = base.select("_row", F.col("doc.source").cast("string").alias("source"), "doc.doc_id", F.xxhash64("doc.text").alias("text_hash"))
    placed = assign(rows, "source", ["doc_id", "text_hash", "_row"], shards=shards, seed=seed).select(F.col("_row").alias("_placed"), "shard", "slot")
    taken = {c.lower() for c in docs.columns}

    def name(column: str) -> str:
        if column.lower() not in ("shard", "slot"):
            return column
        new = f"input_{column}"
        while new.lower() in taken:
            new += "_"
        return new

    own = [F.col("doc").getField(c).alias(name(c)) for c in docs.columns]
    return base.join(placed, F.col("_row") == F.col("_placed")).select(*own, "shard", "slot")


def light(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))


def op8_interleaved_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = assign(light(docs), "source", ["doc_id", "text_hash", "size"], shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
