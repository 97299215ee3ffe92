"""Shared pieces of the training-data operators: scratch tables, word splitting, global ranks, hot keys.

Queries select the columns they need first. Operators that return whole documents hold them in one
struct column (``packed``) while they work, so no column name of the caller can clash with theirs.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of all operators but decontamination: runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Arrow batches carry this many rows at most; texts are cut into CHUNK_BYTES pieces of work after that.
BATCH_ROWS = 1000
CHUNK_BYTES = 4 << 20
#: A table of at most so many rows of two or three numbers may be broadcast.
BROADCAST_ROWS = 200_000
#: Maps A-Z to a-z and leaves every other byte, also those of UTF-8 sequences.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tune(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that Python workers hold megabytes at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``. Where that is unset, a temporary one,
    which only a local master can share; any other raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """``docs`` as one struct column ``doc``, and the columns ``more`` (of ``docs``) beside it."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), *more)


def sized(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, to be broadcast if it has at most ``rows`` rows (counted; it should be a stored table of
    few narrow columns); beyond that its join shuffles, where AQE splits hot keys."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def in_blocks(rows: DataFrame, key: str, spread: Column, hot: DataFrame) -> DataFrame:
    """``rows`` with ``block`` and ``pair`` for keys that are too hot for one task.

    ``hot`` (key, blocks) lists them. A row of such a key belongs to one of its blocks by the hash
    ``spread``, and is repeated for every pair of blocks that holds its own, so any two rows of a key
    meet at one pair at least, and the rows at a pair are those of two blocks. Rows of other keys have
    pair 0.
    """
    zero = F.lit(0).cast("long")
    listed = sized(stored(hot.select(F.col(key).alias("_hot"), F.col("blocks").cast("long").alias("_n")), "hot"))
    joined = rows.join(listed, F.col(key) == F.col("_hot"), "left").withColumn("block", F.coalesce(F.pmod(spread, F.col("_n")), zero))
    pairs = F.transform(F.sequence(zero, F.col("_n") - 1), lambda o: F.least(o, F.col("block")) * F.col("_n") + F.greatest(o, F.col("block")) + 1)
    return joined.withColumn("pair", F.explode(F.when(F.col("_n").isNull(), F.array(zero)).otherwise(pairs))).drop("_hot", "_n")


def whole_groups(batches, keys: list[str]):
    """Columns (as arrays, by name) of the batches of a partition sorted by ``keys`` (longs), cut so that no
    group of equal keys is split: memory holds a batch and the group that is still open."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(k).to_numpy() for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in last:
            new[1:] |= c[1:] != c[:-1]
        if held:
            new[0] = any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != c[0] for k, c in zip(keys, last, strict=True))
        at = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if not new.any():
            held.append(b)
            continue
        yield _columns([*held, b.slice(0, at)])
        held = [b.slice(at)]
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches([b for b in held if b.num_rows], held[0].schema)
    return {n: table.column(n).to_numpy() for n in table.column_names}


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of rows with equal ``keys``."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return start, np.append(start[1:], len(new))


def text_chunks(batch: pa.RecordBatch, column: str = "text"):
    """Cut a batch into (first row, list of UTF-8 texts) of about CHUNK_BYTES; null reads as empty."""
    values = batch.column(column).cast(pa.large_binary())
    first, chunk, size = 0, [], 0
    for i, value in enumerate(values):
        raw = value.as_py() or b""
        if chunk and size + len(raw) > CHUNK_BYTES:
            yield first, chunk
            first, chunk, size = i, [], 0
        chunk.append(raw)
        size += len(raw)
    if chunk:
        yield first, chunk


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0), on the JVM."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")).cast("long")


def ranked(df: DataFrame, order: list[str], size: str | None = None) -> DataFrame:
    """Number the rows of ``df`` from 0 in the order of ``order`` as ``rank``, without one global task.

    Rows are dealt by range and sorted per partition; the partition's row counts (one row each, so
    bounded by the number of partitions) are summed on the driver and added as offsets. With ``size``
    there is also ``before``: the sum of ``size`` over all earlier rows. The sorted rows are written
    once, so a lost executor never sees another order. Rows equal in ``order`` keep any order.
    """
    spark = df.sparkSession
    extra = [T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_sum", T.LongType())]
    schema = T.StructType([*df.schema.fields, *extra])
    at = df.columns.index(size) if size else None

    def number(batches):
        from pyspark import TaskContext

        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.num_rows
            sizes = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64) if size else np.zeros(n, np.int64)
            sums = total + np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n)), pa.array(sums)],
                names=[*b.schema.names, "_part", "_at", "_sum"],
            )
            rows, total = rows + n, total + int(sizes.sum())

    dealt = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    table = stored(dealt.mapInArrow(number, schema), "ranked")
    ends = table.groupBy("_part").agg(F.count("*").alias("n"), F.sum(size or F.lit(0)).alias("s")).collect()
    offsets, rows, total = [], 0, 0
    for r in sorted(ends, key=lambda r: r["_part"]):
        offsets.append((r["_part"], rows, total))
        rows, total = rows + r["n"], total + r["s"]
    small = spark.createDataFrame(offsets, "_part int, _rows long, _total long")
    out = table.join(F.broadcast(small), "_part")  # one row for each partition
    out = out.withColumn("rank", F.col("_rows") + F.col("_at"))
    if size:
        out = out.withColumn("before", F.col("_total") + F.col("_sum"))
    return out.drop("_part", "_at", "_sum", "_rows", "_total")
