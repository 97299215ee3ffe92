"""What several operators need: the checkpoint folder, and joins on keys that many rows have."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that meet in one piece of work: two blocks of so many at most.
BLOCK_ROWS = 1000


def ensure_checkpoint_dir(spark) -> None:
    """The cluster's shared folder; a temporary one where none is set and the master is local."""
    if spark.sparkContext.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        shared = "file://" + tempfile.mkdtemp()
    spark.sparkContext.setCheckpointDir(shared)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once below the checkpoint folder and read again: cuts the plan and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made_once(rows: DataFrame, raw: str, made: Column, name: str) -> DataFrame:
    """``rows`` with a column ``name``, ``made`` of the column ``raw`` once for each of its values (none for null)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.select(raw).filter(F.col(raw).isNotNull()).distinct().repartition(parts, raw)
    return rows.join(stored(values.withColumn(name, made)), raw, "left")


def blocks_of(rows: DataFrame, *key: str) -> DataFrame:
    """(key, blocks) of the keys with more than BLOCK_ROWS rows."""
    load = rows.groupBy(*key).agg(F.count("*").alias("load")).filter(F.col("load") > BLOCK_ROWS)
    return load.select(*key, F.ceil(F.col("load") / BLOCK_ROWS).alias("blocks"))


def pairs_by_key(rows: DataFrame, key: str, id: str) -> DataFrame:
    """All pairs of rows with one ``key``, columns suffixed _i and _j, id_i < id_j.

    A row of a key with many rows belongs to one of its blocks, and goes to every pair of blocks that holds
    its own: two rows meet at one pair of blocks (of one block: at that block with itself).
    """
    zero, hot = F.lit(0).cast("long"), stored(blocks_of(rows, key))
    if hot.isEmpty():
        other = [c for c in rows.columns if c != key]
        a, b = (rows.select(key, *[F.col(c).alias(f"{c}_{s}") for c in other]) for s in "ij")
        return a.join(b, key).filter(F.col(f"{id}_i") < F.col(f"{id}_j"))
    dealt = rows.join(hot, key, "left").withColumn("own", F.pmod(F.xxhash64(id), F.col("blocks")))
    met = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda o: F.least(o, F.col("own")) * F.col("blocks") + F.greatest(o, F.col("own")) + 1)
    dealt = dealt.withColumn("cell", F.explode(F.when(F.col("blocks").isNull(), F.array(zero)).otherwise(met)))
    other = [c for c in rows.columns if c != key]
    a, b = (dealt.select(key, "cell", *[F.col(c).alias(f"{c}_{s}") for c in other], F.col("own").alias(f"own_{s}"), "blocks") for s in "ij")
    # Rows of one block meet at every pair that holds it; they count at the pair of that block with itself.
    itself = F.col("cell") == F.col("own_i") * (F.col("blocks") + 1) + 1
    once = F.col("blocks").isNull() | (F.col("own_i") != F.col("own_j")) | itself
    return a.join(b.drop("blocks"), [key, "cell"]).filter(F.col(f"{id}_i") < F.col(f"{id}_j")).filter(once).drop("cell", "own_i", "own_j", "blocks")


def dealt_to_blocks(rows: DataFrame, hot: DataFrame, *key: str) -> DataFrame:
    """``rows`` with the ``cell`` (0 for other keys) that each row of a ``hot`` key is dealt to."""
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in key]), F.col("blocks"))
    return rows.join(hot, list(key), "left").withColumn("cell", F.coalesce(spread, F.lit(0).cast("long"))).drop("blocks")


def every_cell(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``blocks``, null for keys that are not hot), each once for every ``cell`` of its key."""
    zero = F.lit(0).cast("long")
    every = F.when(F.col("blocks").isNull(), F.array(zero)).otherwise(F.sequence(zero, F.col("blocks") - 1))
    return rows.withColumn("cell", F.explode(every)).drop("blocks")


def join_spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` joined with ``right`` on a key of which the right side may have many rows: those are dealt to blocks."""
    hot = stored(blocks_of(right, key))
    if hot.isEmpty():
        return left.join(right, key)
    return every_cell(left.join(hot, key, "left")).join(dealt_to_blocks(right, hot, key), [key, "cell"]).drop("cell")
