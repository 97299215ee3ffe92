"""Mixing sources to target weights (operator 9).

The rows of each source, in a seeded order, form one stream of words that is packed into blocks of
``block`` words. Every output shard draws its source counts from a multinomial whose weights are the
blocks each source still owes, so the draws add up to the targets exactly. The draws have two steps:
the driver draws the counts of at most RANGES runs of shards, and each run draws those of its own
shards in a task, from a seed of its own. The k-th slot of a source
takes block perm(k mod blocks) of epoch k div blocks, perm being a keyed Feistel permutation, and
slots meet the packed pieces of documents in a join on (source, block). The last slot of a source is
cut so that its words equal its target rounded to a word.

Targets: sources in code point order, null last, weigh 1, 2, 3, 1, ...; they share all words, and a
source stops at 3 times its own words, the excess going to the others by weight. So no block, and no
document, is used more than three times. One row per source is gathered on the driver, so sources must be
names of collections, at most some million; above BROADCAST_ROWS of them their plan is joined, not broadcast.

Defined results: a document without words (null, empty, blank) takes 0; very long texts are cut into
as many blocks as they need; repeated rows each take their own part; an empty table gives no rows;
``mixed`` returns the columns of its input, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD_GAP, n_words, packed as as_struct, partitions, ranked, stored, tune

BLOCK = 512
SLOTS_PER_SHARD = 4096
RANGES = 256
MOST = 3


def targets(sizes: dict[str | None, int], weights=(1, 2, 3), most: int = MOST) -> dict[str | None, float]:
    """Words that the mix wants of each source."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def _mix(x, key):
    """One Feistel round function: a 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _feistel(x: np.ndarray, half: int, key: int, back: bool) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for r in range(3, -1, -1) if back else range(4):
        k = np.uint64((key * 4 + r) & 0xFFFFFFFFFFFFFFFF)
        if back:
            left, right = right ^ (_mix(left, k) & mask), left
        else:
            left, right = right, left ^ (_mix(right, k) & mask)
    return (left << h) | right


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``x``; ``back`` inverts it. Values outside are walked on."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = _feistel(np.asarray(x, np.uint64), half, key, back)
    while (far := out >= np.uint64(n)).any():
        out[far] = _feistel(out[far], half, key, back)
    return out.astype(np.int64)


def plan(sizes: dict[str | None, int], *, block: int, seed: int) -> list[dict]:
    """Per source: blocks, slots, target and the cut of its last slot."""
    want, sources = targets(sizes), []
    for k, s in enumerate(sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)):
        size, key = sizes[s], zlib.crc32(f"{seed}:{s!r}".encode())
        blocks, words = -(-size // block), min(round(want[s]), MOST * size)
        epochs, rest = divmod(words, size) if size else (0, 0)
        # In the last epoch the short last block comes at slot `short`; slots before it are full.
        short, missing = (int(permute(np.array([blocks - 1]), blocks, key, back=True)[0]), blocks * block - size) if size else (0, 0)
        slots = -(-rest // block)
        if rest and short < slots:
            slots = -(-(rest + missing) // block)
        have = slots * block - (missing if slots and short < slots else 0)
        last = block - missing if slots and short == slots - 1 else block
        cut = last - (have - rest) if rest else None
        sources.append({"source": s, "k": k, "size": size, "target": want[s], "blocks": blocks, "slots": epochs * blocks + slots, "cut": cut, "key": key})
    return sources


def draw(owed: np.ndarray, size: int, rng: np.random.Generator):
    """Rows of ``size`` slots by source until nothing is owed: multinomial, never more than is still owed."""
    owed = owed.copy()
    while owed.sum() > 0:
        need, got = min(size, int(owed.sum())), np.zeros_like(owed)
        while need > got.sum():
            left = owed - got
            got += np.minimum(rng.multinomial(need - int(got.sum()), left / left.sum()), left)
        yield got
        owed -= got


def slots(spark, sources: list[dict], *, block: int, per_shard: int, seed: int) -> DataFrame:
    """Every slot as (shard, k, block, epoch, words): which block it takes and how many of its words."""
    owed = np.array([s["slots"] for s in sources], np.int64)
    shards = -(-int(owed.sum()) // per_shard)
    run = max(1, -(-shards // RANGES))
    ranges, given = [], np.zeros_like(owed)
    for i, got in enumerate(draw(owed, run * per_shard, np.random.default_rng([seed, 0]))):
        ranges.append((i, given.tolist(), got.tolist()))
        given = given + got

    def fill(batches):
        for b in batches:
            for i, given, owed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at_source = list(given)
                for j, got in enumerate(draw(np.array(owed, np.int64), per_shard, np.random.default_rng([seed, 1, i]))):
                    for k in np.nonzero(got)[0].tolist():
                        yield from of_source(i * run + j, sources[k], at_source[k], int(got[k]))
                        at_source[k] += int(got[k])

    def of_source(shard: int, s: dict, first: int, n: int):
        for at in range(first, first + n, 1 << 18):
            j = np.arange(at, min(first + n, at + (1 << 18)))
            words = np.full(len(j), block)
            if s["cut"] is not None:
                words[j == s["slots"] - 1] = s["cut"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(j), shard)), pa.array(np.full(len(j), s["k"])), pa.array(permute(j % s["blocks"], s["blocks"], s["key"])), pa.array(j // s["blocks"]), pa.array(words)],
                names=["shard", "k", "block", "epoch", "words"],
            )

    table = spark.createDataFrame(ranges, "i long, given array<long>, owed array<long>").repartition(min(partitions(spark), max(1, len(ranges))))
    return table.mapInArrow(fill, "shard long, k long, block long, epoch long, words long")


def packed(rows: DataFrame, *, block: int, per_shard: int, seed: int, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked rows with their source's plan, document pieces, slots). ``rows`` has source and size."""
    spark = rows.sparkSession
    tune(spark)
    placed = ranked(rows.withColumn("_seeded", F.xxhash64(F.lit(seed), *order)), ["source", "_seeded", *order], size="size")
    found = placed.groupBy("source").agg(F.sum("size").alias("size"), F.min("before").alias("before")).collect()  # one row per source
    sources = plan({r["source"]: r["size"] for r in found}, block=block, seed=seed)
    starts = {r["source"]: r["before"] for r in found}
    known = spark.createDataFrame([(s["source"], s["k"], s["size"], s["target"], starts[s["source"]]) for s in sources], "_source string, k long, source_size long, target double, _start long")
    known = F.broadcast(known) if len(sources) <= BROADCAST_ROWS else known.hint("merge")
    placed = placed.join(known, placed["source"].eqNullSafe(known["_source"])).withColumn("_from", F.col("before") - F.col("_start")).drop("_source", "_start", "_seeded", "before")
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(_from div {block}, (_from + size - 1) div {block})")))
    base = F.col("block") * block
    pieces = pieces.select(
        "rank", "k", "block",
        (F.greatest(base, F.col("_from")) - base).alias("lo"),
        (F.least(base + block, F.col("_from") + F.col("size")) - base).alias("hi"),
        (F.greatest(base, F.col("_from")) - F.col("_from")).alias("at"),
    )
    return placed.drop("_from"), pieces, slots(spark, sources, block=block, per_shard=per_shard, seed=seed)


def taken(rows: DataFrame, *, block: int = BLOCK, per_shard: int = SLOTS_PER_SHARD, seed: int = 29, order: list[str]) -> DataFrame:
    """``rows`` with source_size, target and the words ``taken`` of each row."""
    placed, pieces, slots_ = packed(rows, block=block, per_shard=per_shard, seed=seed, order=order)
    full = F.col("words") == block
    uses = slots_.groupBy("k", "block").agg(F.count_if(full).alias("n"), F.max(F.when(~full, F.col("words"))).alias("cut"))
    part = F.greatest(F.least("hi", F.coalesce("cut", F.lit(0).cast("long"))) - F.col("lo"), F.lit(0).cast("long"))
    # Blocks and rows grow with the corpus: neither side is broadcast, also where a small one would fit.
    got = pieces.join(uses.hint("merge"), ["k", "block"]).groupBy("rank").agg(F.sum(F.col("n") * (F.col("hi") - F.col("lo")) + part).alias("taken"))
    return placed.join(got.hint("merge"), "rank", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mixed(docs: DataFrame, *, block: int = BLOCK, per_shard: int = SLOTS_PER_SHARD, seed: int = 29) -> DataFrame:
    """The mix as documents: for each document and epoch one row with the words taken of it then.

    Same columns as ``docs``; a row whose document is taken whole keeps its text as it is, else the
    taken words are joined by single spaces. ``n_chars`` follows the text.
    """
    base = stored(as_struct(docs, F.monotonically_increasing_id().alias("_row")), "numbered")
    rows = base.select("_row", F.col("doc.source").cast("string").alias("source"), "doc.doc_id", n_words(F.col("doc.text")).alias("size"), F.xxhash64("doc.text").alias("_hash"))
    placed, pieces, slots_ = packed(rows, block=block, per_shard=per_shard, seed=seed, order=["doc_id", "_hash"])
    spans = pieces.join(slots_.hint("merge"), ["k", "block"]).filter("least(hi, words) > lo")
    spans = spans.select("rank", "epoch", F.struct("at", (F.least("hi", "words") - F.col("lo")).alias("n")).alias("s"))
    spans = spans.groupBy("rank", "epoch").agg(F.sort_array(F.collect_list("s")).alias("_spans"), F.sum("s.n").alias("_taken"))
    use = placed.join(spans, "rank").select(F.col("_row").alias("_used"), F.col("size").alias("_size"), "_taken", "_spans")
    out = base.join(use, F.col("_row") == F.col("_used")).withColumn("_words", F.array_remove(F.split("doc.text", WORD_GAP), ""))
    cut = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice("_words", (s["at"] + 1).cast("int"), s["n"].cast("int")))), " ")
    out = out.withColumn("_text", F.when(F.col("_taken") == F.col("_size"), F.col("doc.text")).otherwise(cut))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns))


def op9_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_hash"))
    return taken(rows, order=["doc_id", "_hash"]).select("doc_id", "size", "source_size", "target", "taken", "source")
