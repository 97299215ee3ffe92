"""SimHash near-duplicates by multi-index hashing (operator 6).

A fingerprint has 64 bits in two segments of 32. Two fingerprints within ``radius`` = 4 bits agree in
one segment up to 2 bits, so each has, within one bit of its own segment value, a value that is also
within one bit of the other's: both enumerate that ball of 33 values as table keys, meet at a common
key, and the full distance is verified there. Keys meet on distinct fingerprints only; copies of a
text, or of a fingerprint, cost nothing.

Within a key, members are grouped by the bit in which they differ from it; a pair of groups is
compared only at the smaller of the keys that both share, in blocks of bounded size, and a union-find
keeps one link for each newly joined pair instead of all pairs. Keys are read one after another from
sorted partitions. A key of more than HOT_MEMBERS fingerprints, however many there are, is split into
pairs of blocks of about that size, which go to different tasks; its load is known from the counts of
the segment values around it.

Defined results: texts without words have fingerprint zero and link like any other; null doc_id never
becomes a component's id unless the component has no other; very long texts are read whole; repeated
rows return each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, in_blocks, packed, partitions, runs, sized, stored, text_chunks, tune, whole_groups
from .components import components

WORDS = 4
RADIUS = 4
SEED = 42
HOT_MEMBERS = 4096


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the 64-bit ``hashes``."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def shingle_hashes(words: list[bytes], width: int = WORDS, seed: int = SEED) -> np.ndarray:
    from xxhash import xxh64_intdigest

    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    return np.array([xxh64_intdigest(text[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprints(docs: DataFrame, *, width: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``fp``, the fingerprint as a signed long."""
    tune(docs.sparkSession)
    keep = keep or ["doc_id"]
    rows = docs.select(*[c for c in keep if c != "text"], "text")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", fp long"

    def run(batches):
        for b in batches:
            fps = [fingerprint(shingle_hashes(raw.translate(LOWER).split(), width)) for _, chunk in text_chunks(b) for raw in chunk]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[*keep, "fp"])

    return rows.mapInArrow(run, schema)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _linked(x: np.ndarray, gx: np.ndarray, y: np.ndarray, gy: np.ndarray, radius: int, size: int = 1024):
    """Pairs (i, j) within ``radius`` that are to be compared at this key, in blocks."""
    for a in range(0, len(x), size):
        for b in range(0, len(y), size):
            if y is x and b < a:
                continue
            near = np.bitwise_count(x[a : a + size, None] ^ y[None, b : b + size]) <= radius
            # Equal segments meet at their own key (group -1) only, not at those around it.
            near &= (gx[a : a + size, None] != gy[None, b : b + size]) | (gx[a : a + size, None] == -1)
            if y is x and a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            yield a + i, b + j


def _key_links(fp: np.ndarray, bit: np.ndarray, side: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that join the members of one key; with ``side`` only between the two blocks 0 and 1."""
    if len(fp) < 2 or (len(fp) == 2 and bit[0] == bit[1] != -1):
        return []
    forest, out = _Forest(len(fp)), []
    if side is None:
        parts = ((np.arange(len(fp)), None),)
    else:
        parts = ((np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]),)
    for left, right in parts:
        x, gx = fp[left], bit[left]
        y, gy, to = (x, gx, left) if right is None else (fp[right], bit[right], right)
        for i, j in _linked(x, gx, y, gy, radius):
            for p, q in zip(left[i].tolist(), to[j].tolist(), strict=True):
                if forest.join(p, q):
                    out.append((p, q))
    return out


def _hot_keys(values: DataFrame) -> DataFrame:
    """(key, blocks) of the keys around frequent segment values ``v`` that may have over HOT_MEMBERS members.

    A key has the fingerprints of 33 values; those that are not frequent add HOT_MEMBERS at most.
    """
    frequent = values.groupBy("v").count().filter(F.col("count") > HOT_MEMBERS // 33)
    bits = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(32)))
    around = frequent.select(F.explode(F.transform(bits, lambda x: F.col("v").bitwiseXOR(x))).alias("key"), "count")
    load = around.groupBy("key").agg(F.sum("count").alias("load")).filter(F.col("load") > HOT_MEMBERS)
    return load.select("key", F.ceil((F.col("load") + HOT_MEMBERS) / HOT_MEMBERS).alias("blocks"))


def links(fps: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that leave the components of all
    pairs within ``radius`` bits (at most 5) as they are."""
    spark = fps.sparkSession
    tune(spark)
    fps = stored(fps.select("fp").distinct(), "fingerprints")
    values = fps.select(F.explode(F.array(F.expr("shiftrightunsigned(fp, 32)"), F.expr("(fp & 4294967295) + 4294967296"))).alias("v"))
    balls = np.concatenate([[0], 1 << np.arange(32)]).astype(np.int64)

    def keys(batches):
        for b in batches:
            fp = b.column("fp").to_numpy()
            for own in ((fp.view(np.uint64) >> np.uint64(32)).astype(np.int64), (fp & 0xFFFFFFFF) + (1 << 32)):
                columns = [(own[:, None] ^ balls).ravel(), np.tile(np.arange(-1, 32), len(fp)), np.repeat(fp, 33)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "bit", "fp"])

    def meet(batches):
        for group in whole_groups(batches, ["key", "pair"]):
            key, pair, block, bit, fp = (group[c] for c in ("key", "pair", "block", "bit", "fp"))
            starts, ends = runs(key, pair)
            some = ends - starts > 1
            out: set[tuple[int, int]] = set()
            for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
                own = block[s:e]
                side = (own != own[0]).astype(np.int8) if pair[s] and (own != own[0]).any() else None
                members = fp[s:e].view(np.uint64)
                out.update((int(fp[s + p]), int(fp[s + q])) for p, q in _key_links(members, bit[s:e], side, radius))
            got = np.array(sorted(out), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])

    rows = fps.mapInArrow(keys, "key long, bit long, fp long")
    dealt = in_blocks(rows, "key", F.xxhash64("fp"), _hot_keys(values)).repartition(partitions(spark), "key", "pair").sortWithinPartitions("key", "pair", "fp")
    return dealt.select("key", "pair", "block", "bit", "fp").mapInArrow(meet, "a long, b long")


def placed(marked: DataFrame, roots: DataFrame, least) -> DataFrame:
    """(_fp, root, least) for each fingerprint of ``marked``: its root among ``roots`` (node, root) or itself, and
    ``least`` (an aggregate over columns of ``marked``) of all that have that root. Rows of a fingerprint are
    aggregated before anything is joined, so copies of one text make no hot key."""
    own = marked.groupBy(F.col("fp").alias("_fp")).agg(least.alias("_own"))
    named = own.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", F.coalesce("root", "_fp").alias("root"), "_own")
    named = stored(named, "roots")
    return named.join(named.groupBy("root").agg(F.min("_own").alias("least")), "root")


def groups(marked: DataFrame, *, radius: int = RADIUS, doc_id: str = "doc_id") -> DataFrame:
    """``marked`` (with fp) and ``component_id``: the least doc_id reachable over links."""
    of_root = placed(marked, components(links(marked, radius=radius)), F.min(doc_id))
    place = stored(of_root.select("_fp", F.col("least").alias("component_id")), "places")
    return marked.join(sized(place), F.col("fp") == F.col("_fp")).drop("_fp")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as ``doc`` with a number ``_row`` for each row, written once."""
    return stored(packed(docs, F.monotonically_increasing_id().alias("_row")), "numbered")


def first_of_each(base: DataFrame, marked: DataFrame, roots: DataFrame) -> DataFrame:
    """One document of each group, from ``base`` (see ``numbered``), ``marked`` (doc_id, _row, fp) and the
    ``roots`` of linked fp: that with the least doc_id (null last; of equal ids, the first row)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row"))
    best = placed(marked, roots, first).select(F.col("least._row").alias("_kept")).distinct()
    return base.join(best.hint("merge"), F.col("_row") == F.col("_kept")).select("doc.*")


def dedup(docs: DataFrame, *, width: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The documents left of groups linked by fingerprints, with the columns of ``docs``."""
    base = numbered(docs)
    marked = stored(fingerprints(base.select("doc.doc_id", "_row", "doc.text"), width=width, keep=["doc_id", "_row"]), "marked")
    return first_of_each(base, marked, components(links(marked, radius=radius)))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = stored(fingerprints(docs), "marked")
    return groups(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
