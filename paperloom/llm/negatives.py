"""Hard negatives of anchor vectors by blocked dense products (operator 11).

Vectors become integers, floor(scale * x) of each component, so scores are exact inner products. Anchors
are numbered in the order of their id and taken in blocks of at most BLOCK_BYTES, the only thing that is
broadcast. For each block two passes go over all candidates, whose Arrow batches are gathered to dense
blocks and multiplied with the anchors in float64. That is exact while length * max|a| * max|c| is below
2^53; a pair of blocks above that is multiplied in Python integers instead.

* First pass: the best ``positives`` rows of the anchor's label. Each task keeps a list of that length for
  each anchor, lists of tasks merge by a top-k window.
* Second pass: for each positive the best ``negatives`` rows of other labels whose score is between the
  shares ``low`` and ``high`` (percent) of the positive's score, kept and merged in the same way.

Higher scores come first, then smaller ids. What a task emits and the driver sees is bounded by the block.
Labels, which may be skewed, deal nothing out: every task has whole candidate blocks.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; vectors
of different lengths never meet, empty ones score 0; a repeated id is a candidate as often as it occurs, and
each of its rows an anchor of its own, but no row serves an anchor of the same id; a score outside 64 bits
raises; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, stored, tune

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256.0, 5, 3, 50, 95
#: Anchors of one pass, as float64; dense blocks of candidates; anchors multiplied with one of those at once.
BLOCK_BYTES, CANDIDATES, ANCHORS = 8 << 20, 4096, 512
EXACT = 2**53


def dense(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row number, id, label, integer vectors as float64) of a batch's complete rows, one set for each length of vectors."""
    vectors = batch.column("vector")
    flat = vectors.flatten()
    lens = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lens)
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    whole = bad[ends] == bad[ends - lens]
    for c in ("id", "label", "vector"):
        whole &= batch.column(c).is_valid().to_numpy(zero_copy_only=False)
    ids, labels = (pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
    for n in np.unique(lens[whole]):
        rows = np.nonzero(whole & (lens == n))[0]
        at = (ends[rows] - n)[:, None] + np.arange(n)
        yield rows, ids[rows], labels[rows], np.floor(scale * values[at])


def gathered(batches, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, label, vectors) blocks of about CANDIDATES rows of one length, sorted by id."""
    held: dict[int, list] = {}
    count: dict[int, int] = {}

    def block(n):
        ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(n), strict=True))
        del count[n]
        order = np.argsort(ids, kind="stable")
        return ids[order], labels[order], x[order]

    for b in batches:
        for _, *rows in dense(b, scale):
            n = rows[2].shape[1]
            held.setdefault(n, []).append(rows)
            count[n] = count.get(n, 0) + len(rows[0])
            if count[n] >= CANDIDATES:
                yield block(n)
            elif sum(count.values()) >= 4 * CANDIDATES:  # many lengths
                yield block(max(count, key=count.get))
    for n in list(held):
        yield block(n)


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: int64."""
    if not a.shape[1]:
        return np.zeros((len(a), len(c)), np.int64)
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(c).max()) < EXACT:
        return (a @ c.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object)
    return (whole(a) @ whole(c).T).astype(np.int64)  # raises beyond 64 bits


class Best:
    """For each of n lists its k best (score, id): higher scores first, then smaller ids."""

    NONE = np.iinfo(np.int64).min

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), self.NONE), np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros((n, k), bool)

    def add(self, lists: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Offer row i of ``scores``, where allowed, to list lists[i]; ``ids`` (of the columns) ascend."""
        k = self.score.shape[1]
        # The last of a full list must be beaten, or met by a smaller id.
        rows = np.nonzero((allowed & ((scores >= self.score[lists, -1][:, None]) | ~self.full[lists, -1][:, None])).any(1))[0]
        if not len(rows):
            return
        left, ok, lists = scores[rows], allowed[rows], lists[rows]
        new = [(self.score[lists], self.id[lists], self.full[lists])]
        left = np.where(ok, left, self.NONE)
        every = np.arange(len(rows))
        for _ in range(min(k, left.shape[1])):
            j = left.argmax(1)  # the first of equal ones has the smallest id
            new.append((left[every, j][:, None], ids[j][:, None], ok[every, j][:, None]))
            left[every, j] = self.NONE
            ok[every, j] = False
        score, at, full = (np.concatenate(c, 1) for c in zip(*new, strict=True))
        order = np.lexsort((at, ~score, ~full), axis=1)[:, :k]
        self.score[lists], self.id[lists], self.full[lists] = (np.take_along_axis(x, order, 1) for x in (score, at, full))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of all entries."""
        where = np.nonzero(self.full)
        return where[0], self.score[where], self.id[where]


def _top(found: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k best of each key, numbered from 1, out of the lists of all tasks."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(anchors: DataFrame, scale: float) -> Iterator[list[tuple]]:
    """The anchors, block by block: (anchor number, id, label, vectors) for each length."""
    numbered = stored(ranked(anchors, ["id", "label"]), "anchors")
    n, widest = numbered.agg(F.count("*"), F.max(F.size("vector"))).first()
    size = max(1, BLOCK_BYTES // (8 * max(1, widest or 1)))
    for first in range(0, n, size):
        block = numbered.filter(F.col("rank").between(first, first + size - 1)).toArrow()
        out = []
        for b in block.combine_chunks().to_batches():
            numbers = b.column("rank").to_numpy()
            out += [(numbers[rows], ids, labels, x) for rows, ids, labels, x in dense(b, scale)]
        if out:
            yield out


def mine(table: DataFrame, anchor: Column, *, id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``anchor`` holds."""
    spark = table.sparkSession
    tune(spark)
    label = F.col(label) if isinstance(label, str) else label
    rows = table.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), anchor.alias("anchor"))
    candidates = rows.select("id", "label", "vector")
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = [none]
    for block in _blocks(rows.filter("anchor AND id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select("id", "label", "vector"), scale):
        first = min(int(numbers.min()) for numbers, *_ in block)
        count = max(int(numbers.max()) for numbers, *_ in block) - first + 1
        shared = spark.sparkContext.broadcast(block)
        found = candidates.mapInArrow(_near(shared, first, count, scale, positives), "anchor int, score long, id long")
        best = _top(found, ["anchor"], positives).select("anchor", "rank", "score", "id").toArrow()
        # Bounded by the block: ``positives`` rows for each anchor.
        score, of = np.zeros((count, positives), np.int64), np.zeros((count, positives), np.int64)
        known = np.zeros((count, positives), bool)
        a, k = best.column("anchor").to_numpy(), best.column("rank").to_numpy() - 1
        score[a, k], of[a, k], known[a, k] = best.column("score").to_numpy(), best.column("id").to_numpy(), True
        sent = spark.sparkContext.broadcast((score, known))
        found = candidates.mapInArrow(_window(shared, sent, first, count, scale, negatives, low, high), "anchor int, positive int, score long, id long")
        hits = _top(found, ["anchor", "positive"], negatives)
        ids = np.zeros(count, np.int64)
        for numbers, own, _, _ in block:
            ids[numbers - first] = own
        pairs = pa.table({"anchor": pa.array(a, pa.int32()), "positive": pa.array(k, pa.int32()), "anchor_id": ids[a], "positive_id": of[a, k], "positive_score": score[a, k]})
        named = hits.join(F.broadcast(spark.createDataFrame(pairs)), ["anchor", "positive"])  # of one block
        out.append(stored(named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    return reduce(DataFrame.unionByName, out)


def _near(shared, first: int, count: int, scale: float, k: int):
    def run(batches):
        best = Best(count, k)
        for ids, labels, x in gathered(batches, scale):
            for numbers, own, mine, a in shared.value:
                if a.shape[1] != x.shape[1]:
                    continue
                for i in range(0, len(a), ANCHORS):
                    s = slice(i, i + ANCHORS)
                    allowed = (mine[s][:, None] == labels) & (own[s][:, None] != ids)
                    best.add(numbers[s] - first, products(a[s], x), allowed, ids)
        anchor, score, at = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int32()), pa.array(score), pa.array(at)], names=["anchor", "score", "id"])

    return run


def _window(shared, sent, first: int, count: int, scale: float, k: int, low: int, high: int):
    def run(batches):
        positive, known = sent.value
        n = positive.shape[1]
        best = [Best(count, k) for _ in range(n)]
        least, most = -(-low * positive.astype(object) // 100), positive.astype(object) * high // 100  # Python integers: no overflow
        least, most = least.astype(np.int64), most.astype(np.int64)
        for ids, labels, x in gathered(batches, scale):
            for numbers, own, mine, a in shared.value:
                if a.shape[1] != x.shape[1]:
                    continue
                for i in range(0, len(a), ANCHORS):
                    s = slice(i, i + ANCHORS)
                    lists = numbers[s] - first
                    scores, other = products(a[s], x), (mine[s][:, None] != labels) & (own[s][:, None] != ids)
                    for p in range(n):
                        allowed = other & known[lists, p][:, None] & (scores >= least[lists, p][:, None]) & (scores <= most[lists, p][:, None])
                        best[p].add(lists, scores, allowed, ids)
        for p in range(n):
            anchor, score, at = best[p].rows()
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int32()), pa.array(np.full(len(anchor), p, np.int32)), pa.array(score), pa.array(at)], names=["anchor", "positive", "score", "id"])

    return run


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; labels of ids divisible by 7 are moved on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, label=label)


OP11_SQL = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, list_dot_product(a.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score FROM v a JOIN v c ON a.id % 50 = 0 AND a.id <> c.id AND len(a.x) = len(c.x)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS r
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, r::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3"""
