"""Near-duplicates by SimHash and five-word shingles of Jaccard similarity 0.8: what the near_dedup stage takes.

The stage takes operator 6's steps for its own shingles: fingerprints of the distinct texts (here of five-word shingle
sets), tables of their segments, links within RADIUS bits verified by the full distance, components, the first of each
group. At 0.8 two fingerprints of 64 bits differ in about 10 bits, with a deviation of 3, and the Hamming balls that reach
such pairs hold a share of all documents; so fingerprints alone would lose most pairs below 0.95. Their links are
therefore joined by those of minima, and an exact check of the shingle sets follows for both.

The minima meet in BANDS bands of ROWS (a pair at exactly 0.8 misses all of them once in 100,000, at 0.85 once in 30
million) and are thinned there by a sketch of one bit for each of SKETCH minima. All links are put into groups, and within
these the shingle sets decide. Texts with equal sets are one member throughout, so exact copies cost nothing.

Groups are searched by growing components: a member is compared with those not reached yet, so a
large group around one text takes few comparisons and no pair is ever written. Keys and groups above
BLOCK members are dealt as pairs of blocks, which go to different tasks.

Defined results: texts of one to five words have one shingle; texts without words have none and stay;
very long texts are read whole; repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, in_blocks, partitions, runs, stored, text_chunks, tune, whole_groups
from .components import components
from .simhash import fingerprint, first_of_each, numbered, shingle_hashes
from .simhash import links as fingerprint_links

WORDS = 5
#: Jaccard similarity as a fraction, compared in whole numbers.
SIMILARITY = (4, 5)
ROWS, BANDS = 4, 22
#: At 0.8 two sketches differ in 12.8 bits, with a deviation of 3.4; FAR is five of these above.
SKETCH, FAR = 128, 30
SEED = 42
#: Bits in which linked fingerprints differ at most; operator 6's tables find all pairs up to 5.
RADIUS = 5
BLOCK = 1024
_PARTS = [f"s{i}" for i in range(SKETCH // 64)]


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(SEED)
    return rng.randint(0, 2**32, SKETCH, dtype=np.uint32) | np.uint32(1), rng.randint(0, 2**32, SKETCH, dtype=np.uint32)


def shingles(raw: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(raw.translate(LOWER).split(), WORDS))


def minima(found: np.ndarray) -> np.ndarray:
    a, b = _factors()
    h, out = (found >> np.uint64(32)).astype(np.uint32), np.full(SKETCH, 2**32 - 1, np.uint32)
    for at in range(0, len(h), 1024):
        out = np.minimum(out, (h[at : at + 1024, None] * a + b).min(axis=0))
    return out


def marks(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``fp`` (a hash of the shingle set), ``simhash`` (its fingerprint), the band
    ``keys`` and the sketch."""
    tune(docs.sparkSession)
    rows = docs.select(*keep, "text")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", fp long, simhash long, keys array<long>, " + ", ".join(f"{c} long" for c in _PARTS)

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            fps, simhashes, keys, sketches = [], [], [], []
            for _, chunk in text_chunks(b):
                for raw in chunk:
                    found = shingles(raw)
                    fps.append(xxh64_intdigest(found.tobytes(), SEED))
                    simhashes.append(fingerprint(found))
                    low = minima(found)
                    keys.append([xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)] if len(found) else [])
                    sketches.append(np.packbits((low * np.uint32(0x9E3779B1)) >> np.uint32(31) != 0).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.array(np.array([k for ks in keys for k in ks], np.uint64).view(np.int64))
            sketch = np.array(sketches, np.int64).reshape(-1, len(_PARTS))
            cols = [*(b.column(c) for c in keep), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, simhashes)), pa.ListArray.from_arrays(pa.array(ends), flat), *(pa.array(np.ascontiguousarray(s)) for s in sketch.T)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "fp", "simhash", "keys", *_PARTS])

    return rows.mapInArrow(run, schema)


def _hot(rows: DataFrame, key: str) -> DataFrame:
    """(key, blocks) of the keys of more than BLOCK ``rows``."""
    return rows.groupBy(key).count().filter(F.col("count") > BLOCK).select(key, F.ceil(F.col("count") / BLOCK).alias("blocks"))


def _grown(n: int, near) -> list[tuple[int, int]]:
    """Links that span the components of 0..n-1, where ``near(i, left)`` tells which of ``left`` are near i."""
    left, out = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            reached = left[hit].tolist()
            out += [(i, j) for j in reached]
            queue += reached
            left = left[~hit]
    return out


def _sketch_links(sketch: np.ndarray) -> list[tuple[int, int]]:
    return _grown(len(sketch), lambda i, left: np.bitwise_count(sketch[left] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= FAR)


def set_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of all pairs of ``sets`` whose Jaccard similarity is SIMILARITY or more."""
    size = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    of = np.split(ids, np.cumsum(size)[:-1])
    mark, now = np.zeros(len(ids) + 1, bool), {"left": np.zeros(0, np.int64)}
    num, den = SIMILARITY

    def near(i, left):
        # The ids of the members left are laid out anew when half of them are gone.
        if not 2 * len(left) >= len(now["left"]) > 0:
            now.update(left=left, flat=np.concatenate([of[j] for j in left.tolist()]), starts=np.concatenate([[0], np.cumsum(size[left])[:-1]]))
        mark[of[i]] = True
        common = np.add.reduceat(mark[now["flat"]], now["starts"], dtype=np.int64)[np.searchsorted(now["left"], left)]
        mark[of[i]] = False
        return den * common >= num * (size[i] + size[left] - common)

    return _grown(len(sets), near)


def _spanning(links: list[tuple[int, int]], fp: np.ndarray) -> set[tuple[int, int]]:
    return {(int(fp[i]), int(fp[j])) for i, j in links}


def _batch(links) -> pa.RecordBatch:
    got = np.array(sorted(links), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])


def distinct_sets(marked: DataFrame) -> DataFrame:
    """A row for each ``fp`` of ``marked`` that has shingles."""
    return stored(marked.filter(F.size("keys") > 0).select("fp", "simhash", "keys", *_PARTS).dropDuplicates(["fp"]), "sketches")


def simhash_candidates(one: DataFrame) -> DataFrame:
    """Links (a, b) between ``fp`` that join those whose fingerprints are within RADIUS bits, by operator 6's tables.

    Of the ``fp`` with one fingerprint the least stands for all."""
    least = stored(one.groupBy("simhash").agg(F.min("fp").alias("least")), "fingerprints")
    same = one.join(least, "simhash").filter("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    near = fingerprint_links(least.select(F.col("simhash").alias("fp")), radius=RADIUS)
    a, b = (least.select(F.col("simhash").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
    return same.unionByName(near.join(a, "a").join(b, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))


def candidates(one: DataFrame) -> DataFrame:
    """Links (a, b) between ``fp`` that share a band and have near sketches."""
    spark = one.sparkSession
    rows = one.select("fp", F.explode("keys").alias("key"), *_PARTS)

    def meet(batches):
        for group in whole_groups(batches, ["key", "pair"]):
            fp, sketch = group["fp"], np.stack([group[c] for c in _PARTS], axis=1).view(np.uint64)
            a, b = runs(group["key"], group["pair"])
            two = a[b - a == 2]
            two = two[np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(axis=1, dtype=np.int64) <= FAR]
            out = set(zip(fp[two].tolist(), fp[two + 1].tolist(), strict=True))
            for s, e in zip(a[b - a > 2].tolist(), b[b - a > 2].tolist(), strict=True):
                out |= _spanning(_sketch_links(sketch[s:e]), fp[s:e])
            yield _batch(out)

    dealt = in_blocks(rows, "key", F.xxhash64("fp"), _hot(rows, "key")).select("key", "pair", "fp", *_PARTS)
    return dealt.repartition(partitions(spark), "key", "pair").sortWithinPartitions("key", "pair", "fp").mapInArrow(meet, "a long, b long")


def links(light: DataFrame, marked: DataFrame) -> DataFrame:
    """Links (a, b) between the ``fp`` of ``marked`` whose shingle sets are similar; ``light`` holds _row and text."""
    spark = light.sparkSession
    one = distinct_sets(marked)
    near = components(simhash_candidates(one).unionByName(candidates(one)))
    first = marked.groupBy("fp").agg(F.min("_row").alias("_at"))
    members = stored(first.join(near, F.col("fp") == F.col("node")).select("fp", "_at", "root"), "members")
    dealt = in_blocks(members, "root", F.xxhash64("fp"), _hot(members, "root")).select("root", "pair", "fp", "_at")
    texts = light.select("_row", "text").join(dealt, F.col("_row") == F.col("_at"))

    def verify(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("root", "pair", "fp", "text")), strict=True))
        for _, group in groupby(rows, key=lambda r: r[:2]):
            fps, sets = [], []
            for _, _, fp, text in group:
                fps.append(fp)
                sets.append(shingles((text or "").encode()))
            yield _batch(_spanning(set_links(sets), np.array(fps, np.int64)))

    dealt = texts.select("root", "pair", "fp", "text").repartition(partitions(spark), "root", "pair").sortWithinPartitions("root", "pair", "fp")
    return dealt.mapInArrow(verify, "a long, b long")


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, as ``simhash.first_of_each`` chooses it; columns of ``docs``."""
    base = numbered(docs)
    light = base.select("doc.doc_id", "_row", "doc.text")
    marked = stored(marks(light, ["doc_id", "_row"]), "marked")
    return first_of_each(base, marked, components(links(light, marked)))
