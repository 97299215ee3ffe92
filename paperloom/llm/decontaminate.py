"""Benchmark decontamination by training suffix arrays (operator 4).

Documents are taken in shards of about SHARD_WORDS words. A shard's words become numbers of the
benchmark's vocabulary (0: not in it); words in runs too short for any window cannot matter and are
left out, and a suffix array is built over the rest by prefix doubling. Every suffix of every
benchmark item is then binary-searched in the shard, word by word, which gives the range of all
occurrences of its first window. Occurrences of neighbouring suffixes at neighbouring words form the
verbatim matches of an item in a document; the longest of each document is kept with its places, of
equally long ones that of the least item (as a string), then of the first word. So matches do not
depend on how rows fall into shards.

The benchmark is read in blocks of at most BLOCK_BYTES of text, one after another, each broadcast; a
larger benchmark is searched block after block over the same rows, carrying hit words along.
Documents are never shuffled, so groups of copies or frequent passages make no hot task.

Defined results: null and empty texts have no words and are clean; items without words are ignored; a
null item_id reads "null"; very long texts are read whole; repeated documents are each judged; repeated
item ids count once; an empty benchmark leaves all documents clean; no documents give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, tune

#: Lower-cases A-Z and turns every byte that ends a word into a space.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WINDOW = 13
SHARD_WORDS = 2_000_000
BLOCK_BYTES = 8 << 20
#: So many occurrences are chained at a time, but always all those of an item.
PAIRS = 4_000_000


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(WORD_BYTES).split()


class SuffixArray:
    """Suffixes of ``ids`` (numbers over 0) in order, compared up to ``depth`` words."""

    def __init__(self, ids: np.ndarray, depth: int):
        n, rank, k = len(ids), ids.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while k < depth and n:
            second = np.zeros(n, np.int64)
            second[: n - k] = rank[k:] + 1 if k < n else 0
            key = rank * (int(second.max()) + 1) + second
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank, k = new, 2 * k
            if new[order[-1]] == n - 1:
                break
        self.ids, self.order = ids, order

    def _bound(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, after: bool) -> np.ndarray:
        """First place in [lo, hi) whose word at ``depth`` is not below (or, after: is above) ``word``."""
        lo, hi, n = lo.copy(), hi.copy(), len(self.ids)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = self.order[np.where(open_, mid, 0)] + depth
            here = np.where(at < n, self.ids[np.minimum(at, n - 1)], -1)
            right = open_ & ((here <= word) if after else (here < word))
            lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        return lo

    def search(self, query: np.ndarray, starts: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with query[start : start + depth], for each start."""
        q = len(starts)
        lo, hi = np.zeros(q, np.int64), np.full(q, len(self.ids), np.int64)
        live, depth = np.arange(q), 0
        while len(live) and len(self.ids):
            word = query[starts[live] + depth]
            lo[live], hi[live] = self._bound(word, lo[live], hi[live], depth, False), self._bound(word, lo[live], hi[live], depth, True)
            depth += 1
            live = live[(lo[live] < hi[live]) & (depths[live] > depth)]
        return lo, np.maximum(lo, hi)


class Benchmark:
    """A block of items as numbers, with the suffixes to search."""

    def __init__(self, items: list[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        ids, self.starts, self.depths, self.item, self.names = [], [], [], [], []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            self.names.append("null" if item_id is None else str(item_id))
            first, n = len(ids), min(window, len(words))
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            new = range(first, len(ids) - n + 1)
            self.starts += new
            self.depths += [n] * len(new)
            self.item += [len(self.names) - 1] * len(new)
        self.ids = np.array(ids, np.int64)
        self.starts, self.depths, self.item = (np.array(x, np.int64) for x in (self.starts, self.depths, self.item))
        self.shortest = int(self.depths.min()) if len(self.depths) else window
        #: Items are searched in the order of their names, equal ones as given.
        order = np.argsort(np.array(self.names, object), kind="stable")
        self.order = np.empty(len(order), np.int64)
        self.order[order] = np.arange(len(order))

    def search(self, docs: list[np.ndarray]) -> tuple[np.ndarray, list[set], list[tuple]]:
        """Over a shard: hit flag of each word, items of each document, longest match (words, item, word) of each."""
        bounds = np.cumsum([0, *map(len, docs)])
        flat = np.concatenate([*docs, np.zeros(0, np.int64)]) if docs else np.zeros(0, np.int64)
        hit, items, best = np.zeros(len(flat) + 1, np.int64), [set() for _ in docs], [(0, None, None)] * len(docs)
        if not len(self.starts) or not len(flat):
            return hit[:-1] > 0, items, best
        # Runs of known words inside one document, at least as long as the shortest window.
        known = flat > 0
        edge = np.zeros(len(flat) + 1, bool)
        edge[bounds] = True
        new = known & (edge[:-1] | ~np.concatenate([[False], known[:-1]]))
        start = np.nonzero(new)[0]
        run = np.cumsum(new) - 1
        length = np.bincount(run[known], minlength=len(start)) if len(start) else np.zeros(0, np.int64)
        keep = known & (length[np.maximum(run, 0)] >= self.shortest) if len(start) else known
        where = np.nonzero(keep)[0]
        if not len(where):
            return hit[:-1] > 0, items, best
        # A separator that no item holds stands between runs.
        cut = np.nonzero((np.diff(where) > 1) | edge[where[1:]])[0] + 1
        sep = len(self.vocabulary) + 1
        ids, where = np.insert(flat[where], cut, sep), np.insert(where, cut, -1)
        array = SuffixArray(ids, int(self.depths.max()))
        first, last = array.search(self.ids, self.starts, self.depths)
        found = np.nonzero(last > first)[0]
        for part in self._parts(found, last - first):
            n = (last - first)[part]
            q = np.repeat(part, n)
            at = where[array.order[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[part], n)]]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + self.depths[q], -1)
            # Matches: rows of occurrences whose words and suffixes both go up by one.
            line = at - self.starts[q]
            by = np.lexsort((at, line, self.item[q]))
            q, at, line = q[by], at[by], line[by]
            new = np.ones(len(q), bool)
            new[1:] = (np.diff(self.item[q]) != 0) | (np.diff(line) != 0) | (np.diff(at) != 1)
            start = np.nonzero(new)[0]
            length = np.diff(np.append(start, len(q))) + self.depths[q[start]] - 1
            at, item = at[start], self.item[q[start]]
            doc = np.searchsorted(bounds, at, side="right") - 1
            for d, i in {(d, i) for d, i in zip(doc.tolist(), item.tolist(), strict=True)}:
                items[d].add(self.names[i])
            by = np.lexsort((at, self.order[item], -length, doc))
            for j in by[np.unique(doc[by], return_index=True)[1]].tolist():
                d = int(doc[j])
                best[d] = min(best[d], (int(length[j]), self.names[item[j]], int(at[j] - bounds[d])), key=_rank)
        return np.cumsum(hit[:-1]) > 0, items, best

    def _parts(self, found: np.ndarray, n: np.ndarray):
        """The suffixes ``found``, some items at a time, with about PAIRS occurrences."""
        if not len(found):
            return
        cut = np.nonzero(np.diff(self.item[found]))[0] + 1
        total = np.add.reduceat(n[found], np.concatenate([[0], cut]))
        part = np.cumsum(total) // PAIRS
        of = np.repeat(part, np.diff(np.concatenate([[0], cut, [len(found)]])))
        for p in np.unique(of).tolist():
            yield found[of == p]


def _rank(match: tuple):
    """Longer matches first, then the least item and word."""
    words, item, at = match
    return -words, item or "", at or 0


MARKS = [("d_words", T.LongType()), ("d_hit", T.LongType()), ("d_bits", T.BinaryType()), ("d_items", T.ArrayType(T.StringType())), ("d_longest", T.LongType()), ("d_item", T.StringType()), ("d_at", T.LongType())]
_ARROW = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64()]


def _blocks(benchmark: DataFrame, window: int):
    """The benchmark in blocks of bounded size, by hash of the item, one after another."""
    rows = benchmark.select("item_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield k == n - 1, Benchmark([tuple(r) for r in rows.filter(part == k).collect()], window)


def mark(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text", carry: bool = True) -> DataFrame:
    """The rows of ``docs`` as ``doc``, with d_words, d_hit, d_bits (hit words as packed bits), d_items, and the
    longest match: d_longest words of item d_item from word d_at on (0 and nulls if there is none).
    Without ``carry`` the text itself is null in the result."""
    spark = docs.sparkSession
    tune(spark)
    out = packed(docs)
    schema = T.StructType([*out.schema.fields, *(T.StructField(n, t) for n, t in MARKS)])
    at = docs.columns.index(text)
    for last, built in _blocks(benchmark, window):
        shared = spark.sparkContext.broadcast(built)  # a block of at most BLOCK_BYTES of text, or one longer item
        out = out.mapInArrow(_searcher(shared, schema.names, at, drop=last and not carry), schema)
    return out


def _searcher(shared, names: list[str], at: int, *, drop: bool):
    def own(batch: pa.RecordBatch) -> pa.StructArray:
        doc = batch.column(0)
        if not drop:
            return doc
        parts = [doc.field(i) for i in range(doc.type.num_fields)]
        parts[at] = pa.nulls(len(doc), parts[at].type)
        return pa.StructArray.from_arrays(parts, fields=list(doc.type))

    def search(batches):
        block, held, ids, words = shared.value, [], [], 0
        get = block.vocabulary.get

        def result():
            hit, items, best = block.search(ids)
            bounds, k = np.cumsum([0, *map(len, ids)]), 0
            for b in held:
                n = b.num_rows
                bits = [hit[bounds[j] : bounds[j + 1]] for j in range(k, k + n)]
                found, top = items[k : k + n], best[k : k + n]
                if b.num_columns > 1:  # an earlier block's marks
                    for j, (old, more, *match) in enumerate(zip(*(b.column(c).to_pylist() for c in ("d_bits", "d_items", "d_longest", "d_item", "d_at")), strict=True)):
                        bits[j] = bits[j] | np.unpackbits(np.frombuffer(old, np.uint8), count=len(bits[j])).astype(bool)
                        found[j] = found[j] | set(more)
                        top[j] = min(top[j], tuple(match), key=_rank)
                columns = [[len(x) for x in bits], [int(x.sum()) for x in bits], [np.packbits(x).tobytes() for x in bits], [sorted(x) for x in found], *zip(*top, strict=True)]
                yield pa.RecordBatch.from_arrays([own(b), *(pa.array(list(c), t) for c, t in zip(columns, _ARROW, strict=True))], names=names)
                k += n

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            for raw in b.column(0).field(at).cast(pa.large_binary()):
                w = words_of(raw.as_py())
                ids.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
                words += len(w)
            if words >= SHARD_WORDS:
                yield from result()
                held, ids, words = [], [], 0
        if held:
            yield from result()

    return search


def verdict(*, share: int = 20):
    """Contaminated: some word hit, and at least one word in ``share``."""
    return (F.col("d_hit") > 0) & (share * F.col("d_hit") >= F.col("d_words"))


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs``."""
    return mark(docs, benchmark, **options).filter(~verdict()).select("doc.*")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=False)
    return out.select(
        "doc.doc_id", F.col("d_words").alias("n_words"), F.col("d_hit").alias("n_hit"), F.size("d_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("d_items", ","), 256).alias("items_sha256"), verdict().alias("contaminated"),
        F.col("d_longest").alias("longest_words"), F.col("d_item").alias("longest_item"), F.col("d_at").alias("longest_at"),
    )


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS s, coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT s, item, i AS j, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT s, item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM q))),
o AS (SELECT p.r, p.i, p.k, q.s, q.item, q.j FROM p JOIN q ON p.k = q.k AND p.g = q.g),
h AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + k)) AS x FROM o) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n, array_to_string(list_sort(list_distinct(list(item))), ',') AS s FROM o GROUP BY r),
m AS (SELECT r, item, min(i) AS i, count(*) + min(k) - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY r, s, i - j ORDER BY i) AS run FROM o) GROUP BY r, s, item, i - j, run),
l AS (SELECT r, n, item, i FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, item, i) AS k FROM m) WHERE k = 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated,
  coalesce(l.n, 0)::BIGINT AS longest_words, l.item AS longest_item, (l.i - 1)::BIGINT AS longest_at
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN l USING (r)
"""
