"""Substring dedup by prefix-partitioned suffix trees (operator 7).

A window of ``window`` words goes if its word sequence also starts in a document with a smaller id.

1. Copies. Equal texts are one text, whose id is their least; all windows of the others go at once.
2. Anchors. The least hash among the ``GRAM``-word grams of a window is its anchor; equal windows have
   equal anchors. A count over (anchor, text) finds the anchors of two texts or more; all other windows
   are unique and their suffixes are left out. The shared anchors go into a filter of bounded size
   (FILTER_BITS; with more anchors the next steps run once for each part of them), whose false alarms
   cost work and change nothing.
3. Suffixes. The rest is written as one row for each suffix: its path labels, hashes of its first words
   at DEPTHS and at the window, the word before it, text and place. Shipping the words themselves would
   take ``window`` words a suffix, many times the input.
4. Groups. Suffixes are dealt by a prefix of variable length: the shortest of DEPTHS at which no more
   than GROUP_ROWS suffixes share it, else the window. Each task reads its groups one after another,
   sorted by path labels, so neighbours in a group are neighbours in its subtree. Internal nodes of the
   window's depth whose leaves lie in several texts are the repeats; their leaves in all but the text
   with the least id are reported. A node that alone exceeds a group is never gathered: its least id
   and its number of leaves are aggregated and joined.
5. The places meet their documents again, whose covered words are removed.

Repeats. ``repeats`` follows the nodes of a text from one start to the next: as long as the next node has
the same occurrences, one word to the right, the repeat is a word longer. Each such row of nodes is one
repeat with its length and places; no word can be added to it without changing where its windows occur.
A passage of which a part occurs in more places is given as several of them.

Path labels are 64-bit hashes, two for a window. Defined results: null text has no words; rows without
a doc_id are neither source nor target; repeated rows (and rows of equal id) do not affect one another;
texts below the window keep all words; very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, runs, sized, stored, text_chunks, tune, whole_groups

WINDOW = 50
GRAM = 16
#: Prefix lengths by which suffixes may be dealt; those below the window are used.
DEPTHS = (8, 16, 32)
GROUP_ROWS = 250_000
FILTER_BITS = 1 << 28
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


class _Hashes(dict):
    """Word hashes, kept for the first words that a worker meets."""

    def __missing__(self, word):
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


_hashes = _Hashes()
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


class Chunk:
    """Word hashes of some texts in a row, and hashes of their grams by differences of one running sum."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.lens = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for s in split for w in s]
        n = len(words)
        values = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n) * _power(_BASE, n)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        self.n, self.ends = n, np.cumsum(self.lens)

    def grams(self, length: int, shift: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from i + shift on, for every i for which they exist."""
        m = max(0, self.n - length - shift + 1)
        x = (self.sum[shift + length : shift + length + m] - self.sum[shift : shift + m]) * _power(_BACK, shift + m)[shift:]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    def windows(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, document and anchor of every window."""
        if self.n < window:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        g, k = self.grams(gram), window - gram + 1
        padded = np.full(-(-len(g) // k) * k, np.uint64(2**64 - 1))
        padded[: len(g)] = g
        rows = padded.reshape(-1, k)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        m = self.n - window + 1
        least = np.minimum(behind[:m], ahead[k - 1 : k - 1 + m])
        doc = np.repeat(np.arange(len(self.lens)), self.lens)
        inside = doc[:m] == doc[window - 1 :]
        start = np.nonzero(inside)[0]
        return start, doc[:m][inside], least[inside]


def _chunks(batch: pa.RecordBatch):
    ids, tags, texts_of = batch.column("doc_id"), batch.column("tag").to_numpy(), batch.column("copy").to_numpy()
    for first, texts in text_chunks(batch):
        part = slice(first, first + len(texts))
        null = np.array(ids[part].is_null())
        yield Chunk(texts), ids[part].fill_null(0).to_numpy(), null, tags[part], texts_of[part]


def _light(docs: DataFrame) -> DataFrame:
    """doc_id and text, ``copy`` (equal for equal texts) and ``tag`` (31 bits of it, which tell rows of one id apart)."""
    copy = F.xxhash64("text")
    return docs.select("doc_id", "text", copy.alias("copy"), F.shiftrightunsigned(copy, 33).alias("tag"))


def _copies(light: DataFrame) -> DataFrame:
    """(doc_id, tag) of texts that a smaller id has as well."""
    rows = light.select("doc_id", "tag", "copy").filter("doc_id IS NOT NULL AND copy IS NOT NULL")
    least = rows.groupBy(F.col("copy").alias("_copy")).agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).filter("_least < _most")
    least = stored(least.drop("_most"), "copies")
    return rows.join(sized(least), F.col("copy") == F.col("_copy")).filter("doc_id > _least").select("doc_id", "tag")


def _shared_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def anchors(batches):
        for b in batches:
            for chunk, _, null, _, copies in _chunks(b):
                _, doc, least = chunk.windows(window, gram)
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                new &= ~null[doc]
                doc, least = doc[new], least[new]
                yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(copies[doc])], names=["anchor", "copy"])

    rows = docs.mapInArrow(anchors, "anchor long, copy long")
    return rows.groupBy("anchor").agg(F.min("copy").alias("a"), F.max("copy").alias("b")).filter("a < b").select("anchor")


def _filter(anchors: DataFrame, bits: int) -> bytes:
    """A two-hash filter of ``bits`` bits (a power of two); pages of 4 KB are filled by the tasks."""
    both = anchors.select(F.explode(F.array(F.expr(f"anchor & {bits - 1}"), F.expr(f"shiftrightunsigned(anchor, 32) & {bits - 1}"))).alias("bit"))
    paged = both.select(F.expr("bit div 32768").alias("page"), (F.col("bit") % 32768).alias("bit")).repartition(partitions(anchors.sparkSession), "page")

    def fill(batches):
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            page, bit = b.column("page").to_numpy(), b.column("bit").to_numpy()
            for p in np.unique(page).tolist():
                pages.setdefault(p, np.zeros(32768, bool))[bit[page == p]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array([np.packbits(x).tobytes() for x in pages.values()], pa.binary())], names=["page", "bytes"])

    out = bytearray(max(bits // 8, 4096))
    for r in paged.mapInArrow(fill, "page long, bytes binary").collect():  # FILTER_BITS / 8 bytes at most
        out[r["page"] * 4096 : r["page"] * 4096 + 4096] = r["bytes"]
    return bytes(out)


def _parts(window: int) -> list[tuple[int, int]]:
    """The word ranges whose hashes are a suffix's path labels, from depth to depth."""
    depths = [0, *(d for d in DEPTHS if d < window), window]
    return list(zip(depths, depths[1:], strict=False))


def _suffixes(docs: DataFrame, anchors: bytes, bits: int, parts: int, part: int, window: int, gram: int) -> DataFrame:
    ranges = _parts(window)
    names = [*(f"p{i}" for i in range(len(ranges))), "doc_id", "place"]

    def rows(batches):
        table = np.frombuffer(anchors, np.uint8)

        def has(at):
            return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1

        for b in batches:
            for chunk, ids, null, tags, _ in _chunks(b):
                start, doc, least = chunk.windows(window, gram)
                a = least.view(np.int64)
                keep = (has(a & (bits - 1)) & has((least >> np.uint64(32)).astype(np.int64) & (bits - 1))).astype(bool) & ~null[doc]
                if parts > 1:
                    keep &= (least % np.uint64(parts)).astype(np.int64) == part
                start, doc = start[keep], doc[keep]
                place = start - (chunk.ends - chunk.lens)[doc] + (tags[doc].astype(np.int64) << 32)
                labels = [chunk.grams(hi - lo, lo)[start].view(np.int64) for lo, hi in ranges]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*labels, ids[doc], place)], names=names)

    return docs.mapInArrow(rows, ", ".join(f"{n} long" for n in names))


def _grouped(suffixes: DataFrame, labels: list[str], group_rows: int) -> DataFrame:
    """``suffixes`` with ``g``: the group of the shortest prefix that fits, up to the whole window.

    Prefixes are counted in buckets of their hashes, so the counts are few; those of a bucket that is
    too large are told apart by the next label. Groups of whole windows may still be too large.
    """
    buckets = max(16, 16 * suffixes.count() // group_rows)
    rows = suffixes.withColumn("g", F.pmod(F.xxhash64(labels[0]), F.lit(buckets)))
    for i in range(1, len(labels)):
        large = stored(rows.groupBy("g").count().filter(F.col("count") > group_rows).select(F.col("g").alias("_g")), "large")
        if large.limit(1).count() == 0:
            break
        longer = F.pmod(F.xxhash64(*labels[: i + 1]), F.lit(buckets)) + i * buckets
        rows = rows.join(sized(large), F.col("g") == F.col("_g"), "left").withColumn("g", F.when(F.col("_g").isNull(), F.col("g")).otherwise(longer)).drop("_g")
    return rows


def _nodes(suffixes: DataFrame, window: int, group_rows: int, least_only: bool) -> DataFrame:
    """(doc_id, place, least, n, node) of the leaves of the window's nodes, ``least`` being the smallest id of a node
    and ``n`` its leaves. With ``least_only`` those of greater ids, else those of nodes with several texts."""
    labels = [f"p{i}" for i in range(len(_parts(window)))]
    rows = _grouped(suffixes, labels, group_rows)
    # Nodes of more leaves than a group may have are aggregated, not gathered.
    tag = F.shiftright("place", 32)
    sums = [F.min("doc_id").alias("least"), F.count("*").alias("n"), (F.min(tag) != F.max(tag)).alias("several")]
    large = rows.groupBy("g").count().filter(F.col("count") > group_rows).select(F.col("g").alias("_g"))
    large = stored(large, "large")
    schema = "doc_id long, place long, least long, n long, node long"
    out = None
    if large.limit(1).count():
        whole = rows.join(sized(large), F.col("g") == F.col("_g"), "left_semi").groupBy(*labels).agg(*sums).filter(F.col("n") > group_rows)
        whole = stored(whole, "nodes")
        side = sized(whole.select(*(F.col(c).alias(f"_{c}") for c in labels), "least", "n", "several"))
        same = [F.col(c) == F.col(f"_{c}") for c in labels]
        out = rows.join(side, same).filter("doc_id > least" if least_only else "several")
        out = out.select("doc_id", "place", "least", "n", F.xxhash64(*labels).alias("node"))
        rows = rows.join(side, same, "left_anti")

    def subtrees(batches):
        for group in whole_groups(batches, ["g"]):
            doc, place = group["doc_id"], group["place"]
            start, end = runs(group["g"], group["p0"], group["node"])
            size = end - start
            least, n = np.repeat(doc[start], size), np.repeat(size, size)
            if least_only:
                keep = doc > least
            else:
                tag = place >> 32
                keep = np.repeat(np.minimum.reduceat(tag, start) != np.maximum.reduceat(tag, start), size)
            node = np.repeat(group["node"][start], size)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[keep])) for x in (doc, place, least, n, node)], names=["doc_id", "place", "least", "n", "node"])

    # Behind the prefix of its group a suffix needs its first label and one hash of all: two for a window.
    light = rows.select("g", "p0", F.xxhash64(*labels).alias("node"), "doc_id", "place")
    dealt = light.repartition(partitions(suffixes.sparkSession), "g").sortWithinPartitions("g", "p0", "node", "doc_id", "place")
    found = dealt.mapInArrow(subtrees, schema)
    return found if out is None else found.unionByName(out)


def _leaves(light: DataFrame, *, window: int, gram: int, group_rows: int, filter_bits: int, least_only: bool) -> DataFrame:
    anchors = stored(_shared_anchors(light, window, gram), "anchors")
    count = anchors.count()
    bits = min(filter_bits, max(1 << 15, 1 << (32 * count).bit_length()))
    parts = max(1, -(-32 * count // (2 * filter_bits)))
    found = None
    for part in range(parts):
        own = anchors if parts == 1 else anchors.filter(F.expr(f"pmod(pmod(anchor, {parts}) + if(anchor < 0, {2**64 % parts}, 0), {parts}) = {part}"))
        suffixes = stored(_suffixes(light, _filter(own, bits), bits, parts, part, window, gram), "suffixes")
        some = _nodes(suffixes, window, group_rows, least_only)
        found = some if found is None else found.unionByName(some)
    return found


def _of_place(found: DataFrame) -> list:
    return [F.col("doc_id"), F.shiftright("place", 32).alias("tag"), (F.col("place") % (1 << 32)).cast("int").alias("start")]


def repeated(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, tag, starts): the repeated windows of each document that has some; -1 stands for all of them."""
    tune(docs.sparkSession)
    light = _light(docs)
    found = _leaves(light, window=window, gram=gram, group_rows=group_rows, filter_bits=filter_bits, least_only=True)
    copies = _copies(light).withColumn("start", F.lit(-1))
    return found.select(*_of_place(found)).unionByName(copies).groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts"))


def repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(repeat, length, n_places, doc_id, tag, start): each repeat between distinct texts once for each of its places.

    ``repeat`` names it, ``length`` is its words. Equal texts have equal places.
    """
    tune(docs.sparkSession)
    leaves = _leaves(_light(docs), window=window, gram=gram, group_rows=group_rows, filter_bits=filter_bits, least_only=False)
    leaves = stored(leaves.select(*_of_place(leaves), "node", "n"), "leaves")
    order = Window.partitionBy("doc_id", "tag").orderBy("start")
    before = lambda c: F.when(F.lag("start").over(order) == F.col("start") - 1, F.lag(c).over(order))
    steps = leaves.withColumns({"from": before("node"), "from_n": before("n")})
    # A step keeps all occurrences if it is taken as often as both of its nodes occur.
    kept = steps.filter(F.col("from_n") == F.col("n")).groupBy("from", "node").agg(F.count("*").alias("taken"), F.max("n").alias("n")).filter("taken = n")
    kept = kept.select(F.col("from").alias("_from"), F.col("node").alias("_node"))
    rows = steps.join(kept, (F.col("from") == F.col("_from")) & (F.col("node") == F.col("_node")), "left").withColumn("new", F.col("_node").isNull().cast("long"))
    rows = rows.withColumn("run", F.sum("new").over(order))
    first = F.struct("start", "node", "n")
    whole = rows.groupBy("doc_id", "tag", "run").agg(F.min(first).alias("f"), (F.count("*") + window - 1).alias("length"))
    return whole.select(F.col("f.node").alias("repeat"), "length", F.col("f.n").alias("n_places"), "doc_id", "tag", F.col("f.start").alias("start"))


def removed(docs: DataFrame, *, window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of each document."""
    rows = _light(docs).drop("copy")
    spans = repeated(docs, window=window, **options).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "starts")
    joined = rows.join(spans, (F.col("doc_id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select("doc_id", "text", "starts")

    def cut(batches):
        for b in batches:
            starts, words, gone, kept = b.column("starts"), [], [], []
            for first, texts in text_chunks(b):
                for i, raw in enumerate(texts, first):
                    w = raw.split()
                    words.append(len(w))
                    at = starts[i].values
                    if at is None:
                        gone.append(0)
                    else:
                        at = at.to_numpy()
                        if (at < 0).any():
                            at = np.arange(max(0, len(w) - window + 1))
                        cover = np.zeros(len(w) + 1, np.int64)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                        stay = np.cumsum(cover[:-1]) == 0
                        gone.append(int(len(w) - stay.sum()))
                        w = [x for x, s in zip(w, stay.tolist(), strict=True) if s]
                    kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    out = removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
m AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE doc_id > least),
c AS (SELECT DISTINCT r, x FROM (SELECT r, unnest(range(i, i + 50)) AS x FROM m)),
k AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM d),
s AS (SELECT k.r, string_agg(k.word, ' ' ORDER BY k.x) AS t FROM k LEFT JOIN c ON k.r = c.r AND k.x = c.x WHERE c.x IS NULL GROUP BY k.r),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(s.t, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r) LEFT JOIN n USING (r)
"""
