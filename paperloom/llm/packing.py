"""Best-fit packing of documents into sequences (operator 13).

A document is its token ids and an end id; one longer than ``capacity`` is cut into pieces of that size, the
first of which may be shorter. Packing depends on lengths alone, so it is planned on the histogram of
lengths, which has at most ``capacity`` entries however many documents there are:

* Large lengths, above a third of the capacity, fit at most twice into a sequence. From the longest on, each
  is matched with the longest that still fits beside it: a greedy matching, which for such lengths opens as
  few sequences as possible.
* Then small lengths, from the longest on, go to the smallest gap that holds them, as often as they fit;
  where no gap does, to new sequences.

All sequences with the same content are one run of numbers, so a step moves as many documents as both the
length and the run have. The plan says for each length which ranks among the pieces of that length go to
which run; its size depends on the capacity only (at most some 100,000 rows; thousands in practice), and it
is broadcast. Pieces are ranked by range of (length, document, piece), so a length that a third of all
pieces have is split over tasks.

Defined results: a null text is empty and holds only the end id; repeated rows, equal ids and null ids are documents
each; very long texts are encoded whole; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, ranked, stored, text_chunks, tune

CAPACITY, END_ID = 2048, 0
#: Chunks of text kept with their ids for a worker's life.
CACHE_CHUNKS = 1_200_000


# Encoding -------------------------------------------------------------------------------------------


class ByteEncoder:
    """Ids of whole texts by a byte-level vocabulary whose words are a blank at most and what follows.

    Such a tokenizer never joins anything across the start of a word, so words are encoded once and kept.
    Texts of single blanks and line ends are cut by Arrow, others by a pattern; a text with other separators,
    or one of the vocabulary's special strings, is encoded whole. Words of letters and the marks after them are
    kept apart from each other.
    """

    WORDS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
    #: What Python and the tokenizer may not both take for white space.
    ODD = r"[\x1c-\x1f\x{85}\x{180e}\x{200b}\x{feff}]"
    MARKS = ".,;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([self.ODD, *special])
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for word, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(word)  # a character stands for a byte
        self.ids: dict[str, bytes] = {}
        self.line = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word. Those after a blank are encoded joined, and cut apart by the bytes of their tokens."""
        out, joined = {}, [w for w in words if w[0] == " " and not w[-1].isspace()]
        for i in range(0, len(joined), 64):
            some = joined[i : i + 64]
            ids = np.array(self.tokenizer.encode("".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(w.encode()) for w in some])) + 1
            raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            out.update((w, raw[a:b]) for w, a, b in zip(some, cuts, cuts[1:], strict=False))
        out.update((w, self._whole(w)) for w in words if w not in out)
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.ids.get, words))
        new = list({w for w, x in zip(words, found, strict=True) if x is None})
        if new:
            learned = self._learn(new)
            if len(self.ids) + len(new) <= CACHE_CHUNKS:
                self.ids.update(learned)
            found = [learned[w] if x is None else x for w, x in zip(words, found, strict=True)]
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        table = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(table, self.odd).to_numpy(zero_copy_only=False)
        rough = pc.match_substring_regex(table, r"[\p{Z}\s\x0b][\p{Z}\s\x0b]|^[\p{Z}\s\x0b]|[\p{Z}\s\x0b]$").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd):
            out[i] = self._whole(texts[i])
        for i in np.flatnonzero(rough & ~odd):
            out[i] = b"".join(self.of_words(self.WORDS.findall(texts[i])))
        smooth = ~rough & ~odd & (pc.binary_length(table).to_numpy(zero_copy_only=False) > 0)
        for i, raw in zip(np.flatnonzero(smooth), self._smooth(table.filter(pa.array(smooth))), strict=True):
            out[i] = raw
        return out

    def _smooth(self, texts: pa.Array) -> Iterator[bytes]:
        """Texts where every white space stands alone between words: words after a line end have no blank before them."""
        if not len(texts):
            return
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        coded = cut.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        starts = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        line = pc.index(words, "\n").as_py()
        bare = np.zeros(len(code), bool)
        bare[starts[:-1]] = True
        bare[1:] |= code[:-1] == line
        # Each word is encoded once for a chunk: its letters, and the marks after them, if that is all it has.
        core = pc.utf8_rtrim(words, characters=self.MARKS)
        letters = pc.match_substring_regex(core, r"^\p{L}+$")
        tail = pc.replace_substring_regex(pc.if_else(letters, words, ""), r"^\p{L}+", "").dictionary_encode()
        kind = code * 2 + bare
        used = np.flatnonzero(np.bincount(kind))
        after, alone = used[used % 2 == 0], used[used % 2 == 1]
        used = np.concatenate([after, alone])
        slot = np.full(2 * len(words), -1)
        slot[used] = np.arange(len(used))
        heads = pc.if_else(letters, core, words)
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), heads.take(pa.array(after >> 1)), pa.scalar(" ", pa.large_string()))
        raw = self.of_words(spaced.to_pylist() + heads.take(pa.array(alone >> 1)).to_pylist())
        marks = [b"" if t == "" else x for t, x in zip(tail.dictionary.to_pylist(), self.of_words([t or "." for t in tail.dictionary.to_pylist()]), strict=True)]
        ends = tail.indices.to_numpy()[used >> 1]
        raw = [x + marks[t] if marks[t] else x for x, t in zip(raw, ends.tolist(), strict=True)]
        for k in (2 * line, 2 * line + 1):
            if line >= 0 and slot[k] >= 0:
                raw[slot[k]] = self.line
        pieces = list(map(raw.__getitem__, slot[kind].tolist()))
        for a, b in itertools.pairwise(starts.tolist()):
            yield b"".join(pieces[a:b])


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian 32-bit) of all pieces of all documents."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for first, texts in text_chunks(b):
                ids = b.column("doc_id").slice(first, len(texts)).to_pylist()
                out, size = [], 0
                for doc, raw in zip(ids, encode([t.decode("utf-8", "replace") for t in texts]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    k = -(-n // capacity)
                    cuts = [0, *range(n - (k - 1) * capacity, n + 1, capacity)]
                    for i, (a, z) in enumerate(itertools.pairwise(cuts)):
                        out.append((doc, i, a, z - a, raw[4 * a : 4 * z]))
                        size += 4 * (z - a)
                        if size > CHUNK_BYTES:
                            yield _batch(out, b.schema.field("doc_id").type)
                            out, size = [], 0
                if out:
                    yield _batch(out, b.schema.field("doc_id").type)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length int, ids binary")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])


# Packing --------------------------------------------------------------------------------------------


class Gaps:
    """Runs of sequences that have the same space left: (first number, how many), by that space."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []
        self.opened = 0

    def put(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.runs:
                bisect.insort(self.sizes, gap)
                self.runs[gap] = []
            self.runs[gap].append((first, count))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A run with the smallest gap of at least ``least``: (gap, first, count)."""
        at = bisect.bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, count = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap], self.sizes[at]
        return gap, first, count

    def open(self, count: int) -> int:
        self.opened += count
        return self.opened - count


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, how many a sequence, offset there) for a count of each length."""
    left, rank, gaps = dict(histogram), dict.fromkeys(histogram, 0), Gaps()
    out: list[tuple[int, int, int, int, int, int]] = []

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        out.append((length, rank[length], n, first, each, offset))
        rank[length] += n
        left[length] -= n

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect.bisect_right(large, capacity - a) - 1
            while at >= 0 and not (left[large[at]] - (large[at] == a)) > 0:
                at -= 1
            if at < 0:
                n = left[a]
                first = gaps.open(n)
                place(a, n, first, 1, 0)
                gaps.put(capacity - a, first, n)
                continue
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            first = gaps.open(n)
            place(a, n, first, 1, 0)
            place(b, n, first, 1, a)
            gaps.put(capacity - a - b, first, n)
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            run = gaps.take(s)
            if run is None:
                count = -(-left[s] // (capacity // s))
                run = (capacity, gaps.open(count), count)
            gap, first, count = run
            each = gap // s
            full = min(count, left[s] // each)
            if full:
                place(s, full * each, first, each, capacity - gap)
                gaps.put(gap - each * s, first, full)
            if full < count:
                rest = left[s]
                if rest:  # fewer than one sequence takes
                    place(s, rest, first + full, rest, capacity - gap)
                    gaps.put(gap - rest * s, first + full, 1)
                    full += 1
                gaps.put(gap, first + full, count - full)
    return out


def packed(cut: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, start, length and more narrow columns) with sequence_id and offset."""
    spark = cut.sparkSession
    held = stored(cut, "pieces")
    order = [c for c in ("length", "doc_id", "piece", "start") if c in cut.columns]
    more = [c for c in cut.columns if c not in order]
    numbered = ranked(held, order + more)
    # One row for each length: at most ``capacity``.
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = sorted(plan(histogram, capacity))
    table = np.array(steps, np.int64).reshape(-1, 6)
    lengths = sorted(histogram)
    before = np.zeros(capacity + 2, np.int64)
    before[np.array(lengths, np.int64)] = np.cumsum([0, *(histogram[n] for n in lengths)])[:-1]
    # Steps in order of length and rank are in order of the global rank.
    begins = before[table[:, 0]] + table[:, 1]
    shared = spark.sparkContext.broadcast((table, begins))

    def run(batches):
        table, begins = shared.value
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(begins, rank, "right") - 1
            length, _, _, first, each, offset = table[at].T
            i = rank - begins[at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + i // each), pa.array(offset + i % each * length)], names=[*b.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields)
    return numbered.mapInArrow(run, f"{fields}, sequence_id long, offset long").drop("rank")


def sequences(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """sequence_id, ids (array) and the offsets where its pieces start: what a training job reads."""
    cut = pieces(docs, tokenizer, capacity=capacity, end_id=end_id)
    placed = packed(cut, capacity=capacity)
    kind = "sequence_id long, ids array<int>, offsets array<int>"
    dealt = placed.select("sequence_id", "offset", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")

    def run(batches):
        now, raw, offsets = None, b"", []

        def batch():
            ids = np.frombuffer(raw, "<u4").astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([offsets], pa.list_(pa.int32()))], names=["sequence_id", "ids", "offsets"])

        for b in batches:
            for s, offset, ids in zip(*(b.column(n).to_pylist() for n in ("sequence_id", "offset", "ids")), strict=True):
                if s != now:
                    if now is not None:
                        yield batch()
                    now, raw, offsets = s, b"", []
                raw += ids
                offsets.append(offset)
        if now is not None:
            yield batch()

    return dealt.mapInArrow(run, kind)


def op13_pack(spark, sf_dir: str) -> DataFrame:
    """All documents packed; digests are taken from the ids of each piece."""
    import public_tokenizers

    cut = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    narrow = cut.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))
    return packed(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
