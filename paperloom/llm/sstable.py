"""Token ids in sorted-string-table shards (operator 3).

Documents are dealt by range of their id, encoded and written in order. A shard file holds

* blocks of about 64 KB: entries (shared key bytes, key suffix length, value length as varints, key
  suffix, value), the key in full at every 16th entry, then the places of those entries (64 bits each) and
  their number, so a key is found by binary search in its block; compressed with zstd;
* the sparse index: last key, offset and length of each block;
* a Bloom filter over the document keys;
* a footer: offsets of both, counts and a magic string.

A key is 0x01 and the id with flipped sign bit, big-endian (a null id: 0x00), then the entry's number
among equal ids, so that keys sort as ids do and repeated ids stay apart. A value is the ids as
little-endian 16-bit integers if all fit (flag 2), else 32-bit (flag 4).

A task names each file anew and reports it; only reported files count, so retries and lost executors
leave no duplicates. The files go through a file system chosen by the folder's URI.

Defined results: null text is empty and holds only the end id; null ids come first; among equal ids
the order is that of a hash of the text; very long texts are encoded whole, and one above a block's size has a block
of its own; extra columns are not read; an empty table gives no shards.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_dir, text_chunks, tune

MAGIC = b"PLSSTAB2"
BLOCK_BYTES, RESTART, SHARD_BYTES, BLOOM_BITS = 64 << 10, 16, 256 << 20, 10
FOOTER = struct.Struct("<QQQQQQ8s")
END_ID = 2
#: Pieces of words kept with their ids for a worker's life; further ones are encoded again in each chunk.
CACHE_WORDS = 700_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        n, at, shift = n | (x & 127) << shift, at + 1, shift + 7
        if x < 128:
            return n, at


def key_of(doc_id: int | None, tie: int = 0) -> bytes:
    return (b"\x00" + bytes(8) if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))) + struct.pack(">I", tie)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _bloom_bits(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key) | 1
    return [(a + i * b) % bits for i in range(7)]


class Writer:
    """Takes (doc_id, ids) in ascending order of doc_id and writes one shard."""

    def __init__(self, out):
        import zstandard

        self.out, self.zip, self.at = out, zstandard.ZstdCompressor(level=1), 0
        self.block, self.n, self.last, self.tie, self.size = [], 0, b"", 0, 0
        self.restarts, self.length = [], 0
        self.index, self.keys, self.docs, self.tokens = [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        prefix = key_of(doc_id)[:9]
        self.tie = self.tie + 1 if self.last[:9] == prefix else 0
        key = prefix + struct.pack(">I", self.tie)
        shared = 0 if self.n % RESTART == 0 else len(os.path.commonprefix([self.last, key]))
        wide = len(ids) and int(ids.max()) > 0xFFFF
        value = (b"\x04" if wide else b"\x02") + ids.astype("<u4" if wide else "<u2").tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        if self.n % RESTART == 0:
            self.restarts.append(self.length)
        self.block += [entry, value]
        self.length += len(entry) + len(value)
        self.size += len(value) + 12
        self.n, self.last, self.docs, self.tokens = self.n + 1, key, self.docs + 1, self.tokens + len(ids)
        self.keys.append(prefix)
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.n:
            ends = struct.pack(f"<{len(self.restarts) + 1}Q", *self.restarts, len(self.restarts))
            raw = self.zip.compress(b"".join([*self.block, ends]))
            self.out.write(raw)
            self.index.append((self.last, self.at, len(raw)))
            self.at, self.block, self.n, self.size = self.at + len(raw), [], 0, 0
            self.restarts, self.length = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for x in _bloom_bits(key, bits):
                bloom[x >> 3] |= 1 << (x & 7)
        self.out.write(index + bytes(bloom) + FOOTER.pack(self.at, len(index), bits, self.docs, self.tokens, len(self.index), MAGIC))
        self.out.close()


class Reader:
    """Reads a shard: ``get`` by binary search in the sparse index and in one block, or all in order."""

    def __init__(self, file):
        import zstandard

        self.file, self.zip = file, zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - FOOTER.size)
        at, n, self.bits, self.docs, self.tokens, blocks, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(at)
        raw = file.read(n)
        self.bloom, self.index, p = file.read((self.bits + 7) // 8), [], 0
        for _ in range(blocks):
            k, p = _read_varint(raw, p)
            key, p = raw[p : p + k], p + k
            offset, p = _read_varint(raw, p)
            length, p = _read_varint(raw, p)
            self.index.append((key, offset, length))

        self.keys = [k for k, _, _ in self.index]

    def _block(self, i: int) -> tuple[bytes, tuple[int, ...]]:
        """A block's entries, and the places of those with a key in full."""
        _, offset, length = self.index[i]
        self.file.seek(offset)
        raw = self.zip.decompress(self.file.read(length))
        (n,) = struct.unpack_from("<Q", raw, len(raw) - 8)
        at = len(raw) - 8 * (n + 1)
        return raw[:at], struct.unpack_from(f"<{n}Q", raw, at)

    @staticmethod
    def _entries(raw: bytes, p: int = 0):
        key = b""
        while p < len(raw):
            shared, p = _read_varint(raw, p)
            own, p = _read_varint(raw, p)
            n, p = _read_varint(raw, p)
            key, p = key[:shared] + raw[p : p + own], p + own
            yield key, np.frombuffer(raw, "<u2" if raw[p] == 2 else "<u4", offset=p + 1, count=(n - 1) // raw[p])
            p += n

    def __iter__(self):
        for i in range(len(self.index)):
            yield from self._entries(self._block(i)[0])

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first entry of ``doc_id``, by binary search for its block and its stretch of the block; the
        Bloom filter spares most reads of absent ids."""
        key = key_of(doc_id)
        if not all(self.bloom[x >> 3] >> (x & 7) & 1 for x in _bloom_bits(key[:9], self.bits)):
            return None
        i = bisect.bisect_left(self.keys, key)
        if i == len(self.index):
            return None
        raw, restarts = self._block(i)
        at = max(0, bisect.bisect_right(restarts, key, key=lambda p: next(self._entries(raw, p))[0]) - 1)
        for k, ids in self._entries(raw, restarts[at]):
            if k >= key:
                return ids if k == key else None
        return None


def _spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after another."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Ids of texts by a tokenizer whose pieces never cross ASCII white space: words are encoded once.

    Arrow splits a chunk and finds its distinct words. A word of plain letters and a run of symbols after
    it are two pieces, met again in many words, so only letters in lower case and symbols are encoded:
    letters many in a row, cut at the tokens that end a piece. All other words go singly and as they are.
    """

    LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
    LETTER = "".join(c for c in map(chr, range(256)) if re.fullmatch("[A-Za-zÀ-ÖØ-öø-ÿ]", c))
    #: Symbols that are one piece after letters: ASCII ones but those of contractions and special tokens.
    SYMBOLS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.places: dict[bytes, int] = {}
        self.starts, self.lens, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _each(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[list[int]]:
        runs = [words[i : i + 256] for i in range(0, len(words), 256)]
        out = []
        for run, row in zip(runs, self._each([" ".join(r) for r in runs]), strict=True):
            cuts = (np.nonzero(self.ends[row])[0] + 1).tolist()
            whole = len(cuts) == len(run) and cuts[-1] == len(row)
            out += [row[a:b] for a, b in zip([0, *cuts], cuts, strict=False)] if whole else self._each(run)
        return out

    def _slots(self, pieces: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each piece's ids start and how many they are, and the pool that holds them."""
        raw = pieces.view(pa.large_binary()).to_pylist()
        slots = np.fromiter(map(self.places.get, raw, itertools.repeat(-1)), np.int64, len(raw))
        new = np.nonzero(slots < 0)[0]
        if not len(new):
            return self.starts[slots], self.lens[slots], self.pool
        order = np.concatenate([new[letters[new]], new[~letters[new]]])
        text = [raw[i].decode("utf-8", "replace") for i in order]
        n = int(letters[new].sum())
        ids = self._letters(text[:n]) + self._each(text[n:])
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lens.sum()))])
        starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lens) - lens])
        lens = np.concatenate([self.lens, lens])
        slots[order] = np.arange(len(self.lens), len(lens))
        if len(lens) <= CACHE_WORDS:
            self.places.update(zip((raw[i] for i in order), range(len(self.lens), len(lens)), strict=True))
            self.starts, self.lens, self.pool = starts, lens, pool
        return starts[slots], lens[slots], pool

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        core = pc.ascii_rtrim(words, characters=self.SYMBOLS)
        plain = pc.match_substring_regex(core, self.LETTERS)
        head = pc.if_else(plain, pc.utf8_lower(pc.if_else(plain, core, "")), words)
        tail = pc.utf8_ltrim(pc.if_else(plain, words, ""), characters=self.LETTER)
        heads, tails = head.dictionary_encode(), tail.dictionary_encode()
        pieces = pa.concat_arrays([heads.dictionary, tails.dictionary])
        letters = pc.match_substring_regex(pieces, self.LETTERS).to_numpy(zero_copy_only=False)
        starts, lens, pool = self._slots(pieces, letters)
        # Each word is its head and its tail; then each text is its words.
        pair = np.stack([heads.indices.to_numpy(), tails.indices.to_numpy() + len(heads.dictionary)], 1).ravel()
        pool = pool[_spans(starts[pair], lens[pair])]
        lens = lens[pair].reshape(-1, 2).sum(1)
        starts, code = np.cumsum(lens) - lens, coded.indices.to_numpy()
        flat = pool[_spans(starts[code], lens[code])]
        ends = np.concatenate([[0], np.cumsum(lens[code])])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def write(docs: DataFrame, out: str, tokenizer: str, *, end_id: int = END_ID) -> list[dict]:
    """Encode ``docs`` into shards below ``out``; the manifest, one entry for each shard in key order."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def shards(batches):
        from pyspark import TaskContext

        part, encode, done, w = TaskContext.get().partitionId(), encoder(tokenizer), [], None
        fs, root = _filesystem(out)
        fs.create_dir(root, recursive=True)

        def finish():
            w.close()
            done.append((part, len(done), name, w.docs, w.tokens))

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for first, chunk in text_chunks(b):
                for doc_id, tokens in zip(ids[first : first + len(chunk)], encode(chunk), strict=True):
                    if w is None:
                        name = f"part-{part:05d}-{len(done):03d}-{uuid.uuid4().hex}.sst"
                        w = Writer(fs.open_output_stream(f"{root}/{name}"))
                    w.add(doc_id, np.append(tokens, np.uint32(end_id)))
                    if w.at >= SHARD_BYTES:
                        finish()
                        w = None
        if w is not None:
            finish()
        columns = list(zip(*done, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "name", "docs", "tokens"])

    found = dealt.mapInArrow(shards, "part int, seq int, name string, docs long, tokens long").collect()  # one row per file
    manifest, start = [], 0
    for r in sorted(found, key=lambda r: (r["part"], r["seq"])):
        manifest.append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"], "start": start})
        start += r["tokens"]
    fs, root = _filesystem(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/MANIFEST.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read(spark, out: str) -> DataFrame:
    """Every document of the shards below ``out``: doc_id, start, n_tokens and ids_crc32."""
    fs, root = _filesystem(out)
    with fs.open_input_stream(f"{root}/MANIFEST.json") as f:
        manifest = json.loads(f.read())
    files = spark.createDataFrame([(m["name"], m["start"]) for m in manifest], "name string, start long").repartition(max(1, len(manifest)))

    def rows(batches):
        fs, root = _filesystem(out)
        for b in batches:
            for name, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    got = []
                    for key, ids in Reader(f):
                        got.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(got) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            got = []
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = shared_dir(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, out)
