"""Operator 3's files: lookups by binary search, long texts, many blocks."""

import io

import numpy as np
import public_tokenizers
import pytest

from paperloom.llm import sstable


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


class _Out(io.BytesIO):
    def close(self):
        pass


def shard(docs):
    out = _Out()
    w = sstable.Writer(out)
    for doc, ids in docs:
        w.add(doc, np.array(ids, np.uint32))
    w.close()
    return sstable.Reader(_File(out.getvalue())), w


@pytest.mark.parametrize("block", [60, 500, 1 << 16])
def test_lookups(monkeypatch, block):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", block)
    docs = [(None, [7]), (None, [8])] + [(i, list(range(i % 50)) + [70_000] * (i % 3 == 0) + [2]) for i in range(-300, 3000, 3)] + [(5000, [1]), (5000, [9])]
    reader, w = shard(docs)
    assert [(sstable.id_of(k), ids.tolist()) for k, ids in reader] == docs and len(reader.index) > (block < 1 << 16)
    first = {}
    for doc, ids in docs:
        first.setdefault(doc, ids)
    assert all(reader.get(doc).tolist() == ids for doc, ids in first.items())
    assert all(reader.get(doc) is None for doc in range(-299, 3100) if doc not in first)


def test_lookups_read_one_stretch_of_one_block(monkeypatch):
    reader, _ = shard([(i, [i]) for i in range(4000)])
    read, plain = [], sstable.Reader._entries

    def counted(raw, p=0):
        for entry in plain(raw, p):
            read.append(entry[0])
            yield entry

    monkeypatch.setattr(sstable.Reader, "_entries", staticmethod(counted))
    assert reader.get(3777).tolist() == [3777] and len(read) <= sstable.RESTART + 16


def test_empty():
    reader, _ = shard([])
    assert list(reader) == [] and reader.get(1) is None


def test_a_text_above_a_chunk(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    long = " ".join(f"word{i % 977} and" for i in range(500_000))  # more than CHUNK_BYTES
    docs = spark.createDataFrame([(1, "short", "x"), (2, long, "y"), (3, None, "z")], "doc_id long, text string, key string")
    sstable.write(docs, f"file://{tmp_path}/s", path)
    rows = {r["doc_id"]: r["n_tokens"] for r in sstable.read(spark, f"file://{tmp_path}/s").collect()}
    plain = Tokenizer.from_file(path)
    assert rows == {1: len(plain.encode("short", add_special_tokens=False).ids) + 1, 2: len(plain.encode(long, add_special_tokens=False).ids) + 1, 3: 1}
