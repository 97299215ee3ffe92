"""Operator 13: ids against whole texts, packing against a plain best fit and bounds."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers

from paperloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, "One two, three.\nFour it's\nfive 12,5% of x_y (a) [b]", "  two  blanks \n\n lines\n", "tab\tand\r\nreturn", "a\xa0b \xa0c d\xa0 e", "x\x1cy\x85z ​ q", "<|endoftext|> is special, <|endoftext|>",
    "éäö ß, 中文字 日本。 emoji 🙂🙂 é", "'s 'll don't DON'T we've'", "...!!! a.b,c;d :e ?!", "\n", " ", "\n\n\n", " leading", "trailing ", "line\n next", "word " * 3000, "9" * 9000, "no-blank-" * 2000,
]


def test_ids_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    parts = [" ", " ", " ", "\n", "  ", "\t", ".", ",", "'s", "ab", "Cd", "é", "12", "-", "\xa0", "🙂", "²", "　", "é"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(3000)]
    encode = packing.ByteEncoder(PATH)
    for _ in range(2):  # the second time from what is kept
        got = encode(texts)
        bad = [t for t, raw in zip(texts, got) if np.frombuffer(raw, "<u4").tolist() != plain.encode(t, add_special_tokens=False).ids]
        assert not bad, bad[:5]


def fits(steps, histogram, capacity):
    """Pieces by sequence; checks that ranks and places are used once, without holes."""
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, each, offset in steps:
        for i in range(n):
            bins[first + i // each].append((offset + i % each * length, length))
            ranks[length].append(rank + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    return [sorted((n for _, n in b), reverse=True) for b in bins.values()]


def best_fit(histogram, capacity):
    """Sequences of a plain best fit from the longest on, one piece at a time."""
    gaps = []
    for n in sorted(Counter(histogram).elements(), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - n)
    return len(gaps)


def test_plan():
    rng = random.Random(4)
    for case in range(60):
        capacity = rng.choice([30, 64, 100])
        lengths = rng.choices(range(1, capacity + 1), k=12)
        histogram = {n: rng.choice([1, 2, 5, 40]) for n in lengths}
        bins = fits(packing.plan(histogram, capacity), histogram, capacity)
        large = [b for b in bins if any(3 * n > capacity for n in b)]
        assert all(sum(3 * n > capacity for n in b) <= 2 for b in large)
        assert len(bins) <= best_fit(histogram, capacity) + 1
        assert len(bins) >= -(-sum(n * k for n, k in histogram.items()) // capacity)


def test_large_lengths_open_as_few_sequences_as_possible():
    def least(items, capacity):
        if not items:
            return 0
        first, *rest = items
        return 1 + min([least(rest, capacity), *(least(rest[:i] + rest[i + 1 :], capacity) for i in range(len(rest)) if first + rest[i] <= capacity)])

    rng = random.Random(6)
    for _ in range(80):
        items = [rng.randrange(11, 31) for _ in range(8)]
        assert len(fits(packing.plan(Counter(items), 30), Counter(items), 30)) == least(items, 30)


def test_plan_does_not_grow_with_the_documents():
    few, many = ({n: 3 * k + n % 7 for n in range(1, 2049)} for k in (1, 10**9))
    assert len(packing.plan(many)) < 3 * len(packing.plan(few)) < 100_000
    total = sum(n * k for n, k in many.items())
    steps = packing.plan(many)
    assert max(first + -(-n // each) for _, _, n, first, each, _ in steps) <= 1.001 * total / 2048


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = [(i, t, "s", 3, i, i) for i, t in enumerate(TEXTS)] + [(None, "no id", "s", 1, 1, 1)] * 3 + [(5, TEXTS[2], "s", 1, 1, 1)] * 40
    rows += [(100 + i, " ".join(f"w{rng.randrange(999)}" for _ in range(int(rng.paretovariate(0.7)) % 6000 + 1)), "t", 1, 1, 1) for i in range(150)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, length int, rank long, sequence_id long")


def test_whole_operator(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    cut = packing.pieces(docs, PATH, capacity=512)
    rows = packing.packed(cut, capacity=512).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        cuts = list(range(len(ids), 0, -512))[::-1]
        for i, (a, z) in enumerate(zip([0, *cuts], cuts)):
            want[r["doc_id"], i, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 512
    read = {r["sequence_id"]: r for r in packing.sequences(docs, PATH, capacity=512).collect()}
    assert {s: len(r["ids"]) for s, r in read.items()} == {s: sum(n for _, n in own) for s, own in held.items()}
    assert all(r["offsets"][0] == 0 for r in read.values())
    assert Counter(x for r in read.values() for x in r["ids"]) == Counter(x for r in rows for x in np.frombuffer(r["ids"], "<u4").tolist())


def test_empty_table(spark, docs):
    assert packing.packed(packing.pieces(docs.limit(0), PATH)).count() == 0
    assert packing.sequences(docs.limit(0), PATH).count() == 0
