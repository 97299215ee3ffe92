import re

import numpy as np
import pytest

from paperloom.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_removal(rows, window):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1) if d is not None else ():
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {i + k for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for k in range(window)}
        out.append((str(d), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def removal(docs, **options):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substrings.removed(docs, **options).collect())


OPTIONS = [{}, {"group_rows": 8}, {"filter_bits": 1 << 9}]


@pytest.mark.parametrize("options", OPTIONS)
def test_odd_rows(spark, odd, options):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert removal(odd, window=20, gram=8, **options) == plain_removal(rows, 20)
    assert substrings.removed(odd.limit(0), window=20, gram=8, **options).count() == 0


def passages(seed):
    """Texts that share passages of several lengths, copies, and one passage in most texts."""
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared, common = [words(int(n)) for n in rng.integers(12, 60, 6)], words(15)
    texts = []
    for _ in range(40):
        parts = [words(int(rng.integers(0, 30))) for _ in range(3)]
        for p in rng.choice(6, 2):
            cut = int(rng.integers(0, 8))
            parts.insert(int(rng.integers(0, len(parts))), shared[p][cut:])
        if rng.random() < 0.7:
            parts.append(common)
        texts.append(" ".join(w for p in parts for w in p))
    texts += [texts[0], texts[0], texts[3], "a b " * 20, "a b " * 25]
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]


@pytest.mark.parametrize("options", OPTIONS)
@pytest.mark.parametrize("window", [10, 20])
def test_shared_passages(spark, options, window):
    rows = passages(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removal(docs, window=window, gram=5, **options) == plain_removal(rows, window)


def plain_repeats(rows, window):
    """Rows of windows with equal occurrences, one word apart, of windows that two texts or more hold."""
    texts = {d: WORD.findall(t) for d, t in rows}
    places = {}
    for d, w in texts.items():
        for i in range(len(w) - window + 1):
            places.setdefault(tuple(w[i : i + window]), set()).add((d, i))
    shared = {at for ps in places.values() if len({" ".join(texts[d]) for d, _ in ps}) > 1 for at in ps}
    where = {at: ps for ps in places.values() for at in ps if at in shared}

    def goes_on(d, i):
        here, there = where.get((d, i)), where.get((d, i + 1))
        return here is not None and there is not None and {(e, j + 1) for e, j in here} == there

    out = []
    for d, i in where:
        if not goes_on(d, i - 1):
            n = window
            while goes_on(d, i + n - window):
                n += 1
            out.append((n, len(where[d, i]), d, i))
    return sorted(out)


@pytest.mark.parametrize("options", OPTIONS)
def test_repeats_against_a_plain_search(spark, options):
    rows = [r for r in passages(5) if "a b a" not in r[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.repeats(docs, window=10, gram=5, **options).collect()
    plain = plain_repeats(rows, 10)
    assert sorted((r["length"], r["n_places"], r["doc_id"], r["start"]) for r in got) == plain and len(plain) > 20
    texts = {d: WORD.findall(t) for d, t in rows}
    words = {}
    for r in got:
        words.setdefault(r["repeat"], set()).add(" ".join(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]))
    assert all(len(w) == 1 for w in words.values())
