import numpy as np
import pytest

import corpus_pipeline
from paperloom.llm import minhash


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_first(rows):
    """Least doc_id of each component of the pairs of Jaccard 0.8 or more."""
    sets, up = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sorted({min(rows[i][0] for i in range(len(rows)) if find(i) == r) for r in map(find, range(len(rows)))})


@pytest.mark.parametrize("block", [512, 7])
def test_near_dedup_stage_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    texts = ["too short", "Too  short", "a b c d e f", "a b c d e g"]
    for c in range(8):
        base = [f"W{c}x{k}" for k in rng.integers(0, 10**6, 150)]
        for n in (0, 0, 1, 2, 2, 3, 3, 4, 5, 7, 12):
            copy = list(base)
            for at in rng.choice(150, n, replace=False):
                copy[at] = f"new{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows = [(int(i), str(t)) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == brute_first(rows)


def test_near_dedup_stage_odd_rows(spark, odd):
    got = corpus_pipeline.near_dedup(spark, odd, "")
    assert got.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in got.collect())
    assert ids == ["1", "3", "6", "6", "7", "8", "9"]
    assert corpus_pipeline.near_dedup(spark, odd.limit(0), "").count() == 0


def test_set_links_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 25)).astype(np.uint64)) for _ in range(120)]
    up = list(range(len(sets)))
    for a, b in minhash.set_links(sets):
        x, y = up[a], up[b]
        up = [x if u == y else u for u in up]
    want = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])):
                x, y = want[a], want[b]
                want = [x if u == y else u for u in want]
    assert len({(u, v) for u, v in zip(up, want)}) == len(set(want)) == len(set(up)) < len(sets)


def test_near_dedup_links_fingerprints_within_the_radius(spark):
    """The stage's fingerprint links join what all pairs of fingerprints within RADIUS bits join."""
    rng = np.random.default_rng(8)
    texts = ["", "one two", "a b c d e"]
    for c in range(6):
        base = [f"w{c}x{k}" for k in rng.integers(0, 10**6, 400)]
        for n in (0, 0, 1, 1, 2, 3, 40):
            copy = list(base)
            for at in rng.choice(400, n, replace=False):
                copy[at] = f"new{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = minhash.distinct_sets(minhash.marks(docs, ["doc_id"]))
    rows = [(r["fp"], r["simhash"] % 2**64) for r in one.collect()]
    assert sorted(s for _, s in rows) == sorted({minhash.fingerprint(minhash.shingles(t.encode())) for t in texts if t})

    def parts(links):
        of = {fp: fp for fp, _ in rows}
        for a, b in links:
            x, y = of[a], of[b]
            of = {k: x if v == y else v for k, v in of.items()}
        return {frozenset(k for k in of if of[k] == v) for v in of.values()}

    near = [(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= minhash.RADIUS]
    assert near and parts((r["a"], r["b"]) for r in minhash.simhash_candidates(one).collect()) == parts(near)
