import math
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest

from paperloom.llm import neural, scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def tokens(text):
    return [*(w.encode() for w in WORD.findall(lower(text))), b""]


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 10 == 0


def check_base(rows, out):
    """Counts and base scores against a plain count."""
    counts = Counter()
    for d, t in rows:
        if not is_held_out(d):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in rows:
        w = tokens(t)
        want[d, is_held_out(d), len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n} and all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


@pytest.mark.parametrize("common", [200_000, 5])
def test_counts_and_base(spark, odd, monkeypatch, common):
    monkeypatch.setattr(scoring, "COMMON", common)
    check_base([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()], scoring.score(odd).collect())
    assert scoring.score(odd.limit(0)).count() == 0
    held = odd.filter("doc_id IS NULL")
    assert [(r["n_known"], r["train_tokens"]) for r in scoring.score(held).collect()] == [(0, 0)]


def two_tongues(n, rng):
    """Texts of one of two made-up tongues, whose words end alike and come by Zipf's law."""
    words = [[f"{''.join(rng.choice(list('bdgklmnprst'), 2))}{i}{end}" for i in range(900)] for end in ("ing", "eau")]
    share = 1 / np.arange(2, 902)
    return [" ".join(rng.choice(words[k % 2], 80, p=share / share.sum())) for k in range(n)]


def test_beats_the_base_on_held_out_texts_however_files_are_split(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SHARD_TOKENS", 20_000)
    monkeypatch.setattr(neural, "BATCH", 1_000)
    rows = list(enumerate(two_tongues(1200, np.random.default_rng(3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for split in (docs.repartition(2), docs.repartition(7)):
        out = scoring.score(split).collect()
        check_base(rows, out)
        held = [r for r in out if r["held_out"]]
        n = sum(r["n_tokens"] for r in held)
        assert sum(r["score"] for r in held) / n > sum(r["base_score"] for r in held) / n + 0.15  # knowing the tongue is worth 0.3
        scores.append({r["doc_id"]: r["score"] for r in out})
    assert scores[0] == pytest.approx(scores[1], rel=1e-4)


@pytest.mark.parametrize("own", [3071, 20])
def test_probabilities_add_to_one(spark, monkeypatch, own):
    monkeypatch.setattr(scoring, "OWN", own)
    monkeypatch.setattr(scoring, "ENDINGS", 12)
    texts = two_tongues(200, np.random.default_rng(4))
    docs = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "doc_id long, name string, text string")
    lexicon, distinct = scoring.lexicon_of(scoring.word_counts(docs))
    net = neural.Network(lexicon.share, lexicon.end)
    held = [lexicon.codes(tokens(t))[1] for t in texts]
    rng = np.random.default_rng(0)
    for leaf, pos in neural.batches(held, 2000):
        net.train(leaf, pos, rng)
    counts = Counter(w for i, t in enumerate(texts) if not is_held_out(i) for w in tokens(t))
    assert len(counts) == distinct and sum(counts.values()) == lexicon.total
    inside = np.zeros(len(lexicon.share))
    for w, c in counts.items():
        codes, leaves = lexicon.codes([w])
        inside[leaves[0]] += 1 if lexicon.is_own[codes[0]] else (c - lexicon.discount) / 10 ** lexicon.log_tokens[leaves[0]]
    for leaf in lexicon.ending.values():
        inside[leaf] += 10 ** lexicon.unseen[leaf]
    assert np.allclose(inside, 1)
    before = held[0][:30]
    probs = [np.exp(net.log_probs(np.append(before, leaf), np.arange(31))[-1]) for leaf in range(len(lexicon.share))]
    assert sum(probs) == pytest.approx(1, abs=1e-3)


def test_network_starts_as_unigrams_and_learns_order():
    share = np.array([4.0, 3, 2, 1, 4, 3, 2, 1, 5]) / 25
    net = neural.Network(share, 0)
    leaf = np.tile([1, 2, 3, 7], 500)
    pos = neural.positions(np.full(20, 100))
    assert np.allclose(np.exp(net.log_probs(leaf, pos)), share[leaf], atol=1e-5)
    start, rng = net.log_probs(leaf, pos).mean(), np.random.default_rng(0)
    for _ in range(200):
        net.train(leaf, pos, rng)
    assert net.log_probs(leaf, pos).mean() > start + 0.5
    again = neural.Network(share, 0, net.flat.copy())
    assert np.array_equal(again.log_probs(leaf, pos), net.log_probs(leaf, pos))


def test_context_gradients_match_differences():
    """The gradient through the context, against finite differences of a plain sum."""
    share = np.full(6, 1 / 6)
    net = neural.Network(share, 0)
    rng = np.random.default_rng(1)
    leaf, pos = rng.integers(0, 6, 23), neural.positions(np.array([1, 2, 9, 11]))
    net.leaves[:] = rng.normal(0, 0.3, net.leaves.shape)
    taken = {}
    net._step = lambda name, gradient, rows=slice(None): taken.update({name: (gradient, rows)})
    draws = [rng.random((neural.GROUP_NOISE,)), rng.random((2, neural.LEAF_NOISE))]

    class Fixed:
        def random(self, shape):
            shape = shape if isinstance(shape, tuple) else (shape,)
            return draws[0] if shape == (neural.GROUP_NOISE,) else np.resize(draws[1], shape)

    def objective():
        """The objective whose gradient ``train`` follows, written out token by token."""
        _, _, q, _, _ = net._predicted(leaf, pos)
        group = net.group[leaf]
        log_sigmoid = lambda x: -np.log1p(np.exp(-x))
        k = np.minimum(np.searchsorted(net.group_sums, draws[0]), len(net.group_sums) - 1)
        total = 0.0
        for i in range(len(leaf)):
            total += log_sigmoid(q[i] @ net.groups[group[i]] - net.group_noise[group[i]]) + log_sigmoid(q[i] @ net.leaves[leaf[i]] - net.leaf_noise[leaf[i]])
            total += sum(log_sigmoid(-(q[i] @ net.groups[j] - net.group_noise[j])) for j in k)
            lo, hi = net.first[group[i]], net.first[group[i] + 1]
            below = net.leaf_sums[lo - 1] if lo else 0.0
            at = np.resize(draws[1], (len(np.unique(group)), neural.LEAF_NOISE))[np.searchsorted(np.unique(group), group[i])]
            drawn = np.clip(np.searchsorted(net.leaf_sums, below + at * (net.leaf_sums[hi - 1] - below)), lo, hi - 1)
            total += sum(log_sigmoid(-(q[i] @ net.leaves[j] - net.leaf_noise[j])) for j in drawn)
        return float(total) / len(leaf)

    net.flat = net.flat.astype(np.float64)
    net.train(leaf, pos, Fixed())
    for name in ("inputs", "weights", "leaves", "groups"):
        gradient, rows = taken[name]
        full = np.zeros_like(getattr(net, name))
        full[rows] = gradient
        array = getattr(net, name)
        for at in [tuple(int(rng.integers(0, s)) for s in array.shape) for _ in range(6)]:
            old, step = array[at], 3e-2
            array[at] = old + step
            up = objective()
            array[at] = old - step
            down = objective()
            array[at] = old
            assert (up - down) / (2 * step) == pytest.approx(float(full[at]), abs=4e-3), (name, at)


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(neural, "PIECE", 10)
    text = np.arange(25) % 4
    (leaf, pos), = neural.batches([text])
    assert (leaf == text).all() and pos.tolist() == [*range(10), *range(10), *range(5)]


def test_rounds_use_every_shard_once():
    for n in (1, 2, 5, 40, 121):
        assert [s for a, b in scoring.rounds_of(n) for s in range(a, b)] == list(range(n))


def test_training_reuses_freed_memory():
    """Mini-batches take no new pages from the system once the first ones have run; in a process of its own, as workers are."""
    code = """if True:
        import resource
        import numpy as np
        from paperloom.llm import neural
        neural.keep_freed_memory()
        net, rng = neural.Network(np.full(4096, 1 / 4096), 0), np.random.default_rng(0)
        leaf, pos = rng.integers(0, 4096, neural.BATCH), neural.positions(np.full(32, neural.BATCH // 32))
        for k in range(6):
            if k == 3:
                before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
            net.train(leaf, pos, rng)
        print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
    """
    root = Path(scoring.__file__).resolve().parents[2]
    faults = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert int(faults) < 1_500  # 10,000 and more if each batch's arrays are new pages


def test_words_are_those_of_the_contract():
    texts = ["", " \n\t ", None, "One", "  A\x0bb\x0cC\r\n\td  ", "no\x00break\x1c\x85\xa0 x É Z", "x " * 70_000]
    assert [list(map(str.encode, row)) for row in scoring._words([(t or "").encode() for t in texts]).to_pylist()] == [tokens(t) for t in texts]


def test_no_word_of_a_chunk_is_looked_up_twice(spark, monkeypatch):
    """The lexicon is asked for the distinct words of a chunk, not for its tokens; run here, not in a worker."""
    texts = two_tongues(300, np.random.default_rng(6))
    docs = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "doc_id long, name string, text string")
    lexicon, distinct = scoring.lexicon_of(scoring.word_counts(docs))
    want, asked, codes = [lexicon.codes(tokens(t))[1].tolist() for t in texts], [], scoring.Lexicon.codes
    monkeypatch.setattr(scoring.Lexicon, "codes", lambda self, words: asked.append(words) or codes(self, words))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    local = SimpleNamespace(
        schema=docs.schema, mapInArrow=lambda f, _: f, sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
    )
    rows = [r for b in scoring.encoded(local, lexicon, distinct)(iter(docs.toArrow().to_batches())) for r in b.to_pylist()]
    assert [np.frombuffer(r["leaves"], "<u2").tolist() for r in sorted(rows, key=lambda r: r["doc_id"])] == want
    assert asked and all(len(set(words)) == len(words) for words in asked)


def test_network_takes_few_numpy_calls_on_rows_of_a_group():
    """A mini-batch's noise and data of a group are one product, and its softmaxes one: exponentials are counted."""
    share = np.full(64, 1 / 64)
    net, rng = neural.Network(share, 0), np.random.default_rng(0)
    leaf, pos = rng.integers(0, 64, 400), neural.positions(np.full(4, 100))
    made, exp = [], np.exp
    with pytest.MonkeyPatch.context() as m:
        m.setattr(np, "exp", lambda x, **kw: made.append(x.size) or exp(x, **kw))
        net.log_probs(leaf, pos)
        assert len(made) == len(net.groups)
        made.clear()
        net.train(leaf, pos, rng)
    assert len(made) == len(net.groups) + 1
    assert sum(made) == 400 * (neural.GROUP_NOISE + neural.LEAF_NOISE + 2)


def test_log_probabilities_of_large_scores_are_normalized():
    share = np.arange(1, 31) / np.arange(1, 31).sum()
    net = neural.Network(share, 0)
    net.inputs[:], net.leaves[:, :-1] = 9, np.random.default_rng(2).normal(0, 9, (30, neural.DIM))
    before = np.array([3, 4])
    logs = np.array([net.log_probs(np.append(before, leaf), np.arange(3))[-1] for leaf in range(30)])
    assert np.isfinite(logs).all() and np.exp(logs).sum() == pytest.approx(1, abs=1e-3)
    rng = np.random.default_rng(0)
    with np.errstate(all="raise", under="ignore"):
        net.train(rng.integers(0, 30, 400), neural.positions(np.full(4, 100)), rng)
    assert np.isfinite(net.flat).all()
