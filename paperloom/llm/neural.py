"""A log-bilinear network over leaf classes, trained in numpy by noise-contrastive estimation.

A text is a row of leaves. The vector predicted for a token is the sum of three vectors, each times its
weights by dimension: those of the two leaves before it and the mean of those of all leaves before it
in the text. A leaf's probability has two factors: that of its group among all groups, and that of the
leaf among the leaves of its group; both are softmaxes of products with the predicted vector, so a
token costs two rows of about the square root of the number of leaves. Leaves of a group are
neighbours in number.

At the start every product is zero and the biases are log shares, so that an untrained network is the
unigram model of its leaves.
"""

from __future__ import annotations

import numpy as np

DIM = 16
GROUP_NOISE, LEAF_NOISE = 24, 12
RATE = 0.1
#: Longer texts are read in pieces of so many tokens, each as a text of its own, which bounds memory.
PIECE = 1 << 16
BATCH = 16_384
#: Rows of a matrix product at most, so that what is made of them stays in the processor's cache.
ROWS = 512
_F = np.float32


def keep_freed_memory() -> None:
    """glibc returns freed blocks to the system unless a larger one (32 MB at most) was freed before, and then the arrays
    of every mini-batch cost a page fault for each 4 KB again. So one large block, which is never written, is freed first."""
    np.empty(31 << 20, np.uint8)


def _shares(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place; 0 where exp(x) is beyond the range of floats, of which callers take no warning."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sums_of_runs(rows: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the rows (an even number of columns, taken as ``_cumulate`` does) from each ``cut`` to the next."""
    return np.add.reduceat(rows.view(np.complex64), cut, axis=0).view(_F)


def _cumulate(rows: np.ndarray, out: np.ndarray) -> None:
    """Sums of the rows so far; taken as complex numbers, two columns are added at once."""
    np.cumsum(rows.view(np.complex64), axis=0, out=out.view(np.complex64))


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.concatenate([[0], np.nonzero(np.diff(sorted_values))[0] + 1])


def positions(lens: np.ndarray) -> np.ndarray:
    """The place of each token in its piece, for texts of ``lens`` tokens in a row."""
    return (np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)) % PIECE


def batches(texts, size: int = BATCH):
    """(leaves, positions) of the ``texts`` (arrays of leaves), about ``size`` tokens at a time."""
    held, n = [], 0
    for text in texts:
        for at in range(0, len(text), PIECE):
            held.append(text[at : at + PIECE])
            n += len(held[-1])
            if n >= size:
                yield np.concatenate(held), positions(np.array([len(x) for x in held]))
                held, n = [], 0
    if held:
        yield np.concatenate(held), positions(np.array([len(x) for x in held]))


class Network:
    """``share`` is the training share of each leaf, ``end`` the leaf that stands before a text."""

    NAMES = ("inputs", "leaves", "groups", "weights")

    def __init__(self, share: np.ndarray, end: int, flat: np.ndarray | None = None):
        c, size = len(share), max(1, int(np.ceil(np.sqrt(len(share)))))
        self.end, self.first = end, np.append(np.arange(0, c, size), c)
        n = len(self.first) - 1
        self.group = np.repeat(np.arange(n), np.diff(self.first))
        of_group = np.add.reduceat(share, self.first[:-1])
        inside = share / of_group[self.group]
        self.leaf_sums, self.group_sums = np.cumsum(share), np.cumsum(of_group)
        self.leaf_noise, self.group_noise = np.log(LEAF_NOISE * inside).astype(_F), np.log(GROUP_NOISE * of_group).astype(_F)
        #: Parameters, then the sums of their squared gradients. The last column of leaves and groups is the bias.
        shapes = [(c, DIM), (c, DIM + 1), (n, DIM + 1), (3, DIM)]
        total = sum(a * b for a, b in shapes)
        self.flat = np.full(2 * total, 1e-6, _F) if flat is None else flat
        views, at = [], 0
        for a, b in shapes * 2:
            views.append(self.flat[at : at + a * b].reshape(a, b))
            at += a * b
        self.inputs, self.leaves, self.groups, self.weights = views[:4]
        self.squares = dict(zip(self.NAMES, views[4:], strict=True))
        if flat is None:
            self.inputs[:] = np.random.default_rng(5).normal(0, 0.1, self.inputs.shape)
            self.leaves[:], self.groups[:], self.weights[:] = 0, 0, 1
            self.leaves[:, -1], self.groups[:, -1] = np.log(inside), np.log(of_group)

    def _predicted(self, leaf: np.ndarray, pos: np.ndarray):
        """Vectors of the tokens, means before them, predictions (with a one for the bias), and who is first or second."""
        n, w = len(leaf), self.weights
        own, end = np.take(self.inputs, leaf, axis=0), self.inputs[self.end]
        sums = np.zeros((n + 1, DIM), _F)
        _cumulate(own, sums[1:])
        mean = sums[:-1] - np.take(sums, np.arange(n) - pos, axis=0)
        mean *= (1 / np.maximum(pos, 1)).astype(_F)[:, None]
        # Weighted before they are taken: there are fewer leaves than tokens.
        v = mean * w[2]
        v[1:] += np.take(self.inputs * w[0], leaf[:-1], axis=0)
        v[2:] += np.take(self.inputs * w[1], leaf[:-2], axis=0)
        first, second = np.nonzero(pos == 0)[0], np.nonzero(pos == 1)[0]
        v[first] = end * (w[0] + w[1])
        v[second] = mean[second] * w[2] + own[second - 1] * w[0] + end * w[1]
        q = np.ones((n, DIM + 1), _F)
        q[:, :-1] = v
        return own, mean, q, first, second

    def _step(self, name: str, gradient: np.ndarray, rows=slice(None)) -> None:
        """Ascent with step sizes by parameter."""
        squares = self.squares[name][rows] + gradient * gradient
        self.squares[name][rows] = squares
        getattr(self, name)[rows] += RATE * gradient / np.sqrt(squares)

    @np.errstate(over="ignore")
    def train(self, leaf: np.ndarray, pos: np.ndarray, rng: np.random.Generator) -> None:
        """One mini-batch. Noise groups are drawn once for it, noise leaves once for each group in it, so
        scores and gradients are matrix products."""
        n, w = len(leaf), self.weights
        own, mean, q, first, second = self._predicted(leaf, pos)
        order = np.argsort(leaf.astype(np.uint16), kind="stable")
        leaf, q = leaf[order], np.take(q, order, axis=0)
        group = self.group[leaf]
        cut, leaf_cut = _runs(group), _runs(leaf)
        present, touched = group[cut], leaf[leaf_cut]
        draw = np.minimum(np.searchsorted(self.group_sums, rng.random(GROUP_NOISE)), len(self.group_sums) - 1)
        lo, hi = self.first[present], self.first[present + 1]
        below = np.where(lo > 0, self.leaf_sums[lo - 1], 0.0)
        at = below[:, None] + rng.random((len(present), LEAF_NOISE)) * (self.leaf_sums[hi - 1] - below)[:, None]
        draws = np.clip(np.searchsorted(self.leaf_sums, at), lo[:, None], hi[:, None] - 1)
        # Data: 1 - sigma of score minus log noise; noise: -sigma. Both are shares (1 / (1 + exp)) of the score with the data's
        # sign times the vector with that sign, so what tokens of a group share, noise and group, is three matrix products.
        of_leaf = np.take(self.leaves, leaf, axis=0)
        to_leaf = _shares(np.einsum("ij,ij->i", q, of_leaf) - self.leaf_noise[leaf])
        back = np.multiply(of_leaf, to_leaf[:, None], out=of_leaf)
        g_groups, g_leaves, g_draw = np.zeros_like(self.groups), np.zeros_like(self.leaves), np.zeros((GROUP_NOISE, DIM + 1), _F)
        g_noise = np.zeros((len(present), LEAF_NOISE, DIM + 1), _F)
        signed, to = np.empty((GROUP_NOISE + LEAF_NOISE + 1, DIM + 1), _F), GROUP_NOISE + LEAF_NOISE
        signed[:GROUP_NOISE] = -self.groups[draw]
        less = np.empty(len(signed), _F)
        less[:GROUP_NOISE] = -self.group_noise[draw]
        for g, k, g_k, a, b in zip(present.tolist(), draws, g_noise, cut.tolist(), [*cut[1:].tolist(), n], strict=True):
            signed[GROUP_NOISE:to], signed[to] = -self.leaves[k], self.groups[g]
            less[GROUP_NOISE:to], less[to] = -self.leaf_noise[k], self.group_noise[g]
            scored = signed.copy()
            scored[:, -1] -= less
            for a in range(a, b, ROWS):  # noqa: B020, PLW2901
                some, sums = q[a : min(b, a + ROWS)], back[a : min(b, a + ROWS)]
                share = _shares(some @ scored.T)
                sums += share @ signed
                gradient = share.T @ some
                g_draw += gradient[:GROUP_NOISE]
                g_k += gradient[GROUP_NOISE:to]
                g_groups[g] += gradient[to]
        np.subtract.at(g_groups, draw, g_draw)
        for i in range(LEAF_NOISE):  # groups share no leaf
            g_leaves[draws[:, i]] -= g_noise[:, i]
        g_leaves[touched, :-1] += _sums_of_runs(q[:, :-1] * to_leaf[:, None], leaf_cut)
        g_leaves[touched, -1] += np.add.reduceat(to_leaf, leaf_cut)
        # Through the context: a vector serves the next token, the one after it, and the means of all later ones.
        g = np.empty((n, DIM), _F)
        g[order] = back[:, :-1]
        end, opening, after = self.inputs[self.end], g[first].sum(axis=0), g[second].sum(axis=0)
        one = g.copy()
        one[first] = 0
        two = one.copy()
        two[second] = 0
        g_weights = np.stack([
            np.einsum("ij,ij->j", one[1:], own[:-1]) + opening * end,
            np.einsum("ij,ij->j", two[2:], own[:-2]) + (opening + after) * end,
            np.einsum("ij,ij->j", g, mean),
        ])
        g *= w[2]
        g *= np.where(pos > 0, 1 / np.maximum(pos, 1), 0).astype(_F)[:, None]
        later = np.zeros((n + 1, DIM), _F)
        _cumulate(g[::-1], later[1:])
        later = later[::-1]
        text_end = np.append(first[1:], n)[np.cumsum(pos == 0) - 1]
        g_own = later[1:] - np.take(later, text_end, axis=0)
        one *= w[0]
        two *= w[1]
        g_own[:-1] += one[1:]
        g_own[:-2] += two[2:]
        scale = _F(1 / n)
        self._step("inputs", _sums_of_runs(np.take(g_own, order, axis=0), leaf_cut) * scale, touched)
        for name, gradient in (("weights", g_weights), ("groups", g_groups), ("leaves", g_leaves)):
            self._step(name, gradient * scale)

    def log_probs(self, leaf: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Normalised log probability (natural) of each token."""
        q, n = self._predicted(leaf, pos)[2], len(leaf)
        order = np.argsort(leaf.astype(np.uint16), kind="stable")
        leaf, q = leaf[order], np.take(q, order, axis=0)
        group = self.group[leaf]
        out = np.einsum("ij,ij->i", q, np.take(self.groups, group, axis=0) + np.take(self.leaves, leaf, axis=0))
        # No score is beyond the product of the lengths of its vectors; far below 60 no row can over- or underflow.
        longest = max(np.einsum("ij,ij->i", x, x).max() for x in (self.groups, self.leaves))
        safe = np.einsum("ij,ij->i", q, q).max() * longest <= 50.0**2
        cut, sums, n_groups, ones = _runs(group), np.ones((2, n), _F), len(self.groups), np.ones(len(self.groups) + len(self.leaves), _F)
        for k, a, b in zip(group[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), n], strict=True):
            both = self.groups, self.leaves[self.first[k] : self.first[k + 1]]
            vectors = np.concatenate(both).T
            for at in range(a, b, ROWS):
                end = min(b, at + ROWS)
                if safe:
                    scores = q[at:end] @ vectors
                    np.exp(scores, out=scores)
                    sums[0, at:end] = scores[:, :n_groups] @ ones[:n_groups]
                    sums[1, at:end] = scores[:, n_groups:] @ ones[: scores.shape[1] - n_groups]
                else:
                    out[at:end] -= sum(_log_sums(q[at:end], x) for x in both)
        out -= np.log(sums).sum(axis=0)
        result = np.empty_like(out)
        result[order] = out
        return result


def _log_sums(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Log of the sum of exp(score) over ``vectors``, for each row, whatever the scores."""
    scores = q @ vectors.T
    top = scores.max(axis=1, keepdims=True)
    scores -= top
    np.exp(scores, out=scores)
    return top[:, 0] + np.log(scores.sum(axis=1))
