"""Linear-chain conditional random field: exact marginals of many sequences at once, and training.

Scores of a position's states come from its features, those of neighbouring states from learned transitions. Marginals are
those of forward-backward. All sequences advance together, one position a step; to bound the steps, sequences are laid out
in blocks of BLOCK positions: a first pass finds each block's product of transition matrices, a scan over the blocks what
enters each, and a second pass the marginals inside. The results are those of the plain recursion.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


def _blocks(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(first position, length, number within its sequence) of each block; most blocks of a sequence."""
    n = -(-length // BLOCK)
    of = np.repeat(np.arange(len(length)), n)
    ends = np.cumsum(n)
    k = np.arange(len(of)) - np.repeat(ends - n, n)
    start = np.concatenate(([0], np.cumsum(length)[:-1]))[of] + k * BLOCK if len(of) else np.empty(0, np.int64)
    return start, np.minimum(length[of] - k * BLOCK, BLOCK), k, int(n.max()) if len(n) else 0


def marginals(score: np.ndarray, length: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(positions x states marginals, expected transitions, log-likelihood's normaliser), for consecutive sequences of these lengths.

    score: positions x states; trans[i, j]: from state i to j; begin: of the first state.
    """
    length = length[length > 0]
    n, s = score.shape
    if not n:
        return np.empty((0, s)), np.zeros((s, s)), 0.0
    score = score.copy()
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    score[first] += begin
    top = score.max(1)
    e = np.exp(score - top[:, None])
    peak = trans.max()
    a = np.exp(trans - peak)
    start, size, k, most = _blocks(length)
    order = np.argsort(-size, kind="stable")  # longest first: those that go on are always the first ones
    start, size, k = start[order], size[order], k[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
    m = len(start)
    # products of each block but the first of a sequence, applied to the states before it
    product = np.zeros((m, s, s))
    product[:] = np.eye(s)
    if most > 1:
        for t, b in enumerate(live):
            p = product[:b] @ a
            p *= e[start[:b] + t][:, None, :]
            z = p.sum((1, 2))
            product[:b] = p / z[:, None, None]
    # what enters each block from before, and what follows it
    blocks = np.bincount(np.repeat(np.arange(len(length)), -(-length // BLOCK)), minlength=len(length))
    block0 = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    enters, follows = np.zeros((m, s)), np.ones((m, s)) / s
    by = np.argsort(-blocks, kind="stable")
    count = np.searchsorted(-blocks[by], -np.arange(1, most + 1), "right")

    def inside(which: np.ndarray) -> np.ndarray:
        """Forward values at the ends of first blocks."""
        v = e[start[which]].copy()
        v /= v.sum(1, keepdims=True)
        for t in range(1, int(size[which].max())):
            on = size[which] > t
            w = (v[on] @ a) * e[start[which[on]] + t]
            v[on] = w / w.sum(1, keepdims=True)
        return v

    if most > 1:
        here = place[block0[by[: count[1]]]]
        v = inside(here)
        for j in range(1, most):
            b = count[j]
            at = place[block0[by[:b]] + j]
            enters[at] = v[:b]
            w = np.einsum("bi,bij->bj", v[:b], product[at])
            v = w / w.sum(1, keepdims=True)
        f = np.ones((len(length), s)) / s
        for j in range(most - 1, 0, -1):
            b = count[j]
            at = place[block0[by[:b]] + j]
            w = np.einsum("bij,bj->bi", product[at], f[:b])
            f[:b] = w / w.sum(1, keepdims=True)
            follows[place[block0[by[:b]] + j - 1]] = f[:b]
    # inside the blocks
    alpha = np.empty((n, s))
    logz = float(top.sum()) + peak * (n - len(length))
    v = np.empty((m, s))
    for t, b in enumerate(live):
        if t:
            v = (v[:b] @ a) * e[start[:b] + t]
        else:
            v = np.where((k == 0)[:, None], 1.0, enters @ a) * e[start]
        z = v.sum(1)
        logz += float(np.log(z).sum())
        v = v / z[:, None]
        alpha[start[:b] + t] = v
    beta = np.empty((n, s))
    v = follows.copy()
    for t in range(len(live) - 1, -1, -1):
        b = live[t]
        at = start[:b] + t
        beta[at] = v[:b]
        w = (e[at] * v[:b]) @ a.T
        v[:b] = w / w.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    later = np.ones(n, bool)
    later[first] = False
    later = np.flatnonzero(later)
    # expected transitions
    left, right = alpha[later - 1], e[later] * beta[later]
    z = np.einsum("ni,ij,nj->n", left, a, right) if len(later) else np.empty(0)
    pair = a * ((left / z[:, None]).T @ right) if len(later) else np.zeros((s, s))
    return post, pair, logz


class Adam:
    """Steps along gradients of a log-likelihood, in place."""

    def __init__(self, *params: np.ndarray, rate: float = 0.05):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, *grads: np.ndarray) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def counts(y: np.ndarray, length: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray]:
    """(transitions, first states) of labelled sequences."""
    length = length[length > 0]
    first = np.concatenate(([0], np.cumsum(length)[:-1])) if len(length) else np.empty(0, np.int64)
    later = np.ones(len(y), bool)
    later[first] = False
    later = np.flatnonzero(later)
    pairs = np.bincount(y[later - 1] * states + y[later], minlength=states * states).reshape(states, states)
    return pairs.astype(float), np.bincount(y[first], minlength=states).astype(float)
