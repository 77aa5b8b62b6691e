import numpy as np

from keystrata.llm import crf


def plain(score, length, trans, begin):
    """The textbook recursion in logarithms."""
    s, at = score.shape[1], 0
    post, pairs, total = [], np.zeros((s, s)), 0.0
    for n in length:
        if not n:
            continue
        x = score[at : at + n].copy()
        x[0] += begin
        at += n
        a, b = np.zeros((n, s)), np.zeros((n, s))
        a[0] = x[0]
        for t in range(1, n):
            a[t] = x[t] + np.logaddexp.reduce(a[t - 1][:, None] + trans, axis=0)
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(trans + x[t + 1] + b[t + 1], axis=1)
        z = np.logaddexp.reduce(a[-1])
        total += z
        post.append(np.exp(a + b - z))
        for t in range(1, n):
            pairs += np.exp(a[t - 1][:, None] + trans + x[t] + b[t] - z)
    return np.concatenate(post), pairs, total


def test_blocks_give_the_plain_marginals():
    r = np.random.default_rng(0)
    length = np.array([1, 3, 200, 65, 64, 0, 130, 2])
    score, trans, begin = r.normal(size=(length.sum(), 3)), r.normal(size=(3, 3)), r.normal(size=3)
    for got, want in zip(crf.marginals(score, length, trans, begin), plain(score, length, trans, begin)):
        assert np.allclose(got, want)


def test_nothing():
    post, pairs, z = crf.marginals(np.empty((0, 2)), np.array([0, 0]), np.zeros((2, 2)), np.zeros(2))
    assert post.shape == (0, 2) and pairs.sum() == 0 and z == 0
