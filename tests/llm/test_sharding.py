from collections import Counter

import numpy as np
import pytest

from keystrata.llm import sharding


def test_matrix_has_the_margins_and_the_distribution():
    counts, sizes = np.array([5, 0, 7, 3]), np.array([4, 6, 5])
    cells = Counter()
    for seed in range(3000):
        m = np.array([sharding.row(counts, sizes, i, seed) for i in range(4)])
        assert (m.sum(1) == counts).all() and (m.sum(0) == sizes).all() and (m >= 0).all()
        cells[int(m[0, 0])] += 1
    from math import comb

    for x in range(5):
        p = comb(4, x) * comb(11, 5 - x) / comb(15, 5)
        assert abs(cells[x] / 3000 - p) < 4 * (p * (1 - p) / 3000) ** 0.5 + 1e-3


def test_large_populations():
    r = np.random.default_rng(0)
    x = [sharding.hypergeometric(r, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(40)]
    assert abs(np.mean(x) - 3e5) < 400 and 200 < np.std(x) < 800


def test_rows(spark, tmp_path):
    rows = [(i % 50 if i % 7 else None, None if i % 5 == 0 else f"text {i}", 1, 2) for i in range(1003)]
    spark.createDataFrame(rows, "doc_id int, text string, shard int, `c0.x` int").repartition(5).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    out = sharding.shuffle(df, 8).collect()
    assert Counter(x["shard"] for x in out) == Counter({i: 126 if i < 3 else 125 for i in range(8)})
    assert all(sorted(x["position"] for x in out if x["shard"] == s) == list(range(126 if s < 3 else 125)) for s in range(8))
    assert Counter(x[1] for x in out) == Counter(x[1] for x in rows) and out[0].__fields__ == ["doc_id", "text", "c0.x", "shard", "position"]
    again = sharding.shuffle(df, 8).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    own = sharding.shuffle(df.repartition(3), 3, [1000, 0, 3]).collect()
    assert Counter(x["shard"] for x in own) == {0: 1000, 2: 3}
    with pytest.raises(ValueError):
        sharding.shuffle(df, 2, [1, 2])
    assert sharding.shuffle(df.limit(0), 4).collect() == []


def test_pieces_add_up():
    of, begin, rows = sharding.pieces(np.array([10, 0, 7, 3]), 4)
    assert np.bincount(of, rows, 4).tolist() == [10, 0, 7, 3] and rows.max() <= 4
    assert all(begin[i] == rows[:i][of[:i] == of[i]].sum() for i in range(len(of)))


def test_splits_of_large_populations():
    r = np.random.default_rng(1)
    sizes = np.array([4, 1, 3, 2]) * 10**9
    x = np.array([sharding.split(r, sizes, 10**6) for _ in range(30)])
    assert (x.sum(1) == 10**6).all() and np.abs(x.mean(0) - sizes / 10**4).max() < 600


def test_order_is_uniform_and_pieces_don_t_show(spark, tmp_path):
    """Where rows come to lie, by all their places: old eighths against new ones, and how far neighbours part."""
    spark.range(400).repartition(3).sortWithinPartitions("id").write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    old = {x["id"]: i for i, x in enumerate(df.collect())}
    cells, together, runs = np.zeros((8, 8)), 0, 16
    for seed in range(runs):
        out = sharding.shuffle(df, 5, seed=seed, piece=31 if seed % 2 else 1000).collect()
        assert Counter(x["shard"] for x in out) == {i: 80 for i in range(5)} and {x["position"] for x in out} == set(range(80))
        new = {x["id"]: 80 * x["shard"] + x["position"] for x in out}
        np.add.at(cells, ([old[i] // 50 for i in range(400)], [new[i] // 50 for i in range(400)]), 1)
        together += sum(abs(new[a] - new[b]) == 1 for a, b in zip(sorted(old, key=old.get), sorted(old, key=old.get)[1:]))
    mean = 400 * runs / 64
    assert ((cells - mean) ** 2 / mean).sum() < 49 + 5 * 98**0.5  # chi-square of 49 degrees of freedom
    assert abs(together - 2 * runs) < 6 * (2 * runs) ** 0.5


def test_clashing_names_and_long_texts(spark):
    df = spark.createDataFrame([(i, "x" * (3_000_000 if i == 2 else 1), "s", "p", None) for i in range(5)], "doc_id string, text string, SHARD string, `position.` string, shard string")
    out = sharding.shuffle(df, 2)
    assert out.columns == ["doc_id", "text", "SHARD", "position.", "shard", "position"] and sorted(len(x[1]) for x in out.collect()) == [1, 1, 1, 1, 3_000_000]
