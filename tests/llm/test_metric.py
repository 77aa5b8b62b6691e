import numpy as np
import pytest

from keystrata.llm import metric


def rows(seed=1, n=700, dim=12):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim))
    v[n // 2 :] = v[r.integers(0, n // 2, n - n // 2)] + r.normal(size=(n - n // 2, dim)) * r.choice([0, 0.02, 0.3], (n - n // 2, 1))
    return [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]


def cosines(data):
    v = np.array([x for _, x in data], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return np.round(v @ v.T, 9)


def links(data, similar):
    """{id: (class, links)} by all pairs."""
    near = cosines(data) >= similar
    np.fill_diagonal(near, False)
    label = np.arange(len(data))
    while True:
        least = np.minimum(label, np.where(near, label, len(data)).min(1))
        if (least == label).all():
            return {data[i][0]: (data[int(label[i])][0], int(near[i].sum())) for i in range(len(data))}
        label = least


def found(df, **how):
    out = metric.near_vectors(df, **how).collect()
    assert len({x["vec_id"] for x in out}) == len(out)
    return {x["vec_id"]: (x["class_id"], x["links"]) for x in out}


BAD = [(9001, None), (9002, [0.0] * 12), (9003, [float("nan")] * 12), (None, [1.0] * 12), (9005, [None] + [1.0] * 11), (9006, [])]
SHORT = [(9100, [1.0, 2.0, 3.0]), (9101, [1.0, 2.0, 3.0]), (9102, [-1.0, -2.0, 3.0])]


@pytest.fixture(scope="module")
def vectors(spark):
    data = rows()
    return data, spark.createDataFrame(data + BAD + data[:30] + SHORT, "vec_id int, embedding array<float>")


@pytest.mark.parametrize("cell", [60, 4096])
@pytest.mark.parametrize("similar", [0.95, 0.6])
def test_links_are_exact(spark, vectors, cell, similar):
    data, df = vectors
    want = links(data, similar) | {9100: (9100, 1), 9101: (9100, 1), 9102: (9102, 0)}
    assert found(df, cell=cell, similar=similar) == want and sum(n > 0 for _, n in want.values()) > 200


def test_one_group_holds_most(spark):
    r = np.random.default_rng(3)
    one = r.normal(size=16)
    v = np.concatenate((one + r.normal(size=(400, 16)) * 0.1, np.repeat(one[None], 300, 0), r.normal(size=(300, 16))))
    data = [(i, x.tolist()) for i, x in enumerate(v[r.permutation(len(v))])]
    want = links(data, 0.95)
    assert max(n for _, n in want.values()) > 400
    assert found(spark.createDataFrame(data, "vec_id long, embedding array<double>"), cell=50) == want


def test_copies_are_one(spark, monkeypatch):
    """A third of all rows being one vector, no task holds or compares them."""
    r = np.random.default_rng(7)
    one = r.normal(size=8)
    v = np.concatenate((np.repeat(one[None], 3000, 0), one + r.normal(size=(50, 8)) * 0.05, r.normal(size=(950, 8))))
    data = [(i, x.tolist()) for i, x in enumerate(v[r.permutation(len(v))])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    made = []
    cells, _ = metric.cells(df, "vec_id", "embedding", 100, made, True)
    assert cells.homes.count() == 1001 and cells.homes.agg({"n": "max"}).first()[0] == 3000
    assert found(df, cell=100) == links(data, 0.95)


def test_shards_are_bounded(spark):
    data = [(i, [1.0, 1e-3 * (i % 7)]) for i in range(3000)]
    made = []
    cells, _ = metric.cells(spark.createDataFrame(data, "vec_id int, embedding array<float>"), "vec_id", "embedding", 100, made)
    assert max(x["count"] for x in cells.homes.groupBy("shard").count().collect()) < 250


@pytest.mark.parametrize("cell", [60, 4096])
@pytest.mark.parametrize("every", [1, 20])
def test_factor_one_is_exact(spark, vectors, cell, every):
    data, df = vectors
    c = cosines(data)
    np.fill_diagonal(c, -2)
    want = {i: sorted(range(len(data)), key=lambda j: (-c[i, j], j))[:5] for i in range(0, len(data), every)}
    got = {}
    for x in sorted(metric.neighbours(df, k=5, factor=1.0, cell=cell, every=every).collect(), key=lambda x: x["rank"]):
        if x["id"] < 9000:
            got.setdefault(x["id"], []).append(x["neighbour"])
            assert x["cosine"] == pytest.approx(c[x["id"], x["neighbour"]], abs=2e-9)
    assert got == want
    near = [x for x in metric.neighbours(df, k=5, cell=cell, every=every).collect() if x["id"] < 9000]
    assert sum(x["neighbour"] in want[x["id"]] for x in near) >= 0.9 * 5 * len(want)


def test_branches_are_left():
    r = np.random.default_rng(4)
    v = metric._unit(r.normal(size=(4000, 3)))
    tree = metric.VantageTree(v, 20)
    seen = []
    plain = metric._distance
    try:
        metric._distance = lambda c: (seen.append(c.size), plain(c))[1]
        metric.search(tree, np.arange(4000), v[:10], np.arange(10), np.full(10, np.inf), 3, 1.0)
    finally:
        metric._distance = plain
    assert sum(seen) < 0.1 * 10 * 4000


def test_ties_repeats_and_clashing_names(spark):
    data = [(i, [1.0, 0.0], "x", 1) for i in (20, 3, 40, 7)] + [(20, [0.0, 1.0], "y", 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, `VEC_ID` string, shard int")
    # of the vectors of 20 the least is taken
    assert found(df) == {3: (3, 2), 7: (3, 2), 40: (3, 2), 20: (20, 0)}
    near = metric.neighbours(df, k=2).collect()
    assert sorted((x["id"], x["rank"], x["neighbour"]) for x in near) == [(20, 1, 3), (20, 2, 7), (40, 1, 3), (40, 2, 7)]
    with pytest.raises(TypeError):
        metric.near_vectors(df, id_column="VEC_ID")


def test_nothing_and_one(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert metric.near_vectors(df).collect() == [] and metric.neighbours(df).collect() == []
    df = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert found(df) == {20: (20, 0)} and metric.neighbours(df).collect() == []


def test_cover_tree_covers_and_halves():
    v = metric._unit(np.array([x for _, x in rows(5, 400)]))

    def look(node, level):
        d = metric._distance(v[node.members] @ v[node.centre])
        assert len(node.members) == 1 or d.max() <= node.radius
        if node.children:
            assert sorted(np.concatenate([c.members for c in node.children])) == sorted(node.members)
            assert sorted(np.concatenate([node.flat, *(c.members for c in node.wide)])) == sorted(node.members)
            centres = v[[c.centre for c in node.children]]
            apart = metric._distance(centres @ centres.T) + 9 * np.eye(len(centres))
            assert apart.min() > max(c.radius for c in node.children) * 0.99 or len(centres) == 1
            for c in node.children:
                look(c, level / 2)

    look(metric.cover_tree(v, leaf=4), 2.0)


def test_wide_distances_are_compared_in_large_blocks(monkeypatch):
    r = np.random.default_rng(12)
    v = metric._unit(np.concatenate((r.normal(size=(1500, 32)), np.repeat(r.normal(size=(3, 32)), 300, 0) + 1e-3 * r.normal(size=(900, 32)))))
    v, n = v[r.permutation(len(v))], 1600
    similar = 0.35
    reach = float(metric._distance(np.array(similar))) + metric.SLACK
    a = metric.cover_tree(v, np.arange(n), 0, leaf=metric._leaf(reach), reach=reach)
    b = metric.cover_tree(v, np.arange(n, len(v)), n, leaf=metric._leaf(reach), reach=reach)
    steps, plain = [], metric._distance
    monkeypatch.setattr(metric, "_distance", lambda x: steps.append(1) or plain(x))
    own, both = metric.Links(np.ones(len(v), np.int64)), metric.Links(np.ones(len(v), np.int64))
    metric.dual(a, a, v, v.astype(np.float32), similar, own)
    metric.dual(a, b, v, v.astype(np.float32), similar, both)
    near = np.round(v @ v.T, 9) >= similar
    np.fill_diagonal(near, False)
    assert own.count[:n].tolist() == near[:n, :n].sum(1).tolist()
    assert both.count.tolist() == [*near[:n, n:].sum(1), *near[n:, :n].sum(1)]
    assert len(steps) < 2000  # nodes that are followed, of the many small ones
