import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from keystrata.llm import minhash, text as T
from keystrata.llm.components import components


@lru_cache(None)
def shingles(t):
    w = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    both = sum((x & y).values())
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


def groups(rows, similar):
    """{doc_id: least id of its group}, by all pairs."""
    ids = {i: i for i, _ in rows}

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if jaccard(a, b) >= similar:
                x, y = sorted((root(i), root(j)))
                ids[y] = x
    return {i: root(i) for i in ids if root(i) != i}


def edited(r, t, share):
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in t.split())


def test_as_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(r.choices(words, k=r.choice([1, 2, 5, 30, 200, 900])))) for i in range(150)]
    for i in range(150, 260):
        base = rows[r.randrange(150)][1]
        rows.append((i, edited(r, base, 0.05) if r.random() < 0.7 else base))
    rows += [(i, rows[7][1]) for i in range(300, 330)]
    extra = [(900, None), (901, ""), (902, "!? ,"), (None, rows[3][1])]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string")
    got = {x[0]: x[1] for x in minhash.near_duplicates(df).collect()}
    surely, maybe = groups(rows, 0.7), groups(rows, 0.35)
    assert sum(i in got for i in surely) >= 0.99 * len(surely) and len(surely) > 50
    assert all(i in maybe and maybe[i] == maybe.get(k, k) for i, k in got.items())
    assert all(k not in got for k in got.values())
    kept = {x[0] for x in minhash.drop_near_duplicates(df).collect()}
    assert kept == {i for i, _ in rows + extra} - set(got)


def candidates(rows, bands=minhash.BANDS, per=minhash.ROWS, similar=minhash.SIMILAR):
    """{doc_id: least id of its group}, by every two texts that share a bucket and are similar by their signatures."""
    k = bands * per
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    out = pa.Table.from_batches(minhash._sign(bands, per)([batch]))
    ids, sig = out["doc_id"].to_pylist(), np.array([[x >> 4, x & 15] for s in out["sig"].to_pylist() for x in s]).reshape(len(rows), -1)[:, :k]
    bucket = np.array(out["bands"].to_pylist())
    root = {i: i for i in ids}
    for n in range(len(ids)):
        alike = ((sig[:n] == sig[n]).mean(1) - 1 / 16) / (15 / 16) >= similar
        for j in np.flatnonzero(alike & (bucket[:n] == bucket[n]).any(1)).tolist():
            x, y = sorted((root[ids[n]], root[ids[j]]))
            if x != y:
                root = {i: x if least == y else least for i, least in root.items()}
    return {i: least for i, least in root.items() if least != i}


def around_one(seed, n, first):
    """n copies of one text, like it but not each other, and copies of copies; the original has neither the least nor the greatest id."""
    r = random.Random(seed)
    base = [f"b{seed}x{i}" for i in range(300)]
    rows = [(first + 2 * i, edited(r, " ".join(base), 0.14)) for i in range(n)]
    rows += [(first + 2 * i + 1, rows[i][1]) for i in range(0, n, 40)]
    return rows + [(first + n + 1 - n % 2, " ".join(base))]


def test_every_pair_of_a_bucket(spark):
    rows = [x for seed in range(3) for x in around_one(seed, 240, 1000 * seed)]
    want = candidates(rows)
    assert len(want) > 0.8 * len(rows)  # else the test says little
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x[0]: x[1] for x in minhash.near_duplicates(df).collect()} == want
    for block in (7, 50):  # the same in pieces
        assert {x[0]: x[1] for x in components(minhash.similar_pairs(df, block=block)).collect()} == want


def test_pairs_from_the_threshold_on_share_a_bucket():
    r = random.Random(11)
    pairs = []
    while len(pairs) < 500:
        a = " ".join(f"w{r.randrange(5000)}" for _ in range(r.choice([60, 150, 400])))
        b = edited(r, a, r.uniform(0.12, 0.2))
        if 0.5 <= jaccard(a, b) < 0.57:
            pairs += [a, b]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pairs))), pa.array(pairs)], ["doc_id", "text"])
    bucket = np.array(pa.Table.from_batches(minhash._sign(minhash.BANDS, minhash.ROWS)([batch]))["bands"].to_pylist())
    assert (bucket[::2] == bucket[1::2]).any(1).mean() > 0.95


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(1, "a b c", 1, 2), (2, "a b c", 3, 4), (2, "x y z", 3, 4)], "doc_id int, text string, lead int, `gone.x` int")
    out = minhash.drop_near_duplicates(df)
    # rows that share an id but not the text are judged apart
    assert out.columns == df.columns and sorted(tuple(x)[:2] for x in out.collect()) == [(1, "a b c"), (2, "x y z")]


def test_one_row_of_full_repeats_stays(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b c", "y", 2), (2, "d e f", "x", 3), (2, "g h i", "x", 4), (3, None, "x", 5), (3, None, "x", 6), (None, "j k", "x", 7), (None, "j k", "x", 8), (4, "a b c", "x", 9)]
    out = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id int, text string, `id` string, `key` int"))
    assert out.columns == ["doc_id", "text", "id", "key"] and sorted(x["key"] for x in out.collect()) == [1, 3, 4, 5, 6, 7, 8]


def test_agreement_is_weighted_jaccard():
    r = np.random.default_rng(1)
    x = np.round(r.uniform(0.1, 6, 80), 2)
    y = np.where(r.random(80) < 0.5, x, np.round(r.uniform(0.1, 6, 80), 2))
    e = T.stream(80, 99)
    of = np.repeat([0, 1], 80)
    sig, some = minhash.signatures(of, np.concatenate((e, e)), np.concatenate((x, y)), 2, 4000)
    assert some.all() and abs((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.03


def test_elements_count_repeats():
    (c,) = T.chunks(pa.array(["A b a B", "one", None, "", "?"]))
    of, _, weight = minhash.elements(c)
    assert sorted(zip(of.tolist(), weight.tolist())) == [(0, 1.0), (0, 2.0), (1, 1.0)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (7, None)], "a long, b long")
    got = {x[0]: x[1] for x in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_no_task_holds_the_copies_of_a_text(spark):
    """One text 10**5 times, and near copies of another in every batch: what meets in a task is bounded by the batches."""
    one, other = " ".join(f"a{i}" for i in range(40)), [f"b{i}" for i in range(120)]
    r = random.Random(4)
    rows = [(100_000 + i, edited(r, " ".join(other), 0.04)) for i in range(600)]
    df = spark.range(100_000).selectExpr("id AS doc_id", f"'{one}' AS text").union(spark.createDataFrame(rows, "doc_id long, text string")).repartition(16)
    got = {x[0]: x[1] for x in minhash.near_duplicates(df).collect()}
    assert sum(k == 0 for k in got.values()) == 99_999 and sum(k == 100_000 for k in got.values()) == 599
    batch = pa.RecordBatch.from_arrays([pa.array([5, 3, 9]), pa.array([[1, 2], [1, 7], [8, 2]])], ["doc_id", "bands"])
    assert [tuple(x.values()) for x in next(minhash._local([batch])).to_pylist()] == [(1, 3, 3), (1, 5, 3), (2, 5, 5), (2, 9, 5), (7, 3, 3), (8, 9, 9)]


def test_very_long_texts_and_ids(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    df = spark.createDataFrame([(7, long), (3, long + " more"), (5, "x y")], "doc_id int, text string")
    assert [tuple(x) for x in minhash.near_duplicates(df).collect()] == [(7, 3)]
    with pytest.raises(TypeError):
        minhash.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    odd = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y")], "doc_id int, text string, TEXT string")
    assert [tuple(x) for x in minhash.drop_near_duplicates(odd).collect()] == [(1, "a b c", "x")]


def test_rows_that_share_an_id_are_judged_apart(spark):
    rows = [(5, "a b c d"), (5, "e f g h"), (5, "e f g h"), (7, "a b c d"), (7, "i j k l"), (2, "i j k l"), (9, None), (9, "m n o p"), (None, "a b c d"), (9, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(map(tuple, minhash.drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, "a b c d"), (5, "e f g h"), (2, "i j k l"), (9, None), (9, "m n o p"), (None, "a b c d"), (9, "")], key=str)
