import random

import pytest

from keystrata.llm import substrings


def brute(rows, k):
    """{(doc_id, start, n, first, copies)} of docs with distinct ids."""
    where = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None and t is not None):
        w = t.split()
        for p in range(len(w) - k + 1):
            where.setdefault(tuple(w[p : p + k]), []).append((i, p))
    state = {}
    for at in where.values():
        if len(at) > 1:
            for x in at:
                state[x] = (x == min(at), len(at))
    out = set()
    for i, p in sorted(state):
        first, n = state[i, p]
        if (i, p - 1) in state and state[i, p - 1][0] == first:
            continue
        q, most = p, 0
        while (i, q) in state and state[i, q][0] == first:
            most = max(most, state[i, q][1])
            q += 1
        out.add((i, p, q - p + k - 1, first, most))
    return out


def found(spark, rows, k, m, hot=substrings.HOT):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {tuple(r) for r in substrings.repeated_passages(df, k, m, hot).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_as_brute_force(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3 if seed == 0 else 60)]
    shared = [" ".join(r.choices(words, k=r.randint(5, 30))) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [" ".join(r.choices(words, k=r.randint(0, 25))) for _ in range(3)]
        parts.insert(r.randint(0, 3), r.choice(shared))
        rows.append((i, r.choice(["  ", "\n", " "]).join(parts)))
    rows += [(100, None), (101, ""), (102, " \n"), (None, shared[0])]
    assert found(spark, rows, 8, 3) == brute(rows, 8) == found(spark, rows, 8, 3, hot=4)


def test_empty_table(spark):
    assert found(spark, [], 8, 3) == set()


def test_repeated_rows_are_not_later_than_each_other(spark):
    t = " ".join(f"w{i}" for i in range(20))
    got = found(spark, [(1, t), (1, t), (2, t)], 8, 3)
    assert {(x[0], x[3]) for x in got} == {(1, True), (2, False)} and {x[4] for x in got} == {3}


def test_very_long_text(spark):
    r = random.Random(9)
    w = [f"x{r.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(w)), (2, "a b c " + " ".join(w[30_000:30_100]))]
    assert found(spark, rows, 50, 5) == brute(rows, 50)


def test_drop_later_copies(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"head {p} tail", 5, "x"), (2, f"other {p}\nend of it", 5, "y"), (3, p, 5, None), (4, None, 0, "z"), (None, p, 5, "n"), (5, "", 0, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, `__runs.x` string")
    out = substrings.drop_later_copies(df)
    assert out.columns == df.columns
    got = {(r[0], r[1]) for r in out.collect()}
    assert got == {(1, f"head {p} tail"), (2, "other\nend of it"), (4, None), (None, p), (5, "")}




def test_a_passage_in_every_row_is_in_no_task_s_bucket(spark):
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'a{r.randrange(10**6)}' for _ in range(12))} {passage} {' '.join(f'b{r.randrange(10**6)}' for _ in range(12))}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    seen = []
    plain = substrings._extract
    try:
        substrings._extract = lambda k, m, hot: (seen.append(hot), plain(k, m, hot))[1]
        out = substrings.repeated_passages(df, 50, 5, hot=1000).collect()
    finally:
        substrings._extract = plain
    assert {tuple(x) for x in out} == brute(rows, 50)
    (hot,) = seen
    assert len(hot)
    texts = [t.encode() for _, t in rows]
    rest = substrings.super_kmers(texts, 50, 5)[2]
    assert all((rest == b).sum() <= 1000 for b in set(rest.tolist()) - set(hot.tolist()))  # what is left to tasks
    kept = substrings.drop_later_copies(df, 50, 5, hot=1000).collect()
    assert sum("p5 p6" in x["text"] for x in kept) == 1 and len(kept) == 3000


def test_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_chars int")
    assert substrings.drop_later_copies(df).collect() == []
    t = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(2, t, "x", 1), (1, "v " + t, "y", 2), (3, None, "z", 3)], "doc_id int, text string, TEXT string, `key` int")
    assert [tuple(x) for x in substrings.repeated_passages(df).orderBy("doc_id").collect()] == [(1, 1, 200_000, True, 2), (2, 0, 200_000, False, 2)]
    out = substrings.drop_later_copies(df)
    assert out.columns == df.columns and sorted(x["key"] for x in out.collect()) == [2, 3]
    with pytest.raises(TypeError):
        substrings.repeated_passages(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
