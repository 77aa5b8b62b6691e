from collections import Counter

import pytest

from keystrata.llm import mixing


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int, `of` string")


def test_quotas_are_exact(spark):
    rows = [(i, "t", "en", "big" if i % 10 else "small", i % 700, 1, "z") for i in range(3000)] + [(5000 + i, None, None, None, None, 1, "z") for i in range(40)]
    df = table(spark, rows)
    n = Counter(r[3] for r in rows)
    out = mixing.mix(df)
    assert out.columns == df.columns
    got = Counter(r[3] for r in out.collect())
    total = sum(v**0.5 for v in n.values())
    assert sum(got.values()) == len(rows)
    assert all(abs(got[s] - len(rows) * n[s] ** 0.5 / total) < 1 for s in n)
    named = Counter(r[3] for r in mixing.mix(df, rate=0.1, weights={"big": 1, "small": 3, "absent": 6}).collect())
    assert named == {"big": 76, "small": 228} and sum(named.values()) == 304


def test_inclusion_follows_size(spark):
    df = table(spark, [(i, "t", "en", "s", 9999 if i % 2 else 0, 1, "z") for i in range(4000)])
    got = Counter()
    for x in mixing.sample(df, rate=0.3).collect():
        got[x["doc_id"] % 2] += x["copies"]
    assert sum(got.values()) == 1200 and got[1] > 1150  # sizes 100 and 1: 1188 to 12
    twice = {x["doc_id"]: x["copies"] for x in mixing.sample(df, rate=1.5).collect()}
    assert all(twice[i] in (2, 3) for i in range(1, 4000, 2))


def test_empty_table_repeats_and_one_row(spark):
    assert mixing.mix(table(spark, [])).collect() == []
    assert [r[0] for r in mixing.mix(table(spark, [(None, None, None, None, -5, 1, "z")])).collect()] == [None]
    df = table(spark, [(1, "t", "en", "s", 3, 1, "z")] * 6)
    assert {x["copies"] for x in mixing.sample(df).collect()} == {1}


def test_ties_long_texts_and_clashing_names(spark):
    rows = [(1 + i // 3, "t" * (2_000_000 if i == 5 else 1), "s", 9, "x", 1) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, n_chars int, SOURCE string, id int")
    out = mixing.mix(df, rate=0.5)
    assert out.columns == df.columns
    got = Counter(x[0] for x in out.collect())
    # rows of one doc_id share a random number: they are drawn together
    assert set(got.values()) == {3} and 6 <= sum(got.values()) <= 8
    with pytest.raises(TypeError):
        mixing.sample(spark.createDataFrame([("a", "t", "s", 1)], "doc_id string, text string, source string, n_chars int"))
