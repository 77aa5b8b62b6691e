import math
import random

import numpy as np
import pyarrow as pa
import pytest
from test_crf import plain as recursion

from keystrata.llm import quality, text as T


def document(r, good):
    lines = []
    for _ in range(r.randint(2, 8)):
        w = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(r.randint(5, 40))]
        lines.append(" ".join(w).capitalize() + "." if good else r.choice([" ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join(x + "$$$" for x in w)]))
    if not good and r.random() < 0.5:
        lines[0] = document(r, True).split("\n")[0]
    return "\n".join(lines)


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(2)
    return [(document(r, good), int(good)) for good in [True] * 150 + [False] * 60]


def test_held_out(labelled):
    m = quality.fit(*map(list, zip(*labelled)))
    r = random.Random(9)
    fresh = [(document(r, good), good) for good in [True] * 100 + [False] * 100]
    right = 0
    for c in T.chunks(pa.array([t for t, _ in fresh])):
        q, _, _ = quality.judge(c, m)
        right += sum((x >= quality.KEEP) == good for x, (_, good) in zip(q, fresh[c.first :]))
    assert right >= 194


def test_rows(spark, labelled):
    rows = [(i, t, "x") for i, (t, _) in enumerate(labelled)] + [(900, None, "n"), (901, "", "e"), (902, " \n\t", "w"), (None, labelled[0][0], "i"), (0, labelled[0][0], "again")]
    labels = [(i, y) for i, (_, y) in enumerate(labelled)] + [(None, 1), (5000, 0), (3, None), (4, 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, `keep` string")
    m = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    out = quality.document_quality(df, m).collect()
    assert len(out) == len(rows)
    by = {x["doc_id"]: x for x in out}
    assert all((by[i]["quality"], by[i]["n_lines"], by[i]["keep"]) == (0, 0, False) for i in (900, 901, 902))
    assert by[None]["keep"] and sum(by[i]["keep"] == bool(y) for i, (_, y) in enumerate(labelled)) >= 205
    kept = quality.drop_bad_documents(df, m)
    assert kept.columns == df.columns
    assert sorted(map(str, (x[0] for x in kept.collect()))) == sorted(str(x["doc_id"]) for x in out if x["keep"])


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "one line"), (2, None)], "doc_id long, text string")
    m = quality.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert {x["doc_id"]: (x["quality"], x["keep"]) for x in quality.document_quality(df, m).collect()} == {1: (0.5, True), 2: (0.0, False)}
    assert quality.drop_bad_documents(df.limit(0), m).collect() == []


def test_very_long_text_and_many_lines():
    m = quality.fit(["Good line here.", "BAD!! BAD!!"], [1, 0], 5)
    (c,) = T.chunks(pa.array(["word " * 300_000 + "\n" * 5 + "x\n" * 20_000]))
    q, n, bad = quality.judge(c, m)
    assert n[0] == 20_001 and 0 <= q[0] <= 1


def plain(text, m):
    """(quality, lines, bad lines) of one text, line by line, with the textbook recursion."""
    own, sizes, before = [], [], set()
    stops, others = b".,;:?'\"-()", b"!#$%&*+/<=>@[\\]^_`{}~"
    for line in (text or "").encode().split(b"\n"):
        words = line.split()
        if not words:
            continue
        span, n = line.strip(), len(words)
        low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
        count = lambda f: sum(map(f, span)) / len(span)  # noqa: E731, B023
        own.append([math.log1p(len(span)) / 5, count(lambda b: 65 <= b <= 90), 4 * count(lambda b: 48 <= b <= 57), 4 * count(lambda b: b in stops), 4 * count(lambda b: b == 124), 4 * count(lambda b: b in others),
            count(lambda b: b >= 128), len(span) / n / 10, 2 * sum(a == b for a, b in zip(low, low[1:])) / n, 2 * (n - len(set(low))) / n, math.log1p(n) / 4, float(tuple(low) in before), 1.0])
        before.add(tuple(low))
        sizes.append(len(span))
    if not own:
        return 0.0, 0, 0
    none = [0.0] * 13
    x = np.array([a + b + c + [min(size / 2000, 3)] for a, b, c, size in zip(own, [none, *own], [*own[1:], none], sizes)])
    good = x @ m.weights
    post = recursion(np.stack((-good / 2, good / 2), 1), [len(own)], m.trans, m.begin)[0][:, 1]
    return float((post * sizes).sum() / sum(sizes)), len(own), int((post < 0.5).sum())


def odd_texts():
    return [None, "", " \n\t", "one", "a a a b\nA A A B\n\n  x | y | z  \n12 34!!", "é ü\nÉ ü", "no end.\n" * 40, "tabs\tand\x0bmore\r\nlines (here) \"quoted\"", "w " * 3000]


def test_as_a_plain_version(spark, labelled):
    m = quality.fit(*map(list, zip(*labelled[:60] + labelled[150:180])))
    texts = [t for t, _ in labelled[:25] + labelled[-25:]] + odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = quality.document_quality(df, m).collect()
    assert len(out) == len(texts)
    for x in out:
        q, n, bad = plain(texts[x["doc_id"]], m)
        assert (x["n_lines"], x["n_bad_lines"], x["keep"]) == (n, bad, n > 0 and q >= quality.KEEP) and x["quality"] == pytest.approx(q, abs=1e-9)


def test_clashing_names(spark, labelled):
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, (t, _) in enumerate(labelled)], "doc_id int, text string, TEXT string, QUALITY double")
    labels = spark.createDataFrame([(i, y, 7) for i, (_, y) in enumerate(labelled)], "doc_id int, quality int, Quality int")
    m = quality.train(df, labels)
    assert quality.drop_bad_documents(df, m).columns == df.columns and quality.document_quality(df, m).count() == len(labelled)
    with pytest.raises(TypeError):
        quality.document_quality(spark.createDataFrame([("a", "b")], "doc_id string, text string"), m)
