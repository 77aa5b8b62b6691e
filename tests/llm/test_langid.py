import random

import numpy as np
import pyarrow as pa
import pytest
from test_crf import plain as recursion

from keystrata.llm import langid, text as T

PARTS = {"aa": "ka lo mi ne pu ra", "bb": "sch ung lich keit ver ge", "cc": "tion eau é ou vi re"}


def words(r, lang, n):
    return ["".join(r.choices(PARTS[lang].split(), k=r.randint(1, 4))) for _ in range(n)]


def corpus(r, n):
    return [(" ".join(words(r, lang, r.randint(20, 200))), lang) for _ in range(n) for lang in PARTS]


def test_held_out_code_switched_text():
    r = random.Random(3)
    m = langid.fit(*map(list, zip(*corpus(r, 25))))
    g = np.random.default_rng(1)
    right = total = 0
    for _ in range(20):
        w, of = langid.splice(g, [[x.encode() for x in words(r, lang, 150)] for lang in sorted(PARTS)])
        (c,) = T.chunks(pa.array([b" ".join(w).decode()]))
        _, best, n = langid.label(c, m)
        assert n[0] == len(of)
        right, total = right + (best == of).sum(), total + len(of)
    assert right / total > 0.93


def test_rows(spark):
    r = random.Random(4)
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate(corpus(r, 12))]
    rows += [(100, None, "aa", 1), (101, "", "bb", 1), (102, "!?", None, 1), (None, rows[0][1], "aa", 1), (0, rows[1][1], None, 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, `share` int")
    out = langid.word_languages(df, langid.train(df)).collect()
    assert len(out) == len(rows)
    by = {x["doc_id"]: x for x in out if x["doc_id"] not in (0, None)}
    assert sum(by[i]["lang"] == rows[i][2] for i in range(1, 36)) >= 34
    assert all((by[i]["lang"], by[i]["share"], by[i]["n_words"], by[i]["runs"]) == (None, None, 0, []) for i in (100, 101, 102))
    for x in out:
        assert sum(y["n_words"] for y in x["runs"]) == x["n_words"] and x["n_switches"] == max(0, len(x["runs"]) - 1)


def test_no_language_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    (x,) = langid.word_languages(df, langid.train(df)).collect()
    assert (x["lang"], x["share"], x["n_words"]) == (None, None, 2)
    assert langid.word_languages(df.limit(0), langid.train(df.limit(0))).collect() == []


def plain(text, m):
    """(lang, share, n_words, n_switches, runs) of one text, word by word, with the textbook recursion."""
    data, words, now = (text or "").encode(), [], b""
    for b in data + b" ":
        low = b + 32 if 65 <= b <= 90 else b
        if 48 <= low <= 57 or 97 <= low <= 122 or low >= 128:
            now += bytes([low])
        elif now:
            words.append(now)
            now = b""
    if not words:
        return None, None, 0, 0, []
    slot = lambda x, kind: ((x * 0x9E3779B97F4A7C15 + kind * 0xD1B54A32D192ED03) * 0xBF58476D1CE4E5B9 % 2**64) >> 48
    score = []
    for w in words:
        one = T.Words(np.array([0]), np.array([len(w)]), np.array([0]), np.array([0, 1]))
        rows = [slot(int(T.hashes(np.frombuffer(w, np.uint8), one)[0]), 0)]
        for i in range(3):
            rows += [slot(int.from_bytes(w[: min(len(w), i + 1)], "big"), 1 + i), slot(int.from_bytes(w[::-1][: min(len(w), i + 1)], "big"), 4 + i)]
        rows += [slot(int.from_bytes(w[j : j + 3], "big"), 7) for j in range(len(w) - 2)]
        score.append(m.weights[rows].astype(np.float64).sum(0))
    post = recursion(np.array(score), [len(words)], m.trans, m.begin)[0]
    mean, runs = post.mean(0), []
    for best in post.argmax(1):
        if runs and runs[-1][0] == m.languages[best]:
            runs[-1][1] += 1
        else:
            runs.append([m.languages[best], 1])
    return m.languages[mean.argmax()], mean.max(), len(words), len(runs) - 1, [tuple(x) for x in runs]


def test_as_a_plain_version(spark):
    r = random.Random(8)
    g = np.random.default_rng(2)
    texts = [t for t, _ in corpus(r, 6)] + [" ".join(w.decode() for w in langid.splice(g, [[x.encode() for x in words(r, lang, 60)] for lang in PARTS])[0]) for _ in range(6)]
    texts += [None, "", " \n", "a", "É é ü", "A1-b2_C3", "x" * 5000 + " ka lo"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    m = langid.fit(*map(list, zip(*corpus(random.Random(3), 8))))
    for x in langid.word_languages(df, m).collect():
        lang, share, n, switches, runs = plain(texts[x["doc_id"]], m)
        assert (x["lang"], x["n_words"], x["n_switches"], [tuple(y) for y in x["runs"]]) == (lang, n, switches, runs)
        assert x["share"] is None if share is None else x["share"] == pytest.approx(share, abs=1e-9)


def test_ties_long_texts_and_clashing_names(spark):
    even = langid.Model(["aa", "bb"], np.zeros((langid.TABLE, 2), np.float32), np.zeros((2, 2)), np.zeros(2))
    df = spark.createDataFrame([(1, "one two " * 300_000, "x", "q")], "doc_id long, text string, TEXT string, lang string")
    (x,) = langid.word_languages(df, even).collect()
    assert (x["lang"], x["share"], x["n_words"], x["n_switches"]) == ("aa", 0.5, 600_000, 0)  # the first by name
    assert langid.train(df).languages == ["q"]
    with pytest.raises(TypeError):
        langid.word_languages(spark.createDataFrame([("a", "b")], "doc_id string, text string"), even)


def test_languages_are_bounded(spark):
    df = spark.range(langid.LANGUAGES + 1).selectExpr("id AS doc_id", "'a b' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError, match="256"):
        langid.train(df)
