import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import bpe, text as T


@pytest.fixture(scope="module")
def plain():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(plain, texts):
    v = bpe.vocabulary(bpe.VOCABULARY)
    e = bpe.Encoder(v)
    for c in T.chunks(pa.array(texts, pa.large_string()), 1 << 12):
        ids, n = e.encode(c)
        at = np.concatenate(([0], np.cumsum(n)))
        for j in range(len(c)):
            got = ids[at[j] : at[j + 1]]
            assert got.tolist() == plain.encode_ordinary(texts[c.first + j])
            assert v.decode(got).tobytes().decode() == texts[c.first + j]


def test_as_the_plain_algorithm(plain):
    r = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "２", "!", "…", " ", " ", "😀", "中", "'S", "\r\n", "́", "²", "the"]
    same(plain, ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(5000)])


def test_very_long_pieces(plain):
    r = random.Random(2)
    same(plain, ["a" * 3000, "ab" * 2000, " " * 500, "", "'" * 50, "x " * 10, "".join(r.choices("abcdethe", k=60_000)), "ab" * 127 + "c", "é" * 700])


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_pieces_are_told_by_their_bytes(plain, monkeypatch):
    texts = [x for n in (512, 1024, 2048, 4096, 8192) for x in (thue_morse(n), thue_morse(n, "b", "a"))]
    same(plain, texts)
    # pieces that share a hash, in one chunk and in later ones
    monkeypatch.setattr(bpe.Encoder, "_mixed", staticmethod(lambda h, word: h & T.U(0)))
    r = random.Random(6)
    same(plain, ["".join(r.choices("abcde", k=r.choice([3, 8, 9, 12, 40, 64, 65]))) for _ in range(400)] * 2 + [" ".join("".join(r.choices("xyz", k=11)) for _ in range(300)) for _ in range(6)])


def test_long_only_chooses_the_algorithm():
    v = bpe.vocabulary(bpe.VOCABULARY)
    r = random.Random(7)
    (c,) = T.chunks(pa.array(["".join(r.choices("abcdethe", k=n)) for n in (5, 60, 300, 900)], pa.large_string()))
    assert len({tuple(bpe.Encoder(v, long).encode(c)[0].tolist()) for long in (16, 64, 256, 2000)}) == 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_any_text(plain, texts):
    same(plain, texts)


def test_remembering_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    r = random.Random(3)
    same(plain, [" ".join(f"w{r.randrange(500)}" for _ in range(40)) for _ in range(60)])


def test_rows(spark, plain):
    rows = [(1, "Hello, world's end", 5), (2, None, 6), (3, "", 7), (None, "x", 8), (1, "Hello, world's end", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    out = bpe.encode(df).collect()
    assert sorted((str(x["doc_id"]), x["n_tokens"], x["round_trip"]) for x in out) == sorted((str(i), None if t is None else len(plain.encode_ordinary(t)), None if t is None else True) for i, t, _ in rows)
    full = bpe.encode_documents(df)
    assert full.columns == ["doc_id", "text", "tokens", "n_tokens"]
    back = bpe.decode(full).collect()
    assert all(x["decoded"] == x["text"] for x in back) and len(back) == 5
    assert bpe.encode(df.limit(0)).collect() == []


def test_pieces_of_equal_hashes_as_rows(spark, plain):
    rows = [(i, t) for i, t in enumerate((thue_morse(2048), thue_morse(2048, "b", "a"), "x " + thue_morse(1024)))]
    df = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    want = {i: plain.encode_ordinary(t) for i, t in rows}
    assert {x["doc_id"]: x["tokens"] for x in bpe.encode_documents(df).collect()} == want
    assert all(x["tokens"] == want[x["doc_id"]] and x["round_trip"] for x in bpe.encode(df).collect())


def test_clashing_names_and_ids(spark):
    df = spark.createDataFrame([(1, "one two", "x", True)], "doc_id int, text string, TEXT string, round_trip boolean")
    assert bpe.encode(df).first()["n_tokens"] == 2
    full = bpe.encode_documents(df)
    assert full.columns == ["doc_id", "text", "TEXT", "round_trip", "tokens", "n_tokens"] and full.first()[2] == "x"
    with pytest.raises(TypeError):
        bpe.encode(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
