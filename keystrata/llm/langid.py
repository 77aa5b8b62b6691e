"""The language of every word of code-switched text, by a linear-chain conditional random field.

A word's features are the word itself (a hashed lexicon), its prefixes and suffixes of one to three bytes and its byte
trigrams, each with a learned weight per language; transitions between languages are learned too. Forward-backward over the
whole text gives each word's marginals, and the word the language of the greatest.

The field is trained on texts whose language is given, at most SAMPLE of each language, those of least hash of their doc_id:
half of them as they are, half spliced from stretches of texts of all languages, whose words' languages are known.

Words are runs of letters and digits, ASCII letters in lower case; all bytes beyond ASCII count as letters. Null and empty
texts and texts without words have no runs, no language and a null share. Rows without a doc_id and rows that repeat one are
labelled like any other. Where no language is given at all, every word's language is null. Ties go to the language that is
first by name. Columns other than doc_id, text and lang aren't read. An empty table gives an empty result.
Ids that aren't integers are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm import common, crf, text as T

#: Most texts of a language that the field is trained on.
SAMPLE = 100
#: Most languages of a field, whose weights every task holds; more are an error.
LANGUAGES = 256
#: Rows of the table of weights.
TABLE = 1 << 16
PASSES = 3
BATCH = 40_000


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # TABLE x languages
    trans: np.ndarray
    begin: np.ndarray


class Features(NamedTuple):
    words: np.ndarray  # words x 7 rows of the table
    grams: np.ndarray  # rows of the table of all trigrams
    of: np.ndarray  # trigrams of each word


def _slot(x: np.ndarray, kind: int) -> np.ndarray:
    return ((x * T.U(0x9E3779B97F4A7C15) + T.U(kind * 0xD1B54A32D192ED03 & (1 << 64) - 1)) * T.U(0xBF58476D1CE4E5B9) >> T.U(48)).astype(np.int32)


def features(low: np.ndarray, w: T.Words) -> Features:
    length = w.end - w.start
    pad = np.concatenate((low, np.zeros(3, np.uint8))).astype(T.U)
    out = np.empty((len(length), 7), np.int32)
    out[:, 0] = _slot(T.hashes(low, w), 0)
    head, tail = np.zeros(len(length), T.U), np.zeros(len(length), T.U)
    for i in range(3):  # shorter words repeat themselves
        there = length > i
        head = np.where(there, head << T.U(8) | pad[w.start + i], head)
        tail = np.where(there, tail << T.U(8) | pad[np.maximum(w.end - 1 - i, 0)], tail)
        out[:, 1 + i] = _slot(head, 1 + i)
        out[:, 4 + i] = _slot(tail, 4 + i)
    n = np.maximum(length - 2, 0)
    at = T.ragged(w.start, n)
    return Features(out, _slot(pad[at] << T.U(16) | pad[at + 1] << T.U(8) | pad[at + 2], 7), n)


def scores(f: Features, weights: np.ndarray) -> np.ndarray:
    total = weights[f.words[:, 0]].astype(np.float64)
    for i in range(1, 7):
        total += weights[f.words[:, i]]
    sums = np.zeros((len(f.grams) + 1, weights.shape[1]))
    np.cumsum(weights[f.grams], axis=0, out=sums[1:], dtype=np.float64)
    ends = np.cumsum(f.of)
    return total + sums[ends] - sums[ends - f.of]


def _words(c: T.Texts) -> tuple[np.ndarray, T.Words]:
    low = T.LOWER[c.data]
    return low, T.spans(T.WORD[low], c.offsets)


def splice(r: np.random.Generator, texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """(words, which text each is from): stretches of the texts' words in turn, until one of them runs out."""
    at, words, of = [0] * len(texts), [], []
    now = int(r.integers(len(texts)))
    while True:
        n = int(r.integers(3, 40))
        stretch = texts[now][at[now] : at[now] + n]
        at[now] += n
        words += stretch
        of += [now] * len(stretch)
        if at[now] >= len(texts[now]):
            return words, np.array(of, np.int64)
        if len(texts) > 1:
            now = (now + int(r.integers(1, len(texts)))) % len(texts)


def fit(texts: list[str], langs: list[str], passes: int = PASSES) -> Model:
    """The field, from texts in one language each."""
    languages = sorted(set(langs))
    k = len(languages)
    m = Model(languages, np.zeros((TABLE, k), np.float32), np.zeros((k, k)), np.zeros(k))
    r = np.random.default_rng(1)
    by: list[list[list[bytes]]] = [[] for _ in languages]
    whole: list[tuple[list[bytes], np.ndarray]] = []
    for t, lang in zip(texts, langs):
        for c in T.chunks(pa.array([t], pa.large_string())):
            low, w = _words(c)
            data = low.tobytes()
            words = [data[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]
            if words:
                by[languages.index(lang)].append(words)
                whole.append((words, np.full(len(words), languages.index(lang))))
    kept = [x for x in range(k) if by[x]]
    for i in range(len(whole) if len(kept) > 1 else 0):
        words, of = splice(r, [by[x][i % len(by[x])] for x in kept])
        whole.append((words, np.array(kept)[of]))
    r.shuffle(whole)
    batches: list[tuple[Features, np.ndarray, np.ndarray]] = []
    held: list[tuple[list[bytes], np.ndarray]] = []
    for i, x in enumerate(whole):
        held.append(x)
        if sum(len(y) for _, y in held) >= BATCH or i == len(whole) - 1:
            low, w = _words(next(T.chunks(pa.array([b" ".join(a for words, _ in held for a in words)], pa.large_binary()).cast(pa.large_string()), 1 << 62)))
            batches.append((features(low, w), np.concatenate([y for _, y in held]), np.array([len(y) for _, y in held])))
            held = []
    weights = m.weights.astype(float)
    adam = crf.Adam(weights, m.trans, m.begin, rate=0.1)
    for _ in range(passes):
        for f, y, length in batches:
            post, expected, _z = crf.marginals(scores(f, weights), length, m.trans, m.begin)
            pairs, first = crf.counts(y, length, k)
            left = -post
            left[np.arange(len(y)), y] += 1
            grams = np.repeat(left, f.of, axis=0)
            grad = np.stack([np.bincount(f.words.ravel(), np.repeat(left[:, j], 7), TABLE) + np.bincount(f.grams, grams[:, j], TABLE) for j in range(k)], 1)
            start = np.concatenate(([0], np.cumsum(length)[:-1]))
            adam.step(grad / len(y) - 1e-6 * weights, (pairs - expected) / len(y), (first - post[start].sum(0)) / len(y))
    return m._replace(weights=weights.astype(np.float32))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The field, from the texts of least hash, at most sample of each language that is given."""
    common.integers(docs, "doc_id")
    d = common.narrow(docs, doc_id="doc_id", text="text", lang="lang")
    ids = d.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("name")).filter("id IS NOT NULL AND name IS NOT NULL").distinct()
    if ids.select("name").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    # of each language the least ids, by way of the least of each of many parts, so that no task sorts a language
    rank = F.row_number().over(Window.partitionBy("name", "part").orderBy("u", "id"))
    ids = ids.withColumn("u", common.unit(1, "id")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(256)))
    ids = ids.withColumn("n", rank).filter(F.col("n") <= sample)
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("u", "id"))).filter(F.col("n") <= sample).select("id", "name")
    few = ids.collect()
    few = docs.sparkSession.createDataFrame([tuple(x) for x in few], "id long, name string")  # sample rows for each language
    rows = d.filter("text IS NOT NULL").join(F.broadcast(few), (F.col("doc_id").cast("long") == F.col("id")) & (F.col("lang").cast("string") == F.col("name"))).select("id", "name", "text").collect()
    rows.sort()
    return fit([x["text"] for x in rows], [x["name"] for x in rows])


def label(c: T.Texts, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, their states, words of each text)."""
    low, w = _words(c)
    n = np.diff(w.first)
    post = crf.marginals(scores(features(low, w), m.weights), n, m.trans, m.begin)[0] if len(m.languages) and len(w.start) else np.ones((len(w.start), max(1, len(m.languages))))
    return post, post.argmax(1), n


def word_languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, share, n_words, n_switches, runs) of each row of docs: lang has the greatest mean marginal, share; runs are the consecutive words of one language."""
    common.integers(docs, "doc_id")
    names = [*model.languages] or [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = pa.array(names, pa.string())
        for batch in batches:
            for c in T.chunks(batch["text"]):
                post, best, n = label(c, model)
                k = post.shape[1]
                of = np.repeat(np.arange(len(c)), n)
                mean = np.stack([np.bincount(of, post[:, j], len(c)) for j in range(k)], 1) / np.maximum(n, 1)[:, None]
                top = mean.argmax(1)
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (best[1:] != best[:-1])
                head = np.flatnonzero(new)
                runs = np.bincount(of[head], minlength=len(c))
                items = pa.StructArray.from_arrays([name.take(pa.array(best[head])), pa.array(np.diff(np.append(head, len(of))))], ["lang", "n_words"])
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(c.first, len(c)),
                        name.take(pa.array(np.where(none, 0, top), mask=none)),
                        pa.array(mean[np.arange(len(c)), top], mask=none | (not model.languages)),
                        pa.array(n),
                        pa.array(np.maximum(runs - 1, 0)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(runs))).astype(np.int32)), items),
                    ],
                    ["doc_id", "lang", "share", "n_words", "n_switches", "runs"],
                )

    d = common.narrow(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    return d.mapInArrow(common.lean(run), "doc_id long, lang string, share double, n_words long, n_switches long, runs array<struct<lang:string,n_words:long>>")
