"""Document quality from a linear-chain conditional random field over lines.

Every line that has a word is labelled good or bad. A line's features are its own and those of the lines before and after
it: length, shares of character classes, word lengths, repetition of words and of lines. The field's marginals, by
forward-backward, weighted by the lines' lengths, average to the document's quality; documents below KEEP are rejected.

The field is trained on at most SAMPLE labelled documents, those of least hash of their doc_id. A document's label is first
that of all its lines; then a bad document's lines are labelled by the trained field, its worst line staying bad, and the
field is trained again.

Null and empty texts and texts without words have quality 0 and are rejected. Rows without a doc_id and rows that repeat one
are judged like any other. Where there are no labelled documents of both kinds, every text with words has quality 0.5 and is
kept. Labels that are null are not used; of several labels of one document the least counts. Columns other than doc_id and
text aren't read. An empty table gives an empty result.
Ids that aren't integers are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm import common, crf, text as T

#: Most labelled documents that the field is trained on.
SAMPLE = 2000
KEEP = 0.5
STEPS = 150

_CLASSES = np.zeros((256, 6), np.uint8)  # upper, digit, stop mark, bar, other mark, beyond ASCII
_CLASSES[65:91, 0] = 1
_CLASSES[48:58, 1] = 1
_CLASSES[[ord(c) for c in ".,;:?'\"-()"], 2] = 1
_CLASSES[ord("|"), 3] = 1
_CLASSES[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{}~"], 4] = 1
_CLASSES[128:, 5] = 1


class Model(NamedTuple):
    weights: np.ndarray
    trans: np.ndarray
    begin: np.ndarray


class Lines(NamedTuple):
    doc: np.ndarray
    size: np.ndarray  # bytes
    features: np.ndarray


def lines(c: T.Texts) -> Lines:
    """The lines with words of consecutive texts, with their own and their neighbours' features."""
    w = T.spans(~T.SPACE[c.data], c.offsets)
    if not len(w.start):
        return Lines(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 40)))
    # a word begins a line if it is its text's first or a line break stands before it
    breaks = np.concatenate(([0], np.cumsum(c.data == 10)))
    new = np.ones(len(w.start), bool)
    new[1:] = (w.doc[1:] != w.doc[:-1]) | (breaks[w.start[1:]] != breaks[w.end[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(new)) - 1
    start, end, doc = w.start[head], w.end[tail], w.doc[head]
    size, words = end - start, tail - head + 1
    line_of = np.cumsum(new) - 1
    h = T.hashes(T.LOWER[c.data], w)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & ~new[1:]
    order = np.lexsort((h, line_of))
    same = np.zeros(len(h))
    same[1:] = (h[order][1:] == h[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
    own = np.zeros((len(head), 13))
    own[:, 0] = np.log1p(size) / 5
    for i in range(6):
        marks = np.concatenate(([0], np.cumsum(_CLASSES[:, i][c.data], dtype=np.int64)))
        own[:, 1 + i] = (marks[end] - marks[start]) / size * (1 if i in (0, 5) else 4)
    own[:, 7] = size / words / 10
    own[:, 8] = np.add.reduceat(again, head) / words * 2
    own[:, 9] = np.bincount(line_of[order], weights=same, minlength=len(head)) / words * 2
    own[:, 10] = np.log1p(words) / 4
    line_hash = T.rolled(T.prefix(h), head, tail + 1)
    order = np.lexsort((line_hash, doc))
    twin = (line_hash[order][1:] == line_hash[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    own[order[1:][twin], 11] = 1
    own[:, 12] = 1
    features = np.zeros((len(head), 40))
    features[:, :13] = own
    together = doc[1:] == doc[:-1]
    features[1:, 13:26] = own[:-1] * together[:, None]
    features[:-1, 26:39] = own[1:] * together[:, None]
    features[:, 39] = np.minimum(size / 2000, 3)
    return Lines(doc, size, features)


def _score(x: np.ndarray, m: Model) -> np.ndarray:
    good = x @ m.weights
    return np.stack((-good / 2, good / 2), 1)


def _fit(x: np.ndarray, y: np.ndarray, length: np.ndarray, m: Model, steps: int) -> None:
    adam = crf.Adam(*m, rate=0.2)
    pairs, first = crf.counts(y, length, 2)
    at = np.concatenate(([0], np.cumsum(length)[:-1]))
    n = len(y)
    for _ in range(steps):
        post, expected, _z = crf.marginals(_score(x, m), length, m.trans, m.begin)
        adam.step(x.T @ (y - post[:, 1]) / n - 1e-4 * m.weights, (pairs - expected) / n - 1e-4 * m.trans, (first - post[at].sum(0)) / n - 1e-4 * m.begin)


def fit(texts: list[str], labels: list[int], steps: int = STEPS) -> Model:
    """The field, from documents that are labelled 1, good, or 0."""
    m = Model(np.zeros(40), np.zeros((2, 2)), np.zeros(2))
    if len(set(labels)) < 2:
        return m
    found = [(c.first, lines(c)) for c in T.chunks(pa.array(texts, pa.large_string()))]
    doc = np.concatenate([first + f.doc for first, f in found])
    x = np.concatenate([f.features for _, f in found])
    if not len(x):
        return m
    length = np.bincount(doc, minlength=len(texts))
    length = length[length > 0]
    label = np.array(labels)[doc]
    _fit(x, label, length, m, steps)
    # a bad document's good lines
    post = crf.marginals(_score(x, m), length, m.trans, m.begin)[0][:, 1]
    y = np.where(label == 1, 1, post > 0.5).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    worst = np.minimum.reduceat(post, start)
    y[(label == 0) & (post == np.repeat(worst, length))] = 0
    _fit(x, y, length, m, steps)
    return m


def judge(c: T.Texts, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quality, lines, bad lines) of each text."""
    f = lines(c)
    n = np.bincount(f.doc, minlength=len(c))
    post = crf.marginals(_score(f.features, m), n, m.trans, m.begin)[0]
    total = np.bincount(f.doc, weights=f.size, minlength=len(c))
    good = np.bincount(f.doc, weights=f.size * post[:, 1], minlength=len(c))
    return good / np.maximum(total, 1), n, np.bincount(f.doc, weights=post[:, 1] < 0.5, minlength=len(c)).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The field, from the labelled documents of least hash, at most sample of them."""
    common.integers(labels, "doc_id")
    common.integers(docs, "doc_id")
    known = common.narrow(labels, doc_id="doc_id", quality="quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))
    known = known.orderBy(common.unit(3, "id"), "id").limit(sample)  # so few that they are broadcast
    texts = common.narrow(docs, doc_id="doc_id", text="text").filter("text IS NOT NULL")
    rows = texts.join(F.broadcast(known), F.col("doc_id").cast("long") == F.col("id")).select("id", "text", "quality").collect()
    rows.sort()
    return fit([r["text"] for r in rows], [int(r["quality"] > 0) for r in rows])


def document_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, quality, n_lines, n_bad_lines, keep) of each row of docs."""
    common.integers(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in T.chunks(batch["text"]):
                q, n, bad = judge(c, model)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(c.first, len(c)), pa.array(q), pa.array(n), pa.array(bad), pa.array((n > 0) & (q >= KEEP))], ["doc_id", "quality", "n_lines", "n_bad_lines", "keep"])

    d = common.narrow(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    return d.mapInArrow(common.lean(run), "doc_id long, quality double, n_lines long, n_bad_lines long, keep boolean")


def drop_bad_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs, in the same columns, without those that are rejected."""
    plain, (text,) = common.numbered(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(n > 0) & (q >= KEEP) for q, n, _ in (judge(c, model) for c in T.chunks(batch[text]))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return plain.mapInArrow(common.lean(run), plain.schema).toDF(*docs.columns)
