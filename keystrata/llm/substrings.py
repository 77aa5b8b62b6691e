"""Repeated passages: exact counts of all k-word windows by super-k-mer partitioning.

Every window of K words has a minimiser, the least hash among its M-word grams. Consecutive windows of a text that share
it travel as one packed string to the bucket of that hash, so a word is shipped about three times, not K times. Equal
windows have equal minimisers and so meet in one bucket, where sorting their fingerprints, checked byte by byte, counts
them exactly.

A bucket of over HOT strings, that of a passage in very many documents, is not sent to one task. Buckets that stand more than
once in a batch are counted first; the windows of the hot ones are told apart by 128-bit digests, aggregated where they lie,
and joined with their counts. No task so gets more of a bucket than HOT strings and one for each batch.

Words are what ASCII white space separates; how much of it stands between two words doesn't matter. Null and empty texts,
texts of fewer than K words and rows without an id have no windows. An occurrence is (doc_id, hash of the text, position);
the least one of a window is its first. Rows that repeat both id and text are one occurrence counted as often as it stands
there, so neither of them is later than the other. Rows that share an id but not the text are told apart. Other columns
aren't read. An empty table gives an empty result.
Ids that aren't integers are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from keystrata.llm import common, text as T

K = 50
M = 5
PACKED = "bucket long, doc_id long, key long, start int, twice boolean, packed binary"
#: Strings of a bucket from which it is hot.
HOT = 1 << 18
WINDOWS = "x long, y long, doc_id long, key long, start int"
RUNS = "doc_id long, key long, a int, b int, first boolean, copies long"


def _fingerprints(h: np.ndarray, k: int) -> np.ndarray:
    """Of each k consecutive hashes."""
    at = np.arange(len(h) - k + 1)
    return T.rolled(T.prefix(h), at, at + k)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _spaced(c: T.Texts) -> list[bytes]:
    """The texts with single spaces."""
    data = c.data.tobytes()
    return [b" ".join(data[a:b].split()) for a, b in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist())]


def super_kmers(texts: list[bytes], k: int, m: int, packing: bool = True) -> tuple[np.ndarray, ...]:
    """(text, first window, bucket, whether the minimiser stands there twice, packed strings) of texts with single spaces."""
    data = b" ".join(texts)
    size = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(size + 1)))
    raw = np.frombuffer(data + b" ", np.uint8)
    w = T.spans(raw != 32, offsets)
    count = np.diff(w.first)
    windows = np.maximum(count - k + 1, 0)
    if not windows.sum():
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, T.U), np.empty(0, bool), []
    grams = _fingerprints(T.hashes(raw, w), m)
    at = np.arange(len(grams), dtype=T.U)
    least = _sliding_min((grams >> T.U(28) << T.U(28)) | at, k - m + 1)
    start = T.ragged(w.first[:-1], windows)
    place = (least[start] & T.U((1 << 28) - 1)).astype(np.int64)
    value = grams[place]
    of = np.repeat(np.arange(len(texts)), windows)
    new = np.ones(len(start), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    begin, end = w.start[start[head]].tolist(), w.end[start[tail] + k - 1].tolist()
    packed = [data[a:b] for a, b in zip(begin, end)] if packing else []
    return of[head], (start[head] - w.first[of[head]]).astype(np.int32), value[head], place[head] != place[tail], packed


def _sizes(k: int, m: int):
    """Of each batch the buckets that stand there more than once, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [super_kmers(_spaced(c), k, m, False)[2] for c in T.chunks(batch["text"])]
            bucket, n = np.unique(np.concatenate(found) if found else np.empty(0, T.U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[n > 1].view(np.int64)), pa.array(n[n > 1])], ["bucket", "n"])

    return run


def _extract(k: int, m: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch["doc_id"].to_numpy(zero_copy_only=False), batch["key"].to_numpy(zero_copy_only=False)
            for c in T.chunks(batch["text"]):
                of, start, bucket, twice, packed = super_kmers(_spaced(c), k, m)
                if packed:
                    out = pa.RecordBatch.from_arrays(
                        [pa.array(bucket.view(np.int64)), pa.array(ids[c.first + of]), pa.array(keys[c.first + of]), pa.array(start), pa.array(twice), pa.array(packed, pa.binary())],
                        ["bucket", "doc_id", "key", "start", "twice", "packed"],
                    )
                    yield out.filter(pa.array(np.isin(bucket, hot, invert=True))) if len(hot) else out

    return run


def _hot_windows(k: int, m: int, hot: np.ndarray):
    """Each window of the hot buckets, by a digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch["doc_id"].to_numpy(zero_copy_only=False), batch["key"].to_numpy(zero_copy_only=False)
            for c in T.chunks(batch["text"]):
                of, start, bucket, _, packed = super_kmers(_spaced(c), k, m)
                digests, rows, places = [], [], []
                for i in np.flatnonzero(np.isin(bucket, hot)).tolist():
                    words = packed[i].split(b" ")
                    n = len(words) - k + 1
                    digests += [blake2b(b" ".join(words[j : j + k]), digest_size=16).digest() for j in range(n)]
                    rows += [of[i]] * n
                    places += range(start[i], start[i] + n)
                if digests:
                    xy, rows = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), c.first + np.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1]), pa.array(ids[rows]), pa.array(keys[rows]), pa.array(places, pa.int32())], ["x", "y", "doc_id", "key", "start"])

    return run


def _same(order: np.ndarray, f: np.ndarray, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number per window, the same for equal ones only; order sorts the fingerprints f."""
    ranked = f[order]
    new = np.ones(len(f), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    pairs = np.flatnonzero(~new)
    x, y = order[pairs - 1], order[pairs]
    differ = [p for p, a, b, c, d in zip(pairs.tolist(), begin[x].tolist(), end[x].tolist(), begin[y].tolist(), end[y].tolist()) if data[a:b] != data[c:d]]
    out = np.empty(len(f), np.int64)
    out[order] = np.cumsum(new) - 1
    for run in {int(out[order[p]]) for p in differ}:  # fingerprints that collide: told apart by their texts
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(out == run).tolist():
            out[i] = seen.setdefault(data[begin[i] : end[i]], len(f) * (len(seen) + 1) + run if seen else run)
    return out


def count_windows(doc: np.ndarray, key: np.ndarray, start: np.ndarray, code: np.ndarray, strings: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """(row, first window, end, first, copies) of each run of repeated windows; rows are in order of doc, key and start; strings[code] is a row's packed string."""
    data = b" ".join(strings) + b" "
    offsets = np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings])))
    raw = np.frombuffer(data, np.uint8)
    w = T.spans(raw != 32, offsets)
    n = np.diff(w.first) - k + 1  # windows of a string, at least 1
    at = T.ragged(w.first[:-1], n)
    of = np.repeat(np.arange(len(strings)), n)
    offset = at - w.first[of]
    f = _fingerprints(T.hashes(raw, w), k)[at]
    same = _same(np.argsort(f, kind="stable"), f, data, w.start[at], w.end[at + k - 1])
    _, same = np.unique(same, return_inverse=True)
    times = np.bincount(code, minlength=len(strings))
    copies = np.bincount(same, weights=times[of]).astype(np.int64)[same]
    least = np.full(len(strings), len(code))
    np.minimum.at(least, code, np.arange(len(code)))
    # the window's first occurrence: by doc, key and position among the first ones of the strings that have it
    rank = np.lexsort((start[least[of]] + offset, key[least[of]], doc[least[of]]))
    owner = np.full(int(same.max()) + 1, -1)
    owner[same[rank[::-1]]] = rank[::-1]
    first = owner[same] == np.arange(len(same))
    out = []
    leads = (doc == doc[least[code]]) & (key == key[least[code]]) & (start == start[least[code]])
    for rows, status in ((np.flatnonzero(leads), first), (np.flatnonzero(~leads), np.zeros(len(first), bool))):
        state = np.where(copies > 1, 1 + status, 0)
        new = np.ones(len(state), bool)
        new[1:] = (state[1:] != state[:-1]) | (of[1:] != of[:-1])
        head = np.flatnonzero(new)
        end = np.append(head[1:], len(state))
        most = np.maximum.reduceat(copies, head)
        kept = state[head] > 0
        head, end, most = head[kept], end[kept], most[kept]
        runs = np.bincount(of[head], minlength=len(strings))
        begin = np.concatenate(([0], np.cumsum(runs)))[:-1]
        r = np.repeat(rows, runs[code[rows]])
        i = T.ragged(begin[code[rows]], runs[code[rows]])
        a = start[r] + offset[head[i]]
        out.append((r, a, a + end[i] - head[i], state[head[i]] == 2, most[i]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _count(k: int, enough: int = 20_000):
    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.unify_dictionaries().combine_chunks()
        if not len(t):
            return
        bucket = t["bucket"].to_numpy()
        new = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(bucket)))
        open_ = np.repeat((size > 1) | np.logical_or.reduceat(t["twice"].to_numpy(), head), size)
        if not open_.any():
            return
        t = t.filter(pa.array(open_))
        packed = t["packed"].combine_chunks()
        packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
        used, code = np.unique(packed.indices.to_numpy(), return_inverse=True)
        strings = packed.dictionary.take(pa.array(used)).to_pylist()
        doc, key, start = (t[c].to_numpy() for c in ("doc_id", "key", "start"))
        order = np.lexsort((start, key, doc))
        doc, key, start, code = doc[order], key[order], start[order], code[order]
        r, a, b, first, copies = count_windows(doc, key, start.astype(np.int64), code, strings, k)
        if len(r):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[r]), pa.array(key[r]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(first), pa.array(copies)],
                ["doc_id", "key", "a", "b", "first", "copies"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            # a bucket's equal strings are held once, however many occurrences it has
            t = pa.table({c: batch[c] if c != "packed" else batch[c].dictionary_encode() for c in batch.schema.names})
            held.append(t)
            rows += len(t)
            if rows < enough:
                continue
            bucket = t["bucket"].to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut or len(held) > 1 and held[-2]["bucket"][-1].as_py() != bucket[0]:
                yield from solve(pa.concat_tables([*held[:-1], t.slice(0, cut)]))
                held = [pa.table({c: t[c].slice(cut) for c in t.schema.names})]
                rows = len(held[0])
            elif len(held) > 64:  # one bucket fills them all
                held = [pa.concat_tables(held).unify_dictionaries().combine_chunks()]
        if held:
            yield from solve(pa.concat_tables(held))

    return run


def _hot_runs(d: DataFrame, k: int, m: int, hot: np.ndarray) -> DataFrame:
    """RUNS of one window each, of the hot buckets."""
    windows = common.cut(d.mapInArrow(common.lean(_hot_windows(k, m, hot)), WINDOWS))
    counted = windows.groupBy("x", "y").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "key", "start")).alias("least")).filter("copies > 1")
    first = F.struct("doc_id", "key", "start") == F.col("least")
    return windows.join(counted, ["x", "y"]).select("doc_id", "key", F.col("start").alias("a"), (F.col("start") + 1).alias("b"), first.alias("first"), "copies")


def repeated_windows(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """(doc_id, key, a, b, first, copies): maximal runs a to b - 1 of windows that stand at least twice in docs, apart by whether they are the windows' first occurrence."""
    common.integers(docs, "doc_id")
    d = common.narrow(docs, doc_id="doc_id", text="text")
    d = d.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = d.select("text").mapInArrow(common.lean(_sizes(k, m)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > hot)
    hottest = np.array([r["bucket"] for r in large.collect()], np.int64).view(T.U)  # one for each hot strings at most
    runs = d.mapInArrow(common.lean(_extract(k, m, hottest)), PACKED).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(common.lean(_count(k)), RUNS)
    if len(hottest):
        runs = runs.union(_hot_runs(d, k, m, hottest))
    w = Window.partitionBy("doc_id", "key").orderBy("a", "first")
    runs = runs.distinct()  # rows that repeat an id and its text
    runs = runs.withColumn("new", F.coalesce((F.lag("first").over(w) != F.col("first")) | (F.lag("b").over(w) != F.col("a")), F.lit(True)))
    runs = runs.withColumn("island", F.sum(F.col("new").cast("int")).over(w))
    return runs.groupBy("doc_id", "key", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("first").alias("first"), F.max("copies").alias("copies")).drop("island")


def repeated_passages(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, n_words, first, copies): the passages that consist of repeated windows; copies is the most occurrences of one of them."""
    return repeated_windows(docs, k, m, hot).select("doc_id", F.col("a").cast("long").alias("start_word"), (F.col("b") - F.col("a") + k - 1).cast("long").alias("n_words"), "first", "copies")


def _cut_text(k: int, text_column: str):
    def cut(text: bytes, runs) -> str:
        w = T.spans(~T.SPACE[np.frombuffer(text, np.uint8)], np.array([0, len(text)]))
        gone = np.zeros(len(w.start) + 1, np.int32)
        for r in runs:
            gone[r["a"]] += 1
            gone[r["b"] + k - 1] -= 1
        kept = np.cumsum(gone[:-1]) == 0
        if not kept.any():
            return ""
        edge = np.diff(np.concatenate(([0], kept.view(np.int8), [0])))
        pieces = [text[w.start[a] : w.end[b - 1]] for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
        return b"\n".join(pieces).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index(text_column)
            texts = batch[text_column].to_pylist()
            emptied = np.zeros(len(texts), bool)
            for i, runs in enumerate(batch["runs"].to_pylist()):
                if runs:
                    texts[i] = cut(texts[i].encode(), runs)
                    emptied[i] = not texts[i]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch[text_column].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(emptied)], [*names[:-1], "emptied"])

    return run


def drop_later_copies(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """docs, in the same columns, without the words of any window that isn't its first occurrence; n_chars, if there, is the new length.

    A text that loses all its words goes with its row; one that had none stays. The pieces around a removed passage are joined by a line break.
    """
    later = repeated_windows(docs, k, m, hot).filter(~F.col("first")).groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    later = later.select(F.col("doc_id").alias("id"), "key", "runs")
    plain, (doc_id, text) = common.numbered(docs, "doc_id", "text")
    both = plain.join(later, (F.col(doc_id).cast("long") == F.col("id")) & (F.xxhash64(text) == F.col("key")), "left").drop("id", "key")
    kept = both.mapInArrow(common.lean(_cut_text(k, text)), StructType([*plain.schema.fields, StructField("emptied", BooleanType())])).filter(~F.col("emptied")).drop("emptied")
    if "n_chars" in docs.columns:
        (n_chars,) = common.numbered(docs, "n_chars")[1]
        kept = kept.withColumn(n_chars, F.length(text).cast(docs.schema["n_chars"].dataType))
    return kept.toDF(*docs.columns)


#: All windows as texts. Of rows that share a doc_id but not the text, the one that is first isn't told by SQL.
PASSAGES_SQL = f"""
WITH d AS (SELECT doc_id, text, count(*) AS times FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\t\\n\\v\\f\\r ]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT doc_id, text, times, w, unnest(range(0, len(w) - {K - 1})) AS a FROM w WHERE len(w) >= {K}),
s AS (SELECT doc_id, text, times, a, array_to_string(w[a + 1 : a + {K}], ' ') AS s FROM p),
c AS (SELECT doc_id, text, a, CAST(sum(times) OVER (PARTITION BY s) AS BIGINT) AS copies, row_number() OVER (PARTITION BY s ORDER BY doc_id, text, a) = 1 AS first FROM s),
i AS (SELECT *, a - row_number() OVER (PARTITION BY doc_id, text, first ORDER BY a) AS island FROM c WHERE copies > 1)
SELECT doc_id, CAST(min(a) AS BIGINT) AS start_word, CAST(max(a) - min(a) + {K} AS BIGINT) AS n_words, first, max(copies) AS copies FROM i GROUP BY doc_id, text, first, island"""
