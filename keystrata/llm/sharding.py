"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Entry (i, j) of the matrix says how many rows partition i sends to shard j; the matrix is drawn from the distribution that a
uniform shuffle of all rows has. It is never held: the rows of two halves of the partitions split the shards' sizes by a
multivariate hypergeometric draw with a seed of their own, and each task follows the halves down to its own row. It permutes
its partition's rows, deals them to the shards by that row, and after the exchange each shard's rows are permuted again. A
shard of over PIECE rows is dealt as several, one after another, which are exchanged and permuted by tasks of their own: a
uniform shuffle into those of exact sizes is one into the shard.

A row is its place in the table, so null and repeated doc_ids, repeated rows and empty or null texts are rows like any other,
and no column is read. Sizes must add up to the rows; by default they differ by one at most. An empty table gives an empty
result. Columns of exactly the names shard or position are replaced. Only a table that is read from files, and filtered or
projected at most, has the same partitions in each run; any other is written first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm import common

SHARDS = 64
SEED = 10
#: Most rows of a shard that one task permutes.
PIECE = 100_000
#: What keeps the partitions and rows of a table of files as they are.
PLAIN = {"FileSourceScanExec", "ProjectExec", "FilterExec"}


def hypergeometric(r: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn from good + bad."""
    if good + bad < 10**9:
        return int(r.hypergeometric(good, bad, n)) if n and good else 0
    total = good + bad
    mean = n * good / total
    sd = (mean * (bad / total) * ((total - n) / (total - 1))) ** 0.5
    lo, hi = max(0, n - bad, int(mean - 12 * sd) - 12), min(good, n, int(mean + 12 * sd) + 12)
    x = np.arange(lo, hi, dtype=float)
    log = np.concatenate(([0.0], np.cumsum(np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1))))
    p = np.cumsum(np.exp(log - log.max()))
    return lo + int(np.searchsorted(p, r.random() * p[-1]))


def split(r: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows drawn from shards of these sizes are of each."""
    if not n or not len(sizes):
        return np.zeros_like(sizes)
    total = int(sizes.sum())
    if len(sizes) == 1 or n == total:
        return np.array([n], sizes.dtype) if len(sizes) == 1 else sizes.copy()
    if total < 10**9:
        return r.multivariate_hypergeometric(sizes, n, method="marginals").astype(sizes.dtype)
    half = len(sizes) // 2
    left = int(sizes[:half].sum())
    m = hypergeometric(r, left, total - left, n)
    return np.concatenate((split(r, sizes[:half], m), split(r, sizes[half:], n - m)))


def row(counts: np.ndarray, sizes: np.ndarray, i: int, seed: int) -> np.ndarray:
    """Row i of the matrix: counts are the partitions' rows, sizes the shards'."""
    upto = np.concatenate(([0], np.cumsum(counts)))
    lo, hi = 0, len(counts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(np.random.default_rng((seed, lo, hi)), sizes, int(upto[mid] - upto[lo]))
        if i < mid:
            hi, sizes = mid, left
        else:
            lo, sizes = mid, sizes - left
    return sizes


def even(n: int, shards: int) -> np.ndarray:
    return n // shards + (np.arange(shards) < n % shards)


def pieces(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, place of its first row there, rows) of the pieces of shards."""
    n = np.maximum(1, -(-sizes // most))
    of = np.repeat(np.arange(len(sizes)), n)
    i = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    begin = i * sizes[of] // n[of]
    return of, begin, (i + 1) * sizes[of] // n[of] - begin


def _plain(df: DataFrame) -> bool:
    """Whether df is read from files and no more than filtered and projected."""
    todo = [df._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in PLAIN:
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def shuffle(docs: DataFrame, shards: int = SHARDS, sizes: list[int] | None = None, seed: int = SEED, piece: int = PIECE) -> DataFrame:
    """docs with each row's shard and its position there, from 0."""
    spark = docs.sparkSession
    docs = common.without(docs, "shard", "position")
    plain, _ = common.numbered(docs)
    if not _plain(plain):
        plain = common.cut(plain)
    found = plain.groupBy(F.spark_partition_id().alias("p")).count().collect()  # a number for each partition
    counts = np.zeros(max((x["p"] for x in found), default=0) + 1, np.int64)
    for x in found:
        counts[x["p"]] = x["count"]
    want = even(int(counts.sum()), shards) if sizes is None else np.array(sizes, np.int64)
    if want.sum() != counts.sum():
        raise ValueError(f"the sizes add up to {want.sum()}; there are {counts.sum()} rows")
    of, begin, rows = pieces(want, piece)
    shared = spark.sparkContext.broadcast((counts, rows))  # a number for each partition and each piece
    dealt: dict[int, np.ndarray] = {}

    def deal(place: pa.Array) -> pa.Array:
        at = place.to_numpy(zero_copy_only=False)
        p, i = at >> 33, at & (1 << 33) - 1
        out = np.empty(len(at), np.int32)
        counts, rows = shared.value
        for one in np.unique(p).tolist():
            if one not in dealt:
                dealt.clear()
                dealt[one] = np.random.default_rng((seed, one)).permutation(np.repeat(np.arange(len(rows), dtype=np.int32), row(counts, rows, one, seed)))
            out[p == one] = dealt[one][i[p == one]]
        return pa.array(out)

    sent = plain.withColumn("place", F.monotonically_increasing_id()).withColumn("piece", F.arrow_udf(deal, "int")("place"))
    # a task for each piece; a row's number in its task is its place in the piece
    sent = sent.repartitionById(max(1, len(rows)), F.col("piece")).sortWithinPartitions(F.xxhash64(F.lit(seed), "place"), "place")
    sent = sent.withColumn("position", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    first = spark.createDataFrame([(i, int(s), int(b)) for i, (s, b) in enumerate(zip(of, begin))], "number int, shard int, begin long")
    sent = sent.join(F.broadcast(first), F.col("piece") == F.col("number"))
    return sent.select(*plain.columns, "shard", (F.col("begin") + F.col("position")).alias("position")).toDF(*docs.columns, "shard", "position")
