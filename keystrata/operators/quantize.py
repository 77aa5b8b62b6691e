"""Product quantization and inverted lists: training, encoding, distance tables.

Models are tables: codebooks (cb_id, sub_id, cent_id, centroid) and centroids (cb_id, centroid_id, centroid), small enough
for every task; their size is checked before they are sent there. Distances between codes and queries are sums over a
table of the query's distances to all centroids of each subspace.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, ShortType

from keystrata import config
from keystrata.functions.vectors import matrix, normalised

CENTROIDS = 256


def kmeans(x: np.ndarray, k: int, steps: int) -> np.ndarray:
    """Lloyd's: begins with the first k rows, repeated if there are fewer; ties go to the lowest; an empty cluster stays."""
    x = np.asarray(x, np.float32)
    c = x[np.minimum(np.arange(k), len(x) - 1)].copy() if len(x) >= k else np.concatenate((x, np.repeat(x[:1], k - len(x), 0)))
    for _ in range(steps):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, near, x.astype(np.float64))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids, in 64 bits."""
    x, c = np.asarray(x, np.float64), np.asarray(c, np.float64)
    return np.maximum(np.einsum("ij,ij->i", x, x)[:, None] - 2 * x @ c.T + np.einsum("ij,ij->i", c, c), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.round(squared(x, c), 12).argmin(1)


@dataclass(frozen=True)
class Lists:
    """Centroids of inverted lists."""

    centroids: np.ndarray  # lists x dimensions

    def assign(self, v: np.ndarray) -> np.ndarray:
        return nearest(v, self.centroids)

    def probe(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        if n < 1:
            raise ValueError("at least one list has to be probed")
        return np.argsort(np.round(squared(q, self.centroids), 12), axis=1, kind="stable")[:, : min(n, len(self.centroids))]


@dataclass(frozen=True)
class Codes:
    """Codebooks of the subspaces; of residuals to lists if those are given."""

    books: np.ndarray  # subspaces x CENTROIDS x dimensions of each
    lists: Lists | None = None

    @property
    def m(self) -> int:
        return len(self.books)

    @property
    def dim(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def _parts(self, v: np.ndarray) -> np.ndarray:
        if v.shape[1] != self.dim:
            raise ValueError(f"expected {self.dim} dimensions, found {v.shape[1]}")
        return v.reshape(len(v), self.m, -1)

    def _prepared(self, v: np.ndarray, of: np.ndarray | None) -> np.ndarray:
        if self.lists is None:
            return normalised(v)
        if of is None or (np.asarray(of) < 0).any() or (np.asarray(of) >= len(self.lists.centroids)).any():
            raise ValueError(f"a list's number is from 0 to {len(self.lists.centroids) - 1}")
        return np.asarray(v, np.float32) - self.lists.centroids[of]

    def encode(self, v: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """rows x m codes; of: the rows' lists, for codes of residuals."""
        p = self._parts(self._prepared(v, of))
        return np.stack([nearest(p[:, i], self.books[i]) for i in range(self.m)], 1).astype(np.uint8)

    def table(self, q: np.ndarray, of: int | None = None) -> np.ndarray:
        """m x CENTROIDS squared distances of a query, in 32 bits."""
        p = self._parts(self._prepared(np.asarray(q, np.float32)[None], None if of is None else np.array([of])))
        return np.stack([squared(p[:, i], self.books[i])[0] for i in range(self.m)]).astype(np.float32)


def adc(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The table's sums over codes, rows x m."""
    if codes.shape[1] != len(table):
        raise ValueError(f"a code of {codes.shape[1]} bytes and a table of {len(table)} subspaces")
    return table[np.arange(len(table)), codes].astype(np.float64).sum(1)


def sample(df: DataFrame, vector: str, n: int, seed: int) -> np.ndarray:
    """At most n vectors, at random but the same each time; nulls are left out."""
    v = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    rows = v.orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(n).collect()
    if not rows:
        raise ValueError("there are no vectors to train on")
    return np.array([r["v"] for r in rows], np.float32)


def train_codes(x: np.ndarray, m: int, steps: int = 10, lists: Lists | None = None) -> Codes:
    if not 1 <= m <= 1024:
        raise ValueError(f"m is from 1 to 1024, not {m}")
    if not 1 <= steps <= 50:
        raise ValueError(f"there are 1 to 50 steps, not {steps}")
    if x.shape[1] % m:
        raise ValueError(f"{x.shape[1]} dimensions aren't a multiple of {m}")
    x = normalised(x) if lists is None else np.asarray(x, np.float32) - lists.centroids[lists.assign(x)]
    p = x.reshape(len(x), m, -1)
    return Codes(np.stack([kmeans(p[:, i], CENTROIDS, steps) for i in range(m)]), lists)


def train_lists(x: np.ndarray, n: int, steps: int = 10) -> Lists:
    if not 1 <= n <= 32_767:
        raise ValueError(f"there are 1 to 32767 lists, not {n}")
    return Lists(kmeans(x, n, steps))


def pq_train(df: DataFrame, vector: str, m: int, steps: int = 10, most: int = 10_000, seed: int = 42, lists: Lists | None = None) -> Codes:
    if most < CENTROIDS:
        raise ValueError(f"the sample has at least {CENTROIDS} rows")
    return train_codes(sample(df, vector, most, seed), m, steps, lists)


def ivf_train(df: DataFrame, vector: str, n: int, steps: int = 10, most: int = 10_000, seed: int = 42) -> Lists:
    if most < n:
        raise ValueError("the sample has at least a row for each list")
    return train_lists(sample(df, vector, most, seed), n, steps)


def ann_train(df: DataFrame, vector: str, n: int, m: int, steps: int = 10, most: int = 10_000, seed: int = 42, residual: bool = False) -> Codes:
    """Lists and codes together; without residual the codes are of the vectors themselves."""
    lists = ivf_train(df, vector, n, steps, most, seed)
    codes = pq_train(df, vector, m, steps, most, seed + 1, lists if residual else None)
    return codes if residual else Codes(codes.books, None)


def save(spark: SparkSession, path: str, codes: Codes | None = None, lists: Lists | None = None, cb_id: int = 1) -> None:
    """Models as tables below path."""
    if lists is not None:
        rows = [(cb_id, i, c.tolist()) for i, c in enumerate(lists.centroids)]
        spark.createDataFrame(rows, "cb_id int, centroid_id int, centroid array<float>").coalesce(1).write.parquet(f"{path}/lists/{cb_id}")
    if codes is not None:
        rows = [(cb_id, i, j, c.tolist()) for i, b in enumerate(codes.books) for j, c in enumerate(b)]
        spark.createDataFrame(rows, "cb_id int, sub_id int, cent_id int, centroid array<float>").coalesce(1).write.parquet(f"{path}/codes/{cb_id}")


def load_lists(spark: SparkSession, path: str, cb_id: int = 1) -> Lists:
    rows = spark.read.parquet(f"{path}/lists/{cb_id}").orderBy("centroid_id").collect()
    return Lists(np.array([r["centroid"] for r in rows], np.float32))


def load_codes(spark: SparkSession, path: str, cb_id: int = 1, lists: Lists | None = None) -> Codes:
    rows = spark.read.parquet(f"{path}/codes/{cb_id}").orderBy("sub_id", "cent_id").collect()
    flat = np.array([r["centroid"] for r in rows], np.float32)
    return Codes(flat.reshape(-1, CENTROIDS, flat.shape[1]), lists)


def shared(spark: SparkSession, *arrays: np.ndarray):
    """Arrays for every task; an error if they are more than the setting allows."""
    size, most = sum(a.nbytes for a in arrays), int(config.setting(spark, "broadcastBytes"))
    if size > most:
        raise ValueError(f"a model of {size} bytes is more than spark.keystrata.broadcastBytes, {most}")
    return spark.sparkContext.broadcast(arrays)


def _valid(*columns: pa.Array) -> np.ndarray:
    ok = np.ones(len(columns[0]), bool)
    for c in columns:
        ok &= c.is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(ok)


def assign(spark: SparkSession, v: Column, lists: Lists) -> Column:
    """The list of each vector, smallint."""
    held = shared(spark, lists.centroids)

    def run(column: pa.Array) -> pa.Array:
        at = _valid(column)
        out = np.zeros(len(column), np.int16)
        if len(at):
            out[at] = Lists(held.value[0]).assign(matrix(column.take(pa.array(at))))
        return pa.array(out, mask=np.isin(np.arange(len(out)), at, invert=True))

    return F.arrow_udf(run, ShortType())(v)


def _binary(rows: list[bytes | None]) -> pa.Array:
    return pa.array(rows, pa.binary())


def encode(spark: SparkSession, v: Column, codes: Codes, of: Column | None = None) -> Column:
    """The code of each vector, binary; of: its list, for codes of residuals."""
    residual = codes.lists is not None
    held = shared(spark, codes.books, *([codes.lists.centroids] if residual else []))

    def model() -> Codes:
        return Codes(held.value[0], Lists(held.value[1]) if residual else None)

    def run(*columns: pa.Array) -> pa.Array:
        at = _valid(*columns)
        out: list[bytes | None] = [None] * len(columns[0])
        if len(at):
            taken = [c.take(pa.array(at)) for c in columns]
            for i, c in zip(at.tolist(), model().encode(matrix(taken[0], np.float32), taken[1].to_numpy() if residual else None)):
                out[i] = c.tobytes()
        return _binary(out)

    if residual:
        if of is None:
            raise ValueError("codes of residuals need the vectors' lists")
        return F.arrow_udf(lambda a, b: run(a, b), BinaryType())(v, of.cast("int"))
    return F.arrow_udf(lambda a: run(a), BinaryType())(v)


def adc_by_list(tables: dict[int, np.ndarray], of: Column, code: Column) -> Column:
    """Distances of a query to codes of residuals, by its table for each list; null for other lists and codes of another length."""
    names = np.array(sorted(tables))
    stacked = np.stack([tables[p] for p in names.tolist()])
    m = stacked.shape[1]

    def run(lists: pa.Array, column: pa.Array) -> pa.Array:
        rows, at = column.to_pylist(), lists.fill_null(-1).to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(names, at), len(names) - 1)
        ok = np.flatnonzero((names[place] == at) & np.array([r is not None and len(r) == m for r in rows], bool))
        out = np.zeros(len(rows))
        if len(ok):
            c = np.frombuffer(b"".join(rows[i] for i in ok.tolist()), np.uint8).reshape(-1, m)
            out[ok] = stacked[place[ok][:, None], np.arange(m), c].astype(np.float64).sum(1)
        return pa.array(out, mask=np.isin(np.arange(len(rows)), ok, invert=True))

    return F.arrow_udf(run, DoubleType())(of.cast("int"), code)


def adc_distance(table: np.ndarray, code: Column, strict: bool = True) -> Column:
    """Distances of a query, by its table, to codes; codes of another length are an error or, if not strict, null."""

    def run(column: pa.Array) -> pa.Array:
        rows = column.to_pylist()
        ok = np.array([r is not None and len(r) == len(table) for r in rows], bool)
        if strict and any(r is not None and len(r) != len(table) for r in rows):
            raise ValueError(f"a code that isn't of {len(table)} bytes")
        out = np.zeros(len(rows))
        if ok.any():
            out[ok] = adc(table, np.frombuffer(b"".join(r for r, x in zip(rows, ok) if x), np.uint8).reshape(-1, len(table)))
        return pa.array(out, mask=~ok)

    return F.arrow_udf(run, DoubleType())(code)
