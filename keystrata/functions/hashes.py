"""Locality hashes of vectors: random hyperplanes, and the nearest of random unit vectors in several ways. Deterministic by seed.

Sums are in 64 bits, ties go to the lowest number. Null gives null; a null element is an error.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType

from keystrata.functions.vectors import matrix

BITS = 12
_MASK = (1 << 64) - 1


class Random:
    """xoshiro256** seeded by splitmix64."""

    def __init__(self, seed: int):
        x = seed & _MASK
        self.s = []
        for _ in range(4):
            x = (x + 0x9E3779B97F4A7C15) & _MASK
            z = x
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB & _MASK
            self.s.append(z ^ (z >> 31))

    def bits(self) -> int:
        s = self.s
        x = s[1] * 5 & _MASK
        out = ((x << 7 | x >> 57) & _MASK) * 9 & _MASK
        t = s[1] << 17 & _MASK
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = (s[3] << 45 | s[3] >> 19) & _MASK
        return out

    def uniform(self) -> float:
        return (self.bits() >> 11) * 2.0**-53

    def normals(self, n: int) -> np.ndarray:
        """By Box and Muller, the cosine of each two uniforms."""
        u = np.empty((n, 2))
        for i in range(n):
            u[i, 0] = self.uniform()
            while u[i, 0] <= 1e-300:
                u[i, 0] = self.uniform()
            u[i, 1] = self.uniform()
        return np.sqrt(-2 * np.log(u[:, 0])) * np.cos(2 * np.pi * u[:, 1])


@lru_cache(32)
def planes(dim: int, seed: int) -> np.ndarray:
    return Random(seed).normals(BITS * dim).reshape(BITS, dim)


@lru_cache(32)
def codebook(n: int, dim: int, seed: int) -> np.ndarray:
    """n random unit vectors, in 32 bits."""
    v = Random(seed).normals(n * dim).astype(np.float32).reshape(n, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", v.astype(np.float64), v.astype(np.float64)))
    return (v / np.where(norm > 0, norm, 1)[:, None].astype(np.float32)).astype(np.float32)


def _nearest(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (v.astype(np.float64) @ book.astype(np.float64).T).argmax(1)


def simhash(v: np.ndarray, seed: int = 42) -> np.ndarray:
    """12 bits, one for each random hyperplane that a row is above."""
    return ((v.astype(np.float64) @ planes(v.shape[1], seed).T > 0) << np.arange(BITS)).sum(1).astype(np.int16)


def _count(n: int, most: int = 32_000) -> None:
    if not 2 <= n <= most:
        raise ValueError(f"the number of centroids is from 2 to {most}, not {n}")


def vq(v: np.ndarray, centroids: int, seed: int = 42) -> np.ndarray:
    """The nearest of so many random unit vectors."""
    _count(centroids)
    return _nearest(v, codebook(centroids, v.shape[1], seed)).astype(np.int16)


def rvq(v: np.ndarray, coarse: int, fine: int, seed: int = 42) -> np.ndarray:
    """The nearest coarse vector, and that of what is left, scaled to length one, of fine ones."""
    _count(coarse)
    _count(fine)
    if coarse * fine > 32_767:
        raise ValueError(f"{coarse} times {fine} is more than 32767")
    book = codebook(coarse, v.shape[1], seed)
    first = _nearest(v, book)
    rest = v.astype(np.float32) - book[first]
    square = np.einsum("ij,ij->i", rest.astype(np.float64), rest.astype(np.float64))
    rest = rest.astype(np.float64) / np.where(square > 1e-30, np.sqrt(square), 1)[:, None]
    return (first * fine + _nearest(rest, codebook(fine, v.shape[1], seed + 1))).astype(np.int16)


def rpvq(v: np.ndarray, projections: int, centroids: int, seed: int = 42) -> np.ndarray:
    """vq() of the dot products with random unit vectors."""
    _count(projections, 4096)
    _count(centroids)
    low = v.astype(np.float64) @ codebook(projections, v.shape[1], seed).astype(np.float64).T
    return _nearest(low, codebook(centroids, projections, seed + 1)).astype(np.int16)


def cvq(v: np.ndarray, reference: np.ndarray, centroids: int, seed: int = 42) -> np.ndarray:
    """vq() of the difference from a reference."""
    reference = np.asarray(reference, np.float32)
    if reference.shape[-1] != v.shape[1]:
        raise ValueError(f"different vector dimensions {v.shape[1]} and {reference.shape[-1]}")
    return vq(v.astype(np.float32) - reference, centroids, seed)


def cvq_probe(v: np.ndarray, reference: np.ndarray, centroids: int, probes: int, seed: int = 42) -> np.ndarray:
    """The probes nearest numbers that cvq() can give, nearest first."""
    _count(centroids)
    if not 1 <= probes <= centroids:
        raise ValueError(f"probes is from 1 to {centroids}, not {probes}")
    if np.shape(reference)[-1] != v.shape[1]:
        raise ValueError(f"different vector dimensions {v.shape[1]} and {np.shape(reference)[-1]}")
    dot = (v.astype(np.float32) - np.asarray(reference, np.float32)).astype(np.float64) @ codebook(centroids, v.shape[1], seed).astype(np.float64).T
    return np.argsort(-dot, axis=1, kind="stable")[:, :probes].astype(np.int16)


def on_column(kernel, v: Column, *args, many: bool = False) -> Column:
    """A kernel of this module on a column of vectors."""

    def run(column: pa.Array) -> pa.Array:
        there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        rows = column.take(pa.array(there))
        if rows.flatten().null_count:
            raise ValueError("a vector has a null element")
        out: list = [None] * len(column)
        size = np.diff(rows.offsets.to_numpy())
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            for i, x in zip(there[at].tolist(), kernel(matrix(rows.take(pa.array(at)), np.float32), *args).tolist()):
                out[i] = x
        return pa.array(out, pa.list_(pa.int16()) if many else pa.int16())

    return F.arrow_udf(run, ArrayType(ShortType()) if many else ShortType())(v)
