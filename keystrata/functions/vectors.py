"""Vectors of 32-bit and of 16-bit floats: reading, writing, casting, and cosine distance.

Both are array<float> in a DataFrame; a half vector's values have been rounded to 16 bits. Null gives null everywhere.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

MOST, MOST_HALF = 16_000, 32_000
_NUMBER = re.compile(r"[ \t]*([-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|inf(?:inity)?|nan))[ \t]*,?", re.I)


def parse(text: str, dim: int | None = None, most: int = MOST) -> np.ndarray:
    """A vector from its text, [1, 2, 3]; the commas are optional."""
    s = text.strip(" \t\n\r")
    if not s.startswith("["):
        raise ValueError(f"a vector begins with [: {text!r}")
    if "]" not in s:
        raise ValueError(f"a vector ends with ]: {text!r}")
    inside, rest = s[1:].split("]", 1)
    if rest.strip():
        raise ValueError(f"{rest!r} follows the vector")
    values, at = [], 0
    while inside[at:].strip(" \t"):
        m = _NUMBER.match(inside, at)
        if not m:
            raise ValueError(f"{inside[at:]!r} doesn't begin with a number")
        values.append(float(m[1]))
        at = m.end()
    if not values:
        raise ValueError("a vector has at least one dimension")
    if len(values) > most:
        raise ValueError(f"a vector has at most {most} dimensions")
    if dim is not None and len(values) != dim:
        raise ValueError(f"expected {dim} dimensions, found {len(values)}")
    return np.array(values, np.float32)


def parse_half(text: str, dim: int | None = None) -> np.ndarray:
    with np.errstate(over="ignore"):
        return parse(text, dim, MOST_HALF).astype(np.float16)


def text(v: np.ndarray) -> str:
    """The shortest text that parse() reads back."""
    out = []
    for x in v:
        s = np.format_float_positional(x, unique=True, trim="-") if np.isfinite(x) and (x == 0 or 1e-5 <= abs(float(x)) < 1e16) else str(x)
        out.append({"inf": "Infinity", "-inf": "-Infinity", "nan": "NaN"}.get(s, s))
    return "[" + ",".join(out) + "]"


def to_bytes(v: np.ndarray) -> bytes:
    """Dimensions, a zero, and the values, all big-endian; 16-bit values of a half vector."""
    kind = ">f2" if v.dtype == np.float16 else ">f4"
    return np.array([len(v), 0], ">i2").tobytes() + np.asarray(v).astype(kind).tobytes()


def from_bytes(data: bytes, half: bool = False) -> np.ndarray:
    n, zero = np.frombuffer(data[:4], ">i2")
    if n < 1 or zero or len(data) != 4 + int(n) * (2 if half else 4):
        raise ValueError("these aren't the bytes of a vector")
    return np.frombuffer(data, ">f2" if half else ">f4", offset=4).astype(np.float16 if half else np.float32)


def matrix(column: pa.Array | pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    """A column of vectors of one dimension, without nulls, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = np.asarray(column.flatten())
    if not n:
        return np.empty((0, 0), dtype)
    if len(flat) % n or (np.diff(column.offsets.to_numpy()) != len(flat) // n).any():
        raise ValueError("vectors of different dimensions")
    return flat.reshape(n, -1).astype(dtype)



@F.arrow_udf(ArrayType(FloatType()))
def half(v: pa.Array) -> pa.Array:
    """A vector's values rounded to 16 bits."""
    flat = np.asarray(v.flatten()).astype(np.float32)
    with np.errstate(over="ignore"):
        flat = flat.astype(np.float16).astype(np.float32)
    offsets = np.concatenate(([0], np.cumsum(np.where(v.is_null().to_numpy(zero_copy_only=False), 0, np.diff(v.offsets.to_numpy()))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=v.is_null())


def widened(v: Column) -> Column:
    """A half vector as a vector: the values are the same; more than MOST dimensions are an error."""
    return F.when(F.size(v) > MOST, F.raise_error(F.lit(f"a vector has at most {MOST} dimensions")).cast("array<float>")).otherwise(v)


def cosine_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows; NaN where a vector has no length."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
    return 1 - np.clip(c, -1, 1)


def cosine_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of each row of a from each of b; NaN where a vector has no length."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = a @ b.T / (np.sqrt(np.einsum("ij,ij->i", a, a))[:, None] * np.sqrt(np.einsum("ij,ij->i", b, b)))
    return 1 - np.clip(c, -1, 1)


@F.arrow_udf(DoubleType())
def cosine_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """1 - cosine, in 64 bits; NaN if a vector has no length; different dimensions are an error."""
    null = a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False)
    there = np.flatnonzero(~null)
    x, y = a.take(pa.array(there)), b.take(pa.array(there))
    nx, ny = np.diff(x.offsets.to_numpy()), np.diff(y.offsets.to_numpy())
    if (nx != ny).any():
        raise ValueError(f"different vector dimensions {nx[nx != ny][0]} and {ny[nx != ny][0]}")
    out = np.zeros(len(a))
    for dim in np.unique(nx):
        at = np.flatnonzero(nx == dim)
        out[there[at]] = cosine_distances(matrix(x.take(pa.array(at))), matrix(y.take(pa.array(at)))) if dim else np.nan
    return pa.array(out, mask=null)


def normalised(v: np.ndarray) -> np.ndarray:
    """Rows of length one, in 32 bits; rows too short for that as they are; values that aren't finite are an error."""
    v = np.asarray(v, np.float32)
    norm = np.sqrt(np.einsum("ij,ij->i", v.astype(np.float64), v.astype(np.float64)))
    if not np.isfinite(norm).all():
        raise ValueError("a vector's length isn't finite")
    scale = np.where(norm < 1e-30, 1.0, 1 / np.maximum(norm, 1e-300)).astype(np.float32)
    return v * scale[:, None]


def head(v: Column, dim: int) -> Column:
    """A sketch: the first dim values, rounded to 16 bits."""
    return half(F.slice(v, 1, dim))
