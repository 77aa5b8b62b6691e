"""Words of many texts at once, as numpy arrays over the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15))


_BYTE = stream(256, 1) | U(1)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words of letters and digits: ASCII ones and all of UTF-8's longer codes.
WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_lo:_hi] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts(NamedTuple):
    """Consecutive texts: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray
    first: int  # row of text 0 in its batch

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Texts]:
    """The column's texts in pieces of about size bytes, without copying; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, values = column.buffers()
    at = np.frombuffer(at, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield Texts(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lo)
        lo = hi


class Words(NamedTuple):
    """Word j is data[start[j]:end[j]] and belongs to text doc[j]; text i's words are first[i] to first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def spans(inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of marked bytes that don't cross a text's border."""
    n, size = len(inside), np.diff(offsets)
    if not n:
        e = np.empty(0, np.int64)
        return Words(e, e, e, np.zeros(len(size) + 1, np.int64))
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = size > 0
    at = offsets[:-1][full]
    begins[at] = inside[at]
    at = offsets[1:][full] - 1
    ends[at] = inside[at]
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, offsets)
    return Words(start, np.flatnonzero(ends) + 1, np.repeat(np.arange(len(size)), np.diff(first)), first)


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2 ** 64; kept for the next call."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(max(n, CHUNK + 1), base, U)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base ** i before each place; the hash of a stretch is rolled() of its two ends."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def rolled(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each stretch, the same wherever it stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    return rolled(prefix(_BYTE[data]), w.start, w.end) if len(w.start) else np.empty(0, U)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, … for length[0] values, then the same for the next."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - length), length) + np.arange(total)
