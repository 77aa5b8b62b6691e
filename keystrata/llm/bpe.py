"""Byte-pair encoding and decoding with a given vocabulary of ranks.

A text is split into pieces as by the usual pattern: contractions; runs of letters, of digits, or of other marks, each with a
space before it if there is one; white space. A piece is held as a contiguous array of part boundaries with the rank of each
part joined to the next. The least rank is looked for, the boundary between its two parts deleted, and the ranks on both
sides refreshed, until no two parts can be joined; in a piece of more than LONG bytes, a parameter, a heap finds the least
rank, with the same result. The pieces that are new to a task are merged side by side, row by row of one matrix; their ids
are kept for the pieces' next occurrence, which is told by the pieces' bytes, and forgotten when there are more than
REMEMBERED pieces, or REMEMBERED_BYTES of pieces of over WORDS * 8 bytes.

Null texts have null tokens; empty ones none. Texts are encoded whole, without special tokens. Rows without a doc_id and rows
that repeat one are encoded like any other. Only doc_id and text are read; encode_documents keeps the other columns, and
replaces one of the name tokens or n_tokens. An empty table gives an empty result. Decoding a text's tokens gives its bytes.
Ids that aren't integers are an error. The vocabulary is read by the driver and sent to the tasks; it has a bounded size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from keystrata.llm import common, text as T

#: Vocabulary of the production queries; a line is a token in base64 and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces whose ids a task keeps.
REMEMBERED = 400_000
#: Bytes of such pieces of over WORDS * 8 bytes.
REMEMBERED_BYTES = 8 << 20
#: 64-bit words that a piece is compared by.
WORDS = 8
#: Bytes of a piece from which its ranks are in a heap.
LONG = 256
#: Most bytes of a vocabulary's file.
VOCABULARY_BYTES = 64 << 20
_NONE = np.int32((1 << 31) - 1)
LETTER, DIGIT, WHITE, MARK = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point."""
    out = np.full(0x110000, MARK, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            if b - a == m.end() - m.start() - 1:
                out[a : b + 1] = kind
            else:  # across the surrogates
                out[[ord(x) for x in m.group()]] = kind
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of consecutive texts."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    byte = data[lead]
    point = byte.astype(np.int32)
    wide = np.flatnonzero(byte >= 0xC0)
    if len(wide):
        padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int32)
        at = lead[wide]
        b0, b1, b2, b3 = (padded[at + i] for i in range(4))
        low = lambda x: x & 63
        point[wide] = np.where(b0 < 0xE0, (b0 & 31) << 6 | low(b1), np.where(b0 < 0xF0, (b0 & 15) << 12 | low(b1) << 6 | low(b2), (b0 & 7) << 18 | low(b1) << 12 | low(b2) << 6 | low(b3)))
    kind = _classes()[point]
    m = len(lead)
    text = np.zeros(m, bool)  # starts of texts
    begins = np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])
    text[begins] = True
    change = text.copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    # the last blank of a run before something else goes with it if it is a space, and stands alone if not
    white = np.flatnonzero(change & (kind != WHITE) & ~text)
    white = white[kind[white - 1] == WHITE]
    start[white - 1] = True
    start[white[point[white - 1] == 32]] = False
    # contractions: a lone ' that nothing precedes in its piece
    quote = np.flatnonzero(start & (point == 39))
    if len(quote):
        end = np.append(text, [True] * 3)
        letters = np.append(kind, [MARK] * 3) == LETTER
        ext = np.append(point, [0, 0, 0])
        near = letters[quote + 1] & ~end[quote + 1]
        one = near & np.isin(ext[quote + 1], [115, 116, 109, 100])
        pair = ext[quote + 1] * 256 + ext[quote + 2]
        two = near & letters[quote + 2] & ~end[quote + 2] & np.isin(pair, [114 * 256 + 101, 118 * 256 + 101, 108 * 256 + 108])
        for which, size in ((one, 1), (two & ~one, 2)):
            q = quote[which]
            start[q + 1] = False
            after = q + 1 + size
            after = after[after < m]
            start[after[(kind[after] == LETTER) & ~text[after]]] = True
    return lead[start]


class Vocabulary:
    """Ranks of byte strings, by pairs of ids."""

    def __init__(self, text: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line.strip())}
        self.size = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * self.size
        for t, i in ranks.items():
            tokens[i] = t
        self.length = np.array([len(t) for t in tokens])
        self.ends = np.cumsum(self.length)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        # every way to join two tokens to a third
        found = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        found.sort()
        keys = np.array([k for k, _ in found], np.uint64)
        values = np.array([v for _, v in found], np.int32)
        bits = max(1, int(2 * len(keys)).bit_length())
        self.shift = T.U(64 - bits)
        self.keys = np.full((1 << bits) + 64, np.uint64((1 << 64) - 1))
        self.values = np.full(len(self.keys), _NONE, np.int32)
        slots = self._slot(keys)
        self.probes = 1
        left = np.arange(len(keys))
        step = 0
        while len(left):  # open addressing, all keys at once
            at = slots[left] + step
            free = self.keys[at] == np.uint64((1 << 64) - 1)
            who, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.keys[who], self.values[who] = keys[won], values[won]
            left = np.setdiff1d(left, won)
            step += 1
            self.probes = max(self.probes, step)
            if step >= 64:
                raise ValueError("the table of pairs is too full")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (T.mix(keys) >> self.shift).astype(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE."""
        keys = a.astype(np.uint64) << T.U(32) | b.astype(np.uint64)
        slot = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int32)
        open_ = np.arange(len(keys))
        for step in range(self.probes):
            at = slot[open_] + step
            got = self.keys[at]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (got != np.uint64((1 << 64) - 1))]
            if not len(open_):
                break
        return out

    def merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has)."""
        n = len(start)
        count = np.empty(n, np.int64)
        order = np.argsort(length, kind="stable")
        done: list[tuple[np.ndarray, np.ndarray]] = []
        lo = 0
        while lo < n:  # pieces of like length together
            if length[order[lo]] > long:
                rows = order[lo : lo + 1]
                a = int(start[rows[0]])
                ids = self._merge_long(data[a : a + int(length[rows[0]])])
                count[rows] = len(ids)
                done.append((rows, ids))
                lo += 1
                continue
            longest = min(long, max(16, int(length[order[lo]]) * 5 // 4))
            hi = int(np.searchsorted(length[order], longest, "right"))
            hi = max(lo + 1, min(hi, lo + max(1, (1 << 20) // longest)))
            rows = order[lo:hi]
            ids, size = self._merge(data, start[rows], length[rows])
            count[rows] = size
            done.append((rows, ids))
            lo = hi
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for rows, ids in done:
            out[T.ragged(first[rows], count[rows])] = ids
        return out, count

    def _merge_long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long piece: scanning it for every merge would take the square of its length, so the ranks are in a heap."""
        part = self.bytes[data].tolist()
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = {}
        heap = [(r, i, part[i], part[i + 1]) for i, r in enumerate(self.joined(self.bytes[data[:-1]], self.bytes[data[1:]]).tolist()) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n:
                    key = (part[x], part[y])
                    if key not in pair:
                        pair[key] = int(self.joined(np.array([key[0]]), np.array([key[1]]))[0])
                    if pair[key] != _NONE:
                        heapq.heappush(heap, (pair[key], x, *key))
        return np.array([x for x in part if x >= 0], np.int32)

    def _merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, most = len(start), int(length.max())
        parts = np.zeros((n, most), np.int32)
        inside = np.arange(most) < length[:, None]
        parts[inside] = self.bytes[data[T.ragged(start, length)]]
        ranks = np.full((n, most), _NONE, np.int32)
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self.joined(parts[:, :-1][pair], parts[:, 1:][pair])
        size = length.copy()
        finished: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        row = np.arange(n)
        column = np.arange(most)
        while len(row):
            at = ranks.argmin(1)
            i = np.arange(len(row))
            least = ranks[i, at]
            end = least == _NONE
            if end.any():
                finished.append((row[end], parts[end], size[end]))
                go = np.flatnonzero(~end)
                if not len(go):
                    break
                parts, ranks, size, row, at, least = parts[go], ranks[go], size[go], row[go], at[go], least[go]
                i = np.arange(len(row))
            # delete the boundary after part at
            source = np.minimum(column + (column > at[:, None]), len(column) - 1)
            parts = np.take_along_axis(parts, source, 1)
            ranks = np.take_along_axis(ranks, source, 1)
            ranks[:, -1] = _NONE
            parts[i, at] = least
            size -= 1
            ranks[i, size - 1] = _NONE
            # refresh the ranks on both sides
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.joined(parts[left, at[left] - 1], least[left])
            right = np.flatnonzero(at < size - 1)
            ranks[right, at[right]] = self.joined(least[right], parts[right, at[right] + 1])
            width = int(size.max())
            if width < len(column):
                parts, ranks, column = parts[:, :width], ranks[:, :width], column[:width]
        count = np.empty(n, np.int64)
        for rows, _, s in finished:
            count[rows] = s
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for rows, p, s in finished:
            out[T.ragged(first[rows], s)] = p[np.arange(p.shape[1]) < s[:, None]]
        return out, count

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens in a row."""
        length = self.length[ids]
        return self.data[T.ragged(self.ends[ids] - length, length)]


@lru_cache(2)
def _parsed(text: bytes) -> Vocabulary:
    return Vocabulary(text)


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        text = f.read(VOCABULARY_BYTES + 1)
    if len(text) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return text


def vocabulary(path: str) -> Vocabulary:
    return _parsed(_file(path))


_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], T.U)
_BYTES_KEY = T.U(255 << 56)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """a with room for n rows, doubled when there isn't."""
    if n <= len(a):
        return a
    out = np.zeros((max(n, 2 * len(a)), *a.shape[1:]), a.dtype)
    out[: len(a)] = a
    return out


class Encoder:
    """Encodes chunks of texts; remembers pieces.

    A piece's key is its length and, up to 7 bytes, the bytes themselves; up to WORDS * 8 bytes a hash, which counts for
    nothing unless the bytes agree, too; beyond that, its number in a dictionary of byte strings.
    """

    def __init__(self, v: Vocabulary, long: int = LONG):
        self.v, self.long = v, long
        self.place: dict[int, int] = {}
        self.strings: dict[bytes, int] = {}
        self.held = 0  # bytes of strings
        self.n = self.m = 0  # pieces and ids that are kept
        self.first, self.count = np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.words = np.zeros((1024, WORDS), T.U)
        self.ids = np.empty(4096, np.int32)

    def _named(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Keys of pieces by their bytes."""
        out = np.empty(len(which), T.U)
        for i, (a, b) in enumerate(zip(start[which].tolist(), end[which].tolist())):
            piece = data[a:b].tobytes()
            if piece not in self.strings:
                self.strings[piece] = len(self.strings)
                self.held += len(piece)
            out[i] = self.strings[piece]
        return out | _BYTES_KEY

    def encode(self, c: T.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        start = pieces(c.data, c.offsets)
        if not len(start):
            return np.empty(0, np.int32), np.zeros(len(c), np.int64)
        if self.n > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.__init__(self.v, self.long)
        end = np.append(start[1:], len(c.data))
        size = end - start
        padded = np.concatenate((c.data, np.zeros(8 * WORDS, np.uint8)))
        word = np.ndarray((len(c.data) + 8 * WORDS - 7,), "<u8", padded, 0, (1,))  # the 8 bytes from each place on
        key = size.astype(T.U) << T.U(56) | word[start] & _MASK[np.minimum(size, 7)]
        middle = np.flatnonzero((size > 7) & (size <= 8 * WORDS))
        words, h = np.zeros((len(middle), WORDS), T.U), size[middle].astype(T.U)
        for i in range(WORDS):
            there = np.flatnonzero(size[middle] > 8 * i)
            at = middle[there]
            words[there, i] = word[start[at] + 8 * i] & _MASK[np.minimum(size[at] - 8 * i, 8)]
            h[there] = self._mixed(h[there], words[there, i])
        key[middle] = size[middle].astype(T.U) << T.U(56) | h >> T.U(8)
        large = np.flatnonzero(size > 8 * WORDS)
        key[large] = self._named(c.data, start, end, large)
        row = np.full(len(start), -1)
        row[middle] = np.arange(len(middle))
        while True:
            new, where, code = np.unique(key, return_index=True, return_inverse=True)
            hashed = middle[key[middle] < _BYTES_KEY]
            other = hashed[(words[row[hashed]] != words[row[where[code[hashed]]]]).any(1)]
            if not len(other):
                break
            key[other] = self._named(c.data, start, end, other)  # pieces that share a hash only
        place = np.array([self.place.get(k, -1) for k in new.tolist()], np.int64)
        by_hash = np.flatnonzero((place >= 0) & (row[where] >= 0) & (new < _BYTES_KEY))
        wrong = by_hash[(words[row[where[by_hash]]] != self.words[place[by_hash]]).any(1)]
        place[wrong] = -1
        miss = np.flatnonzero(place < 0)
        if len(miss):
            s = start[where[miss]]
            ids, count = self.v.merge(c.data, s, end[where[miss]] - s, self.long)
            n, m = self.n + len(miss), self.m + len(ids)
            self.first, self.count, self.words, self.ids = _grown(self.first, n), _grown(self.count, n), _grown(self.words, n), _grown(self.ids, m)
            place[miss] = np.arange(self.n, n)
            self.first[self.n : n] = self.m + np.cumsum(count) - count
            self.count[self.n : n] = count
            self.ids[self.m : m] = ids
            hashed = np.flatnonzero(row[where[miss]] >= 0)
            self.words[self.n : n] = 0
            self.words[self.n + hashed] = words[row[where[miss[hashed]]]]
            for k, i in zip(new[miss].tolist(), place[miss].tolist()):
                self.place.setdefault(k, i)
            self.n, self.m = n, m
        at = place[code]
        n = self.count[at]
        total = np.concatenate(([0], np.cumsum(n)))
        piece = np.searchsorted(start, c.offsets)
        return self.ids[T.ragged(self.first[at], n)], np.diff(total[piece])

    @staticmethod
    def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
        return T.mix(h * T.U(0x9E3779B97F4A7C15) + word)


def _encoded(spark: SparkSession, path: str, text: str, keep: bool, long: int):
    held = spark.sparkContext.broadcast(_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _parsed(held.value)
        e = Encoder(v, long)
        for batch in batches:
            for c in T.chunks(batch[text]):
                ids, n = e.encode(c)
                null = batch[text].slice(c.first, len(c)).is_null().to_numpy(zero_copy_only=False)
                at = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                tokens = pa.ListArray.from_arrays(at, pa.array(ids), mask=pa.array(null))
                counts = pa.array(n, mask=null)
                here = batch.slice(c.first, len(c))
                if keep:
                    yield pa.RecordBatch.from_arrays([*here.columns, tokens, counts], [*here.schema.names, "tokens", "n_tokens"])
                else:
                    back = v.decode(ids)
                    ends = np.concatenate(([0], np.cumsum(v.length[ids])))[at.to_numpy()]
                    wrong = np.concatenate(([0], np.cumsum(back != c.data))) if len(back) == len(c.data) else None
                    same = (ends == c.offsets)[1:] & (wrong[c.offsets[1:]] == wrong[c.offsets[:-1]]) if wrong is not None else np.array([back[a:b].tobytes() == c.data[x:y].tobytes() for a, b, x, y in zip(ends, ends[1:], c.offsets, c.offsets[1:])])
                    yield pa.RecordBatch.from_arrays([here["doc_id"], tokens, counts, pa.array(same, mask=null)], ["doc_id", "tokens", "n_tokens", "round_trip"])

    return run


def encode(docs: DataFrame, path: str = VOCABULARY, long: int = LONG) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) of each row of docs; round_trip says whether decoding gave the text again."""
    common.integers(docs, "doc_id")
    d = common.narrow(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    return d.mapInArrow(common.lean(_encoded(docs.sparkSession, path, "text", False, long)), "doc_id long, tokens array<int>, n_tokens long, round_trip boolean")


def encode_documents(docs: DataFrame, path: str = VOCABULARY, long: int = LONG) -> DataFrame:
    """docs with the columns tokens and n_tokens."""
    docs = common.without(docs, "tokens", "n_tokens")
    plain, (text,) = common.numbered(docs, "text")
    schema = StructType([*plain.schema.fields, StructField("tokens", ArrayType(IntegerType())), StructField("n_tokens", LongType())])
    return plain.mapInArrow(common.lean(_encoded(docs.sparkSession, path, text, True, long)), schema).toDF(*docs.columns, "tokens", "n_tokens")


def decode(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """df with the column decoded, the text of its tokens: null for null; bytes that aren't UTF-8 are replaced; ids that the vocabulary hasn't are an error."""
    df = common.without(df, "decoded")
    plain, (tokens,) = common.numbered(df, "tokens")
    held = df.sparkSession.sparkContext.broadcast(_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _parsed(held.value)
        for batch in batches:
            out = [None if t is None else v.decode(np.array(t, np.int64)).tobytes().decode("utf-8", "replace") for t in batch[tokens].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return plain.mapInArrow(common.lean(run), StructType([*plain.schema.fields, StructField("decoded", StringType())])).toDF(*df.columns, "decoded")
