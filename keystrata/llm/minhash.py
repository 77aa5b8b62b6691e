"""Near-duplicate documents by DartMinHash.

A text is a weighted set: its pairs of consecutive words, lower-cased, each weighted by how often it stands there. Darts
fall on the plane of an element's weight and a rank as a Poisson process that the element's hash alone determines, so two
texts see the same darts wherever their regions overlap. A text's region is its elements' weights times the ranks below a
bound that is chosen so that about K (ln K + 2) darts hit it; each dart belongs to one of K coordinates, and the dart of
least rank is the coordinate's value. Two texts agree in a coordinate with the probability of their weighted Jaccard
similarity. A text with a coordinate that no dart hit gets twice the bound until all are hit.

Texts that agree in a whole band of coordinates are candidates, and similar if their whole signatures say so. Groups are the
connected components of all similar pairs; the least id of a group stands for it.

Texts of one signature are linked and count as the least id of them. In each bucket, every text of a batch is held against the
batch's least id there, and these against the least of all; then each text is held against every other that these links don't
yet join to it. Buckets of over BLOCK texts are cut into blocks,
and each pair of blocks is a piece of work of its own. What is known of a bucket or a signature (its least id, how many texts
it has) is aggregated where the texts lie, and joined back where it must be, so no task holds a bucket or the copies of a text.

Words are runs of letters and digits (all bytes beyond ASCII count as letters). A text of one word is that word; null texts
and texts without words are in no group. Rows without a doc_id are in no group. For near_duplicates() rows that share a doc_id
are one document; drop_near_duplicates() judges those with different texts apart, and keeps one of those with the same. Other columns aren't read. An empty table gives an
empty result. Ids that aren't integers are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from keystrata.llm import common, text as T
from keystrata.llm.components import components

BANDS, ROWS = 60, 4
#: Texts are near duplicates if the share of coordinates that they agree in says so.
SIMILAR = 0.5
#: About as many texts of a bucket are held against as many others at once.
BLOCK = 2048
#: Pairs of texts whose signatures are compared at once.
PAIRS = 1 << 16


def elements(c: T.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight): pairs of consecutive words and how often each stands in its text."""
    low = T.LOWER[c.data]
    w = T.spans(T.WORD[low], c.offsets)
    h = T.hashes(low, w)
    count = np.diff(w.first)
    n = np.where(count == 1, 1, np.maximum(count - 1, 0))
    at = T.ragged(w.first[:-1], n)
    of = np.repeat(np.arange(len(c)), n)
    nxt = np.where(count[of] == 1, T.U(0), h[np.minimum(at + 1, len(h) - 1)]) if len(h) else h
    e = T.mix(h[at] * T.U(0x9E3779B97F4A7C15) + nxt)
    order = np.lexsort((e, of))
    of, e = of[order], e[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    return of[head], e[head], np.diff(np.append(head, len(e))).astype(float)


def signatures(of: np.ndarray, e: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(n x k values, which texts have any): of is each element's text; weights are positive reals."""
    sig = np.zeros((n, k), T.U)
    total = np.bincount(of, weights=weight, minlength=n)
    todo = total > 0
    # strips of weight 1 and the last one's share
    strips = np.ceil(weight).astype(np.int64)
    row = np.repeat(np.arange(len(e)), strips)
    level = T.ragged(np.zeros(len(e), np.int64), strips)
    cell = T.mix(e[row] + level.astype(T.U) * T.U(0xD1B54A32D192ED03))
    share = np.minimum(weight[row] - level, 1.0)
    cell_of = of[row]
    bound = k * (np.log(k) + 2) / np.maximum(total, 1e-300)
    whole = bool((share == 1).all())
    while todo.any():
        best = np.full(n * k, np.inf)
        live = np.flatnonzero(todo[cell_of])
        c, text = cell[live], cell_of[live]
        rank, most, first, part = np.zeros(len(live)), bound[text], text * k, share[live]
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        throw = 0
        while len(c):
            throw += 1
            x = T.mix(c + T.U(throw * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            rank = rank - np.log(((x >> T.U(24)).astype(float) + 0.5) * 2.0**-40)
            inside = np.flatnonzero(rank < most)
            c, rank, most, first, x = c[inside], rank[inside], most[inside], first[inside], x[inside]
            key = first + ((x & T.U(0xFFFFFF)) * T.U(k) >> T.U(24)).view(np.int64)
            if whole:
                hits.append((key, rank, x))
            else:
                part = part[inside]
                hit = (T.mix(x) >> T.U(11)).astype(float) * 2.0**-53 < part
                hits.append((key[hit], rank[hit], x[hit]))
        key, rank, x = (np.concatenate(a) for a in zip(*hits))
        np.minimum.at(best, key, rank)
        won = np.flatnonzero(rank == best[key])
        flat = sig.reshape(-1)
        flat[key[won]] = x[won]
        todo = todo & np.isinf(best.reshape(n, k)).any(1)
        bound = np.where(todo, bound * 2, bound)
    return sig, total > 0


def _sign(bands: int, rows: int):
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = T.stream(k, 7).reshape(bands, rows) | T.U(1)
        number = T.stream(bands, 8)
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for c in T.chunks(batch["text"]):
                sig, some = signatures(*elements(c), len(c), k)
                if not some.any():
                    continue
                at = np.flatnonzero(some)
                sig = T.mix(sig[at])
                band = T.mix((T.mix(sig).reshape(-1, bands, rows) * salt).sum(2, dtype=T.U) + number).view(np.int64)
                small = np.zeros((len(at), 16 * _words(k)), np.uint8)
                small[:, :k] = sig & T.U(15)
                packed = small[:, ::2] << 4 | small[:, 1::2]
                m, width = packed.shape
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[c.first + at]),
                        pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(0, (m + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(packed))]),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * bands, bands, dtype=np.int32)), pa.array(band.reshape(-1))),
                    ],
                    ["doc_id", "sig", "bands"],
                )

    return run


def _words(k: int) -> int:
    """64-bit words of a packed signature of k coordinates."""
    return -(-k // 16)


def _alike(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Share of the coordinates that packed signatures agree in, without the 1 in 16 that do by chance."""
    z = x ^ y
    z |= z >> T.U(1)
    z |= z >> T.U(2)
    other = np.bitwise_count(z & T.U(0x1111111111111111)).sum(-1, dtype=np.int64)
    return ((k - other) / k - 1 / 16) / (15 / 16)


def _packed(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), T.U).reshape(len(column), _words(k))


def _agree(k: int, similar: float):
    return F.arrow_udf(lambda a, b: pa.array(_alike(_packed(a, k), _packed(b, k), k) >= similar), BooleanType())


def _links(ids: np.ndarray, label: np.ndarray, sig: np.ndarray, start: np.ndarray, count: np.ndarray, k: int, similar: float) -> Iterator[np.ndarray]:
    """(2 x n) ids of similar pairs: each row i against rows start[i] to start[i] + count[i] but those of its label; what a pair joins becomes one label."""
    upto = np.cumsum(count)
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - count[a] + PAIRS, "right")))
        i, j = np.repeat(np.arange(a, b), count[a:b]), T.ragged(start[a:b], count[a:b])
        other = np.flatnonzero(label[i] != label[j])
        i, j = i[other], j[other]
        good = _alike(sig[i], sig[j], k) >= similar
        i, j = i[good], j[good]
        if len(i):
            yield np.stack((np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])))
            if b < len(ids):
                for x, y in zip(i.tolist(), j.tolist()):
                    if label[x] != label[y]:
                        # only within the bucket: start is its first row, count reaches to its last
                        part = slice(int(start[x]), int(np.searchsorted(start, start[x], "right")))
                        of = label[part]
                        of[of == label[x]] = label[y]
        a = b


def _rest(k: int, similar: float):
    """Of rows in order of piece and block, a piece being one block or two of a bucket: the similar pairs within the one, or across the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(piece: np.ndarray, block: np.ndarray, two: np.ndarray, ids: np.ndarray, label: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
            n = len(ids)
            new = np.ones(n, bool)
            new[1:] = (piece[1:] != piece[:-1]).any(1)
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            turn = new.copy()
            turn[1:] |= block[1:] != block[:-1]
            first = np.maximum.accumulate(np.where(turn, np.arange(n), 0))  # of the row's block
            count = np.where(two, first, np.arange(n)) - start
            for found in _links(ids, label, sig, start, count, k, similar):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["doc_id", "lead"])

        held: list[np.ndarray] = []
        for batch in batches:
            if not len(batch):
                continue
            piece = np.stack([batch[c].to_numpy() for c in ("bucket", "p", "q")], 1)
            now = [piece, batch["block"].to_numpy(), piece[:, 1] != piece[:, 2], batch["doc_id"].to_numpy(), batch["label"].to_numpy().copy(), _packed(batch["sig"], k)]
            held = [np.concatenate(a) for a in zip(held, now)] if held else now
            last = held[0][-1]
            if (held[0][0] == last).all():
                continue
            whole = int(np.flatnonzero((held[0] != last).any(1))[-1]) + 1
            yield from pairs(*(a[:whole] for a in held))
            held = [a[whole:] for a in held]
        if held:
            yield from pairs(*held)

    return run


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, doc_id, lead) of each text's buckets, lead being the batch's least id there."""
    for batch in batches:
        if not len(batch):
            continue
        batch = batch.take(pa.array(np.argsort(batch["doc_id"].to_numpy(), kind="stable")))
        bucket = batch["bands"].flatten().to_numpy()
        ids = np.repeat(batch["doc_id"].to_numpy(), len(bucket) // len(batch))
        order = np.argsort(bucket, kind="stable")
        bucket, ids = bucket[order], ids[order]
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        lead = ids[np.maximum.accumulate(np.where(new, np.arange(len(bucket)), 0))]
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ids), pa.array(lead)], ["bucket", "doc_id", "lead"])


def similar_pairs(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, similar: float = SIMILAR, made: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, lead) of near duplicates, lead < doc_id: their components are those of all similar pairs that share a bucket. made gets the tables that it reads."""
    spark, k = docs.sparkSession, bands * rows
    common.integers(docs, "doc_id")
    d = common.narrow(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    signed = common.cut(d.mapInArrow(common.lean(_sign(bands, rows)), "doc_id long, sig binary, bands array<long>"), made)
    # texts of one signature, by 128 bits of it
    key = [F.xxhash64("sig", "bands").alias("x"), F.xxhash64("bands", "sig").alias("y")]
    named = signed.select("doc_id", *key)
    heads = named.groupBy("x", "y").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).filter("last <> lead")
    same = common.cut(named.join(heads, ["x", "y"]).filter("doc_id <> lead").select("doc_id", "lead", "x", "y"), made)
    signed = signed.select("*", *key).join(same.select("doc_id", "x", "y").distinct(), ["doc_id", "x", "y"], "left_anti").select("doc_id", "sig", "bands")
    signed = common.cut(signed, made)
    sig = signed.select("doc_id", "sig")
    local = signed.select("doc_id", "bands").mapInArrow(common.lean(_local), "bucket long, doc_id long, lead long")
    followers = local.filter("doc_id <> lead")
    # one text of a bucket from each batch
    w = Window.partitionBy("bucket")
    leads = local.filter("doc_id = lead").select("bucket", "doc_id").withColumns({"lead": F.min("doc_id").over(w), "last": F.max("doc_id").over(w)}).filter("last <> lead").drop("last")
    held = common.cut(followers.union(leads), made)
    pairs = held.filter("doc_id <> lead").select("doc_id", "lead").distinct().join(sig, "doc_id").join(sig.select(F.col("doc_id").alias("lead"), F.col("sig").alias("other")), "lead")
    good = common.cut(pairs.filter(_agree(k, similar)("sig", "other")).select("doc_id", "lead").distinct(), made)
    known = components(good, made).toDF("doc_id", "least")
    rest = held.select("bucket", "doc_id").union(held.select("bucket", "lead")).distinct().join(known, "doc_id", "left").select("bucket", "doc_id", F.coalesce("least", "doc_id").alias("label"))
    rest = common.cut(rest, made)
    mixed = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    rest = rest.join(mixed.select("bucket", "n"), "bucket")
    blocks = F.ceil(F.col("n") / block).cast("long")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rest = rest.select("bucket", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "block", "doc_id", "label").join(sig, "doc_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = rest.repartition(n, "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "block", "doc_id").mapInArrow(common.lean(_rest(k, similar)), "doc_id long, lead long")
    return same.select("doc_id", "lead").union(good).union(rest)


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, keep_id): each document that isn't its group's least, and the least, which stands for the group."""
    made: list[str] = []
    found = components(similar_pairs(docs, bands, rows, similar, made)).select(F.col("id").alias("doc_id"), F.col("least").alias("keep_id"))
    common.discard(docs.sparkSession, made)  # the components are a table of their own
    return found


def _one_of_repeats(docs: DataFrame) -> DataFrame:
    """docs without the rows that repeat the doc_id and the text of another: the one whose other columns come first stays."""
    plain, (doc_id, text) = common.numbered(docs, "doc_id", "text")
    plain = plain.withColumns({"id": F.col(doc_id).cast("long"), "key": F.xxhash64(text)})
    rows = plain.filter(F.col("id").isNotNull() & F.col(text).isNotNull())
    made: list[str] = []
    twice = common.cut(rows.groupBy("id", "key").count().filter("count > 1").select("id", "key"), made)
    if twice.isEmpty():
        common.discard(docs.sparkSession, made)
        return docs
    names = [f"c{i}" for i in range(len(docs.columns))]
    once = plain.withColumn("key", F.when(F.col(text).isNotNull(), F.col("key"))).join(twice, ["id", "key"], "left_anti")
    order = [c for c, kind in plain.dtypes if not any(x in kind for x in ("map<", "variant", "void"))]
    first = rows.join(twice, ["id", "key"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("id", "key").orderBy(*order))).filter("n = 1")
    return once.select(names).union(first.select(names)).toDF(*docs.columns)


def drop_near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, similar: float = SIMILAR) -> DataFrame:
    """docs, in the same columns, with one document of each group, and one row of those that share doc_id and text.

    Rows that share a doc_id but not the text are judged apart, in the order of their texts' hashes.
    """
    spark, made = docs.sparkSession, []
    plain, (doc_id, text) = common.numbered(_one_of_repeats(docs), "doc_id", "text")
    there = F.col(doc_id).isNotNull() & F.col(text).isNotNull()
    named = plain.filter(there).select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    several = named.groupBy("id").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least <> most").limit(1)
    if several.isEmpty():
        gone = near_duplicates(docs, bands, rows, similar).select(F.col("doc_id").alias("gone"))
        return plain.join(gone, F.col(doc_id).cast("long") == F.col("gone"), "left_anti").toDF(*docs.columns)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # numbers in the order of ids and hashes
    ranked = named.repartitionByRange(n, "id", "key").sortWithinPartitions("id", "key").withColumn("number", F.monotonically_increasing_id())
    ranked = common.cut(ranked, made)
    found = near_duplicates(ranked.select(F.col("number").alias("doc_id"), "text"), bands, rows, similar).select(F.col("doc_id").alias("number"))
    gone = common.cut(ranked.join(found, "number", "left_semi").select("id", "key"))
    common.discard(spark, made)
    return plain.join(gone, there & (F.col(doc_id).cast("long") == F.col("id")) & (F.xxhash64(text) == F.col("key")), "left_anti").toDF(*docs.columns)
