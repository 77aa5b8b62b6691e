"""The functions and searches under names that SQL can call.

register(spark) gives the functions of vectors, hashes and locators; register_models() those of models; register_search() and
register_graph() table functions, which are called as SELECT * FROM name(arguments) or, for a table of queries, laterally.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, ShortType, StringType

from keystrata.functions import hashes, vectors
from keystrata.functions.vectors import matrix
from keystrata.operators import ann, graph, quantize
from keystrata.operators.quantize import Codes, Lists
from keystrata.sources.table import KeyTable

_CALLS: dict[int, Callable] = {
    1: lambda run: lambda a: run(a),
    2: lambda run: lambda a, b: run(a, b),
    3: lambda run: lambda a, b, c: run(a, b, c),
    4: lambda run: lambda a, b, c, d: run(a, b, c, d),
    5: lambda run: lambda a, b, c, d, e: run(a, b, c, d, e),
}


def _each(kernel):
    """A function of one Arrow column, a row at a time, as texts and bytes are read; null for null."""
    return lambda column, out: pa.array([None if x is None else kernel(x) for x in column.to_pylist()], out)


def _valid(*columns: pa.Array) -> np.ndarray:
    ok = np.ones(len(columns[0]), bool)
    for c in columns:
        ok &= c.is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(ok)


def _same(rows: list) -> Iterator[tuple[object, np.ndarray]]:
    """(value, where it stands) of each different value; lists count as values."""
    found: dict[object, list[int]] = {}
    for i, x in enumerate(rows):
        found.setdefault(tuple(x) if isinstance(x, list) else x, []).append(i)
    for x, at in found.items():
        yield x, np.array(at)


def _batched(kernel, out: pa.DataType):
    """A function of a column of vectors and further arguments: kernel(matrix, arguments) for each set of arguments and dimension; null if any is."""

    def run(v: pa.Array, *args: pa.Array) -> pa.Array:
        there = _valid(v, *args)
        result: list = [None] * len(v)
        if not len(there):
            return pa.array(result, out)
        rows = v.take(pa.array(there))
        if rows.flatten().null_count:
            raise ValueError("a vector has a null element")
        sizes = np.diff(rows.offsets.to_numpy()).tolist()
        given = [a.take(pa.array(there)).to_pylist() for a in args]
        keys = [(n, *(tuple(x) if isinstance(x, list) else x for x in rest)) for n, *rest in zip(sizes, *given)]
        for (_, *rest), at in _same(keys):
            found = kernel(matrix(rows.take(pa.array(at)), np.float32), *(np.array(x, np.float32) if isinstance(x, tuple) else x for x in rest))
            for i, x in zip(there[at].tolist(), found):
                result[i] = x.tolist() if isinstance(x, (np.ndarray, np.generic)) else x
        return pa.array(result, out)

    return run


#: Locators: 16 bytes of a major and a minor number.
_HALF = """CASE WHEN length(l) = 16 THEN cast(CASE WHEN cast(conv(substr(hex(l), {at}, 16), 16, 10) AS DECIMAL(20, 0)) >= 9223372036854775808
THEN cast(conv(substr(hex(l), {at}, 16), 16, 10) AS DECIMAL(20, 0)) - 18446744073709551616 ELSE cast(conv(substr(hex(l), {at}, 16), 16, 10) AS DECIMAL(20, 0)) END AS BIGINT)
WHEN l IS NOT NULL THEN cast(raise_error('a locator has 16 bytes') AS BIGINT) END"""
_PARTS = "named_struct('a', locator_major({x}), 'b', locator_minor({x}))"
LOCATORS = {
    "locator_pack(a BIGINT, b BIGINT) RETURNS BINARY": "unhex(concat(lpad(hex(a), 16, '0'), lpad(hex(b), 16, '0')))",
    "locator_pack_minor(b BIGINT) RETURNS BINARY": "locator_pack(0, b)",
    "locator_major(l BINARY) RETURNS BIGINT": _HALF.format(at=1),
    "locator_minor(l BINARY) RETURNS BIGINT": _HALF.format(at=17),
    "locator_to_hex(l BINARY) RETURNS STRING": "concat(substr(hex(l), 1, 16), ':', substr(hex(l), 17))",
    "locator_compare(x BINARY, y BINARY) RETURNS INT": f"CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN {_PARTS.format(x='x')} < {_PARTS.format(x='y')} THEN -1 WHEN {_PARTS.format(x='x')} > {_PARTS.format(x='y')} THEN 1 ELSE 0 END",
    **{f"locator_{name}(x BINARY, y BINARY) RETURNS BOOLEAN": f"locator_compare(x, y) {op} 0" for name, op in (("less", "<"), ("less_or_equal", "<="), ("equal", "="), ("greater_or_equal", ">="), ("greater", ">"), ("unequal", "<>"))},
    "locator_advance_major(l BINARY, n BIGINT) RETURNS BINARY": "locator_pack(locator_major(l) + n, locator_minor(l))",
    "locator_next_minor(l BINARY, n BIGINT) RETURNS BINARY": "locator_pack(locator_major(l), locator_minor(l) + n)",
}


def register(spark: SparkSession) -> None:
    """vector_in, vector_out, half_in, half_vector, cosine_distance, their binary forms, the hashes, and all locator functions."""
    f32 = pa.list_(pa.float32())
    for name, kernel, kind, out in (
        ("vector_in", lambda s: vectors.parse(s).tolist(), ArrayType(FloatType()), f32),
        ("half_in", lambda s: vectors.parse_half(s).astype(np.float32).tolist(), ArrayType(FloatType()), f32),
        ("vector_out", lambda v: vectors.text(np.array(v, np.float32)), StringType(), pa.string()),
        ("half_out", lambda v: vectors.text(np.array(v, np.float16)), StringType(), pa.string()),
        ("vector_send", lambda v: vectors.to_bytes(np.array(v, np.float32)), BinaryType(), pa.binary()),
        ("vector_recv", lambda b: vectors.from_bytes(b).tolist(), ArrayType(FloatType()), f32),
        ("half_send", lambda v: vectors.to_bytes(np.array(v, np.float16)), BinaryType(), pa.binary()),
        ("half_recv", lambda b: vectors.from_bytes(b, True).astype(np.float32).tolist(), ArrayType(FloatType()), f32),
    ):
        spark.udf.register(name, F.arrow_udf(lambda a, run=_each(kernel), out=out: run(a, out), kind))
    spark.udf.register("half_vector", vectors.half)
    spark.udf.register("cosine_distance", vectors.cosine_distance)
    for name, kernel, n, many in (
        ("vector_simhash", hashes.simhash, 2, False),
        ("vector_vq", hashes.vq, 3, False),
        ("vector_rvq", hashes.rvq, 4, False),
        ("vector_rpvq", hashes.rpvq, 4, False),
        ("vector_cvq", hashes.cvq, 4, False),
        ("vector_cvq_probe", hashes.cvq_probe, 5, True),
    ):
        spark.udf.register(name, F.arrow_udf(_CALLS[n](_batched(kernel, pa.list_(pa.int16()) if many else pa.int16())), ArrayType(ShortType()) if many else ShortType()))
    for head, body in LOCATORS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register_models(spark: SparkSession, codes: Codes, lists: Lists | None = None) -> None:
    """pq_encode, pq_distance_table, pq_adc_lookup, pq_distance, ivf_assign and ivf_probe by these models; of residuals, whose functions take the list too: pq_encode_residual, pq_distance_table_residual, pq_distance_residual."""
    lists = lists or codes.lists
    held = quantize.shared(spark, codes.books, *([lists.centroids] if lists is not None else []))
    residual = codes.lists is not None

    def model() -> Codes:
        return Codes(held.value[0], Lists(held.value[1]) if residual else None)

    def add(name: str, n: int, run, kind) -> None:
        spark.udf.register(name, F.arrow_udf(_CALLS[n](run), kind))

    def lookup(tables: pa.Array, code: pa.Array) -> pa.Array:
        """Each different table is read once a batch."""
        ok = _valid(tables, code)
        out = np.zeros(len(code))
        rows, given = code.take(pa.array(ok)).to_pylist(), tables.take(pa.array(ok)).to_pylist()
        for t, at in _same(given):
            c = _codes([rows[i] for i in at.tolist()], len(t) // (4 * quantize.CENTROIDS))
            out[ok[at]] = quantize.adc(np.frombuffer(t, "<f4").reshape(-1, quantize.CENTROIDS), c)
        return pa.array(out, mask=np.isin(np.arange(len(out)), ok, invert=True))

    def _codes(rows: list[bytes], m: int) -> np.ndarray:
        if any(len(r) != m for r in rows):
            raise ValueError(f"a code that isn't of {m} bytes")
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, m)

    def distance(*columns: pa.Array) -> pa.Array:
        """Distances of vectors to codes: the table of each different vector, and list, is made once a batch."""
        ok = _valid(*columns)
        out = np.zeros(len(columns[0]))
        taken = [c.take(pa.array(ok)).to_pylist() for c in columns]
        for key, at in _same([(tuple(v), *rest) for v, *rest in zip(taken[0], *taken[1:-1])]):
            table = model().table(np.array(key[0], np.float32), *key[1:])
            out[ok[at]] = quantize.adc(table, _codes([taken[-1][i] for i in at.tolist()], len(table)))
        return pa.array(out, mask=np.isin(np.arange(len(out)), ok, invert=True))

    add("pq_adc_lookup", 2, lookup, DoubleType())
    if residual:
        add("pq_encode_residual", 2, _batched(lambda v, p: [c.tobytes() for c in model().encode(v, np.full(len(v), p))], pa.binary()), BinaryType())
        add("pq_distance_table_residual", 2, _batched(lambda v, p: [model().table(x, p).astype("<f4").tobytes() for x in v], pa.binary()), BinaryType())
        add("pq_distance_residual", 3, distance, DoubleType())
    else:
        add("pq_encode", 1, _batched(lambda v: [c.tobytes() for c in model().encode(v)], pa.binary()), BinaryType())
        add("pq_distance_table", 1, _batched(lambda v: [model().table(x).astype("<f4").tobytes() for x in v], pa.binary()), BinaryType())
        for name in ("pq_distance", "pq_adc"):
            add(name, 2, distance, DoubleType())
    if lists is not None:
        add("ivf_assign", 1, _batched(lambda v: Lists(held.value[1]).assign(v), pa.int16()), ShortType())
        add("ivf_probe", 2, _batched(lambda v, n: Lists(held.value[1]).probe(v, n), pa.list_(pa.int16())), ArrayType(ShortType()))


#: Nearest first, the first lim of first, by a vector's own distance if rerank is over 0.
_RANKED = """SELECT id, distance FROM (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS n FROM (
SELECT id, CASE WHEN rerank > 0 THEN coalesce(cosine_distance(embedding, q), near) ELSE near END AS distance FROM (
SELECT id, embedding, near, row_number() OVER (ORDER BY near, id) AS n FROM ({first})) WHERE n <= CASE WHEN rerank > 0 THEN greatest(rerank, lim) ELSE lim END)) WHERE n <= lim"""


def register_search(spark: SparkSession, t: KeyTable, codes: Codes, lists: Lists | None = None, sketch: DataFrame | None = None) -> None:
    """ann_search(q, nprobe, lim, rerank) and ann_scan(q, nprobe, lim, rerank[, sketch_topk]) over the table: (id, distance) of the nearest.

    ann_search is for codes of the vectors themselves; ann_scan takes codes of residuals too, skips codes of another length,
    gives ids as text, and with a table of sketches (partition_id, id, sketch) takes sketch_topk between codes and vectors;
    a candidate without a sketch is an error there.
    """
    register(spark)
    register_models(spark, codes, lists)
    t.scan().createOrReplaceTempView("keystrata_search_rows")
    kind = t.schema["id"].dataType.simpleString()
    probed = "SELECT r.id, r.embedding, r.partition_id, {near} AS near FROM keystrata_search_rows r WHERE array_contains(ivf_probe(q, nprobe), r.partition_id) AND {ok}"
    plain = probed.format(near="pq_distance(q, r.pq_code)", ok="r.pq_code IS NOT NULL")
    if codes.lists is None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ann_search(q ARRAY<FLOAT>, nprobe INT, lim INT, rerank INT) RETURNS TABLE (id {kind}, distance DOUBLE) RETURN {_RANKED.format(first=plain)}")
    own = plain if codes.lists is None else probed.format(near="pq_distance_residual(q, cast(r.partition_id AS INT), r.pq_code)", ok="r.pq_code IS NOT NULL")
    own = own.replace("r.pq_code IS NOT NULL", f"length(r.pq_code) = {codes.m}")
    text = "SELECT coalesce(cast(id AS STRING), '') AS id, distance FROM ({ranked})"
    if sketch is None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ann_scan(q ARRAY<FLOAT>, nprobe INT, lim INT, rerank INT) RETURNS TABLE (id STRING, distance DOUBLE) RETURN {text.format(ranked=_RANKED.format(first=own))}")
        return
    sketch.createOrReplaceTempView("keystrata_search_sketches")
    some = f"SELECT id, embedding, partition_id, near FROM (SELECT *, row_number() OVER (ORDER BY near, id) AS n FROM ({own})) WHERE n <= greatest(rerank, lim)"
    near = "cosine_distance(coalesce(s.sketch, cast(raise_error('a candidate has no sketch') AS ARRAY<FLOAT>)), slice(q, 1, size(s.sketch)))"
    both = f"SELECT c.id, c.embedding, {near} AS near FROM ({some}) c LEFT JOIN keystrata_search_sketches s ON c.partition_id = s.partition_id AND c.id <=> s.id"
    kept = f"SELECT id, embedding, near FROM (SELECT *, row_number() OVER (ORDER BY near, id) AS n FROM ({both})) WHERE n <= greatest(sketch_topk, lim)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ann_scan(q ARRAY<FLOAT>, nprobe INT, lim INT, rerank INT, sketch_topk INT) RETURNS TABLE (id STRING, distance DOUBLE) RETURN {text.format(ranked=_RANKED.format(first=kept))}")


def register_graph(spark: SparkSession, nodes: DataFrame, entries: DataFrame | None = None, meta: DataFrame | None = None, rows: DataFrame | None = None) -> None:
    """graph_scan(q, ef, lim) on a flat graph or, if meta is given, hnsw_scan(q, ef, lim) on a hierarchy: (id, distance) of the nearest, by the vectors of rows (id, embedding) if those are given.

    Each task that asks holds the graph, whose size is checked; tables of queries are better sent to operators.graph. If ef is
    all nodes or more, and rows rank them, nothing is walked or held: all nodes count, reached or not.
    """
    register(spark)
    patience = int(graph.config.setting(spark, "graphPatience"))
    level = nodes if meta is None else nodes.filter("level = 0")
    whole = level.count() if rows is not None and not patience else 0
    try:
        found, refused = graph.held_walk(nodes, entries, patience) if meta is None else graph.held_hierarchy(meta, nodes, patience), ""
    except graph.TooLarge as e:
        found, refused = None, str(e)
    name = "graph_scan" if meta is None else "hnsw_scan"

    class Walk:
        def eval(self, q: list, ef: int):
            if whole and ef >= whole:
                return
            if refused:
                raise ValueError(refused)
            for shard, nid, distance in found(np.array(q), ef):
                yield shard, nid, distance

    spark.udtf.register(f"{name}_walk", F.udtf(Walk, returnType="shard int, nid long, distance double"))
    level.select((F.col("shard") if "shard" in nodes.columns else F.lit(0)).cast("int").alias("shard"), "nid", F.col("src_id").cast("string").alias("id")).createOrReplaceTempView(f"keystrata_{name}_nodes")
    near, join = "w.distance", ""
    if rows is not None:
        rows.select(F.col("id").cast("string").alias("vid"), "embedding").createOrReplaceTempView(f"keystrata_{name}_rows")
        near, join = "coalesce(cosine_distance(v.embedding, q), double('inf'))", f" LEFT JOIN keystrata_{name}_rows v ON g.id = v.vid"
    chosen = f"SELECT {'CASE WHEN v.vid IS NULL THEN \'\' ELSE g.id END' if rows is not None else 'g.id'} AS id, {near} AS distance FROM"
    walked = f"{chosen} {name}_walk(q, greatest(ef, lim)) w JOIN keystrata_{name}_nodes g ON w.nid = g.nid AND w.shard = g.shard{join}"
    if whole:
        walked = f"{walked} UNION ALL {chosen} keystrata_{name}_nodes g{join} WHERE greatest(ef, lim) >= {whole}"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(q ARRAY<FLOAT>, ef INT, lim INT) RETURNS TABLE (id STRING, distance DOUBLE) RETURN SELECT id, distance FROM (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS n FROM ({walked})) WHERE n <= lim")


def search_view(spark: SparkSession, name: str, t: KeyTable, queries: str, lists: Lists, codes: Codes, nprobe: int = 10, k: int = 10, rerank: int = 0) -> None:
    """A view of the nearest neighbours of a table or view of queries (query_id, query)."""
    ann.search_many(t, spark.table(queries), lists, codes, nprobe, k, rerank).createOrReplaceTempView(name)
