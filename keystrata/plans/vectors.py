"""Queries on vectors: distances, hashes, quantization, inverted lists and graphs."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType

from keystrata.functions import hashes, register, synthetic
from keystrata.functions.vectors import cosine_distance, half, head, matrix
from keystrata.operators import ann, graph, quantize
from keystrata.operators.quantize import Codes, Lists
from keystrata.plans.storage import Query, read, scratch

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIM, LISTS, M, K = 64, 16, 8, 10


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@cache
def fixed() -> tuple[Lists, Codes]:
    """Models that don't depend on the data, so that SQL can state them."""
    x = hashes.codebook(300, DIM, 7)
    return quantize.train_lists(x, LISTS, 3), quantize.train_codes(x, M, 3)


def _list(v) -> str:
    return "[" + ",".join(repr(float(x)) for x in v) + "]::DOUBLE[]"


def _table(rows: np.ndarray) -> str:
    return "(VALUES " + ", ".join(f"({i}, {_list(v)})" for i, v in enumerate(rows)) + ") AS c(i, c)"


QUERY = hashes.codebook(4, DIM, 11)[3]
E = "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_COS = "1 - greatest(-1, least(1, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))))"
KNN_SQL = f"{E}, q AS (SELECT {_list(QUERY)} AS q) SELECT id, round({_COS.format(a='v', b='q')}, 9) AS distance FROM e, q ORDER BY {_COS.format(a='v', b='q')}, id LIMIT {K}"
MANY_SQL = f"""{E}, d AS (SELECT x.id AS query_id, y.id, {_COS.format(a='x.v', b='y.v')} AS d FROM e x CROSS JOIN e y),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM d) SELECT query_id, rank, id, round(d, 9) AS distance FROM r WHERE rank <= {K}"""


def _many(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 9))


@query(f"{E} SELECT x.id AS a, y.id AS b, round({_COS.format(a='x.v', b='y.v')}, 9) AS distance FROM e x JOIN e y ON x.label = y.label AND x.id < y.id")
def cosine_pairs(spark, sf_dir):
    return ann.pairs(vectors(spark, sf_dir))


@query(KNN_SQL)
def knn_exact(spark, sf_dir):
    return _rounded(ann.exact(vectors(spark, sf_dir), QUERY, K))


@query(MANY_SQL)
def knn_per_query_topk(spark, sf_dir):
    found = ann.exact_many(vectors(spark, sf_dir), _many(spark, sf_dir), K, digits=9)
    return _rounded(found)


def _half(x: str) -> str:
    """A number rounded to 16 bits: to 11 digits of its power of two, or of 2 ** -14."""
    ulp = f"pow(2, greatest(floor(log2(greatest(abs({x}), 1e-30))), -14) - 10)"
    return f"round_even({x} / {ulp}, 0) * {ulp}"


_HALVES = f"h AS (SELECT id, v, list_transform(v, lambda x: {_half('x')}) AS h FROM e)"


@query(f"{E}, {_HALVES} SELECT id, round({_COS.format(a='h', b='v')}, 6) AS distance, TRUE AS stable FROM h")
def half_round_trip(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", half("embedding").alias("h"), "embedding")
    return v.select("id", F.round(cosine_distance("h", "embedding"), 6).alias("distance"), (half("h") == F.col("h")).alias("stable"))


@query(f"{E} SELECT id, CAST((" + " + ".join(f"CASE WHEN list_dot_product(v, {_list(p)}) > 0 THEN {1 << b} ELSE 0 END" for b, p in enumerate(hashes.planes(DIM, 42))) + ") AS SMALLINT) AS hash FROM e")
def simhash(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", hashes.on_column(hashes.simhash, F.col("embedding"), 42).alias("hash"))


@query(f"{E}, s AS (SELECT id, i, list_dot_product(v, c) AS d FROM e, {_table(hashes.codebook(32, DIM, 42))}) SELECT id, CAST(arg_max(i, d) AS SMALLINT) AS hash FROM s GROUP BY id")
def vq(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", hashes.on_column(hashes.vq, F.col("embedding"), 32, 42).alias("hash"))


@query(f"""{E}, s AS (SELECT id, any_value(v) AS v, arg_max(i, list_dot_product(v, c)) AS i, arg_max(c, list_dot_product(v, c)) AS c FROM e, {_table(hashes.codebook(8, DIM, 42))} GROUP BY id),
r AS (SELECT id, i, list_transform(range(1, {DIM + 1}), lambda j: CAST(CAST(v[j] AS FLOAT) - CAST(c[j] AS FLOAT) AS DOUBLE)) AS r FROM s),
f AS (SELECT id, r.i, c.i AS j, list_dot_product(r, c) AS d FROM r, {_table(hashes.codebook(16, DIM, 43))})
SELECT id, CAST(any_value(i) * 16 + arg_max(j, d) AS SMALLINT) AS hash FROM f GROUP BY id""")
def rvq(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", hashes.on_column(hashes.rvq, F.col("embedding"), 8, 16, 42).alias("hash"))


@query(f"""{E}, p AS (SELECT id, list(list_dot_product(v, c) ORDER BY i) AS p FROM e, {_table(hashes.codebook(12, DIM, 42))} GROUP BY id),
s AS (SELECT id, i, list_dot_product(p, c) AS d FROM p, {_table(hashes.codebook(32, 12, 43))}) SELECT id, CAST(arg_max(i, d) AS SMALLINT) AS hash FROM s GROUP BY id""")
def rpvq(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", hashes.on_column(hashes.rpvq, F.col("embedding"), 12, 32, 42).alias("hash"))


_DIFF = f"d AS (SELECT id, list_transform(range(1, {DIM + 1}), lambda j: CAST(CAST(v[j] AS FLOAT) - CAST(q[j] AS FLOAT) AS DOUBLE)) AS v FROM e, (SELECT {_list(QUERY)} AS q))"


@query(f"{E}, {_DIFF}, s AS (SELECT id, i, list_dot_product(v, c) AS d FROM d, {_table(hashes.codebook(32, DIM, 42))}) SELECT id, CAST(arg_max(i, d) AS SMALLINT) AS hash FROM s GROUP BY id")
def cvq(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", hashes.on_column(hashes.cvq, F.col("embedding"), QUERY, 32, 42).alias("hash"))


@query(f"{E}, {_DIFF}, s AS (SELECT id, i, list_dot_product(v, c) AS d FROM d, {_table(hashes.codebook(32, DIM, 42))}) SELECT id, array_to_string(list(i ORDER BY d DESC, i)[1:5], ',') AS probes FROM s GROUP BY id")
def cvq_probe(spark, sf_dir):
    p = hashes.on_column(hashes.cvq_probe, F.col("embedding"), QUERY, 32, 5, 42, many=True)
    return vectors(spark, sf_dir).select("id", F.array_join(p.cast("array<string>"), ",").alias("probes"))


def _near(v: str, c: str) -> str:
    return f"round(list_dot_product({v}, {v}) - 2 * list_dot_product({v}, {c}) + list_dot_product({c}, {c}), 12)"


@query(f"{E}, s AS (SELECT id, i, {_near('v', 'c')} AS d FROM e, {_table(fixed()[0].centroids)}) SELECT id, CAST(arg_min(i, d) AS SMALLINT) AS partition_id FROM s GROUP BY id")
def ivf_assign(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", quantize.assign(spark, F.col("embedding"), fixed()[0]).alias("partition_id"))


@query(f"SELECT rank, i AS partition_id FROM (SELECT i, row_number() OVER (ORDER BY {_near('q', 'c')}, i) AS rank FROM (SELECT {_list(QUERY)} AS q), {_table(fixed()[0].centroids)}) WHERE rank <= 5")
def ivf_probe(spark, sf_dir):
    return spark.createDataFrame([(r + 1, int(p)) for r, p in enumerate(fixed()[0].probe(QUERY[None], 5)[0])], "rank long, partition_id int")


_BOOKS = "(VALUES " + ", ".join(f"({m}, {i}, {_list(v)})" for m, b in enumerate(fixed()[1].books) for i, v in enumerate(b)) + ") AS c(m, i, c)"
_PARTS = f"n AS (SELECT id, sqrt(list_dot_product(v, v)) AS norm, v FROM e), p AS (SELECT id, unnest(range(0, {M})) AS m, v, norm FROM n), u AS (SELECT id, m, list_transform(range(1, {DIM // M + 1}), lambda j: CAST(CAST(v[m * {DIM // M} + j] AS FLOAT) * CAST(1 / norm AS FLOAT) AS DOUBLE)) AS x FROM p)"
_CODED = f"{E}, {_PARTS}, s AS (SELECT id, u.m, arg_min(i, {_near('x', 'c')}) AS code, arg_min(c, {_near('x', 'c')}) AS c FROM u JOIN {_BOOKS} ON u.m = c.m GROUP BY id, u.m)"


@query(f"{_CODED} SELECT id, string_agg(lower(format('{{:02x}}', code)), '' ORDER BY m) AS code FROM s GROUP BY id")
def pq_encode(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.lower(F.hex(quantize.encode(spark, F.col("embedding"), fixed()[1]))).alias("code"))


@query(f"{_CODED}, q AS (SELECT {_list(quantize.normalised(QUERY[None])[0])} AS q) SELECT id, round(sum(list_sum(list_transform(range(1, {DIM // M + 1}), lambda j: (q[m * {DIM // M} + j] - c[j]) * (q[m * {DIM // M} + j] - c[j])))), 4) AS distance FROM s, q GROUP BY id")
def pq_adc(spark, sf_dir):
    codes = fixed()[1]
    code = quantize.encode(spark, F.col("embedding"), codes)
    return vectors(spark, sf_dir).select("id", code.alias("code")).select("id", F.round(quantize.adc_distance(codes.table(QUERY), F.col("code")), 4).alias("distance"))


def _built(spark, sf_dir, residual: bool = False):
    v = vectors(spark, sf_dir)
    lists = quantize.ivf_train(v, "embedding", LISTS)
    codes = quantize.pq_train(v, "embedding", M, lists=lists if residual else None)
    return ann.build(v.select("id", "embedding"), scratch(spark), lists, codes, files=LISTS), lists, codes


@query(KNN_SQL)
def ann_search_all(spark, sf_dir):
    t, lists, codes = _built(spark, sf_dir)
    return _rounded(ann.search(t, QUERY, lists, codes, LISTS, K, 1 << 30))


def _fixed(spark, sf_dir, residual: bool = False):
    """A table by the models that don't depend on the data."""
    lists, codes = fixed()
    codes = fixed_residual() if residual else codes
    return ann.build(vectors(spark, sf_dir).select("id", "embedding"), scratch(spark), lists, codes, files=LISTS), lists, codes


@cache
def fixed_residual() -> Codes:
    return quantize.train_codes(hashes.codebook(300, DIM, 7), M, 3, fixed()[0])


_PLACED = f"w AS (SELECT id, arg_min(i, {_near('v', 'c')}) AS p, arg_min(c, {_near('v', 'c')}) AS centre FROM e, {_table(fixed()[0].centroids)} GROUP BY id)"


def _probed(q: str, n: int) -> str:
    """(query_id, p) of the n nearest lists of each q (query_id, q)."""
    return f"(SELECT query_id, i AS p FROM (SELECT query_id, i, row_number() OVER (PARTITION BY query_id ORDER BY {_near('q', 'c')}, i) AS r FROM {q}, {_table(fixed()[0].centroids)}) WHERE r <= {n})"


def _adc(parts: str, q: str = "q") -> str:
    """Squared distance of a query's part m to a code's centroid."""
    return f"sum(list_sum(list_transform(range(1, {DIM // M + 1}), lambda j: ({parts} - s.c[j]) * ({parts} - s.c[j]))))"


_ONE = f"o AS (SELECT 0 AS query_id, {_list(QUERY)} AS q, {_list(quantize.normalised(QUERY[None])[0])} AS u)"
_PLAIN = f"{_CODED}, {_PLACED}, {_ONE}, a AS (SELECT query_id, s.id, any_value(w.p) AS p, {_adc(f'u[s.m * {DIM // M} + j]')} AS d FROM s JOIN w ON s.id = w.id, o GROUP BY query_id, s.id)"
_CANDIDATES = "b AS (SELECT a.query_id, id, d, row_number() OVER (PARTITION BY a.query_id ORDER BY d, id) AS r FROM a JOIN {probed} t ON a.query_id = t.query_id AND a.p = t.p)"
_RERANKED = f"SELECT e.id, round({_COS.format(a='v', b='q')}, 9) AS distance FROM b JOIN e ON b.id = e.id, o WHERE r <= 96 ORDER BY {_COS.format(a='v', b='q')}, e.id LIMIT {K}"


@query(f"{_PLAIN}, {_CANDIDATES.format(probed=_probed('o', 5))} {_RERANKED}")
def ann_search(spark, sf_dir):
    t, lists, codes = _fixed(spark, sf_dir)
    return _rounded(ann.search(t, QUERY, lists, codes, 5, K, 96))


_RESIDUAL_BOOKS = "(VALUES " + ", ".join(f"({m}, {i}, {_list(v)})" for m, b in enumerate(fixed_residual().books) for i, v in enumerate(b)) + ") AS c(m, i, c)"
_RESIDUAL = f"""{E}, {_PLACED}, {_ONE}, u AS (SELECT id, m, list_transform(range(1, {DIM // M + 1}), lambda j: CAST(CAST(v[m * {DIM // M} + j] AS FLOAT) - CAST(centre[m * {DIM // M} + j] AS FLOAT) AS DOUBLE)) AS x FROM (SELECT e.id, v, centre, unnest(range(0, {M})) AS m FROM e JOIN w ON e.id = w.id)),
s AS (SELECT id, u.m, arg_min(c, {_near('x', 'c')}) AS c FROM u JOIN {_RESIDUAL_BOOKS} ON u.m = c.m GROUP BY id, u.m),
a AS (SELECT query_id, s.id, any_value(w.p) AS p, {_adc(f'CAST(CAST(q[s.m * {DIM // M} + j] AS FLOAT) - CAST(w.centre[s.m * {DIM // M} + j] AS FLOAT) AS DOUBLE)')} AS d FROM s JOIN w ON s.id = w.id, o GROUP BY query_id, s.id)"""


@query(f"{_RESIDUAL}, {_CANDIDATES.format(probed=_probed('o', 5))} {_RERANKED.replace('SELECT e.id', 'SELECT CAST(e.id AS VARCHAR) AS id')}")
def ann_scan_residual(spark, sf_dir):
    t, _, codes = _fixed(spark, sf_dir, residual=True)
    return _rounded(ann.scan(t, QUERY, codes, nprobe=5, lim=K, rerank=96))


_SKETCHED = f"""h AS (SELECT id, list_transform(v[1:32], lambda x: {_half('x')}) AS h FROM e),
g AS (SELECT b.query_id, b.id, row_number() OVER (ORDER BY {_COS.format(a='h', b='q[1:32]')}, b.id) AS r FROM b JOIN h ON b.id = h.id, o WHERE r <= 96)"""


@query(f"{_PLAIN}, {_CANDIDATES.format(probed=_probed('o', 5))}, {_SKETCHED} {_RERANKED.replace('SELECT e.id', 'SELECT CAST(e.id AS VARCHAR) AS id').replace('FROM b JOIN e ON b.id', 'FROM g b JOIN e ON b.id').replace('r <= 96', 'r <= 48')}")
def ann_scan_sketch(spark, sf_dir):
    t, lists, codes = _fixed(spark, sf_dir)
    return _rounded(ann.scan(t, QUERY, codes, lists, 5, K, 96, ann.sketches(t, 32), 48))


_EVERY = f"o AS (SELECT e.id AS query_id, e.v AS q, list_transform(e.v, lambda x: CAST(CAST(x AS FLOAT) * CAST(1 / sqrt(list_dot_product(e.v, e.v)) AS FLOAT) AS DOUBLE)) AS u FROM e)"
_MANY_FOUND = f"""{_PLAIN.replace(_ONE, _EVERY)}, {_CANDIDATES.format(probed=_probed('o', 4))},
f AS (SELECT b.query_id, b.id, {_COS.format(a='x.v', b='y.v')} AS d FROM b JOIN e x ON b.id = x.id JOIN e y ON b.query_id = y.id WHERE r <= 50),
found AS (SELECT query_id, id, round(d, 9) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM f)"""


@query(f"{_MANY_FOUND} SELECT query_id, rank, id, distance FROM found WHERE rank <= {K}")
def ann_search_many(spark, sf_dir):
    t, lists, codes = _fixed(spark, sf_dir)
    return _rounded(ann.search_many(t, _many(spark, sf_dir), lists, codes, 4, K, 50))


_TRUTH = f"truth AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM (SELECT x.id AS query_id, y.id, {_COS.format(a='x.v', b='y.v')} AS d FROM e x CROSS JOIN e y))"


@query(f"""{_MANY_FOUND}, {_TRUTH}, both_ AS (SELECT t.query_id, count(f.id) / count(*) AS r, max(CASE WHEN t.rank = 1 AND f.rank = 1 THEN 1 ELSE 0 END) AS first
FROM truth t LEFT JOIN (SELECT * FROM found WHERE rank <= {K}) f ON t.query_id = f.query_id AND t.id = f.id WHERE t.rank <= {K} GROUP BY t.query_id) SELECT round(avg(r), 9) AS recall, round(avg(first), 9) AS first FROM both_""")
def recall_at_k(spark, sf_dir):
    """Of an inverted-list search that probes a quarter of the lists and reranks 50 rows."""
    t, lists, codes = _fixed(spark, sf_dir)
    q = _many(spark, sf_dir)
    r = ann.recall(ann.search_many(t, q, lists, codes, 4, K, 50), ann.exact_many(vectors(spark, sf_dir), q, K, digits=9), K)
    return r.select(F.round("recall", 9).alias("recall"), F.round("first", 9).alias("first"))


def _sketched(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.select(quantize.assign(spark, F.col("embedding"), quantize.ivf_train(v, "embedding", 4)).alias("partition_id"), "id", head(F.col("embedding"), DIM).alias("sketch"))


@query(MANY_SQL.replace("query_id, rank, id, round", "query_id, rank, CAST(id AS VARCHAR) AS id, round").replace("round(d, 9), id", "round(d, 12), CAST(id AS VARCHAR)"))
def graph_scan_all(spark, sf_dir):
    nodes, entries = graph.build_flat(_sketched(spark, sf_dir))
    return _rounded(graph.graph_scan(nodes, _many(spark, sf_dir), entries, vectors(spark, sf_dir), ef=1 << 20, lim=K))


@query(MANY_SQL.replace("query_id, rank, id, round", "query_id, rank, CAST(id AS VARCHAR) AS id, round").replace("round(d, 9), id", "round(d, 12), CAST(id AS VARCHAR)"))
def hnsw_scan_all(spark, sf_dir):
    meta, nodes = graph.build_hierarchy(_sketched(spark, sf_dir), ef=64)
    return _rounded(graph.hnsw_scan(meta, nodes, _many(spark, sf_dir), vectors(spark, sf_dir), ef=1 << 20, lim=K))


@query()
def hnsw_scan(spark, sf_dir):
    meta, nodes = graph.build_hierarchy(_sketched(spark, sf_dir), ef=64, shards=2)
    return _rounded(graph.hnsw_scan(meta, nodes, _many(spark, sf_dir), vectors(spark, sf_dir), ef=96, lim=K, rerank=48))


@query(f"""{E}, {_PLACED}, o AS (SELECT e.id AS query_id, e.v AS q FROM e), {_TRUTH},
l AS (SELECT query_id, i AS p, row_number() OVER (PARTITION BY query_id ORDER BY {_near('q', 'c')}, i) AS r FROM o, {_table(fixed()[0].centroids)}),
n AS (SELECT CAST(l.r AS INTEGER) AS r, count(*) AS n FROM truth t JOIN w ON t.id = w.id JOIN l ON t.query_id = l.query_id AND w.p = l.p WHERE t.rank <= {K} GROUP BY 1)
SELECT r, round(sum(n) OVER (ORDER BY r) / (SELECT count(*) FROM truth WHERE rank <= {K}), 9) AS ceiling FROM n""")
def route_ceiling(spark, sf_dir):
    v = vectors(spark, sf_dir)
    lists = fixed()[0]
    placed = v.select("id", quantize.assign(spark, F.col("embedding"), lists).alias("partition_id"))
    near = F.arrow_udf(lambda c: pa.array(lists.probe(matrix(c), LISTS).astype(np.int16).tolist(), pa.list_(pa.int16())), ArrayType(ShortType()))
    probes = v.select(F.col("id").alias("query_id"), F.posexplode(near("embedding")).alias("r", "partition_id")).withColumn("r", F.col("r") + 1)
    return graph.route_ceiling(ann.exact_many(v, _many(spark, sf_dir), K, digits=9), placed, probes).withColumn("ceiling", F.round("ceiling", 9))


@query(f"{_PLAIN}, {_CANDIDATES.format(probed=_probed('o', 5))} {_RERANKED}")
def ann_search_sql(spark, sf_dir):
    """The search as a table function of SQL."""
    t, lists, codes = _fixed(spark, sf_dir)
    register.register_search(spark, t, codes, lists)
    return _rounded(spark.sql(f"SELECT * FROM ann_search(vector_in('[{','.join(repr(float(x)) for x in QUERY)}]'), 5, {K}, 96)"))


@query(KNN_SQL.replace("SELECT id, round", "SELECT CAST(id AS VARCHAR) AS id, round"))
def hnsw_scan_sql(spark, sf_dir):
    """The hierarchy's search as a table function of SQL, wide enough to meet every node."""
    meta, nodes = graph.build_hierarchy(_sketched(spark, sf_dir), ef=64)
    register.register_graph(spark, nodes, meta=meta, rows=vectors(spark, sf_dir).select("id", "embedding"))
    return _rounded(spark.sql(f"SELECT * FROM hnsw_scan(vector_in('[{','.join(repr(float(x)) for x in QUERY)}]'), 1048576, {K})"))


@query(KNN_SQL.replace("SELECT id, round", "SELECT CAST(id AS VARCHAR) AS id, round"))
def graph_scan_sql(spark, sf_dir):
    nodes, entries = graph.build_flat(_sketched(spark, sf_dir))
    register.register_graph(spark, nodes, entries, rows=vectors(spark, sf_dir).select("id", "embedding"))
    return _rounded(spark.sql(f"SELECT * FROM graph_scan(vector_in('[{','.join(repr(float(x)) for x in QUERY)}]'), 1048576, {K})"))


@query(f"{E} SELECT id, CAST(len(v) AS INTEGER) AS dim, round({_COS.format(a='v', b='q')}, 6) AS distance FROM e, (SELECT {_list(QUERY)} AS q)")
def sql_functions(spark, sf_dir):
    register.register(spark)
    vectors(spark, sf_dir).createOrReplaceTempView("keystrata_vectors")
    q = "[" + ",".join(repr(float(x)) for x in QUERY) + "]"
    return spark.sql(f"SELECT id, size(vector_in(vector_out(embedding))) AS dim, round(cosine_distance(vector_recv(vector_send(embedding)), vector_in('{q}')), 6) AS distance FROM keystrata_vectors")


@query("SELECT CAST(2000 AS BIGINT) AS n, 1.0 AS length")
def synthetic_vectors(spark, sf_dir):
    v = synthetic.clustered_vectors(spark, 2000, 32)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return v.agg(F.count("*").alias("n"), F.round(F.avg(F.sqrt(norm)), 5).alias("length"))
