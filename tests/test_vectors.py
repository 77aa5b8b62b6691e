import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.functions import hashes, locator, register, vectors
from keystrata.operators import ann, graph, quantize


def test_text_and_bytes():
    assert vectors.text(vectors.parse(" [1.5 2,3,] ")) == "[1.5,2,3]"
    assert vectors.text(vectors.parse_half("[0.1,1e9]")) == "[0.1,Infinity]"
    for bad in ("1,2", "[1,2", "[1]x", "[]", "[a]"):
        with pytest.raises(ValueError):
            vectors.parse(bad)
    with pytest.raises(ValueError):
        vectors.parse("[1,2]", dim=3)
    v = np.array([1.5, -2, 1e-7], np.float32)
    assert (vectors.from_bytes(vectors.to_bytes(v)) == v).all()
    assert (vectors.parse(vectors.text(v)) == v).all()
    assert vectors.to_bytes(v.astype(np.float16))[:4] == b"\0\3\0\0"


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [-3.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    d = [r[0] for r in df.select(vectors.cosine_distance("a", "b")).collect()]
    assert d[:3] == [0, 1, 2] and np.isnan(d[3]) and d[4] is None
    h = [r[0] for r in spark.createDataFrame([([0.1, 70000.0],), (None,), ([2.0],)], "v array<float>").select(vectors.half("v")).collect()]
    assert h[0] == [np.float32(np.float16(0.1)), np.inf] and h[1:] == [None, [2.0]]


def test_locators(spark):
    df = spark.createDataFrame([(-1, 5), (2**63 - 1, -(2**63)), (0, 0)], "a long, b long").withColumn("l", locator.pack(F.col("a"), F.col("b")))
    got = df.select(locator.major(F.col("l")), locator.minor(F.col("l")), locator.to_hex(F.col("l"))).collect()
    assert [tuple(r)[:2] for r in got] == [(-1, 5), (2**63 - 1, -(2**63)), (0, 0)] and got[0][2] == "FFFFFFFFFFFFFFFF:0000000000000005"
    with pytest.raises(Exception, match="(?i)overflow"):
        df.select(locator.advance_major(F.col("l"), F.lit(1))).collect()
    assert spark.range(1).select(locator.compare(locator.pack(F.lit(-1), F.lit(0)), locator.pack_minor(F.lit(3)))).first()[0] == -1


def test_generator_and_hashes():
    r = hashes.Random(0)
    assert [hashes.Random(0).s[0]] == [0xE220A8397B1DCDAF] and 0 <= r.uniform() < 1  # splitmix64's first value
    v = hashes.codebook(50, 8, 3)
    assert np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-6)
    assert (hashes.vq(hashes.codebook(20, 8, 42), 20, 42) == np.arange(20)).all()
    assert (hashes.cvq_probe(v, np.zeros(8), 16, 1)[:, 0] == hashes.vq(v, 16)).all()
    for call in (lambda: hashes.vq(v, 1), lambda: hashes.rvq(v, 300, 300), lambda: hashes.cvq(v, np.zeros(3), 4), lambda: hashes.cvq_probe(v, np.zeros(8), 4, 5)):
        with pytest.raises(ValueError):
            call()


def test_models(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 16)).astype(np.float32)
    lists = quantize.train_lists(x, 8)
    plain, residual = quantize.train_codes(x, 4), quantize.train_codes(x, 4, lists=lists)
    of = lists.assign(x)
    assert (lists.probe(x, 3)[:, 0] == of).all()
    code = plain.encode(x)
    u = vectors.normalised(x)
    back = np.stack([plain.books[i][code[:, i]] for i in range(4)], 1).reshape(600, 16)
    assert np.allclose(quantize.adc(plain.table(x[0]), code), ((u[0] - back) ** 2).sum(1), atol=1e-4)
    assert residual.encode(x, of).shape == (600, 4)
    quantize.save(spark, f"{tmp_path}/m", plain, lists)
    assert (quantize.load_codes(spark, f"{tmp_path}/m").books == plain.books).all() and (quantize.load_lists(spark, f"{tmp_path}/m").centroids == lists.centroids).all()
    for call in (lambda: quantize.train_codes(x, 5), lambda: quantize.train_lists(x, 0), lambda: residual.encode(x, of + 100), lambda: lists.probe(x, 0), lambda: quantize.adc(plain.table(x[0]), code[:, :2])):
        with pytest.raises(ValueError):
            call()


def fixture(spark):
    v = [(f"v{i:03d}", [float(i % m) for m in (10, 7, 11, 13, 3, 5, 9, 4)]) for i in range(1, 301)]
    return v, spark.createDataFrame(v, "id string, embedding array<float>")


def test_searches_and_recall(spark, tmp_path):
    v, df = fixture(spark)
    q = [5, 3, 6, 7, 1, 2, 4, 2]
    lists = quantize.ivf_train(df, "embedding", 2)
    codes = quantize.pq_train(df, "embedding", 2, most=300)
    t = ann.build(df, f"{tmp_path}/a", lists, codes, files=2)
    want = [r["id"] for r in ann.exact(df, q, 5).collect()]
    assert [r["id"] for r in ann.search(t, q, lists, codes, 2, 5, 400).collect()] == want
    assert [r["id"] for r in ann.scan(t, q, codes, lists, 2, 5, 300, ann.sketches(t, 8), 300).collect()] == want
    assert ann.scan(t, v[6][1], codes, lists, 1, 5, 2).count() == 5
    assert ann.search(t, v[6][1], lists, codes, 2, 1, 300).first()["distance"] < 1e-6
    with pytest.raises(ValueError):
        ann.search(t, q, lists, codes, 2, 0)
    with pytest.raises(ValueError):
        ann.scan(t, q[:3], codes, lists)
    queries = df.filter("id < 'v040'").select(F.substring("id", 2, 3).cast("long").alias("query_id"), F.col("embedding").alias("query"))
    truth = ann.exact_many(df, queries, 5)
    got = ann.recall(ann.search_many(t, queries, lists, codes, 2, 5, 100), truth, 5).first()
    assert got["recall"] >= 0.9


def test_graphs(spark):
    v, df = fixture(spark)
    queries = df.filter("id < 'v030'").select(F.substring("id", 2, 3).cast("long").alias("query_id"), F.col("embedding").alias("query"))
    truth = ann.exact_many(df, queries, 5)
    placed = df.withColumn("partition_id", F.pmod(F.xxhash64("id"), F.lit(3)).cast("int")).withColumnRenamed("embedding", "sketch")
    nodes, entries = graph.build_flat(placed)
    assert sorted(r[0] for r in nodes.select("nid").collect()) == list(range(300)) and nodes.filter(F.size("neighbors") > 32).count() == 0
    flat = graph.graph_scan(nodes, queries, entries, df, ef=64, lim=5)
    meta, levels = graph.build_hierarchy(placed, m=8, ef=64)
    high = graph.hnsw_scan(meta, levels, queries, df, ef=64, lim=5, rerank=20)
    for found in (flat, high):
        assert ann.recall(found, truth, 5).first()["recall"] >= 0.9
    r1 = levels.filter("level = 0").select("nid", F.col("sketch").cast("array<float>").alias("rerank_vec"))
    assert graph.hnsw_scan(meta, levels, queries, df, r1, ef=64, lim=5, rerank1=10).count() == 5 * queries.count()
    with pytest.raises(ValueError):
        graph.graph_scan(nodes, queries, entries.limit(0))
    with pytest.raises(ValueError):
        graph.hnsw_scan(meta.limit(0), levels, queries)


def test_sql_functions(spark):
    register.register(spark)
    r = spark.sql("SELECT vector_out(vector_in('[1 2.5]')), half_out(half_in('[0.1]')), cosine_distance(vector_in('[1,0]'), vector_in('[0,1]')), locator_to_hex(locator_pack(1, 2)), vector_vq(vector_in('[1,2,3]'), 8, 42), vector_simhash(NULL, 42), vector_out(vector_recv(vector_send(vector_in('[3]'))))").first()
    assert tuple(r) == ("[1,2.5]", "[0.1]", 1.0, "0000000000000001:0000000000000002", int(hashes.vq(np.array([[1, 2, 3]]), 8)[0]), None, "[3]")


def test_locator_functions_in_sql(spark):
    register.register(spark)
    a, b = "locator_pack(-1, 5)", "locator_pack_minor(7)"
    names = ("less", "less_or_equal", "equal", "greater_or_equal", "greater", "unequal")
    sql = ", ".join(f"locator_{n}({x}, {y})" for n in names for x, y in ((a, b), (b, a), (a, a)))
    cols = [f(x, y) for f in (locator.less, locator.less_or_equal, locator.equal, locator.greater_or_equal, locator.greater, locator.unequal) for x, y in ((1, 2), (2, 1), (1, 1))
            for x, y in [[{1: locator.pack(F.lit(-1), F.lit(5)), 2: locator.pack_minor(F.lit(7))}[i] for i in (x, y)]]]
    want = (True, False, False, True, False, True, False, False, True, False, True, True, False, True, False, True, True, False)
    assert tuple(spark.sql(f"SELECT {sql}").first()) == want == tuple(spark.range(1).select(*cols).first())
    r = spark.sql(f"SELECT locator_major({a}), locator_minor({a}), locator_compare({a}, {b}), locator_compare(NULL, {b}), locator_to_hex(locator_advance_major({b}, -3)), locator_to_hex(locator_next_minor({a}, 2))").first()
    assert tuple(r) == (-1, 5, -1, None, "FFFFFFFFFFFFFFFD:0000000000000007", "FFFFFFFFFFFFFFFF:0000000000000007")
    for bad in ("locator_major(unhex('00'))", "locator_advance_major(locator_pack(9223372036854775807, 0), 1)"):
        with pytest.raises(Exception, match="(?i)16 bytes|overflow"):
            spark.sql(f"SELECT {bad}").collect()


def test_model_functions_in_sql(spark):
    v, df = fixture(spark)
    df.union(spark.createDataFrame([("none", None)], df.schema)).createOrReplaceTempView("fixture_rows")
    lists, codes = quantize.ivf_train(df, "embedding", 4), quantize.pq_train(df, "embedding", 2, most=300)
    residual = quantize.pq_train(df, "embedding", 2, most=300, lists=lists)
    x = np.array([r[1] for r in v], np.float32)
    register.register(spark)
    register.register_models(spark, codes, lists)
    got = {r["id"]: r for r in spark.sql("SELECT id, pq_encode(embedding) AS c, ivf_assign(embedding) AS p, ivf_probe(embedding, 3) AS ps, pq_distance(embedding, pq_encode(embedding)) AS d, pq_adc_lookup(pq_distance_table(embedding), pq_encode(embedding)) AS l FROM fixture_rows").collect()}
    code, of = codes.encode(x), lists.assign(x)
    for i, (name, q) in enumerate(v):
        r = got[name]
        assert bytes(r["c"]) == code[i].tobytes() and r["p"] == of[i] and r["ps"] == lists.probe(x[i : i + 1], 3)[0].tolist()
        assert r["d"] == r["l"] == quantize.adc(codes.table(x[i]), code[i : i + 1])[0]
    assert list(got["none"])[1:] == [None] * 5
    register.register_models(spark, residual)
    r = spark.sql("SELECT pq_encode_residual(embedding, 1) AS c, pq_distance_residual(embedding, 1, pq_encode_residual(embedding, 1)) AS d, pq_adc_lookup(pq_distance_table_residual(embedding, 1), pq_encode_residual(embedding, 1)) AS l FROM fixture_rows WHERE id = 'v007'").first()
    assert bytes(r["c"]) == residual.encode(x[6:7], np.array([1]))[0].tobytes() and r["d"] == r["l"]


def test_searches_in_sql(spark, tmp_path):
    v, df = fixture(spark)
    q = [5, 3, 6, 7, 1, 2, 4, 2]
    text = "array(" + ", ".join(f"{x}f" for x in q) + ")"
    lists, codes = quantize.ivf_train(df, "embedding", 4), quantize.pq_train(df, "embedding", 2, most=300)
    t = ann.build(df, f"{tmp_path}/a", lists, codes, files=2)
    near = lambda rows: [(r["id"], round(r["distance"], 5)) for r in rows]
    register.register_search(spark, t, codes, lists)
    for rerank in (0, 40):
        assert near(spark.sql(f"SELECT * FROM ann_search({text}, 2, 5, {rerank}) ORDER BY distance, id").collect()) == near(ann.search(t, q, lists, codes, 2, 5, rerank).collect())
        assert near(spark.sql(f"SELECT * FROM ann_scan({text}, 2, 5, {rerank}) ORDER BY distance, id").collect()) == near(ann.scan(t, q, codes, lists, 2, 5, rerank).collect())
    sketch = ann.sketches(t, 4)
    register.register_search(spark, t, codes, lists, sketch)
    assert near(spark.sql(f"SELECT * FROM ann_scan({text}, 3, 5, 60, 20) ORDER BY distance, id").collect()) == near(ann.scan(t, q, codes, lists, 3, 5, 60, sketch, 20).collect())
    with pytest.raises(Exception, match="no sketch"):
        ann.scan(t, q, codes, lists, 3, 5, 60, sketch.limit(10), 20).collect()
    residual = quantize.pq_train(df, "embedding", 2, most=300, lists=lists)
    u = ann.build(df, f"{tmp_path}/b", lists, residual, files=2)
    register.register_search(spark, u, residual)
    assert near(spark.sql(f"SELECT * FROM ann_scan({text}, 2, 5, 0) ORDER BY distance, id").collect()) == near(ann.scan(u, q, residual, nprobe=2, lim=5).collect())
    df.filter("id IN ('v001', 'v002')").createOrReplaceTempView("fixture_queries")
    assert spark.sql("SELECT f.id, s.distance FROM fixture_queries f, LATERAL ann_scan(f.embedding, 4, 3, 50) s").count() == 6
    spark.createDataFrame([(1, [float(x) for x in q])], "query_id long, query array<float>").createOrReplaceTempView("fixture_asked")
    register.search_view(spark, "fixture_found", t, "fixture_asked", lists, codes, 4, 5, 300)
    assert [r["id"] for r in spark.table("fixture_found").orderBy("rank").collect()] == [r["id"] for r in ann.exact(df, q, 5).collect()]


def test_graphs_in_sql(spark, tmp_path):
    v, df = fixture(spark)
    q = v[6][1]
    text = "array(" + ", ".join(f"{x}f" for x in q) + ")"
    placed = df.withColumn("partition_id", F.lit(0)).withColumnRenamed("embedding", "sketch")
    asked = spark.createDataFrame([(1, q)], "query_id long, query array<float>")
    nodes, entries = graph.build_flat(placed)
    register.register_graph(spark, nodes, entries, rows=df)
    near = lambda rows: [(r["id"], round(r["distance"], 9)) for r in rows]
    assert near(spark.sql(f"SELECT * FROM graph_scan({text}, 64, 5) ORDER BY distance, id").collect()) == near(graph.graph_scan(nodes, asked, entries, df, 64, 5).orderBy("rank").collect())
    meta, levels = graph.build_hierarchy(placed, m=8, ef=64, shards=2)
    graph.save_levels(meta, levels, f"{tmp_path}/g")
    meta, levels = graph.open_levels(spark, f"{tmp_path}/g")
    register.register_graph(spark, levels, meta=meta, rows=df)
    for most in ("0", "4"):
        spark.conf.set("spark.keystrata.levelCache", most)
        for _ in range(2):
            assert near(spark.sql(f"SELECT * FROM hnsw_scan({text}, 64, 5) ORDER BY distance, id").collect()) == near(graph.hnsw_scan(meta, levels, asked, df, ef=64, lim=5).orderBy("rank").collect())
    spark.conf.unset("spark.keystrata.levelCache")


def test_kmeans_as_a_plain_one():
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 6)).astype(np.float32)
    c = [list(map(float, v)) for v in x[:7]]
    for _ in range(4):
        groups = [[] for _ in c]
        for v in x.astype(float):
            groups[min(range(7), key=lambda i: (round(sum((a - b) ** 2 for a, b in zip(v, c[i])), 12), i))].append(v)
        c = [[float(np.float32(sum(col) / len(g))) for col in zip(*g)] if g else old for g, old in zip(groups, c)]
    assert np.allclose(quantize.kmeans(x, 7, 4), c, atol=1e-6)
    few = quantize.kmeans(x[:3], 5, 2)
    assert few.shape == (5, 6) and np.isfinite(few).all()


def test_training_together_and_samples(spark):
    v, df = fixture(spark)
    codes = quantize.ann_train(df, "embedding", 4, 2, most=300, residual=True)
    assert codes.lists.centroids.shape == (4, 8) and codes.books.shape == (2, 256, 4)
    assert quantize.ann_train(df, "embedding", 4, 2, most=300).lists is None
    one, two = (quantize.sample(df.repartition(n), "embedding", 50, 3) for n in (1, 7))
    assert (one == two).all() and len(one) == 50
    q = ann.sample_queries(df, 20)
    assert sorted(map(tuple, q.select("query_id").collect())) == sorted(map(tuple, ann.sample_queries(df.repartition(5), 20).select("query_id").collect())) and q.count() == 20


def test_beams_find_what_all_distances_do():
    r = np.random.default_rng(6)
    u = graph._unit(r.normal(size=(400, 8)))
    entry, levels = graph.insert_all(u, m=8, ef=60)
    assert sorted(levels[0]) == list(range(400)) and all(len(n) <= (16 if k == 0 else 8) for k, level in enumerate(levels) for n in level.values())
    level = graph.Level.of(np.arange(400), u, [levels[0][i] for i in range(400)])
    hits = looked = 0
    for q in graph._unit(r.normal(size=(30, 8))):
        want = np.argsort(1 - u @ q, kind="stable")[:10]
        got = [i for _, i in graph.beam(level, q, np.array([entry]), 60)]
        assert got[:10] == sorted(got[:10], key=lambda i: 1 - u[i] @ q)
        hits += len(set(want.tolist()) & set(got[:10]))
        short = graph.beam(level, q, np.array([entry]), 60, patience=2)
        looked += len(short)
        assert [i for _, i in graph.beam(level, q, np.array([entry]), 400)][:10] == want.tolist()
    assert hits >= 0.9 * 300 and looked > 0


def test_missing_rows_come_last(spark):
    v, df = fixture(spark)
    placed = df.withColumnRenamed("embedding", "sketch")
    meta, nodes = graph.build_hierarchy(placed, m=8, ef=64)
    asked = spark.createDataFrame([(1, v[6][1])], "query_id long, query array<float>")
    out = graph.hnsw_scan(meta, nodes, asked, df.filter("id <> 'v007'"), ef=300, lim=300).orderBy("rank").collect()
    assert out[-1]["id"] == "" and np.isinf(out[-1]["distance"]) and len(out) == 300


def test_as_of_joins_over_spans(spark):
    import datetime as dt

    from keystrata.operators import joins

    r = np.random.default_rng(3)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s))
    left = [(i, int(r.integers(3)) if i % 9 else None, at(r.integers(5000)) if i % 11 else None) for i in range(200)]
    right = [(int(r.integers(3)), at(r.integers(0, 5000, 1)[0] // 7 * 7), int(r.integers(100))) for _ in range(80)] + [(None, at(3), 1), (1, None, 2)]
    a = spark.createDataFrame(left, "n int, k int, t timestamp")
    b = spark.createDataFrame(right, "k int, seen timestamp, x int")
    for span in (50, 86_400):
        for row in joins.as_of(a, b, "k", "t", "seen", span).collect():
            _, k, t = left[row["n"]]
            some = [y for y in right if None not in (k, t, y[1]) and y[0] == k and y[1] <= t]
            want = max(some, key=lambda y: (y[1], y[2])) if some else (None, None, None)
            assert (row["seen"], row["x"]) == want[1:]
