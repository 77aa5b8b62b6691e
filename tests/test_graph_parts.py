import numpy as np
from pyspark.sql import functions as F

from keystrata.functions import register
from keystrata.operators import ann, graph


def sketched(spark):
    v = np.random.default_rng(4).normal(size=(600, 8)).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v)], "id string, embedding array<float>")
    return df, df.select((F.substring("id", 2, 1).cast("int") % 2).alias("partition_id"), "id", F.col("embedding").alias("sketch"))


def asked(df):
    return df.filter("id < 'v040'").select(F.substring("id", 2, 3).cast("long").alias("query_id"), F.col("embedding").alias("query"))


def same(found, truth):
    rows = lambda t: sorted((x["query_id"], x["rank"], x["id"], round(x["distance"], 9)) for x in t.collect())
    assert rows(found) == rows(truth)


def unwalked(monkeypatch):
    for name in ("beam", "held_walk", "held_hierarchy"):
        monkeypatch.setattr(graph, name, None)


def test_wide_flat_searches_are_exact_without_a_walk(spark, monkeypatch):
    df, placed = sketched(spark)
    nodes, entries = graph.build_flat(placed)
    unwalked(monkeypatch)
    same(graph.graph_scan(nodes, asked(df), entries, df, ef=600, lim=5), ann.exact_many(df, asked(df), 5))


def test_wide_hierarchical_searches_are_exact_without_a_walk(spark, monkeypatch):
    df, placed = sketched(spark)
    meta, nodes = graph.build_hierarchy(placed, m=8, ef=40, shards=3)
    unwalked(monkeypatch)
    same(graph.hnsw_scan(meta, nodes, asked(df), df, ef=600, lim=5), ann.exact_many(df, asked(df), 5))


def test_long_partitions_are_cut(spark, monkeypatch):
    df, placed = sketched(spark)
    monkeypatch.setattr(graph, "SHARD", 100)
    nodes, entries = graph.build_flat(placed)
    assert sorted(x[0] for x in nodes.select("nid").collect()) == list(range(600)) and nodes.filter(F.size("neighbors") > 32).count() == 0
    assert entries.count() >= 6
    assert ann.recall(graph.graph_scan(nodes, asked(df), entries, df, ef=96, lim=5), ann.exact_many(df, asked(df), 5), 5).first()["recall"] >= 0.9
    meta, levels = graph.build_hierarchy(placed, m=8, ef=40)
    assert meta.count() == 6 and levels.filter("level = 0").count() == 600
    assert graph.build_hierarchy(placed, m=8, ef=40, shards=2)[0].count() == 2


def test_wide_searches_in_sql_need_not_hold_the_graph(spark):
    df, placed = sketched(spark)
    one = df.filter("id = 'v007'")
    text = "array(" + ", ".join(f"{x!r}f" for x in one.first()["embedding"]) + ")"
    truth = [(x["id"], round(x["distance"], 9)) for x in ann.exact_many(df, one.select(F.lit(1).alias("query_id"), F.col("embedding").alias("query")), 5).orderBy("rank").collect()]
    nodes, entries = graph.build_flat(placed)
    meta, levels = graph.build_hierarchy(placed, m=8, ef=40)
    spark.conf.set("spark.keystrata.broadcastBytes", "1000")
    try:
        register.register_graph(spark, nodes, entries, rows=df)
        register.register_graph(spark, levels, meta=meta, rows=df)
        for name in ("graph_scan", "hnsw_scan"):
            assert [(x["id"], round(x["distance"], 9)) for x in spark.sql(f"SELECT * FROM {name}({text}, 600, 5) ORDER BY distance, id").collect()] == truth
    finally:
        spark.conf.unset("spark.keystrata.broadcastBytes")


def test_large_shards_are_built_in_cells(spark, monkeypatch):
    df, placed = sketched(spark)
    copies = [f"w{i:03d}" for i in range(150)]  # of one row
    more = df.filter("id = 'v007'").select(F.explode(F.array(*map(F.lit, copies))).alias("id"), "embedding")
    df, placed = df.union(more), placed.select("id", "sketch").union(more)
    monkeypatch.setattr(graph, "SHARD", 60)
    monkeypatch.setattr(graph, "insert_all", None)
    meta, nodes = graph.build_hierarchy(placed, m=8, ef=40, shards=2)
    rows = nodes.collect()
    for s in (0, 1):
        own = sorted((x["nid"], x["src_id"]) for x in rows if x["shard"] == s and x["level"] == 0)
        assert [n for n, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted(i for _, i in own)
    assert sorted(x["src_id"] for x in rows if x["level"] == 0) == sorted([f"v{i:03d}" for i in range(600)] + copies)
    assert all(len(x["neighbors"]) <= (8 if x["level"] else 16) for x in rows)
    assert {(x["shard"], x["entry_nid"], x["max_level"]) for x in meta.collect()} <= {(x["shard"], x["nid"], x["level"]) for x in rows}
    monkeypatch.setattr(graph, "ASKED", 10)  # several tasks a shard
    found = graph.hnsw_scan(meta, nodes, asked(df), df, ef=96, lim=5, rerank=48)
    assert ann.recall(found.filter("query_id <> 7"), ann.exact_many(df, asked(df).filter("query_id <> 7"), 5), 5).first()["recall"] >= 0.9
    assert [round(x["distance"], 6) for x in found.filter("query_id = 7").collect()] == [0] * 5


def test_diversity_of_many_is_that_of_one():
    r = np.random.default_rng(2)
    u = graph._unit(r.normal(size=(40, 6)))
    near = u[:5] @ u[10:].T
    order = np.argsort(-near, axis=1)
    near = np.take_along_axis(near, order, 1)
    among = np.array([u[10:][o] @ u[10:][o].T for o in order])
    for i, taken in enumerate(graph.diverse_many(near, among, 9)):
        assert sorted(graph.diverse(np.arange(30), near[i], among[i], 9)) == np.flatnonzero(taken).tolist()
