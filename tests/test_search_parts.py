import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.functions.vectors import cosine_distance, cosine_distances
from keystrata.operators import ann, graph, quantize


@pytest.fixture(scope="module")
def some(spark):
    """Vectors with equal ones, and some without a direction."""
    r = np.random.default_rng(8)
    v = r.normal(size=(400, 8)).astype(np.float32)
    v[300:350], v[395:] = v[:50], 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    return v, df, df.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def test_exact_searches_in_parts(spark, some, monkeypatch):
    v, df, queries = some
    for name, value in (("SIDE", 90), ("PAIRS", 1000), ("FIRST", 16), ("WIDTH", 32), ("TILE", 64)):
        monkeypatch.setattr(ann, name, value)
    found = {(x["query_id"], x["rank"]): (x["id"], x["distance"]) for x in ann.exact_many(df, queries, 12, digits=9).collect()}
    assert len(found) == 400 * 12
    for i in range(0, 400, 7):
        d = np.round(cosine_distances(np.broadcast_to(v[i], v.shape), v), 9)
        for n, j in enumerate(np.lexsort((np.arange(400), d))[:12].tolist()):
            who, distance = found[i, n + 1]
            assert who == j and (distance == pytest.approx(d[j], abs=1e-8) or np.isnan(distance) and np.isnan(d[j]))
    few = ann.exact_many(df.filter("id >= 390"), queries.filter("query_id IN (1, 399)"), 8).collect()
    assert [x["id"] for x in sorted(few, key=lambda x: x["rank"]) if x["query_id"] == 399] == list(range(390, 398))
    assert sorted(x["id"] for x in few if x["query_id"] == 1 and np.isnan(x["distance"])) == [395, 396, 397]


@pytest.mark.parametrize("residual", (False, True))
def test_searches_by_codes_in_parts(spark, some, tmp_path, monkeypatch, residual):
    v, df, queries = some
    monkeypatch.setattr(ann, "SIDE", 40)
    lists = quantize.train_lists(v, 5)
    codes = quantize.train_codes(v, 4, lists=lists if residual else None)
    t = ann.build(df, f"{tmp_path}/t", lists, codes, files=3)
    found = {(x["query_id"], x["rank"]): x["id"] for x in ann.search_many(t, queries, lists, codes, 2, 6).collect()}
    of = lists.assign(v)
    code, probes = codes.encode(v, of if residual else None), lists.probe(v, 2)
    for i in range(0, 400, 11):
        best = []
        for p in probes[i].tolist():
            own = np.flatnonzero(of == p)
            parts = codes._parts(codes._prepared(v[i : i + 1], np.array([p]) if residual else None))
            d = sum(quantize.squared(parts[:, s], codes.books[s])[0][code[own, s]] for s in range(4))
            best += zip(d.tolist(), own.tolist())
        assert [found[i, n + 1] for n in range(min(6, len(best)))] == [j for _, j in sorted(best)[:6]]


def test_the_truth_of_a_ceiling_is_found_once(spark, some):
    _, df, queries = some
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    truth = ann.exact_many(df.limit(60), queries, 3).select("query_id", "id").mapInArrow(counted, "query_id long, id long")
    placed, probes = df.select("id", F.lit(0).alias("partition_id")), queries.select("query_id", F.lit(1).alias("r"), F.lit(0).alias("partition_id"))
    assert graph.route_ceiling(truth, placed, probes).first()["ceiling"] == 1 and seen.value == 1200


def test_pairs_of_a_label_meet_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(8)
    v = [x.tolist() for x in r.normal(size=(200, 6)).astype(np.float32)]
    rows = [(i, x, 0 if i < 150 else i % 3) for i, x in enumerate(v)]
    rows += [(3, v[9], 0), (None, v[1], 0), (500, v[1], None), (501, None, 0), (502, [0.0] * 6, 0), (503, [1.0, 2.0], 7)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, label int")
    x, y = df.toDF("a", "u", "label"), df.toDF("b", "w", "label")
    plain = lambda t: sorted((p["a"], p["b"], str(p["distance"])) for p in t.collect())
    want = plain(x.join(y, "label").filter("a < b").select("a", "b", F.round(cosine_distance("u", "w"), 9).alias("distance")))
    monkeypatch.setattr(ann, "PAIRED", 40)
    found = ann.pairs(df)
    assert plain(found) == want and len(want) > 10_000
    with pytest.raises(Exception, match="different vector dimensions"):
        ann.pairs(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], "id long, embedding array<float>, label int")).collect()
