from keystrata.sources.table import KeyTable
from keystrata.streaming import ingest


def test_replay_of_a_log_is_idempotent(spark, tmp_path):
    schema = "id long, v string"
    t = KeyTable.load(spark.createDataFrame([(i, "old") for i in range(20)], schema), f"{tmp_path}/t", ["id"], primary=True, files=2)
    log = spark.createDataFrame([(3, "new", "U", 1), (3, "newer", "U", 2), (5, None, "D", 3), (30, "in", "I", 4), (31, "in", "I", 5), (31, None, "D", 6)], "id long, v string, action string, seq long")
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    for i in range(2):
        ingest.replay(ingest.read(spark, f"{tmp_path}/log", log.schema), f"{tmp_path}/t", f"{tmp_path}/c{i}").awaitTermination()
        got = dict(map(tuple, t.refresh().scan().collect()))
        assert got == {i: "old" for i in range(20) if i not in (3, 5)} | {3: "newer", 30: "in"}


def test_windows_of_a_stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("*", "CAST(ts AS TIMESTAMP) AS at").drop("ts")
    e.coalesce(2).write.parquet(f"{tmp_path}/e")
    s = ingest.windows(ingest.read(spark, f"{tmp_path}/e", e.schema), "at", "1 day", late="40 days")
    q = s.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = ingest.windows(e, "at", "1 day")
    assert {tuple(r)[:3] for r in spark.table("daily").collect()} == {tuple(r)[:3] for r in want.collect()}
