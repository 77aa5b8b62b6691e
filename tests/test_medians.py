import random

from pyspark.sql import functions as F

from keystrata.plans import relational


def test_medians_by_counts(spark):
    r = random.Random(2)
    rows = [(g, None if r.random() < 0.1 else r.choice((-3.25, -0.5, 0.0, 7.0, 7.25, r.uniform(-20, 20)))) for g in ("a", "b", None) for _ in range(101)]
    df = spark.createDataFrame([*rows, ("c", None), ("d", 4.0), ("d", 5.0)], "g string, x double")
    want = {x["g"]: x["m"] for x in df.groupBy("g").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("m")).collect()}
    assert {x["g"]: x["middle"] for x in relational._medians(df, "g", "x").collect()} == {g: m for g, m in want.items() if m is not None}


def test_no_task_holds_all_values(spark, sf):
    plan = relational.agg_approx(spark, sf)._jdf.queryExecution().toString()
    assert "percentile_disc" not in plan and "Expand" not in plan
