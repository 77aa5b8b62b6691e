from pyspark.sql import functions as F

from keystrata.operators import maintain
from keystrata.sources import table
from keystrata.sources.table import KeyTable


def test_a_file_holds_so_many_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table, "ROWS", 100)
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    t = KeyTable.load(df, f"{tmp_path}/t", ["k"], files=2)
    assert len(t.manifest.files) >= 8 and max(f.rows for f in t.manifest.files) < 500 and t.manifest.sorted
    t.append(df.withColumn("k", F.col("k") + 500), 2)
    t = maintain.merge(t)
    assert len(t.manifest.files) >= 16 and t.scan().count() == 2000 and t.inversions().first()[0] == 0


def test_changes_join_the_rows_once(spark, tmp_path, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("k"), F.col("id").cast("string").alias("x"))
    t = KeyTable.load(df, f"{tmp_path}/t", ["k"], primary=True, files=3)
    seen, own = [], KeyTable._rewritten

    def rewritten(self, old, change, added=None):
        def seeing(rows):
            out = change(rows)
            seen.append(out._jdf.queryExecution().optimizedPlan().toString().count("Join"))
            return out

        places = own(self, old, seeing, added)
        return places

    monkeypatch.setattr(KeyTable, "_rewritten", rewritten)
    new = spark.createDataFrame([(5, "five"), (7, None), (900, "new")], "k long, x string")
    t.apply(new, spark.createDataFrame([(7,), (8,), (250,), (901,)], "k long"))
    got = {r["k"]: r["x"] for r in t.scan().collect()}
    assert got == {i: str(i) for i in range(300) if i not in (8, 250)} | {5: "five", 7: None, 900: "new"}
    assert seen and max(seen) <= 3  # the files' places, the changes, and what the removed keys leave out
