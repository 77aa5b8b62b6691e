"""Queries on clustered tables: pruned scans, changes, maintenance, and what is known of the files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.config import shared_folder
from keystrata.functions import locator, register
from keystrata.operators import maintain, placement
from keystrata.sources import datasource
from keystrata.sources.table import STATS, Key, KeyTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FILES = 16
COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def clustered(spark: SparkSession, sf_dir: str, name: str, key: list[Key], primary: bool = False) -> KeyTable:
    return KeyTable.load(read(spark, sf_dir, name), scratch(spark), key, primary, FILES)


def orders(spark: SparkSession, sf_dir: str, primary: bool = False) -> KeyTable:
    return clustered(spark, sf_dir, "orders", ["o_orderkey"], primary)


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def scan_point(spark, sf_dir):
    return orders(spark, sf_dir).scan([("o_orderkey", "=", 77)])


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 1200")
def scan_range(spark, sf_dir):
    return orders(spark, sf_dir).scan([("o_orderkey", "between", (100, 1200))])


@query("SELECT * FROM orders WHERE o_orderkey > 900 AND o_orderkey < 1400 AND o_totalprice > 1000")
def scan_half_open(spark, sf_dir):
    return orders(spark, sf_dir).scan([("o_orderkey", ">", 900), ("o_orderkey", "<", 1400), ("o_totalprice", ">", 1000.0)])


@query("SELECT * FROM orders WHERE o_orderkey IN (3, 500, 1111, 999999999)")
def scan_in_sparse(spark, sf_dir):
    return orders(spark, sf_dir).scan([("o_orderkey", "in", [1111, None, 3, 500, 999999999])])


@query("SELECT * FROM orders WHERE o_orderkey > 1000 AND o_orderkey < 10")
def scan_contradiction(spark, sf_dir):
    return orders(spark, sf_dir).scan([("o_orderkey", ">", 1000), ("o_orderkey", "<", 10)])


@query("SELECT * FROM orders WHERE o_orderkey = NULL")
def scan_null(spark, sf_dir):
    return orders(spark, sf_dir).scan([("o_orderkey", "=", None)])


@query("SELECT * FROM orders WHERE o_custkey = 7 OR o_orderkey = 5")
def scan_unpruned(spark, sf_dir):
    return orders(spark, sf_dir).scan().filter("o_custkey = 7 OR o_orderkey = 5")


@query("SELECT * FROM lineitem WHERE l_orderkey BETWEEN 40 AND 700 AND l_linenumber = 2")
def scan_composite(spark, sf_dir):
    return clustered(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"]).scan([("l_orderkey", "between", (40, 700)), ("l_linenumber", "=", 2)])


@query("SELECT * FROM events WHERE user_id = 3 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def scan_time_device(spark, sf_dir):
    import datetime as dt

    return clustered(spark, sf_dir, "events", ["user_id", "ts"]).scan([("user_id", "=", 3), ("ts", ">=", dt.datetime(2024, 1, 5)), ("ts", "<", dt.datetime(2024, 1, 20))])


@query("SELECT * FROM customer WHERE c_name > 'Customer#000000100' AND c_name < 'Customer#000000130'")
def scan_text_strict(spark, sf_dir):
    return clustered(spark, sf_dir, "customer", ["c_name"]).scan([("c_name", ">", "Customer#000000100"), ("c_name", "<", "Customer#000000130")])


@query("SELECT * FROM part WHERE p_brand = 'Brand#12' AND p_partkey > 50")
def scan_text_integer(spark, sf_dir):
    return clustered(spark, sf_dir, "part", ["p_brand", "p_partkey"]).scan([("p_brand", "=", "Brand#12"), ("p_partkey", ">", 50)])


@query("SELECT * FROM orders WHERE o_orderkey <= 300")
def scan_descending(spark, sf_dir):
    return clustered(spark, sf_dir, "orders", [("o_orderkey", False)]).scan([("o_orderkey", "<=", 300)])


@query("SELECT o.* FROM orders o WHERE o_orderkey BETWEEN 10 AND 20 UNION ALL SELECT o.* FROM orders o WHERE o_orderkey BETWEEN 500 AND 510")
def scan_prepared(spark, sf_dir):
    t = orders(spark, sf_dir)
    bound = lambda low, high: t.scan([("o_orderkey", "between", (low, high))])
    return bound(10, 20).union(bound(500, 510))


@query("SELECT o.* FROM orders o WHERE o_orderkey IN (SELECT c_custkey * 7 FROM customer)")
def scan_lateral_keys(spark, sf_dir):
    return orders(spark, sf_dir).lookup(read(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("k")))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = c_custkey + 1)")
def join_lateral(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    found = orders(spark, sf_dir).lookup(c.select((F.col("c_custkey") + 1).alias("k")))
    return c.join(found, F.col("o_orderkey") == F.col("c_custkey") + 1).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer JOIN (SELECT unnest([5, 10, 15, 101, 200, 300]) AS k) ON c_custkey = k")
def join_unnest(spark, sf_dir):
    keys = spark.range(1).select(F.explode(F.array(*(F.lit(k).cast("long") for k in (5, 10, 15, 101, 200, 300)))).alias("k"))
    return clustered(spark, sf_dir, "customer", ["c_custkey"]).lookup(keys).select("c_custkey", "c_name")


@query("SELECT * FROM orders WHERE o_orderkey > 200 AND o_orderkey <= 900")
def source_scan(spark, sf_dir):
    t = orders(spark, sf_dir)
    datasource.register(spark)
    return spark.read.format("keystrata").load(t.path).filter("o_orderkey > 200 AND o_orderkey <= 900")


@query()
def scan_stats(spark, sf_dir):
    t = orders(spark, sf_dir)
    STATS.reset()
    t.scan([("o_orderkey", "=", 77)])
    return STATS.frame(spark)


@query("SELECT sum(1) AS n_rows, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders")
def zones(spark, sf_dir):
    return orders(spark, sf_dir).zones().agg(F.sum("rows").cast("decimal(38,0)").alias("n_rows"), F.min(F.col("min1").cast("long")).alias("least"), F.max(F.col("max1").cast("long")).alias("most"))


@query("SELECT * FROM orders WHERE o_orderkey < 640")
def vacuum_rebuild(spark, sf_dir):
    t = orders(spark, sf_dir).update({"o_custkey": F.col("o_custkey")}, [("o_orderkey", "<", 10)], lazy=True)
    maintain.vacuum(t)
    return t.scan([("o_orderkey", "<", 640)])


@query("SELECT count(*) AS rows_total, count(*) FILTER (WHERE o_orderkey BETWEEN 100 AND 1200) AS rows_found, TRUE AS adds_up, TRUE AS one_range, TRUE AS no_file_too_many FROM orders")
def explain_scan(spark, sf_dir):
    """What explain_scan() counts, against the rows: the files with a row in the range are one stretch, and no other file is read."""
    t, where = orders(spark, sf_dir), [("o_orderkey", "between", (100, 1200))]
    seen = t.explain_scan(where).select((F.col("files_total") == F.col("files_scanned") + F.col("files_pruned")).alias("adds_up"), (F.col("n_ranges") == 1).alias("one_range"), "files_scanned")
    rows = t._with_file(t.manifest.files)
    files = rows.groupBy("__file").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey").between(100, 1200)).alias("hits"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    files = files.agg(F.sum("n").alias("rows_total"), F.sum("hits").alias("rows_found"), F.count_if((F.col("low") <= 1200) & (F.col("high") >= 100)).alias("meet"))
    return files.join(seen).select("rows_total", "rows_found", "adds_up", "one_range", (F.col("files_scanned") == F.col("meet")).alias("no_file_too_many"))


@query("SELECT n_nationkey, n_nationkey - 10 < 0 OR (n_nationkey = 10 AND n_regionkey < 2) AS less, n_nationkey = 10 AND n_regionkey = 2 AS same, n_nationkey + 5 AS major, n_regionkey + 2 AS minor FROM nation")
def locator_sql(spark, sf_dir):
    register.register(spark)
    read(spark, sf_dir, "nation").createOrReplaceTempView("keystrata_nation")
    return spark.sql("""SELECT n_nationkey, locator_less(l, o) AS less, locator_equal(l, o) AS same, cast(locator_major(locator_advance_major(l, 15)) AS INT) AS major, cast(locator_minor(locator_next_minor(l, 2)) AS INT) AS minor
        FROM (SELECT *, locator_pack(n_nationkey - 10, n_regionkey) AS l, locator_pack_minor(2) AS o FROM keystrata_nation)""")


@query("SELECT * FROM orders UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders UNION ALL SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def append_then_merge(spark, sf_dir):
    t, o = orders(spark, sf_dir), read(spark, sf_dir, "orders")
    t.append(o.withColumn("o_orderkey", F.col("o_orderkey") + 100000000), 2)
    t.append(o.withColumn("o_orderkey", -1 - F.col("o_orderkey")), 2)
    return maintain.merge(t).scan()


def _shuffled(spark, sf_dir, primary=False):
    """Orders in two appended runs of scattered keys."""
    o = read(spark, sf_dir, "orders")
    t = KeyTable.create(spark, scratch(spark), o.schema, ["o_orderkey"], primary)
    return t.append(o.filter("o_orderkey % 2 = 0"), 4).append(o.filter("o_orderkey % 2 <> 0"), 4)


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 700 AND 900")
def compact_after_shuffle(spark, sf_dir):
    return maintain.compact(_shuffled(spark, sf_dir)).scan([("o_orderkey", "between", (700, 900))])


@query("SELECT 0 AS inversions")
def order_inversions(spark, sf_dir):
    return maintain.compact(_shuffled(spark, sf_dir)).inversions().select(F.col("inversions").cast("int").alias("inversions"))


@query("SELECT * REPLACE (CASE WHEN o_orderkey BETWEEN 10 AND 400 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey BETWEEN 10 AND 400 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM orders")
def update_eager(spark, sf_dir):
    return orders(spark, sf_dir).update({"o_totalprice": F.col("o_totalprice") * 2, "o_orderstatus": "X"}, [("o_orderkey", "between", (10, 400))]).scan()


@query("SELECT * REPLACE (CASE WHEN o_orderkey > 1000 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey) FROM orders")
def update_lazy(spark, sf_dir):
    return orders(spark, sf_dir).update({"o_custkey": F.col("o_custkey") + 1}, [("o_orderkey", ">", 1000)], lazy=True).scan()


@query("SELECT * FROM orders WHERE NOT (o_orderkey BETWEEN 100 AND 1100 AND o_orderstatus = 'O')")
def delete_range(spark, sf_dir):
    return orders(spark, sf_dir).delete([("o_orderkey", "between", (100, 1100)), ("o_orderstatus", "=", "O")]).scan()


@query("SELECT * FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT * REPLACE ('U' AS o_orderstatus) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT * REPLACE (o_orderkey + 500000000 AS o_orderkey, 'U' AS o_orderstatus) FROM orders WHERE o_orderstatus = 'O'")
def upsert(spark, sf_dir):
    new = read(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").withColumn("o_orderstatus", F.lit("U"))
    return orders(spark, sf_dir, True).upsert(new.union(new.withColumn("o_orderkey", F.col("o_orderkey") + 500000000))).scan()


@query("SELECT * REPLACE ('R' AS o_orderstatus) FROM orders")
def truncate_reload(spark, sf_dir):
    return maintain.compact(orders(spark, sf_dir).truncate().append(read(spark, sf_dir, "orders").withColumn("o_orderstatus", F.lit("R")))).scan()


ONLINE_SQL = "SELECT * REPLACE (CASE WHEN o_orderkey BETWEEN 50 AND 90 THEN 'M' ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderkey NOT BETWEEN 300 AND 420 UNION ALL SELECT * REPLACE (o_orderkey + 700000000 AS o_orderkey) FROM orders WHERE o_orderkey BETWEEN 1 AND 60"


def _meanwhile(t: KeyTable, spark, sf_dir):
    """What other writers do while the table is rewritten."""

    def write():
        other = KeyTable(spark, t.path)
        other.update({"o_orderstatus": "M"}, [("o_orderkey", "between", (50, 90))])
        other.delete([("o_orderkey", "between", (300, 420))])
        other.append(read(spark, sf_dir, "orders").filter("o_orderkey BETWEEN 1 AND 60").withColumn("o_orderkey", F.col("o_orderkey") + 700000000), 1)

    return write


@query(ONLINE_SQL)
def compact_online(spark, sf_dir):
    t = _shuffled(spark, sf_dir, True)
    return maintain.compact_online(t, _meanwhile(t, spark, sf_dir)).scan()


@query(ONLINE_SQL)
def merge_online(spark, sf_dir):
    t = _shuffled(spark, sf_dir, True)
    return maintain.merge_online(t, _meanwhile(t, spark, sf_dir)).scan()


@query("SELECT o_orderkey, CAST(NULL AS INTEGER) AS note, CAST(round(o_totalprice) AS BIGINT) AS price FROM orders WHERE o_orderkey < 1500")
def alter_columns(spark, sf_dir):
    t = orders(spark, sf_dir).add_column("note", "int").drop_column("o_orderpriority").rename_column("o_totalprice", "price")
    t.update({"price": F.round("price")}).alter_type("price", "bigint")
    return maintain.rebuild(t).scan([("o_orderkey", "<", 1500)]).select("o_orderkey", "note", "price")


@query("SELECT CAST(floor((rn - 1) / 1000) AS BIGINT) AS block, count(*) AS n_rows, min(o_orderkey) AS min1, max(o_orderkey) AS max1 FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1")
def zone_entries_fixed_blocks(spark, sf_dir):
    # numbers across files: the rows before a file, from the table's own counts, and the row's place in it
    t = orders(spark, sf_dir)
    before = t.zones().select(F.element_at(F.split("path", "/"), -1).alias("f"), (F.sum("rows").over(Window.partitionBy().orderBy("ord")) - F.col("rows")).alias("before"))
    rows = t._read(t.manifest.files).select("o_orderkey", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).join(F.broadcast(before), "f")
    block = F.floor((F.col("before") + F.col("i")) / 1000)
    return rows.groupBy(block.alias("block")).agg(F.count("*").alias("n_rows"), F.min("o_orderkey").alias("min1"), F.max("o_orderkey").alias("max1"))


_BLOCKS_SQL = "b AS (SELECT ts_day AS ord, min(user_id) AS min1, max(user_id) AS max1 FROM (SELECT CAST(day(ts) AS BIGINT) - 1 AS ts_day, user_id + 1000 * day(ts) AS user_id FROM events) GROUP BY 1)"


@query(f"WITH {_BLOCKS_SQL}, z AS (SELECT *, max(max1) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b) SELECT coalesce(min(ord) FILTER (WHERE min1 < before), count(*)) AS sorted_prefix FROM z")
def sorted_prefix(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.dayofmonth("ts").cast("long") - 1).alias("ord"), (F.col("user_id") + 1000 * F.dayofmonth("ts")).alias("k"))
    return maintain.prefix_sql(e.groupBy("ord").agg(F.min("k").alias("min1"), F.max("k").alias("max1")))


LOG_SQL = "SELECT event_id, user_id % 40 AS k, CASE event_id % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'I' ELSE 'U' END AS action, value FROM events"


@query(f"SELECT k, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id DESC) AS rn FROM ({LOG_SQL})) WHERE rn = 1 AND action <> 'D'")
def online_replay_lww(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.col("event_id") % 5
    log = e.select("event_id", (F.col("user_id") % 40).alias("k"), F.when(kind == 0, "D").when(kind == 1, "I").otherwise("U").alias("action"), "value")
    return maintain.last_writes(log, ["k"], "event_id", "action")


@query("SELECT user_id, CAST(1 AS BIGINT) AS partitions FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def directed_blocks(spark, sf_dir):
    return placement.blocks(placement.placed(read(spark, sf_dir, "events"), "user_id"), "user_id")


@query("SELECT l_orderkey, l_linenumber, format('{:016X}:{:016X}', l_orderkey, CAST(l_linenumber AS BIGINT)) AS hex FROM lineitem")
def locator_hex(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", locator.to_hex(locator.pack(F.col("l_orderkey"), F.col("l_linenumber"))).alias("hex"))


@query("SELECT l_orderkey - 3000 AS major, l_linenumber * -2 AS minor, l_orderkey + 7000 AS advanced, l_linenumber * -2 + 5 AS next FROM lineitem")
def locator_parts(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select(locator.pack(F.col("l_orderkey") - 3000, F.col("l_linenumber") * -2).alias("l"))
    moved = locator.next_minor(locator.advance_major(F.col("l"), F.lit(10000)), F.lit(5))
    return l.select(locator.major(F.col("l")).alias("major"), locator.minor(F.col("l")).cast("int").alias("minor"), locator.major(moved).alias("advanced"), locator.minor(moved).cast("int").alias("next"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey - 10 < 0 THEN -1 WHEN n_nationkey - 10 > 0 THEN 1 WHEN n_regionkey < 2 THEN -1 WHEN n_regionkey > 2 THEN 1 ELSE 0 END AS cmp FROM nation")
def locator_compare(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return n.select("n_nationkey", locator.compare(locator.pack(F.col("n_nationkey") - 10, F.col("n_regionkey")), locator.pack(F.lit(0), F.lit(2))).alias("cmp"))
