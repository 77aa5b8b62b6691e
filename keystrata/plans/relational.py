"""The relational surface: joins, aggregates, windows, set operations, sorts, scalar functions, files, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.operators import chunking, joins
from keystrata.plans.storage import Query, read, scratch
from keystrata.sources.table import KeyTable
from keystrata.streaming import ingest

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT n_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_inner(spark, sf_dir):
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    per = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("m"))
    j = per.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("s"), 2).alias("revenue"), F.sum("m").alias("n"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def join_left(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 2")
def join_full(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey") * 2, "full").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, 'semi' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'anti' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_anti(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    semi = c.join(o, on, "left_semi").select("c_custkey", F.lit("semi").alias("kind"))
    return semi.union(c.join(o, on, "left_anti").select("c_custkey", F.lit("anti").alias("kind")))


@query("""SELECT a.event_id, a.user_id, b.seen, b.amount FROM (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase') a
ASOF LEFT JOIN (SELECT user_id, ts AS seen, max(value) AS amount FROM events WHERE event_type = 'purchase' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.seen""")
def join_as_of(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("amount"))
    return joins.as_of(e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "seen").drop("ts")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, min(l_quantity) AS least, max(l_quantity) AS most, round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 9) AS discount, bool_and(l_tax >= 0) AS taxed FROM lineitem GROUP BY ALL")
def agg_basic(spark, sf_dir):
    aggs = (F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.avg("l_discount"), 9).alias("discount"), F.bool_and(F.col("l_tax") >= 0).alias("taxed"))
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*aggs)


def _medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, middle): of each group the least value that half of the values don't exceed, from counts of different values: of stretches of values first, then of those in the median's."""
    path = scratch(df.sparkSession)
    df.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n")).write.parquet(path)
    counts = df.sparkSession.read.parquet(path).withColumn("b", F.floor("v"))
    w = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.groupBy("g", "b").agg(F.sum("n").alias("n")).select("g", "b", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    at = upto.filter("before * 2 < total AND upto * 2 >= total").select(F.col("g").alias("h"), F.col("b").alias("c"), "before", "total")
    some = counts.join(F.broadcast(at), F.col("g").eqNullSafe(F.col("h")) & (F.col("b") == F.col("c")))  # a row for each group
    reached = F.col("before") + F.sum("n").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return some.withColumn("reached", reached).filter("reached * 2 >= total").groupBy(F.col("g").alias(by)).agg(F.min("v").alias("middle"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, quantile_disc(l_extendedprice, 0.5) AS middle, TRUE AS parts_near, TRUE AS middle_near FROM lineitem GROUP BY l_returnflag")
def agg_approx(spark, sf_dir):
    """Sketches against what they estimate: distinct values within a tenth, the rank of the median within a hundredth."""
    l = read(spark, sf_dir, "lineitem")
    near = l.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"), F.percentile_approx("l_extendedprice", [0.49, 0.51], 10_000).alias("near"))
    parts = l.select("l_returnflag", "l_partkey").distinct().groupBy(F.col("l_returnflag").alias("f1")).agg(F.count("l_partkey").alias("parts"))
    middle = _medians(l, "l_returnflag", "l_extendedprice").select(F.col("l_returnflag").alias("f2"), "middle")
    both = near.join(parts, F.col("l_returnflag").eqNullSafe(F.col("f1"))).join(middle, F.col("l_returnflag").eqNullSafe(F.col("f2")), "left")
    return both.select("l_returnflag", "parts", "middle", (F.abs(F.col("about") - F.col("parts")) <= F.col("parts") * 0.1).alias("parts_near"), F.col("middle").between(F.col("near")[0], F.col("near")[1]).alias("middle_near"))


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey)[2:4], ',') AS some FROM orders GROUP BY o_custkey")
def agg_array_slice(spark, sf_dir):
    got = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(got.alias("a")).select("o_custkey", F.array_join(F.slice(F.col("a.o_orderkey").cast("array<string>"), 2, 3), ",").alias("some"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY o_orderpriority HAVING count(*) > 10")
def agg_filter_having(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count("*").alias("n"))
    return o.filter("n > 10").drop("n")


def _sets(kind: str) -> str:
    return f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY {kind}"


@query(_sets("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def grouping_sets(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    sets = [[F.col("l_returnflag")], [F.col("l_linestatus")], []]
    return l.groupingSets(sets, "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query(_sets("ROLLUP (l_returnflag, l_linestatus)"))
def rollup(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query(_sets("CUBE (l_returnflag, l_linestatus)"))
def cube(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT event_id, lag(value, 1, -1.0) OVER w AS before, row_number() OVER w AS n, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS r, round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_functions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moving = F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6)
    return read(spark, sf_dir, "events").select("event_id", F.lag("value", 1, -1.0).over(w).alias("before"), F.row_number().over(w).alias("n"), F.rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("r"), moving.alias("moving"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn")).filter("rn <= 3")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT k, 'union' AS op FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'intersect' FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'except' FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_ops(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    k = s.select(F.col("s_nationkey").alias("k"))
    named = lambda df, op: df.withColumn("op", F.lit(op))
    return named(c.union(k).distinct(), "union").union(named(c.intersect(k), "intersect")).union(named(n.subtract(s.filter("s_acctbal > 5000").select("s_nationkey")), "except"))


@query("SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS padded, repeat('ab', 1 + CAST(o_orderkey % 3 AS INTEGER)) AS rep, abs(o_totalprice - 100000) AS off, md5(o_orderpriority) AS h, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END AS kind FROM orders")
def scalar_functions(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("padded"), F.expr("repeat('ab', 1 + int(o_orderkey % 3))").alias("rep"), F.abs(F.col("o_totalprice") - 100000).alias("off"), F.md5("o_orderpriority").alias("h"), kind.alias("kind"))


@query("SELECT i, i * i AS square FROM (SELECT CAST(unnest(range(1, 101)) AS BIGINT) AS i)")
def series(spark, sf_dir):
    return spark.range(1, 101).select(F.col("id").alias("i"), (F.col("id") * F.col("id")).alias("square"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT * FROM supplier")
def csv_round_trip(spark, sf_dir):
    s, path = read(spark, sf_dir, "supplier"), scratch(spark)
    s.write.csv(path, header=True)
    return spark.read.schema(s.schema).csv(path, header=True)


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({_CLEAN}, '[ \n]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT doc_id, words, unnest(range(0, 1 + CAST(greatest(ceil((len(words) - 200) / 160.0), 0) AS BIGINT))) AS idx FROM w WHERE len(words) > 0),
c AS (SELECT doc_id AS doc, CAST(idx AS BIGINT) AS idx, array_to_string(words[idx * 160 + 1 : idx * 160 + 200], ' ') AS chunk FROM i)
SELECT concat_ws(':', CAST(doc AS VARCHAR), CAST(idx AS VARCHAR), substr(md5(chunk), 1, 12)) AS id, doc, idx, chunk FROM c""")
def chunk_documents(spark, sf_dir):
    return chunking.chunks(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    w = ingest.windows(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, TRUE) AS new FROM events),
s AS (SELECT user_id, ts, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s""")
def events_sessions(spark, sf_dir):
    s = ingest.sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", "user_id")
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT * FROM events")
def stream_append_merge(spark, sf_dir):
    path, e = scratch(spark), read(spark, sf_dir, "events")
    e.repartition(3, "event_id").write.parquet(f"{path}-in")
    KeyTable.create(spark, path, e.schema, ["user_id", "ts"])
    ingest.append(ingest.read(spark, f"{path}-in", e.schema), path, f"{path}-checkpoint", merge_every=2).awaitTermination()
    return KeyTable(spark, path).scan()


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'changed' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderstatus <> 'P'")
def stream_replay(spark, sf_dir):
    """A log that changes the finished orders and removes the pending ones."""
    path, o = scratch(spark), read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    rows = o.drop("o_orderstatus")
    KeyTable.load(rows, path, ["o_orderkey"], primary=True)
    log = o.filter("o_orderstatus IN ('F', 'P')").select("o_orderkey", F.lit("changed").alias("o_orderpriority"), F.when(F.col("o_orderstatus") == "P", "D").otherwise("U").alias("action"), F.col("o_orderkey").alias("seq"))
    log.write.parquet(f"{path}-log")
    ingest.replay(ingest.read(spark, f"{path}-log", log.schema), path, f"{path}-checkpoint").awaitTermination()
    return KeyTable(spark, path).scan()
