"""Mixing sources to target weights by Pareto order sampling.

Every source gets its share of the total, exactly, by largest remainders. Within it a document is expected so many times as
its size says: its quota times the document's share of the source's sizes. The whole part of that is certain copies. The
fraction left is an inclusion probability p; the documents with the least u / (1 - u) : p / (1 - p), u being the document's
own random number, fill what is left of the quota.

The least ones are not sorted out by source, of which one may hold most rows: counts of 4096 classes of the ratio give the
class in which a source's last sampled document lies, and only that class is ranked to find the ratio at which to stop.

The random number is a hash of doc_id, so rows that repeat a doc_id are drawn together: a source can exceed its quota by the
repeats of its last document. Null doc_ids count as one doc_id, a null source is a source, a null or negative size is that
of an empty text. Sources that weights doesn't name get none; quotas of sources without rows go to none. Texts aren't read.
Other columns are kept; none can clash. An empty table gives an empty result.
Ids that aren't integers are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm import common

SEED = 6
CLASSES = 4096


def quotas(sources: DataFrame, total: int, weights: dict[str, float] | None, power: float) -> DataFrame:
    """(source, n, size, quota) of sources (source, n, size): shares of total by weights, or by n ** power."""
    if weights is None:
        w = F.sqrt(F.col("n").cast("double")) if power == 0.5 else F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("source") == name, F.lit(float(value))).otherwise(w)
    every = Window.partitionBy()  # the sources, not their documents
    s = sources.withColumn("w", w)
    s = s.withColumn("target", F.when(F.sum("w").over(every) > 0, F.lit(float(total)) * F.col("w") / F.sum("w").over(every)).otherwise(0.0))
    s = s.withColumn("base", F.floor("target"))
    s = s.withColumn("left", F.when(F.sum("w").over(every) > 0, F.lit(int(total))).otherwise(0) - F.sum("base").over(every))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("target") - F.col("base")), F.col("source").asc_nulls_first())))
    return s.select("source", "n", "size", (F.col("base") + (F.col("rank") <= F.col("left")).cast("long")).alias("quota"))


def _size(n_chars: Column) -> Column:
    return F.lit(1) + F.floor(F.sqrt(F.greatest(F.coalesce(n_chars, F.lit(0)), F.lit(0)).cast("double")))


def copies(docs: DataFrame, rate: float = 1.0, weights: dict[str, float] | None = None, power: float = 0.5, seed: int = SEED) -> DataFrame:
    """docs under their columns' numbers, with copies: how often each row is taken. rate: the mixture's rows to those of docs."""
    common.integers(docs, "doc_id")
    plain, (doc_id, source, n_chars) = common.numbered(docs, "doc_id", "source", "n_chars")
    plain = plain.withColumns({"id": F.col(doc_id).cast("long"), "source": F.col(source).cast("string"), "x": _size(F.col(n_chars))})
    d = plain.select("id", "source", "x")
    made: list[str] = []
    sources = common.cut(d.groupBy("source").agg(F.count("*").alias("n"), F.sum("x").alias("size")), made)
    rows = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    quota = common.cut(quotas(sources, round(rate * rows), weights, power).select(F.col("source").alias("of"), "size", "quota"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        # a row for each source: Spark sees the table's size, and broadcasts it if that is small
        return left.join(right, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    def drawn(df: DataFrame) -> DataFrame:
        e = joined(df, quota).withColumn("e", F.col("quota").cast("double") * F.col("x") / F.col("size").cast("double"))
        e = e.withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole"))
        u = common.unit(seed, "id")
        return e.withColumn("q", F.when(F.col("p") > 0, u / (1 - u) / (F.col("p") / (1 - F.col("p")))))

    cell = F.floor(F.col("q") / (1 + F.col("q")) * CLASSES)
    e = drawn(d).withColumn("cell", cell)
    counts = common.cut(e.groupBy("source", "quota", "cell").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")), made)
    w = Window.partitionBy("source")
    c = counts.withColumn("rest", F.col("quota") - F.sum("whole").over(w)).filter("cell IS NOT NULL").withColumn("upto", F.sum("n").over(w.orderBy("cell")))
    last = c.filter("upto >= rest AND upto - n < rest").select(F.col("source").alias("of"), F.col("cell").alias("last"), (F.col("rest") - F.col("upto") + F.col("n")).alias("need"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("q", F.col("id").asc_nulls_first()))
    stop = joined(e, last).filter("cell = last").withColumn("rank", rank).filter("rank = need").select(F.col("source").alias("of"), F.col("q").alias("stop_q"), F.col("id").alias("stop_id"))
    stop = common.cut(stop)
    common.discard(docs.sparkSession, made)
    full = drawn(plain).join(stop, F.col("source").eqNullSafe(F.col("of")), "left")
    taken = F.coalesce((F.col("q") < F.col("stop_q")) | ((F.col("q") == F.col("stop_q")) & (F.coalesce(F.col("id") <= F.col("stop_id"), F.col("id").isNull()))), F.lit(False))
    return full.withColumn("copies", F.col("whole") + taken.cast("long")).select(*(f"c{i}" for i in range(len(docs.columns))), "copies").filter("copies > 0")


def mix(docs: DataFrame, rate: float = 1.0, weights: dict[str, float] | None = None, power: float = 0.5, seed: int = SEED) -> DataFrame:
    """docs, in the same columns, each row as often as it is taken."""
    many = copies(docs, rate, weights, power, seed)
    return many.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies").toDF(*docs.columns)


def sample(docs: DataFrame, rate: float = 1.0, weights: dict[str, float] | None = None, power: float = 0.5, seed: int = SEED) -> DataFrame:
    """(doc_id, source, copies) of the rows that are taken."""
    return copies(common.narrow(docs, doc_id="doc_id", source="source", n_chars="n_chars"), rate, weights, power, seed).toDF("doc_id", "source", "n_chars", "copies").drop("n_chars")


SAMPLE_SQL = f"""
WITH d AS (SELECT doc_id, source, 1 + CAST(floor(sqrt(CAST(greatest(coalesce(n_chars, 0), 0) AS DOUBLE))) AS BIGINT) AS x, {common.unit_sql(SEED, 'doc_id')} AS u FROM documents),
s AS (SELECT source, count(*) AS n, CAST(sum(x) AS BIGINT) AS size FROM d GROUP BY source),
t AS (SELECT *, CAST((SELECT count(*) FROM d) AS DOUBLE) * sqrt(CAST(n AS DOUBLE)) / (SELECT sum(sqrt(CAST(n AS DOUBLE))) FROM s) AS target FROM s),
f AS (SELECT *, CAST(floor(target) AS BIGINT) AS base, row_number() OVER (ORDER BY target - floor(target) DESC, source NULLS FIRST) AS r FROM t),
k AS (SELECT source, size, base + CASE WHEN r <= (SELECT count(*) FROM d) - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS quota FROM f),
e AS (SELECT d.doc_id, d.source, u, quota, CAST(quota AS DOUBLE) * x / CAST(size AS DOUBLE) AS e FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
p AS (SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p FROM e),
q AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS q, quota - sum(whole) OVER (PARTITION BY source) AS rest FROM p),
z AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST) AS r FROM q)
SELECT doc_id, source, whole + CASE WHEN q IS NOT NULL AND r <= rest THEN 1 ELSE 0 END AS copies FROM z WHERE whole + CASE WHEN q IS NOT NULL AND r <= rest THEN 1 ELSE 0 END > 0
"""
