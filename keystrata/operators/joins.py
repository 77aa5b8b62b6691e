"""As-of joins: each row with the last row of another table that has its key and is no later.

Times are cut into spans, so no task holds all rows of a key: within a span a window finds the last row, and the last row of
the spans before it comes from one row for each key and span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, span: int = 86_400) -> DataFrame:
    """left's rows with right's columns, null where there is no such row; of several at one time the greatest row. span: seconds.

    Rows of left with a null key or time have no match; rows of right with one are none. The columns' names must differ but for the key.
    """
    values = [c for c in right.columns if c != key]
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"both tables have {', '.join(sorted(clash))}")

    def at(name: str):
        return F.floor(F.col(f"`{name}`").cast("timestamp").cast("double") / span).cast("long")

    known = right.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{right_time}`").isNotNull())
    one = F.struct(F.col(f"`{right_time}`").alias("__time"), *(F.col(f"`{c}`") for c in values))
    known = known.select(F.col(f"`{key}`").alias("__key"), at(right_time).alias("__span"), F.col(f"`{right_time}`").alias("__time"), one.alias("__row"))
    rows = left.select(F.col(f"`{key}`").alias("__key"), at(left_time).alias("__span"), F.col(f"`{left_time}`").alias("__time"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("__left"))
    both = rows.withColumn("__row", F.lit(None).cast(known.schema["__row"].dataType)).unionByName(known.withColumn("__left", F.lit(None).cast(rows.schema["__left"].dataType)))
    # a row of right comes before one of left at the same time
    within = Window.partitionBy("__key", "__span").orderBy("__time", F.col("__row").isNull(), "__row").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__row", True).over(within)).filter("__left IS NOT NULL").drop("__row")
    spans = both.groupBy("__key", "__span").agg(F.max("__row").alias("__last"))
    before = Window.partitionBy("__key").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__before", F.last("__last", True).over(before)).filter("__before IS NOT NULL").select(F.col("__key").alias("k"), F.col("__span").alias("s"), "__before")
    joined = found.join(spans, (F.col("__key") == F.col("k")) & (F.col("__span") == F.col("s")), "left").withColumn("__found", F.when(F.col("__time").isNotNull() & F.col("__key").isNotNull(), F.coalesce("__found", "__before")))
    return joined.select(*(F.col(f"__left.`{c}`").alias(c) for c in left.columns), *(F.col(f"__found.`{c}`").alias(c) for c in values))
