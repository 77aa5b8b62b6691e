"""Directed placement: rows of one key side by side, without a total order of the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType


def placed(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """df's rows, those of a key in one partition and in a row there. The key is an integer; a null in it is an error."""
    if not isinstance(df.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{key} is {df.schema[key].dataType.simpleString()}; rows are placed by an integer key")
    k = F.col(f"`{key}`")
    checked = df.withColumn(key, F.coalesce(k, F.raise_error(F.lit(f"null in {key}")).cast(df.schema[key].dataType)))
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checked.repartition(n, k).sortWithinPartitions(k)


def blocks(df: DataFrame, key: str) -> DataFrame:
    """(key, partitions): how many partitions of placed() rows a key is in."""
    return df.withColumn("__p", F.spark_partition_id()).groupBy(key).agg(F.count_distinct("__p").alias("partitions"))
