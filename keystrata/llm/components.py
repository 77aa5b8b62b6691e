"""Connected components of a graph of integer ids, by alternating large and small stars.

The least neighbour of each id is aggregated where the edges lie and joined back, so the edges of an id that most others are
joined to are spread over as many tasks as its join is split in, and none holds them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import cut, discard


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least v of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def _star(edges: DataFrame) -> DataFrame:
    """(u, v, m) both ways round, m the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).withColumn("m", F.least("u", "m"))


def components(edges: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """(id, least): of each id that has an edge (a, b), the least id of its component. Loops, repeated edges and nulls are ignored. kept gets the path of the result.

    A round is two joins by id and one table of at most as many edges; rounds grow as the logarithm of the longest path.
    """
    ids = edges.toDF("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    made: list[str] = []
    now = cut(ids.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), made)
    sign = None
    while True:
        large = _star(now).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # every id has one least neighbour below it now, or some: they and the id are joined to the least of them
        small = _least(large)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, made = made, []
        now = cut(small.filter("u <> v").distinct(), made)
        discard(edges.sparkSession, before)
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if found == sign:
            if kept is not None:
                kept += made
            return now.select(F.col("u").alias("id"), F.col("v").alias("least"))
        sign = found
