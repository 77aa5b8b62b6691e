"""Streams into clustered tables, replay of change logs, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from keystrata.operators import maintain
from keystrata.sources.table import KeyTable


def read(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that come to path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append(stream: DataFrame, table: str, checkpoint: str, merge_every: int = 0) -> StreamingQuery:
    """Each batch appended as a sorted run, and the table merged after every merge_every batches. Ends when all there is has come.

    A batch that is repeated after a failure is appended again; tables with a primary key take it as an upsert, which isn't.
    """

    def batch(df: DataFrame, n: int) -> None:
        t = KeyTable(df.sparkSession, table)
        if df.isEmpty():
            return
        t.upsert(df) if t.manifest.primary else t.append(df)
        if merge_every and (n + 1) % merge_every == 0:
            maintain.merge(t)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(stream: DataFrame, table: str, checkpoint: str, action: str = "action", seq: str = "seq") -> StreamingQuery:
    """One pass over a log of actions I, U and D on whole rows: of each key the last one counts; a batch is one version."""

    def batch(df: DataFrame, n: int) -> None:
        t = KeyTable(df.sparkSession, table)
        keys = t._names()
        last = _last(df, keys, seq)
        rows = last.filter(F.col(action) != "D").select(*t.schema.names)
        gone = last.filter(F.col(action) == "D").select(*keys)
        t.apply(rows, gone)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    names = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*names), seq).alias("last")).select(*keys, "last.*")


def windows(events: DataFrame, ts: str, size: str, slide: str | None = None, late: str | None = None, by: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, by, n, total) of tumbling or sliding windows; late: how long a stream waits for rows that come late."""
    e = events.withWatermark(ts, late) if late else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return e.groupBy(w, by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, by: str, late: str | None = None) -> DataFrame:
    """(by, session_start, n): stretches of rows less than gap apart."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("session_start"), "n")
