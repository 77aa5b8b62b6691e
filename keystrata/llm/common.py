"""What the operators share: reading tables, cutting lineage, column names that can't clash."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, where all executors read and write; a local folder only where that is unset and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="keystrata-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """df, written as a table in the shared folder: later steps read it, column by column, and the loss of an executor loses nothing. made gets its path."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Deletes tables that cut() wrote and that nothing reads any more."""
    for path in made:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    made.clear()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, which gives its memory back when it ends: a worker outlives its tasks, and holds on to what they took."""

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return leave


def place(df: DataFrame, name: str) -> int:
    """Where the column of exactly this name stands, or else the only one of this name in other letter cases."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not found or df.columns[found[0]] != name and len(found) > 1:
        raise ValueError(f"there is no column {name} among {', '.join(df.columns)}")
    return found[0]


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns called c0, c1, …, and what the named ones are called there: no name of the caller's can clash, in any case of letters."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), [f"c{place(df, n)}" for n in names]


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra columns and their names never matter."""
    plain, names = numbered(df, *columns.values())
    return plain.select(*(F.col(old).alias(new) for new, old in zip(columns, names)))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of exactly these names."""
    plain, _ = numbered(df)
    kept = [i for i, c in enumerate(df.columns) if c not in names]
    return plain.select(*(f"c{i}" for i in kept)).toDF(*(df.columns[i] for i in kept))


def integers(df: DataFrame, *names: str) -> None:
    """An error, before any row is read, unless the columns hold integers."""
    for n in names:
        kind = df.schema.fields[place(df, n)].dataType
        if not isinstance(kind, (IntegralType, NullType)):
            raise TypeError(f"{n} is of type {kind.simpleString()}; ids have to be integers")


def unit(seed: int, *columns: str | Column) -> Column:
    """A reproducible uniform in (0, 1) from the columns' values; DuckDB's md5 gives the same, see unit_sql()."""
    text = F.concat_ws("/", F.lit(str(seed)), *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in columns))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def unit_sql(seed: int, *columns: str) -> str:
    parts = ", ".join(f"coalesce(cast({c} AS VARCHAR), 'null')" for c in columns)
    return f"((cast('0x' || substr(md5(concat_ws('/', '{seed}', {parts})), 1, 12) AS BIGINT) + 0.5) / {float(1 << 48)})"
