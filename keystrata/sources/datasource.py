"""Clustered tables for spark.read.format("keystrata") and SQL: filters on the key skip files before they are opened, and row groups.

The option scanPruning=false reads everything.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from keystrata.sources.manifest import File, Manifest, _files
from keystrata.sources.predicates import bounds
from keystrata.sources.table import pruned


def _root(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path.removeprefix("file:"))


def _latest(path: str) -> Manifest:
    fs, root = _root(path)
    names = sorted(f.base_name for f in fs.get_file_info(pa.fs.FileSelector(f"{root}/_manifest")) if f.base_name.startswith("v") and f.size > 0)
    with fs.open_input_stream(f"{root}/_manifest/{names[-1]}") as f:
        text = f.read().decode()

    def part(name: str) -> list[File]:
        with fs.open_input_stream(f"{root}/{name}") as f:
            return _files(json.loads(f.read().decode()))

    return Manifest.loads(text, part)


class Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, pruning: bool = True):
        self.path, self.names, self.pruning = path, schema.names, pruning
        self.m = _latest(path)
        self.where: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        ops = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if isinstance(f, In):
                self.where.append((f.attribute[0], "in", list(f.value)))
            elif type(f) in ops:
                self.where.append((f.attribute[0], ops[type(f)], f.value))
            yield f  # Spark evaluates them too

    def partitions(self) -> list[Part]:
        return [Part(f.path) for f in (pruned(self.m, self.where) if self.m.valid and self.pruning else self.m.files)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, root = _root(self.path)
        present = {c.name: c for c in self.m.columns}
        with fs.open_input_file(f"{root}/{part.path}") as f:
            file = pq.ParquetFile(f)
            there = set(file.schema_arrow.names)
            groups = self._groups(file.metadata)
            for batch in file.iter_batches(row_groups=groups, columns=[present[n].physical for n in self.names if present[n].physical in there]):
                cols = [batch[present[n].physical] if present[n].physical in there else pa.nulls(len(batch)) for n in self.names]
                yield pa.RecordBatch.from_arrays(cols, self.names)

    def _groups(self, meta: pq.FileMetaData) -> list[int]:
        """The row groups that can have rows for the filters, by the statistics in the footer."""
        at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        plain = {c.name: at[c.physical] for c in self.m.columns if c.physical in at and c.type in ("tinyint", "smallint", "int", "bigint", "string", "date")}
        ranges = {n: b for n, b in bounds([w for w in self.where if w[0] in plain]).columns.items()} if self.pruning else {}
        out = []
        for g in range(meta.num_row_groups):
            stats = {n: meta.row_group(g).column(plain[n]).statistics for n in ranges}
            try:
                if all(s is None or not s.has_min_max or ranges[n].meets(s.min, s.max) for n, s in stats.items()):
                    out.append(g)
            except TypeError:
                out.append(g)
        return out


class Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keystrata"

    def schema(self) -> str:
        return ", ".join(f"`{c.name}` {c.type}" for c in _latest(self.options["path"]).columns)

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, self.options.get("scanPruning", "true").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
