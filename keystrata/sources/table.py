"""Tables clustered by a key, with the key range of every file: predicates on the key read only the files that can match.

State of the ranges, per version:
  valid   ranges may rule files out
  sorted  the files are in order of the key
  prefix  so many of the first files are
A new or truncated table has none of these; compact, merge, rebuild and vacuum set them by what they find; appends take
sorted away; updates and upserts also shorten the prefix to the first file they touch; lazy updates take away all three;
deletes and changes of columns keep what the files still bear out.

Changes rewrite the files that hold rows they change, and no others: each stretch of neighbouring files is rewritten in its
own place. Rows that upsert() adds come after the others, as a run of their own.
"""

from __future__ import annotations

import calendar
import datetime as dt
import time
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from itertools import accumulate
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import StructField, StructType

from keystrata import config
from keystrata.sources.manifest import Column, Conflict, File, Files, Manifest, Part, Store, encode
from keystrata.sources.predicates import Predicate, bounds, condition

Key = str | tuple[str, bool]
DAY = dt.timedelta(days=1)


def _micros(v: dt.datetime) -> int:
    """The instant that Spark takes a datetime for: without a time zone it is a local time of this process."""
    seconds = calendar.timegm(v.utctimetuple()) if v.tzinfo else int(time.mktime(v.timetuple()))
    return seconds * 1_000_000 + v.microsecond


def _comparable(where: Predicate, kinds: dict[str, str]) -> Predicate:
    """The part of a predicate that can be compared with ranges, in their terms, or a weaker one: kinds are the columns' types."""
    out = []
    for name, op, value in where:
        kind = kinds.get(name)
        many = list(value) if op in ("between", "in") else [value]
        if any(isinstance(v, float) and not abs(v) < 2**53 for v in many):
            continue  # Spark compares such numbers as doubles
        if kind in ("timestamp", "timestamp_ntz") and any(v is not None for v in many):
            if not all(v is None or isinstance(v, dt.datetime) for v in many):
                continue
            if kind == "timestamp":
                many = [None if v is None else _micros(v) for v in many]
            else:  # the filter compares wall-clock times in the session's zone with this process's: no further apart than a day
                known = [v.replace(tzinfo=None) for v in many if v is not None]
                if op in ("=", "in"):
                    out.append((name, "between", (min(known) - DAY, max(known) + DAY)))
                elif op == "between" and None not in many:
                    out.append((name, op, (known[0] - DAY, known[1] + DAY)))
                elif op != "between":
                    out.append((name, op, known[0] + (DAY if op[0] == "<" else -DAY)))
                continue
            value = many if op in ("between", "in") else many[0]
        out.append((name, op, value))
    return out


def pruned(m: Manifest, where: Predicate) -> list[File]:
    """The files of a version that can have rows for which where holds, by its ranges."""
    by = {c.physical: c for c in m.columns}
    keys = [(i, by[k]) for i, (k, _) in enumerate(m.key[:2]) if k in by]
    ranges = bounds(_comparable(where, {c.name: c.type for _, c in keys})).columns
    if any(p[1] != "in" and (p[2] is None or p[1] == "between" and None in p[2]) for p in where):
        return []  # a comparison with null
    try:
        if any(b.empty() for b in ranges.values()):
            return []
    except TypeError:
        return m.files
    tracked = [(i, ranges[c.name]) for i, c in keys if c.name in ranges]

    def meets(x: File | Part) -> bool:
        try:
            return all(b.meets(*x.span(i)) for i, b in tracked)
        except TypeError:  # a literal of another type: the filter decides
            return True

    if isinstance(m.files, Files):
        return [f for p in m.files.parts if meets(p) for f in m.files.of(p) if meets(f)]
    return [f for f in m.files if meets(f)]


def _file() -> SparkColumn:
    """The path below the table's folder of the file that a row is read from."""
    return F.concat(F.lit("data/"), F.url_decode(F.substring_index(F.col("_metadata.file_path"), "/data/", -1)))


class ScanStats:
    """Files scanned and skipped by this process's scans."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.scans = self.scanned = self.pruned = 0

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.scans, self.scanned, self.pruned, "local")], "total_scans long, files_scanned long, files_pruned long, source string")


STATS = ScanStats()


#: Rows of a file, which a task sorts, beyond which there are more files than asked for.
ROWS = 1 << 21


class KeyTable:
    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        """The table at path, at its latest version or a given one."""
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, path)
        self.manifest = self.store.load(version)
        self._open: list[str] = []  # folders that this writer has filled and not published
        self._logged: list[str] = []  # entries of the change log, likewise

    # making and reading

    @staticmethod
    def create(spark: SparkSession, path: str, schema: StructType, key: list[Key], primary: bool = False) -> "KeyTable":
        """An empty table. primary: no two rows may share a key, and none may have a null in it."""
        names = [k if isinstance(k, str) else k[0] for k in key]
        for k in names:
            if k not in schema.names:
                raise ValueError(f"the key column {k} isn't among {', '.join(schema.names)}")
        columns = [Column(f.name, f.name, f.dataType.simpleString()) for f in schema.fields]
        Store(spark, path).publish(Manifest(1, columns, [(k, True) if isinstance(k, str) else k for k in key], primary))
        return KeyTable(spark, path)

    @staticmethod
    def load(df: DataFrame, path: str, key: list[Key], primary: bool = False, files: int | None = None) -> "KeyTable":
        """A table of df's rows, clustered."""
        t = KeyTable.create(df.sparkSession, path, df.schema, key, primary)
        t._unique(df)
        m = t.manifest
        found = t._write(t._clustered(t._physical(df), files))
        return t._publish(replace(m, files=found).order())

    def at(self, version: int) -> "KeyTable":
        return KeyTable(self.spark, self.path, version)

    def refresh(self) -> "KeyTable":
        self.manifest = self.store.load()
        self._logged = []
        return self

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(", ".join(f"`{c.name}` {c.type}" for c in self.manifest.columns)) if self.manifest.columns else StructType()

    def _read(self, files: Iterable[File]) -> DataFrame:
        """Rows of files, under their physical names."""
        schema = StructType([StructField(c.physical, f.dataType) for c, f in zip(self.manifest.columns, self.schema.fields)])
        paths = [f"{self.path}/{f.path}" for f in files]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _logical(self, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f"`{c.physical}`").alias(c.name) for c in self.manifest.columns))

    def _physical(self, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f"`{c.name}`").cast(c.type).alias(c.physical) for c in self.manifest.columns))

    def _names(self) -> list[str]:
        """The key columns by their present names."""
        by = {c.physical: c.name for c in self.manifest.columns}
        return [by[k] for k, _ in self.manifest.key if k in by]

    def candidates(self, where: Predicate) -> list[File]:
        """The files that can have rows for which where holds."""
        m = self.manifest
        if not m.valid or not config.flag(self.spark, "scanPruning") or not m.key:
            return m.files
        return pruned(m, where)

    def holding(self, keys: DataFrame) -> list[File]:
        """The files whose range of the first key column has any of keys' only column in it: each task looks its keys up and reports files."""
        m = self.manifest
        if not m.valid or not config.flag(self.spark, "scanPruning"):
            return m.files
        unknown = [i for i, f in enumerate(m.files) if None in f.span(0)]
        known = sorted((*f.span(0), i) for i, f in enumerate(m.files) if None not in f.span(0))
        held = self.spark.sparkContext.broadcast(([x[0] for x in known], [x[1] for x in known], list(accumulate((x[1] for x in known), max)), [x[2] for x in known]))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least, most, upto, number = held.value
            found: set[int] = set()
            for batch in batches:
                for k in batch["k"].to_pylist():
                    for i in range(bisect_left(upto, k), bisect_right(least, k)):
                        if most[i] >= k:
                            found.add(number[i])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["i"])

        k = F.col(f"`{keys.columns[0]}`").cast(self._kind(0))
        named = keys.select((F.unix_micros(k) if self._kind(0) == "timestamp" else k).alias("k")).filter("k IS NOT NULL")
        hit = {x["i"] for x in named.mapInArrow(find, "i int").distinct().collect()} if known else set()  # numbers of files
        files = list(m.files)
        return [files[i] for i in sorted(hit | set(unknown))]

    def _kind(self, i: int) -> str:
        """The type of a key column."""
        return next(c.type for c in self.manifest.columns if c.physical == self.manifest.key[i][0])

    def scan(self, where: Predicate | None = None) -> DataFrame:
        """The rows for which where holds."""
        files = self.candidates(where or [])
        STATS.scans += 1
        STATS.scanned += len(files)
        STATS.pruned += len(self.manifest.files) - len(files)
        return self._logical(self._read(files)).filter(condition(where or []))

    def lookup(self, keys: DataFrame, column: str | None = None) -> DataFrame:
        """The rows whose first key column is among keys' only column; files are skipped by the keys that come."""
        name = column or self._names()[0]
        found = keys.select(F.col(f"`{keys.columns[0]}`").alias("__k")).filter("__k IS NOT NULL")
        files = self.holding(found) if name == self._names()[0] else self.manifest.files
        STATS.scans += 1
        STATS.scanned += len(files)
        STATS.pruned += len(self.manifest.files) - len(files)
        return self._logical(self._read(files)).join(found, F.col(f"`{name}`") == F.col("__k"), "left_semi")

    def explain_scan(self, where: Predicate) -> DataFrame:
        """(files_total, files_scanned, files_pruned, n_ranges): n_ranges counts the stretches of consecutive files."""
        kept = {f.path for f in self.candidates(where)}
        at = [i for i, f in enumerate(self.manifest.files) if f.path in kept]
        ranges = sum(1 for i, x in enumerate(at) if not i or at[i - 1] != x - 1)
        n = len(self.manifest.files)
        return self.spark.createDataFrame([(n, len(at), n - len(at), ranges)], "files_total long, files_scanned long, files_pruned long, n_ranges long")

    # writing files

    def _order(self) -> list[Any]:
        return [F.col(f"`{k}`").asc_nulls_last() if asc else F.col(f"`{k}`").desc_nulls_first() for k, asc in self.manifest.key]

    def _clustered(self, df: DataFrame, files: int | None = None) -> DataFrame:
        if not self.manifest.key:
            return df
        n = max(files or int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))
        return df.repartitionByRange(n, *self._order()).sortWithinPartitions(*self._order())

    def _folder(self) -> str:
        """A new folder for data files, marked as being filled until this writer publishes."""
        folder = uuid.uuid4().hex
        self.store.mark(folder)
        self._open.append(folder)
        return f"data/{folder}"

    def _write(self, df: DataFrame) -> list[File]:
        """df, under physical names, as new files with their ranges, in order of their first keys."""
        folder = self._folder()
        df.write.parquet(f"{self.path}/{folder}")
        return self.ranges([folder])

    def _placed(self, found: list[File]) -> list[File]:
        """Files in order of their first keys; those that have none last."""
        asc = not self.manifest.key or self.manifest.key[0][1]
        known = sorted((f for f in found if None not in f.span(0)), key=lambda f: (*f.span(0), f.path) if asc else f.path)
        if not asc:
            known.sort(key=lambda f: f.span(0)[::-1], reverse=True)
        return known + sorted((f for f in found if None in f.span(0)), key=lambda f: f.path)

    def _footers(self, folders: list[str]) -> list[File] | None:
        """Rows and key ranges from the footers of local files; None where they don't tell."""
        if self.store.fs.getScheme() != "file":
            return None
        kinds = {c.physical: c.type for c in self.manifest.columns}
        keys = [k for k, _ in self.manifest.key[:2]]
        if any(kinds[k] not in ("tinyint", "smallint", "int", "bigint", "string", "date", "timestamp_ntz") for k in keys):
            return None
        plain = self.store._path.getPathWithoutSchemeAndAuthority
        names = []
        for folder in folders:
            files = self.store.fs.listFiles(self.store._path(f"{self.path}/{folder}"), True)
            while files.hasNext():
                name = plain(files.next().getPath()).toString()
                if name.endswith(".parquet"):
                    names.append(name)

        def one(name: str) -> File | None:
            meta = pq.read_metadata(name)
            at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
            ranges = []
            for k in keys:
                if k not in at:  # a file from before the column
                    ranges.append([None, None])
                    continue
                stats = [meta.row_group(g).column(at[k]).statistics for g in range(meta.num_row_groups)]
                if any(s is None or not s.has_min_max and s.num_values for s in stats):
                    return None
                some = [s for s in stats if s.has_min_max]
                ranges.append([min(s.min for s in some), max(s.max for s in some)] if some else [None, None])
            return File("data/" + name.rsplit("/data/", 1)[1], meta.num_rows, ranges)

        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(one, names))
        return None if None in found else [f for f in found if f.rows]

    def ranges(self, folders: list[str]) -> list[File]:
        """Rows and key ranges of the files there, from their footers or else from their key columns; one row for each on the driver."""
        found = self._footers(folders)
        if found is not None:
            return self._placed(found)
        keys = [k for k, _ in self.manifest.key[:2]]
        kinds = {c.physical: c.type for c in self.manifest.columns}
        schema = StructType([StructField(c.physical, f.dataType) for c, f in zip(self.manifest.columns, self.schema.fields)])
        aggs = [F.count("*").alias("n")]
        for i, k in enumerate(keys):
            c = F.unix_micros(F.col(f"`{k}`")) if kinds[k] == "timestamp" else F.col(f"`{k}`")
            aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{f}" for f in folders)).groupBy(_file().alias("p")).agg(*aggs).collect()
        return self._placed([File(r["p"], r["n"], [[r[f"lo{i}"], r[f"hi{i}"]] if encode(r[f"lo{i}"]) is not None else [None, None] for i in range(len(keys))]) for r in rows])

    def _publish(self, m: Manifest) -> "KeyTable":
        logged, self._logged = self._logged, []
        self.manifest = self.store.publish(replace(m, version=self.manifest.version + 1, entries=[*m.entries, *logged] if m.log else []))
        self.store.unmark(self._open)
        self._open = []
        return self

    def _undisturbed(self) -> None:
        if self.manifest.log:
            raise Conflict(f"{self.path} is being maintained; its files can't change their columns or key meanwhile")

    def _guarded(self, df: DataFrame, kept: DataFrame) -> None:
        """An error if the table, kept and df together, has two rows that share all columns of a guard; nulls are never shared."""
        by = {c.physical: c.name for c in self.manifest.columns}
        for guard in self.manifest.unique:
            names = [by[c] for c in guard if c in by]
            new = df.select(*(F.col(f"`{c}`") for c in names))
            old = kept.select(*(F.col(f"`{c}`") for c in names)).join(new, names, "left_semi")
            bad = new.union(old).dropna().groupBy(*(F.col(f"`{c}`") for c in names)).count().filter("count > 1").limit(1).collect()
            if bad:
                raise ValueError(f"({', '.join(names)}) stands twice: {bad[0].asDict()}")

    def _unique(self, df: DataFrame, also: DataFrame | None = None) -> None:
        if not self.manifest.primary:
            return
        keys = self._names()
        both = df.select(*keys) if also is None else df.select(*keys).union(also.select(*keys))
        bad = both.groupBy(*keys).count().filter(" OR ".join(["count > 1", *(f"`{k}` IS NULL" for k in keys)])).limit(1).collect()
        if bad:
            raise ValueError(f"the key ({', '.join(keys)}) is null or stands twice: {bad[0].asDict()}")

    # changing rows

    def _capture(self, action: str, df: DataFrame) -> None:
        """Rows, under physical names, to the change log, if one is kept; they count once a manifest names the entry."""
        if self.manifest.log:
            name = f"{self.manifest.version:012d}-{len(self._logged)}-{action}-{uuid.uuid4().hex}"
            df.withColumns({"__action": F.lit(action), "__seq": F.lit(self.manifest.version)}).write.parquet(f"{self.path}/{self.manifest.log}/{name}")
            self._logged.append(name)

    def append(self, df: DataFrame, files: int | None = None) -> "KeyTable":
        """df's rows, sorted among themselves, after the others."""
        m = self.manifest
        if m.primary:
            keys = self._names()
            self._unique(df, self._logical(self._read(self.holding(df.select(f"`{keys[0]}`")))).join(df.select(*keys), keys, "left_semi"))
        if m.unique:
            self._guarded(df, self._logical(self._read(m.files)))
        rows = self._physical(df)
        found = self._write(self._clustered(rows, files))
        self._capture("I", self._read(found))
        return self._publish(replace(m, files=m.files + found, sorted=m.sorted and not m.files or False))

    def _with_file(self, files: list[File]) -> DataFrame:
        """Rows of files by their columns' names, and the file as __file."""
        rows = self._read(files)
        return rows.select(*(F.col(f"`{c.physical}`").alias(c.name) for c in self.manifest.columns), _file().alias("__file")) if files else self._logical(rows).withColumn("__file", F.lit(""))

    def _hit(self, files: list[File], some: Callable[[DataFrame], DataFrame]) -> list[File]:
        """Those files that have any of the rows that some leaves: a name for each comes to the driver."""
        if not files:
            return []
        names = {r["__file"] for r in some(self._with_file(files)).select("__file").distinct().collect()}
        return [f for f in files if f.path in names]

    def _owned(self, rows: DataFrame) -> DataFrame:
        """rows with __file, the file that each can join without overlapping another, if none do: the last that begins no later, or the first."""
        known = sorted((f.span(0)[0], f.path) for f in self.manifest.files)
        held = self.spark.sparkContext.broadcast(([x[0] for x in known], [x[1] for x in known]))

        def owner(k: pa.Array) -> pa.Array:
            least, path = held.value
            return pa.array([path[0 if x is None else max(0, bisect_right(least, x) - 1)] for x in k.to_pylist()], pa.string())

        k = F.col(f"`{self._names()[0]}`").cast(self._kind(0))
        return rows.withColumn("__file", F.arrow_udf(owner, "string")(F.unix_micros(k) if self._kind(0) == "timestamp" else k))

    def _rewritten(self, old: list[File], change: Callable[[DataFrame], DataFrame], added: DataFrame | None = None) -> list[File]:
        """The table's files with old ones replaced by what change makes of their rows: each stretch of neighbours in its place. added: rows to put beside those of their __file."""
        m = self.manifest
        gone = {f.path for f in old}
        if not gone:
            return m.files
        stretch: dict[str, int] = {}
        files, before, n = list(m.files), None, -1
        for f in files:
            if f.path in gone:
                n += before not in gone
                stretch[f.path] = n
            before = f.path
        places = self.spark.createDataFrame(list(stretch.items()), "__file string, __stretch int")
        rows = change(self._with_file(old).join(places, "__file").drop("__file"))
        if added is not None:
            rows = rows.unionByName(added.join(places, "__file").drop("__file"))
        rows = rows.select(*(F.col(f"`{c.name}`").cast(c.type).alias(c.physical) for c in m.columns), "__stretch")
        order = [F.col("__stretch"), *self._order()]
        folder = self._folder()
        rows.repartitionByRange(len(gone), *order).sortWithinPartitions(*order).write.partitionBy("__stretch").parquet(f"{self.path}/{folder}")
        made: dict[int, list[File]] = {}
        for f in self.ranges([folder]):
            made.setdefault(int(f.path.split("/__stretch=")[1].split("/")[0]), []).append(f)
        out: list[File] = []
        done: set[int] = set()
        for f in files:
            n = stretch.get(f.path)
            if n is None:
                out.append(f)
            elif n not in done:
                done.add(n)
                out += made.get(n, [])
        return out

    def _touched(self, old: list[File]) -> int:
        """Place of the first of these files."""
        gone = {f.path for f in old}
        return next((i for i, f in enumerate(self.manifest.files) if f.path in gone), len(self.manifest.files))

    def update(self, changes: dict[str, Any], where: Predicate | None = None, lazy: bool | None = None) -> "KeyTable":
        """Sets columns, to values or Columns, where the predicate holds."""
        m, where = self.manifest, where or []
        lazy = config.flag(self.spark, "lazyUpdate") if lazy is None else lazy
        hit = F.coalesce(condition(where), F.lit(False))
        old = self._hit(self.candidates(where), lambda rows: rows.filter(hit))
        if not old:
            return self
        types = {c.name: c.type for c in m.columns}
        value = {c: (v if hasattr(v, "_jc") else F.lit(v)).cast(types[c]) for c, v in changes.items()}

        def changed(rows: DataFrame) -> DataFrame:
            return rows.select(*(F.when(hit, value[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in changes else F.col(f"`{c}`") for c in rows.columns))

        moves = any(k in changes for k in self._names())
        rows = self._logical(self._read(old))
        if moves and m.primary:
            rest = [f for f in m.files if f.path not in {o.path for o in old}]
            self._unique(changed(rows), self._logical(self._read(rest)))
        if any(c in {x.physical for x in m.columns if x.name in changes} for guard in m.unique for c in guard):
            rest = [f for f in m.files if f.path not in {o.path for o in old}]
            self._guarded(changed(rows), self._logical(self._read(rest)))
        if m.log:
            if moves:
                self._capture("D", self._physical(rows.filter(hit)))
            self._capture("I" if moves else "U", self._physical(rows.filter(hit).select(*(value[c].alias(c) if c in changes else F.col(f"`{c}`") for c in rows.columns))))
        now = m.still(self._rewritten(old, changed))
        if lazy and m.valid:
            return self._publish(replace(now, valid=False, sorted=False, prefix=0))
        return self._publish(replace(now, sorted=False, prefix=min(now.prefix, self._touched(old))))

    def delete(self, where: Predicate | None = None) -> "KeyTable":
        m, where = self.manifest, where or []
        hit = F.coalesce(condition(where), F.lit(False))
        old = self._hit(self.candidates(where), lambda rows: rows.filter(hit))
        if not old:
            return self
        if m.log:
            self._capture("D", self._physical(self._logical(self._read(old)).filter(hit)))
        return self._publish(m.still(self._rewritten(old, lambda rows: rows.filter(~hit))))

    def upsert(self, df: DataFrame) -> "KeyTable":
        """df's rows in place of those with their keys, or after the others; of several rows of df with one key the greatest."""
        return self.apply(df)

    def apply(self, df: DataFrame, gone: DataFrame | None = None) -> "KeyTable":
        """One version with df's rows upserted and those with gone's keys deleted; a key that is in both is upserted."""
        m = self.manifest
        if not m.primary:
            raise ValueError("upsert needs a table with a primary key")
        keys, names = self._names(), self.schema.names
        rest = [c for c in names if c not in keys]
        types = {f.name: f.dataType for f in self.schema.fields}
        df = df.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) for c in names))
        try:
            df = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__last")).select(*keys, "__last.*").select(*names) if rest else df.distinct()
        except AnalysisException:  # values without an order
            df = df.dropDuplicates(keys)
        staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
        try:
            # the rows are read several times; where they come from needn't give the same twice
            df.withColumn("__gone", F.lit(False)).write.parquet(staged)
            if gone is not None:
                dead = gone.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) for c in keys)).distinct()
                dead.select(*keys, *(F.lit(None).cast(types[c]).alias(c) for c in rest), F.lit(True).alias("__gone")).write.mode("append").parquet(staged)
            every = self.spark.read.schema(df.withColumn("__gone", F.lit(False)).schema).parquet(staged)
            df = every.filter("NOT __gone").drop("__gone")
            bad = df.filter(" OR ".join(f"`{k}` IS NULL" for k in keys)).limit(1).collect()
            if bad:
                raise ValueError(f"the key ({', '.join(keys)}) is null: {bad[0].asDict()}")
            if gone is not None:
                dead = every.filter("__gone").select(*keys).join(df.select(*keys), keys, "left_anti")
            touched = every.select(*keys).distinct()
            old = self._hit(self.holding(every.select(f"`{keys[0]}`")), lambda rows: rows.join(touched, keys, "left_semi"))
            if m.unique:
                self._guarded(df, self._logical(self._read(m.files)).join(touched, keys, "left_anti"))
            if gone is not None and m.log:
                self._capture("D", self._physical(self._logical(self._read(old)).join(dead, keys, "left_semi").select(*names)))
            if m.log:
                self._capture("U", self._physical(df))
            added = df
            if old:
                added = df.join(self._logical(self._read(old)).select(*keys), keys, "left_anti").select(*names)
            added = self._physical(added)
            made = self._write(self._clustered(added))

            # what becomes of a key, each once: one pass over the files' rows
            new = df.select(*keys, *(F.col(f"`{c}`").alias(f"__new{i}") for i, c in enumerate(rest)), F.lit(False).alias("__gone"))
            if gone is not None:
                new = new.unionByName(dead.withColumn("__gone", F.lit(True)), allowMissingColumns=True)
            at = {c: f"__new{i}" for i, c in enumerate(rest)}

            def changed(rows: DataFrame) -> DataFrame:
                both = rows.join(new, keys, "left").filter(~F.coalesce("__gone", F.lit(False)))
                return both.select(*(F.when(F.col("__gone").isNull(), F.col(f"`{c}`")).otherwise(F.col(at[c])).alias(c) if c in at else F.col(f"`{c}`") for c in names), "__stretch")

            if not old and not made:
                self.store.unmark(self._open)
                self._open = []
                return self
            now = m.still(self._rewritten(old, changed))
            return self._publish(replace(now, files=now.files + made, sorted=False, prefix=min(now.prefix, self._touched(old))))
        finally:
            self.store.delete(staged.removeprefix(f"{self.path}/"))

    def truncate(self) -> "KeyTable":
        if self.manifest.log:
            self._capture("D", self._read(self.manifest.files))
        return self._publish(replace(self.manifest, files=[], valid=False, sorted=False, prefix=0))

    # changing columns

    def add_column(self, name: str, type: str) -> "KeyTable":
        """A column that is null in the rows so far."""
        if name in self.schema.names:
            raise ValueError(f"there is a column {name}")
        return self._publish(replace(self.manifest, columns=[*self.manifest.columns, Column(name, f"{name}_{uuid.uuid4().hex[:8]}", type)]))

    def drop_column(self, name: str) -> "KeyTable":
        if name in self._names():
            raise ValueError(f"{name} is a key column; drop the key first")
        if any(self._column(name).physical in guard for guard in self.manifest.unique):
            raise ValueError(f"{name} is guarded; drop the guard first")
        return self._publish(replace(self.manifest, columns=[c for c in self.manifest.columns if c.name != name]))

    def rename_column(self, name: str, to: str) -> "KeyTable":
        self._column(name)
        if to in self.schema.names:
            raise ValueError(f"there is a column {to}")
        return self._publish(replace(self.manifest, columns=[replace(c, name=to) if c.name == name else c for c in self.manifest.columns]))

    def alter_type(self, name: str, type: str) -> "KeyTable":
        """All rows rewritten with the column cast; their order has to be found again."""
        self._undisturbed()
        old = self._column(name)
        rows = self._logical(self._read(self.manifest.files)).withColumn(name, F.col(f"`{name}`").cast(type))
        columns = [replace(c, type=type, physical=f"{c.name}_{uuid.uuid4().hex[:8]}") if c.name == name else c for c in self.manifest.columns]
        physical = next(c.physical for c in columns if c.name == name)
        key = [(physical if k == old.physical else k, asc) for k, asc in self.manifest.key]
        was = self.manifest
        self.manifest = replace(was, columns=columns, key=key, unique=[[physical if c == old.physical else c for c in g] for g in was.unique])
        found = self._write(self._clustered(self._physical(rows), max(1, len(was.files))))
        return self._publish(replace(self.manifest, files=found, valid=False, sorted=False, prefix=0))

    def drop_key(self) -> "KeyTable":
        self._undisturbed()
        return self._publish(replace(self.manifest, key=[], primary=False, valid=False, sorted=False, prefix=0))

    def set_key(self, key: list[Key], primary: bool = False) -> "KeyTable":
        """A key for a table without one; compact() then clusters the rows by it."""
        self._undisturbed()
        by = {c.name: c.physical for c in self.manifest.columns}
        pairs = [(k, True) if isinstance(k, str) else k for k in key]
        was = self.manifest
        self.manifest = replace(was, key=[(by[k], asc) for k, asc in pairs], primary=primary)
        try:
            self._unique(self._logical(self._read(was.files)))
        except ValueError:
            self.manifest = was
            raise
        return self._publish(replace(self.manifest, valid=False, sorted=False, prefix=0))

    def add_unique(self, columns: list[str]) -> "KeyTable":
        """From now on no two rows may share all these columns; nulls are never shared. Rewrites keep the guard."""
        guard = [self._column(c).physical for c in columns]
        was = self.manifest
        self.manifest = replace(was, unique=[*was.unique, guard])
        try:
            every = self._logical(self._read(was.files))
            self._guarded(every, every.limit(0))
        except ValueError:
            self.manifest = was
            raise
        return self._publish(self.manifest)

    def drop_unique(self, columns: list[str]) -> "KeyTable":
        guard = [self._column(c).physical for c in columns]
        return self._publish(replace(self.manifest, unique=[g for g in self.manifest.unique if g != guard]))

    def _column(self, name: str) -> Column:
        for c in self.manifest.columns:
            if c.name == name:
                return c
        raise ValueError(f"there is no column {name}")

    # looking at the table

    def zones(self) -> DataFrame:
        """(ord, path, rows, min1, max1, min2, max2), values as strings, of each file."""
        text = lambda v: None if v is None else str(v)
        rows = [(i, f.path, f.rows, *map(text, f.span(0)), *map(text, f.span(1))) for i, f in enumerate(self.manifest.files)]
        return self.spark.createDataFrame(rows, "ord long, path string, rows long, min1 string, max1 string, min2 string, max2 string")

    def zone_stats(self) -> str:
        """One line: version, files, key, flags, prefix, and the first five files' ranges."""
        m = self.manifest
        flags = ",".join(n for n, on in (("valid", m.valid), ("sorted", m.sorted)) if on) or "none"
        first = "".join(f" [{i}:{f.span(0)[0]}..{f.span(0)[1]}" + (f" c2:{f.span(1)[0]}..{f.span(1)[1]}" if len(f.ranges) > 1 else "") + "]" for i, f in enumerate(m.files[:5]))
        return f"version={m.version} nentries={len(m.files)} key={','.join(self._names())} flags={flags} sorted_prefix={m.prefix}{first}"

    def inversions(self) -> DataFrame:
        """(inversions): rows whose first key is less than that of the row before them in the same file, and files that begin before the last one's end."""
        if not self.manifest.files:
            return self.spark.createDataFrame([(0,)], "inversions long")
        k = f"`{self.manifest.key[0][0]}`"
        asc = self.manifest.key[0][1]
        paths = {f.path: i for i, f in enumerate(self.manifest.files)}
        rows = self._read(self.manifest.files).select(F.col(k).alias("k"), _file().alias("f"), F.col("_metadata.row_index").alias("i"))
        inside = rows.withColumn("before", F.lag("k").over(Window.partitionBy("f").orderBy("i")))
        n = F.sum(((F.col("k") < F.col("before")) if asc else (F.col("k") > F.col("before"))).cast("long"))
        each = inside.groupBy("f").agg(F.coalesce(n, F.lit(0)).alias("n"), F.min("k").alias("least"), F.max("k").alias("most"))
        place = self.spark.createDataFrame(list(paths.items()), "f string, ord long")
        across = each.join(place, "f").withColumn("last", F.lag("most" if asc else "least").over(Window.partitionBy().orderBy("ord")))  # a row for each file
        across = across.withColumn("n", F.col("n") + F.coalesce((F.col("least") < F.col("last")) if asc else (F.col("most") > F.col("last")), F.lit(False)).cast("long"))
        return across.agg(F.sum("n").alias("inversions"))
