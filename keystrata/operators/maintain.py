"""Keeping clustered tables in order: compaction, merging, online variants, key ranges and orphans."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata import config
from keystrata.sources.manifest import Conflict, File, Manifest, follows, sorted_prefix
from keystrata.sources.table import KeyTable

#: Passes over the change log before the last one.
PASSES = 10
#: Times that the last one is tried while others keep publishing.
TRIES = 50


def _keyed(t: KeyTable) -> None:
    if not t.manifest.key:
        raise ValueError(f"the table at {t.path} has no key to be in order of")


def compact(t: KeyTable, files: int | None = None) -> KeyTable:
    """All rows rewritten in order of the key."""
    _keyed(t)
    m = t.manifest
    if not m.files:
        return t._publish(m.order())
    return t._publish(replace(m, files=t._write(t._clustered(t._read(m.files), files or len(m.files)))).order())


def split_for_merge(m: Manifest) -> tuple[list[File], list[File]]:
    """(files that stay, files to rewrite): those of the sorted prefix that no later file's range meets stay."""
    n = sorted_prefix(m.files, m.key) if m.valid else 0
    tail = m.files[n:]
    if not tail:
        return m.files, []
    if any(None in f.span(0) for f in tail):
        return [], m.files
    low, high = min(f.span(0)[0] for f in tail), max(f.span(0)[1] for f in tail)
    meets = [f for f in m.files[:n] if f.span(0)[1] >= low and f.span(0)[0] <= high]
    # equal keys at a border may stay apart, but the rewritten stretch must be one
    gone = {f.path for f in meets}
    return [f for f in m.files[:n] if f.path not in gone], meets + tail


def _placed(m: Manifest, kept: list[File], made: list[File]) -> list[File]:
    files = kept + made
    if any(None in f.span(0) for f in files):
        return files
    return sorted(files, key=lambda f: f.span(0), reverse=bool(m.key) and not m.key[0][1])


def merge(t: KeyTable) -> KeyTable:
    """The files after the sorted prefix worked in; only files whose ranges meet are rewritten."""
    _keyed(t)
    m = t.manifest
    kept, old = split_for_merge(m)
    if not old:
        return t._publish(m.order()) if m.files and m != m.order() else t
    made = t._write(t._clustered(t._read(old), len(old)))
    return t._publish(replace(m, files=_placed(m, kept, made)).order())


def rebuild(t: KeyTable) -> KeyTable:
    """Key ranges and flags from the files themselves; their order stays."""
    m = t.manifest
    folders = sorted({f.path.rsplit("/", 1)[0] for f in m.files})
    found = {f.path: f for f in t.ranges(folders)} if folders else {}
    return t._publish(replace(m, files=[found[f.path] for f in m.files]).order())


def vacuum(t: KeyTable, keep_versions: int = 1, retain: float | None = None) -> list[str]:
    """Removes the files that no version in use names, and the versions before those; rebuilds ranges that aren't valid. The removed files.

    In use are the last versions and those that were the latest within retain seconds (by default the setting retainSeconds),
    for their readers' sake. Files that a writer has marked, of an online rewrite too, stay; so do orphans younger than retain.
    """
    retain = float(config.setting(t.spark, "retainSeconds")) if retain is None else retain
    if t.manifest.files and not t.manifest.valid and config.flag(t.spark, "vacuumRebuild"):
        rebuild(t)
    # in this order: what is written after the list is not in it, what is published after the marks were read is in a manifest
    there, marked = t.store.data_files(), t.store.marked()
    ages = t.store.ages()
    versions = list(ages)
    last = set(versions[-keep_versions:]) | {v for v, after in zip(versions, versions[1:]) if ages[after] < retain}
    named = {f.path for v in last for f in t.store.load(v).files}
    gone = [p for p, age in there if p not in named and p.split("/")[1] not in marked and age >= retain]
    for p in gone:
        t.store.delete(p)
    for v in versions:
        if v not in last:
            t.store.delete(f"_manifest/v{v:012d}.json")
    parts = {p.path for v in last for p in getattr(t.store.load(v).files, "parts", [])}
    for p, age in t.store.parts():
        if p not in parts and age >= max(retain, 3600):  # a publisher writes them just before its version
            t.store.delete(p)
    return gone


def prefix_sql(zones: DataFrame) -> DataFrame:
    """(sorted_prefix) of files (ord, min1, max1), by a window: how many of the first files begin no earlier than all before them end."""
    before = F.max("max1").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    z = zones.withColumn("bad", F.coalesce(F.col("min1") < before, F.lit(False)) | F.col("min1").isNull())
    return z.agg(F.coalesce(F.min(F.when(F.col("bad"), F.col("ord"))), F.count("*")).alias("sorted_prefix"))


class Online:
    """A rewrite beside readers and writers: begin() starts the change log and copies a snapshot; finish() replays the log and takes over.

    Changes are replayed by the whole key, the last one of a key winning, in at most PASSES passes and a last one; if another
    version is published in between, the last one is done again, after a longer and longer pause, at most TRIES times. Only
    entries of the log that a published version names are replayed. The table needs a primary key.
    """

    def __init__(self, t: KeyTable, merging: bool = False):
        _keyed(t)
        if not t.manifest.primary:
            raise ValueError("online maintenance follows changes by the key; the table has no primary key")
        self.t, self.merging = t, merging
        self.kept: list[File] = []
        self.made: list[File] = []
        self.seen = 0  # entries of the log that were replayed
        self.version = 0
        self.log = ""

    def begin(self) -> "Online":
        t = self.t.refresh()
        if t.manifest.log:
            raise Conflict(f"{t.manifest.log} says that {t.path} is being maintained already")
        self.log = f"_log/{int(time.time() * 1000):015d}"
        t._publish(replace(t.manifest, log=self.log, entries=[]))
        m = t.manifest
        self.version = m.version
        if self.merging:
            self.kept, old = split_for_merge(m)
        else:
            self.kept, old = [], m.files
        self.made = t._write(t._clustered(t._read(old), max(1, len(old)))) if old else []
        return self

    def changes(self) -> DataFrame | None:
        """The last action on each key that the log has after what was replayed."""
        t = self.t
        names = t.manifest.entries[self.seen :]
        if not names:
            return None
        keys = [k for k, _ in t.manifest.key]
        rows = t.spark.read.option("mergeSchema", "true").parquet(*(f"{t.path}/{self.log}/{n}" for n in names))
        # within a version a row's old key goes before its new one comes
        last = Window.partitionBy(*keys).orderBy(F.desc("__seq"), (F.col("__action") == "D").cast("int"))
        return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")

    def replay(self) -> bool:
        """Works in what came since; whether there was anything."""
        t = self.t.refresh()
        if t.manifest.log != self.log:
            raise Conflict(f"the maintenance of {t.path} was given up by another")
        found = self.changes()
        self.seen, self.version = len(t.manifest.entries), t.manifest.version
        if found is None:
            return False
        keys = [k for k, _ in t.manifest.key]
        names = [c.physical for c in t.manifest.columns]
        for c in names:  # a column that no entry has yet
            if c not in found.columns:
                found = found.withColumn(c, F.lit(None).cast(next(x.type for x in t.manifest.columns if x.physical == c)))
        of = t.at(t.manifest.version)
        of.manifest = replace(t.manifest, files=_placed(t.manifest, self.kept, self.made), valid=True)
        of._open = t._open
        logical = of._logical(found.select(*names))
        touched = logical.select(*of._names()).distinct()
        new = of._logical(found.filter("__action <> 'D'").select(*names))
        hit = of._hit(of.holding(touched.select(f"`{of._names()[0]}`")), lambda rows: rows.join(touched, of._names(), "left_semi"))
        files = of.manifest.files
        if not files or any(None in f.span(0) for f in files):
            made = t._write(t._clustered(of._physical(new)))
            files = of._rewritten(hit, lambda rows: rows.join(touched, of._names(), "left_anti").select(rows.columns)) + made
        else:
            new = of._owned(new)
            owners = {r[0] for r in new.select("__file").distinct().collect()}  # names of files
            both = {f.path for f in hit} | owners
            files = of._rewritten([f for f in files if f.path in both], lambda rows: rows.join(touched, of._names(), "left_anti").select(rows.columns), new)
        paths = {f.path for f in self.kept}
        self.kept, self.made = [f for f in files if f.path in paths], [f for f in files if f.path not in paths]
        return True

    def finish(self) -> KeyTable:
        t = self.t
        for _ in range(PASSES):
            if not self.replay():
                break
        for n in range(TRIES):
            self.replay()
            m = t.manifest
            try:
                t._publish(replace(m, files=_placed(m, self.kept, self.made), log=None, entries=[]).order())
            except Conflict:
                time.sleep(min(5.0, 0.05 * 2**n) * random.random())
                continue
            t.store.delete(self.log)
            return t
        raise Conflict(f"others kept writing to {t.path}")

    def abandon(self) -> KeyTable:
        t = self.t.refresh()
        if t.manifest.log == self.log:
            t._publish(replace(t.manifest, log=None, entries=[]))
        t.store.unmark(t._open)
        t._open = []
        t.store.delete(self.log)
        return t


def _online(t: KeyTable, merging: bool, meanwhile: Callable[[], None] | None) -> KeyTable:
    o = Online(t, merging).begin()
    try:
        if meanwhile:
            meanwhile()
        return o.finish()
    except BaseException:
        o.abandon()
        raise


def compact_online(t: KeyTable, meanwhile: Callable[[], None] | None = None) -> KeyTable:
    """compact() while others read and write; meanwhile is called between the copy and the replay."""
    return _online(t, False, meanwhile)


def merge_online(t: KeyTable, meanwhile: Callable[[], None] | None = None) -> KeyTable:
    return _online(t, True, meanwhile)


def last_writes(log: DataFrame, keys: list[str], seq: str, action: str) -> DataFrame:
    """The rows that a log of actions I, U and D leaves: each key's last one, unless that is D."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return log.withColumn("__n", F.row_number().over(w)).filter(f"__n = 1 AND `{action}` <> 'D'").drop("__n", action, seq)


def observability(t: KeyTable) -> dict[str, object]:
    m = t.manifest
    return {"version": m.version, "files": len(m.files), "rows": sum(f.rows for f in m.files), "valid": m.valid, "sorted": m.sorted, "prefix": m.prefix, "in_order": all(follows(a, b, m.key) for a, b in zip(m.files, m.files[1:]))}
