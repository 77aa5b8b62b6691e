import random

import pytest
from pyspark.sql import functions as F

from keystrata.operators import maintain
from keystrata.sources import datasource
from keystrata.sources.manifest import Conflict
from keystrata.sources.table import STATS, KeyTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def base(spark, tmp_path):
    data = [(i, i % 7 if i % 11 else None, f"n{i:05d}") for i in random.Random(1).sample(range(400), 400)]
    return spark.createDataFrame(data, "id long, a int, name string"), f"file://{tmp_path}/t"


def flags(t):
    return t.manifest.valid, t.manifest.sorted, t.manifest.prefix


def test_pruned_scans_equal_full_ones(spark, base):
    df, path = base
    t = KeyTable.load(df, path, ["id", "a"], files=6)
    n = len(t.manifest.files)
    assert flags(t) == (True, True, n) and rows(t.inversions()) == [(0,)]
    r = random.Random(2)
    for _ in range(6):
        a, b = r.randrange(-20, 420), r.randrange(-20, 420)
        where = r.choice([[("id", "between", (a, b))], [("id", ">", a), ("a", "=", 3)], [("id", "in", [a, b, None])], [("a", "<=", 2), ("id", "<", b)], [("id", "=", a)]])
        got = rows(t.scan(where))
        spark.conf.set("spark.keystrata.scanPruning", "false")
        assert len(t.candidates(where)) == n
        assert got == rows(t.scan(where))
        spark.conf.unset("spark.keystrata.scanPruning")
    total, scanned, pruned, ranges = t.explain_scan([("id", "in", [3, 390])]).first()
    assert (total, scanned, pruned, ranges) == (n, 2, n - 2, 2)
    STATS.reset()
    t.scan([("id", "=", 5)])
    assert tuple(STATS.frame(spark).first()) == (1, 1, n - 1, "local")
    # the data source sees the same
    datasource.register(spark)
    s = spark.read.format("keystrata").load(path)
    assert rows(s.filter("id > 100 AND id <= 120")) == rows(t.scan([("id", ">", 100), ("id", "<=", 120)]))


def test_states_and_row_changes(spark, base):
    df, path = base
    t = KeyTable.create(spark, path, df.schema, ["id"], primary=True)
    assert flags(t) == (False, False, 0)
    t.append(df.filter("id < 200"), 3)
    assert flags(t) == (False, False, 0) and len(t.candidates([("id", "=", 1)])) == 3
    maintain.compact(t)
    assert flags(t) == (True, True, len(t.manifest.files))
    old = t.at(t.manifest.version)
    k = t.manifest.prefix
    t.append(df.filter("id >= 200"), 3)
    assert flags(t) == (True, False, k)
    kept = {f.path for f in t.manifest.files[:k]}
    maintain.merge(t)
    assert kept <= {f.path for f in t.manifest.files} and rows(t.scan()) == rows(df)  # nothing overlapped
    assert flags(t)[:2] == (True, True) and rows(t.inversions()) == [(0,)]
    t.delete([("id", "between", (50, 60))])
    assert flags(t)[:2] == (True, True) and t.scan().count() == 389
    t.update({"name": F.concat("name", F.lit("x"))}, [("id", "=", 100)])
    assert not t.manifest.sorted and t.manifest.valid and rows(t.scan([("id", "=", 100)]))[0][2] == "n00100x"
    t.upsert(spark.createDataFrame([(100, 1, "u"), (1000, 2, "v")], df.schema))
    assert rows(t.scan([("id", ">=", 100)]).filter("name IN ('u', 'v')")) == [(100, 1, "u"), (1000, 2, "v")]
    t.update({"a": 0}, [("id", "=", 3)], lazy=True)
    assert flags(t) == (False, False, 0)
    assert maintain.vacuum(t, retain=0) and t.manifest.valid
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(1000, 2, "v")], df.schema))
    with pytest.raises(Conflict):
        t.store.publish(t.manifest)
    t.truncate()
    assert flags(t) == (False, False, 0) and t.scan().count() == 0
    assert old.manifest.version < t.manifest.version


def test_columns_and_errors(spark, base):
    df, path = base
    with pytest.raises(ValueError):
        KeyTable.create(spark, path, df.schema, ["nothing"])
    t = KeyTable.load(df, path, ["id"], files=3)
    t.add_column("note", "string").rename_column("name", "title")
    assert t.scan([("id", "=", 7)]).columns == ["id", "a", "title", "note"] and t.manifest.valid
    with pytest.raises(ValueError):
        t.drop_column("id")
    t.alter_type("a", "bigint")
    assert not t.manifest.valid and dict(t.scan().dtypes)["a"] == "bigint"
    t.drop_key()
    with pytest.raises(ValueError):
        maintain.compact(t)
    maintain.compact(t.set_key([("id", False)]))
    assert rows(t.scan([("id", ">", 395)]).select("id")) == [(i,) for i in range(396, 400)] and rows(t.inversions()) == [(0,)]


def test_online_maintenance_keeps_what_others_write(spark, base):
    df, path = base
    t = KeyTable.create(spark, path, df.schema, ["id"], primary=True)
    t.append(df.filter("id % 2 = 0"), 2).append(df.filter("id % 2 = 1"), 2)

    def meanwhile():
        other = KeyTable(spark, path)
        other.update({"id": F.col("id") + 1000}, [("id", "between", (10, 12))])  # keys that move
        other.delete([("id", "=", 20)])
        with pytest.raises(Conflict):
            maintain.compact_online(KeyTable(spark, path))

    maintain.compact_online(t, meanwhile)
    got = rows(t.scan().select("id"))
    assert got == sorted(((i + 1000,) if 10 <= i <= 12 else (i,) for i in range(400) if i != 20), key=repr)
    assert flags(t)[:2] == (True, True) and t.manifest.log is None

    def fails():
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        maintain.merge_online(t, fails)
    assert t.refresh().manifest.log is None and t.scan().count() == 399


def test_orphans_of_a_writer_that_broke_off(spark, base):
    df, path = base
    t = KeyTable.load(df, path, ["id"], files=2)
    df.write.parquet(f"{path}/data/orphan")
    assert t.refresh().scan().count() == 400
    assert maintain.vacuum(t) == []  # it may be younger than its writer's mark
    gone = maintain.vacuum(t, retain=0)
    assert gone and all("orphan" in g for g in gone) and t.scan().count() == 400


def truth(t):
    """Whether the flags claim no more than the files bear out, and the files no other ranges than their rows have."""
    m = t.manifest
    real = m.order()
    found = {f.path: f for f in t.ranges(sorted({"/".join(f.path.split("/")[:2]) for f in m.files}))} if m.files else {}
    return (not m.sorted or real.sorted) and m.prefix <= real.prefix and all(found[f.path] == f for f in m.files)


def test_deleting_from_files_far_apart(spark, tmp_path):
    df = spark.range(1600).selectExpr("id AS k", "id % 5 AS v")
    t = KeyTable.load(df, f"{tmp_path}/t", ["k"], files=16)
    before = [f.path for f in t.manifest.files]
    t.delete([("k", "in", [f.span(0)[0] for f in (t.manifest.files[2], t.manifest.files[9])])])
    after = [f.path for f in t.manifest.files]
    assert len(set(before) - set(after)) == 2 and truth(t) and flags(t) == (True, True, 16)
    assert rows(t.inversions()) == [(0,)] and t.scan().count() == 1598
    t.update({"v": -1}, [("k", "in", [5, 1500])])
    assert len(set(after) - {f.path for f in t.manifest.files}) == 2 and truth(t) and not t.manifest.sorted
    maintain.merge(t)
    assert flags(t) == (True, True, 16)


def test_flags_after_any_changes(spark, tmp_path):
    r = random.Random(8)
    t = KeyTable.load(spark.range(0, 600, 2).selectExpr("id AS k", "0 AS v"), f"{tmp_path}/t", ["k"], primary=True, files=8)
    want = {k: 0 for k in range(0, 600, 2)}
    for i in range(1, 13):
        what = r.choice(["append", "delete", "update", "move", "upsert", "merge"])
        some = r.sample(sorted(want), 3)
        if what == "append":
            new = [k for k in r.sample(range(1, 900, 2), 6) if k not in want]
            t.append(spark.createDataFrame([(k, i) for k in new], "k long, v int"), 1)
            want |= {k: i for k in new}
        elif what == "delete":
            t.delete([("k", "in", some)])
            want = {k: v for k, v in want.items() if k not in some}
        elif what == "update":
            t.update({"v": i}, [("k", "in", some)])
            want |= {k: i for k in some}
        elif what == "move":
            t.update({"k": F.col("k") + 10_000 * i}, [("k", "=", some[0])])
            want[some[0] + 10_000 * i] = want.pop(some[0])
        elif what == "upsert":
            t.upsert(spark.createDataFrame([(k, i) for k in (*some, 20_000 + i)], "k long, v int"))
            want |= {k: i for k in (*some, 20_000 + i)}
        else:
            maintain.merge(t)
            assert t.manifest.sorted and t.manifest.prefix == len(t.manifest.files) and rows(t.inversions()) == [(0,)]
        assert truth(t), what
    assert dict(rows(t.scan())) == want


def test_upsert_rewrites_only_files_with_its_keys(spark, tmp_path):
    t = KeyTable.load(spark.range(0, 3200, 2).selectExpr("id AS k", "0 AS v"), f"{tmp_path}/t", ["k"], primary=True, files=32)
    before = {f.path for f in t.manifest.files}
    t.upsert(spark.createDataFrame([(10, 1), (3000, 2), (10, 0)], "k long, v int"))
    assert len(before - {f.path for f in t.manifest.files}) == 2
    assert rows(t.scan().filter("v > 0")) == [(10, 1), (3000, 2)] and t.scan().count() == 1600
    # keys of which no file's range tells, however many there are
    keys = spark.range(11_000).selectExpr("CASE WHEN id % 2 = 0 THEN 6 ELSE 3100 END AS k")
    STATS.reset()
    assert t.lookup(keys).count() == 2 and STATS.scanned <= 2


def test_a_failed_writer_leaves_no_trace(spark, base):
    df, path = base
    t = KeyTable.load(df, path, ["id"], primary=True, files=3)
    o = maintain.Online(t).begin()
    one, two = KeyTable(spark, path), KeyTable(spark, path)
    one.append(spark.createDataFrame([(200_000, 1, "in")], df.schema))
    with pytest.raises(Conflict):
        two.append(spark.createDataFrame([(300_000, 1, "out")], df.schema))
    o.finish()
    assert {r[0] for r in KeyTable(spark, path).scan([("id", ">=", 400)]).collect()} == {200_000}


def test_vacuum_beside_writers_and_readers(spark, base):
    df, path = base
    t = KeyTable.load(df, path, ["id"], primary=True, files=3)
    o = maintain.Online(t).begin()
    maintain.vacuum(KeyTable(spark, path), retain=0)
    o.finish()
    assert KeyTable(spark, path).scan().count() == 400
    # between an append's files and its version
    w = KeyTable(spark, path)
    publish = w._publish
    w._publish = lambda m: (maintain.vacuum(KeyTable(spark, path), retain=0), publish(m))[1]
    w.append(spark.createDataFrame([(900, 1, "x")], df.schema))
    assert KeyTable(spark, path).scan().count() == 401
    # a reader of an older version
    reader = KeyTable(spark, path)
    maintain.compact(w)
    maintain.vacuum(w)
    assert reader.scan().count() == 401
    maintain.vacuum(w, retain=0)
    assert w.store.versions() == [w.manifest.version] and w.scan().count() == 401


def test_ranges_don_t_depend_on_the_time_zone(spark, tmp_path):
    import datetime as dt
    import os
    import time

    zone = os.environ.get("TZ")
    df = spark.sql("SELECT id, TIMESTAMP '2024-01-01 00:00:00 UTC' + make_dt_interval(0, cast(id AS int)) AS ts FROM range(100)")
    try:
        os.environ["TZ"] = "America/New_York"
        time.tzset()
        KeyTable.load(df, f"{tmp_path}/t", ["ts"], files=6)
        os.environ["TZ"] = "UTC"
        time.tzset()
        t = KeyTable(spark, f"{tmp_path}/t")
        for at in (dt.datetime(2024, 1, 4, 0), dt.datetime(2024, 1, 3, 19, tzinfo=dt.timezone(dt.timedelta(hours=-5)))):
            assert t.scan([("ts", ">=", at)]).count() == 28 and t.scan([("ts", "=", at)]).count() == 1
            assert len(t.candidates([("ts", ">=", at)])) < len(t.manifest.files)
    finally:
        os.environ.pop("TZ") if zone is None else os.environ.__setitem__("TZ", zone)
        time.tzset()


def test_what_a_broken_off_publisher_left(spark, base):
    df, path = base
    t = KeyTable.load(df, path, ["id"], files=2)
    t.store.fs.create(t.store._name(t.manifest.version + 1), False).close()
    t.store.fs.create(t.store._path(f"{path}/_manifest/.draft"), False).close()
    again = KeyTable(spark, path)
    assert again.manifest == t.manifest
    again.append(df.limit(1))
    assert KeyTable(spark, path).scan().count() == 401


def test_tables_of_the_first_format(spark):
    from keystrata.sources.manifest import Manifest

    old = """{"version": 3, "columns": [{"name": "ts", "physical": "ts", "type": "timestamp"}, {"name": "n", "physical": "n", "type": "int"}], "key": [["ts", true], ["n", true]], "primary": false,
        "valid": true, "sorted": true, "prefix": 1, "files": [{"path": "data/a/b.parquet", "rows": 1, "ranges": [[{"ts": "2024-01-01T00:00:00"}, {"ts": "2024-01-02T00:00:00"}], [1, 2]]}], "log": null, "format": 1}"""
    m = Manifest.loads(old)
    assert m.files[0].ranges == [[None, None], [1, 2]] and not m.sorted and Manifest.loads(m.dumps()) == m


def test_columns_stay_while_the_table_is_maintained(spark, base):
    df, path = base
    t = KeyTable.load(df, path, ["id"], primary=True, files=2)
    o = maintain.Online(t).begin()
    with pytest.raises(Conflict):
        KeyTable(spark, path).alter_type("a", "bigint")
    KeyTable(spark, path).add_column("note", "string").update({"note": "n"}, [("id", "=", 3)])
    o.finish()
    assert rows(KeyTable(spark, path).scan([("id", "<", 5)]).select("id", "note")) == [(0, None), (1, None), (2, None), (3, "n"), (4, None)]


def test_manifests_in_parts(spark, tmp_path, monkeypatch):
    from keystrata.sources import manifest

    monkeypatch.setattr(manifest, "PART", 4)
    df = spark.range(0, 2000, 2).selectExpr("id AS k", "id AS v")
    t = KeyTable.load(df, f"{tmp_path}/t", ["k"], primary=True, files=18)
    u = KeyTable(spark, f"{tmp_path}/t")
    assert len(u.manifest.files.parts) == 5 and not u.manifest.files._held
    assert u.scan([("k", "=", 10)]).count() == 1 and len(u.manifest.files._held) == 1  # other parts aren't opened
    before = {p.path for p in u.manifest.files.parts}
    u.update({"v": -1}, [("k", "=", 10)])
    assert len(before - {p.path for p in u.manifest.files.parts}) == 1
    u.append(spark.createDataFrame([(3, 3), (5000, 1)], "k long, v long"), 1)
    maintain.merge(u)
    assert truth(u) and u.manifest.sorted and KeyTable(spark, f"{tmp_path}/t").scan().count() == 1002
    datasource.register(spark)
    assert spark.read.format("keystrata").load(f"{tmp_path}/t").filter("k >= 1998").count() == 2
    maintain.compact_online(u)
    maintain.vacuum(u, retain=0)
    assert rows(u.scan([("k", "<", 8)])) == [(0, 0), (2, 2), (3, 3), (4, 4), (6, 6)] and t.manifest.version < u.manifest.version


def test_guards_survive_rewrites(spark, base):
    df, path = base
    t = KeyTable.load(df, path, ["id"], primary=True, files=3)
    with pytest.raises(ValueError):
        t.add_unique(["a"])
    t.add_unique(["name"])
    maintain.compact(t)
    for change in (lambda: t.append(spark.createDataFrame([(900, 1, "n00007")], df.schema)), lambda: t.update({"name": "same"}, [("id", "<", 3)]), lambda: t.upsert(spark.createDataFrame([(3, 1, "n00007")], df.schema))):
        with pytest.raises(ValueError, match="stands twice"):
            change()
        t.refresh()
    with pytest.raises(ValueError):
        t.drop_column("name")
    t.append(spark.createDataFrame([(900, 1, None), (901, 1, None)], df.schema)).upsert(spark.createDataFrame([(7, 1, "n00007")], df.schema))
    t.drop_unique(["name"]).append(spark.createDataFrame([(902, 1, "n00007")], df.schema))
    assert t.scan().count() == 403


def test_what_is_said_of_a_table(spark, base):
    import keystrata

    df, path = base
    t = KeyTable.load(df, path, ["id", "a"], files=3)
    seen = maintain.observability(t)
    assert (seen["files"], seen["rows"], seen["valid"], seen["sorted"], seen["prefix"], seen["in_order"]) == (3, 400, True, True, 3, True)
    text = t.zone_stats()
    assert text.startswith("version=2 nentries=3 key=id,a flags=valid,sorted sorted_prefix=3 [0:0..") and " c2:0..6]" in text and keystrata.version().endswith(keystrata.__version__)
