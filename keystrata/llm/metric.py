"""Near-duplicate vectors by cover trees, and nearest neighbours by vantage-point trees; both by cosine, over shards.

Vectors are scaled to length one, so that the distance d of two has cosine 1 - d * d / 2. A sample of the vectors are pivots;
a vector belongs to the cell of its nearest pivot. A cell of far more than its share of vectors is cut by a hash of their
ids, so no task holds more than a bounded part of it; a cell, or such a part, is a shard. A vector visits those other shards
that the triangle inequality cannot rule out, where it is read as a stream.

near_vectors: each shard's vectors are a cover tree: nested levels, a level's nodes covering theirs within half the radius of
the level above. Visitors form such a tree too, some thousand at a time, and pairs of nodes are followed down both trees: a
pair is left when the distance of its centres exceeds the threshold and both covering radii, and counted as a whole when
even with both radii it is within the threshold. Each pair of shards meets in one of the two, half of them in either. Pairs
are counted where they are found, and only each vector's number of links and one link towards its class leave the task.
Equal vectors are one beforehand, that of the least id, which counts as many times.

neighbours: each shard's vectors are a vantage-point tree, walked from its root; a branch is left when its lower bound, times
factor, exceeds the distance of the query's k-th neighbour so far. Factor one is exact; more is faster and may miss some.

Rows that repeat an id count once, with the least of their vectors. Rows without an id or vector, and vectors with a null or
a value that isn't finite, or of length zero, are in no result. Vectors of different dimensions are never near each other:
those of each dimension are searched apart. Ties go by id; cosines count to nine decimals. Other columns aren't read. An
empty table gives an empty result. Ids that aren't integers are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from keystrata.llm import common
from keystrata.llm.components import components

#: About so many vectors of a cell; one of over half as many again is cut.
CELL = 4096
#: Bytes of a shard's vectors, in 64 bits, if they are many-dimensional.
SHARD_BYTES = 32 << 20
#: Bytes of all pivots, which every task holds.
PIVOT_BYTES = 64 << 20
#: Visitors of a shard at once.
BLOCK = 2048
LEAF = 128
#: Vectors of a cover tree's leaf: a few, or many if the distance is so wide that bounds rule out little among vectors in all directions.
FEW, MANY = 16, 256
#: Pairs of vectors that are cheaper compared than followed down two trees.
SMALL = 1 << 16
SLACK = 1e-6
#: Values of a matrix that is worked on at once.
AREA = 1 << 20
#: Cosine from which two vectors are near duplicates.
SIMILAR = 0.95
K = 10
FACTOR = 1.25
#: Of so many ids one is a query of op8.
EVERY = 20
VISITS = "shard int, visitor boolean, id long, bound double, v binary"


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _within(distance: np.ndarray | float) -> np.ndarray | float:
    """The cosine of unit vectors at a distance."""
    return 1 - distance * distance / 2


class Space(NamedTuple):
    """The pivots of one dimension, their cells' radii, and the cells' shards: cell c has parts[c] of them, from first[c] on."""

    pivots: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def shards(self) -> tuple[np.ndarray, np.ndarray]:
        """(shards, their cells)."""
        of = np.repeat(np.arange(len(self.parts)), self.parts)
        return self.first[of] + np.arange(len(of)) - (np.cumsum(self.parts) - self.parts)[of], of

    def bounds(self, v: np.ndarray, home: np.ndarray) -> np.ndarray:
        """A lower bound of the distance from each vector to those of each cell; none to its own."""
        d = _distance(v @ self.pivots.T)
        at = np.arange(len(v))
        low = np.maximum(np.maximum(d - self.radii, (d - d[at, home][:, None]) / 2) - SLACK, 0)
        low[at, home] = 0
        return low


class Cells(NamedTuple):
    """Each vector with its dimension, cell and shard, as a table; what is known of each dimension; how many shards there are."""

    homes: DataFrame  # id, v, dim, n, cell, shard
    spaces: dict[int, Space]
    shards: int
    members: DataFrame  # id and two hashes of v, of all vectors


def _raw(wide: bool):
    return np.float64 if wide else np.float32


def _of(column: pa.Array, wide: bool) -> np.ndarray:
    """Unit vectors from the bytes of raw ones, all of one dimension."""
    rows = column.to_pylist()
    return _unit(np.frombuffer(b"".join(rows), _raw(wide)).reshape(len(rows), -1)) if rows else np.empty((0, 1))


def _groups(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, where it stands) of each value."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    edges = np.concatenate(([0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, [len(ranked)]))
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        if a < b:
            yield int(ranked[a]), order[a:b]


def _hashed(d: DataFrame) -> DataFrame:
    return d.withColumns({"x": F.xxhash64("v"), "y": F.xxhash64(F.lit(1), "v")})


def cells(df: DataFrame, id_column: str, vector: str, cell: int, made: list[str], once: bool = False) -> tuple[Cells, bool] | None:
    """The vectors in cells, and whether they are of 64 bits; None if there are none. once: of equal ones the one of the least id, n of them. made gets the paths of the tables."""
    common.integers(df, id_column)
    spark = df.sparkSession
    kind = df.schema.fields[common.place(df, vector)].dataType
    wide = not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType))
    d = common.narrow(df, id=id_column, v=vector).select(F.col("id").cast("long"), F.col("v").cast("array<double>" if wide else "array<float>").alias("v"))
    d = d.filter("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(v, x -> x <> 0)")
    d = d.groupBy("id").agg(F.min("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at = batch["v"].offsets.to_numpy() - batch["v"].offsets[0].as_py()
                data = np.ascontiguousarray(batch["v"].flatten().to_numpy(zero_copy_only=False), _raw(wide))
                size = data.itemsize
                v = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((at * size).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch["id"], v, pa.array(np.diff(at).astype(np.int32))], ["id", "v", "dim"])

    d = common.cut(d.mapInArrow(common.lean(pack), "id long, v binary, dim int"), made)
    members = _hashed(d).select("id", "x", "y")
    d = common.cut(d.groupBy("v", "dim").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "v", "dim", "n"), made) if once else d.withColumn("n", F.lit(1).cast("long"))
    d = d.withColumn("u", common.unit(7, "id"))
    dims = d.groupBy("dim").agg(F.count("*").alias("n"), F.min_by("v", F.struct("u", "id")).alias("v")).collect()  # a row for each dimension
    if not dims:
        return None
    # of each dimension the pivots: the vector of least hash, and so many more as its share says
    most = {x["dim"]: max(1, min(cell, SHARD_BYTES // (8 * x["dim"]))) for x in dims}
    share = [(x["dim"], min(x["n"] / most[x["dim"]], PIVOT_BYTES / (8 * x["dim"])) / x["n"]) for x in dims]
    few = d.join(F.broadcast(spark.createDataFrame(share, "dim int, share double")), "dim").filter("u < share").select("dim", "id", "v").collect()
    chosen = {x["dim"]: {bytes(x["v"])} for x in dims}
    for x in sorted(few, key=lambda x: x["id"]):
        chosen[x["dim"]].add(bytes(x["v"]))
    pivots = {dim: _of(pa.array(sorted(rows), pa.binary()), wide) for dim, rows in chosen.items()}
    d = d.drop("u")
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for dim, rows in _groups(batch["dim"].to_numpy()):
                p = shared.value[dim]
                step = max(1, AREA // len(p))
                for i in range(0, len(rows), step):
                    part = rows[i : i + step]
                    cosine = _of(batch["v"].take(pa.array(part)), wide) @ p.T
                    home[part], far[part] = cosine.argmax(1), _distance(cosine.max(1))
            if len(batch):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(far)], ["id", "v", "dim", "n", "cell", "far"])

    homes = common.cut(d.mapInArrow(common.lean(assign), "id long, v binary, dim int, n long, cell int, far double"), made)
    spaces, shards = {}, 0
    known = homes.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()  # a row for each pivot
    for dim, p in pivots.items():
        radii, size = np.zeros(len(p)), np.zeros(len(p), np.int64)
        for x in known:
            if x["dim"] == dim:
                radii[x["cell"]], size[x["cell"]] = x["far"], x["n"]
        parts = np.maximum(1, np.round(size / most[dim])).astype(np.int64)
        spaces[dim] = Space(p, radii, shards + np.cumsum(parts) - parts, parts)
        shards += int(parts.sum())
    table = spark.createDataFrame([(dim, c, int(a), int(n)) for dim, s in spaces.items() for c, (a, n) in enumerate(zip(s.first, s.parts))], "dim int, cell int, first int, parts int")
    homes = homes.drop("far").join(F.broadcast(table), ["dim", "cell"])  # a row for each pivot
    homes = homes.withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")).select("id", "v", "dim", "n", "cell", "shard")
    return Cells(homes, spaces, shards, members), wide


class Held(NamedTuple):
    ids: np.ndarray
    v: np.ndarray
    bound: np.ndarray


def _by_shard(batches: Iterator[pa.RecordBatch], wide: bool, block: int) -> Iterator[tuple[int, bool, Held]]:
    """(shard, whether these visit, vectors): all residents of a shard, then its visitors, block by block; rows are in that order."""
    held: list[pa.RecordBatch] = []
    now: tuple[int, bool] | None = None

    def out() -> tuple[int, bool, Held]:
        t = pa.Table.from_batches(held).combine_chunks()
        return (*now, Held(t["id"].to_numpy(), np.concatenate([_of(b["v"], wide) for b in held]), t["bound"].to_numpy()))

    for batch in batches:
        key = batch["shard"].to_numpy().astype(np.int64) * 2 + batch["visitor"].to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(edges, edges[1:]):
            while a < b:
                this = (int(key[a] // 2), bool(key[a] % 2))
                if held and (this != now or this[1] and sum(map(len, held)) >= block):
                    yield out()
                    held = []
                now = this
                step = b - a if not this[1] else min(b - a, block - sum(map(len, held)))
                held.append(batch.slice(a, step))
                a += step
    if held:
        yield out()


def _parted(visits: DataFrame, shards: int) -> DataFrame:
    """A task for each shard, residents first."""
    return visits.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "visitor")


#: The distance at which two vectors are orthogonal, as most of those in all directions nearly are.
ACROSS = 2**0.5


def _leaf(reach: float) -> int:
    return FEW if 2 * reach <= ACROSS else MANY


class Node:
    """A node of a cover tree: its centre, the greatest distance of its vectors from it, and its children.

    flat are the vectors without children of their own: those of a leaf, of children of one vector, and of leaves so wide that
    no bound would rule them out; wide are the other children.
    """

    __slots__ = ("centre", "radius", "children", "members", "flat", "wide", "centres", "radii")

    def __init__(self, centre: int, radius: float, members: np.ndarray):
        self.centre, self.radius, self.members = centre, radius, members
        self.children: list[Node] = []
        self.flat, self.wide = members, []

    def settle(self, leaf: int, reach: float) -> None:
        """flat and wide from the children."""
        most = min(reach, max(0.0, ACROSS - reach))
        flat = [c for c in self.children if len(c.members) == 1 or (len(c.members) <= leaf and c.radius > most)]
        self.wide = [c for c in self.children if not (len(c.members) == 1 or (len(c.members) <= leaf and c.radius > most))]
        self.flat = np.concatenate([c.members for c in flat]) if flat else np.empty(0, np.int64)
        self.centres = np.array([c.centre for c in self.wide], np.int64)
        self.radii = np.array([c.radius for c in self.wide])


def cover_tree(v: np.ndarray, members: np.ndarray | None = None, centre: int = 0, level: float = 2.0, leaf: int = FEW, reach: float = 0.0) -> Node:
    """members is all vectors by default; level is a radius that covers them from the centre; reach the distance that is asked for."""
    if members is None:
        members = np.arange(len(v))
    d = _distance(v[members] @ v[centre])
    node = Node(centre, float(d.max()) + SLACK if len(members) > 1 else 0.0, members)
    if len(members) <= leaf or node.radius <= 100 * SLACK:
        return node
    while level / 2 >= node.radius:
        level /= 2
    near = _within(level / 2)
    # the centre first, then whatever isn't within half the level of a child yet, some at a time
    left = np.concatenate(([centre], members[members != centre]))
    while len(left):
        some = left[:64]
        close = v[some] @ v[left].T >= near
        open_ = np.ones(len(left), bool)
        for i, c in enumerate(some.tolist()):
            if not open_[i]:
                continue
            own = close[i] & open_
            own[i] = True
            open_ &= ~own
            if own.sum() == 1:
                node.children.append(Node(c, 0.0, left[i : i + 1]))
            else:
                node.children.append(cover_tree(v, left[own], c, level / 2, leaf, reach))
        left = left[open_]
    node.settle(leaf, reach)
    return node


class Links:
    """Links among the vectors of one shard and a block of its visitors: each one's number, and a forest that joins what is linked. times: for how many a vector stands."""

    def __init__(self, times: np.ndarray):
        self.times = times
        self.count = np.zeros(len(times), np.int64)
        self.root = np.arange(len(times))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            other = a != b
            if not other.any():
                return
            i, j, a, b = i[other], j[other], a[other], b[other]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """These are linked; no pair comes twice."""
        if len(i):
            n = len(self.count)
            self.count += (np.bincount(i, self.times[j], n) + np.bincount(j, self.times[i], n)).astype(np.int64)
            self.join(i, j)

    def whole(self, a: np.ndarray, b: np.ndarray | None = None) -> None:
        """All of a are linked with all of b, or among themselves."""
        if b is None:
            self.count[a] += self.times[a].sum() - self.times[a]
            self.join(a[1:], np.full(len(a) - 1, a[0]))
        else:
            self.count[a] += self.times[b].sum()
            self.count[b] += self.times[a].sum()
            every = np.concatenate((a, b))
            self.join(every[1:], np.full(len(every) - 1, every[0]))


def dual(a: Node, b: Node, v: np.ndarray, low: np.ndarray, similar: float, links: Links) -> None:
    """Counts the pairs of vectors below a and b whose cosine is similar; if a is b, each pair once. low is v in 32 bits."""
    reach = float(_distance(np.array(similar)))
    far, sure = reach + SLACK, reach - SLACK
    screen, certain = np.float32(similar - 1e-5), np.float32(similar + 1e-5)  # more than 32 bits can err by

    def flat(x: np.ndarray, y: np.ndarray, same: bool = False) -> None:
        if not len(x) or not len(y):
            return
        step = max(1, AREA // len(y))
        for i in range(0, len(x), step):
            rest = y[i:] if same else y
            cosine = (low[x[i : i + step]] @ low[rest].T).ravel()
            at = np.flatnonzero(cosine >= screen)
            p, q = np.divmod(at, len(rest))
            if same:  # the upper triangle
                at, p, q = at[q > p], p[q > p], q[q > p]
            if len(p):
                p, q = x[i + p], rest[q]
                good = cosine[at] >= certain
                open_ = np.flatnonzero(~good)
                good[open_] = np.round(np.einsum("ij,ij->i", v[p[open_]], v[q[open_]]), 9) >= similar
                links.pairs(p[good], q[good])

    todo: list[tuple[Node, Node | np.ndarray]] = [(a, b)]
    while todo:
        a, b = todo.pop()
        if isinstance(b, np.ndarray):  # a node and single vectors
            d = _distance(v[b] @ v[a.centre])
            whole = d + a.radius <= sure
            if whole.any():
                links.whole(a.members, b[whole])
            b = b[~whole & (d <= far + a.radius)]
            if len(a.members) * len(b) <= SMALL:
                flat(a.members, b)
            elif len(b):
                flat(a.flat, b)
                todo += [(x, b) for x in a.wide]
        elif a is b:
            if 2 * a.radius <= sure:
                links.whole(a.members)
                continue
            if len(a.members) ** 2 <= SMALL:
                flat(a.members, a.members, True)
                continue
            flat(a.flat, a.flat, True)
            for i, x in enumerate(a.wide):
                todo += [(x, a.flat), (x, x)]
                d = _distance(v[a.centres[i + 1 :]] @ v[x.centre])
                todo += [(x, a.wide[i + 1 + j]) for j in np.flatnonzero(d <= far + x.radius + a.radii[i + 1 :]).tolist()]
        else:
            d = float(_distance(v[a.centre] @ v[b.centre]))
            if d + a.radius + b.radius <= sure:
                links.whole(a.members, b.members)
                continue
            if len(a.members) * len(b.members) <= SMALL:
                flat(a.members, b.members)
                continue
            flat(a.flat, b.flat)
            todo += [(x, b.flat) for x in a.wide if len(b.flat)] + [(y, a.flat) for y in b.wide if len(a.flat)]
            if a.wide and b.wide:
                d = _distance(v[a.centres] @ v[b.centres].T)
                todo += [(a.wide[i], b.wide[j]) for i, j in zip(*(k.tolist() for k in np.nonzero(d <= far + a.radii[:, None] + b.radii)))]


def _visit(spaces, wide: bool, limit, choose, carried=None):
    """A map over vectors to the shards, not their own, whose cells may hold any within their limit; choose says which of both shards. What is carried is in bound, the limit by default."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, shard, bound = batch["cell"].to_numpy(), batch["shard"].to_numpy(), limit(batch)
            carry = bound if carried is None else batch[carried].to_numpy().astype(float)
            for dim, every in _groups(batch["dim"].to_numpy()):
                s: Space = spaces.value[dim]
                number, of = s.shards()
                step = max(1, AREA // len(number))
                for i in range(0, len(every), step):
                    rows = every[i : i + step]
                    low = s.bounds(_of(batch["v"].take(pa.array(rows)), wide), home[rows])
                    row, to = np.nonzero((low[:, of] <= bound[rows][:, None]) & choose(shard[rows][:, None], number))
                    at = pa.array(rows[row])
                    yield pa.RecordBatch.from_arrays([pa.array(number[to].astype(np.int32)), pa.array(np.ones(len(to), bool)), batch["id"].take(at), pa.array(carry[rows[row]]), batch["v"].take(at)], ["shard", "visitor", "id", "bound", "v"])

    return run


def _residents(homes: DataFrame) -> DataFrame:
    return homes.select("shard", F.lit(False).alias("visitor"), "id", F.col("n").cast("double").alias("bound"), "v")


def near_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", similar: float = SIMILAR, cell: int = CELL) -> DataFrame:
    """(vec_id, class_id, links) of each vector: with how many others it has a cosine of at least similar, and the least id that such links lead to."""
    spark, made = df.sparkSession, []
    found = cells(df, id_column, vector, cell, made, True)
    if found is None:
        common.discard(spark, made)
        return spark.createDataFrame([], "vec_id long, class_id long, links long")
    (homes, spaces, shards, members), wide = found
    reach = float(_distance(np.array(similar))) + SLACK
    shared = spark.sparkContext.broadcast(spaces)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: np.ndarray, links: Links, at: np.ndarray) -> pa.RecordBatch:
            at = at[links.count[at] > 0]
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links.count[at]), pa.array(ids[links.root[at]])], ["id", "links", "other"])

        here = None
        for shard, visits, h in _by_shard(batches, wide, BLOCK):
            if not visits:
                here, at = h, shard
                n, low = len(h.ids), h.v.astype(np.float32)
                tree, total = cover_tree(h.v, leaf=_leaf(reach), reach=reach), Links(h.bound.astype(np.int64))
                dual(tree, tree, h.v, low, similar, total)
            elif here is not None and at == shard:
                both = np.concatenate((here.v, h.v))
                links = Links(np.concatenate((here.bound, h.bound)).astype(np.int64))
                links.root[:n] = total.root
                other = cover_tree(both, np.arange(n, len(both)), n, leaf=_leaf(reach), reach=reach)
                dual(tree, other, both, np.concatenate((low, h.v.astype(np.float32))), similar, links)
                total.count += links.count[:n]
                total.root[:] = links.root[:n]
                yield out(np.concatenate((here.ids, h.ids)), links, np.arange(n, len(both)))
            if here is not None and at != shard:
                here = None
        if here is not None:
            yield out(here.ids, total, np.arange(n))

    # of two shards the one with the lesser number is visited if the numbers' sum is odd, else the other
    visit = _visit(shared, wide, lambda batch: np.full(len(batch), reach), lambda own, to: (own != to) & ((own > to) == ((own + to) % 2 == 1)), "n")
    visits = _residents(homes).union(homes.mapInArrow(common.lean(visit), VISITS))
    some = common.cut(_parted(visits, shards).mapInArrow(common.lean(join), "id long, links long, other long"), made)
    classes = components(some.select("id", "other"), made).select(F.col("id").alias("c"), F.col("least").alias("class_id"))
    links = some.groupBy(F.col("id").alias("l")).agg(F.sum("links").alias("links"))
    first = _hashed(homes.select("id", "v", "n")).select(F.col("id").alias("first"), "n", "x", "y")
    first = first.join(links, F.col("first") == F.col("l"), "left").join(classes, F.col("first") == F.col("c"), "left")
    first = first.select("x", "y", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    result = common.cut(members.join(first, ["x", "y"]).select(F.col("id").alias("vec_id"), "class_id", "links"))
    common.discard(spark, made)
    return result


class VantageTree:
    """A binary tree over vectors: a node's vantage point, and how far from it the vectors of either child are, at least and at most."""

    def __init__(self, v: np.ndarray, leaf: int = LEAF):
        self.v = v
        self.root = self._node(np.arange(len(v)), leaf)

    def _node(self, members: np.ndarray, leaf: int) -> np.ndarray | tuple:
        if len(members) <= leaf:
            return members
        p = int(members[len(members) // 2])
        d = _distance(self.v[members] @ self.v[p])
        order = np.argsort(d, kind="stable")
        half = len(order) // 2
        parts = (order[:half], order[half:])
        spans = [(float(d[x[0]]) - SLACK, float(d[x[-1]]) + SLACK) for x in parts]
        return p, spans, [self._node(members[x], leaf) for x in parts]


def search(tree: VantageTree, ids: np.ndarray, q: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, ids) of each query's k nearest that are within its bound, the rest being -inf and -1; own: the ids of the queries, which aren't neighbours."""
    best = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), -1, np.int64)
    tau = bound.copy()

    def look(members: np.ndarray, rows: np.ndarray) -> None:
        cosine = np.round(q[rows] @ tree.v[members].T, 9)
        cosine[own[rows][:, None] == ids[members]] = -np.inf
        hit = np.flatnonzero((_distance(cosine) <= tau[rows][:, None] + SLACK).any(1))
        if not len(hit):
            return
        rows = rows[hit]
        every = np.concatenate((best[rows], cosine[hit]), 1)
        name = np.concatenate((who[rows], np.broadcast_to(ids[members], (len(rows), len(members)))), 1)
        order = np.lexsort((name, -every), axis=1)[:, :k]
        best[rows], who[rows] = np.take_along_axis(every, order, 1), np.take_along_axis(name, order, 1)
        last = best[rows, k - 1]
        tau[rows] = np.minimum(tau[rows], np.where(np.isinf(last), np.inf, _distance(np.maximum(last, -1))))

    def walk(node: np.ndarray | tuple, rows: np.ndarray, low: np.ndarray) -> None:
        near = low * factor <= tau[rows] + SLACK
        rows, low = rows[near], low[near]
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            look(node, rows)
            return
        p, spans, children = node
        d = _distance(q[rows] @ tree.v[p])
        inner, outer = (np.maximum(low, np.maximum(d - most, least - d)) for least, most in spans)
        first = inner <= outer
        # each query goes down its nearer branch first
        walk(children[0], rows[first], inner[first])
        walk(children[1], rows[~first], outer[~first])
        walk(children[1], rows[first], outer[first])
        walk(children[0], rows[~first], inner[~first])

    walk(tree.root, np.arange(len(q)), np.zeros(len(q)))
    return best, np.where(np.isinf(best), -1, who)


def neighbours(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K, factor: float = FACTOR, cell: int = CELL, every: int = EVERY) -> DataFrame:
    """(id, rank, neighbour, cosine): of each vector whose id is a multiple of every, the k nearest of all others, by cosine and then id, rank from 1."""
    spark, made = df.sparkSession, []
    found = cells(df, id_column, vector, cell, made)
    if found is None:
        common.discard(spark, made)
        return spark.createDataFrame([], "id long, rank long, neighbour long, cosine double")
    (homes, spaces, shards, _), wide = found
    shared = spark.sparkContext.broadcast(spaces)
    queries = homes.filter(F.pmod("id", F.lit(every)) == 0)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for shard, visits, h in _by_shard(batches, wide, BLOCK):
            if not visits:
                tree, here, at = VantageTree(h.v), h, shard
            elif here is not None and at == shard:  # else a shard without vectors
                best, who = search(tree, here.ids, h.v, h.ids, h.bound, k, factor)
                i, j = np.nonzero(who >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(h.ids[i]), pa.array(who[i, j]), pa.array(best[i, j])], ["id", "neighbour", "cosine"])

    def sought(visits: DataFrame) -> DataFrame:
        return common.cut(_parted(_residents(homes).union(visits), shards).mapInArrow(common.lean(seek), "id long, neighbour long, cosine double"), made)

    # at home first, which bounds how far to look elsewhere
    first = sought(queries.select("shard", F.lit(True).alias("visitor"), "id", F.lit(float("inf")).alias("bound"), "v"))
    every_one = first
    if shards > 1:
        tau = first.groupBy("id").agg(F.min("cosine").alias("worst"), F.count("*").alias("n")).filter(F.col("n") >= k).select("id", "worst")

        def limit(batch: pa.RecordBatch) -> np.ndarray:
            worst = batch["worst"].to_numpy(zero_copy_only=False)
            return np.where(np.isnan(worst), np.inf, _distance(np.nan_to_num(worst)) / factor + SLACK)

        away = queries.join(tau, "id", "left").mapInArrow(common.lean(_visit(shared, wide, limit, lambda own, to: own != to)), VISITS)
        # the search takes the bound of the k-th neighbour itself
        away = away.withColumn("bound", F.col("bound") * factor)
        every_one = first.union(sought(away))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    result = common.cut(every_one.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("id", "rank", "neighbour", "cosine"))
    common.discard(spark, made)
    return result


def links_sql(similar: float) -> str:
    """near_vectors() in SQL: all pairs, and from every vector all that links lead to."""
    return f"""WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS norm FROM e),
p AS (SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.id <> y.id WHERE round(list_dot_product(x.v, y.v) / (x.norm * y.norm), 9) >= {similar}),
r AS (SELECT id, id AS other FROM e UNION SELECT r.id, p.b FROM r JOIN p ON r.other = p.a),
c AS (SELECT id, min(other) AS class_id FROM r GROUP BY id), l AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT c.id AS vec_id, c.class_id, CAST(coalesce(l.links, 0) AS BIGINT) AS links FROM c LEFT JOIN l ON c.id = l.a"""


NEIGHBOURS_SQL = f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS norm FROM e),
p AS (SELECT x.id, y.id AS neighbour, round(list_dot_product(x.v, y.v) / (x.norm * y.norm), 9) AS cosine FROM n x JOIN n y ON x.id <> y.id WHERE x.id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS rank FROM p) SELECT id, rank, neighbour, cosine FROM r WHERE rank <= {K}"""
