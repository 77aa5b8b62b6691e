"""Nearest neighbours on proximity graphs: building flat and hierarchical ones, and searching them.

A flat graph is a table (nid, sketch, neighbors, src_id) with one of entries (entry_nid, centroid); a hierarchy has such a
table for each level, 0 holding all nodes, and (entry_nid, max_level). Searches take a table of queries (query_id, query); a
sketch may have fewer dimensions than the query, whose first ones then count. A flat search holds the graph in every task,
its size checked. A hierarchy is built in shards: a task holds one shard, and the queries come to it, so no graph is
collected; the setting levelCache says how many shards a worker keeps for the next search of the same table.

A node is linked with candidates among its 4 m nearest; a hierarchy has at most 17 levels.
"""

from __future__ import annotations

import heapq
import uuid
from collections import OrderedDict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata import config
from keystrata.functions.vectors import cosine_distance, matrix
from keystrata.operators import ann
from keystrata.operators.quantize import shared

#: Rows of a shard, or of a cell of a flat graph, beyond which it is cut.
SHARD = 4096
#: Entries that a flat search begins from.
STARTS = 8
#: Cells of a large shard that a row is linked in.
NEAREST = 3
#: Links of a row with the equal rows before it.
COPIES = 4
#: Queries for which a task of its own is worth another copy of a shard.
ASKED = 1024


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.float64)
    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


class TooLarge(ValueError):
    """A graph that tasks can't hold."""


@dataclass
class Level:
    """One level's nodes: neighbours of node i are to[first[i]:first[i + 1]], as places in nids."""

    nids: np.ndarray
    sketch: np.ndarray  # unit rows
    first: np.ndarray
    to: np.ndarray
    place: dict[int, int] = field(default_factory=dict)

    @staticmethod
    def of(nids: np.ndarray, sketch: np.ndarray, neighbours: list[list[int]]) -> "Level":
        place = {int(n): i for i, n in enumerate(nids)}
        near = [[place[x] for x in ns if x in place] for ns in neighbours]
        return Level(np.asarray(nids, np.int64), _unit(sketch), np.concatenate(([0], np.cumsum([len(x) for x in near]))).astype(np.int64), np.array([x for ns in near for x in ns], np.int64), place)

    @staticmethod
    def packed(t: pa.Table) -> "Level":
        """From a table (nid, sketch, neighbors) in order of nid, without a list or number of Python's for each link; place stays empty."""
        nids, near = t["nid"].to_numpy(), t["neighbors"].combine_chunks()
        to, of = near.flatten().to_numpy(), np.repeat(np.arange(len(t)), np.diff(near.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(nids, to), len(nids) - 1)
        there = nids[at] == to
        first = np.concatenate(([0], np.cumsum(np.bincount(of[there], minlength=len(t))))).astype(np.int64)
        return Level(nids, _unit(matrix(t["sketch"])), first, at[there])

    @staticmethod
    def load(df: DataFrame) -> "Level":
        """From a table (nid, sketch, neighbors); as many nodes as the setting for models allows."""
        size = df.agg(F.coalesce(F.sum(F.size("sketch") * 8 + F.size("neighbors") * 8 + 16), F.lit(0))).first()[0]
        most = int(config.setting(df.sparkSession, "broadcastBytes"))
        if size > most:
            raise TooLarge(f"a graph of {size} bytes is more than spark.keystrata.broadcastBytes, {most}; build it in shards")
        t = df.select("nid", F.col("sketch").cast("array<double>").alias("sketch"), "neighbors").toArrow().sort_by("nid")
        if not len(t):
            raise ValueError("the graph is empty")
        return Level.of(t["nid"].to_numpy(), matrix(t["sketch"]), t["neighbors"].to_pylist())

    def distances(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 - self.sketch[at] @ q


def beam(level: Level, q: np.ndarray, starts: np.ndarray, ef: int, patience: int = 0) -> list[tuple[float, int]]:
    """The ef nearest places that a best-first walk finds, nearest first; patience: expansions in a row without an improvement, once there are ef, after which it ends."""
    seen = np.zeros(len(level.nids), bool)
    starts = np.unique(starts)
    seen[starts] = True
    d = level.distances(q, starts)
    todo = sorted(zip(d.tolist(), starts.tolist()))
    best = [(-x, -i) for x, i in todo]
    heapq.heapify(best)
    while len(best) > ef:
        heapq.heappop(best)
    idle = 0
    while todo:
        d0, i = heapq.heappop(todo)
        if len(best) >= ef and d0 > -best[0][0]:
            break
        near = level.to[level.first[i] : level.first[i + 1]]
        near = near[~seen[near]]
        improved = False
        if len(near):
            seen[near] = True
            d = level.distances(q, near)
            if len(best) >= ef:  # most are farther than all of these
                closer = d < -best[0][0]
                d, near = d[closer], near[closer]
            for x, j in zip(d.tolist(), near.tolist()):
                if len(best) < ef or x < -best[0][0]:
                    improved = True
                    heapq.heappush(todo, (x, j))
                    heapq.heappush(best, (-x, -j))
                    if len(best) > ef:
                        heapq.heappop(best)
        idle = 0 if improved or len(best) < ef else idle + 1
        if patience and idle >= patience:
            break
    return sorted((-x, -i) for x, i in best)


def _query(q: np.ndarray, dim: int) -> np.ndarray:
    if dim > len(q):
        raise ValueError(f"sketches of {dim} dimensions and a query of {len(q)}")
    return _unit(q[:dim])


def _search(queries: DataFrame, run) -> DataFrame:
    """(query_id, nid, distance) from run(query) for each query."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch["query_id"].to_pylist(), []
            for i, q in zip(ids, matrix(batch["query"]) if len(batch) else []):
                out += [(i, n, d) for n, d in run(q)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["query_id", "nid", "distance"])

    return queries.select(F.col("query_id").cast("long"), F.col("query").cast("array<double>")).filter("query IS NOT NULL").mapInArrow(each, "query_id long, nid long, distance double")


def _topk(df: DataFrame, k: int, by: str = "distance", tie: str = "nid") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(by, tie))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def _reranked(found: DataFrame, nodes: DataFrame, queries: DataFrame, vectors: DataFrame | None, lim: int, rerank: int) -> DataFrame:
    """(query_id, rank, id, distance): by the vectors (id, embedding), if they are given, of the first max(rerank, lim) candidates, or of all."""
    if rerank > 0:
        found = _topk(found, max(rerank, lim)).drop("rank")
    return _final(found.join(nodes.select("nid", F.col("src_id").cast("string").alias("id")), "nid"), queries, vectors, lim)


def _final(found: DataFrame, queries: DataFrame, vectors: DataFrame | None, lim: int) -> DataFrame:
    """The first lim of each query's (query_id, nid, distance, id), by the vectors if they are given."""
    if vectors is not None:
        v = vectors.select(F.col("id").cast("string").alias("vid"), "embedding")
        found = found.join(v, F.col("id") == F.col("vid"), "left").join(queries.select(F.col("query_id").cast("long"), F.col("query").alias("q")), "query_id")
        # a node without a row comes last
        found = found.withColumn("distance", F.coalesce(cosine_distance("embedding", "q"), F.lit(float("inf"))))
        found = found.withColumn("id", F.when(F.col("vid").isNull(), "").otherwise(F.col("id")))
    return _topk(found, lim, tie="id").select("query_id", "rank", "id", "distance")


def _all_nodes(nodes: DataFrame, queries: DataFrame, vectors: DataFrame, lim: int) -> DataFrame:
    """What a search as wide as the graph gives: of all nodes the first lim by the vectors, without a walk."""
    named = nodes.select(F.col("src_id").cast("string").alias("id"))
    v = vectors.select(F.col("id").cast("string").alias("vid"), "embedding")
    rows = named.join(v, F.col("id") == F.col("vid"), "left").select(F.when(F.col("vid").isNull(), "").otherwise(F.col("id")).alias("id"), "embedding")
    asked = queries.select(F.col("query_id").cast("long"), "query").filter("query IS NOT NULL")
    found = ann.exact_many(rows, asked, lim).drop("rank")
    # nodes without a row come last
    bare = rows.filter("embedding IS NULL").select("id").orderBy("id").limit(lim).collect()
    if bare:
        rest = F.broadcast(nodes.sparkSession.createDataFrame(bare, "id string"))
        found = found.union(asked.select("query_id").crossJoin(rest).select("query_id", "id", F.lit(float("inf"))))
    return _topk(found, lim, tie="id").select("query_id", "rank", "id", "distance")


def held_walk(nodes: DataFrame, entries: DataFrame | None, patience: int):
    """A function from (query, ef) to (0, nid, distance) of a flat graph, which is sent to the tasks, its size checked."""
    g = Level.load(nodes)
    if entries is not None:
        rows = entries.orderBy("entry_nid").collect()  # one for each partition
        if not rows:
            raise ValueError("the table of entries is empty")
        doors, centres = np.array([g.place[r["entry_nid"]] for r in rows]), _unit(np.array([r["centroid"] for r in rows]))
    else:
        doors, centres = np.array([g.place.get(0, 0)]), g.sketch[[g.place.get(0, 0)]]
    held = shared(nodes.sparkSession, g.nids, g.sketch, g.first, g.to, doors, centres)

    def walk(q: np.ndarray, ef: int) -> list[tuple[int, int, float]]:
        nids, sketch, first, to, doors, centres = held.value
        q = _query(q, sketch.shape[1])
        starts = doors[np.argsort(1 - centres @ q, kind="stable")[:STARTS]]
        return [(0, int(nids[i]), d) for d, i in beam(Level(nids, sketch, first, to), q, starts, ef, patience)]

    return walk


def held_hierarchy(meta: DataFrame, nodes: DataFrame, patience: int):
    """A function from (query, ef) to (shard, nid, distance) of a hierarchy, which is sent to the tasks, its size checked."""
    spark = nodes.sparkSession
    if "shard" not in meta.columns:
        meta, nodes = meta.withColumn("shard", F.lit(0)), nodes.withColumn("shard", F.lit(0))
    size = nodes.agg(F.coalesce(F.sum(F.size("sketch") * 8 + F.size("neighbors") * 8 + 24), F.lit(0))).first()[0]
    most = int(config.setting(spark, "broadcastBytes"))
    if size > most:
        raise TooLarge(f"a graph of {size} bytes is more than spark.keystrata.broadcastBytes, {most}; send the queries to hnsw_scan()")
    doors = meta.select("shard", F.col("entry_nid").alias("e"))
    t = nodes.join(doors, "shard").select("shard", "level", "nid", F.col("sketch").cast("array<double>").alias("sketch"), "neighbors", (F.col("nid") == F.col("e")).alias("door")).toArrow()
    if not len(t):
        raise ValueError("the graph has no entry")
    held = spark.sparkContext.broadcast({s: t.filter(pa.array(t["shard"].to_numpy() == s)) for s in np.unique(t["shard"].to_numpy()).tolist()})
    shards: dict[int, Shard] = {}

    def walk(q: np.ndarray, ef: int) -> list[tuple[int, int, float]]:
        out = []
        for s, table in held.value.items():
            if s not in shards:
                shards[s] = Shard(table)
            out += [(int(s), n, d) for n, d in shards[s].search(q, ef, patience)]
        return out

    return walk


def graph_scan(nodes: DataFrame, queries: DataFrame, entries: DataFrame | None = None, vectors: DataFrame | None = None, ef: int = 64, lim: int = 10, rerank: int = 0, patience: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance) on a flat graph, from the entries nearest to the query or, without entries, from node 0.

    If ef is all nodes or more, and vectors rank them, there is nothing to walk: all nodes count, reached or not.
    """
    if lim < 1:
        raise ValueError("lim is at least 1")
    patience = int(config.setting(nodes.sparkSession, "graphPatience")) if patience is None else patience
    ef = max(ef, lim, 1)
    if vectors is not None and rerank <= 0 and not patience and (entries is None or not entries.isEmpty()) and ef >= nodes.count() > 0:
        return _all_nodes(nodes, queries, vectors, lim)
    walk = held_walk(nodes, entries, patience)
    run = lambda q: [(nid, d) for _, nid, d in walk(q, ef)]
    return _reranked(_search(queries, run), nodes, queries, vectors, lim, rerank)


def diverse(order: np.ndarray, near: np.ndarray, among: np.ndarray, m: int) -> list[int]:
    """Of candidates in order of nearness, m that are nearer to the node than to those taken before; then the nearest of the rest."""
    taken: list[int] = []
    free = np.ones(len(order), bool)
    nearest = near[order]
    while len(taken) < m:
        at = int(free.argmax()) if len(free) else 0
        if not len(free) or not free[at]:
            break
        taken.append(int(order[at]))
        free &= among[order, taken[-1]] < nearest
        free[at] = False
    return taken + [j for j in order.tolist() if j not in taken][: m - len(taken)]


def _cells(rows: DataFrame) -> DataFrame:
    """rows, their partitions cut into cells of about SHARD rows at most if any has more: by the nearest of some of its own rows, then by a hash of the ids."""
    spark = rows.sparkSession
    sizes = {x["partition_id"]: x["count"] for x in rows.groupBy("partition_id").count().collect()}  # a row for each partition
    if max(sizes.values(), default=0) <= SHARD:
        return rows
    kind = rows.schema["partition_id"].dataType.simpleString()
    share = F.broadcast(spark.createDataFrame([(p, 2 / SHARD) for p, n in sizes.items() if n > SHARD], f"partition_id {kind}, share double"))
    few = rows.join(share, "partition_id").filter(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("partition_id", "id", "sketch").collect()
    some: dict = {}
    for x in sorted(few, key=lambda x: x["id"]):
        some.setdefault(x["partition_id"], []).append(x["sketch"])
    held = spark.sparkContext.broadcast({p: _unit(np.array(v)) for p, v in some.items()})

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, cell = np.array(batch["partition_id"].to_pylist()), np.zeros(len(batch), np.int32)
            for p, pivots in held.value.items():
                at = np.flatnonzero(of == p)
                for a in range(0, len(at), 1024):
                    cell[at[a : a + 1024]] = (_unit(matrix(batch["sketch"].take(pa.array(at[a : a + 1024])))) @ pivots.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    path = f"{config.shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    rows.select("partition_id", "id", "sketch").mapInArrow(nearest, f"partition_id {kind}, id string, sketch array<double>, cell int").write.parquet(path)
    placed = spark.read.parquet(path)
    known = placed.groupBy("partition_id", "cell").count().orderBy("partition_id", "cell").collect()  # a row for each pivot
    table, first = [], 0
    for x in known:
        table.append((x["partition_id"], x["cell"], first, -(-x["count"] // SHARD)))
        first += table[-1][3]
    numbers = F.broadcast(spark.createDataFrame(table, f"partition_id {kind}, cell int, first int, parts int"))
    part = F.pmod(F.xxhash64(F.lit(9), "id"), F.col("parts")).cast("int")
    return placed.join(numbers, ["partition_id", "cell"]).select((F.col("first") + part).alias("partition_id"), "id", "sketch")


def build_flat(rows: DataFrame, m: int = 16, adjacent: int = 2, diversify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, entries) of rows (partition_id, id, sketch): each node's m nearest in its partition and the adjacent nearest ones, both ways round, 2 m at most.

    A task holds one partition and its neighbours; one of over SHARD rows is cut into cells, which are partitions of their own,
    with an entry each. Nodes are numbered within each partition in the order of a walk from its medoid.
    """
    spark = rows.sparkSession
    r = rows.select("partition_id", F.col("id").cast("string").alias("id"), F.col("sketch").cast("array<double>").alias("sketch")).filter("sketch IS NOT NULL")
    r = _cells(r)
    means = r.select("partition_id", F.posexplode("sketch")).groupBy("partition_id", "pos").agg(F.avg("col").alias("x"))
    means = means.groupBy("partition_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("c")).select("partition_id", F.col("c.x").alias("c")).orderBy("partition_id").collect()
    names = [x["partition_id"] for x in means]  # a row for each partition
    centres = _unit(np.array([x["c"] for x in means])) if means else np.empty((0, 1))
    near = []
    for i in range(len(names)):
        order = np.argsort(-(centres @ centres[i]), kind="stable").tolist()
        near += [(names[j], names[i]) for j in [x for x in order if x != i][:adjacent]]
    goes = spark.createDataFrame([(n, n) for n in names] + near, f"partition_id {r.schema['partition_id'].dataType.simpleString()}, pool {r.schema['partition_id'].dataType.simpleString()}")
    pooled = r.join(F.broadcast(goes), "partition_id")

    def link(key: tuple, t: pa.Table) -> pa.Table:
        own = np.flatnonzero(np.array([p == key[0].as_py() for p in t["partition_id"].to_pylist()], bool))
        ids, v = t["id"].to_pylist(), _unit(matrix(t["sketch"]))
        src, dst, score = [], [], []
        for a in range(0, len(own), 512):
            block = own[a : a + 512]
            cosine = v[block] @ v.T
            cosine[np.arange(len(block)), block] = -np.inf
            for i, c in zip(block.tolist(), cosine):
                n = min(4 * m, len(c) - 1)
                top = np.argpartition(-c, n)[:n]
                top = top[np.lexsort((top, -c[top]))]
                if diversify:
                    among = v[top] @ v[top].T
                    picked = top[diverse(np.arange(len(top)), c[top], among, m)]
                else:
                    picked = top[:m]
                for j in picked.tolist():
                    src.append(ids[i]), dst.append(ids[j]), score.append(float(c[j]))
        return pa.table({"src": pa.array(src, pa.string()), "dst": pa.array(dst, pa.string()), "cosine": pa.array(score, pa.float64())})

    edges = pooled.groupBy("pool").applyInArrow(link, "src string, dst string, cosine double")
    both = edges.union(edges.select("dst", "src", "cosine")).groupBy("src", "dst").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cosine"), "dst"))
    both = both.withColumn("n", rank).filter(F.col("n") <= 2 * m)
    lists = both.groupBy("src").agg(F.collect_list("dst").alias("near"))
    joined = r.join(lists, F.col("id") == F.col("src"), "left").select("partition_id", "id", "sketch", F.coalesce("near", F.array().cast("array<string>")).alias("near"))

    def walk(key: tuple, t: pa.Table) -> pa.Table:
        ids, v = t["id"].to_pylist(), _unit(matrix(t["sketch"]))
        place = {x: i for i, x in enumerate(ids)}
        near = [sorted(place[x] for x in ns if x in place) for ns in t["near"].to_pylist()]
        medoid = int((v @ v.mean(0)).argmax())
        number = np.full(len(ids), -1)
        n = 0
        for root in (medoid, *range(len(ids))):  # what the medoid doesn't reach comes after
            queue = deque([root])
            while queue:
                i = queue.popleft()
                if number[i] < 0:
                    number[i] = n
                    n += 1
                    queue += [j for j in near[i] if number[j] < 0]
        return pa.table({"partition_id": t["partition_id"], "id": ids, "at": pa.array(number), "medoid": pa.array(np.arange(len(ids)) == medoid)})

    numbered = joined.groupBy("partition_id").applyInArrow(walk, f"partition_id {r.schema['partition_id'].dataType.simpleString()}, id string, at long, medoid boolean")
    sizes = r.groupBy("partition_id").count().orderBy("partition_id").collect()
    begin = np.concatenate(([0], np.cumsum([x["count"] for x in sizes]))).tolist()
    starts = spark.createDataFrame([(x["partition_id"], b) for x, b in zip(sizes, begin)], f"partition_id {r.schema['partition_id'].dataType.simpleString()}, begin long")
    numbered = numbered.join(F.broadcast(starts), "partition_id").withColumn("nid", F.col("begin") + F.col("at"))
    path = f"{config.shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    numbered.select("id", "nid", "medoid", "partition_id").write.parquet(f"{path}/numbers")
    number = spark.read.parquet(f"{path}/numbers")
    flat = joined.select("id", "sketch", F.explode_outer("near").alias("other")).join(number.select(F.col("id").alias("other"), F.col("nid").alias("to")), "other", "left")
    flat = flat.groupBy("id").agg(F.first("sketch").alias("sketch"), F.sort_array(F.collect_list("to")).alias("neighbors"))
    flat.join(number.select("id", "nid"), "id").select("nid", "sketch", "neighbors", F.col("id").alias("src_id")).write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    entries = number.filter("medoid").join(nodes.select("nid", F.col("sketch").alias("centroid")), "nid").select(F.col("nid").alias("entry_nid"), "centroid")
    return nodes, entries


#: Rows up to which a new node's distances to all before it are taken at once.
ROWS = 20_000


def insert_all(v: np.ndarray, m: int = 16, ef: int = 200, seed: int = 42) -> tuple[int, list[dict[int, list[int]]]]:
    """(entry, adjacency of each level) of a hierarchical graph over the rows, inserted one by one."""
    u = _unit(v)
    r = np.random.default_rng(seed)
    height = np.minimum((-np.log(1 - r.random(len(u))) / np.log(m)).astype(int), 16)
    levels: list[dict[int, list[int]]] = []
    entry = -1

    def walk(level: dict[int, list[int]], far, starts: list[int], width: int) -> list[tuple[float, int]]:
        seen = set(starts)
        todo = sorted(zip(far(starts), starts))
        best = [(-d, i) for d, i in todo]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            near = [j for j in level[i] if j not in seen]
            if not near:
                continue
            seen.update(near)
            for d, j in zip(far(near), near):
                if len(best) < width or d < -best[0][0]:
                    heapq.heappush(todo, (d, j))
                    heapq.heappush(best, (-d, j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def pick(found: list[tuple[float, int]], most: int) -> list[int]:
        c = np.array([i for _, i in found])
        near = np.array([1 - d for d, _ in found])
        return [int(c[j]) for j in diverse(np.arange(len(c)), near, u[c] @ u[c].T, most)]

    for i in range(len(u)):
        q, top = u[i], int(height[i])
        if i < ROWS:  # all distances at once are cheaper than some at a time
            row = 1 - u[:i] @ q
            far = lambda some, row=row: row[some].tolist()
        else:
            far = lambda some, q=q: (1 - u[some] @ q).tolist()
        starts = [entry] if entry >= 0 else []
        for k in range(len(levels) - 1, top, -1):
            starts = [walk(levels[k], far, starts, 1)[0][1]]
        for k in range(min(top, len(levels) - 1), -1, -1):
            found = walk(levels[k], far, starts, ef)
            most = 2 * m if k == 0 else m
            levels[k][i] = pick(found, m)
            for j in levels[k][i]:
                back = levels[k][j]
                back.append(i)
                if len(back) > most:
                    d = (1 - u[back] @ u[j]).tolist()
                    levels[k][j] = pick(sorted(zip(d, back)), most)
            starts = [x for _, x in found]
        while len(levels) <= top:
            levels.append({i: []})
            entry = i
    return entry, levels


def diverse_many(near: np.ndarray, among: np.ndarray, m: int) -> np.ndarray:
    """Which candidates diverse() takes for each of many nodes: near (node, candidate) is how near, nearest first, among (node, candidate, candidate)."""
    free, taken, n = np.ones(near.shape, bool), np.zeros(near.shape, bool), np.zeros(len(near), np.int64)
    for j in range(near.shape[1]):
        now = free[:, j] & (n < m)
        taken[:, j] = now
        n += now
        free &= (among[:, :, j] < near) | ~now[:, None]
    return taken | (~taken & (np.cumsum(~taken, 1) <= (m - n)[:, None]))


def _by_cells(r: DataFrame, m: int, ef: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(meta, nodes), as build_hierarchy() gives them, of rows (id, sketch, shard) in shards of any size, without inserting row by row.

    A level's rows are in the NEAREST cells of some of its own rows; a task holds one cell, or a part of it by a hash, of about
    4 * SHARD rows, where each row links with diverse ones of its ef nearest. A shard's edges, united both ways round, are one
    graph; the nearest 2 m of a node stay, on the upper levels m. Of equal rows the first is linked so, the others in a row.
    """
    spark = r.sparkSession
    path = f"{config.shared_folder(spark)}/hierarchy-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    # numbers in order of id: those within a file, after the rows of the files before
    ranged = r.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "id").sortWithinPartitions("shard", "id")
    ranged = kept(ranged.withColumns({"file": F.spark_partition_id(), "at": F.monotonically_increasing_id(), "x": F.xxhash64("sketch"), "y": F.xxhash64(F.lit(1), "sketch")}), "rows")
    offsets, before = [], {}
    for x in ranged.groupBy("shard", "file").agg(F.min("at").alias("least"), F.count("*").alias("n")).orderBy("shard", "file").collect():  # a row for each file and shard
        offsets.append((x["shard"], x["file"], before.get(x["shard"], 0) - x["least"]))
        before[x["shard"]] = before.get(x["shard"], 0) + x["n"]
    offset = F.broadcast(spark.createDataFrame(offsets, "shard int, file int, offset long"))
    every = ranged.join(offset, ["shard", "file"]).select("shard", (F.col("at") + F.col("offset")).alias("nid"), "id", "sketch", "x", "y")
    row = Window.partitionBy("shard", "x", "y").orderBy("nid")
    equal = every.select("shard", "nid", "x", "y").withColumn("copy", F.row_number().over(row) - 1)
    equal = kept(equal.select("shard", "nid", "copy", F.array_compact(F.array(*[F.lag("nid", i + 1).over(row) for i in range(COPIES)])).alias("others")), "equal")
    unit = (F.pmod(F.xxhash64(F.lit(seed), "shard", "nid"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    height = F.when(F.col("copy") > 0, 0).otherwise(F.least(F.floor(-F.log(unit) / float(np.log(max(m, 2)))), F.lit(16))).cast("int")
    members = every.drop("x", "y").join(equal.drop("others"), ["shard", "nid"]).withColumn("level", F.explode(F.sequence(F.lit(0), height)))
    members = kept(members.select("shard", "level", "nid", "id", "sketch", "copy"), "members")
    linked = members.filter("copy = 0").select("shard", "level", "nid", "sketch")

    # the rows that cells are the nearest of, for levels of more than SHARD: one for SHARD rows, those of the least hashes
    number = {(x["shard"], x["level"]): (-(-x["count"] // SHARD), x["count"]) for x in linked.groupBy("shard", "level").count().collect() if x["count"] > SHARD}  # a row for each level
    share = F.broadcast(spark.createDataFrame([(*k, (4 * p + 16) / n) for k, (p, n) in number.items()], "shard int, level int, share double"))
    few = linked.withColumn("hash", F.pmod(F.xxhash64(F.lit(5), F.lit(seed), "level", "nid"), F.lit(1 << 40))).join(share, ["shard", "level"]).filter(F.col("hash") < F.col("share") * float(1 << 40)).collect()
    some: dict = {}
    for x in sorted(few, key=lambda x: (x["hash"], x["nid"])):
        of = some.setdefault((x["shard"], x["level"]), [])
        if len(of) < number[x["shard"], x["level"]][0]:
            of.append(x["sketch"])
    held = spark.sparkContext.broadcast({k: _unit(np.array(v)) for k, v in some.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch["shard"].to_numpy().astype(np.int64) * 32 + batch["level"].to_numpy()
            for key in np.unique(of).tolist():
                every, pivots = np.flatnonzero(of == key), held.value.get(divmod(key, 32))
                for a in range(0, len(every), 1024):
                    part = batch.take(pa.array(every[a : a + 1024]))
                    k = 1 if pivots is None else min(NEAREST, len(pivots))
                    cell = np.zeros((len(part), 1), int) if pivots is None else np.argsort(-(_unit(matrix(part["sketch"])) @ pivots.T), axis=1, kind="stable")[:, :k]
                    part = part.take(pa.array(np.repeat(np.arange(len(part)), k)))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.ravel().astype(np.int32)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(cell)))], [*part.schema.names, "cell", "turn"])

    kind = "shard int, level int, nid long, sketch array<double>, cell int"
    placed = kept(linked.mapInArrow(place, f"{kind}, turn int"), "placed")
    sizes = placed.groupBy("shard", "level", "cell").count().withColumn("parts", F.greatest(F.lit(1), F.round(F.col("count") / (4 * SHARD))).cast("int"))
    # a row's cells are cut by different hashes, so that parts are linked by the rest
    part = F.pmod(F.xxhash64(F.lit(9), "turn", "nid"), F.col("parts")).cast("int")
    placed = placed.join(F.broadcast(sizes.drop("count")), ["shard", "level", "cell"]).select("shard", "level", "cell", part.alias("part"), "nid", "sketch")  # a row for each cell

    def link(key: tuple, t: pa.Table) -> pa.Table:
        nid, v = t["nid"].to_numpy(), _unit(matrix(t["sketch"])).astype(np.float32)
        k = min(ef, len(nid) - 1)
        found = []
        step = max(1, min(512, (1 << 22) // max(len(nid), k * k, 1)))
        for a in range(0, len(nid) if k > 0 else 0, step):
            cosine = v[a : a + step] @ v.T
            rows = np.arange(len(cosine))
            cosine[rows, a + rows] = -np.inf
            top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(cosine, top, 1)
            order = np.argsort(-near, axis=1, kind="stable")
            top, near = np.take_along_axis(top, order, 1), np.take_along_axis(near, order, 1)
            i, j = np.nonzero(diverse_many(near, v[top] @ v[top].transpose(0, 2, 1), m))
            found.append((nid[a + i], nid[top[i, j]], near[i, j]))
        src, dst, cosine = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        whole = [pa.array(np.full(len(src), x.as_py(), np.int32)) for x in key[:2]]
        return pa.table({"shard": whole[0], "level": whole[1], "src": src, "dst": dst, "cosine": cosine})

    edges = placed.groupBy("shard", "level", "cell", "part").applyInArrow(link, "shard int, level int, src long, dst long, cosine float")
    row_by_row = equal.select("shard", F.lit(0).alias("level"), F.col("nid").alias("src"), F.explode("others").alias("dst"), F.lit(2.0).cast("float").alias("cosine"))
    edges = kept(edges.union(row_by_row), "edges")
    both = edges.union(edges.select("shard", "level", "dst", "src", "cosine")).groupBy("shard", "level", "src", "dst").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("shard", "level", "src").orderBy(F.desc("cosine"), "dst"))
    both = both.withColumn("n", rank).filter(F.col("n") <= F.when(F.col("level") == 0, 2 * m).otherwise(m))
    lists = both.groupBy("shard", "level", F.col("src").alias("nid")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))
    nodes = members.join(lists, ["shard", "level", "nid"], "left").select("shard", "level", "nid", "sketch", F.coalesce("neighbors", F.array().cast("array<long>")).alias("neighbors"), F.col("id").alias("src_id"))
    nodes = kept(nodes, "nodes")
    meta = nodes.groupBy("shard").agg(F.max(F.struct("level", (-F.col("nid")).alias("least"))).alias("top")).select("shard", (-F.col("top.least")).alias("entry_nid"), F.col("top.level").alias("max_level"))
    return kept(meta, "meta"), nodes


def build_hierarchy(rows: DataFrame, m: int = 16, ef: int = 200, seed: int = 42, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(meta, nodes) of rows (id, sketch): meta (shard, entry_nid, max_level), nodes (shard, level, nid, sketch, neighbors, src_id).

    A shard is built in one task; nids are numbers within it, in the order of id. Unless shards says how many
    there are, they hold about SHARD rows at most; if it says so few that they hold more, they are built in cells.
    """
    r = rows.select(F.col("id").cast("string").alias("id"), F.col("sketch").cast("array<double>").alias("sketch")).filter("sketch IS NOT NULL")
    n = r.count()
    large = shards is not None and n > shards * SHARD
    shards = shards or max(1, -(-n // SHARD))
    r = r.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    if large:
        return _by_cells(r, m, ef, seed)

    def make(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        v, ids = matrix(t["sketch"]), t["id"].to_pylist()
        entry, levels = insert_all(v, m, ef, seed)
        out = [(k, i, v[i].tolist(), sorted(near), ids[i], entry, len(levels) - 1) for k, level in enumerate(levels) for i, near in sorted(level.items())]
        cols = list(zip(*out))
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int32()]
        names = ["level", "nid", "sketch", "neighbors", "src_id", "entry_nid", "max_level"]
        return pa.table({"shard": pa.array([key[0].as_py()] * len(out), pa.int32())} | {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)})

    built = r.groupBy("shard").applyInArrow(make, "shard int, level int, nid long, sketch array<double>, neighbors array<long>, src_id string, entry_nid long, max_level int")
    path = f"{config.shared_folder(r.sparkSession)}/hierarchy-{uuid.uuid4().hex}"
    built.write.parquet(path)
    built = r.sparkSession.read.parquet(path)
    return built.select("shard", "entry_nid", "max_level").distinct(), built.drop("entry_nid", "max_level")


class Shard:
    """The levels of one shard, with its entry."""

    def __init__(self, table: pa.Table):
        self.levels: list[Level] = []
        level = table["level"].to_numpy()
        for k in range(int(level.max()) + 1):
            t = table.filter(pa.array(level == k)).sort_by("nid")
            self.levels.append(Level.packed(t))
        self.entry = int(table["nid"].to_numpy()[int(np.flatnonzero(table["door"].to_numpy(zero_copy_only=False))[0])])

    def search(self, q: np.ndarray, ef: int, patience: int) -> list[tuple[int, float]]:
        q = _query(q, self.levels[0].sketch.shape[1])
        at = self.entry
        for g in self.levels[:0:-1]:
            at = int(g.nids[beam(g, q, np.searchsorted(g.nids, [at]), 1)[0][1]])
        g = self.levels[0]
        return [(int(g.nids[i]), d) for d, i in beam(g, q, np.searchsorted(g.nids, [at]), ef, patience)]


#: Shards that this worker keeps, by the plan of their table and their number.
_KEPT: OrderedDict[tuple[int, int], Shard] = OrderedDict()


def hnsw_scan(meta: DataFrame, nodes: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, r1: DataFrame | None = None, ef: int = 64, lim: int = 10, rerank: int = 0, rerank1: int = 0, patience: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance) on a hierarchy: down to level 1 by the nearest node, then a walk of width ef on level 0.

    Every shard gives its candidates. r1 (nid, rerank_vec), with the shard if there are several, reorders them and keeps
    max(rerank1, lim) of each shard; vectors (id, embedding) give the final order. If only they do, and ef is all nodes or
    more, there is nothing to walk: all nodes count, reached or not.
    """
    if lim < 1:
        raise ValueError("lim is at least 1")
    spark = nodes.sparkSession
    patience = int(config.setting(spark, "graphPatience")) if patience is None else patience
    most = int(config.setting(spark, "levelCache"))
    ef = max(ef, lim, 1)
    if "shard" not in meta.columns:
        meta, nodes = meta.withColumn("shard", F.lit(0)), nodes.withColumn("shard", F.lit(0))
    highest = meta.agg(F.max("shard")).first()[0]
    if highest is None:
        raise ValueError("the graph has no entry")
    if vectors is not None and r1 is None and rerank <= 0 and not patience and ef >= nodes.filter("level = 0").count():
        return _all_nodes(nodes.filter("level = 0").join(F.broadcast(meta.select("shard")), "shard", "left_semi"), queries, vectors, lim)
    token = nodes._jdf.queryExecution().analyzed().semanticHash()
    doors = meta.select(F.col("shard").alias("s"), F.col("entry_nid").alias("e"), F.col("max_level").alias("top"))
    graph = nodes.join(F.broadcast(doors), (F.col("shard") == F.col("s")) & (F.col("level") <= F.col("top")))  # a row for each shard
    graph = graph.select(F.col("shard").cast("int").alias("shard"), F.lit(False).alias("asks"), F.col("level").cast("int").alias("level"), F.col("nid").cast("long").alias("nid"), F.col("sketch").cast("array<double>").alias("sketch"), F.col("neighbors").cast("array<long>").alias("neighbors"), (F.col("nid") == F.col("e")).alias("door"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")).filter("query IS NOT NULL")
    none = lambda kind: F.lit(None).cast(kind)
    # few shards are copied, so that every core has some of the queries
    number = int(highest) + 1
    copies = max(1, min(-(-spark.sparkContext.defaultParallelism // number), -(-asked.count() // ASKED)))
    graph = graph.withColumn("shard", F.explode(F.sequence(F.col("shard") * copies, F.col("shard") * copies + copies - 1)))
    asking = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(int(highest)))))
    asking = asking.withColumn("shard", F.col("shard") * copies + F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(copies)).cast("int"))
    asking = asking.select("shard", F.lit(True).alias("asks"), none("int").alias("level"), F.col("query_id").alias("nid"), F.col("query").alias("sketch"), none("array<long>").alias("neighbors"), none("boolean").alias("door"))

    give = max(rerank, lim) if rerank > 0 else ef  # in order of distance and nid

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, shard = -1, None
        for batch in batches:
            number, asks = batch["shard"].to_numpy(), batch["asks"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if number[a] != now:
                    now, held, shard = int(number[a]), [], None
                    own = now // copies
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(part)
                    continue
                if shard is None:
                    shard = _KEPT.get((token, own))
                    if shard is None:
                        if not held:
                            continue  # a number without a shard
                        shard = Shard(pa.Table.from_batches(held))
                        if most:
                            _KEPT[token, own] = shard
                            while len(_KEPT) > most:
                                _KEPT.popitem(last=False)
                    held = []
                out = [(own, i, n, d) for i, q in zip(part["nid"].to_pylist(), matrix(part["sketch"])) for n, d in shard.search(q, ef, patience)[:give]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.float64()))], ["shard", "query_id", "nid", "distance"])

    parted = graph.union(asking).repartitionById(number * copies, F.col("shard")).sortWithinPartitions("shard", "asks")
    found = parted.mapInArrow(answer, "shard int, query_id long, nid long, distance double")

    def first(df: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy("distance", "nid"))
        return df.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")

    if r1 is not None:
        on = ["nid", "shard"] if "shard" in r1.columns else ["nid"]
        found = found.join(r1.select(*on, "rerank_vec"), on, "left").join(asked, "query_id")
        found = found.withColumn("distance", F.coalesce(cosine_distance("rerank_vec", F.slice("query", 1, F.size("rerank_vec"))), F.lit(float("inf"))))
        found = first(found.select("shard", "query_id", "nid", "distance"), max(rerank1, lim))
    found = found.join(nodes.filter("level = 0").select("nid", "shard", F.col("src_id").cast("string").alias("id")), ["nid", "shard"]).drop("shard")
    return _final(found, queries, vectors, lim)


def route_ceiling(truth: DataFrame, placed: DataFrame, probes: DataFrame) -> DataFrame:
    """(r, ceiling): the mean share of the true neighbours (query_id, id) that lie in the query's first r lists; placed (id, partition_id), probes (query_id, r, partition_id)."""
    # the truth is read twice, but found once
    path = f"{config.shared_folder(truth.sparkSession)}/truth-{uuid.uuid4().hex}"
    truth.select("query_id", "id").write.parquet(path)
    truth = truth.sparkSession.read.parquet(path)
    t = truth.join(placed.select("id", "partition_id"), "id").join(probes, ["query_id", "partition_id"])
    total = truth.groupBy().agg(F.count("*").alias("total"))
    each = t.groupBy("r").agg(F.count("*").alias("n")).crossJoin(total)
    return each.select("r", (F.sum("n").over(Window.orderBy("r")) / F.col("total")).alias("ceiling"))


def save_levels(meta: DataFrame, nodes: DataFrame, prefix: str) -> None:
    """A hierarchy as tables {prefix}_meta and {prefix}_nodes, which open_levels() reads."""
    meta.write.parquet(f"{prefix}_meta")
    nodes.write.parquet(f"{prefix}_nodes")


def open_levels(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """A hierarchy that was written as {prefix}_meta and {prefix}_nodes."""
    return spark.read.parquet(f"{prefix}_meta"), spark.read.parquet(f"{prefix}_nodes")
