"""Nearest vectors by inner product from robust-pruned directed graphs, one per shard.

Every distinct vector belongs to one shard by its norm, in narrow ranges, and a hash of its smallest id. A shard's graph is built in batches: greedy searches on the graph so far
propose neighbours, relaxed distance pruning keeps diverse ones, reverse edges are added and pruned where a node has too many; a second pass runs
over the full graph. Inner products become distances by one more coordinate that lifts a shard's vectors to their largest norm, which is scaled to 1, so single precision tells them apart whatever the norms of others. A query runs a beam search in
the shards of the longest vectors and rescores what it found in double precision; of the others it asks those whose longest vector can reach its
k-th score, by the bound of Cauchy and Schwarz. Shards and blocks of queries have a bounded size, so have the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisets.llm.common import stored

SHARD, QUERIES = 8192, 16384  # vectors of a shard on average; queries of a block
DEGREE, BEAM, RELAX = 32, 96, 1.2
FOUND = 128  # beam of the queries
RANGE = 0.25  # octaves of norm that share shards: with wider ones the lift, not the direction, decides who is near, and neighbours are lost
BATCH, WIDE = 256, 4  # points that advance together; nodes a search expands at once
NONE = -1


def search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int):
    """Beam search of all ``q`` at once: ids and distances of the best found, nearest first (NONE, inf behind), and the ids it expanded."""
    n, rows = len(q), np.arange(len(q))[:, None]
    ids, dist, open_ = np.full((n, beam), NONE), np.full((n, beam), np.inf, np.float32), np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0], dist[:, 0], open_[:, 0], seen[:, start] = start, ((q - x[start]) ** 2).sum(1), True, True
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    path = []
    while True:
        order = np.where(open_, np.arange(beam), beam)
        pick = np.partition(order, WIDE - 1, axis=1)[:, :WIDE] if beam > WIDE else order
        live = pick < beam
        if not live.any():
            return ids, dist, np.concatenate(path, 1)
        pick = np.minimum(pick, beam - 1)
        at = np.where(live, ids[rows, pick], NONE)
        open_[np.broadcast_to(rows, pick.shape)[live], pick[live]] = False
        path.append(at)
        near = np.where((at >= 0)[:, :, None], edges[at], NONE).reshape(n, -1)
        near[(near >= 0) & seen[rows, near]] = NONE
        r, c = np.nonzero(near >= 0)
        seen[r, near[r, c]] = True
        # a node proposed twice in one step is kept once
        key = np.sort(near, axis=1)
        key[:, 1:][key[:, 1:] == key[:, :-1]] = NONE
        d = np.where(key >= 0, qq[:, None] + xx[key] - 2 * np.einsum("nkd,nd->nk", x[key], q), np.inf).astype(np.float32)
        every, far = np.concatenate([ids, key], 1), np.concatenate([dist, d], 1)
        new = np.concatenate([open_, key >= 0], 1)
        best = np.argpartition(far, beam - 1, axis=1)[:, :beam]
        best = best[rows, np.argsort(far[rows, best], axis=1, kind="stable")]
        ids, dist, open_ = every[rows, best], far[rows, best], new[rows, best] & np.isfinite(far[rows, best])
        ids = np.where(np.isfinite(dist), ids, NONE)


def prune(x: np.ndarray, points: np.ndarray, options: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each point up to ``degree`` of its options (NONE: none): the nearest is kept and drops those that are ``relax`` times nearer to it."""
    options = np.sort(options, axis=1)
    options[:, 1:][options[:, 1:] == options[:, :-1]] = NONE
    options[options == points[:, None]] = NONE
    v, p = x[options], x[points]
    d = np.where(options >= 0, ((v - p[:, None]) ** 2).sum(2), np.inf)
    sq = (v * v).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out, rows = np.full((len(points), degree), NONE), np.arange(len(points))
    for k in range(degree):
        best = d.argmin(1)
        live = np.isfinite(d[rows, best])
        if not live.any():
            break
        out[live, k] = options[rows, best][live]
        drop = relax * relax * np.maximum(between[rows, best], 0) <= d
        drop[rows, best] = True
        d[live] = np.where(drop[live], np.inf, d[live])
    return out


def add_reverse(x: np.ndarray, edges: np.ndarray, points: np.ndarray, relax: float) -> None:
    """For the out-edges of ``points`` add the edges back, and prune nodes that have no room."""
    source = np.repeat(points, edges.shape[1])
    target = edges[points].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, times = np.unique(target, return_index=True, return_counts=True)
    degree = edges.shape[1]
    for i in range(0, len(nodes), BATCH):
        some, f, t = nodes[i : i + BATCH], first[i : i + BATCH], times[i : i + BATCH]
        coming = np.full((len(some), t.max()), NONE)
        r = np.repeat(np.arange(len(some)), t)
        coming[r, np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)] = source[np.repeat(f, t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)]
        both = np.sort(np.concatenate([edges[some], coming], 1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = NONE
        room = (both >= 0).sum(1) <= degree
        both = -np.sort(-both, axis=1)  # NONE last
        width = min(degree, both.shape[1])
        edges[some[room], :width] = both[room][:, :width]
        edges[some[room], width:] = NONE
        if not room.all():
            edges[some[~room]] = prune(x, some[~room], both[~room], degree, relax)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 1) -> tuple[np.ndarray, int]:
    """Neighbours of each vector, and the vector searches start from: the one nearest to the mean."""
    n = len(x)
    edges = np.full((n, degree), NONE)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    for again in (False, True):
        at = 0 if again else 1
        while at < n:
            some = order[at : min(n, at + (BATCH if again else min(BATCH, at)))]  # batches grow with the graph
            at += len(some)
            ids, _, path = search(x, edges, start, x[some], beam)
            edges[some] = prune(x, some, np.concatenate([ids, path, edges[some]], 1), degree, relax)
            add_reverse(x, edges, some, relax)
    return edges, start


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows over their largest norm, without overflow on the way."""
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum(1).max())


def lifted(v: np.ndarray) -> np.ndarray:
    """Vectors, scaled to a largest norm of 1, with one more coordinate, so that all have it: nearest by distance is largest by inner product."""
    v = scaled(v)
    rest = np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))
    return np.concatenate([v, rest[:, None]], 1).astype(np.float32)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    c = column.combine_chunks()
    sizes = np.diff(c.offsets.to_numpy())
    out = np.zeros((len(c), width))
    out[np.repeat(np.arange(len(c)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = c.flatten().to_numpy()
    return out


def valid(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part: an id, finite components without null, not all zero."""
    v = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.expr("vec_id is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    return v.where(finite)


def log_norm(vector: str):
    """log2 of the norm of any finite vector that is not all zero, without overflow on the way."""
    most = F.expr(f"array_max(transform({vector}, x -> abs(x)))")
    return F.log2(most) + F.log2(F.aggregate(vector, F.lit(0.0), lambda s, x: s + (x / most) * (x / most))) / 2


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding", key: str = "vec_id", shard: int = SHARD, beam: int = FOUND) -> DataFrame:
    """For each row of ``queries`` the ``k`` nearest rows of ``vectors`` found: query_id, rank, vec_id, score, by score, ties by vec_id.

    A candidate is every row but those with the query's id; fewer than k: all found. Equal vectors are one point of a graph with its k + 1 smallest
    ids, which no answer can exceed, so copies cost nothing and none is lost. Rows with a null id or a null, zero or not finite vector take no part;
    repeated rows count once; shorter vectors are filled up with zeros; other columns are ignored; empty tables give an empty one.
    """
    v = valid(vectors, vector, key).distinct()
    few = Window.partitionBy("vector").orderBy("vec_id")
    v = v.withColumn("i", F.row_number().over(few)).where(F.col("i") <= k + 1)
    points = stored(v.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "ann-points")
    points = points.withColumn("range", F.floor(log_norm("vector") / RANGE).cast("int"))
    sizes = points.groupBy("range").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).orderBy(F.desc("range")).collect()  # at most some 8,500
    width, shards, place, held, first = max((r["width"] for r in sizes), default=1), 0, [], 0, 0
    for r in sizes:  # shards are numbered from the longest vectors on; the first ones hold ``shard`` vectors together
        own = math.ceil(r["n"] / shard)
        if held < shard:
            first += min(own, math.ceil((shard - held) * own / r["n"]))
            held += r["n"]
        place.append((r["range"], shards, own))
        shards += own
    spark = points.sparkSession
    low, high = (place[-1][0], place[0][0]) if place else (0, 0)
    ends = {r: start + own for r, start, own in place}
    reach, last = [], 0
    for r in range(high + 1, low - 1, -1):  # how many shards have vectors of this range or longer ones
        last = ends.get(r, last)
        reach.append((r, last))
    reach = F.broadcast(spark.createDataFrame(reach, "range int, last int"))
    place = spark.createDataFrame(place, "range int, first int, own int")
    points = points.join(F.broadcast(place), "range").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64(F.col("members")[0]), F.col("own"))).cast("int"))
    points = points.select("vector", "members", "shard")

    def graph(t: pa.Table) -> pa.Table:
        edges, start = build(lifted(matrix(t.column("vector"), width)))
        return t.append_column("edges", pa.array(list(edges.astype(np.int32)), pa.list_(pa.int32()))).append_column(
            "place", pa.array(np.arange(len(t)), pa.int32())).append_column("start", pa.array(np.arange(len(t)) == start))

    index = stored(points.groupBy("shard").applyInArrow(graph, "vector array<double>, members array<bigint>, shard int, edges array<int>, place int, start boolean"), "ann-index")
    asked = valid(queries, vector, key).distinct()
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def ask(points: pa.Table, asked: pa.Table) -> pa.Table:
        found = ([], [], [])
        if len(points) and len(asked):
            points = points.sort_by("place")
            own, members = matrix(points.column("vector"), width), points.column("members").to_pylist()
            x, edges = lifted(own), np.stack(points.column("edges").to_numpy()).astype(np.int64)
            start = int(np.flatnonzero(points.column("start").to_numpy())[0])
            q, query_ids = matrix(asked.column("vector"), width), asked.column("vec_id").to_pylist()
            for a in range(0, len(q), BATCH):
                some = q[a : a + BATCH]
                unit = np.concatenate([scaled(row[None]) for row in some])
                # where a query's norm differs from the lifted one, distances still order candidates by inner product
                ids, _, _ = search(x, edges, start, np.concatenate([unit, np.zeros((len(some), 1))], 1).astype(np.float32), max(beam, k + 1))
                for row, (mine, query_id) in enumerate(zip(ids, query_ids[a : a + BATCH], strict=True)):
                    mine = mine[mine >= 0]
                    scores = own[mine] @ some[row]
                    listed = sorted((-s, m) for s, i in zip(scores.tolist(), mine, strict=True) for m in members[i] if m != query_id)[:k]
                    found[0].extend([query_id] * len(listed))
                    found[1].extend(m for _, m in listed)
                    found[2].extend(-s for s, _ in listed)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    def hits(asked: DataFrame) -> DataFrame:
        pairs = asked.select("shard", "block").distinct().toDF("shard", "block")  # columns of its own, as the other side has them too
        return index.join(pairs, "shard").groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(
            ask, "query_id bigint, vec_id bigint, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    listed = lambda h: h.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = stored(listed(hits(asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(first, 1) - 1)))))).drop("rank"), "ann-first")
    if first < shards:
        least = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        open_ = asked.join(least.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
        # a vector shorter than least / norm of the query can't come in; the small slack is for rounding
        needed = F.floor((F.log2("least") - log_norm("vector") - 1e-6) / RANGE)
        needed = F.when(F.col("least") > 0, F.greatest(F.lit(low), F.least(F.lit(high + 1), needed))).otherwise(low).cast("int")
        open_ = open_.withColumn("range", needed).join(reach, "range").where(F.col("last") > first)
        open_ = open_.withColumn("shard", F.explode(F.sequence(F.lit(first), F.col("last") - 1))).select("vec_id", "vector", "block", "shard")
        found = found.unionByName(hits(open_))
    return listed(found).select("query_id", "rank", "vec_id", "score")
