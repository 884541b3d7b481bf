"""Centroid clustering by Lloyd rounds whose work is dealt by blocks of columns.

Vectors are cut into column blocks and packed: a chunk is some thousand rows, a slice is one block of columns of a chunk, stored by block. In a
round, tasks over slices compute exact partial squared distances to their block's slice of the centroids; the partial distances of a chunk are
added over its blocks, and the smallest sum names the cluster. The labels go back to the slices, each block sums its own columns by cluster and
so updates its own slice of the centroids. All numbers are integers, so sums don't depend on their order and a lost task changes nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisets.llm.common import shared_folder, stored

COLUMNS = 32  # of a block
CELLS = 1 << 18  # rows of a chunk times centroids
SMALL = 32 << 20  # bytes of centroids that may be broadcast
IDS = -1  # the block that holds a chunk's ids
SLICES = "chunk bigint, rows int, ids array<bigint>, data binary, block int"


def lattice(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", width: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the rows with exactly ``width`` finite components."""
    v = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    v = v.where(F.expr(f"size(v) = {width} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"))
    return v.select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale))).alias("x"))


def slices(points: DataFrame, width: int, rows: int, columns: int = COLUMNS) -> DataFrame:
    """The stored slices (chunk, rows, ids, data, block) of ``lattice`` rows, a folder for each block; a block IDS holds the ids."""
    largest = int((2**60 / width) ** 0.5)

    def pack(batches):
        held, n, number = [], 0, 0
        partition = TaskContext.get().partitionId()

        def chunk(t: pa.Table, number: int):
            x = t.column("x").combine_chunks().flatten().to_numpy().reshape(len(t), width)
            if np.abs(x).max() > largest:
                raise OverflowError(f"components beyond {largest} have no exact 64-bit distance")
            starts = range(0, width, columns)
            data = [None, *(np.ascontiguousarray(x[:, a : a + columns], np.int32).tobytes() for a in starts)]
            ids = [t.column("vec_id").to_pylist(), *([None] * len(starts))]
            return pa.RecordBatch.from_arrays([
                pa.array([(partition << 32) | number] * len(data), pa.int64()), pa.array([len(t)] * len(data), pa.int32()),
                pa.array(ids, pa.list_(pa.int64())), pa.array(data, pa.binary()), pa.array([IDS, *range(len(starts))], pa.int32())],
                ["chunk", "rows", "ids", "data", "block"])

        for b in batches:
            held.append(b)
            n += len(b)
            while n >= rows:
                t = pa.Table.from_batches(held)
                yield chunk(t.slice(0, rows), number)
                held, n, number = t.slice(rows).to_batches(), n - rows, number + 1
        if n:
            yield chunk(pa.Table.from_batches(held), number)

    spark = points.sparkSession
    path = f"{shared_folder(spark)}/lloyd-slices-{uuid.uuid4().hex}"
    points.select(F.col("vec_id").cast("long"), "x").mapInArrow(pack, SLICES).write.partitionBy("block").parquet(path)
    return spark.read.schema(SLICES).parquet(path)


def beginning(points: DataFrame, k: int, seed: str, width: int, columns: int = COLUMNS) -> DataFrame:
    """(block, cluster, x): the ``k`` rows with the smallest sha256 of seed and id, cut into blocks; rows with equal ids by their vector."""
    h = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = points.select(h.alias("h"), "x").orderBy("h", "x").limit(k)  # k rows
    first = first.select((F.row_number().over(Window.orderBy("h", "x")) - 1).alias("cluster"), "x")
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), F.slice("x", a + 1, columns).alias("x")) for i, a in enumerate(range(0, width, columns))])
    return first.select("cluster", F.explode(blocks).alias("b")).select("b.block", "cluster", "b.x")


def whole(centroids: DataFrame) -> DataFrame:
    """(block, centroids): each block's slice of all centroids, cluster by cluster."""
    listed = F.sort_array(F.collect_list(F.struct("cluster", "x")))
    return centroids.groupBy("block").agg(F.flatten(F.transform(listed, lambda s: s["x"])).alias("centroids"))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``c``, as integers; through doubles where these are exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    kind = np.float64 if 8 * x.shape[1] * top * top < 2**53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)).astype(np.int64)


def nearest(parts: DataFrame, centroids: DataFrame, bounded: bool) -> DataFrame:
    """(chunk, clusters, distances) of each chunk's rows: partial distances of its blocks, added, and the smallest, ties to the smaller number."""

    def partial(batches):
        for b in batches:
            out = []
            for rows, data, c in zip(b.column("rows").to_pylist(), b.column("data"), b.column("centroids"), strict=True):
                x = np.frombuffer(data.as_buffer(), np.int32).reshape(rows, -1)
                d = distances(x, c.values.to_numpy().reshape(-1, x.shape[1]))
                out.append((d.astype(np.int32) if d.max(initial=0) < 2**31 else d).tobytes())  # half the shuffle where it is enough
            yield pa.record_batch([b.column("chunk"), b.column("rows"), pa.array(out, pa.binary())], ["chunk", "rows", "partial"])

    def least(t: pa.Table) -> pa.Table:
        rows, total = t.column("rows")[0].as_py(), 0
        for p in t.column("partial"):
            cells = len(p.as_buffer())
            total = total + np.frombuffer(p.as_buffer(), np.int32 if cells == 4 * rows * k else np.int64).reshape(rows, k)
        best = total.argmin(1)
        return pa.table({"chunk": t.column("chunk")[:1], "clusters": pa.array([best.astype(np.int32)], pa.list_(pa.int32())),
                         "distances": pa.array([total[np.arange(rows), best].astype(np.int64)], pa.list_(pa.int64()))})

    k = centroids.where("block = 0").count()
    met = parts.join(F.broadcast(whole(centroids)) if bounded else whole(centroids), "block")
    added = met.select("chunk", "rows", "data", "centroids").mapInArrow(partial, "chunk bigint, rows int, partial binary")
    return added.groupBy("chunk").applyInArrow(least, "chunk bigint, clusters array<int>, distances array<bigint>")


def moved(parts: DataFrame, labels: DataFrame, centroids: DataFrame) -> DataFrame:
    """The next centroids: in each block the floor of the mean of a cluster's columns; a cluster without rows stays."""

    def sums(batches):
        total = {}  # by block: columns x clusters of this task
        for b in batches:
            for block, rows, data, c in zip(b.column("block").to_pylist(), b.column("rows").to_pylist(), b.column("data"), b.column("clusters"), strict=True):
                x, label = np.frombuffer(data.as_buffer(), np.int32).reshape(rows, -1), c.values.to_numpy()
                order = np.argsort(label, kind="stable")
                names, first, n = np.unique(label[order], return_index=True, return_counts=True)
                for name, s, m in zip(names.tolist(), np.add.reduceat(x[order].astype(np.int64), first, axis=0), n.tolist(), strict=True):
                    s0, m0 = total.get((block, name), (0, 0))
                    total[block, name] = s0 + s, m0 + m
        keys = list(total)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                               pa.array([total[k][1] for k in keys], pa.int64()), pa.array([total[k][0] for k in keys], pa.list_(pa.int64()))],
                              ["block", "cluster", "n", "sums"])

    s = parts.join(labels.select("chunk", "clusters"), "chunk").select("block", "rows", "data", "clusters").mapInArrow(
        sums, "block int, cluster int, n bigint, sums array<bigint>")
    s = s.select("block", "cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("block", "cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    s = s.select("block", "cluster", "at", F.expr("(s - pmod(s, n)) div n").alias("x"))  # the floor
    s = s.groupBy("block", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda t: t["x"]).alias("new"))
    return centroids.join(s, ["block", "cluster"], "left").select("block", "cluster", F.coalesce("new", "x").alias("x"))


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2:", vector: str = "embedding", key: str = "vec_id", width: int = 64,
            scale: int = 256, columns: int = COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Assignments (vec_id, cluster, distance) after ``rounds`` Lloyd rounds, and the centroids (block, cluster, x), both stored.

    Kept are vectors of exactly ``width`` components, none null, NaN or infinite; the others and null vectors get no row. Components become
    floor(scale * x). Every kept row counts, also where it repeats; a null id counts as the empty text for the choice of the first centroids.
    With fewer than ``k`` kept rows there are as many centroids as rows; without any, both tables are empty. Equal distances go to the smaller
    cluster number; equal first centroids leave the larger numbers empty, and an empty cluster keeps its centroid. Other columns are ignored.
    A component whose squared distances might not fit 64 bits raises an OverflowError.
    """
    points = lattice(vectors, vector, key, width, scale)
    centroids = stored(beginning(points, k, seed, width, columns), "lloyd-centroids")
    parts = slices(points, width, max(1, CELLS // k), columns)
    ids, parts = parts.where(F.col("block") == IDS).select("chunk", "ids"), parts.where(F.col("block") >= 0)
    bounded = 8 * k * width <= SMALL
    for _ in range(rounds):
        labels = stored(nearest(parts, centroids, bounded), "lloyd-labels")
        centroids = stored(moved(parts, labels, centroids), "lloyd-centroids")
    last = nearest(parts, centroids, bounded).join(ids, "chunk")
    rows = last.select(F.explode(F.arrays_zip("ids", "clusters", "distances")).alias("r")).select(
        F.col("r.ids").alias("vec_id"), F.col("r.clusters").alias("cluster"), F.col("r.distances").alias("distance"))
    return stored(rows, "lloyd-rows"), centroids


def report(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Rows of ``cluster`` with the inertia of their cluster, the whole inertia, and the sha256 of their centroid's decimal components."""
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "x"))), lambda s: s["x"]))
    digest = centroids.groupBy("cluster").agg(F.sha2(F.concat_ws(",", F.transform(listed, lambda x: x.cast("string"))), 256).alias("centroid_sha256"))
    total = per.agg(F.sum("cluster_inertia")).scalar()
    return rows.join(per.join(digest, "cluster").withColumn("inertia", total), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
