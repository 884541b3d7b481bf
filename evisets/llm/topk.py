"""Exact top-k inner products over vectors in descending length.

An orthogonal rotation, from the singular vectors of all candidates, moves most of the length into the leading coordinates. Candidates are sorted
by length and packed into slices. A query starts with the k-th best score over the longest vectors as its threshold; by Cauchy-Schwarz a slice
whose longest vector can't reach it is never met. Inside a slice, chunks go from long to short: a query leaves when |q||x| falls below its
threshold; a pair leaves when its partial sum over the leading coordinates, plus the product of the residual lengths, does. What is left is scored
in integers, so results are exact; bounds have a slack above their rounding error. Thresholds rise as a slice is walked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisets.llm.common import shuffle_width, stored

SLICE, QUERIES, SEEDS = 2048, 2048, 2048  # rows of a slice; of a block of queries; longest vectors that give the first thresholds
CHUNK, TURN = 512, 256  # vectors and queries looked at together
SHARES = (0.25, 0.5)  # of the coordinates, at which bounds are checked
DENSE = 0.05  # share of pairs above which a product of whole matrices is faster
SLACK = 1e-9
LOWEST = -(2**63)
PACKED = "number bigint, top double, ids array<bigint>, least array<bigint>, data binary"


def lattice(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """(vec_id, x, length): floor(scale * component) of rows with an id and finite components, and the Euclidean length."""
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    v = v.where(F.expr("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"))
    v = v.select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale))).alias("x"))
    return v.withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as integers, shorter ones filled up with zeros."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = c.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(c), width), np.int64)
    out[np.repeat(np.arange(len(c)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = c.flatten().to_numpy()
    if len(out) and np.sqrt((out.astype(float) ** 2).sum(1).max()) >= 2**31:
        raise OverflowError("a vector of length 2^31 or more has no exact 64-bit inner products")
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact: through doubles where no sum can pass their integers."""
    most = [np.sqrt((m.astype(float) ** 2).sum(1).max(initial=0)) for m in (q, x)]
    kind = np.float64 if most[0] * most[1] < 2**52 else np.int64
    return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)


def rotation(points: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, strongest first, from the matrix of their second moments."""

    def moments(batches):
        g = np.zeros((width, width))
        for b in batches:
            x = matrix(b.column("x"), width).astype(float)
            g += x.T @ x
        yield pa.record_batch([pa.array(np.arange(width), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], ["i", "g"])

    cells = points.select("x").mapInArrow(moments, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "g"))
    g = np.zeros((width, width))
    for r in cells.groupBy("i", "j").agg(F.sum("g").alias("g")).toLocalIterator():  # width x width numbers
        g[r.i, r.j] = r.g
    return np.linalg.eigh(g)[1][:, ::-1]


def pack(rows: int, width: int):
    """Rows (vec_id, x, least, top), as they come, to blocks of ``rows``."""

    def run(batches):
        held, n, number = [], 0, 0
        partition = TaskContext.get().partitionId()

        def block(t: pa.Table):
            return pa.RecordBatch.from_arrays([
                pa.array([(partition << 32) | number], pa.int64()), pa.array([t.column("top")[0].as_py()], pa.float64()),
                pa.array([t.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([t.column("least").to_pylist()], pa.list_(pa.int64())),
                pa.array([matrix(t.column("x"), width).astype(np.int32).tobytes()], pa.binary())], ["number", "top", "ids", "least", "data"])

        for b in batches:
            held.append(b)
            n += len(b)
            while n >= rows:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, rows))
                held, n, number = t.slice(rows).to_batches(), n - rows, number + 1
        if n:
            yield block(pa.Table.from_batches(held))

    return run


def first_k(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` best of each query: largest score, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    return query[rank < k], score[rank < k], ids[rank < k], rank[rank < k]


def walk(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, least: np.ndarray, axes: np.ndarray, k: int, counts: list | None = None):
    """(query, score, id) of candidates, at most ``k`` a query, that hold all of the k best of a slice that reach ``least``.

    ``x`` is sorted by descending length. ``counts`` gets how many pairs each bound left.
    """
    cuts = [max(1, int(s * x.shape[1])) for s in SHARES]
    xr, qr = x @ axes, q @ axes
    xl, ql = np.sqrt((xr * xr).sum(1)), np.sqrt((qr * qr).sum(1))
    rest = [(np.sqrt((xr[:, c:] ** 2).sum(1)), np.sqrt((qr[:, c:] ** 2).sum(1))) for c in cuts]
    least = least.copy()
    best = (np.zeros(0, np.int64),) * 3
    for a in range(0, len(x), CHUNK):
        b = min(a + CHUNK, len(x))
        room = SLACK * (1 + ql * xl[a])
        live = np.flatnonzero(ql * xl[a] + room >= least)
        if not len(live):
            break
        bound = qr[live, : cuts[0]] @ xr[a:b, : cuts[0]].T
        bound += rest[0][1][live][:, None] * rest[0][0][None, a:b]
        r, c = np.nonzero(bound + room[live][:, None] >= least[live][:, None])
        left = [len(live) * (b - a), len(r)]
        if len(r) > DENSE * len(live) * (b - a):
            score = products(q[live], x[a:b])
            r, c = np.nonzero(score >= least[live][:, None])
            score, r, c = score[r, c], live[r], c + a
        else:
            r, c = live[r], c + a
            s = np.einsum("ij,ij->i", qr[r, : cuts[1]], xr[c, : cuts[1]]) + rest[1][1][r] * rest[1][0][c]
            near = s + room[r] >= least[r]
            r, c = r[near], c[near]
            left.append(len(r))
            score = np.einsum("ij,ij->i", q[r], x[c])
        if counts is not None:
            counts.append(left)
        keep = (score >= least[r]) & (ids[c] != own[r])
        best = first_k(np.concatenate([best[0], r[keep]]), np.concatenate([best[1], score[keep]]), np.concatenate([best[2], ids[c[keep]]]), k)
        full = best[3] == k - 1
        least[best[0][full]] = np.maximum(least[best[0][full]], best[1][full])
        best = best[:3]
    return best


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """For each row of ``queries`` the ``k`` rows of ``vectors`` with the largest integer inner product: query_id, rank, vec_id, score.

    Components become floor(scale * x). Equal scores go to the smaller vec_id; rows with the query's id are no candidates; a query with fewer
    than ``k`` candidates gets all. Rows that repeat are rows of their own, as query and as candidate. Rows with a null id or a null, NaN or
    infinite component or vector take no part; zero and empty vectors do; shorter vectors are filled up with zeros. Other columns are ignored;
    an empty table on either side gives an empty result. A vector of length 2^31 or more after scaling raises an OverflowError.
    """
    spark = vectors.sparkSession
    points = stored(lattice(vectors, vector, key, scale), "topk-points")
    n, width = points.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    asked = lattice(queries, vector, key, scale)
    width = max(1, width, asked.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0])
    axes = rotation(points, width)
    longest = points.orderBy(F.desc("length"), "vec_id").limit(SEEDS).toArrow()  # SEEDS vectors
    seeds, seed_ids = matrix(longest.column("x"), width), longest.column("vec_id").to_numpy()

    def thresholds(batches):
        for b in batches:
            out = []
            for a in range(0, len(b), TURN):
                some = b.slice(a, TURN)
                s = products(matrix(some.column("x"), width), seeds)
                s[some.column("vec_id").to_numpy(zero_copy_only=False)[:, None] == seed_ids[None, :]] = LOWEST
                out.append(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(some), LOWEST))
            least, length = np.concatenate(out or [np.zeros(0, np.int64)]), b.column("length").to_numpy()
            # the shortest candidate that can reach the threshold
            need = np.where(least > 0, least / np.maximum(length, 1e-300), 0.0) * (1 - SLACK)
            yield pa.record_batch([b.column("vec_id"), b.column("x"), pa.array(least, pa.int64()), pa.array(need, pa.float64())], ["vec_id", "x", "least", "top"])

    def blocks(df, rows, total, *order):
        parts = max(shuffle_width(spark), -(-total // (16 * rows)))
        dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        return dealt.select("vec_id", "x", "least", "top").mapInArrow(pack(rows, width), PACKED)

    slices = points.withColumns({"least": F.lit(0).cast("long"), "top": F.col("length")})
    slices = stored(blocks(slices, SLICE, n, F.desc("top"), F.col("vec_id")), "topk-slices")
    asked = stored(asked.mapInArrow(thresholds, "vec_id bigint, x array<bigint>, least bigint, top double"), "topk-queries")
    m = asked.count()
    parts = -(-m // QUERIES)
    ordered = asked.repartitionByRange(max(1, parts), "top").sortWithinPartitions("top")
    ordered = stored(ordered.mapInArrow(pack(QUERIES, width), PACKED), "topk-queries").select(
        F.col("number").alias("block"), F.col("top").alias("need"), F.col("ids").alias("query_ids"), "least", F.col("data").alias("asked"))

    def search(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for row in batch.to_pylist():
                x, q = (np.frombuffer(row[c], np.int32).astype(np.int64).reshape(-1, width) for c in ("data", "asked"))
                ids, own, least = (np.array(row[c], np.int64) for c in ("ids", "query_ids", "least"))
                for a in range(0, len(q), TURN):
                    at, score, found = walk(x, ids, q[a : a + TURN], own[a : a + TURN], least[a : a + TURN], axes, k)
                    for o, values in zip(out, (np.full(len(at), row["block"]), at + a, own[at + a], found, score), strict=True):
                        o.append(values.astype(np.int64))
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(o), pa.int64()) for o in out], ["block", "place", "query_id", "vec_id", "score"])

    # blocks of a query set against slices of all rows; blocks are sorted by need, so a slice of short vectors meets few
    met = slices.drop("least").join(ordered, F.col("top") >= F.col("need")).select("data", "ids", "block", "query_ids", "least", "asked")
    hits = met.mapInArrow(search, "block bigint, place bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
