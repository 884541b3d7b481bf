"""Lloyd rounds against a plain loop over integers; odd vectors, ties, copies and empty tables."""
import hashlib

import numpy as np
import pytest

from evisets.llm import lloyd


def plain(rows, k, rounds, width, seed="2:"):
    """rows: (id, vector) with exact integers."""
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(x) for _, x in order[:k]]

    def near(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        label = [near(x)[0] for _, x in kept]
        for j in range(len(c)):
            own = [x for (_, x), g in zip(kept, label, strict=True) if g == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out = [(i, *near(x)) for i, x in kept]
    total = sum(r[2] for r in out)
    return sorted((repr(i), g, d, sum(r[2] for r in out if r[1] == g), total, hashlib.sha256(",".join(map(str, c[g])).encode()).hexdigest()) for i, g, d in out)


def rows_of(df):
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize(("width", "columns", "cells"), [(64, 32, 1 << 18), (7, 3, 64)])
def test_equals_a_plain_loop(spark, monkeypatch, width, columns, cells):
    monkeypatch.setattr(lloyd, "CELLS", cells)
    r = np.random.default_rng(2)
    x = r.normal(size=(300, width)) + r.integers(-2, 3, (300, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)] + [rows[5], rows[5], (None, rows[6][1])]  # copies, repeated rows, a null id
    odd = [(2000, None), (2001, []), (2002, [1.0] * (width - 1)), (2003, [1.0] * (width + 1)), (2004, [float("nan")] * width), (2005, [None] * width),
           (2006, [float("inf")] * width)]
    frame = spark.createDataFrame([(*t, 1, 2, 3) for t in rows + odd], "vec_id long, embedding array<double>, cluster int, block int, x int")
    got, centroids = lloyd.cluster(frame, 9, 3, width=width, columns=columns)
    assert rows_of(lloyd.report(got, centroids)) == plain(rows, 9, 3, width)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [0.0, 0.0]) for i in range(6)] + [(9, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = rows_of(lloyd.report(*lloyd.cluster(frame, 5, 2, width=2)))
    assert got == plain(rows, 5, 2, 2) and len({r[1] for r in got}) <= 2
    assert rows_of(lloyd.report(*lloyd.cluster(frame.limit(1), 5, 2, width=2)))[0][1:4] == (0, 0, 0)  # fewer rows than clusters


def test_nothing_and_too_much(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got, centroids = lloyd.cluster(frame.where("false"), 4, 2, width=2)
    assert lloyd.report(got, centroids).count() == 0 == centroids.count()
    with pytest.raises(Exception, match="exact 64-bit"):
        lloyd.cluster(spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<double>"), 4, 2, width=2)


def test_partial_distances_beyond_doubles():
    x, c = np.array([[2**30, 1, -5]]), np.array([[-(2**30), 0, 2]])
    assert lloyd.distances(x, c).tolist() == [[2**62 + 1 + 49]]
