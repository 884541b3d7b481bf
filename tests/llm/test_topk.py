"""Exact results against brute force, whatever the lengths; ties, copies and rows that take no part."""
import numpy as np
import pytest

from evisets.llm import topk


def plain(rows, queries, k):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    whole = lambda v: [int(np.floor(256 * np.float64(x))) for x in v]
    kept = [(i, whole(v)) for i, v in rows if i is not None and ok(v)]
    out = []
    for q, v in queries:
        if q is None or not ok(v):
            continue
        v = whole(v)
        best = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in kept if i != q)[:k]  # noqa: B905
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.5])
def test_equals_brute_force(spark, monkeypatch, spread):
    for name, value in {"SLICE": 64, "QUERIES": 16, "SEEDS": 32, "CHUNK": 20, "TURN": 7}.items():
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 12)) * np.geomspace(4, 0.1, 12) * np.exp(spread * r.normal(size=(700, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame([(*t, 1, 2.0, 3) for t in rows], "vec_id long, embedding array<double>, least int, top double, number int")
    got = topk.top_products(frame, frame.where("vec_id % 10 = 0"), 5)
    assert rows_of(got) == plain(rows, rows[::10], 5)


def test_bounds_prune_without_losing(monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 50)
    r = np.random.default_rng(5)
    x = (256 * r.normal(size=(1000, 16)) * np.geomspace(8, 0.05, 16) * np.exp(r.normal(size=(1000, 1)))).astype(np.int64)
    x = x[np.argsort(-(x * x).sum(1))]
    axes = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    q, counts = x[::50], []
    at, score, ids = topk.walk(x, np.arange(1000), q, np.full(len(q), -1), np.full(len(q), topk.LOWEST), axes, 3, counts)
    for i in range(len(q)):
        s = x @ q[i]
        best = sorted((-v, j) for j, v in enumerate(s.tolist()))[:3]
        assert [(-v, j) for v, j in zip(score[at == i].tolist(), ids[at == i].tolist(), strict=True)] == best
    first = [c[1] / c[0] for c in counts[1:]]
    assert sum(c[0] for c in counts) < 0.7 * len(q) * 1000 and min(first) < 0.2  # lengths end walks, leading coordinates drop pairs


def test_ties_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [5.0, 5.0]), (105, [0.5]),
                                                    (None, [1.0, 1.0]), (106, [float("inf"), 0.0]), (107, []), (108, [-1.0, -3.0]), (104, [5.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [r for r in rows if r[0] in (0, 40, 100, 101, 104, 105, 107, 108)]
    got = topk.top_products(frame, frame.where("vec_id in (0, 40, 100, 101, 104, 105, 107, 108)"), 5)
    assert rows_of(got) == plain(rows, asked, 5)
    assert topk.top_products(frame, frame.where("vec_id = 0"), 100).count() == 65  # fewer candidates than asked for
    assert topk.top_products(frame.where("false"), frame, 5).count() == 0 == topk.top_products(frame, frame.where("false"), 5).count()
    with pytest.raises(Exception, match="exact 64-bit"):
        topk.top_products(spark.createDataFrame([(1, [1e12])], "vec_id long, embedding array<double>"), frame, 5).count()


def test_a_third_of_all_rows_is_one_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLICE", 32)
    r = np.random.default_rng(6)
    x = r.normal(size=(200, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_products(frame, frame.where("vec_id % 20 = 3 or vec_id = 1050"), 5)
    assert rows_of(got) == plain(rows, [t for t in rows if t[0] % 20 == 3 or t[0] == 1050], 5)


def test_products_beyond_doubles():
    q, x = np.array([[2**30, 1]]), np.array([[2**30, 1], [-(2**30), 3]])
    assert topk.products(q, x).tolist() == [[2**60 + 1, -(2**60) + 3]]
