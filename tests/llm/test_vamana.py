"""Recall against brute force, exact scores, ties, copies and vectors that take no part."""
import numpy as np
import pytest

from evisets.llm import vamana


def test_recall_and_scores(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(1500, 16)) * r.uniform(0.2, 3, (1500, 1))  # lengths differ
    frame = spark.createDataFrame([(i, v.tolist(), "e", 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, members string, shard int")
    got = vamana.nearest(frame, frame.where("vec_id % 20 = 0"), 20, shard=400).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        best = [i for _, i in sorted((-a, i) for i, a in enumerate(s) if i != q)[:20]]
        hits += len({*best} & {*g.vec_id})
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id], rtol=0, atol=1e-12) and (np.diff(g.score) <= 0).all()
    assert hits / len(got) >= 0.9 and len(got) == 75 * 20


def test_copies_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [5.0, 5.0]), (105, [0.5]),
                                                    (None, [1.0, 1.0]), (106, [float("inf"), 0.0]), (107, []), (104, [5.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vamana.nearest(frame, frame.where("vec_id in (0, 40, 100, 104, 105)"), 5).collect()
    of = lambda q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
    assert of(0) == [(104, 5.0), (1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)]
    assert of(40) == [(104, 5.0), (0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]
    assert of(104) == [(0, 5.0), (1, 5.0), (2, 5.0), (3, 5.0), (4, 5.0)]
    assert of(105) == [(104, 2.5), (0, 0.5), (1, 0.5), (2, 0.5), (3, 0.5)] and of(100) == []
    assert len(vamana.nearest(frame, frame.where("vec_id = 0"), 100).collect()) == 61  # fewer candidates than asked for
    assert vamana.nearest(frame.where("false"), frame, 5).count() == 0 == vamana.nearest(frame, frame.where("false"), 5).count()


def test_very_long_vectors_do_not_blur_the_others(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(800, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[0] *= 1e4
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [1e200] + [0.0] * 15)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vamana.nearest(frame, frame.where("vec_id between 1 and 799 and vec_id % 20 = 1"), 20).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        best = sorted([(-a, i) for i, a in enumerate(x @ x[q]) if i != q] + [(-1e200 * x[q][0], 9000)])[:20]
        hits += len({i for _, i in best} & {*g.vec_id})
    assert len(got) == 40 * 20 and hits / len(got) >= 0.9


@pytest.mark.parametrize("width, spread", [(16, 1.0), (32, 0.5), (32, 1.0), (128, 0.5), (128, 1.0)])
def test_recall_where_lengths_vary(spark, width, spread):
    r = np.random.default_rng(width)
    x = r.normal(size=(3000, width))
    x *= np.exp(spread * r.normal(size=(3000, 1))) / np.sqrt((x * x).sum(1))[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vamana.nearest(frame, frame.where("vec_id % 50 = 0"), 20, shard=1000).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({*np.argsort(-s)[:20]} & {*g.vec_id})
    assert len(got) == 60 * 20 and hits / len(got) >= 0.95
