"""The search of each trait against the same rule on one wide grid."""
import numpy as np

from evisets.operators import shrink


def rule(errors, flat=1e-6):
    lo, hi = -1, 1
    side = (lambda k: -1 if k == lo else 1 if k == hi else 0)(min((errors[k], k) for k in (-1, 0, 1))[1])
    while True:
        rss, k = min((errors[k], k) for k in range(lo, hi + 1))
        if lo < k < hi or not rss < errors[k + 1 if k == lo else k - 1] * (1 - flat):
            return k, not lo < k < hi
        lo, hi = (lo - 2, hi) if side < 0 else (lo, hi + 2)


def test_each_trait_moves_its_own_grid(spark):
    g = np.random.default_rng(2)
    X = (g.random((60, 8)) < 0.4) * 1.0
    Y = np.column_stack([X[:, 0] * 2 + g.normal(size=60) * 0.1, g.normal(size=60), X[:, 1:3].sum(1) * 0.3 + g.normal(size=60) * 0.2])
    m = spark.createDataFrame([(j, i, float(X[i, j])) for i in range(60) for j in range(8) if X[i, j]], "set_id long, entity_id long, weight double")
    y = spark.createDataFrame([(i, t, float(Y[i, t])) for i in range(60) for t in range(3)] + [(0, 9, None)], "entity_id long, trait long, value double")
    folds = spark.createDataFrame([(i, i % 3) for i in range(60)], "entity_id long, fold long")
    for start in (1e-3, 10.0):
        wide = shrink.cv_sigma(m, y.where("value is not null"), folds, [start * 10.0 ** k for k in range(-9, 10)], 0.2, None).collect()
        got = {r.trait: r for r in shrink.cross_validate(m, y, folds, start, 1, 0.2, None).collect()}
        assert set(got) == {0, 1, 2}
        for t, r in got.items():
            k, flat = rule({round(np.log10(w.sigma2 / start)): w.rss for w in wide if w.trait == t})
            assert round(np.log10(r.sigma2 / start)) == k and r.flat == flat and not r.at_edge
