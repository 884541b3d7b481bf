"""Grouped regressions against dense NumPy, one group at a time."""
import numpy as np
from pyspark.sql import functions as F

from evisets.operators import grouped


def data(spark, traits=5, n=60, seed=1):
    g = np.random.default_rng(seed)
    X = g.normal(size=(n, 2))
    Y = X @ g.normal(size=(2, traits)) + g.standard_t(1.5, size=(n, traits)) + 0.3
    rows = [(i, t, *map(float, X[i]), float(Y[i, t])) for i in range(n) for t in range(traits)]
    return X, Y, spark.createDataFrame(rows, "entity_id long, trait long, a double, b double, y double")


def edges(spark, n, per_trait=None):
    g = np.random.default_rng(9)
    R = np.eye(n)
    for a, b in g.integers(0, n, size=(n, 2)):
        if a != b:
            R[a, b] = R[b, a] = 0.4
    R[0, 1:] = R[1:, 0] = 0.1  # one entity with everyone
    listed = [(int(a), int(b), float(R[a, b])) for a, b in zip(*np.nonzero(R))]
    return R, spark.createDataFrame(listed, "entity_a long, entity_b long, r double")


def huber(D, y, tol=1e-10):
    b = np.linalg.lstsq(D, y, rcond=None)[0]
    for _ in range(5000):
        res = np.abs(y - D @ b)
        w = np.where(res <= 1, 1, 1 / np.maximum(res, 1e-300))
        new = np.linalg.solve((D.T * w) @ D, (D.T * w) @ y)
        if np.abs(new - b).max() < tol:
            break
        b = new
    res = np.abs(y - D @ new)
    loss = np.where(res <= 1, res ** 2 / 2, res - 0.5).sum()
    return new, np.where(res <= 1, 1, 1 / np.maximum(res, 1e-300)), loss


def by_term(df, *keys):
    return {tuple(r[k] for k in (*keys, "term")): r for r in df.collect()}


def test_huber_of_many_traits_equals_each_alone(spark):
    X, Y, df = data(spark)
    got = by_term(grouped.huber_groups(df, ["a", "b"], "y", ["trait"], tol=1e-8), "trait")
    D = np.column_stack([X, np.ones(len(X))])
    inv = np.linalg.inv(D.T @ D)
    assert len(got) == 15
    for t in range(5):
        b, _, loss = huber(D, Y[:, t])
        for i, term in enumerate(("a", "b", "intercept")):
            r = got[t, term]
            assert r.converged and r.n_rows == 60 and abs(r.beta - b[i]) < 1e-6 and abs(r.se - np.sqrt(loss / 57 * inv[i, i])) < 1e-6


def test_sandwich_and_robust_sandwich(spark, monkeypatch):
    monkeypatch.setattr("evisets.plans.iterate.HEAVY", 20)  # the popular entity is split
    X, Y, df = data(spark, 3)
    R, e = edges(spark, len(X))
    e = e.withColumn("trait", F.explode(F.array(*[F.lit(t).cast("long") for t in range(3)]))).withColumn("r", F.when(
        (F.col("trait") == 2) & (F.col("entity_a") != F.col("entity_b")), F.col("r") / 2).otherwise(F.col("r")))
    D = np.column_stack([X, np.ones(len(X))])
    inv = np.linalg.inv(D.T @ D)
    plain = by_term(grouped.sandwich_ols(df, ["a", "b"], "y", ["trait"], e), "trait")
    robust = by_term(grouped.huber_groups(df, ["a", "b"], "y", ["trait"], tol=1e-8, entity_corr=e), "trait")
    for t in range(3):
        Rt = R if t < 2 else (R + np.eye(len(X))) / 2
        V = inv @ D.T @ Rt @ D @ inv
        beta = inv @ D.T @ Y[:, t]
        b, w, _ = huber(D, Y[:, t])
        Dw = D * np.sqrt(w)[:, None]
        U = inv @ Dw.T @ Rt @ Dw @ inv
        for i, term in enumerate(("a", "b", "intercept")):
            assert abs(plain[t, term].beta - beta[i]) < 1e-8 and abs(plain[t, term].se - np.sqrt(V[i, i])) < 1e-8
            assert abs(robust[t, term].beta - b[i]) < 1e-6 and abs(robust[t, term].se - np.sqrt(U[i, i])) < 1e-6


def test_edge_cases(spark):
    rows = [(i, "ok", float(i % 5), float(i)) for i in range(20)] + [(i, "nulls", None if i % 2 else float(i), float(i)) for i in range(8)]
    rows += [(i, "flat", 1.0, 2.0) for i in range(6)] + [(0, "nan", float("nan"), 1.0), (1, "nan", 1.0, 1.0)] + [(0, "one", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "entity_id long, trait string, a double, y double")
    got = by_term(grouped.huber_groups(df, ["a"], "y", ["trait"]), "trait")
    assert {t for t, _ in got} >= {"ok", "nulls", "flat", "one"} and got["nulls", "a"].n_rows == 4
    assert abs(got["flat", "a"].beta + got["flat", "intercept"].beta - 2) < 1e-9 and all(r.converged for r in got.values())
    assert not any(r.converged for r in grouped.huber_groups(df.where("trait = 'ok'").withColumn("y", F.exp("y")), ["a"], "y", ["trait"], max_rounds=1, tol=1e-14).collect())
    assert grouped.huber_groups(df.where("false"), ["a"], "y", ["trait"]).count() == 0
    none = spark.createDataFrame([], "entity_a long, entity_b long, r double")
    assert {r.se for r in grouped.sandwich_ols(df.where("trait = 'ok'"), ["a"], "y", ["trait"], none).collect()} == {0.0}


def test_factor_trait_fit_counts_absent_pairs_as_zero(spark):
    g = np.random.default_rng(4)
    X = g.random((40, 3))
    Y = np.where(g.random((40, 2)) < 0.4, g.normal(size=(40, 2)) * 3, 0.0)
    wide = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "entity_id long, f1 double, f2 double, c double")
    y = spark.createDataFrame([(i, t, float(Y[i, t])) for i in range(40) for t in range(2) if Y[i, t]] + [(999, 0, 5.0)], "entity_id long, trait long, value double")
    D = np.column_stack([X, np.ones(40)])
    inv = np.linalg.inv(D.T @ D)
    plain = {(r.trait, r.factor): r for r in grouped.factor_trait_fit(wide, ["f1", "f2"], y, ["c"]).collect()}
    robust = {(r.trait, r.factor): r for r in grouped.factor_trait_fit(wide, ["f1", "f2"], y, ["c"], robust=True, tol=1e-8).collect()}
    assert len(plain) == len(robust) == 4
    for t in range(2):
        beta = inv @ D.T @ Y[:, t]
        var = ((Y[:, t] - D @ beta) ** 2).sum() / 36
        b, _, loss = huber(D, Y[:, t])
        for i, f in enumerate(("f1", "f2")):
            assert abs(plain[t, f].beta - beta[i]) < 1e-9 and abs(plain[t, f].se - np.sqrt(var * inv[i, i])) < 1e-9
            assert abs(robust[t, f].beta - b[i]) < 1e-6 and abs(robust[t, f].se - np.sqrt(loss / 36 * inv[i, i])) < 1e-6
