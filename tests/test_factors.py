import itertools

import numpy as np
from pyspark.sql import functions as F

from evisets.operators import factors as fx
from evisets.operators import nmf
from evisets.plans.factor import consensus_fit, phi_search


def cells(spark, V):
    return spark.createDataFrame([(i, j, float(V[i, j])) for i in range(V.shape[0]) for j in range(V.shape[1]) if V[i, j] > 0],
                                 "set_id long, entity_id long, value double")


def test_weighted_error_equals_the_dense_form_and_falls(spark):
    rng = np.random.default_rng(0)
    V, P, Q = np.maximum(rng.random((10, 12)) - 0.4, 0), rng.random((10, 2)), rng.random((12, 2))
    sw = spark.createDataFrame([(i, str(u), float(P[i, u])) for i in range(10) for u in range(2)], "set_id long, anchor string, weight double")
    ew = spark.createDataFrame([(i, str(u), float(Q[i, u])) for i in range(12) for u in range(2)], "entity_id long, anchor string, weight double")
    fit = nmf.ard_nmf(cells(spark, V), 3, [nmf.Run(0, 1, 0.02), nmf.Run(1, 5, 0.02)], sw, ew, iterations=5, tol=0)
    W = {r.set_id: r.w for r in fit.sets.where("run = 0").collect()}
    H = {r.entity_id: r.w for r in fit.entities.where("run = 0").collect()}
    dense = np.array([W[i] for i in range(10)]) @ np.array([H[j] for j in range(12)]).T
    want = (P @ Q.T * (V - dense) ** 2).sum()
    got = fit.summary.where("run = 0").first().error
    assert abs(got - want) < 1e-8
    for run in (0, 1):
        errors = [t[2] for t in fit.trace if t[0] == run]
        assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))


def test_result_does_not_depend_on_partitions(spark):
    V = np.maximum(np.random.default_rng(2).random((6, 7)) - 0.3, 0)
    a = nmf.ard_nmf(cells(spark, V), 2, [nmf.Run(0, 1, 0.05)], iterations=2).summary.first().error
    b = nmf.ard_nmf(cells(spark, V).repartition(9), 2, [nmf.Run(0, 1, 0.05)], iterations=2).summary.first().error
    assert abs(a - b) < 1e-9


def test_capture_recovers_mixtures_whatever_their_scale(spark):
    rng = np.random.default_rng(11)
    keys, k, n = 40, 4, 25
    B = rng.random((keys, k)) ** 2
    shares = rng.dirichlet(np.ones(k), n)
    mass = rng.uniform(0.5, 50, n)
    V = (shares @ (B / B.sum(0)).T) * mass[:, None]
    basis = spark.createDataFrame([(i, f + 1, float(B[i, f])) for i in range(keys) for f in range(k)], "key long, factor int, value double")
    prof = spark.createDataFrame([(p, i, float(V[p, i])) for p in range(n) for i in range(keys)], "profile long, key long, value double")
    share, strength = nmf.capture(basis, prof, k)
    got = np.zeros((n, k))
    for r in share.collect():
        got[r.profile, r.factor - 1] = r.value
    assert np.abs(got - shares).max() < 1e-3
    assert np.allclose([r.strength for r in strength.orderBy("profile").collect()], mass)


def test_top_capture_orders_ties_by_strength_then_key(spark):
    rng = np.random.default_rng(12)
    n, k, top = 60, 3, 7
    value, power = rng.integers(0, 4, (n, k)) / 4, rng.integers(0, 3, n).astype(float)
    c = spark.createDataFrame([(t, f + 1, float(value[t, f])) for t in range(n) for f in range(k)], "trait long, factor int, value double")
    s = spark.createDataFrame([(t, float(power[t])) for t in range(n)], "trait long, strength double")
    got = sorted((r.factor, r["rank"], r.trait) for r in fx.top_capture(c, s, top).collect())
    want = [(f + 1, i + 1, int(t)) for f in range(k) for i, t in enumerate(np.lexsort((np.arange(n), -power, -value[:, f]))[:top])]
    assert got == want


def test_noisy_or(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.4), (2, 0.1), (3, -0.2)], "factor int, value double")
    got = {r.factor: r.any_relevance for r in fx.any_relevance(df).collect()}
    assert abs(got[1] - 0.75) < 1e-12 and got[2] == 1.0 and got[3] == 0.0


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for rows, cols in ((3, 3), (4, 6), (1, 5)):
        cost = rng.random((rows, cols))
        got = sum(cost[r, c] for r, c in fx._assign(cost))
        best = min(sum(cost[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(cols), rows))
        assert abs(got - best) < 1e-12


def test_consensus_follows_swapped_columns(spark):
    rng = np.random.default_rng(3)
    base = rng.random((8, 2))
    data = [(run, "set", str(k), f + 1, float(base[k, f if run == 0 else 1 - f])) for run in range(2) for k in range(8) for f in range(2)]
    loads = spark.createDataFrame(data, "run int, axis string, key string, factor int, value double")
    m = fx.match_factors(fx.factor_cosines(loads, loads.where("run = 0").drop("run", "axis")))
    out, support = fx.consensus(loads, m, 2)
    got = {(r.key, r.factor): r.value for r in out.collect()}
    assert all(abs(got[(str(k), f + 1)] - base[k, f]) < 1e-12 for k in range(8) for f in range(2))
    assert {r.support_runs for r in support.collect()} == {2}


def test_families_keep_the_heaviest(spark):
    rows = [(1, 2, 0.9, 2, 0.1, 0.5, 0.2, 5.0, 5.0), (2, 1, 0.9, 1, 0.1, 0.5, 0.6, 5.0, 5.0), (3, 1, 0.1, 1, 0.1, 0.9, 0.2, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "factor int, entity_nearest_factor int, entity_max_jaccard double, set_nearest_factor int, set_max_jaccard double, "
                                     "combined_unique_fraction double, combined_mass_fraction double, entity_effective_support double, set_effective_support double")
    assert {r.factor for r in fx.merge_families(df).where("keep").collect()} == {2, 3}


def test_phi_choice_prefers_large_phi_inside_the_band(spark):
    cols = ("phi double, modal_factor_count int, num_modal_runs int, run_support double, stability double, best_error double, best_evidence double, redundancy_max double, "
            "redundancy_q90 double, redundancy_mean double, effective_factor_count double, mass_ge_floor_factor_count double, primary_factor_count double, "
            "secondary_factor_count double, filtered_factor_count double, tail_fraction double, filtered_fraction double, max_mass_fraction double, top5_mass_fraction double, capped boolean")
    def row(phi, err, k, red=0.2, capped=False):
        return (phi, 5, 1, 1.0, None, err, 1.0, red, red, red, k, 5.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.3, 1.0, capped)
    pick = lambda rows: fx.select_phi(spark.createDataFrame(rows, cols)).first()
    assert pick([row(0.05, 1.0, 5.0), row(0.1, 1.03, 4.8), row(0.2, 1.2, 4.9), row(0.4, 1.01, 2.0)]).phi == 0.1
    assert pick([row(0.05, 1.0, 5.0, capped=True), row(0.1, 2.0, 4.8)]).phi == 0.1
    assert pick([row(0.05, 1.0, 5.0, red=0.9), row(0.1, 1.0, 4.8, red=0.7)]).reason == "fallback_min_constraint_violation"


def hc3(D, y):
    A = np.linalg.inv(D.T @ D)
    b = A @ D.T @ y
    h = np.einsum("ij,jk,ik->i", D, A, D)
    return b, np.sqrt(np.diag(A @ (D.T * ((y - D @ b) / (1 - h)) ** 2) @ D @ A))


def test_trait_regressions_match_dense_hc3(spark):
    rng = np.random.default_rng(4)
    n = 60
    L, a, Y = rng.random((n, 3)), rng.normal(size=n), rng.random((n, 4)) < 0.3
    loads = spark.createDataFrame([(i, f, float(L[i, f])) for i in range(n) for f in range(3)], "entity_id long, factor int, value double")
    anchor = spark.createDataFrame([(i, float(a[i])) for i in range(n)], "entity_id long, value double")
    hits = spark.createDataFrame([(i, t) for i in range(n) for t in range(4) if Y[i, t]], "entity_id long, trait long")
    one = np.ones(n)
    for r in fx.factor_trait_marginal(loads, hits, anchor).collect():
        b, se = hc3(np.column_stack([L[:, r.factor], a, one]), Y[:, r.trait] * 1.0)
        assert abs(r.beta - b[0]) < 1e-8 and abs(r.se - se[0]) < 1e-8
    wide = spark.createDataFrame([(i, *map(float, L[i]), float(a[i])) for i in range(n)], "entity_id long, f0 double, f1 double, f2 double, a double")
    for r in fx.factor_trait_joint(wide, ["f0", "f1", "f2"], hits, "a").collect():
        b, se = hc3(np.column_stack([L, a, one]), Y[:, r.trait] * 1.0)
        k = int(r.factor[1])
        assert abs(r.beta - b[k]) < 1e-8 and abs(r.se - se[k]) < 1e-8


def test_workflow_choice():
    assert fx.choose_workflow({"entity_list", "membership"}) == "F2"
    assert fx.choose_workflow({"set_stats", "entity_stats", "membership", "set_trait"}) == "F3"


def test_search_and_consensus_run(spark):
    V = np.maximum(np.random.default_rng(5).random((6, 8)) - 0.4, 0)
    best, table = phi_search(cells(spark, V), 2, steps=2, fit_options={"iterations": 2})
    assert best.count() == 1 and table.count() == 3
    fit = nmf.ard_nmf(cells(spark, V), 2, [nmf.Run(i, i, 0.01) for i in range(2)], iterations=2)
    assert consensus_fit(fit)[0].count() > 0


def test_numerators_of_several_runs_side_by_side(spark, monkeypatch):
    """Few loadings are broadcast, many joined, and more runs than a row holds go in turn: the same sums as run by run, from one row of loadings a key."""
    V = np.random.default_rng(3).random((9, 7)) * (np.random.default_rng(4).random((9, 7)) > 0.4)
    x = cells(spark, V).withColumnRenamed("value", "vs")
    W = {(r, i): np.random.default_rng(10 * r + i).random(4) for r in (0, 2, 5) for i in range(9)}
    fixed = spark.createDataFrame([(r, i, w.tolist()) for (r, i), w in W.items()], "run int, set_id long, w array<double>")
    for few, width in ((10 ** 6, 32), (0, 32), (10 ** 6, 8)):
        monkeypatch.setattr(nmf, "CELLS", few)
        monkeypatch.setattr(nmf, "WIDTH", width)
        got = {(r.run, r.entity_id): r.num for r in nmf._numerator(x, fixed, "set_id", "entity_id", 4, [0, 2, 5]).collect()}
        want = {(r, j): sum(V[i, j] * W[r, i] for i in range(9)) for r in (0, 2, 5) for j in range(7) if V[:, j].any()}
        assert got.keys() == want.keys() and max(np.abs(np.array(got[k]) - want[k]).max() for k in want) < 1e-12
