import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from evisets.functions import scalar
from evisets.operators import assoc, diagnostics, locus, regress, shrink


def frame(spark, X):
    return spark.createDataFrame([(j, i, float(X[i, j])) for i in range(X.shape[0]) for j in range(X.shape[1]) if X[i, j]],
                                 "set_id long, entity_id long, weight double")


def outcome(spark, Y):
    return spark.createDataFrame([(i, t, float(Y[i, t])) for i in range(Y.shape[0]) for t in range(Y.shape[1]) if Y[i, t]],
                                 "entity_id long, trait long, value double")


def test_marginal_linear_is_the_standardised_regression(spark):
    rng = np.random.default_rng(0)
    X, Y = (rng.random((30, 5)) < 0.4) * rng.random((30, 5)), rng.normal(size=(30, 3))
    for r in assoc.marginal_linear(frame(spark, X), outcome(spark, Y), F.lit(30.0)).collect():
        x, y = X[:, r.set_id], Y[:, r.trait]
        assert abs(r.beta_tilde - np.cov(x, y, bias=True)[0, 1] / x.std()) < 1e-9
        assert abs(r.se - y.std() / math.sqrt(29)) < 1e-9
        assert abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 1e-6


def newton(x, y):
    X, b = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-X @ b))
        H = (X * (p * (1 - p))[:, None]).T @ X
        b = b + np.linalg.solve(H, X.T @ (y - p))
    return b, H


def test_logistic_forms_agree_with_newton(spark):
    rng = np.random.default_rng(1)
    B = (rng.random((60, 4)) < 0.4) * 1.0
    y = (rng.random(60) < 0.3 + 0.3 * B[:, 0]) * 1.0
    W = B * rng.uniform(0.5, 1.5, B.shape)
    Y = outcome(spark, y[:, None])
    for X, got in ((B, assoc.marginal_logistic(frame(spark, B), Y, F.lit(60.0)).collect()),
                   (W, assoc.marginal_logistic_weighted(frame(spark, W), Y, F.lit(60.0), tol=1e-9).collect())):
        assert len(got) == 4
        for r in got:
            x = X[:, r.set_id]
            b, H = newton(np.append(x, 1.0), np.append(y, y.mean()))
            assert abs(r.beta_tilde - b[1] * x.std()) < 1e-6 and abs(r.alpha_tilde - b[0]) < 1e-6
            assert abs(r.se - x.std() / math.sqrt(H[1, 1] - H[0, 1] ** 2 / H[0, 0])) < 1e-6


def test_empty_cell_diverges_to_zero(spark):
    m = spark.createDataFrame([(0, i, 1.0) for i in range(5)], "set_id long, entity_id long, weight double")
    y = spark.createDataFrame([(i, 0, 1.0) for i in range(5)], "entity_id long, trait long, value double")
    r = assoc.marginal_logistic(m, y, F.lit(20.0)).first()
    assert r.diverged and r.beta_tilde == 0.0 and r.se > 0


def test_error_inflation_quadratic_form(spark):
    rng = np.random.default_rng(2)
    X = (rng.random((12, 3)) < 0.5) * 1.0
    R = np.eye(12)
    R[0, 1] = R[1, 0] = R[4, 7] = R[7, 4] = 0.8
    e = spark.createDataFrame([(i, j, float(R[i, j])) for i in range(12) for j in range(12) if R[i, j]], "entity_a long, entity_b long, r double")
    for r in assoc.error_inflation(frame(spark, X), e, F.lit(12.0)).collect():
        x = X[:, r.set_id]
        q = (R @ x * x).sum() / 12
        assert abs(r.factor - math.sqrt(max(q - q * q, x.var()) / x.var())) < 1e-9


def test_hc3_and_huber_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    y = 1 + x @ [0.5, -0.2] + rng.standard_t(2, size=80)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, y double")
    D = np.column_stack([x, np.ones(80)])
    A = np.linalg.inv(D.T @ D)
    beta = A @ D.T @ y
    e, h = y - D @ beta, np.einsum("ij,jk,ik->i", D, A, D)
    V = A @ (D.T * (e / (1 - h)) ** 2) @ D @ A
    for i, r in enumerate(regress.ols_hc3(df, ["a", "b"], "y").collect()):
        assert abs(r.beta - beta[i]) < 1e-8 and abs(r.se - math.sqrt(V[i, i])) < 1e-8
    b = beta.copy()
    for _ in range(300):
        res = np.abs(y - D @ b)
        w = np.where(res <= 1, 1, 1 / res)
        b = np.linalg.solve((D.T * w) @ D, (D.T * w) @ y)
    got = [r.beta for r in regress.huber_reg(df, ["a", "b"], "y", max_rounds=60, tol=1e-9).collect()]
    assert np.allclose(got, b, atol=1e-6)


def test_covariate_pruning_drops_constant_and_duplicate(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0, float((i * 7) % 11)) for i in range(30)], "a double, b double, c double, d double")
    assert regress.prune_covariates(df, ["a", "b", "c", "d"]) == ["a", "d"]


def dense_v(X):
    Z = (X - X.mean(0)) / X.std(0)
    return Z.T @ Z / len(X)


def test_correlation_product_and_joint_fixed_point(spark):
    rng = np.random.default_rng(4)
    X = (rng.random((50, 6)) < 0.4) * 1.0
    y = X[:, 0] * 1.0 + rng.normal(size=50) * 0.3
    m, n = frame(spark, X), F.lit(50.0)
    stats = shrink.with_hyper(assoc.marginal_linear(m, outcome(spark, y[:, None]), n), 0.3, 0.05, None)
    b = {r.set_id: r for r in stats.collect()}
    vec = np.array([b[j].beta_tilde for j in range(6)])
    got = {r.set_id: r.v_beta for r in shrink.correlation_product(m, stats, n, "beta_tilde").collect()}
    assert np.allclose([got[j] for j in range(6)], dense_v(X) @ vec)
    fit = {r.set_id: r.beta for r in shrink.shrink_joint(m, stats, n, rounds=14, tol=1e-6).collect()}
    beta = np.array([fit[j] for j in range(6)])
    resid = vec - (dense_v(X) @ beta - beta)
    for j in range(6):
        s, h = b[j].se, 0.05 / 0.3
        lo = math.log(0.3 / math.sqrt(h + s * s)) - math.log(0.7 / s) + resid[j] ** 2 / 2 * (1 / s**2 - 1 / (h + s * s))
        want = h / (h + s * s) * resid[j] / (1 + math.exp(-lo))
        assert abs(beta[j] - want) < 1e-3


def test_fold_sums_equal_refits(spark):
    rng = np.random.default_rng(5)
    X, y = (rng.random((24, 4)) < 0.5) * 1.0, rng.normal(size=24)
    folds = spark.createDataFrame([(i, i % 3) for i in range(24)], "entity_id long, fold long")
    for r in shrink.fold_stats(frame(spark, X), outcome(spark, y[:, None]), folds).collect():
        keep = np.arange(24) % 3 != r.fold
        x, t = X[keep, r.set_id], y[keep]
        assert abs(r.beta_tilde - np.cov(x, t, bias=True)[0, 1] / x.std()) < 1e-9


def test_sampling_does_not_depend_on_partitions(spark):
    y = spark.range(200).select(F.col("id").alias("entity_id"), F.lit(1).alias("trait"), F.lit(0.3).alias("value"))
    a = sorted(map(tuple, assoc.sample_outcomes(y, 20, 1).collect()))
    assert a == sorted(map(tuple, assoc.sample_outcomes(y.repartition(7), 20, 1).collect()))
    assert abs(np.mean([r[2] for r in a]) - 0.3) < 0.03


def test_chain_summary_and_rhat(spark):
    rows = [(c, i, p, float(v)) for c, p, v in ((1, "a", 10), (2, "a", 0), (3, "a", 0), (1, "b", 0), (2, "b", 10), (3, "b", 0)) for i in range(4)]
    d = spark.createDataFrame(rows, "chain long, iteration long, param string, value double")
    got = {r.param: r.mean for r in diagnostics.summarize_draws(d).collect()}
    assert abs(got["a"] - 10 / 3) < 1e-12 and abs(got["b"] - 10 / 3) < 1e-12
    assert {r.rhat for r in diagnostics.rhat(d).collect()} == {1.0}


def test_clump_is_the_sequential_greedy(spark):
    rng = np.random.default_rng(6)
    v = [(i, str(int(rng.integers(2))), int(rng.integers(5000)), float(rng.random())) for i in range(150)]
    got = {r.variant_id: r.signal_id for r in locus.clump(spark.createDataFrame(v, "variant_id long, chrom string, pos long, p double"), 200).collect()}
    left, want = sorted(v, key=lambda t: (t[3], t[2], t[0])), {}
    while left:
        lead = left[0]
        for t in left:
            if t[1] == lead[1] and abs(t[2] - lead[2]) <= 200:
                want[t[0]] = lead[0]
        left = [t for t in left if t[0] not in want]
    assert got == want


def test_signal_stage_probabilities(spark):
    fine = spark.createDataFrame([(1, "s", 0.7), (2, "s", 0.3)], "variant_id long, signal_id string, ppa double")
    links = spark.createDataFrame([(1, "g1", 0.8), (2, "g1", 0.2), (2, "g2", 0.6)], "variant_id long, entity_id string, prob double")
    se = locus.signal_entity_prob(fine, links, cap=1.0 - 1e-9)
    assert abs(sum(r.prob for r in se.collect()) - 1) < 1e-8
    q = locus.signal_posterior(se, spark.createDataFrame([("s", 0.5)], "signal_id string, posterior double"))
    assert abs(sum(r.q for r in q.collect()) - 0.5) < 1e-9


def test_every_subset_of_sources_combines(spark):
    from evisets.operators.align import combine_evidence

    src = {n: spark.createDataFrame([(i, float(i + k)) for i in range(k, k + 3)], "entity_id long, log_bf double") for k, n in enumerate("abcd")}
    for size in range(1, 5):
        for names in itertools.combinations(src, size):
            out = combine_evidence({n: src[n] for n in names}, names[0])
            assert out.count() > 0 and out.where("log_bf is null").count() == 0


def test_alternating_estimate_finds_the_planted_set(spark):
    rng = np.random.default_rng(7)
    m = spark.createDataFrame([(s, e, 1.0) for s in range(5) for e in range(s * 20, s * 20 + 20)], "set_id long, entity_id long, weight double")
    ev = spark.createDataFrame([(e, "t", 4.0 if e < 20 else float(rng.normal() - 1)) for e in range(100)], "entity_id long, trait string, log_bf double")
    u = spark.range(100).select(F.col("id").alias("entity_id"))
    scores, draws = shrink.alternate(m, ev, u, rounds=2, p=0.2, sigma2=0.5, power=None, adjust_degree=False)
    s = {r.entity_id: r.prior for r in scores.collect()}
    assert np.mean([s[e] for e in range(20)]) > np.mean([s[e] for e in range(20, 100)])
    assert draws.count() == 10


def test_popular_entities_are_split_without_changing_results(spark, monkeypatch):
    from evisets.plans import iterate

    rng = np.random.default_rng(8)
    rows = [(s, 0, 1.0) for s in range(40)] + [(s, int(e), float(w)) for s in range(40) for e, w in zip(rng.choice(np.arange(1, 200), 12, False), rng.random(12) + 0.1)]
    memb = spark.createDataFrame(rows, "set_id long, entity_id long, weight double")
    y = spark.createDataFrame([(e, t, float(rng.normal())) for e in range(200) for t in range(2)], "entity_id long, trait long, value double")
    n = F.lit(200.0)

    def run():
        stats = assoc.marginal_linear(memb, y, n)
        vb = shrink.correlation_product(memb, stats, n, "beta_tilde", heavy=iterate.heavy_keys(memb, "entity_id"))
        return sorted((r.set_id, r.trait, r.beta_tilde, r.v_beta) for r in stats.join(vb, ["set_id", "trait"]).collect())

    assert iterate.heavy_keys(memb, "entity_id") is None
    plain = run()
    monkeypatch.setattr(iterate, "HEAVY", 10)
    assert iterate.heavy_keys(memb, "entity_id").count() >= 1
    assert len(plain) == 80 and np.allclose(plain, run(), atol=1e-12)


def test_grid_has_no_limit_on_names(spark, monkeypatch):
    from evisets.plans import iterate

    monkeypatch.setattr(iterate, "AXIS", 7)
    got = iterate.grid(spark.range(3).withColumnRenamed("id", "e"), spark.range(50).withColumnRenamed("id", "t"))
    assert sorted(tuple(r) for r in got.collect()) == [(e, t) for e in range(3) for t in range(50)]


def test_run_lists_every_entity_with_its_true_prior(spark):
    from evisets.plans.support import run_support

    rng = np.random.default_rng(9)
    rows = [(s, int(e), 1.0) for s in range(6) for e in rng.choice(60, 15, False)]
    memb = spark.createDataFrame(rows, "set_id long, entity_id long, weight double")
    y = spark.createDataFrame([(int(e), "t", 2.0 + float(rng.random())) for s, e, _ in rows if s == 0], "entity_id long, trait string, value double").dropDuplicates(["entity_id"])
    got = run_support(memb, y, spark.range(100).withColumnRenamed("id", "entity_id"), 0.3, 0.01, -1.0, min_size=2, max_p=0.9, prune_at=None, adjust_degree=False)
    scores, sets = {r.entity_id: r for r in got.scores.collect()}, [r for r in got.set_stats.collect() if r.status == "kept"]
    member = {s: {e for x, e, _ in rows if x == s} for s in range(6)}
    low = -sum(r.mean * r.beta / r.scale for r in sets)
    assert len(scores) == 100 and low < 0
    for e in range(100):
        assert abs(scores[e].prior - (low + sum(r.beta / r.scale for r in sets if e in member[r.set_id]))) < 1e-9


def test_links_that_sum_to_nothing_keep_their_probability(spark):
    links = spark.createDataFrame([("1", 5, 1, 0.0), ("1", 5, 2, 0.0), ("1", 9, 3, 0.2), ("1", 9, 4, 0.6)], "chrom string, pos long, entity_id long, prob double")
    got = {r.entity_id: r.prob for r in locus.read_links(links, links, normalise_to=1.0).collect()}
    assert got[1] == got[2] == 0 and abs(got[3] - 0.25) < 1e-12 and abs(got[4] - 0.75) < 1e-12


def test_signal_entities_by_places_equal_the_way_over_links(spark):
    rng = np.random.default_rng(3)
    fine = spark.createDataFrame([(int(i % 70), f"s{int(i) % 3}", "1", int(rng.integers(0, 40)) * 500, float(rng.random())) for i in range(80)],
                                 "variant_id long, signal_id string, chrom string, pos long, ppa double")
    ivl = spark.createDataFrame([(int(j % 30), "1", int(a) * 1000, int(a) * 1000 + 700) for j, a in enumerate(rng.integers(0, 20, 40))],
                                "entity_id long, chrom string, start_pos long, end_pos long")
    want = {(r.signal_id, r.entity_id): r.prob for r in locus.signal_entity_prob(fine, locus.link_prob(fine, ivl, max_dist=3000)).collect()}
    got = {(r.signal_id, r.entity_id): r.prob for r in locus.signal_entity_near(fine, ivl, 3000).collect()}
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-12 for k in want)
