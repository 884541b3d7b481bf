import math
from statistics import NormalDist

from pyspark.sql import functions as F

from evisets.functions import scalar, special

ND = NormalDist()


def test_normal_tail_is_accurate_in_relative_terms(spark):
    rows = special.with_p(spark.range(0, 60).select((F.col("id") / 4.0 - 5).alias("z"))).collect()
    for r in rows:
        exact = math.erfc(abs(r.z) / math.sqrt(2))
        assert abs(r.p - exact) <= 2e-7 * exact
    col = spark.range(0, 60).select((F.col("id") / 4.0 - 5).alias("z")).select("z", special.p_from_z(F.col("z")).alias("p")).collect()
    assert all(abs(a.p - b.p) < 1e-12 for a, b in zip(rows, col))


def test_quantile_inverts_the_tail(spark):
    df = spark.createDataFrame([(p,) for p in (1.0, 0.9, 0.5, 0.049, 0.01, 5e-8, 1e-100, 0.0)], "p double")
    for r in special.with_abs_z(df, "p", "z").collect():
        assert abs(r.z - abs(ND.inv_cdf(max(r.p, 1e-300) / 2))) < 1e-7


def test_hypergeometric_tail(spark):
    cases = [(k, 40, 12, 9) for k in range(0, 11)]
    df = spark.createDataFrame(cases, "k long, m long, n long, d long")
    got = df.select("k", special.hypergeom_sf(F.col("k"), F.col("m"), F.col("n"), F.col("d")).alias("p")).collect()
    for r in got:
        want = sum(math.comb(12, x) * math.comb(28, 9 - x) for x in range(r.k, 10)) / math.comb(40, 9)
        assert abs(r.p - want) < 1e-12


def test_calibration_hits_both_anchors(spark):
    cal = scalar.calibrate_bf()
    assert abs(cal.k - 0.97375) < 1e-4 and abs(cal.prior_odds - 0.0027620) < 1e-6
    df = spark.createDataFrame([(abs(ND.inv_cdf(2.5e-8)),), (abs(ND.inv_cdf(0.005)),)], "z double")
    got = [r[0] for r in df.select(scalar.posterior(scalar.wakefield_log_bf(F.col("z"), cal.k), cal.prior_odds)).collect()]
    assert abs(got[0] - 0.75) < 1e-9 and abs(got[1] - 0.01) < 1e-9


def test_completion_rules(spark):
    df = spark.createDataFrame([(None, None, None), (None, 2.0, 1.0), (0.05, None, 2.0), (0.05, -3.0, None), (0.1, 1.0, 0.0), (1.0, 0.5, None)],
                               "p double, beta double, se double")
    a, b, c, d, e, f = scalar.complete_p_beta_se(df).collect()
    assert (a.p, a.beta, a.se) == (1.0, 0.0, 1.0)
    assert abs(b.p - math.erfc(2 / math.sqrt(2))) < 1e-7
    z = abs(ND.inv_cdf(0.025))
    assert abs(c.beta - 2 * z) < 1e-6 and abs(d.se - 3 / z) < 1e-6
    assert (e.beta, e.se) == (0.0, 1.0)
    assert abs(f.se - 0.5) < 1e-6  # z = 0 counts as 1


def test_threshold_constants_keep_95_and_5_percent():
    t = scalar.sigma_threshold(100, 1000, 20000)
    for size, share in ((100, 0.95), (1000, 0.05)):
        q = size / 20000
        assert abs(1 / (1 + math.exp(-t.k * (math.sqrt(q * (1 - q)) - t.x0))) - share) < 1e-9


def test_target_variance_grows_with_the_prior():
    assert scalar.sigma2_from_target(0.9, 50, 0.001) > scalar.sigma2_from_target(0.8, 50, 0.001) > 0


def test_sigma2_for_target_is_the_scalar_by_row(spark):
    from pyspark.sql import functions as F

    from evisets.functions.scalar import sigma2_for_target, sigma2_from_target

    df = spark.createDataFrame([(1, 0.1), (7, 0.05), (50, 0.001), (100_000, 1.0), (0, 0.1), (None, 0.1)], "n long, p double")
    for r in df.withColumn("s", sigma2_for_target(0.8, F.col("n"), F.col("p"), 0.5)).collect():
        assert r.s is None if not r.n else abs(r.s / sigma2_from_target(0.8, r.n, r.p, 0.5) - 1) < 1e-6
