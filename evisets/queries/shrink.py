"""Shrinkage, priors, folds, alternating estimate."""

from __future__ import annotations

from pyspark.sql import functions as F

from evisets.operators import assoc, joint, shrink
from evisets.plans.iterate import heavy_keys
from evisets.queries.roles import (
    binary, evidence, evidence_y, marginal_sql, membership, moments_sql, n_entities, order_sets, r, spike_sql, sql_p, table, tidy, trait_y, universe, with_,
)

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql:
            SQL[name] = sql
        return fn
    return add


P, S2 = 0.2, 0.001
M, PO, C = spike_sql(f"{P}::DOUBLE", f"(CASE WHEN scale = 0 THEN 0 ELSE {S2}::DOUBLE * pow(scale, -1.0::DOUBLE) END)")
SHRUNK = f"sh AS (SELECT *, CASE WHEN scale > 0 AND se > 0 THEN {M} ELSE 0 END AS beta_uncorrected, CASE WHEN scale > 0 AND se > 0 THEN {PO} ELSE 0 END AS postp, CASE WHEN scale > 0 AND se > 0 THEN {C} ELSE 0 END AS cond_beta FROM st)"
BASE = with_("memb", "n", "y", extra=marginal_sql() + ",\n" + SHRUNK)


def stats(spark, sf):
    return shrink.with_hyper(assoc.marginal_linear(membership(spark, sf), trait_y(spark, sf), n_entities(spark, sf)), P, S2, -1.0)


@query("shrink_independent", BASE + f"SELECT set_id, trait, {r('beta_uncorrected', 'beta_uncorrected')}, {r('postp', 'postp')}, {r('cond_beta', 'cond_beta')} FROM sh")
def shrink_independent(spark, sf):
    return shrink.shrink_independent(stats(spark, sf)).select("set_id", "trait", "beta_uncorrected", "postp", "cond_beta")


CUT = BASE.rstrip() + """,
mx AS (SELECT trait, max(abs(beta_uncorrected)) AS top FROM sh GROUP BY 1),
sc AS (SELECT set_id, trait, mean, scale, CASE WHEN abs(beta_uncorrected) < 0.1::DOUBLE * top THEN 0 ELSE beta_uncorrected END AS b FROM sh JOIN mx USING (trait))
"""


@query("shrink_sparse_cut", CUT + f"SELECT set_id, trait, {r('b', 'beta_uncorrected')} FROM sc")
def shrink_sparse(spark, sf):
    return shrink.shrink_independent(stats(spark, sf), 0.1).select("set_id", "trait", "beta_uncorrected")


PRIOR = BASE.rstrip() + """,
shift AS (SELECT trait, sum(mean * beta_uncorrected / scale) AS s FROM sh WHERE scale > 0 GROUP BY 1),
xb AS (SELECT entity_id, trait, sum(weight * beta_uncorrected / scale) AS x FROM memb JOIN sh USING (set_id) WHERE scale > 0 GROUP BY 1, 2),
pr AS (SELECT entity_id, trait, x - s AS prior FROM xb JOIN shift USING (trait))
"""


def prior(spark, sf):
    return shrink.prior_from_effects(membership(spark, sf), shrink.shrink_independent(stats(spark, sf)), "beta_uncorrected")


@query("prior_from_effects", PRIOR + f"SELECT entity_id, trait, {r('prior', 'prior')} FROM pr")
def prior_from_effects(spark, sf):
    return prior(spark, sf)


@query("prior_whole_universe", BASE.rstrip() + f""",
shift AS (SELECT trait, sum(mean * beta_uncorrected / scale) AS s FROM sh WHERE scale > 0 GROUP BY 1),
xb AS (SELECT entity_id, trait, sum(weight * beta_uncorrected / scale) AS x FROM memb JOIN sh USING (set_id) WHERE scale > 0 GROUP BY 1, 2)
SELECT p_partkey AS entity_id, t.trait, {r('coalesce(x, 0) - s', 'prior')} FROM part JOIN shift t ON true LEFT JOIN xb ON xb.entity_id = p_partkey AND xb.trait = t.trait""")
def prior_whole(spark, sf):
    return shrink.prior_from_effects(membership(spark, sf), shrink.shrink_independent(stats(spark, sf)), "beta_uncorrected", universe=universe(spark, sf))


@query("naive_prior", PRIOR + f"SELECT entity_id, trait, {r('prior', 'prior')} FROM pr")
def naive_prior(spark, sf):
    return shrink.naive_prior(membership(spark, sf), trait_y(spark, sf), n_entities(spark, sf), P, S2, -1.0)


# the prior of every entity: one without a live set has minus the sum at the mean
WHOLE = PRIOR.rstrip() + """,
every AS (SELECT p_partkey AS entity_id FROM part UNION SELECT entity_id FROM memb UNION SELECT entity_id FROM y),
lowest AS (SELECT trait, sum(CASE WHEN scale > 0 THEN mean * beta_uncorrected / scale ELSE 0 END) AS s FROM sh GROUP BY 1),
wh AS (SELECT every.entity_id, t.trait, coalesce(pr.prior, -t.s) AS prior FROM every JOIN lowest t ON true LEFT JOIN pr ON pr.entity_id = every.entity_id AND pr.trait = t.trait)
"""


def whole(spark, sf):
    everyone = universe(spark, sf).select("entity_id").union(membership(spark, sf).select("entity_id")).union(trait_y(spark, sf).select("entity_id"))
    return shrink.prior_from_effects(membership(spark, sf), shrink.shrink_independent(stats(spark, sf)), "beta_uncorrected", universe=everyone)


ADJ = WHOLE.rstrip() + """,
dg AS (SELECT every.entity_id, count(memb.set_id) AS n_sets FROM every LEFT JOIN memb USING (entity_id) GROUP BY 1),
fit AS (SELECT trait, covar_samp(prior, n_sets) / nullif(var_pop(n_sets), 0) AS sl, avg(prior) AS mp, avg(n_sets) AS mn FROM wh JOIN dg USING (entity_id) GROUP BY 1),
ad AS (SELECT entity_id, trait, prior, prior - coalesce(sl, 0) * n_sets - (mp - coalesce(sl, 0) * mn) AS prior_adj FROM wh JOIN dg USING (entity_id) JOIN fit USING (trait))
"""


@query("adjust_for_degree", ADJ + f"SELECT entity_id, trait, {r('prior_adj', 'prior_adj')} FROM ad")
def adjust_for_degree(spark, sf):
    return shrink.adjust_for_degree(whole(spark, sf), membership(spark, sf)).select("entity_id", "trait", "prior_adj")


@query("combine_scores", WHOLE + f"""SELECT entity_id, trait, {r('coalesce(prior, 0)', 'prior')}, {r('coalesce(value, 0)', 'log_bf')}, {r('coalesce(prior, 0) + coalesce(value, 0)', 'combined')},
    {r('1 / (1 + exp(-(coalesce(prior, 0) + coalesce(value, 0) + ln(0.05::DOUBLE / 0.95))))', 'combined_D')} FROM wh FULL JOIN y USING (entity_id, trait)""")
def combine_scores(spark, sf):
    return shrink.combine_scores(whole(spark, sf), trait_y(spark, sf).withColumnRenamed("value", "log_bf"))


@query("shrink_ignored", BASE + f"SELECT set_id, trait, {r('beta_uncorrected', 'beta_uncorrected')} FROM sh WHERE p > 0.5")
def shrink_ignored(spark, sf):
    from evisets.operators.sets import flag

    s = flag(stats(spark, sf), F.col("p") <= 0.5, "p").where("status = 'ignored'")
    return shrink.shrink_independent(s).select("set_id", "trait", "beta_uncorrected")


VB = with_("bin", "n", "y1", extra=marginal_sql("bin", "y1") + """,
u AS (SELECT entity_id, sum(weight * beta_tilde / scale) AS u FROM bin JOIN st USING (set_id) WHERE scale > 0 GROUP BY 1), sf AS (SELECT sum(mean * beta_tilde / scale) AS s FROM st WHERE scale > 0),
xu AS (SELECT set_id, sum(weight * u) AS xu FROM bin JOIN u USING (entity_id) GROUP BY 1)""")


@query("correlation_product", VB + f"SELECT set_id, trait, {r('(xu / n.n - mean * s) / scale', 'v_beta')} FROM st JOIN xu USING (set_id), n, sf WHERE scale > 0")
def correlation_product(spark, sf):
    n = n_entities(spark, sf)
    s = assoc.marginal_linear(binary(spark, sf), evidence_y(spark, sf), n)
    return shrink.correlation_product(binary(spark, sf), s, n, "beta_tilde", heavy=heavy_keys(binary(spark, sf), "entity_id"))


@query("shrink_joint")
def shrink_joint(spark, sf):
    n = n_entities(spark, sf)
    return shrink.shrink_joint(membership(spark, sf), stats(spark, sf), n).select("set_id", "trait", "beta", "postp", "converged")


def one_round(name):
    """One joint round in SQL: residual by the pair-free product, shrink, damp by one half."""
    m, p, _ = spike_sql(f"{P}::DOUBLE", f"({S2}::DOUBLE * pow(scale, -1.0::DOUBLE))", "res", "se")
    return f"""vb AS (SELECT set_id, trait, (xu / n.n - mean * s) / scale AS v FROM (SELECT set_id, trait, sum(weight * u) AS xu FROM memb JOIN (SELECT entity_id, trait, sum(weight * beta_uncorrected / scale) AS u FROM memb JOIN sh USING (set_id) WHERE scale > 0 GROUP BY 1, 2) USING (entity_id) GROUP BY 1, 2)
    JOIN (SELECT trait, sum(mean * beta_uncorrected / scale) AS s FROM sh GROUP BY 1) USING (trait) JOIN xm USING (set_id), n WHERE scale > 0),
{name} AS (SELECT set_id, trait, beta_uncorrected + 0.5 * ({m} - beta_uncorrected) AS beta FROM (SELECT sh.*, beta_tilde - (v - beta_uncorrected) AS res FROM sh JOIN vb USING (set_id, trait)))"""


@query("shrink_joint_one_round", BASE.rstrip() + ",\n" + one_round("jr") + f"\nSELECT set_id, trait, {r('beta', 'beta')} FROM jr")
def shrink_joint_one(spark, sf):
    return shrink.shrink_joint(membership(spark, sf), stats(spark, sf), n_entities(spark, sf), rounds=1).select("set_id", "trait", "beta")


@query("shrink_sweeps")
def shrink_sweeps(spark, sf):
    return joint.shrink_sweeps(membership(spark, sf), stats(spark, sf), n_entities(spark, sf)).select("set_id", "trait", "beta", "postp", "converged", "sweeps")


def class_step(now: str, then: str, cls: int, keys: str, memb: str) -> str:
    """The step of one class of sets in SQL over rows (keys, set_id, cls, beta, beta_tilde, se, scale, mean, n); ``memb`` has the keys' fold, if any."""
    m, _, _ = spike_sql(f"{P}::DOUBLE", f"({S2}::DOUBLE * pow(scale, -1.0::DOUBLE))", "res", "se")
    on = "fold, " if "fold" in keys else ""
    return f"""{then} AS MATERIALIZED (SELECT * EXCLUDE (beta, res), CASE WHEN cls = {cls} THEN {m} ELSE beta END AS beta
  FROM (SELECT k.*, beta_tilde - ((coalesce(xu, 0) / n - mean * s) / scale - beta) AS res FROM {now} k
    LEFT JOIN (SELECT {keys}, set_id, sum(weight * u) AS xu FROM {memb} JOIN (SELECT {keys}, entity_id, sum(weight * beta / scale) AS u FROM {memb} JOIN {now} USING ({on}set_id) WHERE beta <> 0 GROUP BY ALL) USING ({on}entity_id)
               GROUP BY ALL) USING ({keys}, set_id)
    JOIN (SELECT {keys}, sum(mean * beta / scale) AS s FROM {now} GROUP BY ALL) USING ({keys})))"""


def two_sweeps(keys: str, memb: str) -> str:
    return ",\n".join(class_step(f"g{i}", f"g{i + 1}", i % 2, keys, memb) for i in range(4))


def parity(spark, sf):
    return membership(spark, sf).select("set_id", (F.col("set_id") % 2).cast("int").alias("cls")).distinct()


@query("shrink_sweeps_two", BASE.rstrip() + f""",
g0 AS (SELECT trait, set_id, set_id % 2 AS cls, 0::DOUBLE AS beta, beta_tilde, se, scale, mean, n.n FROM st, n WHERE scale > 0 AND se > 0),
{two_sweeps("trait", "memb")}
SELECT set_id, trait, {r('beta', 'beta')} FROM g4""")
def shrink_sweeps_two(spark, sf):
    return joint.shrink_sweeps(membership(spark, sf), stats(spark, sf), n_entities(spark, sf), classes=parity(spark, sf), sweeps=2, tol=0.0).select("set_id", "trait", "beta")


@query("screen_zero")
def screen_zero(spark, sf):
    return shrink.screen_zero(membership(spark, sf), stats(spark, sf), n_entities(spark, sf), blocks=4, fraction=0.05)


def batched(spark, sf):
    s = assoc.marginal_linear(membership(spark, sf), trait_y(spark, sf), n_entities(spark, sf))
    return s.withColumn("batch", F.col("set_id") % 3)


HM, HP, HC = spike_sql("0.1::DOUBLE", "(0.001::DOUBLE * pow(scale, -1.0::DOUBLE))")


@query("hyper_step", with_("memb", "n", "y", extra=marginal_sql() + f""",
h AS (SELECT trait, set_id % 3 AS batch, {HP} AS post, {HC} AS cond, 0.01::DOUBLE * pow(scale, -1.0::DOUBLE) AS slab, se * se AS se2, pow(scale, -1.0::DOUBLE) AS unit FROM st WHERE scale > 0)""") +
       f"SELECT trait, batch, {r('(1.0 + sum(post)) / (2.0 + count(*))', 'p')}, {r('greatest(sum(post * (cond * cond + slab / (slab + se2) * se2)) / sum(unit), 2e-3::DOUBLE * ((1.0 + sum(post)) / (2.0 + count(*))) * count(*) / sum(unit))', 'sigma2')} FROM h GROUP BY 1, 2")
def hyper_step(spark, sf):
    s = batched(spark, sf)
    hyper = s.select("trait", "batch").distinct().withColumns({"p": F.lit(0.1), "sigma2": F.lit(0.001)})
    return shrink.hyper_step(s, hyper, pseudo=1.0, power=-1.0, update_sigma=True).select("trait", "batch", "p", "sigma2")


@query("learn_hyper")
def learn_hyper(spark, sf):
    return shrink.learn_hyper(batched(spark, sf), 0.1, 0.001, pseudo=1.0, power=-1.0)


@query("assign_hyper", f"""WITH b AS (SELECT c_nationkey::BIGINT AS trait, c_mktsegment AS batch, min(c_custkey) AS batch_order, avg(c_acctbal) / 1e4 AS p, sum(c_acctbal) / 1e6 AS s FROM customer GROUP BY 1, 2),
l AS (SELECT trait, batch, batch_order, CASE WHEN batch <> 'BUILDING' THEN p END AS p, CASE WHEN batch <> 'BUILDING' THEN s END AS s FROM b),
f AS (SELECT trait, arg_min(p, batch_order) AS fp, arg_min(s, batch_order) AS fs FROM l WHERE p IS NOT NULL GROUP BY 1),
j AS (SELECT l.trait, batch, batch_order, fp, coalesce(p, fp) AS p, coalesce(s, fs) AS s FROM l LEFT JOIN f USING (trait))
SELECT trait, batch, batch_order, {r('least(p, fp)', 'p')}, {r('CASE WHEN p > fp THEN s / p * fp ELSE s END', 'sigma2')} FROM j""")
def assign_hyper(spark, sf):
    b = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("trait"), F.col("c_mktsegment").alias("batch")).agg(
        F.min("c_custkey").alias("batch_order"), (F.avg("c_acctbal") / 1e4).alias("p"), (F.sum("c_acctbal") / 1e6).alias("sigma2"))
    return shrink.assign_hyper(b.select("trait", "batch", "batch_order"), b.where("batch <> 'BUILDING'"))


# ---- folds ----------------------------------------------------------------------------------------------------------

def folds(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.substring("p_type", 1, 2).alias("fold"))


FOLD = with_("memb", "y", extra=f"""f AS (SELECT p_partkey AS entity_id, substr(p_type, 1, 2) AS fold FROM part), fs AS (SELECT DISTINCT fold FROM f),
fn AS (SELECT fs.fold, count(*)::DOUBLE AS n FROM fs, f WHERE f.fold <> fs.fold GROUP BY 1),
mf AS (SELECT fs.fold, set_id, m.entity_id, weight FROM memb m JOIN f USING (entity_id), fs WHERE f.fold <> fs.fold),
yf AS (SELECT fs.fold, y.* FROM y JOIN f USING (entity_id), fs WHERE f.fold <> fs.fold),
xm AS (SELECT fold, set_id, sum(weight) AS sw, sum(weight) / n AS mean, sqrt(greatest(sum(weight * weight) / n - (sum(weight) / n) * (sum(weight) / n), 0)) AS scale, n FROM mf JOIN fn USING (fold) GROUP BY fold, set_id, n),
ym AS (SELECT fold, trait, sum(value) / n AS y_mean, sum(value * value) / n - (sum(value) / n) * (sum(value) / n) AS y_var FROM yf JOIN fn USING (fold) GROUP BY fold, trait, n),
dot AS (SELECT fold, set_id, trait, sum(weight * value) AS xy FROM mf JOIN yf USING (fold, entity_id) GROUP BY 1, 2, 3),
st AS (SELECT fold, set_id, trait, mean, scale, CASE WHEN scale <= 1e-12 THEN 0 ELSE (xy - sw * y_mean) / n / scale END AS beta_tilde, CASE WHEN scale <= 1e-12 THEN 0 ELSE sqrt(y_var) / sqrt(n - 1) END AS se
       FROM dot JOIN xm USING (fold, set_id) JOIN ym USING (fold, trait))""")


@query("fold_stats", FOLD + f"SELECT fold, set_id, trait, {r('beta_tilde', 'beta_tilde')}, {r('se', 'se')} FROM st")
def fold_stats(spark, sf):
    return shrink.fold_stats(membership(spark, sf), trait_y(spark, sf), folds(spark, sf)).select("fold", "set_id", "trait", "beta_tilde", "se")


LM, _, _ = spike_sql("0.2::DOUBLE", "(0.001::DOUBLE * pow(scale, -1.0::DOUBLE))")
LOCO = FOLD.rstrip() + """,
sh AS (SELECT *, {m} / scale AS b FROM st WHERE scale > 0 AND se > 0), shift AS (SELECT fold, trait, sum(mean * b) AS s FROM sh GROUP BY 1, 2),
xb AS (SELECT entity_id, fold, trait, sum(weight * b) AS x FROM memb JOIN f USING (entity_id) JOIN sh USING (set_id, fold) GROUP BY 1, 2, 3)
"""


@query("loco_priors", LOCO.format(m=LM) + f"SELECT entity_id, fold, trait, {r('coalesce(x, 0) - s', 'prior')} FROM f JOIN shift USING (fold) LEFT JOIN xb USING (entity_id, fold, trait)")
def loco_priors(spark, sf):
    return shrink.loco_priors(membership(spark, sf), trait_y(spark, sf), folds(spark, sf), 0.2, 0.001, -1.0)


# joint fits per fold: sets are zero whose mean falls too far without the fold, or whose p is above 0.9
LOCO_JOINT = FOLD.rstrip() + f""",
fk AS (SELECT (count(*) - 1.0::DOUBLE) / count(*) AS mr FROM fs), tot AS (SELECT set_id, sum(weight) / (SELECT count(*) FROM part) AS mean0 FROM memb JOIN f USING (entity_id) GROUP BY 1),
zs AS (SELECT st.*, xm.n, st.mean / mean0 AS share, CASE WHEN se > 0 THEN beta_tilde / se ELSE 0 END AS z FROM st JOIN xm USING (fold, set_id) JOIN tot USING (set_id)),
fl AS MATERIALIZED (SELECT zs.*, share < mr - 3 * sqrt(mr * (1 - mr)) OR {sql_p('z')} > 0.9 AS dropped FROM zs, fk),
g0 AS MATERIALIZED (SELECT trait, fold, set_id, set_id % 2 AS cls, 0::DOUBLE AS beta, beta_tilde, se, scale, mean, n FROM fl WHERE NOT dropped AND scale > 0 AND se > 0),
{two_sweeps("trait, fold", "mf")}
"""


@query("loco_joint_effects", LOCO_JOINT + f"SELECT fold, trait, set_id, dropped, {r('coalesce(beta, 0)', 'beta')} FROM fl LEFT JOIN (SELECT fold, trait, set_id, beta FROM g4) USING (fold, trait, set_id)")
def loco_joint_effects(spark, sf):
    return loco_joint(spark, sf, classes=parity(spark, sf), sweeps=2, tol=0.0)[0].select("fold", "trait", "set_id", "dropped", "beta")


@query("loco_joint_priors_two", LOCO_JOINT.rstrip() + f""",
sh AS (SELECT *, beta / scale AS b FROM g4 WHERE beta <> 0), shift AS (SELECT fold, trait, sum(mean * b) AS s FROM sh GROUP BY 1, 2),
xb AS (SELECT entity_id, fold, trait, sum(weight * b) AS x FROM memb JOIN f USING (entity_id) JOIN sh USING (set_id, fold) GROUP BY 1, 2, 3)
SELECT entity_id, fold, trait, {r('coalesce(x, 0) - s', 'prior')} FROM f JOIN shift USING (fold) LEFT JOIN xb USING (entity_id, fold, trait)""")
def loco_joint_two(spark, sf):
    return loco_joint(spark, sf, classes=parity(spark, sf), sweeps=2, tol=0.0)[1]


@query("loco_joint_priors")
def loco_joint_priors(spark, sf):
    return loco_joint(spark, sf)[1]


def loco_joint(spark, sf, **options):
    return joint.loco_joint(membership(spark, sf), trait_y(spark, sf), folds(spark, sf), P, S2, -1.0, max_p=0.9, **options)


RIDGE = "(0.01::DOUBLE * scale * scale / (0.01::DOUBLE * scale * scale + se * se) * beta_tilde)"


@query("pops_prior", LOCO.format(m=RIDGE) + f"SELECT entity_id, fold, trait, {r('coalesce(x, 0) - s', 'prior')} FROM f JOIN shift USING (fold) LEFT JOIN xb USING (entity_id, fold, trait)")
def pops_prior(spark, sf):
    return shrink.pops_prior(membership(spark, sf), trait_y(spark, sf), folds(spark, sf), 0.01)


CM, _, _ = spike_sql("0.2::DOUBLE", "(s2 * pow(scale, -1.0::DOUBLE))")
CV = FOLD.rstrip() + f""",
g AS (SELECT unnest([0.0001, 0.001, 0.01]::DOUBLE[]) AS s2), fm AS (SELECT set_id, sqrt(greatest(sum(weight * weight) / n - (sum(weight) / n) * (sum(weight) / n), 0)) AS fscale FROM memb, (SELECT count(*)::DOUBLE AS n FROM part) GROUP BY set_id, n),
sh AS (SELECT fold, set_id, trait, s2, {CM} / fscale AS b FROM st JOIN fm USING (set_id), g WHERE scale > 0 AND se > 0),
pd AS (SELECT entity_id, trait, s2, sum(weight * b) AS pred FROM memb JOIN f USING (entity_id) JOIN sh USING (set_id, fold) GROUP BY 1, 2, 3),
tm AS (SELECT trait, sum(value) / (SELECT count(*) FROM part) AS m FROM y GROUP BY 1),
rss AS (SELECT t.trait, g.s2 AS sigma2, sum(pow(coalesce(pred, 0) - (coalesce(value, 0) - m), 2)) / count(*) AS rss FROM part JOIN tm t ON true JOIN g ON true LEFT JOIN y ON y.entity_id = p_partkey AND y.trait = t.trait
        LEFT JOIN pd ON pd.entity_id = p_partkey AND pd.trait = t.trait AND pd.s2 = g.s2 GROUP BY 1, 2)
"""


@query("cross_validation_rss", CV + f"SELECT trait, {r('sigma2', 'sigma2')}, {r('rss', 'rss')} FROM rss")
def cv(spark, sf):
    return shrink.cv_sigma(membership(spark, sf), trait_y(spark, sf), folds(spark, sf), [1e-4, 1e-3, 1e-2], 0.2, -1.0)


@query("cross_validation_best", CV + f"SELECT trait, {r('arg_min(sigma2, rss)', 'sigma2')}, {r('min(rss)', 'rss')}, arg_min(sigma2, rss) <> 0.001::DOUBLE AS at_edge FROM rss GROUP BY 1")
def cv_best(spark, sf):
    return shrink.best_sigma(shrink.cv_sigma(membership(spark, sf), trait_y(spark, sf), folds(spark, sf), [1e-4, 1e-3, 1e-2], 0.2, -1.0))


DECADES = "[" + ", ".join(f"1e{k}" for k in range(-18, 13)) + "]"
SEARCH = CV.replace("[0.0001, 0.001, 0.01]", DECADES).rstrip() + f""",
e AS MATERIALIZED (SELECT trait, round(log10(sigma2))::INT + 3 AS k, sigma2, rss FROM rss),
s0 AS (SELECT trait, arg_min(k, rss) AS b FROM e WHERE abs(k) <= 1 GROUP BY 1),
w AS (SELECT trait, j, CASE WHEN b < 0 THEN -1 - 2 * j ELSE -1 END AS lo, CASE WHEN b > 0 THEN 1 + 2 * j ELSE 1 END AS hi FROM s0, range(0, 8) t(j)),
c AS (SELECT trait, j, arg_min(k, rss) AS k, arg_min(sigma2, rss) AS sigma2, min(rss) AS rss, min(rss) FILTER (WHERE k = lo + 1) AS rl, min(rss) FILTER (WHERE k = hi - 1) AS rh, min(lo) AS lo, min(hi) AS hi
FROM e JOIN w USING (trait) WHERE k BETWEEN lo AND hi GROUP BY 1, 2),
fl AS (SELECT *, (k = lo AND rss >= rl * (1 - 1e-6)) OR (k = hi AND rss >= rh * (1 - 1e-6)) AS flat FROM c)
"""


@query("cross_validation_search", SEARCH + f"SELECT trait, {r('sigma2', 'sigma2')}, {r('rss', 'rss')}, false AS at_edge, flat FROM fl WHERE k > lo AND k < hi OR flat QUALIFY row_number() OVER (PARTITION BY trait ORDER BY j) = 1")
def cv_search(spark, sf):
    return shrink.cross_validate(membership(spark, sf), trait_y(spark, sf), folds(spark, sf), 1e-3, 1, 0.2, -1.0)


@query("alternate_scores")
def alternate(spark, sf):
    e = evidence(spark, sf).select("entity_id", F.lit("returns").alias("trait"), "log_bf")
    scores, _ = shrink.alternate(membership(spark, sf), e, universe(spark, sf), rounds=2, p=0.2, sigma2=0.01, power=-1.0)
    return scores


@query("alternate_draw_summary")
def alternate_draws(spark, sf):
    from evisets.operators.diagnostics import rhat

    e = evidence(spark, sf).select("entity_id", F.lit("returns").alias("trait"), "log_bf")
    _, draws = shrink.alternate(membership(spark, sf), e, universe(spark, sf), rounds=3, chains=3, p=0.2, sigma2=0.01, power=-1.0, seed=4)
    return rhat(draws.withColumnRenamed("set_id", "param"))


@query("support_run")
def support(spark, sf):
    from evisets.plans.support import run_support

    y = trait_y(spark, sf)
    return run_support(membership(spark, sf), y, universe(spark, sf), 0.2, 0.001, -1.0, max_p=0.5, sweeps=200).scores


def joint_round(now: str, then: str) -> str:
    """One damped joint round in SQL over rows (set_id, trait, beta, beta_tilde, se, scale, mean)."""
    m, _, _ = spike_sql(f"{P}::DOUBLE", f"({S2}::DOUBLE * pow(scale, -1.0::DOUBLE))", "res", "se")
    return f"""{then} AS (SELECT set_id, trait, beta_tilde, se, scale, mean, beta + 0.5 * (CASE WHEN se > 0 THEN {m} ELSE 0 END - beta) AS beta
  FROM (SELECT k.*, beta_tilde - ((coalesce(xu, 0) / n.n - mean * s) / scale - beta) AS res FROM {now} k
    LEFT JOIN (SELECT set_id, trait, sum(weight * u) AS xu FROM memb JOIN (SELECT entity_id, trait, sum(weight * beta / scale) AS u FROM memb JOIN {now} USING (set_id) GROUP BY 1, 2) USING (entity_id) GROUP BY 1, 2) USING (set_id, trait)
    JOIN (SELECT trait, sum(mean * beta / scale) AS s FROM {now} GROUP BY 1) USING (trait), n))"""


# the whole run from the model: filters, two joint rounds, sparse cut, prior of every entity, degree line over all of them, scores
SUPPORT = BASE.rstrip() + """,
k0 AS (SELECT set_id, trait, beta_tilde, se, scale, mean, beta_uncorrected AS beta FROM sh WHERE size BETWEEN 10 AND 30000 AND p <= 0.5 AND beta_tilde >= 0 AND scale > 0),
""" + joint_round("k0", "k1") + ",\n" + joint_round("k1", "k2") + """,
kept AS (SELECT set_id, trait, scale, mean, CASE WHEN abs(beta) < 0.001::DOUBLE * max(abs(beta)) OVER (PARTITION BY trait) THEN 0 ELSE beta END AS beta FROM k2),
every AS (SELECT p_partkey AS entity_id FROM part UNION SELECT entity_id FROM memb UNION SELECT entity_id FROM y),
low AS (SELECT trait, coalesce(sum(mean * beta / scale), 0) AS s FROM (SELECT DISTINCT trait FROM st) LEFT JOIN kept USING (trait) GROUP BY 1),
xs AS (SELECT entity_id, trait, sum(weight * beta / scale) AS x FROM memb JOIN kept USING (set_id) GROUP BY 1, 2),
p0 AS (SELECT e.entity_id, l.trait, coalesce(x, 0) - s AS prior FROM every e JOIN low l ON true LEFT JOIN xs ON xs.entity_id = e.entity_id AND xs.trait = l.trait),
dg AS (SELECT e.entity_id, count(memb.set_id) AS n_sets FROM every e LEFT JOIN memb USING (entity_id) GROUP BY 1),
ln AS (SELECT trait, coalesce(covar_samp(prior, n_sets) / nullif(var_pop(n_sets), 0), 0) AS sl, avg(prior) AS mp, avg(n_sets) AS mn FROM p0 JOIN dg USING (entity_id) GROUP BY 1),
p1 AS (SELECT entity_id, trait, prior - sl * n_sets - (mp - sl * mn) AS prior FROM p0 JOIN dg USING (entity_id) JOIN ln USING (trait)),
sc AS (SELECT entity_id, trait, coalesce(value, 0) AS log_bf, coalesce(prior, 0) AS prior FROM p1 FULL JOIN y USING (entity_id, trait))
"""


@query("support_run_two_rounds", SUPPORT + f"""SELECT entity_id, trait, {r('log_bf', 'log_bf')}, {r('prior', 'prior')}, {r('prior + log_bf', 'combined')},
    {r('1 / (1 + exp(-(prior + log_bf + ln(0.05::DOUBLE / 0.95))))', 'combined_D')} FROM sc""")
def support_two(spark, sf):
    from evisets.plans.support import run_support

    return run_support(membership(spark, sf), trait_y(spark, sf), universe(spark, sf), P, S2, -1.0, max_p=0.5, prune_at=None, joint_rounds=2).scores.drop("converged")


@query("support_run_sets")
def support_sets(spark, sf):
    from evisets.plans.support import run_support

    return run_support(order_sets(spark, sf), evidence_y(spark, sf), universe(spark, sf), 0.2, 0.001, -1.0, min_size=3, max_p=0.2, prune_at=0.5).set_stats
