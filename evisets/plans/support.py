"""The support run: evidence -> marginal effects -> shrinkage -> priors -> combined scores, for every trait at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisets.operators import assoc, joint, prune, sets, shrink
from evisets.operators.ordered import bh_q
from evisets.plans.iterate import by_group, cut, spread


@dataclass
class Support:
    set_stats: DataFrame
    scores: DataFrame


def enrichment(membership: DataFrame, y: DataFrame, universe: DataFrame) -> DataFrame:
    """Marginal enrichment of every (set, trait) with q-values per trait."""
    n = universe.agg(F.count("*")).scalar()
    return bh_q(assoc.marginal_linear(membership, y, n), "p", ["trait"])


def run_support(membership: DataFrame, y: DataFrame, universe: DataFrame, p: float = shrink.DEFAULT_P, sigma2: float = 1e-4,
                power: float | None = shrink.DEFAULT_POWER, min_size: int = 10, max_size: int = 30_000, max_p: float = 0.01,
                prune_at: float | None = 0.8, joint_rounds: int = 0, adjust_degree: bool = True, learn_p: bool = False, sweeps: int = 0) -> Support:
    """Filters, marginal and (optionally joint) shrunken effects, priors and combined scores.

    y(entity_id, trait, value) is the log Bayes factor. Filtered sets stay in the result with their reason and their independent
    effect; only kept ones feed the priors. ``sweeps``: the most sweeps of the joint fit over colour classes; ``joint_rounds``: else, the most damped rounds; both 0: independent effects.
    Scores list every entity of universe, memberships and evidence for every trait. ``converged`` in both results tells, for a trait, whether
    its joint fit ended by its rule.
    """
    n = universe.agg(F.count("*")).scalar()
    membership, y = cut(spread(membership.select("set_id", "entity_id", "weight"), "set_id", "entity_id")), cut(y.select("entity_id", "trait", "value"))
    inside = membership.join(universe.select("entity_id"), "entity_id", "left_semi")
    stats = sets.prefilter(sets.filter_size(assoc.marginal_linear(inside, y, n), min_size, max_size), max_p)
    if prune_at is not None:
        alive = cut(stats.where("status = 'kept'").select("set_id").distinct())
        kept = prune.prune_correlated(inside.join(alive, "set_id", "left_semi"), n, prune_at).withColumn("_k", F.lit(True))
        stats = sets.flag(stats.join(kept, "set_id", "left"), F.coalesce("_k", F.lit(False)), "correlated").drop("_k")
    stats = cut(stats)
    if learn_p:
        hyper = shrink.learn_hyper(stats.where("status = 'kept'").withColumn("batch", F.lit("all")), p, sigma2, power=power)
        h = hyper.select("trait", F.col("p").alias("_p"), F.col("sigma2").alias("_s"))
        stats = shrink.with_hyper(stats.join(by_group(h), "trait", "left"), F.coalesce("_p", F.lit(p)), F.coalesce("_s", F.lit(sigma2)), power).drop("_p", "_s")
    else:
        stats = shrink.with_hyper(stats, p, sigma2, power)
    fit = cut(shrink.shrink_independent(stats, shrink.DEFAULT_SPARSE_FRACTION))
    kept = F.col("status") == "kept"
    if sweeps or joint_rounds:
        live = stats.where(kept)
        if sweeps:
            fitted = joint.shrink_sweeps(inside, live, n, sweeps=sweeps, sparse_fraction=shrink.DEFAULT_SPARSE_FRACTION)
        else:
            fitted = shrink.shrink_joint(inside, live, n, joint_rounds, sparse_fraction=shrink.DEFAULT_SPARSE_FRACTION)
        fitted = cut(fitted.select("set_id", "trait", "beta", "converged"))
        ended = fitted.groupBy("trait").agg(F.every("converged").alias("converged"))
        fit = fit.join(fitted.drop("converged"), ["set_id", "trait"], "left").fillna(0.0, ["beta"])
    else:
        fit = fit.withColumn("beta", F.when(kept, F.col("beta_uncorrected")).otherwise(F.lit(0.0)))
        ended = stats.select("trait").distinct().withColumn("converged", F.lit(True))
    fit = fit.join(by_group(ended), "trait", "left").withColumn("converged", F.coalesce("converged", F.lit(True)))  # a trait without live sets has nothing to fit
    everyone = universe.select("entity_id").union(membership.select("entity_id")).union(y.select("entity_id")).distinct()
    effects = fit.withColumn("beta", F.when(kept, F.col("beta")).otherwise(F.lit(0.0)))
    prior = shrink.prior_from_effects(membership, effects, "beta", universe=everyone)
    if adjust_degree:
        prior = shrink.adjust_for_degree(prior, membership).withColumn("prior", F.col("prior_adj")).drop("prior_adj", "n_sets")
    scores = shrink.combine_scores(prior, y.select("entity_id", "trait", F.col("value").alias("log_bf")))
    return Support(fit, scores.join(by_group(ended), "trait", "left").withColumn("converged", F.coalesce("converged", F.lit(True))))
