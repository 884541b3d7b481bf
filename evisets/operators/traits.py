"""Many traits at once: the trait is a key, never a loop.

entity_trait(entity_id, trait, log_bf, combined, prior); inputs(entity_id, log_bf, combined, prior) for the target trait.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisets.functions.scalar import BACKGROUND, background_log_odds
from evisets.functions.special import one_sided_p
from evisets.operators.assoc import finalize_stats, marginal_linear
from evisets.operators.shrink import shrink_independent, with_hyper

# The comparisons of trait evidence with target evidence, matched pairs first.
COMPARISONS = (
    ("log_bf_vs_log_bf", "log_bf", "log_bf", True),
    ("combined_vs_combined", "combined", "combined", True),
    ("log_bf_vs_combined", "log_bf", "combined", False),
    ("log_bf_vs_prior", "log_bf", "prior", False),
    ("combined_vs_log_bf", "combined", "log_bf", False),
    ("combined_vs_prior", "combined", "prior", False),
)

# Accepted column names of a many-trait evidence table, most specific first.
MULTI_TRAIT_SYNONYMS = {
    "entity_id": ("entity_id", "gene", "id"),
    "trait": ("trait", "pheno", "phenotype"),
    "log_bf": ("log_bf", "direct", "y"),
    "combined": ("combined",),
    "prior": ("prior", "indirect"),
}


def resolve_multi_cols(df: DataFrame) -> DataFrame:
    """Rename a many-trait table to the canonical columns by its header synonyms (case ignored)."""
    present = {c.lower(): c for c in df.columns}
    picked = []
    for name, options in MULTI_TRAIT_SYNONYMS.items():
        found = [F.col(f"`{present[o]}`") for o in options if o in present]
        if not found and name in ("entity_id", "trait"):
            raise ValueError(f"no column for {name}")
        if found:
            value = F.coalesce(*found)
            picked.append((value if name in ("entity_id", "trait") else value.cast("double")).alias(name))
    return df.select(*picked)


def trait_list(entity_trait: DataFrame, universe: DataFrame) -> DataFrame:
    """Traits with at least one entity of the universe."""
    return entity_trait.join(universe.select("entity_id").distinct(), "entity_id", "left_semi").select("trait").distinct()


def trait_slice(entity_trait: DataFrame, begin, end) -> DataFrame:
    """Traits in [begin, end) of the trait key; a filter, pushed to the scan."""
    return entity_trait.where((F.col("trait") >= F.lit(begin)) & (F.col("trait") < F.lit(end)))


def long_outcome(entity_trait: DataFrame, col: str) -> DataFrame:
    return entity_trait.where(F.col(col).isNotNull() & (F.col(col) != 0)).select("entity_id", "trait", F.col(col).alias("value"))


def trait_set_betas(membership: DataFrame, entity_trait: DataFrame, n: Column, col: str = "log_bf", p: float = 0.001,
                    sigma2: float = 1e-4, power: float | None = -2.0) -> DataFrame:
    """Marginal and shrunken set effects for every trait at once."""
    stats = marginal_linear(membership, long_outcome(entity_trait, col), n)
    return shrink_independent(with_hyper(stats, p, sigma2, power))


def compare_inputs(inputs: DataFrame, background: float = BACKGROUND, log_odds: bool = True) -> DataFrame:
    """axis(set_id, entity_id, weight): the target's direct, combined and prior evidence as probabilities.

    A missing axis falls back to the first one present. ``log_odds=False`` adds the background odds themselves, the published form.
    """
    shift = background_log_odds(background) if log_odds else background / (1 - background)
    default = F.coalesce("log_bf", "combined", "prior")
    to_p = lambda c: F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.coalesce(F.col(c), default) + F.lit(shift))))
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("set_id"), to_p(a).alias("weight")) for a in ("log_bf", "combined", "prior")]))
    return inputs.withColumn("_a", axes).select("_a.set_id", "entity_id", "_a.weight")


def trait_compare(inputs: DataFrame, entity_trait: DataFrame, n: Column, which: str = "matched", p: float = 0.5,
                  sigma2: float = 1e-2, inflation: DataFrame | None = None, log_odds: bool = True) -> DataFrame:
    """Regress each trait's evidence on the target's, for the matched (2) or diagnostic (6) comparisons.

    ``inflation(set_id, trait, factor)`` widens the errors of the combined outcome. Shrinkage uses p = 0.5.
    """
    if which not in ("matched", "diagnostic"):
        raise ValueError(f"unknown comparison set: {which!r}")
    specs = [c for c in COMPARISONS if c[3] or which == "diagnostic"]
    axes = compare_inputs(inputs, log_odds=log_odds)
    outcomes = reduce(DataFrame.unionByName, [
        long_outcome(entity_trait, col).withColumn("trait", F.struct(F.lit(col).alias("outcome"), F.col("trait").alias("name")))
        for col in sorted({c[1] for c in specs})
    ])
    stats = marginal_linear(axes, outcomes, n)
    if inflation is not None:
        factor = inflation.select("set_id", F.struct(F.lit("combined").alias("outcome"), F.col("trait").alias("name")).alias("trait"), "factor")
        stats = stats.join(factor, ["set_id", "trait"], "left").withColumn("se", F.col("se") * F.coalesce("factor", F.lit(1.0)))
        stats = finalize_stats(stats.drop("factor", "z", "p"))
    label = F.coalesce(*[F.when((F.col("trait.outcome") == o) & (F.col("set_id") == a), F.lit(name)) for name, o, a, _ in specs])
    named = stats.withColumn("analysis", label).where("analysis is not null")
    fit = shrink_independent(with_hyper(named, p, sigma2, None))
    return fit.select(
        F.col("trait.name").alias("trait"), "analysis", "beta_tilde", "se", "z", "p", one_sided_p(F.col("z"), F.col("p")).alias("p_onesided"),
        F.col("beta_uncorrected").alias("beta"))


def shared_set_inflation(axes: DataFrame, membership: DataFrame, set_trait: DataFrame, n: Column, n_sets: Column,
                         min_prior: float = 0.1) -> DataFrame:
    """factor(set_id, trait) for the combined outcome, from residual correlation of entities that share live sets.

    Two entities of one trait correlate as cov(X_a beta, X_b beta) over sets. The quadratic form x'Rx is split by set,
    (1/m) sum_k (sum_a x_a s_ak / sd_a)^2 - (sum_a x_a e_a / sd_a)^2, with s_ak = X_ak beta_k, e and sd the mean and sd of s_a over the
    m sets; the diagonal is then put to 1. No entity pair is listed. Entities whose summed effect stays below ``min_prior`` only
    correlate with themselves. The published estimate also zeroes entries below 0.01, an approximation this exact sum does not need.
    """
    s = membership.join(set_trait.where("beta <> 0").select("set_id", "trait", "beta"), "set_id").select(
        F.col("set_id").alias("k"), "entity_id", "trait", (F.col("weight") * F.col("beta")).alias("s"))
    per = s.groupBy("entity_id", "trait").agg(F.sum("s").alias("_s"), F.sum(F.col("s") * F.col("s")).alias("_s2")).withColumn("_m", n_sets)
    per = per.where(F.col("_s") > min_prior).withColumn("_e", F.col("_s") / F.col("_m"))
    per = per.withColumn("_sd", F.sqrt(F.greatest(F.col("_s2") / F.col("_m") - F.col("_e") * F.col("_e"), F.lit(0.0)))).where("_sd > 0")
    x = axes.select("set_id", "entity_id", F.col("weight").alias("x"))
    scaled = per.join(x, "entity_id").select("set_id", "trait", "entity_id", (F.col("x") / F.col("_sd")).alias("_xs"), "x", "_e", "_m",
                                            (F.col("_s2") / F.col("_m")).alias("_ms2"), "_sd")
    by_set = s.join(scaled.select("set_id", "trait", "entity_id", "_xs"), ["entity_id", "trait"]).groupBy("set_id", "trait", "k").agg(
        F.sum(F.col("s") * F.col("_xs")).alias("_d")).groupBy("set_id", "trait").agg(F.sum(F.col("_d") * F.col("_d")).alias("_dd"))
    ones = scaled.groupBy("set_id", "trait").agg(F.sum(F.col("_xs") * F.col("_e")).alias("_xe"), F.first("_m").alias("_m"),
                                                 F.sum(F.col("x") * F.col("x")).alias("_own"))
    total = axes.groupBy("set_id").agg(F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.col("weight")).alias("_w2")).withColumn("_n", n)
    j = by_set.join(ones, ["set_id", "trait"]).join(total, "set_id")
    # correlated part (its diagonal is already 1 per entity) plus the entities that only correlate with themselves
    quad = F.col("_dd") / F.col("_m") - F.col("_xe") * F.col("_xe") + (F.col("_w2") - F.col("_own"))
    mean = F.col("_w") / F.col("_n")
    var = F.col("_w2") / F.col("_n") - mean * mean
    share = quad / F.col("_n")
    return j.select("set_id", "trait", F.when(var > 0, F.sqrt(F.greatest(share - share * share, var) / var)).otherwise(F.lit(1.0)).alias("factor"))
