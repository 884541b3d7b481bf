"""Association of sets with evidence: marginal regressions, error inflation, covariate correction.

evidence long form: y(entity_id, trait, value); an absent pair is 0, and every mean runs over the ``n`` entities of the
universe. Only non-zeros are joined and aggregated; the zero terms are added in closed form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisets.functions.scalar import background_log_odds, complete_p_beta_se, to_log_bf, to_prob
from evisets.functions.scalar import calibrate_bf, posterior, wakefield_log_bf, with_variant_z
from evisets.functions.special import hypergeom_sf, with_p
from evisets.operators.align import count_of
from evisets.operators.ordered import bh_q
from evisets.operators.packed import in_blocks, name_axis, pack, sum_over_entities, unpack, with_blocks
from evisets.operators.sets import set_moments
from evisets.plans.iterate import by_group, grid, held



def finalize_stats(df: DataFrame, group: str | None = "trait", max_se: Column | None = None) -> DataFrame:
    """z and p from beta_tilde and se; a zero effect without error gets 100 x the largest error of its trait.

    ``max_se`` gives that error where it is known per row, which saves the grouped pass over the input.
    """
    if max_se is not None:
        joined = df.withColumn("_max", max_se)
    else:
        keys = [group] if group else []
        biggest = df.groupBy(*keys).agg(F.max("se").alias("_max"))
        joined = df.join(by_group(biggest), keys) if keys else df.withColumn("_max", biggest.scalar())
    big = F.when(F.col("_max") > 0, F.col("_max") * 100).otherwise(F.lit(100.0))
    se = F.when((F.col("beta_tilde") == 0) & (F.col("se") <= 0), big).otherwise(F.col("se"))
    out = joined.withColumn("se", se).drop("_max")
    out = out.withColumn("beta_tilde", F.when(F.col("se") <= 0, F.lit(0.0)).otherwise(F.col("beta_tilde")))
    out = out.withColumn("z", F.when(F.col("se") > 0, F.col("beta_tilde") / F.col("se")).otherwise(F.lit(0.0)))
    return with_p(out)


def trait_moments(y: DataFrame, n: Column) -> DataFrame:
    """Mean and population variance of each trait over the whole universe."""
    s = y.groupBy("trait").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_s2"))
    s = s.withColumn("_n", n)
    mean = F.col("_s") / F.col("_n")
    return s.select("trait", mean.alias("y_mean"), (F.col("_s2") / F.col("_n") - mean * mean).alias("y_var"))


def set_trait_dots(membership: DataFrame, y: DataFrame) -> DataFrame:
    """sum of weight x value per (set, trait): one join on the entity, its traits side by side. Popular entities are split by set. Both are read twice."""
    member, heavy = in_blocks(membership.select("set_id", "entity_id", "weight"))
    values = pack(y, ["entity_id"], name_axis(y, ["trait"]), "value")
    return unpack(sum_over_entities(member, with_blocks(values, member), ["set_id"], heavy), "xy")


def _all_pairs(moments: DataFrame, traits: DataFrame, dots: DataFrame) -> DataFrame:
    """(set, trait) grid with xy = 0 where nothing overlaps."""
    return grid(moments, traits.select("trait", "y_mean", "y_var")).join(dots, ["set_id", "trait"], "left").fillna(0.0, ["xy"])


def marginal_linear(membership: DataFrame, y: DataFrame, n: Column, complete: bool = False,
                    inflation: DataFrame | None = None, moments: DataFrame | None = None) -> DataFrame:
    """Marginal regression of every trait on every set, in units of the standardised set.

    beta_tilde = cov(x, y) / sd(x), se = sd(y) / sqrt(n - 1). ``complete`` also lists pairs without a shared entity.
    ``inflation(set_id[, trait], factor)`` multiplies the errors.
    """
    membership, y = held(membership.select("set_id", "entity_id", "weight")), held(y.select("entity_id", "trait", "value"))
    moments = set_moments(membership, n) if moments is None else moments
    traits = trait_moments(y, n)
    dots = set_trait_dots(membership, y)
    if complete:
        joined = _all_pairs(moments, traits, dots)
    else:
        joined = dots.join(moments, "set_id").join(by_group(traits), "trait")
    sd = F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale"))
    cov = (F.col("xy") - F.col("sum_w") * F.col("y_mean")) / F.col("n")
    beta = F.when(F.col("scale") == 0, F.lit(0.0)).otherwise(cov / sd)
    se = F.when(F.col("scale") == 0, F.lit(0.0)).otherwise(F.sqrt("y_var") / F.sqrt(F.col("n") - 1))
    trait_se = F.sqrt("y_var") / F.sqrt(F.col("n") - 1)
    out = joined.select("set_id", "trait", "size", "mean", "scale", beta.alias("beta_tilde"), se.alias("se"), trait_se.alias("_trait_se"))
    if inflation is not None:
        keys = [c for c in ("set_id", "trait") if c in inflation.columns]
        out = out.join(inflation, keys, "left").withColumn(
            "se", F.col("se") * F.coalesce(F.col("factor"), F.lit(1.0))
        ).drop("factor", "_trait_se")
        return finalize_stats(out)
    return finalize_stats(out, max_se=F.col("_trait_se")).drop("_trait_se")


def error_inflation(membership: DataFrame, entity_corr: DataFrame, n: Column) -> DataFrame:
    """factor(set_id[, trait]) by which residual correlation between entities widens a set's error.

    entity_corr(entity_a, entity_b, r[, trait]) lists both directions and the diagonal.
    """
    extra = [c for c in ("trait",) if c in entity_corr.columns]
    a = membership.select("set_id", F.col("entity_id").alias("entity_a"), F.col("weight").alias("w_a"))
    b = membership.select("set_id", F.col("entity_id").alias("entity_b"), F.col("weight").alias("w_b"))
    quad = (
        a.join(entity_corr, "entity_a").groupBy("set_id", *extra, "entity_b")
        .agg(F.sum(F.col("w_a") * F.col("r")).alias("_rx"))
        .join(b, ["set_id", "entity_b"])
        .groupBy("set_id", *extra).agg(F.sum(F.col("_rx") * F.col("w_b")).alias("_q"))
    )
    return _inflation(quad, set_moments(membership, n), extra)


def error_inflation_blocks(membership: DataFrame, blocks: DataFrame, n: Column, rho: float) -> DataFrame:
    """As ``error_inflation`` where two entities of a block correlate by ``rho`` and entities of different blocks do not.

    blocks(entity_id, *block) names each entity once; an entity that is missing, or has a null in its block, has no terms. A block
    adds rho (sum w)^2 + (1 - rho) sum w^2 to its set, so no pair of entities is formed and a membership is read once.
    """
    extra = [c for c in ("trait",) if c in blocks.columns]
    block = [c for c in blocks.columns if c not in ("entity_id", *extra)]
    w = F.col("weight")
    quad = (
        membership.select("set_id", "entity_id", "weight").join(blocks.dropna(subset=block), "entity_id")
        .groupBy("set_id", *extra, *block).agg(F.sum(w).alias("_s"), F.sum(w * w).alias("_ss"))
        .groupBy("set_id", *extra).agg(F.sum(F.lit(rho) * F.col("_s") * F.col("_s") + F.lit(1.0 - rho) * F.col("_ss")).alias("_q"))
    )
    return _inflation(quad, set_moments(membership, n), extra)


def _inflation(quad: DataFrame, moments: DataFrame, extra: list[str]) -> DataFrame:
    share = F.col("_q") / F.col("n")
    var = F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale") * F.col("scale"))
    return quad.join(moments, "set_id").select("set_id", *extra, F.sqrt(F.greatest(share - share * share, var) / var).alias("factor"))


def marginal_logistic(membership: DataFrame, y: DataFrame, n: Column) -> DataFrame:
    """Marginal logistic regression for 0/1 members and 0/1 (or fractional) outcomes, in closed form.

    With a 0/1 regressor the fit is saturated: the two cells (inside / outside the set) are matched exactly, so four sums
    replace the iterations. One pseudo-entity with x = 1 and y = mean(y) is added. An empty or full cell diverges: the
    effect is 0 and the error comes from the intercept-only fit.
    """
    moments = set_moments(membership, n)
    traits = y.groupBy("trait").agg(F.sum("value").alias("y_sum"))
    dots = set_trait_dots(membership, y)
    j = dots.join(moments, "set_id").join(by_group(traits), "trait")
    m = F.col("n")
    y_mean = F.col("y_sum") / m
    n_in, y_in = F.col("size") + 1.0, F.col("xy") + y_mean
    n_out, y_out = m - F.col("size"), F.col("y_sum") - F.col("xy")
    p_in, p_out = y_in / n_in, F.when(n_out > 0, y_out / n_out)
    ok = (p_in > 0) & (p_in < 1) & F.coalesce((p_out > 0) & (p_out < 1), F.lit(False))
    logit = lambda q: F.log(q / (F.lit(1.0) - q))
    v_in, v_out = n_in * p_in * (F.lit(1.0) - p_in), n_out * p_out * (F.lit(1.0) - p_out)
    # the diverged fit keeps alpha = sum(y) / n on the log-odds scale, as the reference model prescribes
    alpha = (F.col("y_sum") + y_mean) / (m + 1.0)
    q0 = F.lit(1.0) / (F.lit(1.0) + F.exp(-alpha))
    d_in, d_out = n_in * q0 * (F.lit(1.0) - q0), n_out * q0 * (F.lit(1.0) - q0)
    info = F.when(ok, v_in - v_in * v_in / (v_in + v_out)).otherwise(d_in - d_in * d_in / (d_in + d_out))
    info = F.when(F.col("scale") == 0, F.lit(1.0)).when(info == 0, F.lit(1e-10)).otherwise(info)
    beta = F.when(ok, logit(p_in) - logit(p_out)).otherwise(F.lit(0.0))
    out = j.select(
        "set_id", "trait", "size", "mean", "scale",
        (beta * F.col("scale")).alias("beta_tilde"), (F.col("scale") / F.sqrt(info)).alias("se"),
        F.when(ok, logit(p_out)).otherwise(alpha).alias("alpha_tilde"), (~ok).alias("diverged"),
    )
    return finalize_stats(out)


def marginal_logistic_weighted(membership: DataFrame, y: DataFrame, n: Column, rounds: int = 1000,
                               tol: float = 1e-6) -> DataFrame:
    """Marginal logistic regression for general weights: Newton rounds over grouped sums.

    Every round joins the current (alpha, beta) of each (set, trait) to the set's members and takes five sums; the
    entities outside the set share one fitted value and enter as a count. Converged pairs, and those whose coefficients leave every bound,
    leave the loop; it ends with the last pair. Only a diverged pair's effect is 0; ``converged`` tells what ``rounds`` cut off.
    """
    from evisets.plans.iterate import cut

    moments = set_moments(membership, n)
    traits = y.groupBy("trait").agg(F.sum("value").alias("y_sum"))
    pairs = set_trait_dots(membership, y).join(moments, "set_id").join(by_group(traits), "trait")
    y_mean = F.col("y_sum") / F.col("n")
    state = cut(pairs.select(
        "set_id", "trait", "size", "mean", "scale", "n",
        (F.col("xy") + y_mean).alias("xy"), (F.col("y_sum") + y_mean).alias("y_sum"),
        F.lit(0.0).alias("alpha"), F.lit(0.0).alias("beta"), F.lit(False).alias("done"), F.lit(False).alias("diverged"),
    ))
    pseudo = pairs.select("set_id").distinct().select("set_id", F.lit(1.0).alias("weight"))
    members = cut(membership.select("set_id", "weight").unionByName(pseudo)
                  .groupBy("set_id", "weight").agg(F.count("*").alias("copies")))

    def sums(current: DataFrame) -> DataFrame:
        eta = F.least(F.col("weight") * F.col("beta") + F.col("alpha"), F.lit(100.0))
        fit = F.least(F.exp(eta) / (F.lit(1.0) + F.exp(eta)), F.lit(0.999))
        r = fit * (F.lit(1.0) - fit)
        w, c = F.col("weight"), F.col("copies")
        return current.join(members, "set_id").groupBy("set_id", "trait").agg(
            F.sum(c * w * w * r).alias("s_bb"), F.sum(c * w * r).alias("s_ab"), F.sum(c * r).alias("s_aa"),
            F.sum(c * w * fit).alias("s_fit_b"), F.sum(c * fit).alias("s_fit_a"),
        )

    outside = F.col("n") - F.col("size")
    for _ in range(rounds):
        active = state.where("not done")
        s = active.join(sums(active.select("set_id", "trait", "alpha", "beta")), ["set_id", "trait"])
        fit0 = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.col("alpha"), F.lit(100.0))))
        aa = F.col("s_aa") + outside * fit0 * (F.lit(1.0) - fit0)
        det = F.col("s_bb") * aa - F.col("s_ab") * F.col("s_ab")
        gb, ga = F.col("xy") - F.col("s_fit_b"), F.col("y_sum") - F.col("s_fit_a") - outside * fit0
        s = s.withColumns({"_det": det, "_aa": aa, "_gb": gb, "_ga": ga})
        bad = (F.col("_det") == 0) | (F.col("s_bb") == 0) | F.isnan("_det")
        step_b = (F.col("_aa") * F.col("_gb") - F.col("s_ab") * F.col("_ga")) / F.col("_det")
        step_a = (F.col("s_bb") * F.col("_ga") - F.col("s_ab") * F.col("_gb")) / F.col("_det")
        small = F.abs(step_b) <= tol * (F.abs(F.col("beta")) + tol)
        moved = s.select(
            "set_id", "trait", "size", "mean", "scale", "n", "xy", "y_sum",
            F.when(bad, F.col("alpha")).otherwise(F.col("alpha") + step_a).alias("alpha"),
            F.when(bad, F.col("beta")).otherwise(F.col("beta") + step_b).alias("beta"),
            (bad | small | (F.abs(F.col("alpha") + step_a) > 1000) | (F.abs(F.col("beta") + step_b) > 1000)).alias("done"), bad.alias("diverged"),
        )
        state = cut(state.where("done").unionByName(moved))
        if state.where("not done").isEmpty():
            break
    big = F.col("done") & ((F.abs("alpha") > 100) | (F.abs("beta") > 100))
    state = state.withColumn("diverged", F.col("diverged") | big).withColumns({
        "beta": F.when(F.col("diverged"), F.lit(0.0)).otherwise(F.col("beta")),
        "alpha": F.when(F.col("diverged"), F.col("y_sum") / (F.col("n") + 1)).otherwise(F.col("alpha")),
    })
    s = state.join(sums(state.select("set_id", "trait", "alpha", "beta")), ["set_id", "trait"])
    fit0 = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("alpha")))
    info = F.col("s_bb") - F.col("s_ab") * F.col("s_ab") / (F.col("s_aa") + outside * fit0 * (F.lit(1.0) - fit0))
    info = F.when(F.col("scale") == 0, F.lit(1.0)).when(info <= 0, F.lit(1e-10)).otherwise(info)
    return finalize_stats(s.select(
        "set_id", "trait", "size", "mean", "scale", (F.col("beta") * F.col("scale")).alias("beta_tilde"),
        (F.col("scale") / F.sqrt(info)).alias("se"), F.col("alpha").alias("alpha_tilde"), "diverged", F.col("done").alias("converged"),
    ))


def dichotomize(y: DataFrame, n: Column) -> DataFrame:
    """0/1 outcome per trait: 1 strictly above the (floor(sum) + 1)-th largest value.

    The threshold follows from the running counts of distinct values, so no trait is ranked in one task.
    """
    from evisets.operators.ordered import running_totals

    clean = y.withColumn("value", F.when(F.isnan("value"), F.lit(0.0)).otherwise(F.col("value")))
    counted = clean.groupBy("trait", "value").agg(F.count("*").alias("_n"))
    down = running_totals(counted.withColumn("_neg", -F.col("value")), ["trait"], "_neg", "_n", "_upto")
    target = clean.groupBy("trait").agg(F.floor(F.sum("value")).alias("_k"))
    # values absent from the long form are zeros; a threshold beyond the listed rows is therefore 0
    cut = down.join(target, "trait").where(F.col("_upto") > F.col("_k")).groupBy("trait").agg(
        F.max(-F.col("_neg")).alias("_cut")
    )
    return clean.join(cut, "trait", "left").select(
        "entity_id", "trait", F.when(F.col("value") > F.coalesce("_cut", F.lit(0.0)), 1.0).otherwise(0.0).alias("value")
    )


def sample_outcomes(y: DataFrame, draws: int, seed: int) -> DataFrame:
    """Bernoulli draws of each probability, from a hash of (entity, trait, draw, seed): the same on any partitioning."""
    u = F.xxhash64("entity_id", "trait", "draw", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return y.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn(
        "value", F.when(u < F.col("value"), 1.0).otherwise(0.0)
    )


def choose_model(y: DataFrame, max_for_linear: float = 0.95) -> DataFrame:
    """'logistic' for traits whose largest probability exceeds the limit, else 'linear'."""
    top = y.groupBy("trait").agg(F.max(to_prob(F.col("value"))).alias("max_prob"))
    return top.withColumn("model", F.when(F.col("max_prob") > max_for_linear, "logistic").otherwise("linear"))


def list_enrichment(entity_list: DataFrame, membership: DataFrame, max_q: float | None = 0.05) -> DataFrame:
    """Hypergeometric enrichment of an entity list in every set, with BH q-values and weights -ln p / sqrt(size)."""
    universe = membership.where("weight <> 0").select("entity_id").distinct()
    chosen = entity_list.select("entity_id").distinct().join(universe, "entity_id", "left_semi")
    marked = membership.where("weight <> 0").join(chosen.withColumn("_hit", F.lit(1)), "entity_id", "left")
    counts = marked.groupBy("set_id").agg(F.count("*").alias("size"), F.count("_hit").alias("overlap"))
    counts = counts.withColumns({"universe_size": count_of(universe), "list_size": count_of(chosen)})
    p = F.when(F.col("overlap") > 0, hypergeom_sf(
        F.col("overlap"), F.col("universe_size"), F.col("list_size"), F.col("size"))).otherwise(F.lit(1.0))
    out = bh_q(counts.withColumn("p", p), "p")
    weight = -F.log(F.greatest("p", F.lit(2.2250738585072014e-308))) / F.sqrt(F.greatest("size", F.lit(1)))
    out = out.withColumn("enrichment", weight)
    return out if max_q is None else out.where(F.col("q") <= max_q)


def enriched_entities(enriched: DataFrame, membership: DataFrame) -> DataFrame:
    """Entities of the retained sets."""
    return membership.join(enriched.select("set_id"), "set_id", "left_semi").select("entity_id").distinct()


def list_evidence(entity_list: DataFrame, background_list: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Evidence of a known-positive list: ln(c / (1 - c)) minus the background log odds; 0 elsewhere in the list's universe."""
    value = math.log(confidence / (1 - confidence)) - background_log_odds()
    hits = entity_list.select("entity_id").distinct().withColumn("_hit", F.lit(value))
    return background_list.select("entity_id").distinct().join(hits, "entity_id", "left").select(
        "entity_id", F.coalesce("_hit", F.lit(0.0)).alias("log_bf")
    )


def burden_evidence(df: DataFrame, low_p=2.5e-6, low_posterior=0.95, high_p=0.05, high_posterior=0.1) -> DataFrame:
    """Entity burden statistics (p, beta, se) -> log Bayes factor over the background odds."""
    cal = calibrate_bf(low_p, low_posterior, high_p, high_posterior)
    full = complete_p_beta_se(df)
    out = with_variant_z(full).withColumn("posterior", posterior(wakefield_log_bf(F.col("z"), cal.k), cal.prior_odds))
    capped = F.when(F.col("posterior") >= 1, F.lit(0.99)).otherwise(F.col("posterior"))
    return out.withColumn("log_bf", to_log_bf(capped))


def count_evidence(counts: DataFrame, score_breaks: list[float], max_freq: float = 0.001, prior_case: float = 1.0,
                   prior_control: float = 1.0) -> DataFrame:
    """Case / control burden evidence per entity: a beta-binomial log Bayes factor per score bin, summed.

    counts(entity_id, arm in case|control, score, count, total, max_freq). Each bin compares one shared carrier rate with
    two rates; a bin where controls carry more than cases counts against the entity. The engine this follows is described
    in its methods text only, so this is a specification-level form.
    """
    from evisets.functions.special import lgamma

    kept = counts.where(F.coalesce(F.col("max_freq"), F.lit(0.0)) <= max_freq)
    bin_no = sum((F.when(F.col("score") >= b, 1).otherwise(0) for b in score_breaks), F.lit(0))
    case = F.col("arm") == "case"
    binned = kept.withColumn("bin", bin_no).groupBy("entity_id", "bin").agg(
        F.sum(F.when(case, F.col("count")).otherwise(0)).cast("double").alias("k1"),
        F.max(F.when(case, F.col("total")).otherwise(0)).cast("double").alias("n1"),
        F.sum(F.when(~case, F.col("count")).otherwise(0)).cast("double").alias("k0"),
        F.max(F.when(~case, F.col("total")).otherwise(0)).cast("double").alias("n0"),
    )
    ln_beta = lambda a, b: lgamma(a) + lgamma(b) - lgamma(a + b)
    a, b = F.lit(prior_case), F.lit(prior_control)
    k1, n1, k0, n0 = (F.col(c) for c in ("k1", "n1", "k0", "n0"))
    rest1, rest0 = F.greatest(n1 - k1, F.lit(0.0)), F.greatest(n0 - k0, F.lit(0.0))
    separate = ln_beta(k1 + a, rest1 + b) + ln_beta(k0 + a, rest0 + b) - ln_beta(a, b) * 2.0
    shared = ln_beta(k1 + k0 + a, rest1 + rest0 + b) - ln_beta(a, b)
    signed = F.when(k1 * n0 >= k0 * n1, separate - shared).otherwise(-F.abs(separate - shared))
    return binned.withColumn("bin_log_bf", signed).groupBy("entity_id").agg(
        F.sum("bin_log_bf").alias("log_bf"), F.sum("k1").alias("case_count"), F.sum("k0").alias("control_count")
    )


def confounders(intervals: DataFrame, window: int = 250_000) -> DataFrame:
    """Per entity: neighbours up- and downstream within the window, sum of 1 / distance to them, and length."""
    from evisets.operators.align import overlap_join

    mid = intervals.select(F.col("entity_id").alias("other_id"), "chrom", F.col("start_pos").alias("pos"))
    pairs = overlap_join(mid, intervals.select("entity_id", "chrom", "start_pos", F.col("start_pos").alias("end_pos")),
                         pad=window).where("other_id <> entity_id")
    gap = F.abs(F.col("pos") - F.col("start_pos"))
    near = pairs.groupBy("entity_id").agg(
        F.count(F.when(F.col("pos") < F.col("start_pos"), 1)).alias("n_upstream"),
        F.count(F.when(F.col("pos") >= F.col("start_pos"), 1)).alias("n_downstream"),
        F.sum(F.lit(1.0) / F.greatest(gap, F.lit(1))).alias("inverse_distance"),
    )
    return intervals.select("entity_id", (F.col("end_pos") - F.col("start_pos")).alias("length")).join(
        near, "entity_id", "left"
    ).fillna(0, ["n_upstream", "n_downstream", "inverse_distance"])


def set_qc(membership: DataFrame, covariate_z: DataFrame, cols: list[str]) -> DataFrame:
    """Weighted mean of entity covariates per set: sum(w c) / sum(|w|)."""
    total = F.sum(F.abs("weight"))
    denom = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return membership.join(covariate_z.select("entity_id", *cols), "entity_id", "left").groupBy("set_id").agg(
        *[(F.coalesce(F.sum(F.col("weight") * F.col(c)), F.lit(0.0)) / denom).alias(c) for c in cols]
    )


def standardize(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """Population z-scores of whole-table columns; a constant column gives 0."""
    stats = df.agg(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    )).scalar()
    out = df.withColumn("_st", stats)
    for c in cols:
        sd = F.col("_st")[f"s_{c}"]
        out = out.withColumn(c + suffix, (F.col(c) - F.col("_st")[f"m_{c}"]) / F.when(sd == 0, F.lit(1.0)).otherwise(sd))
    return out.drop("_st")


def distance_corr(intervals: DataFrame, y: DataFrame, max_dist: float = 1_000_000.0, n_bins: int = 1000,
                  outlier_sd: float = 3.0) -> DataFrame:
    """One row (slope, intercept, max_distance): residual correlation of neighbours as a line in distance.

    Pairs within ``max_dist`` come from a binned range join and collapse at once into at most ``n_bins`` sums.
    """
    from evisets.operators.align import overlap_join

    located = intervals.join(y, "entity_id")
    first = located.select(F.col("entity_id").alias("id_a"), "chrom", F.col("start_pos").alias("pos"),
                           F.col("value").alias("y_a"), F.col("end_pos").alias("end_a"))
    second = located.select("entity_id", "chrom", "start_pos", F.col("start_pos").alias("end_pos"), F.col("value").alias("y_b"),
                            F.col("end_pos").alias("end_b"))
    later = (F.struct("start_pos", "end_b", "entity_id") > F.struct(
        F.col("pos").alias("start_pos"), F.col("end_a").alias("end_b"), F.col("id_a").alias("entity_id")))
    pairs = overlap_join(first, second, pad=int(max_dist)).where(later & (F.col("y_a") != 0))
    gap = F.abs(F.col("start_pos") - F.col("pos"))
    bins = pairs.groupBy(F.floor(gap / max_dist * (n_bins - 1)).alias("bin")).agg(
        (F.sum(F.col("y_a") * F.col("y_b")) / F.sum(F.col("y_a") * F.col("y_a"))).alias("c")
    ).withColumn("x", F.col("bin") * (max_dist / n_bins))
    limit = bins.agg(F.avg("c") + F.stddev_pop("c") * outlier_sd).scalar()
    kept = bins.withColumn("_limit", limit).where((F.col("c") > -F.col("_limit")) & (F.col("c") < F.col("_limit")))
    # sample covariance over population variance, the mixed form of the reference estimate
    slope = F.try_divide(F.covar_samp("x", "c"), F.var_pop("x"))
    fit = kept.agg(slope.alias("s"), F.avg("c").alias("mc"), F.avg("x").alias("mx"))
    fit = fit.withColumn("i", F.col("mc") - F.col("mx") * F.col("s"))
    usable = F.coalesce((F.col("s") <= 0) & (F.col("i") >= 0), F.lit(False))
    return fit.select(
        F.when(usable, F.col("s")).otherwise(F.lit(0.0)).alias("slope"),
        F.when(usable, F.col("i")).otherwise(F.lit(0.0)).alias("intercept"),
    ).withColumn("max_distance", F.when(F.col("slope") < 0, -F.col("intercept") / F.col("slope")))


def corr_from_distance(intervals: DataFrame, fit: DataFrame, max_dist: int = 1_000_000) -> DataFrame:
    """entity_corr(entity_a, entity_b, r): positive part of the fitted line, both directions, diagonal 1."""
    from evisets.operators.align import overlap_join

    first = intervals.select(F.col("entity_id").alias("entity_a"), "chrom", F.col("start_pos").alias("pos"))
    second = intervals.select(F.col("entity_id").alias("entity_b"), "chrom", "start_pos", F.col("start_pos").alias("end_pos"))
    line = fit.agg(F.struct(F.first("slope").alias("s"), F.first("intercept").alias("i"))).scalar()
    pairs = overlap_join(first, second, pad=max_dist).where("entity_a <> entity_b").withColumn("_l", line)
    r = F.col("_l.i") + F.col("_l.s") * F.abs(F.col("start_pos") - F.col("pos"))
    near = pairs.select("entity_a", "entity_b", r.alias("r")).where("r > 0")
    own = intervals.select(F.col("entity_id").alias("entity_a"), F.col("entity_id").alias("entity_b"), F.lit(1.0).alias("r"))
    return near.unionByName(own)


def dedupe_locations(intervals: DataFrame, y: DataFrame) -> DataFrame:
    """Of entities that share a location, keep the one with the highest evidence (ties: smaller id)."""
    located = intervals.join(y.select("entity_id", "value"), "entity_id")
    best = F.min_by(F.struct("entity_id", "value"), F.struct((-F.col("value")).alias("o"), F.col("entity_id")))
    return located.groupBy("chrom", "start_pos", "end_pos").agg(best.alias("_b")).select(
        "_b.entity_id", "chrom", "start_pos", "end_pos", "_b.value"
    )
