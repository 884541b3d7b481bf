"""Spike-and-slab shrinkage, entity priors and cross-validation.

stats(set_id, trait, beta_tilde, se, scale, mean). Effects are internal (per sd of the set); divide by ``scale`` for external.
The residual correlation of sets is never stored: V beta is two sparse products through the entities, linear in the number of
memberships, so a popular entity costs its degree, not its degree squared.
"""

from __future__ import annotations

import itertools
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisets.functions.scalar import SigmoidThreshold, scaled_sigma2, spike_slab, to_prob
from evisets.operators.assoc import finalize_stats, marginal_linear, marginal_logistic, sample_outcomes
from evisets.operators.packed import entity_keys, in_blocks, name_axis, pack, sum_over_entities, sum_over_sets, unpack
from evisets.operators.sets import entity_degree
from evisets.plans.iterate import by_group, cut, grid, heavy_keys, held, spread

DEFAULT_P = 0.001
DEFAULT_POWER = -2.0
DEFAULT_SPARSE_FRACTION = 0.001


def with_hyper(stats: DataFrame, p: float | Column = DEFAULT_P, sigma2: float | Column = 1e-4,
               power: float | None = DEFAULT_POWER, threshold: SigmoidThreshold | None = None) -> DataFrame:
    """Attach the inclusion weight and the scaled slab variance of every row."""
    p = p if isinstance(p, Column) else F.lit(float(p))
    sigma2 = sigma2 if isinstance(sigma2, Column) else F.lit(float(sigma2))
    scaled = sigma2 if power is None else scaled_sigma2(F.col("scale"), sigma2, power, threshold)
    return stats.withColumns({"p_used": p, "sigma2_used": scaled})


def sparse_cut(df: DataFrame, col: str, fraction: float, groups: list[str]) -> DataFrame:
    """Zero effects below ``fraction`` of the largest effect of their group."""
    if not fraction:
        return df
    top = df.groupBy(*groups).agg(F.max(F.abs(col)).alias("_top"))
    return df.join(by_group(top), groups).withColumn(
        col, F.when(F.abs(col) < F.col("_top") * fraction, F.lit(0.0)).otherwise(F.col(col))
    ).drop("_top")


def shrink_independent(stats: DataFrame, sparse_fraction: float = 0.0, groups: list[str] | None = None) -> DataFrame:
    """Posterior of every effect on its own: a pure column expression given p_used and sigma2_used."""
    beta, post, cond = spike_slab(F.col("beta_tilde"), F.col("se"), F.col("p_used"), F.col("sigma2_used"))
    live = (F.col("sigma2_used") > 0) & (F.col("se") > 0)
    out = stats.withColumns({
        "beta_uncorrected": F.when(live, beta).otherwise(F.lit(0.0)),
        "postp": F.when(live, post).otherwise(F.lit(0.0)),
        "cond_beta": F.when(live, cond).otherwise(F.lit(0.0)),
    })
    return sparse_cut(out, "beta_uncorrected", sparse_fraction, groups or ["trait"])


def prior_from_effects(membership: DataFrame, betas: DataFrame, col: str = "beta", groups: tuple[str, ...] = ("trait",),
                       universe: DataFrame | None = None) -> DataFrame:
    """Entity prior: sum of X beta / scale minus the same sum at the mean of X.

    Only non-zero effects are joined. ``universe`` adds entities without any live set at the constant, minus the sum at the mean; then
    every trait of ``betas`` is listed, one without live sets at 0.
    """
    live = cut(betas.where((F.col(col) != 0) & (F.col("scale") > 0)).select(  # read for the sums and for the shift
        "set_id", *groups, (F.col(col) / F.col("scale")).alias("_b"), "mean"
    ))
    shift = live.groupBy(*groups).agg(F.sum(F.col("mean") * F.col("_b")).alias("_shift"))
    effects = pack(live, ["set_id"], name_axis(live, list(groups)), "_b")
    sums = unpack(sum_over_sets(membership.select("set_id", "entity_id", "weight"), effects, ["entity_id"]), "_xb")
    if universe is not None:
        names = cut(betas.select(*groups).distinct().join(shift, list(groups), "left").fillna(0.0, ["_shift"]))  # a row per trait
        joined = grid(universe.select("entity_id").distinct(), names).join(sums, ["entity_id", *groups], "left")
    else:
        joined = sums.join(by_group(shift), list(groups))
    return joined.select("entity_id", *groups, (F.coalesce("_xb", F.lit(0.0)) - F.col("_shift")).alias("prior"))


def correlation_product(membership: DataFrame, betas: DataFrame, n: Column, col: str = "beta",
                        groups: tuple[str, ...] = ("trait",), heavy: DataFrame | None = None) -> DataFrame:
    """(V beta)(set_id, groups): set correlations times effects, through the entities.

    With u = X (beta / scale), (V beta)_i = (x_i . u / n - mean_i sum_j mean_j beta_j / scale_j) / scale_i. ``heavy`` are the memberships' popular
    entities, counted once by the caller.
    """
    live = cut(betas.where((F.col(col) != 0) & (F.col("scale") > 0)).select(
        "set_id", *groups, (F.col(col) / F.col("scale")).alias("_b"), "mean"
    ))
    membership = membership.select("set_id", "weight", *entity_keys(membership))
    u = sum_over_sets(membership, pack(live, ["set_id"], name_axis(live, list(groups)), "_b"), entity_keys(membership))
    back = unpack(sum_over_entities(membership, u, ["set_id"], heavy), "_xu")
    shift = live.groupBy(*groups).agg(F.sum(F.col("mean") * F.col("_b")).alias("_shift"))
    base = betas.where("scale > 0").select("set_id", *groups, "mean", "scale")
    joined = base.join(back, ["set_id", *groups], "left").join(by_group(shift), list(groups), "left").withColumn("_n", n)
    value = (F.coalesce("_xu", F.lit(0.0)) / F.col("_n") - F.col("mean") * F.coalesce("_shift", F.lit(0.0))) / F.col("scale")
    return joined.select("set_id", *groups, value.alias("v_beta"))


def shrink_joint(membership: DataFrame, stats: DataFrame, n: Column, rounds: int = 200, tol: float = 1e-4,
                 sparse_fraction: float = 0.0, damping: float = 0.5) -> DataFrame:
    """Joint posterior means: each effect is shrunk after removing what the other sets explain.

    stats carries p_used and sigma2_used. All traits advance together; a trait whose step grows has its damping halved, and a
    trait whose largest step falls below ``tol`` x its largest effect leaves the loop. The loop ends when every trait has left it; a trait
    can circle around its solution, so it ends after ``rounds`` rounds at the latest, and ``converged`` tells which rows are final.
    """
    membership, heavy = in_blocks(cut(spread(membership.select("set_id", "entity_id", "weight"), "set_id", "entity_id")))
    start = cut(shrink_independent(stats))
    keys = ["set_id", "trait"]
    fixed = start.select(*keys, "beta_tilde", "se", "scale", "mean", "p_used", "sigma2_used")
    state = start.select(*keys, F.col("beta_uncorrected").alias("beta"), "postp", "scale", "mean",
                         F.lit(damping).alias("_w"), F.lit(float("inf")).alias("_last"), F.lit(False).alias("_done"))
    for _ in range(rounds):
        active = state.where("not _done")
        vb = correlation_product(membership, active, n, heavy=heavy)
        j = active.select(*keys, "beta", "_w", "_last").join(fixed, keys).join(vb, keys, "left")
        resid = F.col("beta_tilde") - (F.coalesce("v_beta", F.lit(0.0)) - F.col("beta"))
        j = j.withColumn("_r", resid)
        target, post, _ = spike_slab(F.col("_r"), F.col("se"), F.col("p_used"), F.col("sigma2_used"))
        live = (F.col("sigma2_used") > 0) & (F.col("se") > 0)
        j = j.withColumns({
            "_t": F.when(live, target).otherwise(F.lit(0.0)), "_post": F.when(live, post).otherwise(F.lit(0.0)),
        })
        j = j.withColumn("_new", F.col("beta") + F.col("_w") * (F.col("_t") - F.col("beta")))
        j = cut(j.select(*keys, F.col("beta").alias("_old"), F.col("_new").alias("beta"), F.col("_post").alias("postp"),
                         "scale", "mean", "_w", "_last"))
        step = j.groupBy("trait").agg(
            F.max(F.abs(F.col("beta") - F.col("_old"))).alias("_step"), F.max(F.abs("beta")).alias("_top")
        )
        moved = j.join(by_group(step), "trait").select(
            *keys, "beta", "postp", "scale", "mean",
            F.when(F.col("_step") > F.col("_last"), F.col("_w") / 2).otherwise(F.col("_w")).alias("_w"),
            F.col("_step").alias("_last"), (F.col("_step") <= F.col("_top") * tol).alias("_done"),
        )
        state = cut(state.where("_done").unionByName(moved))
        if state.where("not _done").isEmpty():
            break
    return sparse_cut(state.select(*keys, "beta", "postp", "scale", "mean", F.col("_done").alias("converged")), "beta", sparse_fraction, ["trait"])


def screen_zero(membership: DataFrame, stats: DataFrame, n: Column, blocks: int, rounds: int = 200,
                fraction: float = DEFAULT_SPARSE_FRACTION) -> DataFrame:
    """Sets worth a joint fit: shrink jointly within hashed blocks only and keep the non-zero ones.

    The block is appended to the trait key, so blocks never see each other and all run at once, each to convergence.
    """
    block = F.pmod(F.xxhash64("set_id"), F.lit(blocks))
    tagged = stats.withColumn("trait", F.concat_ws("|", F.col("trait").cast("string"), block.cast("string")))
    fit = shrink_joint(membership, tagged, n, rounds, sparse_fraction=fraction)
    return fit.where("beta <> 0").select("set_id").distinct()


def hyper_step(stats: DataFrame, hyper: DataFrame, pseudo: float = 0.0, power: float | None = DEFAULT_POWER,
               update_sigma: bool = False, missing_share: float = 1.0, inflate: float = 1.0,
               floor: float = 2e-3) -> DataFrame:
    """One update of hyper(trait, batch, p, sigma2) from the posterior of each batch's sets.

    p is the (pseudo-counted) mean inclusion; sigma2 the expected squared effect per unit scale^power, or kept at a constant
    ratio to p when only p is learned.
    """
    keys = ["trait", "batch"]
    now = hyper.select(*keys, F.col("p").alias("_hp"), F.col("sigma2").alias("_hs"))
    j = with_hyper(stats.join(by_group(now), keys), F.col("_hp"), F.col("_hs"), power)
    slab = F.col("sigma2_used") / F.col("p_used")
    se2 = F.col("se") * F.col("se")
    _, post, cond = spike_slab(F.col("beta_tilde"), F.col("se"), F.col("p_used"), F.col("sigma2_used"))
    unit = F.lit(1.0) if power is None else F.pow("scale", F.lit(float(power)))
    s = j.where("scale > 0").groupBy(*keys).agg(
        F.sum(post).alias("_post"), F.count("*").alias("_m"), F.first("_hp").alias("_p"), F.first("_hs").alias("_s2"),
        F.sum(post * (cond * cond + slab / (slab + se2) * se2)).alias("_h2"), F.sum(unit).alias("_unit"),
    )
    p = (F.lit(pseudo) + F.col("_post")) / (F.lit(2 * pseudo) + F.col("_m")) * missing_share * inflate
    s = s.withColumn("p", F.least(p, F.lit(1.0)))
    if update_sigma:
        learned = F.col("_h2") / F.col("_unit") * missing_share
        sigma2 = F.greatest(learned, F.lit(floor) * F.col("p") * F.col("_m") / F.col("_unit"))
    else:
        sigma2 = F.col("_s2") / F.col("_p") * F.col("p")
    return s.select(*keys, "p", sigma2.alias("sigma2"), F.col("_p").alias("p_before"), F.col("_s2").alias("sigma2_before"))


def learn_hyper(stats: DataFrame, start_p: float, start_sigma2: float, rounds: int | None = None, tol: float = 0.01,
                **options) -> DataFrame:
    """Repeat ``hyper_step`` until p and sigma2 of every (trait, batch) move by less than ``tol``, or for ``rounds`` rounds; ``converged`` tells."""
    if "batch" not in stats.columns:
        stats = stats.withColumn("batch", F.lit("all"))
    stats = held(stats.select("trait", "batch", "beta_tilde", "se", "scale"))  # read in every round
    hyper = cut(stats.select("trait", "batch").distinct().withColumns(
        {"p": F.lit(float(start_p)), "sigma2": F.lit(float(start_sigma2))}))
    for _ in itertools.count() if rounds is None else range(rounds):
        step = cut(hyper_step(stats, hyper, **options))
        moved = F.greatest(F.abs(F.col("p") - F.col("p_before")) / F.col("p_before"), F.abs(F.col("sigma2") - F.col("sigma2_before")) / F.col("sigma2_before"))
        hyper = step.select("trait", "batch", "p", "sigma2", (~(moved >= tol) | (F.col("p") < 1e-12)).alias("converged"))
        if hyper.where("not converged").isEmpty():
            break
    return hyper


def assign_hyper(batches: DataFrame, learned: DataFrame, cap_to_first: bool = True, unlearned: str = "first") -> DataFrame:
    """Hyper values of every batch: learned p capped at the first batch's p; unlearned batches take the first or the mean.

    batches(trait, batch, batch_order); there are few batches per trait, so a window over them is small.
    """
    w = Window.partitionBy("trait")
    j = batches.join(learned.select("trait", "batch", F.col("p").alias("_p"), F.col("sigma2").alias("_s")),
                     ["trait", "batch"], "left")
    order = F.when(F.col("_p").isNotNull(), F.col("batch_order"))
    first_p, first_s = F.min_by("_p", order).over(w), F.min_by("_s", order).over(w)
    if unlearned == "mean":
        fill_p, fill_s = F.avg("_p").over(w), F.avg("_s").over(w)
    else:
        fill_p, fill_s = first_p, first_s
    p = F.coalesce(F.col("_p"), fill_p)
    over = p > first_p
    s = F.coalesce(F.col("_s"), fill_s)
    if cap_to_first:
        s = F.when(over, s / p * first_p).otherwise(s)
        p = F.least(p, first_p)
    return j.select("trait", "batch", "batch_order", p.alias("p"), s.alias("sigma2"))


def adjust_for_degree(priors: DataFrame, membership: DataFrame, groups: tuple[str, ...] = ("trait",)) -> DataFrame:
    """Remove the line of the prior on the number of sets of an entity, fitted on the rows of ``priors``: list all entities there.

    Slope = sample covariance / population variance, the mixed form of the reference.
    """
    degree = entity_degree(membership).select("entity_id", "n_sets")
    j = priors.join(degree, "entity_id", "left").fillna(0, ["n_sets"])
    fit = j.groupBy(*groups).agg(
        F.try_divide(F.covar_samp("prior", "n_sets"), F.var_pop("n_sets")).alias("_slope"), F.avg("prior").alias("_mp"),
        F.avg("n_sets").alias("_mn"),
    )
    slope = F.coalesce(F.col("_slope"), F.lit(0.0))
    return j.join(by_group(fit), list(groups)).withColumn(
        "prior_adj", F.col("prior") - slope * F.col("n_sets") - (F.col("_mp") - slope * F.col("_mn"))
    ).drop("_slope", "_mp", "_mn")


def combine_scores(priors: DataFrame, evidence: DataFrame, groups: tuple[str, ...] = ("trait",)) -> DataFrame:
    """combined = prior + log_bf, and its probability D. ``priors`` lists all entities, also those without a live set; a missing log_bf is 0."""
    j = evidence.join(priors, ["entity_id", *groups], "full_outer").fillna(0.0, ["prior", "log_bf"])
    j = j.withColumn("combined", F.col("prior") + F.col("log_bf"))
    return j.withColumn("combined_D", to_prob(F.col("combined")))


def fold_stats(membership: DataFrame, y: DataFrame, folds: DataFrame) -> DataFrame:
    """Marginal regressions with each fold left out: stats(set_id, trait, fold, ...); ``n`` entities are left, ``share`` is the mean left over the whole mean.

    Each sum is taken once per (set, fold) and the fold's part is subtracted from the total, so k folds cost one pass. ``folds``
    (entity_id, fold) covers the universe and has few distinct folds.
    """
    f = folds.select("entity_id", "fold")
    axis = f.groupBy("fold").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("fold", "n"))).scalar()
    n_all = f.agg(F.count("*")).scalar()

    located = held(membership.select("set_id", "entity_id", "weight").join(f, "entity_id"))
    y = held(y.select("entity_id", "trait", "value"))
    part = located.groupBy("set_id", "fold").agg(
        F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("weight")).alias("w2"), F.count("*").alias("c"))
    total = part.groupBy("set_id").agg(F.sum("w").alias("tw"), F.sum("w2").alias("tw2"), F.sum("c").alias("tc"))
    sets = total.withColumn("_f", F.explode(axis)).select("set_id", "tw", "tw2", "tc", "_f.fold", (n_all - F.col("_f.n")).alias("n"))
    sets = sets.join(part, ["set_id", "fold"], "left").fillna(0, ["w", "w2", "c"])
    mean = (F.col("tw") - F.col("w")) / F.col("n")
    var = F.greatest((F.col("tw2") - F.col("w2")) / F.col("n") - mean * mean, F.lit(0.0))
    sets = sets.select("set_id", "fold", "n", (F.col("tc") - F.col("c")).alias("size"), F.col("c").alias("lost"),
                       (F.col("tw") - F.col("w")).alias("sum_w"), mean.alias("mean"), F.sqrt(var).alias("scale"),
                       F.try_divide(mean * n_all, F.col("tw")).alias("share"))

    yf = y.join(f, "entity_id")
    ypart = yf.groupBy("trait", "fold").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    ytot = ypart.groupBy("trait").agg(F.sum("s").alias("ts"), F.sum("s2").alias("ts2"))
    ygrid = ytot.withColumn("_f", F.explode(axis)).select("trait", "ts", "ts2", "_f.fold", (n_all - F.col("_f.n")).alias("_n"))
    ygrid = ygrid.join(ypart, ["trait", "fold"], "left").fillna(0.0, ["s", "s2"])
    ymean = (F.col("ts") - F.col("s")) / F.col("_n")
    ygrid = ygrid.select("trait", "fold", ymean.alias("y_mean"),
                         ((F.col("ts2") - F.col("s2")) / F.col("_n") - ymean * ymean).alias("y_var"))

    values = pack(y, ["entity_id"], name_axis(y, ["trait"]), "value")
    sums = sum_over_entities(located, values, ["set_id", "fold"], heavy_keys(located, "entity_id"))
    dpart = unpack(replace(sums, rows=held(sums.rows)), "xy")  # read for the parts and for their totals
    dtot = dpart.groupBy("set_id", "trait").agg(F.sum("xy").alias("txy"))
    grid = dtot.join(sets, "set_id").join(by_group(ygrid), ["trait", "fold"]).join(dpart, ["set_id", "trait", "fold"], "left")
    xy = F.col("txy") - F.coalesce("xy", F.lit(0.0))
    cov = (xy - F.col("sum_w") * F.col("y_mean")) / F.col("n")
    flat = F.col("scale") <= 1e-12
    return grid.select(
        "set_id", "trait", "fold", "n", "size", "lost", "share", "mean", "scale",
        F.when(flat, F.lit(0.0)).otherwise(cov / F.col("scale")).alias("beta_tilde"),
        F.when(flat, F.lit(0.0)).otherwise(F.sqrt("y_var") / F.sqrt(F.col("n") - 1)).alias("se"),
    )


def loco_priors(membership: DataFrame, y: DataFrame, folds: DataFrame, p: float = DEFAULT_P, sigma2: float = 1e-4,
                power: float | None = DEFAULT_POWER) -> DataFrame:
    """Leave-one-fold-out priors: effects fitted without an entity's own fold (chromosome), applied to it.

    Every entity of ``folds`` is listed for every trait with live sets; one without a live set has minus the sum at the mean.
    """
    fits = shrink_independent(with_hyper(fold_stats(membership, y, folds), p, sigma2, power))
    return fold_priors(membership, folds, fits, "beta_uncorrected")


def fold_priors(membership: DataFrame, folds: DataFrame, fits: DataFrame, col: str) -> DataFrame:
    """Priors of every entity of ``folds`` from the effects fits(set_id, trait, fold, mean, scale, <col>) of its own fold's fit."""
    live = cut(fits.where((F.col(col) != 0) & (F.col("scale") > 0)).select("set_id", "trait", "fold", "mean", (F.col(col) / F.col("scale")).alias("_b")))
    shift = live.groupBy("trait", "fold").agg(F.sum(F.col("mean") * F.col("_b")).alias("_shift"))
    own = membership.select("set_id", "entity_id", "weight").join(folds.select("entity_id", "fold"), "entity_id")
    sums = unpack(sum_over_sets(own, pack(live, ["set_id", "fold"], name_axis(live, ["trait"]), "_b"), ["entity_id", "fold"]), "_xb")
    every = folds.select("entity_id", "fold").join(by_group(shift.groupBy("fold").agg(F.collect_list(F.struct("trait", "_shift")).alias("_t"))), "fold")
    every = every.select("entity_id", "fold", F.explode("_t").alias("_t")).select("entity_id", "fold", "_t.*")
    return every.join(sums, ["entity_id", "trait", "fold"], "left").select(
        "entity_id", "trait", "fold", (F.coalesce("_xb", F.lit(0.0)) - F.col("_shift")).alias("prior"))


def drop_reduced(fits: DataFrame, folds: DataFrame, max_p: float = 1.0, sds: float = 3.0) -> DataFrame:
    """Zero effects, with 100 x the trait's largest error, of sets whose mean a fold's removal cuts by more than ``sds`` sd of what k equal folds
    would, or whose p without the fold is above ``max_p``; ``dropped`` tells."""
    k = folds.agg(F.count_distinct("fold").cast("double")).scalar()
    left = (k - 1) / k
    largest = fits.groupBy("trait").agg(F.max("se").alias("_max"))
    j = finalize_stats(fits).join(by_group(largest), "trait")
    gone = (F.col("share") < left - sds * F.sqrt(left * (1 - left))) | (F.col("p") > max_p)
    j = j.withColumn("dropped", F.coalesce(gone, F.lit(True)))
    return j.withColumns({"beta_tilde": F.when(F.col("dropped"), 0.0).otherwise(F.col("beta_tilde")),
                          "se": F.when(F.col("dropped"), F.col("_max") * 100).otherwise(F.col("se"))}).drop("_max")


def cv_sigma(membership: DataFrame, y: DataFrame, folds: DataFrame, grid: list[float], p: float = DEFAULT_P,
             power: float | None = DEFAULT_POWER, stats: DataFrame | None = None) -> DataFrame:
    """Mean squared error of held-out evidence for each slab variance: rss(trait, sigma2).

    ``stats`` are stored ``fold_stats`` of the same inputs. The grid is a short literal array on the leave-out statistics; each fold's effects predict only that fold.
    """
    from evisets.operators.sets import set_moments

    membership, y = held(membership.select("set_id", "entity_id", "weight")), held(y.select("entity_id", "trait", "value"))
    stats = (fold_stats(membership, y, folds) if stats is None else stats).withColumn("sigma2", F.explode(F.array(*[F.lit(float(s)) for s in grid])))
    fits = shrink_independent(with_hyper(stats, p, F.col("sigma2"), power)).where("beta_uncorrected <> 0")
    n = folds.agg(F.count("*")).scalar()
    full = set_moments(membership.join(folds.select("entity_id"), "entity_id", "left_semi"), n).select(
        "set_id", F.col("scale").alias("_scale"))
    live = fits.join(full, "set_id").where("_scale > 0").select(
        "set_id", "trait", "fold", "sigma2", (F.col("beta_uncorrected") / F.col("_scale")).alias("_b"))
    axis = name_axis(y, ["trait"])
    own = membership.select("set_id", "entity_id", "weight").join(folds.select("entity_id", "fold"), "entity_id")
    pred = sum_over_sets(own, pack(live, ["set_id", "fold", "sigma2"], axis, "_b"), ["entity_id", "fold", "sigma2"])
    means = y.groupBy("trait").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_s2")).withColumn("_n", n)
    # sum (pred - (y - m))^2 = sum (y - m)^2 + sum pred^2 - 2 sum pred (y - m): entities without a prediction need no row
    mean = F.col("_s") / F.col("_n")
    base = means.select("trait", mean.alias("_m"), (F.col("_s2") - F.col("_n") * mean * mean).alias("_ss"), "_n")
    every = base.withColumn("sigma2", F.explode(F.array(*[F.lit(float(s)) for s in grid])))
    seen = pack(y, ["entity_id"], axis, "value").rows.drop("_mask").withColumnsRenamed({f"_v{k}": f"_y{k}" for k in range(axis.width)})
    cells = F.array(*[F.struct(F.lit(k).alias("_at"), F.col(f"_v{k}").alias("p"), F.coalesce(f"_y{k}", F.lit(0.0)).alias("y")) for k in range(axis.width)])
    parts = pred.rows.join(seen, ["entity_id", "_slot"], "left").select("sigma2", "_slot", "_mask", F.explode(cells).alias("_c")).where("getbit(_mask, _c._at) = 1")
    parts = parts.groupBy("sigma2", "_slot", "_c._at").agg(F.sum(F.col("_c.p") * (F.col("_c.p") - 2 * F.col("_c.y"))).alias("_d"), F.sum("_c.p").alias("_p"))
    parts = parts.join(F.broadcast(axis.table), ["_slot", "_at"]).join(base.select("trait", "_m"), "trait").select(
        "trait", "sigma2", (F.col("_d") + 2 * F.col("_m") * F.col("_p")).alias("_d"))
    return every.join(parts, ["trait", "sigma2"], "left").select(
        "trait", "sigma2", ((F.col("_ss") + F.coalesce("_d", F.lit(0.0))) / F.col("_n")).alias("rss"))


def best_sigma(rss: DataFrame) -> DataFrame:
    """Best grid value per trait (ties: the smaller) and whether it lies at the edge of the grid."""
    s = rss.groupBy("trait").agg(
        F.min_by("sigma2", F.struct("rss", "sigma2")).alias("sigma2"), F.min("rss").alias("rss"),
        F.min("sigma2").alias("_lo"), F.max("sigma2").alias("_hi"))
    return s.select("trait", "sigma2", "rss", ((F.col("sigma2") == F.col("_lo")) | (F.col("sigma2") == F.col("_hi"))).alias("at_edge"))


def _frontier(rss: DataFrame, flat: float) -> DataFrame:
    """Best of each trait with the side (-1, 0, 1) of its grid on which it lies, and whether the error is level there."""
    lo, hi = F.min(F.struct("sigma2", "rss")), F.max(F.struct("sigma2", "rss"))
    best = best_sigma(rss).drop("at_edge")
    ends = rss.groupBy("trait").agg(lo.alias("_lo"), hi.alias("_hi"))
    inner = rss.join(ends, "trait").where((F.col("sigma2") > F.col("_lo.sigma2")) & (F.col("sigma2") < F.col("_hi.sigma2"))).groupBy("trait").agg(
        lo.alias("_low"), hi.alias("_high"))
    side = F.when(F.col("sigma2") == F.col("_lo.sigma2"), F.lit(-1)).when(F.col("sigma2") == F.col("_hi.sigma2"), F.lit(1)).otherwise(F.lit(0))
    near = F.when(F.col("side") < 0, F.col("_low.rss")).otherwise(F.col("_high.rss"))
    level = (F.col("side") != 0) & ~(F.col("rss") < near * (1 - flat))
    return best.join(ends, "trait").join(inner, "trait").withColumn("side", side).withColumn("flat", level).select("trait", "sigma2", "rss", "side", "flat")


def cross_validate(membership: DataFrame, y: DataFrame, folds: DataFrame, sigma2: float, explore: int = 1, p: float = DEFAULT_P,
                   power: float | None = DEFAULT_POWER, flat: float = 1e-6) -> DataFrame:
    """Best slab variance of each trait on its own decade grid: trait, sigma2, rss, at_edge, flat.

    All traits start with ``explore`` decades either side of ``sigma2``. Those whose best lies at an end go on outwards by 2 x explore decades; a
    trait leaves when its best is inside, or when the error no longer falls by ``flat`` of itself at the end (``flat``: any variance beyond does as
    well). The leave-out statistics are stored once, a step reads those of the open traits only. ``at_edge`` stays true only where the variance
    itself would leave the range of doubles. A trait whose evidence is all null has no row.
    """
    if explore < 1:
        raise ValueError("explore at least one decade")
    membership, y = held(membership.select("set_id", "entity_id", "weight")), held(y.where("value is not null"))
    stats = held(fold_stats(membership, y, folds))
    done = held(cv_sigma(membership, y, folds, [sigma2 * 10.0 ** k for k in range(-explore, explore + 1)], p, power, stats))
    parts = [done]
    first = held(_frontier(done, flat))
    for side in (-1, 1):  # the traits that went down never come back up: the other end is known to be worse
        reach, open_ = explore, held(first.where((F.col("side") == side) & ~F.col("flat")).select("trait"))
        while not open_.isEmpty():
            values = [sigma2 * 10.0 ** (side * k) for k in range(reach + 1, reach + 2 * explore + 1)]
            reach += 2 * explore
            if not all(1e-300 < v < 1e300 for v in values):
                break
            only = lambda df: df.join(by_group(open_), "trait", "left_semi")  # noqa: E731, B023
            parts.append(held(cv_sigma(membership, only(y), folds, values, p, power, only(stats))))
            known = only(reduce(DataFrame.unionByName, parts))
            open_ = held(_frontier(known, flat).where((F.col("side") == side) & ~F.col("flat")).select("trait"))
    best = _frontier(reduce(DataFrame.unionByName, parts), flat)
    return best.select("trait", "sigma2", "rss", ((F.col("side") != 0) & ~F.col("flat")).alias("at_edge"), "flat")


def pops_prior(membership: DataFrame, y: DataFrame, folds: DataFrame, sigma2: float) -> DataFrame:
    """Leave-one-fold-out prior under a pure normal slab (p = 1, variance proportional to scale^2)."""
    return loco_priors(membership, y, folds, p=1.0, sigma2=sigma2, power=2.0)


def naive_prior(membership: DataFrame, y: DataFrame, n: Column, p: float = DEFAULT_P, sigma2: float = 1e-4,
                power: float | None = DEFAULT_POWER) -> DataFrame:
    """Prior by one projection of the marginal effects, without a refit."""
    stats = with_hyper(marginal_linear(membership, y, n), p, sigma2, power)
    return prior_from_effects(membership, shrink_independent(stats), "beta_uncorrected")


def alternate(membership: DataFrame, evidence: DataFrame, universe: DataFrame, rounds: int = 5, chains: int = 1,
              p: float = DEFAULT_P, sigma2: float = 1e-4, power: float | None = DEFAULT_POWER, seed: int = 0,
              adjust_degree: bool = True) -> tuple[DataFrame, DataFrame]:
    """Alternate between entity probabilities and set effects; returns (scores, draws).

    evidence(entity_id, trait, log_bf). One round: D = sigma(prior + log_bf + background); outcomes are D itself for one chain or
    seeded Bernoulli draws of D for several (the chain is part of the trait key); effects are refitted by closed-form logistic
    regression and shrunk; their projection is the next prior. draws(chain, iteration, trait, set_id, value) feeds the chain
    diagnostics. The sampler this stands for is described in its methods text only.
    """
    n = universe.agg(F.count("*")).scalar()
    binary = cut(membership.where("weight <> 0").select("set_id", "entity_id", F.lit(1.0).alias("weight")))
    chain_axis = F.explode(F.sequence(F.lit(1), F.lit(chains)))
    everyone = cut(universe.select("entity_id").union(evidence.select("entity_id")).union(binary.select("entity_id")).distinct())
    scores = cut(evidence.select("entity_id", "trait", "log_bf").withColumn("chain", chain_axis).withColumn("prior", F.lit(0.0)))
    draws = None
    for it in range(1, rounds + 1):
        prob = scores.select("entity_id", "trait", "chain", to_prob(F.col("prior") + F.col("log_bf")).alias("value"))
        keyed = prob.select("entity_id", F.struct("trait", "chain").alias("trait"), "value")
        outcomes = keyed if chains == 1 else sample_outcomes(keyed, 1, seed * 7919 + it).drop("draw")
        stats = marginal_logistic(binary, outcomes, n)
        fit = shrink_independent(with_hyper(stats, p, sigma2, power))
        effects = cut(fit.select("set_id", "trait.trait", "trait.chain", F.col("beta_uncorrected").alias("beta"), "mean", "scale", "postp"))
        prior = prior_from_effects(binary, effects, "beta", ("trait", "chain"), everyone)
        if adjust_degree:
            prior = adjust_for_degree(prior, binary, ("trait", "chain")).withColumn("prior", F.col("prior_adj"))
        scores = cut(scores.drop("prior").join(prior.select("entity_id", "trait", "chain", "prior"),
                                               ["entity_id", "trait", "chain"], "left").fillna(0.0, ["prior"]))
        this = effects.select("chain", F.lit(it).alias("iteration"), "trait", "set_id", F.col("beta").alias("value"))
        draws = this if draws is None else draws.unionByName(this)
    final = scores.withColumn("combined", F.col("prior") + F.col("log_bf")).withColumn("combined_D", to_prob(F.col("combined")))
    return final, draws
