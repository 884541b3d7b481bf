"""Factor tables: loading views, relevance, metrics, matching across runs, choice of the prior scale.

loadings(axis, key, factor, value) in long form, non-negative; factors are few (tens), keys are many. Per-factor and per-pair
tables are therefore short; sums over keys are grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisets.functions.scalar import to_prob
from evisets.functions.special import one_sided_p, with_p
from evisets.operators.ordered import top_k
from evisets.plans.iterate import cut

MASS_FLOOR = 1e-50
PRIMARY_SHARE, SECONDARY_SHARE = 0.005, 0.0025


def loading_view(loadings: DataFrame, view: str = "raw") -> DataFrame:
    """raw loadings, specific (share of the key's total), or combined (their mean)."""
    if view == "raw":
        return loadings
    total = loadings.groupBy("axis", "key").agg(F.sum("value").alias("_t"))
    j = loadings.join(total, ["axis", "key"])
    specific = F.when(F.col("_t") > 0, F.col("value") / F.col("_t")).otherwise(F.lit(0.0))
    value = {"specific": specific, "combined": F.col("value") * 0.5 + specific * 0.5}[view]
    return j.withColumn("value", value).drop("_t")


def any_relevance(relevance: DataFrame) -> DataFrame:
    """Noisy-or over anchors: 1 - prod(1 - clip(r))."""
    r = F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0))
    sure = F.max(F.when(r >= 1, 1).otherwise(0)) == 1
    rest = F.coalesce(F.sum(F.when(r < 1, F.log1p(-r))), F.lit(0.0))
    return relevance.groupBy("factor").agg(F.when(sure, F.lit(1.0)).otherwise(F.lit(1.0) - F.exp(rest)).alias("any_relevance"))


def choose_anchor_source(df: DataFrame) -> Column:
    """Value of the first of combined, log_bf, prior that is not entirely non-finite over the table."""
    def finite(c):
        v = F.col(c)
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))

    s = df.agg(F.struct(*[F.avg(F.when(finite(c), 1.0).otherwise(0.0)).alias(c) for c in ("combined", "log_bf", "prior")])).scalar()
    return F.when(s["combined"] > 0, F.col("combined")).when(s["log_bf"] > 0, F.col("log_bf")).otherwise(F.col("prior"))


def threshold_profile(df: DataFrame, mode: str = "weighted_thresholded") -> DataFrame:
    """Profile input of a capture: positive part, or 0/1."""
    if mode == "weighted_thresholded":
        return df.withColumn("value", F.greatest("value", F.lit(0.0)))
    if mode == "binary_thresholded":
        return df.withColumn("value", F.when(F.col("value") > 0, 1.0).otherwise(0.0))
    raise ValueError(f"unknown profile mode: {mode}")


def profile_strength(profiles: DataFrame, key: str = "trait") -> DataFrame:
    return profiles.groupBy(key).agg(F.sum("value").alias("strength"))


def top_capture(capture: DataFrame, strength: DataFrame, k: int, key: str = "trait") -> DataFrame:
    """Top ``k`` profiles per factor by capture; strength, then key, breaks ties."""
    j = capture.join(strength, key)
    return top_k(j, ["factor"], [F.col("value").desc(), F.col("strength").desc(), F.col(key)], k)


def prune_factors(loadings: DataFrame, factors: DataFrame, min_lambda: float = 1e-3, rel_floor: float = 1e-5) -> DataFrame:
    """Factors with lambda above the threshold, a positive mass, and a largest loading that is not negligible."""
    s = loadings.groupBy("factor").agg(F.sum("value").alias("mass"), F.max("value").alias("top"))
    best = s.agg(F.max("top")).scalar()
    return factors.join(s, "factor").where(
        (F.col("lambda") >= min_lambda) & (F.col("mass") > 0) & (F.col("top") >= best * rel_floor))


def order_factors(loadings: DataFrame, relevance: DataFrame, rel_floor: float = 1e-5) -> DataFrame:
    """Renumber factors by falling relevance and zero loadings below ``rel_floor`` of the axis maximum."""
    new = relevance.select("factor", F.row_number().over(  # one row per factor
        Window.orderBy(F.col("any_relevance").desc(), "factor")).alias("new_factor"))
    top = loadings.groupBy("axis").agg(F.max("value").alias("_top"))
    small = F.col("value") < F.col("_top") * rel_floor
    return loadings.join(F.broadcast(new), "factor").join(F.broadcast(top), "axis").select(
        "axis", "key", F.col("new_factor").alias("factor"), F.when(small, F.lit(0.0)).otherwise(F.col("value")).alias("value"))


def _unit_mass(loadings: DataFrame, floor: float, by: list[str]) -> DataFrame:
    v = loadings.withColumn("value", F.greatest("value", F.lit(0.0)))
    if floor:
        v = v.where(F.col("value") >= floor)
    v = v.where("value > 0")
    mass = v.groupBy(*by, "factor").agg(F.sum("value").alias("_m"))
    return v.join(mass, [*by, "factor"]).select(*by, "key", "factor", (F.col("value") / F.col("_m")).alias("u"))


def weighted_jaccard(loadings: DataFrame, floor: float = 0.0, by: tuple[str, ...] = ("axis",)) -> DataFrame:
    """pair(by, factor_a, factor_b, jaccard) over factors that share a key; columns are scaled to mass 1.

    Each key gathers its few factors into one array (at most the factor count) and the pairs come from that array, so the work is
    linear in the keys. For unit-mass columns sum(max) = 2 - sum(min).
    """
    by = list(by)
    unit = _unit_mass(loadings, floor, by)
    packed = unit.groupBy(*by, "key").agg(F.collect_list(F.struct("factor", "u")).alias("_f"))
    a = packed.select(*by, "_f", F.explode("_f").alias("_a"))
    pairs = a.select(*by, F.col("_a.factor").alias("factor_a"), F.col("_a.u").alias("_ua"), F.explode("_f").alias("_b")).where(
        "factor_a <> _b.factor")
    s = pairs.groupBy(*by, "factor_a", F.col("_b.factor").alias("factor_b")).agg(F.sum(F.least("_ua", F.col("_b.u"))).alias("_min"))
    return s.select(*by, "factor_a", "factor_b", (F.col("_min") / (F.lit(2.0) - F.col("_min"))).alias("jaccard"))


def overlap_profile(loadings: DataFrame, floor: float = 0.0, by: tuple[str, ...] = ("axis",)) -> DataFrame:
    """Per factor: largest, 0.9 quantile and mean Jaccard to the others, and the nearest factor (ties: smaller)."""
    by = list(by)
    ids = loadings.select(*by, "factor").distinct()
    # factor x factor rows: short by construction (the factor count squared)
    others = ids.withColumnRenamed("factor", "factor_b")
    grid = ids.withColumnRenamed("factor", "factor_a").join(others, by).where("factor_a <> factor_b")
    j = grid.join(weighted_jaccard(loadings, floor, tuple(by)), [*by, "factor_a", "factor_b"], "left").fillna(0.0, ["jaccard"])
    near = F.struct((-F.col("jaccard")).alias("o"), F.col("factor_b"))
    s = j.groupBy(*by, F.col("factor_a").alias("factor")).agg(
        F.max("jaccard").alias("max_jaccard"), F.percentile("jaccard", 0.9).alias("q90_jaccard"),
        F.avg("jaccard").alias("mean_jaccard"), F.min_by("factor_b", near).alias("nearest_factor"))
    return ids.join(s, [*by, "factor"], "left").fillna(0.0, ["max_jaccard", "q90_jaccard", "mean_jaccard"])


def redundancy(loadings: DataFrame, floor: float = 0.0, by: tuple[str, ...] = ("axis",)) -> DataFrame:
    """Within-run redundancy: max, 0.9 quantile and mean of the nearest-factor overlaps."""
    p = overlap_profile(loadings, floor, by)
    return p.groupBy(*by).agg(F.max("max_jaccard").alias("redundancy_max"), F.percentile("max_jaccard", 0.9).alias("redundancy_q90"),
                              F.avg("max_jaccard").alias("redundancy_mean"))


def component_metrics(loadings: DataFrame, by: tuple[str, ...] = ("axis",)) -> DataFrame:
    """Mass, share, effective support 1 / sum w^2, counts at floors, largest and top-5 share of each factor."""
    by = list(by)
    v = loadings.withColumn("value", F.greatest("value", F.lit(0.0)))
    mass = v.groupBy(*by, "factor").agg(F.sum("value").alias("mass"))
    total = mass.groupBy(*by).agg(F.sum("mass").alias("_total"))
    j = v.join(mass, [*by, "factor"])
    w = F.when(F.col("mass") > 0, F.col("value") / F.col("mass")).otherwise(F.lit(0.0))
    j = j.withColumn("w", w)
    main = j.groupBy(*by, "factor").agg(
        F.sum(F.col("w") * F.col("w")).alias("_w2"), F.count(F.when(F.col("w") > 0, 1)).alias("num_nonzero"),
        *[F.count(F.when(F.col("w") >= t, 1)).alias(f"num_ge_{str(t).replace('.', 'p')}") for t in (0.001, 0.005, 0.01)],
        F.max("w").alias("max_weight"))
    five = top_k(j, [*by, "factor"], [F.col("w").desc(), F.col("key")], 5, "_r").groupBy(*by, "factor").agg(
        F.sum("w").alias("top5_weight_fraction"))
    return main.join(mass, [*by, "factor"]).join(total, by).join(five, [*by, "factor"]).select(
        *by, "factor", "mass", F.when(F.col("_total") > 0, F.col("mass") / F.col("_total")).otherwise(F.lit(0.0)).alias("mass_fraction"),
        F.when(F.col("_w2") > 0, F.lit(1.0) / F.col("_w2")).otherwise(F.lit(0.0)).alias("effective_support"),
        "num_nonzero", "num_ge_0p001", "num_ge_0p005", "num_ge_0p01", "max_weight", "top5_weight_fraction")


def factor_metrics(loadings: DataFrame, factors: DataFrame, axes: tuple[str, str] = ("entity", "set")) -> DataFrame:
    """One row of metrics per factor over both axes, with combined mass (geometric mean), unique share and tier."""
    comp, over = component_metrics(loadings), overlap_profile(loadings)
    both = comp.join(over, ["axis", "factor"])
    cols = [c for c in both.columns if c not in ("axis", "factor")]
    wide = both.groupBy("factor").agg(*[
        F.first(F.when(F.col("axis") == a, F.col(c)), ignorenulls=True).alias(f"{a}_{c}") for a in axes for c in cols])
    log_mass = [F.log(F.greatest(F.coalesce(F.col(f"{a}_mass"), F.lit(0.0)), F.lit(MASS_FLOOR))) for a in axes]
    wide = wide.withColumn("combined_mass", F.exp((log_mass[0] + log_mass[1]) / 2))
    total = wide.agg(F.sum("combined_mass")).scalar()
    share = F.col("combined_mass") / F.col("_t")
    wide = wide.withColumn("_t", total).withColumn("combined_mass_fraction", share).drop("_t")
    top = F.greatest(*[F.coalesce(F.col(f"{a}_max_jaccard"), F.lit(0.0)) for a in axes])
    tier = F.when(F.col("combined_mass_fraction") >= PRIMARY_SHARE, "primary").when(
        F.col("combined_mass_fraction") >= SECONDARY_SHARE, "secondary").otherwise("filtered")
    wide = wide.withColumns({"combined_unique_fraction": F.lit(1.0) - top,
                             "factor_mass_floor_0p5pct": F.col("combined_mass_fraction") >= PRIMARY_SHARE, "factor_tier": tier})
    return factors.join(wide, "factor", "left")


def mass_profile(loadings: DataFrame, by: tuple[str, ...] = ("run",), floor_share: float = 0.005) -> DataFrame:
    """Per run: effective factor count, tier counts, tail share and concentration of factor masses."""
    by = list(by)
    m = loadings.groupBy(*by, "axis", "factor").agg(F.sum(F.greatest("value", F.lit(0.0))).alias("m"))
    g = m.groupBy(*by, "factor").agg(F.exp(F.avg(F.log(F.greatest("m", F.lit(MASS_FLOOR))))).alias("mass"))
    total = g.groupBy(*by).agg(F.sum("mass").alias("_t"), F.sum(F.col("mass") * F.col("mass")).alias("_t2"))
    s = g.join(total, by).withColumn("share", F.col("mass") / F.col("_t"))
    s = s.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("share").desc(), "factor")))  # tens of rows
    small = F.col("share") < SECONDARY_SHARE
    return s.groupBy(*by).agg(
        (F.first("_t") * F.first("_t") / F.first("_t2")).alias("effective_factor_count"),
        F.count(F.when(F.col("share") >= floor_share, 1)).alias("mass_ge_floor_factor_count"),
        F.count(F.when(F.col("share") >= PRIMARY_SHARE, 1)).alias("primary_factor_count"),
        F.count(F.when((F.col("share") >= SECONDARY_SHARE) & (F.col("share") < PRIMARY_SHARE), 1)).alias("secondary_factor_count"),
        F.count(F.when(small, 1)).alias("filtered_factor_count"),
        F.coalesce(F.sum(F.when(small, F.col("share"))), F.lit(0.0)).alias("tail_fraction"),
        F.avg(F.when(small, 1.0).otherwise(0.0)).alias("filtered_fraction"),
        F.max("share").alias("max_mass_fraction"), F.sum(F.when(F.col("_r") <= 5, F.col("share"))).alias("top5_mass_fraction"))


def factor_cosines(loadings: DataFrame, reference: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """cosine(by, ref_factor, factor, cosine) between a reference factor table (key, factor, value) and every run."""
    by = list(by)
    norm = loadings.groupBy(*by, "factor").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n"))
    rnorm = reference.groupBy(F.col("factor").alias("ref_factor")).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_rn"))
    dots = loadings.join(reference.select("key", F.col("factor").alias("ref_factor"), F.col("value").alias("_rv")), "key").groupBy(
        *by, "ref_factor", "factor").agg(F.sum(F.col("value") * F.col("_rv")).alias("_d"))
    scale = F.col("_n") * F.col("_rn")
    return dots.join(norm, [*by, "factor"]).join(rnorm, "ref_factor").select(
        *by, "ref_factor", "factor", F.when(scale > 0, F.col("_d") / scale).otherwise(F.lit(0.0)).alias("cosine"))


def _assign(cost):
    """Minimum-cost one-to-one assignment of rows to columns (shortest augmenting paths), rows <= columns."""
    import numpy as np

    rows, cols = cost.shape
    u, v = np.zeros(rows + 1), np.zeros(cols + 1)
    owner = np.zeros(cols + 1, dtype=int)
    for row in range(1, rows + 1):
        owner[0], col = row, 0
        slack, back, seen = np.full(cols + 1, np.inf), np.zeros(cols + 1, dtype=int), np.zeros(cols + 1, dtype=bool)
        while owner[col]:
            seen[col] = True
            reduced = cost[owner[col] - 1] - u[owner[col]] - v[1:]
            better = ~seen[1:] & (reduced < slack[1:])
            slack[1:][better], back[1:][better] = reduced[better], col
            nxt = int(np.argmin(np.where(seen[1:], np.inf, slack[1:]))) + 1
            gap = slack[nxt]
            u[owner[seen]] += gap
            v[seen] -= gap
            slack[~seen] -= gap
            col = nxt
        while col:
            owner[col], col = owner[back[col]], back[col]
    return [(owner[c] - 1, c - 1) for c in range(1, cols + 1) if owner[c]]


def match_factors(cosines: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """One-to-one matches with the largest total cosine, per run.

    A group is one run's factor-by-factor table (the factor count squared), so it always fits one task.
    """
    by = list(by)
    types = {f.name: f.dataType.simpleString() for f in cosines.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in [*by, "ref_factor", "factor"]) + ", cosine double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="ref_factor", columns="factor", values="cosine", fill_value=0.0, aggfunc="first").sort_index().sort_index(axis=1)
        flip = table.shape[0] > table.shape[1]
        cost = 1.0 - (table.T if flip else table).to_numpy(float)
        found = [(c, r) if flip else (r, c) for r, c in _assign(cost)]
        out = pd.DataFrame({"ref_factor": [table.index[r] for r, _ in found], "factor": [table.columns[c] for _, c in found],
                            "cosine": [float(table.iat[r, c]) for r, c in found]})
        for i, b in enumerate(by):
            out.insert(i, b, pdf[b].iloc[0])
        return out.sort_values("ref_factor")

    return cosines.groupBy(*by).applyInPandas(solve, schema)


def modal_runs(summaries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Runs with the most frequent factor count; ties go to the smaller median error, then the smaller count.

    summaries(run, num_factors, error, evidence[, by]).
    """
    by = list(by)
    counts = summaries.groupBy(*by, "num_factors").agg(F.count("*").alias("_c"), F.median("error").alias("_e"))
    order = F.struct((-F.col("_c")).alias("a"), F.coalesce(F.col("_e"), F.lit(float("inf"))).alias("b"), F.col("num_factors").alias("c"))
    best = counts.groupBy(*by).agg(F.min_by("num_factors", order).alias("num_factors"))
    return summaries.join(best, [*by, "num_factors"], "left_semi")


def best_run(summaries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Run of least evidence value; ties go to more factors, then the first run."""
    by = list(by)
    others = [c for c in summaries.columns if c not in by]
    order = F.struct(F.coalesce(F.col("evidence"), F.lit(float("inf"))).alias("a"), (-F.col("num_factors")).alias("b"), F.col("run").alias("c"))
    return summaries.groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("_b")).select(*by, "_b.*")


def consensus(loadings: DataFrame, matches: DataFrame, n_runs: int, min_cosine: float = 0.7, min_support: float = 0.5,
              how: str = "median") -> tuple[DataFrame, DataFrame]:
    """(consensus loadings, support per reference factor) from loadings(run, axis, key, factor, value) and one-to-one matches.

    A key without a loading in a matched run counts as 0 there.
    """
    good = matches.where(F.col("cosine") >= min_cosine)
    support = good.groupBy(F.col("ref_factor").alias("factor")).agg(F.count("*").alias("support_runs")).withColumn(
        "support_fraction", F.col("support_runs") / F.lit(float(n_runs)))
    support = support.withColumn("kept", F.col("support_fraction") >= min_support)
    kept = good.join(support.where("kept").select(F.col("factor").alias("ref_factor"), "support_runs"), "ref_factor")
    j = loadings.join(kept.select("run", "factor", "ref_factor", "support_runs"), ["run", "factor"])
    packed = j.groupBy("axis", "key", "ref_factor").agg(  # one value per run
        F.sort_array(F.collect_list("value")).alias("_v"), F.first("support_runs").cast("int").alias("_s"))
    full = F.sort_array(F.concat(F.array_repeat(F.lit(0.0), F.col("_s") - F.size("_v")), F.col("_v")))
    if how == "mean":
        value = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.col("_s")
    else:
        lo, hi = F.floor((F.col("_s") + 1) / 2).cast("int"), F.floor((F.col("_s") + 2) / 2).cast("int")
        value = (F.element_at("_full", lo) + F.element_at("_full", hi)) / 2
    out = packed.withColumn("_full", full).select("axis", "key", F.col("ref_factor").alias("factor"), value.alias("value"))
    return out, support


def phi_summary(summaries: DataFrame, stability: DataFrame, redundant: DataFrame, masses: DataFrame, max_factors: int) -> DataFrame:
    """One row per phi: support, stability, redundancy and mass medians over its modal runs.

    All inputs are keyed by (phi, run); stability(phi, run, cosine) holds the matched cosines of non-reference runs.
    """
    modal = modal_runs(summaries, ("phi",)).select("phi", "run", "num_factors", "error", "evidence")
    runs = summaries.groupBy("phi").agg(F.count("*").alias("_all"))
    med = [c for c in ("redundancy_max", "redundancy_q90", "redundancy_mean")]
    mcols = ["effective_factor_count", "mass_ge_floor_factor_count", "primary_factor_count", "secondary_factor_count",
             "filtered_factor_count", "tail_fraction", "filtered_fraction", "max_mass_fraction", "top5_mass_fraction"]
    j = modal.join(redundant, ["phi", "run"], "left").join(masses, ["phi", "run"], "left")
    s = j.groupBy("phi").agg(
        F.first("num_factors").alias("modal_factor_count"), F.count("*").alias("num_modal_runs"), F.min("error").alias("best_error"),
        F.min("evidence").alias("best_evidence"), *[F.median(c).alias(c) for c in med + mcols])
    stable = stability.join(modal.select("phi", "run"), ["phi", "run"], "left_semi").groupBy("phi").agg(F.avg("cosine").alias("_st"))
    s = s.join(runs, "phi").join(stable, "phi", "left")
    return s.select(
        "phi", "modal_factor_count", "num_modal_runs", (F.col("num_modal_runs") / F.col("_all")).alias("run_support"),
        F.when(F.col("num_modal_runs") > 1, F.coalesce("_st", F.lit(0.0))).alias("stability"),
        "best_error", "best_evidence", *med, *mcols, (F.col("modal_factor_count") >= max_factors).alias("capped"))


def select_phi(summary: DataFrame, max_redundancy: float = 0.5, max_redundancy_q90: float = 0.35, min_run_support: float = 0.6,
               min_stability: float = 0.85, max_fit_loss: float = 0.05, k_band: float = 0.9, runs_per_step: int = 1) -> DataFrame:
    """The chosen phi as one row with ``reason``.

    Acceptable candidates (uncapped ones first) within the error band of the best fit and the effective-count band of the richest:
    the largest phi wins. Without an acceptable one, the least constraint violation wins. One row per phi, so the ordering is over
    a handful of rows.
    """
    inf = F.lit(float("inf"))
    ok = (F.col("modal_factor_count") > 0) & (F.col("redundancy_max") <= max_redundancy) & (
        F.col("redundancy_q90") <= max_redundancy_q90) & (F.col("run_support") >= min_run_support)
    if runs_per_step > 1:
        ok = ok & (F.col("num_modal_runs") >= 2) & (F.coalesce("stability", F.lit(-1.0)) >= min_stability)
    s = summary.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("_pool", F.when(F.col("_ok"), F.when(F.col("capped"), 1).otherwise(0)).otherwise(2))
    s = s.withColumn("_level", F.min("_pool").over(everything))
    in_pool = (F.col("_pool") == F.col("_level")) & (F.col("_level") < 2)
    s = s.withColumn("_in", in_pool)
    s = s.withColumn("_limit", F.min(F.when(F.col("_in"), F.col("best_error"))).over(everything) * (1 + max_fit_loss) + 1e-12)
    s = s.withColumn("_fit", F.col("_in") & (F.col("best_error") <= F.col("_limit")))
    s = s.withColumn("_kmax", F.max(F.when(F.col("_fit"), F.col("effective_factor_count"))).over(everything))
    s = s.withColumn("_band", F.col("_fit") & (F.col("effective_factor_count") >= F.col("_kmax") * k_band - 1e-12))
    s = s.withColumn("_best_all", F.min("best_error").over(everything))
    z = F.lit(0.0)
    fit_violation = F.greatest(z, F.col("best_error") - F.col("_best_all") * (1 + max_fit_loss))
    if runs_per_step > 1:
        stab = F.when((F.col("num_modal_runs") < 2) | F.col("stability").isNull(), inf).otherwise(
            F.greatest(z, F.lit(min_stability) - F.col("stability")))
    else:
        stab = z
    normal = F.array(-F.col("phi"), "tail_fraction", "filtered_fraction", F.coalesce("best_error", inf), -F.col("primary_factor_count").cast("double"))
    fallback = F.array(
        F.when(F.col("capped"), 1.0).otherwise(0.0), F.greatest(z, F.col("redundancy_q90") - max_redundancy_q90),
        F.greatest(z, F.col("redundancy_max") - max_redundancy), F.greatest(z, F.lit(min_run_support) - F.col("run_support")), stab,
        F.coalesce(fit_violation, z), F.col("effective_factor_count"), F.col("redundancy_q90"), F.col("redundancy_max"), -F.col("phi"))
    s = s.withColumn("_order", F.when(F.col("_level") < 2, normal).otherwise(fallback)).where((F.col("_level") == 2) | F.col("_band"))
    cols = [c for c in summary.columns]
    reason = F.when(F.col("_level") < 2, "effective_k_tail_band").otherwise("fallback_min_constraint_violation")
    return s.withColumn("reason", reason).groupBy().agg(F.min_by(F.struct(*cols, "reason"), "_order").alias("_b")).select("_b.*")


def merge_families(metrics: DataFrame, axes: tuple[str, str] = ("entity", "set"), overlap: tuple[float, float] = (0.8, 0.6),
                   unique: float = 0.2) -> DataFrame:
    """family(factor, family, keep): factors linked to a near neighbour form families; the heaviest member stays.

    Links: nearest factor with overlap at or above the axis limit, or, for a factor with little unique mass, its nearer neighbour.
    Families are connected components by spreading the smallest label.
    """
    a, b = axes
    na, nb = F.col(f"{a}_nearest_factor"), F.col(f"{b}_nearest_factor")
    ja, jb = F.coalesce(F.col(f"{a}_max_jaccard"), F.lit(0.0)), F.coalesce(F.col(f"{b}_max_jaccard"), F.lit(0.0))
    closer = F.when(nb.isNull() | (ja > jb) | ((ja == jb) & (na <= nb)), na).otherwise(nb)
    links = F.array_compact(F.array(
        F.when(ja >= overlap[0], na), F.when(jb >= overlap[1], nb), F.when(F.col("combined_unique_fraction") <= unique, closer)))
    edges = metrics.select("factor", F.explode(links).alias("other"))
    edges = cut(edges.unionByName(edges.select(F.col("other").alias("factor"), F.col("factor").alias("other"))).distinct())
    labels = cut(metrics.select("factor", F.col("factor").alias("family")))
    while True:  # to the fixed point: a half-spread label would be a wrong family
        seen = edges.join(labels.select(F.col("factor").alias("other"), F.col("family").alias("_f")), "other").groupBy("factor").agg(
            F.min("_f").alias("_f"))
        new = cut(labels.join(seen, "factor", "left").select(
            "factor", F.least("family", F.coalesce("_f", "family")).alias("family"), F.col("family").alias("_old")))
        labels = new.select("factor", "family")
        if new.where("family <> _old").isEmpty():
            break
    j = labels.join(metrics, "factor")
    order = F.struct(F.col("combined_mass_fraction"), F.col(f"{a}_effective_support"), F.col(f"{b}_effective_support"), (-F.col("factor")).alias("o"))
    heads = j.groupBy("family").agg(F.max_by("factor", order).alias("_head"))
    return labels.join(heads, "family").select("factor", "family", (F.col("factor") == F.col("_head")).alias("keep"))


def factor_tops(loadings: DataFrame, k: int = 5, anchor: DataFrame | None = None) -> DataFrame:
    """Top ``k`` keys per (axis, factor[, anchor]) by combined loading, times the anchor's weight of the key where given."""
    v = loading_view(loadings, "combined")
    groups = ["axis", "factor"]
    if anchor is not None:
        v = v.join(anchor.select("axis", "key", "anchor", F.col("weight").alias("_w")), ["axis", "key"]).withColumn(
            "value", F.col("value") * F.col("_w")).drop("_w")
        groups.append("anchor")
    return top_k(v, groups, [F.col("value").desc(), F.col("key")], k)


def default_label(tops: DataFrame, axis: str = "set", k: int = 3) -> DataFrame:
    """Label of a factor: its first top keys, joined."""
    head = tops.where((F.col("axis") == axis) & (F.col("rank") <= k))
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("key").cast("string").alias("k")))), lambda s: s["k"])
    return head.groupBy("factor").agg(F.array_join(names, ", ").alias("label"))


def factor_weights(evidence: DataFrame, background: float = 0.05) -> DataFrame:
    """Anchor weight(key, anchor, weight): probability of each key per anchor, plus 'any', the noisy-or over anchors."""
    w = evidence.select("key", F.col("anchor").cast("string").alias("anchor"), to_prob(F.col("value"), background).alias("weight"))
    miss = F.sum(F.log1p(-F.least("weight", F.lit(1.0 - 1e-15))))
    whole = w.groupBy("key").agg((F.lit(1.0) - F.exp(miss)).alias("weight")).select("key", F.lit("any").alias("anchor"), "weight")
    return w.unionByName(whole)


# The factor workflows and the inputs each needs.
WORKFLOWS = {
    "F1": ("single trait from set and entity statistics", ("set_stats", "entity_stats", "membership")),
    "F2": ("entity list", ("entity_list", "membership")),
    "F3": ("single trait with projected traits", ("set_stats", "entity_stats", "membership", "set_trait")),
    "F4": ("several anchor traits", ("anchor_traits", "entity_trait", "set_trait", "membership")),
    "F5": ("any trait", ("any_trait", "entity_trait", "set_trait", "membership")),
    "F6": ("single anchor entity", ("anchor_entity", "entity_trait", "membership")),
    "F7": ("several anchor entities", ("anchor_entities", "entity_trait", "membership")),
    "F8": ("any entity", ("any_entity", "entity_trait", "membership")),
    "F9": ("anchor set", ("anchor_set", "set_trait", "membership")),
}


def choose_workflow(given: set[str]) -> str:
    """Most specific workflow whose required inputs are all given."""
    fitting = [(len(need), w) for w, (_, need) in WORKFLOWS.items() if set(need) <= given]
    if not fitting:
        raise ValueError("no factor workflow fits the given inputs")
    best = max(n for n, _ in fitting)
    return min(w for n, w in fitting if n == best)


def thresholded_hits(entity_trait: DataFrame, cutoff: float = 1.0, col: str = "combined") -> DataFrame:
    """hit(entity_id, trait) where the combined evidence passes the cut-off (direct evidence: above 0)."""
    return entity_trait.where(F.col(col) > (cutoff if col == "combined" else 0.0)).select("entity_id", "trait")


def _inverse3(s: dict[str, Column]) -> dict[str, Column]:
    """Inverse of a symmetric 3 x 3 matrix of Columns (keys 'ij', i <= j) by cofactors."""
    a, b, c, d, e, f = (s[k] for k in ("00", "01", "02", "11", "12", "22"))
    c00, c01, c02 = d * f - e * e, c * e - b * f, b * e - c * d
    det = a * c00 + b * c01 + c * c02
    return {"00": c00 / det, "01": c01 / det, "02": c02 / det, "11": (a * f - c * c) / det, "12": (b * c - a * e) / det,
            "22": (a * d - b * b) / det}


def factor_trait_marginal(loadings: DataFrame, hits: DataFrame, anchor: DataFrame | None, robust: bool = True) -> DataFrame:
    """Marginal regression of each trait's 0/1 hits on each factor's loading, with intercept and optional anchor covariate.

    loadings(entity_id, factor, value) lists every entity of the universe for every factor (zeros included); anchor(entity_id, value).
    The design does not depend on the trait, so x'x, leverages and all terms without y are sums per factor; a trait only adds sums
    over its hits. HC3: V = sum u^2 e^2 / (1 - h)^2 with u = row 0 of the inverse times x, and e^2 = (x b)^2 + y (1 - 2 x b) for 0/1 y.
    """
    x = loadings.select("entity_id", "factor", F.col("value").alias("x0"))
    if anchor is None:
        x = x.withColumn("x1", F.lit(0.0))
    else:
        x = x.join(anchor.select("entity_id", F.col("value").alias("x1")), "entity_id")
    x = x.withColumn("x2", F.lit(1.0))
    names = ["00", "01", "02", "11", "12", "22"]
    prod = {k: F.col(f"x{k[0]}") * F.col(f"x{k[1]}") for k in names}
    gram = x.groupBy("factor").agg(*[F.sum(prod[k]).alias(f"g{k}") for k in names])
    g = {k: F.col(f"g{k}") for k in names}
    if anchor is None:  # an empty covariate: a unit diagonal keeps the matrix regular and its coefficient 0
        g["11"] = F.lit(1.0)
    inv = _inverse3(g)
    gram = gram.select("factor", *[inv[k].alias(f"a{k}") for k in names])
    A = lambda i, j: F.col(f"a{min(i, j)}{max(i, j)}")
    rows = x.join(gram, "factor")  # one row per factor on the right
    h = sum((A(i, j) * F.col(f"x{i}") * F.col(f"x{j}") for i in range(3) for j in range(3)), F.lit(0.0))
    u = A(0, 0) * F.col("x0") + A(0, 1) * F.col("x1") + A(0, 2) * F.col("x2")
    keep = F.greatest(F.lit(1.0) - h, F.lit(1e-8))
    rows = rows.withColumn("w", u * u / (keep * keep)) if robust else rows.withColumn("w", F.lit(0.0))
    base = rows.groupBy("factor").agg(*[F.sum(F.col("w") * prod[k]).alias(f"q{k}") for k in names], F.count("*").alias("n"))
    per = rows.join(hits, "entity_id").groupBy("factor", "trait").agg(
        *[F.sum(f"x{i}").alias(f"b{i}") for i in range(3)], F.sum("w").alias("hw"), F.count("*").alias("n_hits"),
        *[F.sum(F.col("w") * F.col(f"x{i}")).alias(f"hw{i}") for i in range(3)])
    j = per.join(base, "factor").join(gram, "factor")
    for i in range(3):
        j = j.withColumn(f"beta{i}", A(i, 0) * F.col("b0") + A(i, 1) * F.col("b1") + A(i, 2) * F.col("b2"))
    B = lambda i: F.col(f"beta{i}")
    if robust:
        Q = lambda i, k: F.col(f"q{min(i, k)}{max(i, k)}")
        quad = sum((B(i) * B(k) * Q(i, k) for i in range(3) for k in range(3)), F.lit(0.0))
        var = quad + F.col("hw") - F.lit(2.0) * (B(0) * F.col("hw0") + B(1) * F.col("hw1") + B(2) * F.col("hw2"))
    else:
        sse = F.col("n_hits") - (B(0) * F.col("b0") + B(1) * F.col("b1") + B(2) * F.col("b2"))
        dof = F.greatest(F.col("n") - F.lit(2 if anchor is None else 3), F.lit(1))
        var = sse / dof * A(0, 0)
    out = j.select("factor", "trait", F.col("beta0").alias("beta"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("se"), "n_hits")
    out = out.withColumn("z", F.when(F.col("se") > 0, F.col("beta") / F.col("se")).otherwise(F.lit(0.0)))
    out = with_p(out)
    return out.withColumn("p_onesided", one_sided_p(F.col("z"), F.col("p")))


def factor_trait_joint(wide: DataFrame, factor_cols: list[str], hits: DataFrame, anchor_col: str | None = None) -> DataFrame:
    """Joint regression of each trait's hits on all factors (plus anchor and intercept), HC3 errors.

    wide(entity_id, factors..., [anchor]). The k x k inverse is computed once on the driver (k = factors + 2). Per coefficient the
    trait-free part of the error is a k x k sum over entities; traits add sums over their hits only.
    """
    import numpy as np

    from evisets.operators.regress import fetch_inverse, linear_column, normal_sums

    cols = [*factor_cols, *([anchor_col] if anchor_col else []), "intercept"]
    k = len(cols)
    x = wide.withColumn("intercept", F.lit(1.0)).select("entity_id", *[F.col(c).cast("double").alias(c) for c in cols])
    inv = fetch_inverse(normal_sums(x, cols, []), k)
    h = sum((linear_column(inv[i], cols) * F.col(cols[i]) for i in range(k)), F.lit(0.0))
    keep = F.greatest(F.lit(1.0) - h, F.lit(1e-8))
    xs = x.withColumn("_x", F.array(*cols)).withColumn("_w", F.array(*[
        F.pow(linear_column(inv[j], cols) / keep, F.lit(2.0)) for j in range(len(factor_cols))])).select("entity_id", "_x", "_w")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(factor_cols), k, k))
        for pdf in batches:
            X, Wt = np.stack(pdf["_x"].to_numpy()), np.stack(pdf["_w"].to_numpy())
            total += np.einsum("nj,na,nb->jab", Wt, X, X, optimize=True)
        yield pd.DataFrame({"j": range(len(factor_cols)), "q": [t.ravel().tolist() for t in total]})

    parts = xs.mapInPandas(partial, "j int, q array<double>")
    summed = parts.select("j", F.posexplode("q").alias("i", "v")).groupBy("j", "i").agg(F.sum("v").alias("v"))
    Q = np.zeros((len(factor_cols), k * k))
    for r in summed.collect():  # factors x k^2 numbers
        Q[r["j"], r["i"]] = r["v"]
    Q = Q.reshape(len(factor_cols), k, k)
    hit_rows = xs.join(hits, "entity_id")
    flat = hit_rows.groupBy("trait").agg(
        F.count("*").alias("n_hits"), *[F.sum(F.col("_x")[i]).alias(f"b{i}") for i in range(k)],
        *[F.sum(F.col("_w")[j]).alias(f"hw{j}") for j in range(len(factor_cols))],
        *[F.sum(F.col("_w")[j] * F.col("_x")[i]).alias(f"hw{j}_{i}") for j in range(len(factor_cols)) for i in range(k)])
    trait_type = flat.schema["trait"].dataType.simpleString()

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b = pdf[[f"b{i}" for i in range(k)]].to_numpy(float)
            beta = b @ inv.T
            for j, name in enumerate(factor_cols):
                lin = pdf[[f"hw{j}_{i}" for i in range(k)]].to_numpy(float)
                var = np.einsum("ti,ik,tk->t", beta, Q[j], beta) + pdf[f"hw{j}"].to_numpy(float) - 2 * (lin * beta).sum(axis=1)
                yield pd.DataFrame({"factor": name, "trait": pdf["trait"], "beta": beta[:, j], "se": np.sqrt(np.maximum(var, 0)),
                                    "n_hits": pdf["n_hits"]})

    out = flat.mapInPandas(finish, f"factor string, trait {trait_type}, beta double, se double, n_hits long")
    out = out.withColumn("z", F.when(F.col("se") > 0, F.col("beta") / F.col("se")).otherwise(F.lit(0.0)))
    out = with_p(out)
    return out.withColumn("p_onesided", one_sided_p(F.col("z"), F.col("p")))


def factor_trait_continuous(loadings: DataFrame, outcome: DataFrame, n: Column) -> DataFrame:
    """Continuous trait evidence on factor loadings, one factor at a time (marginal linear form)."""
    from evisets.operators.assoc import marginal_linear

    axes = loadings.where("value <> 0").select(F.col("factor").alias("set_id"), "entity_id", F.col("value").alias("weight"))
    fit = marginal_linear(axes, outcome, n)
    beta, se = F.col("beta_tilde") / F.col("scale"), F.col("se") / F.col("scale")
    return fit.select(F.col("set_id").alias("factor"), "trait", beta.alias("beta"), se.alias("se"), "z", "p",
                      one_sided_p(F.col("z"), F.col("p")).alias("p_onesided"))


def union_modes(blocks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, blocks)
