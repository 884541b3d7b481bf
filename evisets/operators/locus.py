"""Locus evidence: from variant statistics to a per-entity log Bayes factor.

variants(variant_id, chrom, pos, p, beta, se[, freq]); signals(signal_id, chrom, pos, p).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisets.functions.scalar import (
    BACKGROUND, Calibration, calibrate_bf, complete_p_beta_se, posterior, to_log_bf, wakefield_log_bf, with_variant_z,
)
from evisets.operators.align import near_join, nearest_entities, overlap_join
from evisets.plans.iterate import cut

# Default logistic decay of the link probability with distance, and the caps of the model.
LINK_SLOPE = -5.086e-05
LINK_INTERCEPT = 2.988
EXON_LINK = 0.95
MAX_ENTITY_PROB = 0.9


def score_variants(variants: DataFrame, cal: Calibration) -> DataFrame:
    """Complete p / beta / se, then z, log Bayes factor and posterior of each variant."""
    full = complete_p_beta_se(variants)
    full = with_variant_z(full).withColumn("log_bf", wakefield_log_bf(F.col("z"), cal.k))
    return full.withColumn("posterior", posterior(F.col("log_bf"), cal.prior_odds))


def variant_qc(variants: DataFrame, min_n_ratio: float = 0.5, forced: DataFrame | None = None) -> DataFrame:
    """Drop variants with an effective sample size (1 / se^2) below the ratio of the mean; forced positions always stay."""
    n_eff = F.lit(1.0) / (F.col("se") * F.col("se"))
    mean_n = variants.agg(F.avg(n_eff)).scalar()
    out = variants.withColumns({"n_eff": n_eff, "_mean": mean_n})
    keep = F.col("n_eff") >= F.col("_mean") * min_n_ratio
    if forced is not None:
        marks = forced.select("chrom", "pos").distinct().withColumn("_f", F.lit(True))
        out = out.join(marks, ["chrom", "pos"], "left")
        keep = keep | F.coalesce(F.col("_f"), F.lit(False))
    out = out.where(keep).withColumn("log_p", -F.log("p") / F.lit(math.log(10)))
    if "freq" in variants.columns:
        out = out.withColumn("freq", F.least(F.col("freq"), F.lit(1.0) - F.col("freq")))
    return out.drop("_mean", "_f")


def _local_leads(open_variants: DataFrame, window: int) -> DataFrame:
    """Variants that beat every open variant of their own position bin and of the two neighbouring bins.

    Bins are one window wide, so such a variant is the best within +-window. The best of a bin is a partial aggregation; only
    bin winners meet, never the variants of a region.
    """
    bins = open_variants.groupBy("chrom", F.floor(F.col("pos") / window).alias("_bin")).agg(
        F.min(F.struct("p", "pos", "variant_id")).alias("_best"))
    around = bins.withColumn("_bin", F.explode(F.array(*[F.col("_bin") + d for d in (-1, 0, 1)]))).groupBy("chrom", "_bin").agg(
        F.min("_best").alias("_near"))
    return bins.join(around, ["chrom", "_bin"]).where(F.col("_best") == F.col("_near")).select(
        "_best.variant_id", "chrom", "_best.pos", "_best.p")


def clump(variants: DataFrame, window: int = 250_000, lead_p: float = 1.0) -> DataFrame:
    """Greedy clumping with fixed windows: assignment(variant_id, signal_id, chrom, pos, p, is_lead).

    A round picks variants that are best among the unclaimed ones within ``window``; the sequential greedy order would pick them
    too, whatever happens elsewhere. Each claims its window (a contested variant goes to the stronger lead). Only variants with
    p <= lead_p can lead; when no lead is left the rest stays unassigned.
    """
    todo = cut(variants.select("variant_id", "chrom", "pos", "p"))
    done = None
    while True:  # every round claims the best unclaimed variant, so the loop ends
        leads = _local_leads(todo, window).where(F.col("p") <= lead_p)
        claimed_by = leads.select(F.col("variant_id").alias("signal_id"), "chrom", F.col("pos").alias("start_pos"),
                                  F.col("pos").alias("end_pos"), F.col("p").alias("lead_p"))
        hits = overlap_join(todo, claimed_by, pad=window)
        best = hits.groupBy("variant_id").agg(
            F.min_by("signal_id", F.struct("lead_p", "start_pos", "signal_id")).alias("signal_id"))
        step = cut(todo.join(best, "variant_id", "left"))
        got = step.where("signal_id is not null")
        if got.isEmpty():
            break
        done = got if done is None else done.unionByName(got)
        todo = cut(step.where("signal_id is null").drop("signal_id"))
        if todo.isEmpty():
            break
    if done is None:
        done = todo.withColumn("signal_id", F.col("variant_id")).limit(0)
    return done.select("variant_id", "signal_id", "chrom", "pos", "p", (F.col("variant_id") == F.col("signal_id")).alias("is_lead"))


def reanchor(signals: DataFrame, low_p: float = 5e-8, rank: int = 100) -> float:
    """p-value that gets the low-p posterior: the ``rank``-th strongest signal when more than ``rank`` pass ``low_p``."""
    row = signals.where(F.col("p") < low_p).orderBy("p").limit(rank + 1).agg(
        F.count("*").alias("n"), F.max("p").alias("last")).first()
    if row["n"] <= rank:
        return low_p
    return float(signals.orderBy("p").limit(rank).agg(F.max("p")).first()[0])


def fine_map(assigned: DataFrame, group: str = "signal_id") -> DataFrame:
    """Posterior of each variant within its signal, proportional to exp(log_bf) and summing to 1.

    Signal maxima and sums are grouped aggregates joined back, so a large signal is not windowed in one task.
    """
    assigned = cut(assigned)
    top = assigned.groupBy(group).agg(F.max("log_bf").alias("_top"))
    e = assigned.join(top, group).withColumn("_e", F.exp(F.col("log_bf") - F.col("_top")))
    total = e.groupBy(group).agg(F.sum("_e").alias("_sum"))
    return e.join(total, group).withColumn("ppa", F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def link_prob(variants: DataFrame, intervals: DataFrame, links: DataFrame | None = None, exons: DataFrame | None = None,
              max_dist: int = 250_000, slope: float = LINK_SLOPE, intercept: float = LINK_INTERCEPT,
              cap: float = MAX_ENTITY_PROB) -> DataFrame:
    """link(variant_id, entity_id, prob): given link, else exon, else a logistic decay with distance.

    A variant with any given or exon link uses only those.
    """
    base = variants.select("variant_id", "chrom", "pos")
    spans = lambda df: df.select("entity_id", "chrom", "start_pos", "end_pos")
    direct = []
    if links is not None:
        given = base.join(links, ["chrom", "pos"]).select("variant_id", "entity_id", F.least("prob", F.lit(EXON_LINK)).alias("prob"))
        direct.append(given.groupBy("variant_id", "entity_id").agg(F.max("prob").alias("prob")))
        base = base.join(given.select("variant_id").distinct(), "variant_id", "left_anti")
    if exons is not None:
        direct.append(_best_pairs(base, spans(exons), lambda v, e: overlap_join(v, e).select("variant_id", "entity_id", F.lit(EXON_LINK).alias("prob"))))
        base = base.join(overlap_any(base, spans(exons)), "variant_id", "left_anti")
    far = _best_pairs(base, spans(intervals), lambda v, e: near_join(v, e, max_dist).select(
        "variant_id", "entity_id", decay_prob(slope, intercept, cap).alias("prob")))
    return reduce(DataFrame.unionByName, direct, far)


def decay_prob(slope: float = LINK_SLOPE, intercept: float = LINK_INTERCEPT, cap: float = MAX_ENTITY_PROB) -> Column:
    """Capped logistic link probability of a column ``dist``."""
    return F.least(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * F.col("dist") + F.lit(intercept)))), F.lit(cap))


def _single(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key occurs once, and the others."""
    many = df.groupBy(key).agg(F.count("*").alias("_c")).where("_c > 1").select(key)
    return df.join(many, key, "left_anti"), df.join(many, key, "left_semi")


def _best_pairs(variants: DataFrame, entities: DataFrame, pairs: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Largest prob of each (variant_id, entity_id) of ``pairs``; only those whose variant or entity has several rows are grouped, the rest are not shuffled."""
    v, v_more = _single(variants, "variant_id")
    e, e_more = _single(entities, "entity_id")
    repeated = pairs(v, e_more).unionByName(pairs(v_more, entities)).groupBy("variant_id", "entity_id").agg(F.max("prob").alias("prob"))
    return pairs(v, e).unionByName(repeated)


def overlap_any(variants: DataFrame, intervals: DataFrame) -> DataFrame:
    """Variants inside some interval."""
    return nearest_entities(variants, intervals, "variant_id", 1, 0).select("variant_id").distinct()


def read_links(links: DataFrame, seen: DataFrame, default_prob: float = 0.95, normalise_to: float | None = None) -> DataFrame:
    """Given links: default and cap 0.95, only seen positions, optionally rescaled so each position sums to a constant; one that sums to 0 stays."""
    out = links.withColumn("prob", F.least(F.coalesce("prob", F.lit(default_prob)), F.lit(EXON_LINK))).join(
        seen.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")
    if normalise_to is None:
        return out
    total = out.groupBy("chrom", "pos").agg(F.sum("prob").alias("_t"))
    scaled = F.when(F.col("_t") > 0, F.col("prob") * F.lit(normalise_to) / F.col("_t")).otherwise(F.col("prob"))
    return out.join(total, ["chrom", "pos"]).withColumn("prob", scaled).drop("_t")


def credible_sets(cs: DataFrame, variants: DataFrame, threshold_p: float) -> tuple[DataFrame, DataFrame]:
    """(credible set rows with default ids and clipped posteriors, variants extended by unseen positions)."""
    ppa = F.col("ppa").cast("double")
    rows = cs.withColumns({
        "cs_id": F.coalesce(F.col("cs_id").cast("string"), F.concat_ws(":", F.col("chrom"), F.col("pos").cast("string"))),
        "ppa": F.when(ppa > 1, F.lit(0.99)).when(ppa < 0, F.lit(0.0)).otherwise(ppa),
    })
    new = rows.select("chrom", "pos").distinct().join(variants.select("chrom", "pos"), ["chrom", "pos"], "left_anti")
    added = new.select(F.concat_ws(":", "chrom", F.col("pos").cast("string")).alias("variant_id"), "chrom", "pos",
                       F.lit(threshold_p).alias("p"), F.lit(1.0).alias("beta"), F.lit(None).cast("double").alias("se"))
    base = variants.select(F.col("variant_id").cast("string").alias("variant_id"), "chrom", "pos", "p", "beta", "se")
    return rows, base.unionByName(added)


def signal_entity_prob(fine: DataFrame, links: DataFrame, normalise: bool = True, cap: float = MAX_ENTITY_PROB) -> DataFrame:
    """Per (signal, entity): sum of variant posterior x link probability; optionally summing to 1 per signal, capped."""
    raw = fine.select("variant_id", "signal_id", "ppa").join(links, "variant_id").groupBy("signal_id", "entity_id").agg(
        F.sum(F.col("ppa") * F.col("prob")).alias("prob"))
    return _normalised(raw, normalise, cap)


def signal_entity_near(fine: DataFrame, intervals: DataFrame, max_dist: int = 250_000, slope: float = LINK_SLOPE, intercept: float = LINK_INTERCEPT,
                       normalise: bool = True, cap: float = MAX_ENTITY_PROB) -> DataFrame:
    """``signal_entity_prob`` of the links by distance of fine(variant_id, signal_id, chrom, pos, ppa), without listing links.

    A link depends on the two places only, so variants of a signal at one position are one row, and so are entities with one place. Pairs of
    places are summed in the task that forms them. Variants or entities with several rows take the way over their links.
    """
    fine = cut(fine.select("variant_id", "signal_id", "chrom", "pos", "ppa"))
    spans = intervals.select("entity_id", "chrom", "start_pos", "end_pos")
    (v, v_more), (e, e_more) = _single(fine, "variant_id"), _single(spans, "entity_id")
    cells = v.groupBy("signal_id", "chrom", "pos").agg(F.sum("ppa").alias("ppa"))
    places = e.groupBy("chrom", "start_pos", "end_pos").agg(F.min("entity_id").alias("entity_id"), F.collect_list("entity_id").alias("_all"))
    sums = near_join(cells, places.drop("_all"), max_dist).groupBy("signal_id", "entity_id").agg(
        F.sum(F.col("ppa") * decay_prob(slope, intercept)).alias("prob"))
    raw = sums.join(places.select("entity_id", "_all"), "entity_id").select("signal_id", F.explode("_all").alias("entity_id"), "prob")
    links = link_prob(v, e_more, max_dist=max_dist, slope=slope, intercept=intercept).unionByName(
        link_prob(v_more, spans, max_dist=max_dist, slope=slope, intercept=intercept))
    rest = fine.select("variant_id", "signal_id", "ppa").join(links, "variant_id").select("signal_id", "entity_id", (F.col("ppa") * F.col("prob")).alias("prob"))
    return _normalised(raw.unionByName(rest).groupBy("signal_id", "entity_id").agg(F.sum("prob").alias("prob")), normalise, cap)


def _normalised(raw: DataFrame, normalise: bool, cap: float) -> DataFrame:
    if normalise:
        raw = cut(raw)
        total = raw.groupBy("signal_id").agg(F.sum("prob").alias("_t"))
        raw = raw.join(total, "signal_id").withColumn("prob", F.coalesce(F.try_divide("prob", "_t"), F.lit(0.0))).drop("_t")
    return raw.withColumn("prob", F.least("prob", F.lit(cap)))


def signal_posterior(signal_entity: DataFrame, signals: DataFrame, prior: DataFrame | None = None,
                     background: float = BACKGROUND) -> DataFrame:
    """q(signal, entity): entities compete inside a signal by Bayes factor x probability of being the only causal one.

    signals carries ``posterior``, the probability that the signal is real. The product over the other entities cancels to
    prior odds, so the weight of an entity is bf x prior / (1 - prior).
    """
    j = signal_entity.withColumn("bf", F.col("prob") / (F.lit(1.0) - F.col("prob")) * F.lit((1 - background) / background))
    if prior is not None:
        j = j.join(prior.select("entity_id", F.col("prior_prob").alias("_pi")), "entity_id", "left")
    else:
        j = j.withColumn("_pi", F.lit(None).cast("double"))
    pi = F.least(F.coalesce("_pi", F.lit(background)), F.lit(1.0 - 1e-12))
    j = cut(j.withColumn("_w", F.col("bf") * pi / (F.lit(1.0) - pi)))
    total = j.groupBy("signal_id").agg(F.sum("_w").alias("_t"))
    return j.join(total, "signal_id").join(signals.select("signal_id", "posterior"), "signal_id").select(
        "signal_id", "entity_id", "bf", (F.coalesce(F.try_divide("_w", "_t"), F.lit(0.0)) * F.col("posterior")).alias("q"))


def combine_signals(signal_q: DataFrame, mode: str = "max") -> DataFrame:
    """Entity score over signals: the conservative maximum, or 1 - prod(1 - q)."""
    if mode == "max":
        score = F.max("q")
    else:
        certain = F.max(F.when(F.col("q") >= 1, 1).otherwise(0)) == 1
        rest = F.sum(F.when(F.col("q") < 1, F.log1p(-F.col("q"))))
        score = F.when(certain, F.lit(1.0)).otherwise(F.lit(1.0) - F.exp(F.coalesce(rest, F.lit(0.0))))
    return signal_q.groupBy("entity_id").agg(score.alias("score"), F.count("*").alias("n_signals"))


def entity_log_bf(scores: DataFrame, universe: DataFrame | None = None, other: DataFrame | None = None) -> DataFrame:
    """Log Bayes factor of the entity score, plus another source's where given; entities without signals get 0."""
    capped = F.least("score", F.lit(0.99))
    out = scores.select("entity_id", F.coalesce(to_log_bf(capped), F.lit(0.0)).alias("_a"))
    if universe is not None:
        out = universe.select("entity_id").distinct().join(out, "entity_id", "left")
    out = out.withColumn("_a", F.coalesce("_a", F.lit(0.0)))
    if other is None:
        return out.select("entity_id", F.col("_a").alias("log_bf"))
    b = other.select("entity_id", F.col("log_bf").alias("_b"))
    return out.join(b, "entity_id", "full_outer").select(
        "entity_id", (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).alias("log_bf"))


def fit_decay(pairs: DataFrame, nearest_share: float = 0.7, width: int = 5_000) -> tuple[float, float]:
    """(slope, intercept) of the logistic decay, from the distance of each variant to its nearest entity.

    The nearest entity is right with probability ``nearest_share``, so every row contributes a success with that weight and a
    failure at the distance of the second nearest. Distances collapse into ``width``-sized bins; Newton runs on those sums.
    pairs(variant_id, entity_id, dist): all of them, or the two nearest of each variant.
    """
    w = Window.partitionBy("variant_id").orderBy("dist", "entity_id")
    two = pairs.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    success = F.when(F.col("_r") == 1, F.lit(nearest_share)).otherwise(F.lit(1 - nearest_share))
    bins = two.groupBy(F.floor(F.col("dist") / width).alias("bin")).agg(F.sum(success).alias("k"), F.count("*").alias("n"))
    bins = cut(bins.select(((F.col("bin") + 0.5) * width).alias("x"), "k", "n"))
    a, b = 0.0, 0.0
    while True:  # Newton steps on a concave likelihood
        x = F.col("x") / 100_000.0
        fit = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) + F.lit(b) * x)))
        v = F.col("n") * fit * (F.lit(1.0) - fit)
        g = F.col("k") - F.col("n") * fit
        s = bins.agg(F.sum(g).alias("g0"), F.sum(g * x).alias("g1"), F.sum(v).alias("h00"), F.sum(v * x).alias("h01"),
                     F.sum(v * x * x).alias("h11")).first()
        det = s["h00"] * s["h11"] - s["h01"] ** 2
        if not det:
            break
        da = (s["h11"] * s["g0"] - s["h01"] * s["g1"]) / det
        db = (s["h00"] * s["g1"] - s["h01"] * s["g0"]) / det
        a, b = a + da, b + db
        if not abs(da) + abs(db) >= 1e-9:
            break
    return b / 100_000.0, a


def locus_evidence(variants: DataFrame, intervals: DataFrame, cal: Calibration | None = None, window: int = 250_000,
                   lead_p: float = 1e-5, prior: DataFrame | None = None, mode: str = "max",
                   universe: DataFrame | None = None) -> DataFrame:
    """Whole locus run: score, clump, fine-map, link, compete, combine, convert."""
    cal = cal or calibrate_bf()
    scored = cut(variant_qc(score_variants(variants, cal)))
    assigned = clump(scored, window, lead_p)
    leads = assigned.where("is_lead").select("signal_id", F.col("signal_id").alias("variant_id"))
    signals = leads.join(scored.select("variant_id", "posterior"), "variant_id").select("signal_id", "posterior")
    fine = fine_map(assigned.select("variant_id", "signal_id").join(scored.select("variant_id", "chrom", "pos", "log_bf"), "variant_id"))
    q = signal_posterior(signal_entity_near(fine, intervals, window), signals, prior)
    return entity_log_bf(combine_signals(q, mode), universe)
