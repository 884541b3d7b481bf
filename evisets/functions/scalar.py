"""Scalar statistics over columns: Bayes factors, probabilities, shrinkage, loading views."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisets.functions.special import with_abs_z, with_p, z_from_p

__all__ = [
    "BACKGROUND", "background_log_odds", "to_prob", "to_log_bf", "wakefield_log_bf", "posterior",
    "Calibration", "calibrate_bf", "variant_thresholds", "complete_p_beta_se", "variant_z", "with_variant_z",
    "scaled_sigma2", "SigmoidThreshold", "sigma_threshold", "clean_chrom", "sanitize",
    "spike_slab", "sigma2_from_target",
]

BACKGROUND = 0.05


def background_log_odds(background: float = BACKGROUND) -> float:
    return math.log(background / (1 - background))


def to_prob(log_bf: Column, background: float = BACKGROUND) -> Column:
    """Posterior probability of a log Bayes factor on top of the background odds."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(log_bf + F.lit(background_log_odds(background)))))


def to_log_bf(prob: Column, background: float = BACKGROUND) -> Column:
    """Log Bayes factor of a probability; null outside (0, 1)."""
    ok = (prob > 0) & (prob < 1)
    return F.when(ok, F.log(prob / (F.lit(1.0) - prob)) - F.lit(background_log_odds(background)))


def wakefield_log_bf(z: Column, k: float) -> Column:
    """Approximate log Bayes factor of a z-score under relative prior variance ``k``."""
    return F.lit(-0.5 * math.log1p(k)) + z * z * F.lit(0.5 * k / (1 + k))


def posterior(log_bf: Column, prior_odds: float, saturate_at: float = 15.0) -> Column:
    """Posterior probability of a log Bayes factor; log odds of 15 or more count as certain."""
    x = log_bf + F.lit(math.log(prior_odds))
    return F.when(x >= saturate_at, F.lit(1.0)).otherwise(F.exp(x) / (F.lit(1.0) + F.exp(x)))


@dataclass(frozen=True)
class Calibration:
    k: float
    prior_odds: float


def _abs_z(p: float) -> float:
    """abs(z) of a two-sided p as a Python number (statistics has the exact inverse)."""
    from statistics import NormalDist

    return abs(NormalDist().inv_cdf(p / 2))


def calibrate_bf(low_p=5e-8, low_posterior=0.75, high_p=0.01, high_posterior=0.01) -> Calibration:
    """Solve prior variance and prior odds so that two p-values get two posteriors."""
    z1, z2 = _abs_z(low_p), _abs_z(high_p)
    l1 = math.log(low_posterior / (1 - low_posterior))
    l2 = math.log(high_posterior / (1 - high_posterior))
    ratio = 2 * (l1 - l2) / (z1 * z1 - z2 * z2)
    if not 0 < ratio < 1:
        raise ValueError("the two anchors admit no positive prior variance")
    k = ratio / (1 - ratio)
    return Calibration(k, math.exp(l1 + 0.5 * math.log1p(k) - 0.5 * z1 * z1 * ratio))


def variant_thresholds(min_posterior: float, cal: Calibration, high_posterior: float = 0.01):
    """(z, p) cut-offs equivalent to a minimum posterior; (None, None) when nothing is cut."""
    from statistics import NormalDist

    if min_posterior is None or min_posterior <= high_posterior:
        return _abs_z(high_posterior), high_posterior
    need = math.log(min_posterior / (1 - min_posterior)) - math.log(cal.prior_odds) + 0.5 * math.log1p(cal.k)
    if need <= 0:
        return None, None
    z = math.sqrt(2 * (1 + cal.k) * need / cal.k)
    return z, 2 * NormalDist().cdf(-z)


def complete_p_beta_se(df: DataFrame, p="p", beta="beta", se="se") -> DataFrame:
    """Fill whichever of p, beta, se is missing from the other two."""
    P, B, S = (F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in (p, beta, se))
    zero_se = S.isNotNull() & (S == 0)
    b0 = F.when(zero_se & B.isNotNull() & (B != 0), F.lit(0.0)).otherwise(B)
    s0 = F.when(zero_se, F.lit(1.0)).otherwise(S)
    none = P.isNull() & B.isNull() & S.isNull()
    df = df.withColumns({
        "_p": F.when(none, F.lit(1.0)).otherwise(P),
        "_b": F.when(none, F.lit(0.0)).otherwise(b0),
        "_s": F.when(none, F.lit(1.0)).otherwise(s0),
    })
    df = with_p(df.withColumn("_zb", F.col("_b") / F.col("_s")), "_zb", "_pz")
    df = df.withColumn("_p", F.coalesce("_p", "_pz"))
    df = with_abs_z(df, "_p", "_z")
    df = df.withColumn("_b", F.coalesce("_b", F.col("_z") * F.col("_s")))
    divisor = F.when(F.col("_z") == 0, F.lit(1.0)).otherwise(F.col("_z"))
    df = df.withColumn("_s", F.coalesce("_s", F.abs(F.col("_b") / divisor)))
    return df.withColumns({p: F.col("_p"), beta: F.col("_b"), se: F.col("_s")}).drop("_p", "_b", "_s", "_z", "_zb", "_pz")


def variant_z(p: Column, beta: Column, se: Column) -> Column:
    """Signed z that trusts p where present, else beta / se."""
    sign = F.when(beta < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(p.isNotNull(), z_from_p(p) * sign).otherwise(beta / se)


def with_variant_z(df: DataFrame, out: str = "z") -> DataFrame:
    """Signed z of rows with p, beta, se columns; trusts p where present."""
    df = with_abs_z(df, "p", "_az")
    sign = F.when(F.col("beta") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return df.withColumn(out, F.when(F.col("p").isNotNull(), F.col("_az") * sign).otherwise(F.col("beta") / F.col("se"))).drop("_az")


@dataclass(frozen=True)
class SigmoidThreshold:
    k: float
    x0: float


def sigma_threshold(size_95: float, size_5: float, n_entities: int) -> SigmoidThreshold:
    """Sigmoid in the set scale that keeps 95 % of the variance at one size and 5 % at another."""
    def scale(size):
        frac = size / n_entities
        return math.sqrt(frac * (1 - frac))

    a, b = scale(size_95), scale(size_5)
    la, lb = math.log(1 / 0.95 - 1), math.log(1 / 0.05 - 1)
    return SigmoidThreshold(-(lb - la) / (b - a), (a * lb - b * la) / (lb - la))


def scaled_sigma2(scale: Column, sigma2: Column, power: float, threshold: SigmoidThreshold | None = None) -> Column:
    """Slab variance of one set: sigma2 * scale^power, damped by an optional sigmoid; 0 at scale 0."""
    value = sigma2 * F.pow(scale, F.lit(float(power)))
    if threshold is not None:
        value = value / (F.lit(1.0) + F.exp(-(scale - F.lit(threshold.x0)) * F.lit(threshold.k)))
    return F.when(scale == 0, F.lit(0.0)).otherwise(value)


def clean_chrom(chrom: Column) -> Column:
    return F.regexp_replace(chrom.cast("string"), "^chr", "")


def sanitize(value: Column) -> Column:
    """NaN -> 0, +inf -> 1, -inf -> 0."""
    inf = float("inf")
    return F.when(F.isnan(value) | (value == F.lit(-inf)), F.lit(0.0)).when(
        value == F.lit(inf), F.lit(1.0)
    ).otherwise(value)


def spike_slab(beta: Column, se: Column, p: Column, sigma2: Column) -> tuple[Column, Column, Column]:
    """(posterior mean, inclusion probability, conditional slab mean) of one effect.

    ``sigma2`` is the total variance; the slab has variance sigma2 / p. The two densities are compared
    in log space so that a huge z cannot underflow both.
    """
    slab = sigma2 / p
    total = slab + se * se
    log_odds = (
        F.log(p / F.sqrt(total)) - F.log((F.lit(1.0) - p) / se)
        - beta * beta * 0.5 / total + beta * beta * 0.5 / (se * se)
    )
    post = F.when(p >= 1, F.lit(1.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds)))
    cond = slab / total * beta
    return cond * post, post, cond


def sigma2_from_target(prior: float, n_sets: int, p: float, frac: float = 1.0, scale: float = 1.0,
                       background: float = BACKGROUND) -> float:
    """Total slab variance such that the strongest ``frac`` of ``n_sets`` reaches ``prior``.

    The needed effect is the log Bayes factor of ``prior``; it is placed at the quantile of the slab that
    one of ``n_sets`` draws exceeds. The internal unit is effect times scale.
    """
    from statistics import NormalDist

    effect = (math.log(prior / (1 - prior)) - background_log_odds(background)) * scale
    tail = min(max(frac / n_sets, 1e-12), 0.999)
    z = abs(NormalDist().inv_cdf(tail / 2))
    return p * (effect / z) ** 2


def sigma2_for_target(prior: float, n_sets: Column, p: Column, frac: float = 1.0, scale: Column | None = None,
                      background: float = BACKGROUND) -> Column:
    """``sigma2_from_target`` by row: every trait with its own number of sets, slab share and scale; null without sets."""
    effect = F.lit(math.log(prior / (1 - prior)) - background_log_odds(background))
    tail = F.greatest(F.least(F.lit(float(frac)) / F.nullif(n_sets.cast("double"), F.lit(0.0)), F.lit(0.999)), F.lit(1e-12))
    needed = effect if scale is None else effect * scale
    return F.when(n_sets > 0, p * F.pow(needed / z_from_p(tail), F.lit(2.0)))
