"""Special functions as Column expressions, so that they stay in whole-stage codegen.

Spark has no ``erf``, normal quantile or ``lgamma``. Each is spelled here with ``exp``, ``ln``
and a nested polynomial; nothing leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["erfc", "normal_cdf", "p_from_z", "one_sided_p", "z_from_p", "pin", "with_p", "with_abs_z", "lgamma", "hypergeom_sf"]

# Chebyshev fit of erfc (relative error < 1.2e-7 everywhere), constant term first.
ERFC_CHEBYSHEV = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)

# Rational approximation of the normal quantile (relative error < 1.2e-9).
QUANTILE_CENTRE_NUM = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
QUANTILE_CENTRE_DEN = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
QUANTILE_TAIL_NUM = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
QUANTILE_TAIL_DEN = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)
QUANTILE_SPLIT = 0.02425

# Lanczos coefficients (g = 7, nine terms).
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012,
    9.9843695780195716e-06, 1.5056327351493116e-07,
)


def _horner(x: Column, coefs) -> Column:
    """Polynomial with the highest power first."""
    acc = F.lit(float(coefs[0]))
    for c in coefs[1:]:
        acc = acc * x + F.lit(float(c))
    return acc


def erfc(x: Column) -> Column:
    """Complementary error function, accurate in relative terms in the far tail."""
    a = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + a * F.lit(0.5))
    tail = t * F.exp(-a * a + _horner(t, ERFC_CHEBYSHEV[::-1]))
    return F.when(x >= 0, tail).otherwise(F.lit(2.0) - tail)


def normal_cdf(z: Column) -> Column:
    return erfc(-z / F.lit(math.sqrt(2.0))) * F.lit(0.5)


def p_from_z(z: Column) -> Column:
    """Two-sided normal p-value."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def one_sided_p(z: Column, p: Column) -> Column:
    """Upper-tail p from a z-score and its two-sided p."""
    return F.when(z >= 0, p * 0.5).otherwise(F.lit(1.0) - p * 0.5)


def z_from_p(p: Column) -> Column:
    """abs(z) for a two-sided p in (0, 1]; p <= 0 is read as 1e-300."""
    half = F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300)) * F.lit(0.5)
    r = F.sqrt(F.lit(-2.0) * F.log(half))
    tail = -(_horner(r, QUANTILE_TAIL_NUM) / _horner(r, QUANTILE_TAIL_DEN))
    q = half - F.lit(0.5)
    s = q * q
    centre = -(_horner(s, QUANTILE_CENTRE_NUM) * q / _horner(s, QUANTILE_CENTRE_DEN))
    return F.when(half < QUANTILE_SPLIT, tail).otherwise(centre) + F.lit(0.0)


def pin(df: DataFrame, cols: list[str]) -> DataFrame:
    """Compute ``cols`` here and once.

    A filter on a derived column is pushed below its projection by copying the expression into every place; nested special
    functions would be copied exponentially often. A one-element ``explode`` keeps them where they are, without a shuffle.
    """
    others = [c for c in df.columns if c not in cols]
    one = F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in cols]))).alias("_pin")
    return df.select(*[F.col(f"`{c}`") for c in others], one).select(*[F.col(f"`{c}`") for c in others], "_pin.*")


def with_p(df: DataFrame, z: str = "z", out: str = "p") -> DataFrame:
    """Add the two-sided p of a z column. The inner term is a column of its own, which keeps the generated code short."""
    a = F.abs(F.col(z)) * F.lit(0.5 / math.sqrt(2.0))
    df = df.withColumn("_erfc_t", F.lit(1.0) / (F.lit(1.0) + a))
    t = F.col("_erfc_t")
    df = df.withColumn(out, t * F.exp(F.col(z) * F.col(z) * F.lit(-0.5) + _horner(t, ERFC_CHEBYSHEV[::-1]))).drop("_erfc_t")
    return pin(df, [z, out])


def with_abs_z(df: DataFrame, p: str = "p", out: str = "abs_z") -> DataFrame:
    """Add abs(z) of a two-sided p column, with the inner terms as columns of their own."""
    df = df.withColumn("_zp_half", F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(1e-300)) * F.lit(0.5))
    q = F.col("_zp_half") - F.lit(0.5)
    df = df.withColumns({"_zp_r": F.sqrt(F.lit(-2.0) * F.log("_zp_half")), "_zp_q": q, "_zp_s": q * q})
    r, s = F.col("_zp_r"), F.col("_zp_s")
    tail = -(_horner(r, QUANTILE_TAIL_NUM) / _horner(r, QUANTILE_TAIL_DEN))
    centre = -(_horner(s, QUANTILE_CENTRE_NUM) * F.col("_zp_q") / _horner(s, QUANTILE_CENTRE_DEN))
    df = df.withColumn(out, F.when(F.col("_zp_half") < QUANTILE_SPLIT, tail).otherwise(centre) + F.lit(0.0))
    return pin(df.drop("_zp_half", "_zp_r", "_zp_q", "_zp_s"), [p, out])


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 0.5 (Lanczos series)."""
    y = x - F.lit(1.0)
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (y + F.lit(float(i)))
    t = y + F.lit(LANCZOS_G + 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + F.lit(0.5)) * F.log(t) - t + F.log(series)


def _ln_choose(n: Column, k: Column) -> Column:
    return lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)


def hypergeom_sf(k: Column, population: Column, successes: Column, draws: Column) -> Column:
    """P(X >= k) for a hypergeometric X.

    The first term comes from ``lgamma``; the others follow by the ratio of neighbouring terms inside
    one ``aggregate`` over k .. min(successes, draws), so no row is exploded and nothing is shuffled.
    """
    kd, m = k.cast("double"), population.cast("double")
    n, d = successes.cast("double"), draws.cast("double")
    first = F.exp(_ln_choose(n, kd) + _ln_choose(m - n, d - kd) - _ln_choose(m, d))
    top = F.least(successes, draws).cast("long")
    steps = F.when(
        k.cast("long") < top, F.sequence(k.cast("long"), top - F.lit(1).cast("long"))
    ).otherwise(F.array().cast("array<bigint>"))

    def step(acc, x):
        xd = x.cast("double")
        ratio = (n - xd) * (d - xd) / ((xd + 1.0) * (m - n - d + xd + 1.0))
        term = acc["term"] * ratio
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    total = F.aggregate(steps, start, step, lambda acc: acc["total"])
    return F.when(k <= 0, F.lit(1.0)).when(k.cast("long") > top, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), first * total)
    )
