"""Chain diagnostics over draws(chain, iteration, param, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chain_means(draws: DataFrame) -> DataFrame:
    return draws.groupBy("param", "chain").agg(
        F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.count("*").alias("n"))


def rhat(draws: DataFrame) -> DataFrame:
    """Gelman-Rubin R per parameter, from chain means and variances (chains of equal weight, mean length)."""
    s = chain_means(draws).groupBy("param").agg(
        F.var_samp("mean").alias("_between"), F.avg("var").alias("_within"), F.avg("n").alias("_n"))
    v = (F.col("_n") - 1) / F.col("_n") * F.col("_within") + F.col("_between")
    return s.select("param", F.when(F.col("_within") > 0, F.sqrt(v / F.col("_within"))).otherwise(F.lit(1.0)).alias("rhat"))


def mcse(draws: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Monte Carlo error of the overall mean from the spread of chain means: absolute and relative."""
    s = chain_means(draws).groupBy("param").agg(
        F.avg("mean").alias("mean"), F.sqrt(F.var_samp("mean") / F.count("*")).alias("mcse"))
    return s.withColumn("rel_mcse", F.col("mcse") / F.greatest(F.abs("mean"), F.lit(floor)))


def mcse_quantile(draws: DataFrame, top: int | None = None, q: float = 0.95, floor: float = 1e-6) -> DataFrame:
    """Quantile of the errors over all parameters, or over the ``top`` ones of largest absolute mean (a distributed top-n)."""
    active = mcse(draws, floor)
    if top is not None:
        active = active.orderBy(F.abs("mean").desc(), "param").limit(top)
    return active.agg(F.percentile("rel_mcse", q).alias("rel_mcse_q"), F.percentile("mcse", q).alias("mcse_q"),
                      F.count("*").alias("n_active"))


def robust_chain_mean(draws: DataFrame, mad_limit: float = 10.0) -> DataFrame:
    """Mean over chains after dropping chains farther than ``mad_limit`` median absolute deviations from the median."""
    m = chain_means(draws).select("param", "chain", "mean")
    centre = m.groupBy("param").agg(F.median("mean").alias("_med"))
    dev = m.join(centre, "param").withColumn("_dev", F.abs(F.col("mean") - F.col("_med")))
    mad = dev.groupBy("param").agg(F.median("_dev").alias("_mad"))
    ok = dev.join(mad, "param").withColumn("_ok", F.col("_dev") <= F.col("_mad") * mad_limit)
    return ok.groupBy("param").agg(
        F.avg(F.when(F.col("_ok"), F.col("mean"))).alias("robust_mean"),
        F.count(F.when(F.col("_ok"), 1)).alias("n_chains"), F.count(F.when(~F.col("_ok"), 1)).alias("n_outliers"))


def summarize_draws(draws: DataFrame, eps: float = 0.01) -> DataFrame:
    """Posterior mean, sd-based 95 % interval and P(value > eps)."""
    s = draws.groupBy("param").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.avg(F.when(F.col("value") > eps, 1.0).otherwise(0.0)).alias("p_active"), F.count("*").alias("n"))
    return s.withColumns({"lower": F.col("mean") - F.col("sd") * 1.96, "upper": F.col("mean") + F.col("sd") * 1.96})
