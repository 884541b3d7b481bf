"""Multiple regression from grouped sums.

One pass over the rows gives the sums of products; the small solve happens per group on k x k numbers (``mapInPandas`` over
already aggregated rows, or the driver for a single design). Rows never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisets.functions.special import one_sided_p, with_p
from evisets.plans.iterate import held


def _cross_names(cols: list[str]) -> list[tuple[int, int, str]]:
    return [(i, j, f"s_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]


def normal_sums(df: DataFrame, x: list[str], y: list[str], groups: list[str] | None = None) -> DataFrame:
    """Sums of x'x, x'y, y'y and the row count, per group."""
    groups = groups or []
    aggs = [F.sum(F.col(x[i]) * F.col(x[j])).alias(name) for i, j, name in _cross_names(x)]
    for t, c in enumerate(y):
        aggs += [F.sum(F.col(xi) * F.col(c)).alias(f"xy_{t}_{i}") for i, xi in enumerate(x)]
        aggs.append(F.sum(F.col(c) * F.col(c)).alias(f"yy_{t}"))
    return df.groupBy(*groups).agg(F.count("*").alias("n_rows"), *aggs)


def solve_ols(sums: DataFrame, x: list[str], y: list[str], groups: list[str] | None = None) -> DataFrame:
    """Classical OLS per group from ``normal_sums``: one row per (group, outcome, regressor)."""
    groups = groups or []
    k, cross = len(x), _cross_names(x)
    types = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    schema = ", ".join([f"{g} {types[g]}" for g in groups]
                       + ["outcome string", "term string", "beta double", "se double", "n_rows long"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = np.zeros((len(pdf), k, k))
            for i, j, name in cross:
                m[:, i, j] = m[:, j, i] = pdf[name].to_numpy(float)
            inv = np.linalg.pinv(m, hermitian=True)
            for t, c in enumerate(y):
                xy = np.stack([pdf[f"xy_{t}_{i}"].to_numpy(float) for i in range(k)], axis=1)
                beta = np.einsum("gij,gj->gi", inv, xy)
                sse = pdf[f"yy_{t}"].to_numpy(float) - np.einsum("gi,gi->g", beta, xy)
                dof = np.maximum(pdf["n_rows"].to_numpy() - k, 1)
                sigma2 = np.maximum(sse, 0) / dof
                for i, name in enumerate(x):
                    out = pdf[groups].copy() if groups else pd.DataFrame(index=pdf.index)
                    out["outcome"], out["term"] = c, name
                    out["beta"] = beta[:, i]
                    out["se"] = np.sqrt(np.maximum(sigma2 * inv[:, i, i], 0))
                    out["n_rows"] = pdf["n_rows"].to_numpy()
                    yield out

    return sums.mapInPandas(solve, schema)


def with_tests(df: DataFrame) -> DataFrame:
    """z, two-sided and one-sided p of (beta, se)."""
    z = F.when(F.col("se") > 0, F.col("beta") / F.col("se")).otherwise(F.lit(0.0))
    out = with_p(df.withColumn("z", z))
    return out.withColumn("p_onesided", one_sided_p(F.col("z"), F.col("p")))


def multi_ols(df: DataFrame, x: list[str], y: list[str], groups: list[str] | None = None) -> DataFrame:
    """Multiple regression with intercept and classical errors, per group."""
    full = df.withColumn("intercept", F.lit(1.0))
    cols = [*x, "intercept"]
    return with_tests(solve_ols(normal_sums(full, cols, y, groups), cols, y, groups))


def fetch_inverse(sums: DataFrame, k: int) -> np.ndarray:
    """Inverse of x'x for a single design; k x k numbers travel to the driver."""
    row = sums.first()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = float(row[f"s_{i}_{j}"] or 0.0)
    return np.linalg.pinv(m, hermitian=True)


def linear_column(coefs, cols: list[str]) -> Column:
    return sum((F.lit(float(b)) * F.col(c) for b, c in zip(coefs, cols)), F.lit(0.0))


def ols_hc3(df: DataFrame, x: list[str], y: str, robust: bool = True) -> DataFrame:
    """OLS with intercept for one design; HC3 (leverage-corrected) or classical errors.

    Pass one gives x'x and x'y. Pass two, for HC3, sums (A_j x)^2 e^2 / (1 - h)^2 for each coefficient j, where A is the inverse
    and h the leverage: k sums instead of a k x k matrix.
    """
    full = df.withColumn("intercept", F.lit(1.0))
    cols = [*x, "intercept"]
    k = len(cols)
    sums = normal_sums(full, cols, [y])
    inv = fetch_inverse(sums, k)
    if not robust:
        return with_tests(solve_ols(sums, cols, [y]))
    row = sums.first()
    beta = inv @ np.array([float(row[f"xy_0_{i}"]) for i in range(k)])
    h = sum((linear_column(inv[i], cols) * F.col(cols[i]) for i in range(k)), F.lit(0.0))
    resid = F.col(y) - linear_column(beta, cols)
    scaled = (resid / F.greatest(F.lit(1.0) - h, F.lit(1e-8)))
    meat = full.agg(*[F.sum(F.pow(linear_column(inv[j], cols) * scaled, F.lit(2.0))).alias(f"v_{j}") for j in range(k)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(y).alias("outcome"), F.lit(cols[j]).alias("term"), F.lit(float(beta[j])).alias("beta"),
                 F.sqrt(F.col(f"v_{j}")).alias("se"), F.lit(int(row["n_rows"])).alias("n_rows")) for j in range(k)
    ]))
    return with_tests(meat.select(rows.alias("_r")).select("_r.*"))


def huber_reg(df: DataFrame, x: list[str], y: str, delta: float = 1.0, max_rounds: int | None = None,
              tol: float = 1e-6) -> DataFrame:
    """Huber regression of one design: ``grouped.huber_groups`` with a single group."""
    from evisets.operators.grouped import huber_groups

    return huber_groups(df.withColumn("_all", F.lit(0)), x, y, ["_all"], delta, tol, max_rounds).drop("_all")


def prune_covariates(df: DataFrame, cols: list[str], max_corr: float = 0.95) -> list[str]:
    """Covariates left after dropping constant ones and, repeatedly, one of the most correlated pair (the later)."""
    k = len(cols)
    row = df.agg(
        *[F.var_pop(c).alias(f"v_{i}") for i, c in enumerate(cols)],
        *[F.covar_pop(cols[i], cols[j]).alias(f"c_{i}_{j}") for i in range(k) for j in range(i + 1, k)],
    ).first()
    keep = [i for i in range(k) if row[f"v_{i}"] is not None and row[f"v_{i}"] > 1e-8]
    while True:
        pairs = [(abs(row[f"c_{i}_{j}"]) / (row[f"v_{i}"] * row[f"v_{j}"]) ** 0.5, -j) for n, i in enumerate(keep) for j in keep[n + 1:]]
        if not pairs or max(pairs)[0] < max_corr:
            return [cols[i] for i in keep]
        keep.remove(-max(pairs)[1])


def correct_by_covariates(evidence: DataFrame, covariates: DataFrame, cols: list[str], value: str = "log_bf",
                          max_increase: float = 1.0) -> DataFrame:
    """Remove the linear part of entity covariates from the evidence.

    Rows beyond 5 sd in any covariate or in the evidence do not enter the fit; the intercept stays; a row that would grow by
    more than ``max_increase`` is left alone.
    """
    joined = evidence.join(covariates.select("entity_id", *cols), "entity_id")
    kept = prune_covariates(joined, cols)
    if not kept:
        return joined.withColumn("corrected", F.col(value))
    stat = joined.agg(F.struct(
        *[(F.avg(c) + 5 * F.stddev_pop(c)).alias(c) for c in [*kept, value]],
    )).scalar()
    marked = joined.withColumn("_lim", stat)
    cov_ok = F.lit(True)
    for c in kept:
        cov_ok = cov_ok & (F.col(c) < F.col("_lim")[c])
    y_ok = F.col(value) < F.col("_lim")[value]
    full = marked.withColumns({"intercept": F.lit(1.0), "_cov_ok": cov_ok, "_y_ok": y_ok})
    design = [*kept, "intercept"]
    k = len(design)
    w = F.when(F.col("_cov_ok"), F.lit(1.0)).otherwise(F.lit(0.0))
    both = F.when(F.col("_cov_ok") & F.col("_y_ok"), F.lit(1.0)).otherwise(F.lit(0.0))
    sums = full.agg(
        *[F.sum(w * F.col(design[i]) * F.col(design[j])).alias(n) for i, j, n in _cross_names(design)],
        *[F.sum(both * F.col(c) * F.col(value)).alias(f"xy_{i}") for i, c in enumerate(design)],
    )
    row = sums.first()
    inv = fetch_inverse(sums, k)
    beta = inv @ np.array([float(row[f"xy_{i}"] or 0.0) for i in range(k)])
    fitted = linear_column(beta[:-1], kept)
    corrected = F.col(value) - fitted
    return full.withColumn(
        "corrected", F.when(corrected - F.col(value) > max_increase, F.col(value)).otherwise(corrected)
    ).drop("_lim", "intercept", "_cov_ok", "_y_ok")


def correct_set_stats(stats: DataFrame, qc: DataFrame, cols: list[str], directions: dict[str, int] | None = None,
                      correct_var: bool = True, same_rows: bool = True) -> DataFrame:
    """Explain abs(z) of the sets by their quality metrics and widen errors where abs(z) shrinks.

    Metrics enter when their marginal p is below 0.05 and their slope does not oppose ``directions``. ``same_rows=False`` keeps
    the published estimate, whose normal matrix also holds the outlier rows.
    """
    from statistics import NormalDist

    directions = directions or {}
    z = F.when(F.col("se") != 0, F.abs(F.col("beta_tilde")) / F.col("se")).otherwise(F.lit(0.0))
    joined = held(stats.join(qc.select("set_id", *cols), "set_id").withColumn("_z", z))  # read for limits, choice, both fits and the result
    lim = joined.agg(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in [*cols, "_z"]], *[F.stddev_pop(c).alias(f"s_{c}") for c in [*cols, "_z"]]
    )).scalar()
    joined = joined.withColumn("_l", lim)
    ok = F.col("se") != 0
    for c in [*cols, "_z"]:
        ok = ok & (F.abs(F.col(c) - F.col("_l")[f"m_{c}"]) <= 5 * F.col("_l")[f"s_{c}"])
    data = joined.withColumn("_ok", ok).withColumn("_z2", F.col("_z") * F.col("_z")).withColumn("intercept", F.lit(1.0)).drop("_l")
    fit_rows = data.where("_ok")
    m = fit_rows.agg(F.count("*").alias("n"), F.var_pop("_z").alias("vz"),
                     *[F.covar_pop(c, "_z").alias(f"c_{i}") for i, c in enumerate(cols)],
                     *[F.var_pop(c).alias(f"v_{i}") for i, c in enumerate(cols)]).first()
    use = []
    for i, c in enumerate(cols):
        if not m[f"v_{i}"] or m["n"] < 2:
            continue
        beta = m[f"c_{i}"] / m[f"v_{i}"] ** 0.5
        se = (m["vz"] / (m["n"] - 1)) ** 0.5
        p = 2 * NormalDist().cdf(-abs(beta / se)) if se > 0 else 1.0
        if p < 0.05 and beta * directions.get(c, 0) >= 0:
            use.append(c)
    design = [*use, "intercept"]
    k = len(design)
    mat_rows = fit_rows if same_rows else data
    inv = fetch_inverse(normal_sums(mat_rows, design, []), k)
    r = fit_rows.agg(*[F.sum(F.col(c) * F.col(t)).alias(f"{t}_{i}") for t in ("_z", "_z2") for i, c in enumerate(design)]).first()
    b1 = inv @ np.array([float(r[f"_z_{i}"]) for i in range(k)])
    b2 = inv @ np.array([float(r[f"_z2_{i}"]) for i in range(k)])
    desired = data.agg(F.var_pop("_z")).scalar()
    mean, second = linear_column(b1, design), linear_column(b2, design)
    var = second - mean * mean
    out = data.withColumns({"_pv": var, "_dv": desired, "_adj": F.col("_z") - mean + F.lit(float(b1[-1]))})
    if correct_var:
        high = (F.col("_pv") > F.col("_dv")) & (F.col("_pv") > 0)
        out = out.withColumn("_adj", F.when(high, F.col("_adj") * F.col("_dv") / F.col("_pv")).otherwise(F.col("_adj")))
    inflate = (F.abs("_adj") < F.abs("_z")) & (F.col("beta_tilde") != 0)
    floor = F.greatest(F.abs("_adj"), F.lit(1e-300))  # an adjusted z of exactly 0 means an unbounded error
    out = out.withColumn("se", F.when(inflate, F.abs("beta_tilde") / floor).otherwise(F.col("se")))
    zc = F.when(F.col("se") != 0, F.col("beta_tilde") / F.col("se")).otherwise(F.lit(0.0))
    out = with_p(out.withColumn("z", zc))
    return out.drop("_z", "_z2", "_ok", "intercept", "_pv", "_dv", "_adj")
