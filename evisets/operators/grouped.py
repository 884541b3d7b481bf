"""Regressions of many groups (traits) in one set of jobs: classical, correlated residuals, and Huber's robust fit.

rows(groups..., [entity_id], x..., y). A group's design may have any number of rows; what leaves a task are its sums of products, and k x k systems
are solved row by row over aggregated groups. Groups that converge leave the next round.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisets.operators.regress import _cross_names, normal_sums, with_tests
from evisets.plans.iterate import broadcast_if_small, grid, heavy_keys, held, split_join

SHORT = 1_000_000  # open groups whose coefficients are broadcast


def _design(df: DataFrame, x: list[str], y: str, groups: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    full = [F.col(c).cast("double").alias(c) for c in x]
    return df.select(*groups, *extra, *full, F.lit(1.0).alias("intercept"), F.col(y).cast("double").alias(y))


def _kinds(df: DataFrame, groups: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{g} {types[g]}" for g in groups)


def _matrices(pdf: pd.DataFrame, k: int, prefix: str = "s") -> np.ndarray:
    m = np.zeros((len(pdf), k, k))
    for i in range(k):
        for j in range(i, k):
            m[:, i, j] = m[:, j, i] = pdf[f"{prefix}_{i}_{j}"].to_numpy(float)
    return m


def _inverse(m: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of each matrix; one that isn't finite becomes nan and does not stop the others."""
    ok = np.isfinite(m).all((1, 2))
    out = np.full(m.shape, np.nan)
    if ok.any():
        out[ok] = np.linalg.pinv(m[ok], hermitian=True)
    return out


def correlated_sums(rows: DataFrame, cols: list[str], groups: list[str], entity_corr: DataFrame) -> DataFrame:
    """c_i_j = sum over pairs of entities of r x_i x_j, per group: the inner part of the sandwich, through the edge table.

    rows(groups..., entity_id, cols...), an entity once in a group; entity_corr(entity_a, entity_b, r[, groups...]) lists both directions and the
    diagonal, for all groups or with any of the group columns. Entities with many partners are split by partner; no pair of a group is formed that
    the edge table does not list.
    """
    shared = [g for g in groups if g in entity_corr.columns]
    key = lambda entity: F.struct(F.col(entity).alias("e"), *shared).alias("_key")
    edges = held(entity_corr.select(key("entity_a"), F.col("entity_b"), "r"))
    left = rows.select(key("entity_id"), *groups, *cols)
    half = split_join(edges, left, "_key", "entity_b", heavy_keys(edges, "_key")).groupBy(*groups, F.col("entity_b").alias("entity_id")).agg(
        *[F.sum(F.col("r") * F.col(c)).alias(f"_h{i}") for i, c in enumerate(cols)])
    both = half.join(rows.select(*groups, "entity_id", *cols), [*groups, "entity_id"])
    return both.groupBy(*groups).agg(*[F.sum(F.col(f"_h{i}") * F.col(cols[j])).alias(f"c_{i}_{j}") for i, j, _ in _cross_names(cols)])


def block_sums(rows: DataFrame, cols: list[str], groups: list[str], blocks: DataFrame, rho: float) -> DataFrame:
    """As ``correlated_sums`` where two entities of a block correlate by ``rho`` and entities of different blocks do not.

    blocks(entity_id, *block); an entity that is missing, or has a null in its block, has no terms, one that is listed m times counts m times. A block
    adds rho (sum x_i)(sum x_j) + (1 - rho) sum x_i x_j, so no pair of entities is formed.
    """
    names = [c for c in blocks.columns if c != "entity_id"]
    block = [f"_k{i}" for i in range(len(names))]  # the design may have columns of these names
    listed = blocks.select("entity_id", *[F.col(c).alias(k) for c, k in zip(names, block, strict=True)]).dropna().groupBy("entity_id", *block).agg(F.count("*").alias("_m"))
    x = rows.join(listed, "entity_id").groupBy("entity_id", *groups, *block).agg(*[F.coalesce(F.sum(F.col("_m") * F.col(c)), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(cols)])
    cross = _cross_names(cols)
    parts = x.groupBy(*groups, *block).agg(*[F.sum(f"_x{i}").alias(f"_s{i}") for i in range(len(cols))],
                                           *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_q_{i}_{j}") for i, j, _ in cross])
    return parts.groupBy(*groups).agg(*[F.sum(F.lit(rho) * F.col(f"_s{i}") * F.col(f"_s{j}") + F.lit(1.0 - rho) * F.col(f"_q_{i}_{j}")).alias(f"c_{i}_{j}") for i, j, _ in cross])


def _finish(table: DataFrame, groups: list[str], x: list[str], y: str, sandwich: bool) -> DataFrame:
    """(groups, outcome, term, beta, se, n_rows, converged) from rows of (beta, s_i_j, c_i_j or var, n_rows)."""
    k = len(x) + 1
    names = [*x, "intercept"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            inv = _inverse(_matrices(pdf, k))
            if sandwich:
                middle = np.nan_to_num(_matrices(pdf, k, "c"))
                var = np.einsum("gij,gjl,gil->gi", inv, middle, inv)
            else:
                var = pdf["var"].to_numpy(float)[:, None] * np.einsum("gii->gi", inv)
            beta = np.stack(pdf["beta"].to_numpy()) if len(pdf) else np.zeros((0, k))
            for i, name in enumerate(names):
                out = pdf[groups].copy()
                out["outcome"], out["term"] = y, name
                out["beta"], out["se"] = beta[:, i], np.sqrt(np.maximum(var[:, i], 0))
                out["n_rows"], out["converged"] = pdf["n_rows"].to_numpy(), pdf["converged"].to_numpy()
                yield out

    return with_tests(table.mapInPandas(solve, f"{_kinds(table, groups)}, outcome string, term string, beta double, se double, n_rows long, converged boolean"))


def _solved(sums: DataFrame, groups: list[str], k: int) -> DataFrame:
    """(groups, beta) of the normal equations s, xy."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xy = np.stack([pdf[f"xy_0_{i}"].to_numpy(float) for i in range(k)], axis=1)
            out = pdf[groups].copy()
            out["beta"] = list(np.einsum("gij,gj->gi", _inverse(_matrices(pdf, k)), xy))
            yield out

    return sums.mapInPandas(solve, f"{_kinds(sums, groups)}, beta array<double>")


def sandwich_ols(df: DataFrame, x: list[str], y: str, groups: list[str], entity_corr: DataFrame | None = None, blocks: DataFrame | None = None,
                 rho: float = 0.0) -> DataFrame:
    """Multiple regression with intercept per group, errors by (X'X)^-1 X'RX (X'X)^-1 with the residual correlation R of ``entity_corr``, or of ``blocks`` and ``rho``.

    R's scale is the caller's, as in the published form: a unit diagonal stands for residuals of variance 1. Rows are unique by (groups, entity_id);
    a group without listed pairs has se 0 and so z 0; an empty table gives an empty one. ``converged`` is true.
    """
    cols = [*x, "intercept"]
    rows = held(_design(df, x, y, groups, ("entity_id",)))
    sums = held(normal_sums(rows, cols, [y], groups))
    inner = correlated_sums(rows, cols, groups, entity_corr) if blocks is None else block_sums(rows, cols, groups, blocks, rho)
    table = sums.join(_solved(sums, groups, len(cols)), groups).join(inner, groups, "left")
    return _finish(table.withColumn("converged", F.lit(True)), groups, x, y, True)


def _fitted(cols: list[str]) -> Column:
    return sum((F.col("beta")[i] * F.col(c) for i, c in enumerate(cols)), F.lit(0.0))


def huber_groups(df: DataFrame, x: list[str], y: str, groups: list[str], delta: float = 1.0, tol: float = 1e-6, max_rounds: int | None = None,
                 entity_corr: DataFrame | None = None) -> DataFrame:
    """Huber regression with intercept of every group, by re-weighted least squares in one loop.

    A round joins the rows of the open groups with their coefficients, a short table, and sums weighted products; a group leaves when no coefficient
    moved by ``tol`` of the largest, so groups don't depend on each other. Errors: Huber loss / (n - k) times the diagonal of (X'X)^-1, or with
    ``entity_corr`` the sandwich of rows weighted by their square roots. Rows with a null in x or y take no part; a group whose sums are not finite
    ends with nan; ``max_rounds`` leaves the rest unconverged, as ``converged`` says.
    """
    cols = [*x, "intercept"]
    k = len(cols)
    extra = ("entity_id",) if entity_corr is not None else ()
    rows = held(_design(df.dropna(subset=[*x, y, *groups]), x, y, groups, extra))
    first = held(normal_sums(rows, cols, [y], groups))
    open_, closed = held(_solved(first, groups, k)), []
    weight = F.when(F.abs("_res") <= delta, F.lit(1.0)).otherwise(F.lit(delta) / F.abs("_res"))
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        left = open_.count()
        if not left:
            break
        w = rows.join(F.broadcast(open_) if left <= SHORT else open_, groups).withColumn("_res", F.col(y) - _fitted(cols)).withColumn("_w", weight)
        sums = w.groupBy(*groups).agg(
            *[F.sum(F.col("_w") * F.col(cols[i]) * F.col(cols[j])).alias(name) for i, j, name in _cross_names(cols)],
            *[F.sum(F.col("_w") * F.col(c) * F.col(y)).alias(f"xy_0_{i}") for i, c in enumerate(cols)])
        step = _solved(sums, groups, k).join(open_.withColumnRenamed("beta", "_old"), groups)
        size = F.aggregate("beta", F.lit(0.0), lambda a, b: F.greatest(a, F.abs(b)))
        moved = F.aggregate(F.zip_with("beta", "_old", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b))
        # nan counts as largest in greatest, and such a group can't move on
        step = held(step.select(*groups, "beta", (F.isnan(moved) | (moved < tol * (size + 1))).alias("_done")))
        closed.append(step.where("_done").select(*groups, "beta", F.lit(True).alias("converged")))
        open_ = step.where("not _done").drop("_done")
    state = held(reduce(DataFrame.unionByName, [*closed, open_.withColumn("converged", F.lit(False))]))
    res = rows.join(broadcast_if_small(state.select(*groups, "beta")), groups).withColumn("_res", F.col(y) - _fitted(cols)).drop("beta")
    loss = F.when(F.abs("_res") <= delta, F.col("_res") * F.col("_res") / 2).otherwise(delta * (F.abs("_res") - delta / 2))
    if entity_corr is None:
        spread = res.groupBy(*groups).agg(F.sum(loss).alias("_loss"))
        table = first.join(state, groups).join(spread, groups).withColumn("var", F.col("_loss") / F.greatest(F.col("n_rows") - k, F.lit(1)))
    else:
        root = held(res.select(*groups, "entity_id", *[(F.col(c) * F.sqrt(weight)).alias(c) for c in cols]))
        table = first.join(state, groups).join(correlated_sums(root, cols, groups, entity_corr), groups, "left")
    return _finish(table, groups, x, y, entity_corr is not None)


def factor_trait_fit(wide: DataFrame, factor_cols: list[str], outcome: DataFrame, covariates: list[str] | None = None, robust: bool = False,
                     tol: float = 1e-6, entity_corr: DataFrame | None = None) -> DataFrame:
    """Joint continuous regression of each trait on all factors, covariates and intercept: factor, trait, beta, se, z, p, p_onesided, converged.

    wide(entity_id, factors..., covariates...) is the universe; outcome(entity_id, trait, value), where an absent pair is 0. Least squares needs the
    non-zeros only, as X'X is the same for all traits; the robust fit and correlated residuals need every row's residual or place, so the grid of
    entities and traits is stored once. Traits without a row in the universe are not listed.
    """
    x = [*factor_cols, *(covariates or [])]
    cols = [*x, "intercept"]
    base = held(wide.select("entity_id", *[F.col(c).cast("double").alias(c) for c in x]))
    y = held(outcome.where("value is not null").join(base.select("entity_id"), "entity_id", "left_semi").select("entity_id", "trait", "value"))
    if robust or entity_corr is not None:
        full = grid(base, y.select("trait").distinct()).join(y, ["entity_id", "trait"], "left").fillna(0.0, ["value"])
        fit = huber_groups(full, x, "value", ["trait"], tol=tol, entity_corr=entity_corr) if robust else sandwich_ols(full, x, "value", ["trait"], entity_corr)
    else:
        shape = normal_sums(base.withColumn("intercept", F.lit(1.0)), cols, [])
        hits = y.join(base, "entity_id").withColumn("intercept", F.lit(1.0)).groupBy("trait").agg(
            F.sum(F.col("value") * F.col("value")).alias("_yy"), *[F.sum(F.col("value") * F.col(c)).alias(f"xy_0_{i}") for i, c in enumerate(cols)])
        sums = held(hits.withColumn("_shape", shape.select(F.struct("*")).scalar()).select("*", "_shape.*").drop("_shape"))
        table = sums.join(_solved(sums, ["trait"], len(cols)), "trait")
        explained = sum((F.col("beta")[i] * F.col(f"xy_0_{i}") for i in range(len(cols))), F.lit(0.0))
        table = table.withColumn("var", F.greatest(F.col("_yy") - explained, F.lit(0.0)) / F.greatest(F.col("n_rows") - len(cols), F.lit(1)))
        fit = _finish(table.withColumn("converged", F.lit(True)), ["trait"], x, "value", False)
    return fit.where(F.col("term").isin(factor_cols)).select(F.col("term").alias("factor"), "trait", "beta", "se", "z", "p", "p_onesided", "converged")
