"""Weighted non-negative factorisation and projection as rounds of joins and grouped sums.

cells(set_id, entity_id, value) holds the non-zeros of V. Weights Omega_ij = sum_u p_iu q_ju are low rank, so the dense terms
of the update reduce to one K x K Gram matrix per weight column: nothing of size sets x entities exists. Loadings are rows
(run, key, w array<K>); several seeded runs and prior scales advance in the same jobs. K is a few tens, so K x K matrices per
run are the only thing that visits the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisets.operators.packed import CELLS, WIDTH
from evisets.plans.iterate import cut, dealt

EPS = 1e-50


@dataclass(frozen=True)
class Run:
    run: int
    seed: int
    phi: float


def uniform(*keys) -> Column:
    """Uniform (0, 1) from a hash of the keys; independent of partitioning."""
    return (F.xxhash64(*keys).bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))


def _start(keys: DataFrame, key: str, runs: list[Run], k: int, top: float, salt: str) -> DataFrame:
    axis = F.explode(F.array(*[F.struct(F.lit(r.run).alias("run"), F.lit(r.seed).alias("seed")) for r in runs]))
    vec = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: uniform(F.col(key), i, F.col("_r.seed"), F.lit(salt)) * F.lit(top))
    return keys.withColumn("_r", axis).select("_r.run", key, "g", vec.alias("w"))


def _grams(rows: DataFrame, k: int, n_weights: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], dict[int, float]]:
    """Per run: sum_rows g_u w w' for each weight column u, sum w^2, and 0."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, square, cross = {}, {}, {}
        for pdf in batches:
            for run, part in pdf.groupby("run", sort=False):
                w, g = np.stack(part["w"].to_numpy()), np.stack(part["g"].to_numpy())
                gram[run] = gram.get(run, 0) + np.einsum("nu,na,nb->uab", g, w, w, optimize=True)
                square[run] = square.get(run, 0) + (w * w).sum(axis=0)
                cross[run] = 0.0
        yield pd.DataFrame({"run": list(gram), "gram": [v.ravel().tolist() for v in gram.values()],
                            "square": [v.tolist() for v in square.values()], "cross": list(cross.values())})

    return _added(rows.select("run", "g", "w").mapInPandas(partial, "run int, gram array<double>, square array<double>, cross double").select(
        "run", F.concat("gram", "square", F.array("cross")).alias("sums")), k, n_weights)


def _added(parts: DataFrame, k: int, n_weights: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], dict[int, float]]:
    """Sums over tasks of (run, sums: the Gram matrices, the squares and the cross term)."""
    size = n_weights * k * k
    flat: dict[int, np.ndarray] = {}
    for r in parts.select("run", F.posexplode("sums").alias("i", "v")).groupBy("run", "i").agg(F.sum("v").alias("v")).collect():  # runs x (u k^2 + k + 1) numbers
        flat.setdefault(r["run"], np.zeros(size + k + 1))[r["i"]] = r["v"]
    return ({r: v[:size].reshape(n_weights, k, k) for r, v in flat.items()}, {r: v[size:size + k] for r, v in flat.items()},
            {r: float(v[-1]) for r, v in flat.items()})


def _numerator(cells: DataFrame, fixed: DataFrame, fixed_key: str, moving_key: str, k: int, runs: list[int],
               n_fixed: int | None = None) -> DataFrame:
    """sum over non-zeros of weight x value x the other side's loading, per (run, key).

    The loadings of several runs stand side by side, so a cell meets one row for them. Where the ``n_fixed`` keys of the other side are few, they are
    broadcast to the cells, which are stored in buckets of the moving key; then neither cells nor products are shuffled.
    """
    side = max(1, WIDTH // k)
    n_fixed = fixed.select(fixed_key).distinct().count() if n_fixed is None else n_fixed
    parts = []
    for chosen in (runs[i:i + side] for i in range(0, len(runs), side)):
        names = {r: [f"n{at}_{i}" for i in range(k)] for at, r in enumerate(chosen)}
        own = fixed.where(F.col("run").isin(chosen))
        if len(chosen) == 1:
            wide = own.select(fixed_key, *[F.col("w")[i].alias(n) for i, n in enumerate(names[chosen[0]])])
        else:
            wide = own.groupBy(fixed_key).agg(
                *[F.max(F.when(F.col("run") == r, F.col("w")[i])).alias(n) for r in chosen for i, n in enumerate(names[r])])
        few = n_fixed * len(chosen) * k <= CELLS
        j = cells.join(F.broadcast(wide) if few else wide, fixed_key)
        sums = j.groupBy(moving_key).agg(*[F.sum(F.col("vs") * F.col(n)).alias(n) for r in chosen for n in names[r]])
        rows = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.array(*names[r]).alias("num")) for r in chosen]))
        parts.append(sums.select(moving_key, rows.alias("_r")).select("_r.run", moving_key, "_r.num"))
    return reduce(DataFrame.unionByName, parts)


def _update(rows: DataFrame, key: str, num: DataFrame, grams: dict, lam: dict, phi: dict, k: int, cap: float | None) -> tuple:
    """Multiplicative step of one side, w <- w num / (sum_u g_u G_u w + phi w / lambda), stored, and its ``_grams``, which the same tasks sum."""
    key_type = rows.schema[key].dataType.simpleString()
    n_weights = len(next(iter(grams.values())))
    columns = ["run", key, "g", "w", "sums"]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for pdf in batches:
            out = []
            for run, part in pdf.groupby("run", sort=False):
                w, g = np.stack(part["w"].to_numpy()), np.stack(part["g"].to_numpy())
                n = np.stack([np.zeros(k) if x is None else np.asarray(x, float) for x in part["num"]])
                den = np.einsum("nu,uab,nb->na", g, grams[run], w, optimize=True) + phi[run] * w / lam[run] + EPS
                new = np.maximum(w * n / den, 0.0)
                if cap is not None:
                    new = np.minimum(new, cap)
                out.append(pd.DataFrame({"run": run, key: part[key], "g": part["g"], "w": list(new), "sums": None}))
                gram = np.einsum("nu,na,nb->uab", g, new, new, optimize=True).ravel()
                sums[run] = sums.get(run, 0.0) + np.concatenate([gram, (new * new).sum(axis=0), [(new * n).sum()]])
            yield pd.concat(out) if out else pd.DataFrame({c: [] for c in columns})
        if sums:  # a row without a key for each run
            yield pd.DataFrame({"run": list(sums), key: None, "g": None, "w": None, "sums": list(sums.values())}).astype(object)[columns]

    j = rows.select("run", key, "g", "w").join(num, ["run", key], "left").select("run", key, "g", "w", "num")
    done = cut(j.mapInPandas(step, f"run int, {key} {key_type}, g array<double>, w array<double>, sums array<double>"))
    return done.where("sums is null").drop("sums"), _added(done.where("sums is not null").select("run", "sums"), k, n_weights)


@dataclass
class Fit:
    """sets / entities: (run, key, w array<K>); summary: one row per run; lambdas: (run, factor, lambda)."""
    sets: DataFrame
    entities: DataFrame
    summary: DataFrame
    lambdas: DataFrame
    trace: list

    def loadings(self) -> DataFrame:
        """Long loadings(run, axis, key, factor, value), factors from 1."""
        def long(df, key, axis):
            return df.select("run", F.lit(axis).alias("axis"), F.col(key).cast("string").alias("key"),
                             F.posexplode("w").alias("_f", "value")).select("run", "axis", "key", (F.col("_f") + 1).alias("factor"), "value")
        return long(self.sets, "set_id", "set").unionByName(long(self.entities, "entity_id", "entity"))


def _with_weights(keys: DataFrame, key: str, weights: DataFrame | None, anchors: list[str]) -> DataFrame:
    """keys with g array<U>: the key's weight for every anchor, 1 where no weights are given."""
    if weights is None:
        return keys.withColumn("g", F.array(*[F.lit(1.0) for _ in anchors]))
    wide = weights.groupBy(key).agg(*[F.max(F.when(F.col("anchor") == a, F.col("weight"))).alias(f"_a{i}") for i, a in enumerate(anchors)])
    return keys.join(wide, key, "left").select(key, F.array(*[F.coalesce(F.col(f"_a{i}"), F.lit(0.0)) for i in range(len(anchors))]).alias("g"))


def ard_nmf(cells: DataFrame, k: int, runs: list[Run], set_weights: DataFrame | None = None, entity_weights: DataFrame | None = None,
            iterations: int = 100, tol: float = 1e-4, a0: float = 10.0, cap: float | None = 1.0) -> Fit:
    """Factor V (sets x entities) with automatic relevance determination, for several (seed, phi) runs at once.

    set_weights(set_id, anchor, weight) and entity_weights(entity_id, anchor, weight) weight the squared error. Each iteration is two
    joins over the non-zeros; the error comes for free from the second one (sum V Omega (WH) = sum w . numerator).
    """
    anchors = ["all"]
    for weights in (set_weights, entity_weights):
        if weights is not None:
            anchors = [r[0] for r in weights.select(F.col("anchor").cast("string")).distinct().orderBy("anchor").limit(1001).collect()]
            if len(anchors) > 1000:
                raise ValueError("more than 1000 anchors: aggregate them before factoring")
            break
    u = len(anchors)
    sets = cut(_with_weights(cells.select("set_id").distinct(), "set_id", set_weights, anchors))
    ents = cut(_with_weights(cells.select("entity_id").distinct(), "entity_id", entity_weights, anchors))
    dot = F.aggregate(F.zip_with("_gs", "_ge", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    weighted = cells.join(sets.withColumnRenamed("g", "_gs"), "set_id").join(ents.withColumnRenamed("g", "_ge"), "entity_id").select(
        "set_id", "entity_id", (F.col("value") * dot).alias("vs"), (F.col("value") * F.col("value") * dot).alias("v2s"), "value")
    weighted = cut(weighted)
    n, m = sets.count(), ents.count()
    s = weighted.agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.max("value").alias("mx"),
                     F.sum("v2s").alias("v2s")).first()
    mean = s["s"] / (n * m)
    variance = s["s2"] / (n * m) - mean * mean
    c = (n + m) / 2 + a0 + 1
    b0 = 3.14 * (a0 - 1) * mean / (2 * k)
    phi = {r.run: variance * r.phi for r in runs}
    by_entity, by_set = (dealt(weighted.select("set_id", "entity_id", "vs"), key) for key in ("entity_id", "set_id"))
    W = cut(_start(sets, "set_id", runs, k, s["mx"], "set"))
    H = cut(_start(ents, "entity_id", runs, k, s["mx"], "entity"))
    gw, w2, _ = _grams(W, k, u)
    gh, h2, _ = _grams(H, k, u)
    lam = {r.run: (0.5 * (w2[r.run] + h2[r.run]) + b0) / c for r in runs}
    active = {r.run for r in runs}
    trace, last = [], {}
    done_w, done_h = [], []
    for it in range(1, iterations + 1):
        H, (gh, h2, _) = _update(H, "entity_id", _numerator(by_entity, W, "set_id", "entity_id", k, sorted(active), n), gw, lam, phi, k, cap)
        W, (gw, w2, cross) = _update(W, "set_id", _numerator(by_set, H, "entity_id", "set_id", k, sorted(active), m), gh, lam, phi, k, cap)
        finished = set()
        for r in sorted(active):
            new = (0.5 * (w2[r] + h2[r]) + b0) / c
            delta = float(np.max(np.abs(new - lam[r]) / (lam[r] + EPS)))
            lam[r] = new
            error = s["v2s"] - 2 * cross[r] + float(np.einsum("uab,uba->", gw[r], gh[r]))
            like = 0.5 * error
            evidence = like + phi[r] * float(np.sum((0.5 * (w2[r] + h2[r]) + b0) / new + c * np.log(new)))
            last[r] = (r, it, float(error), float(evidence), delta, delta < tol)
            trace.append((r, it, float(error), float(evidence), delta))
            if delta < tol:
                finished.add(r)
        if finished and finished != active:  # converged runs leave the joins
            mark = F.col("run").isin(sorted(finished))
            done_w.append(W.where(mark)), done_h.append(H.where(mark))
            W, H = W.where(~mark), H.where(~mark)
        active -= finished
        if not active:
            break
    for part in done_w:
        W = W.unionByName(part)
    for part in done_h:
        H = H.unionByName(part)
    spark = cells.sparkSession
    bound = 1.5 * b0 / c
    rows = [(*last[r.run], float(r.phi), int(np.sum(lam[r.run] >= bound))) for r in runs]
    summary = spark.createDataFrame(rows, "run int, iterations int, error double, evidence double, delta_lambda double, converged boolean, "
                                          "phi double, num_factors int")
    lambdas = spark.createDataFrame([(r.run, i + 1, float(x), bool(x >= bound)) for r in runs for i, x in enumerate(lam[r.run])],
                                    "run int, factor int, lambda double, active boolean")
    return Fit(W.select("run", "set_id", "w"), H.select("run", "entity_id", "w"), summary, lambdas, trace)


def _basis_gram(basis: DataFrame, k: int) -> np.ndarray:
    rows = basis.select(F.lit(0).alias("run"), F.array(F.lit(1.0)).alias("g"), "w")
    gram, _, _ = _grams(rows, k, 1)
    return gram[0][0] if gram else np.zeros((k, k))


def wide_basis(loadings: DataFrame, k: int) -> DataFrame:
    """(key, w array<K>) from long (key, factor 1..K, value)."""
    sums = loadings.groupBy("key").agg(*[F.sum(F.when(F.col("factor") == i + 1, F.col("value"))).alias(f"w{i}") for i in range(k)])
    return sums.select("key", F.array(*[F.coalesce(F.col(f"w{i}"), F.lit(0.0)) for i in range(k)]).alias("w"))


def nnls_project(basis: DataFrame, profiles: DataFrame, k: int, max_value: float | None = None, max_sum: float | None = None,
                 iterations: int = 100_000, tol: float = 1e-5, penalty: float = 0.0, lambdas: np.ndarray | None = None,
                 seed: int = 0) -> DataFrame:
    """Non-negative loadings(profile, factor, value) of each profile on a fixed basis (key, w array<K>).

    With the basis fixed, a profile needs only its K numerators (one join and sum) and the shared K x K Gram matrix; the
    multiplicative updates then run row by row inside each task, whatever the number of profiles.
    profiles(profile, key, value). ``penalty`` / ``lambdas`` give the regularised projection of the factorisation.
    """
    gram = _basis_gram(basis, k)
    num = profiles.join(basis, "key").groupBy("profile").agg(*[F.sum(F.col("value") * F.col("w")[i]).alias(f"n{i}") for i in range(k)])
    start = F.array(*[uniform(F.col("profile"), F.lit(i), F.lit(seed)) for i in range(k)])
    rows = num.select("profile", F.array(*[f"n{i}" for i in range(k)]).alias("num"), start.alias("h"))
    kind = rows.schema["profile"].dataType.simpleString()
    ridge = penalty / (np.ones(k) if lambdas is None else lambdas)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            n, h = np.stack(pdf["num"].to_numpy()), np.stack(pdf["h"].to_numpy())
            live = np.ones(len(pdf), dtype=bool)
            for _ in range(iterations):
                cur = h[live]
                new = np.maximum(cur * n[live] / (cur @ gram + ridge * cur + 1e-10), 0.0)
                if max_value is not None:
                    new = np.minimum(new, max_value)
                if max_sum is not None:
                    total = new.sum(axis=1, keepdims=True)
                    new = np.where(total > max_sum, new / np.where(total > 0, total, 1.0) * max_sum, new)
                moved = np.abs(new - cur).max(axis=1) >= tol * 1e-2
                h[live] = new
                live[np.flatnonzero(live)[~moved]] = False
                if not live.any():
                    break
            yield pd.DataFrame({"profile": pdf["profile"], "h": list(h)})

    out = rows.mapInPandas(solve, f"profile {kind}, h array<double>")
    return out.select("profile", F.posexplode("h").alias("_f", "value")).select("profile", (F.col("_f") + 1).alias("factor"), "value")


def project(cells: DataFrame, fit_side: DataFrame, key: str, profile: str, k: int, phi: float = 0.0, lambdas: np.ndarray | None = None,
            cap: float | None = 1.0, iterations: int = 100) -> DataFrame:
    """Project new rows of V on fixed factors: cells(key, profile, value) against (key, w)."""
    basis = fit_side.select(F.col(key).alias("key"), "w")
    rows = cells.select(F.col(profile).alias("profile"), F.col(key).alias("key"), "value")
    return nnls_project(basis, rows, k, max_value=cap, iterations=iterations, penalty=phi, lambdas=lambdas)


def capture(basis: DataFrame, profiles: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(capture shares, profile strengths): how much of each profile the factors hold, blind to its scale.

    Basis columns and profiles are scaled to sum 1, shares are non-negative with sum <= 1. basis(key, factor, value) long.
    """
    mass = basis.groupBy("factor").agg(F.sum("value").alias("_m"))
    unit = basis.join(mass, "factor").withColumn("value", F.col("value") / F.greatest("_m", F.lit(1e-12))).drop("_m")
    strength = profiles.groupBy("profile").agg(F.sum("value").alias("strength"))
    scaled = profiles.join(strength, "profile").withColumn("value", F.col("value") / F.greatest("strength", F.lit(1e-12)))
    return nnls_project(wide_basis(unit, k), scaled.select("profile", "key", "value"), k, max_sum=1.0, tol=1e-9), strength


def relevance(basis: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """Relevance(factor, anchor, value) of each factor to each anchor's weight vector: projection capped at 1.

    basis(key, factor, value) long; anchors(key, anchor, weight).
    """
    rows = anchors.select(F.col("anchor").alias("profile"), "key", F.col("weight").alias("value"))
    fit = nnls_project(wide_basis(basis, k), rows, k, max_value=1.0)
    return fit.select("factor", F.col("profile").alias("anchor"), "value")
