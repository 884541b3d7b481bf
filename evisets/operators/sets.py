"""Set membership: normalisation, size and quality filters, pair correlation, sparsification.

membership(set_id, entity_id, weight) holds the non-zero entries only. Filters flag rows of a set table through
``status`` / ``filter_reason``; they do not drop them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisets.operators.align import count_of
from evisets.plans.iterate import by_group, cut, spread

TIE = 1e-9  # relative difference of two p that only the order of their sums makes


def set_sizes(membership: DataFrame) -> DataFrame:
    """Members and total absolute weight of each set."""
    return membership.groupBy("set_id").agg(
        F.count(F.when(F.col("weight") != 0, 1)).alias("size"), F.sum(F.abs("weight")).alias("abs_weight")
    )


def entity_degree(membership: DataFrame) -> DataFrame:
    return membership.groupBy("entity_id").agg(
        F.count(F.when(F.col("weight") != 0, 1)).alias("n_sets"), F.sum(F.abs("weight")).alias("abs_weight")
    )


def set_moments(membership: DataFrame, n: Column) -> DataFrame:
    """Size, mean and population sd of each set over the whole universe of ``n`` entities (absent = 0)."""
    sums = membership.groupBy("set_id").agg(
        F.count("*").alias("size"), F.sum("weight").alias("sum_w"),
        F.sum(F.col("weight") * F.col("weight")).alias("sum_w2"),
    ).withColumn("n", n)
    mean = F.col("sum_w") / F.col("n")
    var = F.greatest(F.col("sum_w2") / F.col("n") - mean * mean, F.lit(0.0))
    return sums.select("set_id", "size", "n", "sum_w", "sum_w2", mean.alias("mean"), F.sqrt(var).alias("scale"))


def normalize_weights(membership: DataFrame, threshold: float | None = 0.5, cap: bool = True) -> DataFrame:
    """Divide a set's weights by their mean absolute value where needed, then threshold and cap.

    A set is rescaled when it holds a weight above 1 in size, or when the threshold would split it.
    """
    if threshold is not None and threshold <= 0:
        threshold = None
    a = F.abs("weight")
    split = F.lit(False)
    if threshold is not None:
        split = F.sum(F.when(a >= threshold, 1).otherwise(0)) != F.sum(F.when(a > 0, 1).otherwise(0))
    norms = membership.where(F.col("weight") != 0).groupBy("set_id").agg(
        F.round(F.sum(a) / F.count("*"), 10).alias("_avg"),
        ((F.max(a) > 1) | split).alias("_rescale"),
    )
    factor = F.when(F.col("_rescale") & (F.col("_avg") != 0), F.col("_avg")).otherwise(F.lit(1.0))
    out = membership.where(F.col("weight") != 0).join(norms, "set_id").withColumn("weight", F.col("weight") / factor)
    if threshold is not None:
        out = out.where(F.abs("weight") >= threshold)
        if cap:
            out = out.withColumn("weight", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("weight"))))
    return out.drop("_avg", "_rescale")


def flag(df: DataFrame, keep: Column, reason: str, status: str = "ignored") -> DataFrame:
    """Move kept rows that fail ``keep`` to another status and append the reason."""
    if "status" not in df.columns:
        df = df.withColumns({"status": F.lit("kept"), "filter_reason": F.lit(None).cast("string")})
    fails = (F.col("status") == "kept") & ~F.coalesce(keep, F.lit(False))
    return df.withColumns({
        "filter_reason": F.when(fails, F.concat_ws(";", "filter_reason", F.lit(reason))).otherwise(F.col("filter_reason")),
        "status": F.when(fails, F.lit(status)).otherwise(F.col("status")),
    })


def filter_size(sets: DataFrame, min_size: int = 10, max_size: int = 30_000) -> DataFrame:
    return flag(flag(sets, F.col("size") >= min_size, "too_small"), F.col("size") <= max_size, "too_large")


def filter_qc(sets: DataFrame, col: str = "mean_qc", limit: float = 2.5) -> DataFrame:
    """Drop sets whose mean quality z is extreme among all sets."""
    s = sets.agg(F.struct(F.avg(col).alias("m"), F.stddev_pop(col).alias("s"))).scalar()
    z = (F.col(col) - F.col("_s.m")) / F.when(F.col("_s.s") == 0, F.lit(1.0)).otherwise(F.col("_s.s"))
    out = sets.withColumn("_s", s).withColumn("qc_z", z).drop("_s")
    return flag(out, F.abs("qc_z") <= limit, "qc")


def prefilter(stats: DataFrame, max_p: float = 0.01, min_fraction: float | None = None,
              drop_negative: bool = True) -> DataFrame:
    """p-value filter; when fewer than ``min_fraction`` of a trait's sets pass, the trait's p quantile at that fraction is used."""
    limit: Column = F.lit(max_p)
    if min_fraction is not None:
        s = stats.groupBy("trait").agg(
            F.avg(F.when(F.col("p") <= max_p, 1.0).otherwise(0.0)).alias("_frac"),
            F.percentile("p", min_fraction).alias("_quantile"),
        )
        stats = stats.join(by_group(s), "trait", "left")
        limit = F.when(F.col("_frac") < min_fraction, F.col("_quantile")).otherwise(F.lit(max_p))
    out = flag(stats, F.col("p") <= limit, "p")
    if drop_negative:
        out = flag(out, F.col("beta_tilde") >= 0, "negative")
    return out.drop("_frac", "_quantile")


def prefilter_any_trait(stats: DataFrame, max_p: float = 0.01) -> DataFrame:
    """One row per set: kept when any trait passes with a non-negative effect."""
    ok = (F.col("p") <= max_p) & (F.col("beta_tilde") >= 0)
    return stats.groupBy("set_id").agg(
        F.bool_or(ok).alias("keep"), F.min("p").alias("min_p"), F.max("beta_tilde").alias("max_beta_tilde")
    )


def flip_signs(membership: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turn sets that hold negative weights and have a negative effect; returns (membership, stats)."""
    negative = membership.groupBy("set_id").agg((F.min("weight") < 0).alias("_neg"))
    marked = stats.join(negative, "set_id", "left").withColumn(
        "flipped", F.coalesce(F.col("_neg"), F.lit(False)) & (F.col("beta_tilde") < 0)
    ).drop("_neg")
    sign = F.when(F.col("flipped"), F.lit(-1.0)).otherwise(F.lit(1.0))
    turned = marked.withColumns({c: F.col(c) * sign for c in ("beta_tilde", "z") if c in marked.columns})
    members = membership.join(marked.select("set_id", "flipped"), "set_id", "left").withColumn(
        "weight", F.col("weight") * F.when(F.col("flipped"), F.lit(-1.0)).otherwise(F.lit(1.0))
    ).drop("flipped")
    return members, turned


def limit_by_p(stats: DataFrame, n: int) -> DataFrame:
    """Keep the ``n`` most significant sets of each trait, ties included.

    Each task keeps n rows per trait before the shuffle, so nothing is ranked in one task. ``stats`` are stored first: a p summed again in another
    order differs in its last digits, and the n-th set would miss its own limit. For the same reason p within TIE of the n-th are ties.
    """
    stats = cut(stats)
    best = Window.partitionBy("trait").orderBy("p")
    nth = stats.where("p is not null").select("trait", "p").withColumn("_i", F.row_number().over(best)).where(F.col("_i") <= n)
    nth = nth.groupBy("trait").agg(F.max("p").alias("_nth"))
    return flag(stats.join(by_group(nth), "trait", "left"), F.coalesce(F.col("p") <= F.col("_nth") * (1 + TIE), F.lit(False)), "limit_p").drop("_nth")


def refilter_corrected(stats: DataFrame, max_p: float) -> DataFrame:
    """Re-apply the p filter after correction; the best set of each trait always survives, with those within TIE of it. ``stats`` are stored, so that its p equals itself."""
    stats = cut(stats)
    best = stats.groupBy("trait").agg(F.min("p").alias("_best"))
    return flag(stats.join(by_group(best), "trait", "left"), F.coalesce((F.col("p") <= max_p) | (F.col("p") <= F.col("_best") * (1 + TIE)), F.lit(False)), "corrected_p").drop("_best")


def drop_zero(stats: DataFrame, col: str = "beta_uncorrected") -> DataFrame:
    return flag(stats, F.col(col) != 0, "zero_beta")


def union_sets(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of memberships; the tag prefixes the set id and names the batch."""
    tagged = [
        df.select(F.concat_ws("_", F.lit(tag), F.col("set_id").cast("string")).alias("set_id"), "entity_id", "weight",
                  F.lit(tag).alias("batch"))
        for tag, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, tagged)


def assign_batches(inputs: list[tuple[str, str | None]]) -> list[tuple[str, str]]:
    """Batch name of each input: its own, or a fresh one."""
    used = {b for _, b in inputs if b is not None}
    out, k = [], 0
    for path, batch in inputs:
        if batch is None:
            while f"BATCH{k}" in used:
                k += 1
            batch = f"BATCH{k}"
            used.add(batch)
        out.append((path, batch))
    return out


def only_inc(membership: DataFrame, included: DataFrame, fraction: float) -> DataFrame:
    """Keep sets with at least ``fraction`` of their members among the included entities."""
    inside = included.select("entity_id").distinct().withColumn("_in", F.lit(1))
    share = membership.join(inside, "entity_id", "left").groupBy("set_id").agg(
        (F.count("_in") / F.count("*")).alias("_share")
    ).where(F.col("_share") >= fraction)
    return membership.join(share, "set_id", "left_semi")


def sets_for_anchors(membership: DataFrame, anchors: DataFrame, fraction: float) -> DataFrame:
    """Keep sets that hold at least ``fraction`` of the anchor list."""
    wanted = anchors.select("entity_id").distinct()
    hits = membership.join(wanted, "entity_id", "left_semi").groupBy("set_id").agg(F.count("*").alias("_hits"))
    keep = hits.where(F.col("_hits") >= F.lit(fraction) * count_of(wanted))
    return membership.join(keep, "set_id", "left_semi")


def rank_for_prune(set_trait: DataFrame) -> DataFrame:
    """Mean uncorrected effect of a set over traits; larger is pruned later."""
    return set_trait.groupBy("set_id").agg(F.avg("beta_uncorrected").alias("mean_beta"))


def filter_anchor(values: DataFrame, key: str, threshold: float) -> DataFrame:
    """Keep rows whose key reaches the threshold in at least one anchor."""
    top = values.groupBy(key).agg(F.max("value").alias("_top")).where(F.col("_top") >= threshold)
    return values.join(top, key, "left_semi")


def subset_sets(sets: DataFrame, keep: Column, status: str, reason: str) -> DataFrame:
    """Move sets out of the kept state, with a reason."""
    return flag(sets, keep, reason, status)


def subset_entities(membership: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership on the chosen entities and the re-counted sets."""
    kept = membership.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    return kept, set_sizes(kept)


def sample_sets(sets: DataFrame, n: int, seed: int) -> DataFrame:
    """Seeded choice of at most ``n`` sets per batch, independent of partitioning."""
    w = Window.partitionBy("batch").orderBy(F.xxhash64("set_id", F.lit(seed)), "set_id")
    return sets.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def permute_members(membership: DataFrame, universe: DataFrame, seed: int) -> DataFrame:
    """Null model: members renamed by one seeded permutation of the universe.

    The identity order and the shuffled order are both numbered with distributed positions and joined.
    """
    from evisets.operators.ordered import dense_position

    u = universe.select("entity_id").distinct()
    own = dense_position(u.withColumn("_h", F.xxhash64("entity_id", F.lit(seed)).cast("double")),
                         ["_h", "entity_id"], "_i", "_h")
    other = dense_position(u.withColumn("_h", F.xxhash64("entity_id", F.lit(seed + 1)).cast("double")),
                           ["_h", "entity_id"], "_i", "_h")
    mapping = own.select("entity_id", "_i").join(other.select(F.col("entity_id").alias("_new"), "_i"), "_i")
    return membership.join(mapping, "entity_id").select("set_id", F.col("_new").alias("entity_id"), "weight")


SIDE = 256  # sets of an entity that stand side by side


def set_overlap(left: DataFrame, right: DataFrame, moments: DataFrame) -> DataFrame:
    """Correlation V of each left set with each right set that shares a member, over the whole universe.

    An entity's right sets stand side by side in arrays of about SIDE, which go to the tasks of its left sets; products are summed there, so what is
    shuffled is a membership with its arrays, not a row per pair and entity. A table with itself is multiplied for set_a < set_b only and mirrored.
    Disjoint pairs have V = -mean_a mean_b / (scale_a scale_b) and are not listed.
    """
    same = left is right
    a = left.select(F.col("set_id").alias("set_a"), "entity_id", F.col("weight").alias("w_a"))
    b = right.select(F.col("set_id").alias("set_b"), "entity_id", F.col("weight").alias("w_b"))
    parts = b.groupBy("entity_id").agg(F.ceil(F.count("*") / SIDE).alias("_parts"))
    lists = b.join(parts, "entity_id").groupBy("entity_id", F.pmod(F.xxhash64("set_b"), F.col("_parts")).alias("_part")).agg(
        F.collect_list(F.struct("set_b", "w_b")).alias("_sets"))
    met = F.filter("_sets", lambda x: x["set_b"] > F.col("set_a") if same else x["set_b"] != F.col("set_a"))
    joined = spread(a, "entity_id").join(lists, "entity_id").select("set_a", "w_a", met.alias("_sets")).where(F.size("_sets") > 0)
    pairs = spread(joined, "set_a").select("set_a", "w_a", F.explode("_sets").alias("_s"))
    dots = pairs.groupBy("set_a", F.col("_s.set_b").alias("set_b")).agg(F.sum(F.col("w_a") * F.col("_s.w_b")).alias("dot"))
    if same:
        both = F.explode(F.array(F.struct("set_a", "set_b"), F.struct(F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b"))))
        dots = dots.select(both.alias("_p"), "dot").select("_p.*", "dot")
    m = moments.where("scale > 0")
    ma = m.select(F.col("set_id").alias("set_a"), F.col("mean").alias("_ma"), F.col("scale").alias("_sa"), "n")
    mb = m.select(F.col("set_id").alias("set_b"), F.col("mean").alias("_mb"), F.col("scale").alias("_sb"))
    v = (F.col("dot") / F.col("n") - F.col("_ma") * F.col("_mb")) / (F.col("_sa") * F.col("_sb"))
    return dots.join(ma, "set_a").join(mb, "set_b").select("set_a", "set_b", "dot", v.alias("v"))


def dedupe_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key by an explicit line order (partial aggregation, no window)."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r")).select(key, "_r.*")
