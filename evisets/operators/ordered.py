"""Distributed ordered computations: running sums, suffix minima and ranks without a one-task window.

A window that orders a whole table (or one hot group) runs in one task. Here values are cut into
quantile buckets first; each bucket is windowed on its own and bucket totals (at most ``buckets`` rows
per group) carry the running state across buckets. Rows with equal order value are aggregated before,
so a value that holds a third of the table is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket_count(df: DataFrame, buckets: int | None) -> int:
    if buckets is not None:
        return buckets
    return max(2, min(512, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def with_bucket(df: DataFrame, value: str, buckets: int | None = None) -> DataFrame:
    """Add ``_bucket`` by approximate quantiles of the column (bounds are one scalar subquery of fixed size)."""
    n = _bucket_count(df, buckets)
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = df.agg(F.array_distinct(F.percentile_approx(value, probs, F.lit(10000)))).scalar()
    kind = df.schema[value].dataType.simpleString()
    marked = df.withColumn("_bounds", F.coalesce(bounds, F.array().cast(f"array<{kind}>")))
    return marked.withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")


def running_totals(df: DataFrame, groups: list[str], value: str, amount: str, out: str = "running",
                   buckets: int | None = None) -> DataFrame:
    """One row per distinct (groups, value) with the sum of ``amount`` over all values <= it, per group.

    Also returns ``<out>_total``, the sum over the whole group.
    """
    distinct = df.groupBy(*groups, value).agg(F.sum(amount).alias("_amount"))
    distinct = with_bucket(distinct, value, buckets)
    keys = [*groups, "_bucket"]
    totals = distinct.groupBy(*keys).agg(F.sum("_amount").alias("_sum"))
    by_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = by_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys,
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
        F.sum("_sum").over(by_group).alias(f"{out}_total"),
    )
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        distinct.withColumn("_inside", F.sum("_amount").over(inside))
        .join(totals, keys)
        .select(*groups, value, "_bucket", F.col("_amount").alias("amount"),
                (F.col("_inside") + F.col("_before")).alias(out), f"{out}_total")
    )


def suffix_min(df: DataFrame, groups: list[str], value: str, target: str, out: str) -> DataFrame:
    """Minimum of ``target`` over rows with order value >= the row's own (needs ``_bucket`` and unique values)."""
    keys = [*groups, "_bucket"]
    by_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    later = by_group.orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    tails = df.groupBy(*keys).agg(F.min(target).alias("_min")).select(
        *keys, F.min("_min").over(later).alias("_later")
    )
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(0, Window.unboundedFollowing)
    return (
        df.withColumn("_own", F.min(target).over(inside))
        .join(tails, keys)
        .withColumn(out, F.least("_own", "_later"))
        .drop("_own", "_later")
    )


def bh_q(df: DataFrame, p: str = "p", groups: list[str] | None = None, out: str = "q",
         buckets: int | None = None) -> DataFrame:
    """Benjamini-Hochberg q-value of every row, within optional groups.

    q depends only on the distinct p-values and how many rows lie at or below each, so ties (all p = 1, say)
    are counted before any ordering. The input is materialised once, since it is read for the counts, the bucket bounds and the
    final join.
    """
    from evisets.plans.iterate import cut

    groups = groups or []
    df = cut(df)
    counted = df.where(F.col(p).isNotNull()).groupBy(*groups, p).agg(F.count("*").alias("_n"))
    ranked = running_totals(counted, groups, p, "_n", "_rank", buckets)
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("_rank_total") / F.col("_rank"))
    q = suffix_min(ranked, groups, p, "_raw", "_q").select(*groups, p, F.least("_q", F.lit(1.0)).alias(out))
    return df.join(q, [*groups, p], "left")  # a null p has a null q and counts for nobody


def dense_position(df: DataFrame, order: list[str], out: str, value: str, buckets: int | None = None) -> DataFrame:
    """0-based position of every row in a total order that starts with the numeric column ``value``."""
    marked = with_bucket(df, value, buckets)
    sizes = marked.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        marked.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(sizes), "_bucket")  # at most ``buckets`` rows
        .withColumn(out, F.col("_before") + F.col("_row") - 1)
        .drop("_bucket", "_row", "_before")
    )


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows of each group; Spark keeps k rows per group and task before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
