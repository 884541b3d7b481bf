"""Inputs that a loop or several passes read are computed once."""
from pyspark.sql import functions as F

from evisets.operators import regress, shrink
from evisets.plans.iterate import cut


def counted(spark, df):
    """The rows, and an accumulator of how many were computed."""
    n = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            n.add(len(b))
            yield b

    return df.mapInPandas(seen, df.schema), n


def stats_of(spark):
    return spark.range(40).select(F.col("id").alias("set_id"), (F.col("id") % 2).alias("trait"), (F.sin(F.col("id")) / 5).alias("beta_tilde"),
                                  F.lit(0.05).alias("se"), (F.lit(0.1) + F.col("id") / 100).alias("scale"))


def test_hyper_rounds_read_stored_statistics(spark):
    stats, n = counted(spark, stats_of(spark))
    got = shrink.learn_hyper(stats, 0.1, 0.001, pseudo=1.0, power=-1.0).collect()
    assert n.value == 40 and {r.trait for r in got} == {0, 1} and all(r.converged and 0 < r.p < 1 for r in got)


def test_set_statistics_are_corrected_from_one_reading(spark):
    stats, n = counted(spark, stats_of(spark).where("trait = 0"))
    qc = spark.range(40).select(F.col("id").alias("set_id"), F.abs(F.sin(F.col("id"))).alias("a"), F.cos(F.col("id")).alias("b"))
    rows = regress.correct_set_stats(stats, qc, ["a", "b"]).select("set_id", "se", "z").collect()
    assert n.value == 20 and len(rows) == 20 and max(r.se for r in rows) > 0.05


def test_rows_of_one_trait_are_not_one_task(spark):
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as if nothing were known to be small
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        stats = cut(spark.range(0, 4000, 1, 4).select(F.col("id").alias("set_id"), F.lit("t").alias("trait"), (F.col("id") / 4000).alias("beta_tilde"),
                                                      F.lit(0.1).alias("se"), F.lit(1.0).alias("scale")))
        fit = shrink.shrink_independent(shrink.with_hyper(stats, 0.1, 0.01, None), 0.001)
        sizes = [r["count"] for r in fit.groupBy(F.spark_partition_id().alias("part"), "trait").count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4000 and max(sizes) < 4000
