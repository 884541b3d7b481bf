"""Sums through blocks of correlated entities equal those through their edge table, without its pairs."""
import numpy as np
from pyspark.sql import functions as F

from evisets.operators import grouped


def test_block_sums_equal_the_edge_table(spark):
    rng = np.random.default_rng(2)
    rows = [(t, e, float(rng.random()) if e % 7 else None, 1.0) for t in ("a", "b") for e in range(40) if (e + len(t)) % 5]
    rows += [("a", 3, 0.5, 1.0), ("a", 99, 0.5, 1.0)]  # a repeated row, an entity without a block
    df = spark.createDataFrame(rows, "trait string, entity_id long, x double, intercept double")
    blocks = spark.createDataFrame([(e, "ABC"[e % 3], e % 2) for e in range(40)] + [(4, "B", 0), (4, "C", 1), (5, None, 1), (None, "A", 0)], "entity_id long, k string, l int")
    j = blocks.withColumnRenamed("entity_id", "entity_a").join(blocks.withColumnRenamed("entity_id", "entity_b"), ["k", "l"])
    edges = j.select("entity_a", "entity_b", F.when(F.col("entity_a") == F.col("entity_b"), 1.0).otherwise(0.3).alias("r"))
    key = lambda d: {r.trait: (r.c_0_0, r.c_0_1, r.c_1_1) for r in d.collect()}
    want, got = key(grouped.correlated_sums(df, ["x", "intercept"], ["trait"], edges)), key(grouped.block_sums(df, ["x", "intercept"], ["trait"], blocks, 0.3))
    assert got.keys() == want.keys() and all(np.allclose(got[t], want[t], atol=1e-9) for t in want)


def test_a_large_block_forms_no_pairs(spark):
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("entity_id"), F.lit("t").alias("trait"), (F.col("id") % 10).cast("double").alias("x"), F.sin("id").alias("y"))
    r = grouped.sandwich_ols(df, ["x"], "y", ["trait"], blocks=df.select("entity_id", F.lit("one").alias("x")), rho=0.3).where("term = 'x'").first()
    x = np.arange(n) % 10 - 4.5  # centred, so the block's sum is zero
    assert abs(r.se - (0.7 / (x @ x)) ** 0.5) < 1e-9
