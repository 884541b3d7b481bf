"""Error inflation by blocks against the same correlations as an edge table."""
import pytest
from pyspark.sql import functions as F

from evisets.operators import assoc
from evisets.queries import queries


def test_blocks_equal_their_edges_and_nulls_have_no_terms(spark):
    b = spark.createDataFrame([(i, None if i == 7 else "xyz"[i % 3], i % 2) for i in range(12)], "entity_id long, brand string, kind long")
    m = spark.createDataFrame([(s, e, 0.5 + (s * e) % 4) for s in range(4) for e in range(14) if (s + e) % (s + 2)] + [(9, 7, 1.0)],
                              "set_id long, entity_id long, weight double")  # 12 and 13 have no block, set 9 holds 7 only
    other = b.select(F.col("entity_id").alias("entity_b"), "brand", "kind")
    e = b.withColumnRenamed("entity_id", "entity_a").join(other, ["brand", "kind"]).select(
        "entity_a", "entity_b", F.when(F.col("entity_a") == F.col("entity_b"), 1.0).otherwise(0.3).alias("r"))
    want = {r.set_id: r.factor for r in assoc.error_inflation(m, e, F.lit(20.0)).collect()}
    got = {r.set_id: r.factor for r in assoc.error_inflation_blocks(m, b, F.lit(20.0), 0.3).collect()}
    assert set(got) == {0, 1, 2, 3} and got == pytest.approx(want, abs=1e-12) and max(got.values()) > 1.0


def test_query_reads_the_parts_of_a_block_once(spark, capsys):
    queries()["assoc_error_inflation"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert sum("FileScan" in line and "p_brand" in line for line in plan.splitlines()) == 1  # twice where pairs of parts are formed
