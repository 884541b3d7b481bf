"""Overlap of sets by arrays of an entity's sets against the long join."""
from pyspark.sql import functions as F

from evisets.operators import sets


def members(spark):
    rows = [(s, e, float(s % 3 + e)) for s in range(40) for e in range(12) if (s * e) % 5 < 2 or e == 1]  # 1 is in every set
    return spark.createDataFrame([*rows, (3, 1, 2.5), (4, 2, None), (5, None, 1.0)], "set_id long, entity_id long, weight double")


def long_join(a, b):
    a = a.select(F.col("set_id").alias("set_a"), "entity_id", F.col("weight").alias("w_a"))
    b = b.select(F.col("set_id").alias("set_b"), "entity_id", F.col("weight").alias("w_b"))
    return {(r.set_a, r.set_b): r.dot for r in a.join(b, "entity_id").where("set_a <> set_b").groupBy("set_a", "set_b").agg(
        F.sum(F.col("w_a") * F.col("w_b")).alias("dot")).collect()}


def test_overlap_equals_the_long_join(spark, monkeypatch):
    monkeypatch.setattr(sets, "SIDE", 8)  # the sets of entity 1 take several arrays
    m = members(spark)
    few = m.where("set_id < 30 and set_id % 4 = 1")
    moments = sets.set_moments(m, F.lit(50.0))
    for left, right in ((m, m), (m, few), (few, m)):
        got = sets.set_overlap(left, right, moments).collect()
        want = long_join(left, right)
        assert len(got) == len(want) > 200
        for r in got:
            dot = want[r.set_a, r.set_b]
            assert r.dot is dot is None or abs(r.dot - dot) < 1e-9


def test_pairs_of_sets_are_not_shuffled_by_entity(spark, capsys):
    m = members(spark)
    sets.set_overlap(m, m, sets.set_moments(m, F.lit(50.0))).explain()
    plan = capsys.readouterr().out.replace(" ", "")
    assert "hashpartitioning(set_a#" in plan
    assert not [x for x in plan.split("hashpartitioning(")[1:] if x.startswith("set_a#") and "set_b#" in x.split(")")[0]]
