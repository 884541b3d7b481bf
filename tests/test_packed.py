"""Packed products against the long join, and what they shuffle."""
import pytest
from pyspark.sql import functions as F

from evisets.operators import joint, packed, shrink


def wide(spark, entities=60, sets=12, traits=70):
    """Every entity in every set, but few values for the last traits, and one null."""
    m = spark.range(sets).withColumnRenamed("id", "set_id").crossJoin(spark.range(entities).withColumnRenamed("id", "entity_id")).withColumn(
        "weight", 1.0 + F.col("set_id") * 0.5 + F.col("entity_id") % 3)
    y = spark.range(entities).withColumnRenamed("id", "entity_id").crossJoin(spark.range(traits).withColumnRenamed("id", "trait"))
    y = y.where("trait < 40 or entity_id = trait % 7").withColumn("value", F.when(F.col("trait") != 66, F.sin(F.col("entity_id") + F.col("trait"))))
    return m, y


def written(spark):
    """Rows that all stages so far have shuffled."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_sums_over_entities_equal_the_long_join(spark):
    m, y = wide(spark)
    m = m.where("entity_id <> 3 or set_id > 5")
    axis = packed.name_axis(y, ["trait"])
    assert axis.width == 24  # 70 names in three rows
    got = rows(packed.unpack(packed.sum_over_entities(m, packed.pack(y, ["entity_id"], axis, "value"), ["set_id"]), "xy"), "set_id", "trait")
    want = rows(m.join(y, "entity_id").groupBy("set_id", "trait").agg(F.sum(F.col("weight") * F.col("value")).alias("xy")), "set_id", "trait")
    assert got.keys() == want.keys() and (6, 66) in got and (0, 45) not in got  # 45 and 66 are at entity 3 only, 66 is null
    for k, r in want.items():
        assert got[k].xy is None if r.xy is None else abs(got[k].xy - r.xy) < 1e-9


def test_sums_over_entities_in_ranges_equal_the_long_join(spark, monkeypatch):
    """Ranges of entities: the same rows and values, with nulls in keys, values and weights, keys besides the entity, and tables to be added up."""
    m, y = wide(spark)
    m = m.where("entity_id <> 3 or set_id > 5").withColumn("weight", F.when(~((F.col("set_id") == 2) & (F.col("entity_id") < 30)), F.col("weight")))
    m = m.unionByName(m.where("set_id = 4").withColumns({"set_id": F.lit(None).cast("long"), "weight": F.lit(2.0)}))
    m = m.unionByName(m.where("set_id = 5").limit(3).withColumn("entity_id", F.lit(None).cast("long")))
    y = y.unionByName(y.where("entity_id = 9").withColumn("entity_id", F.lit(None).cast("long"))).where("entity_id is null or entity_id <> 12")
    y = y.withColumn("fold", (F.col("entity_id") % 2).cast("string"))
    axis = packed.name_axis(y, ["trait"])
    monkeypatch.setattr(packed, "BLOCK", 100)
    member, heavy = packed.in_blocks(m)
    assert heavy is None and member.select("_blk").distinct().count() > 3 and member.drop("_blk").exceptAll(m).isEmpty()
    assert member.groupBy("entity_id").agg(F.countDistinct("_blk").alias("n")).where("n > 1").isEmpty()
    values = packed.with_blocks(packed.pack(y, ["entity_id", "fold"], axis, "value"), member)
    twice = packed.union([values, values])
    got = rows(packed.unpack(packed.sum_over_entities(member, twice, ["set_id", "fold"]), "xy"), "set_id", "fold", "trait")
    want = rows(m.join(y, "entity_id").groupBy("set_id", "fold", "trait").agg(F.sum(2 * F.col("weight") * F.col("value")).alias("xy")), "set_id", "fold", "trait")
    assert got.keys() == want.keys() and (None, "0", 0) in got
    for k, r in want.items():
        assert got[k].xy is None if r.xy is None else abs(got[k].xy - r.xy) < 1e-9


def test_a_range_with_a_popular_entity_is_split_instead(spark, monkeypatch):
    from evisets.plans import iterate

    m, _ = wide(spark)
    monkeypatch.setattr(packed, "BLOCK", 100)
    monkeypatch.setattr(iterate, "HEAVY", 10)
    member, heavy = packed.in_blocks(m)
    assert "_blk" not in member.columns and heavy.count() == 60


def test_correlation_products_in_ranges(spark, monkeypatch):
    m, _ = wide(spark, 40, 8)
    m = m.where("(entity_id + set_id) % 3 > 0")
    b = spark.range(8).selectExpr("id as set_id", "'t' as trait", "cos(id) as beta", "0.5D + id as scale", "0.1D as mean")
    n = F.lit(40.0)
    want = rows(shrink.correlation_product(m, b, n), "set_id", "trait")
    monkeypatch.setattr(packed, "BLOCK", 50)
    member, heavy = packed.in_blocks(m)
    got = rows(shrink.correlation_product(member, b, n, heavy=heavy), "set_id", "trait")
    assert "_blk" in member.columns and got.keys() == want.keys() and max(abs(got[k].v_beta - want[k].v_beta) for k in want) < 1e-9


@pytest.mark.parametrize("cells,passes", [(10 ** 9, 8), (500, 8), (30, 8), (30, 1)])
def test_sums_over_sets_are_the_same_in_any_number_of_passes(spark, monkeypatch, cells, passes):
    monkeypatch.setattr(packed, "CELLS", cells)
    monkeypatch.setattr(packed, "PASSES", passes)
    m, _ = wide(spark, 20, 10)
    m = m.withColumn("fold", F.when(F.col("entity_id") != 7, F.col("entity_id") % 3))
    b = spark.range(10).withColumnRenamed("id", "set_id").withColumns({"fold": F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))), "trait": F.explode(F.sequence(F.lit(0), F.lit(4)))}).withColumn(
        "b", F.cos(F.col("set_id") * 7 + F.col("fold") * 3 + F.col("trait")))
    axis = packed.name_axis(b, ["trait"])
    own = packed.unpack(packed.sum_over_sets(m, packed.pack(b, ["set_id", "fold"], axis, "b"), ["entity_id", "fold"]), "x")
    want = rows(m.join(b, ["set_id", "fold"]).groupBy("entity_id", "fold", "trait").agg(F.sum(F.col("weight") * F.col("b")).alias("x")), "entity_id", "fold", "trait")
    other = packed.unpack(packed.sum_over_sets(m.withColumnRenamed("fold", "_own"), packed.pack(b, ["set_id", "fold"], axis, "b"), ["entity_id", "fold"], "_own <> fold or _own is null"), "x")
    rest = rows(m.withColumnRenamed("fold", "_own").join(b, "set_id").where("_own <> fold or _own is null").groupBy("entity_id", "fold", "trait").agg(
        F.sum(F.col("weight") * F.col("b")).alias("x")), "entity_id", "fold", "trait")
    for have, must in ((rows(own, "entity_id", "fold", "trait"), want), (rows(other, "entity_id", "fold", "trait"), rest)):
        assert have.keys() == must.keys() and max(abs(have[k].x - must[k].x) for k in must) < 1e-9


@pytest.fixture
def many_tasks(spark):
    """As at size: tasks are many against the members of a set, tables are too large for Spark to broadcast by itself."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_products_of_memberships_and_traits_are_not_shuffled(spark, many_tasks, tmp_path):
    spark.range(10_000).select((F.col("id") % 1000).alias("set_id"), F.pmod(F.xxhash64("id"), F.lit(300)).alias("entity_id"), F.lit(1.0).alias("weight")).write.parquet(str(tmp_path / "m"))
    spark.range(300).withColumnRenamed("id", "entity_id").withColumn("trait", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn(
        "value", F.sin(F.col("entity_id") * 13 + F.col("trait"))).write.parquet(str(tmp_path / "y"))
    m, y = (spark.read.parquet(str(tmp_path / k)) for k in "my")
    n, products = F.lit(300.0), 10_000 * 25

    def shuffled(df):
        before = written(spark)
        df().write.format("noop").mode("overwrite").save()
        return written(spark) - before

    stats = lambda: shrink.with_hyper(shrink.marginal_linear(m, y, n), 0.2, 0.001, -1.0)
    assert shuffled(stats) < 0.5 * products
    fits = stats().localCheckpoint()
    parity = m.select("set_id", (F.col("set_id") % 2).cast("int").alias("cls")).distinct()
    assert shuffled(lambda: joint.shrink_sweeps(m, fits, n, classes=parity, sweeps=2, tol=0.0)) < 2 * products
