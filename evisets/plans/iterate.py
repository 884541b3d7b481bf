"""Lineage control for iterative jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names. A machine-local one would lose data on a cluster, so there is no other."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise reliably and drop the lineage, so that a loop's plan stays flat and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held(df: DataFrame) -> DataFrame:
    """As ``cut``, by a written table: one job, columns stay prunable, and joins know its size, so small tables are broadcast by Spark itself."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """As ``held``, in buckets of the keys, one for each shuffle partition: sums and joins by the keys that read it again move none of its rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"dealt_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name)
    return spark.table(name)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows evenly over the session's shuffle partitions.

    Adaptive execution merges small inputs into few tasks; before a join that multiplies rows that would leave most cores idle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


AXIS = 1000  # names held in one array


def grid(left: DataFrame, names: DataFrame) -> DataFrame:
    """Every row of ``left`` with every row of ``names``, which are rows of a short dimension such as traits, in any number.

    The names are packed into arrays of about AXIS entries; a row of ``left`` meets each array once, by an equi-join on its number.
    """
    slots = max(1, -(-names.count() // AXIS))
    packed = names.withColumn("_slot", F.pmod(F.xxhash64(*names.columns), F.lit(slots)).cast("int")).groupBy("_slot").agg(
        F.collect_list(F.struct(*names.columns)).alias("_names"))
    rows = left.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return rows.join(packed, "_slot").withColumn("_names", F.explode("_names")).select(*left.columns, "_names.*")


HEAVY = 200_000  # rows with one key that a task may join


def heavy_keys(many: DataFrame, key: str) -> DataFrame | None:
    """(key, _parts) of the keys with more than HEAVY rows, stored; None if there are none. Counted once for a table that loops join."""
    heavy = many.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HEAVY)
    heavy = cut(heavy.select(key, F.ceil(F.col("_n") / HEAVY).cast("int").alias("_parts")))
    return None if heavy.isEmpty() else heavy


def split_join(many: DataFrame, few: DataFrame, key: str, by: str, heavy: DataFrame | None) -> DataFrame:
    """``many`` joined with ``few`` on ``key``; rows of a heavy key are dealt over parts by a hash of ``by``, its rows in ``few`` are copied to each."""
    if heavy is None:
        return many.join(few, key)
    left = many.join(heavy, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    right = few.join(heavy, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def by_group(df: DataFrame) -> DataFrame:
    """Broadcast of a table with one row for each group, such as a trait or a fold, to the rows of these groups.

    Joined by shuffle all rows of a group are one task, and adaptive execution keeps that join where few partitions hold rows.
    """
    return F.broadcast(df)


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast a materialised narrow table after counting it; a larger one is joined by shuffle.

    Give it the result of ``cut``: the count then reads stored rows only.
    """
    return F.broadcast(df) if df.count() <= max_rows else df
