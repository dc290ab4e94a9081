"""Sorted sets of keys, and their packing into ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.operators.entity import minus

PACK = 48
RANGE = 4096


def add(keys: DataFrame, new: DataFrame) -> DataFrame:
    return keys.union(new).distinct()


def delete(keys: DataFrame, gone: DataFrame) -> DataFrame:
    return minus(keys, gone)


def has(probe: DataFrame, keys: DataFrame) -> DataFrame:
    return probe.join(keys.select(*[F.col(c).alias(f"_{c}") for c in keys.columns]), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys.columns]), "left_semi")


def iterate(keys: DataFrame) -> DataFrame:
    return keys.orderBy(*keys.columns)


def positions(keys: DataFrame, key: str = "key") -> DataFrame:
    """Adds `position`, 0 for the smallest key: counts by range partition, then a window within each, so no task holds all keys."""
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = keys.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id())
    ranged = ranged.withColumn("inside", F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1)
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min(key).alias("low"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return ranged.join(before.select("part", "before"), "part").select(*keys.columns, (F.col("before") + F.col("inside")).cast("long").alias("position"))


def pack(keys: DataFrame, key: str = "key", threshold: int = PACK, height: int = 2) -> DataFrame:
    """Runs of `threshold` neighbouring keys from the left: height, pack, min_key, max_key, n. A shorter rest stays unpacked and is left out."""
    placed = positions(keys, key).withColumn("pack", F.floor(F.col("position") / threshold).cast("long"))
    packs = placed.groupBy("pack").agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("n")).where(F.col("n") == threshold)
    return packs.withColumn("height", F.lit(height))


def pack_all(keys: DataFrame, key: str = "key", threshold: int = PACK) -> list[DataFrame]:
    """Packs, packs of packs, ... until fewer than `threshold` remain: a frame for each height."""
    levels = [pack(keys, key, threshold, 2)]
    while levels[-1].count() >= threshold:
        upper = pack(levels[-1].select(F.col("min_key").alias("key"), F.col("max_key").alias("last")), "key", threshold, len(levels) + 2)
        levels.append(upper)
    return levels
