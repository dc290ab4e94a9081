"""Named values in a small table; the newest of a name counts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key string, value string, version long"


class NotFound(LookupError):
    pass


def set_value(variables: DataFrame, key: str, value: str) -> DataFrame:
    version = (variables.agg(F.max("version")).first()[0] or 0) + 1
    return variables.unionByName(variables.sparkSession.createDataFrame([(key, value, version)], SCHEMA))


def get_value(variables: DataFrame, key: str) -> str:
    row = variables.where(F.col("key") == key).agg(F.max_by("value", "version").alias("v"), F.count("*").alias("n")).first()
    if not row["n"]:
        raise NotFound(key)
    return row["v"]


class Variables:
    """Variables that stay: a Parquet folder to which every set() appends."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).option("ignoreMissingFiles", True).parquet(self.folder)

    def set(self, key: str, value: str) -> None:
        self.spark.createDataFrame([(key, value, time.time_ns())], SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def get(self, key: str) -> str:
        return get_value(self.table(), key)
