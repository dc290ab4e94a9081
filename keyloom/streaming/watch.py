"""Change tracking: the latest change of every path and what is below it.

A maximum is associative and commutative, so late and repeated events need no watermark: the streaming
form in complete mode gives at any time what the batch form gives over the events so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType, TimestampType

from keyloom.functions import paths


def rollup(events: DataFrame) -> DataFrame:
    """Events (path, ts), batch or streaming -> path, last_change for each path and each of its ancestors."""
    return events.select(F.explode(paths.ancestors("path", itself=True)).alias("path"), "ts").groupBy("path").agg(F.max("ts").alias("last_change"))


def not_changed(probes: DataFrame, latest: DataFrame, since) -> DataFrame:
    """probes (path) with unchanged: known and last changed strictly before `since`; unknown paths are false."""
    out = probes.join(latest, "path", "left")
    return out.select("path", F.coalesce(F.col("last_change") < F.lit(since), F.lit(False)).alias("unchanged"))


def watch(events: DataFrame, query_name: str, max_delay: str = "1 second", on_updated: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Start the streaming rollup. With on_updated, it is called with what changed, at most once per max_delay; else the result is the memory table query_name."""
    out = rollup(events).writeStream.queryName(query_name).trigger(processingTime=max_delay)
    if checkpoint:
        out = out.option("checkpointLocation", checkpoint)
    if on_updated:
        return out.outputMode("update").foreachBatch(on_updated).start()
    return out.outputMode("complete").format("memory").start()


def read_changes(spark, folder: str, per_batch: int = 1) -> DataFrame:
    """A stream of event files (path, ts) in a folder."""
    return spark.readStream.schema("path string, ts timestamp_ntz").option("maxFilesPerTrigger", per_batch).parquet(folder)


def is_time(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (TimestampType, TimestampNTZType))
