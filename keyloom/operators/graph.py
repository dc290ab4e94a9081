"""Reference graphs: reachability, garbage collection, replication.

A closure is a loop over frontiers. The edges are written once, as they come: repeated ones cost less
than a shuffle that finds them. Each round joins the newest nodes with them and drops what is known or
excluded; a small frontier is broadcast, and rounds are as many as the graph is deep. Every round is written, which keeps plans short and survives
lost executors.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NoRoots(ValueError):
    """Garbage collection without roots would delete everything."""


def checkpoint(df: DataFrame) -> DataFrame:
    """df written as Parquet into the folder that the cluster shares (spark.checkpoint.dir) and read back; a session inside one process may do without."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/keyloom-checkpoints"
    path = f"{folder.rstrip('/')}/keyloom/{spark.sparkContext.applicationId}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(roots: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """node: all that is reachable from roots (node) over edges (src, dst), roots included; nodes in stop are neither kept nor passed."""

    def allowed(nodes: DataFrame) -> DataFrame:
        return nodes if stop is None else nodes.join(stop, "node", "left_anti")

    edges = checkpoint(edges.select("src", "dst"))
    frontier = checkpoint(allowed(roots.select("node").distinct()))
    known = frontier
    while not frontier.isEmpty():
        step = edges.join(frontier.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        frontier = checkpoint(allowed(step).join(known, "node", "left_anti"))
        known = known.union(frontier)
    return known


def dead(candidates: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates (node, from the summary index, never from a raw scan) that no root reaches."""
    if roots.isEmpty():
        raise NoRoots("no roots")
    return candidates.join(closure(roots, edges), "node", "left_anti")


def push(roots: DataFrame, edges: DataFrame, destination: DataFrame) -> DataFrame:
    """Nodes to copy so that destination (node) holds the closure of roots: what it has is not looked into."""
    return closure(roots, edges, destination)


def sweep(objects: DataFrame, candidates: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects (node, ...) without the candidates that no root reaches."""
    return objects.join(dead(candidates, roots, edges), "node", "left_anti")


def copy(source: DataFrame, destination: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """destination (node, ...) with what push() plans added from source (same columns); a planned node that source lacks is an error."""
    plan = push(roots, edges, destination.select("node"))
    missing = plan.join(source.select("node"), "node", "left_anti").limit(1).collect()
    if missing:
        raise LookupError(f"{missing[0]['node']} is referred to and not in the source")
    return destination.unionByName(source.join(plan, "node", "left_semi").select(*destination.columns))
