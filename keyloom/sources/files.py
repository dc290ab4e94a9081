"""Directories as trees, and files out of trees."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import paths
from keyloom.operators import tree


def below(root: str):
    """The path of a file relative to root, without a leading slash; a path begins with its root, so the first occurrence is it."""
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    return F.ltrim(F.substring(F.col("path"), F.instr("path", base) + F.lit(len(base)), F.length("path")), F.lit("/"))


def scan(spark: SparkSession, root: str, ignore: list[str] = (), restricted: list[str] = ()) -> DataFrame:
    """Files below root: path (relative), is_dir, size, mode, mod_time, and directories above them.

    Contents are not read: the columns that hold them are pruned from the scan. ignore: lines of an ignore file;
    restricted: paths that are left out with all below them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = found.select(below(root).alias("path"), F.col("length").alias("size"), F.lit(0).cast("long").alias("mode"), F.col("modificationTime").cast("timestamp_ntz").alias("mod_time"))
    files = files.where(~paths.ignored("path", list(ignore)))
    if restricted:
        files = tree.without_ignored(files, spark.createDataFrame([(p,) for p in restricted], "path string"))
    return tree.with_directories(files)


def contents(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content, content_hash of the files below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select(below(root).alias("path"), "content", F.sha2("content", 256).alias("content_hash"))


def read_file(tree_rows: DataFrame, path: str) -> bytes:
    """Content of one file of a tree with a content column."""
    row = tree_rows.where(F.col("path") == path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row[0] or b"")


def list_dir(tree_rows: DataFrame, path: str) -> list[str]:
    return [r[0] for r in tree.children(tree_rows, path).select(paths.name("path")).collect()]


def restore(tree_rows: DataFrame, path: str, target: str) -> None:
    """Write one file of a tree to a local path, with its mode and time."""
    row = tree_rows.where(F.col("path") == path).select("content", "mode", F.unix_micros(F.col("mod_time").cast("timestamp")).alias("t")).first()
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with open(target, "wb") as f:
        f.write(bytes(row["content"] or b""))
    os.chmod(target, row["mode"] or 0o644)
    os.utime(target, (row["t"] / 1e6, row["t"] / 1e6))
