"""File trees as rows: build, size, merge, difference, update, equality, packing.

A tree is a DataFrame: path ('' is the root), is_dir, size, mode, mod_time and, for files, contents. Names
sort by bytes. Trees are complete rows, so laziness becomes predicates on parents and ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions import paths

PACK = 128
STAT = ("is_dir", "size", "mode", "mod_time")


def build(files: DataFrame) -> DataFrame:
    """Files (path, size) -> every node with its tree size (sum of sizes below) and weight (nodes below and itself)."""
    nodes = files.select(F.explode(paths.ancestors("path", itself=True)).alias("path"), "size", F.col("path").alias("leaf"))
    sums = nodes.groupBy("path").agg(F.sum("size").cast("long").alias("tree_size"), F.count("*").alias("n_files"), F.max(F.col("path") != F.col("leaf")).alias("is_dir"))
    below = sums.select(F.explode(paths.ancestors("path", itself=True)).alias("path")).where("path is not null").groupBy("path").agg(F.count("*").alias("weight"))
    return sums.join(below, "path").select("path", "is_dir", "tree_size", "n_files", "weight")


def with_directories(files: DataFrame) -> DataFrame:
    """Files and a row for each directory above them; a directory's mod_time is the latest below, its size 0."""
    above = files.select(F.explode(paths.ancestors("path")).alias("path"), "mod_time").groupBy("path").agg(F.max("mod_time").alias("mod_time"))
    return files.select("path", F.lit(False).alias("is_dir"), "size", "mode", "mod_time").unionByName(above.select("path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mode"), "mod_time"))


def sides(tree: DataFrame, side: str) -> DataFrame:
    return tree.select("path", F.struct(*[c for c in tree.columns if c != "path"]).alias(side))


def zip_flat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge of two trees: path, a, b, status ('both', 'a', 'b')."""
    status = F.when(F.col("a").isNull(), "b").when(F.col("b").isNull(), "a").otherwise("both")
    return sides(a, "a").join(sides(b, "b"), "path", "full_outer").select("path", "a", "b", status.alias("status"))


def zip_trees(a: DataFrame, b: DataFrame, expand: Column | None = None) -> DataFrame:
    """Merge of two lazily expanded trees: what is below a node that only one side has is not listed.

    A row stays if its parent is on both sides. `expand`, a predicate over columns a and b of a pair of
    directories, stops the descent where it is false: no row has such an ancestor.
    """
    rows = zip_flat(a, b).withColumn("dir", F.when(F.col("path") == "", F.lit(None)).otherwise(paths.parent("path")))
    both = rows.where("status = 'both'").select(F.col("path").alias("dir"))
    kept = rows.where("dir is null").unionByName(rows.where("dir is not null").join(both, "dir", "left_semi").select(rows.columns))
    if expand is not None:
        closed = rows.where("status = 'both' and a.is_dir and b.is_dir").where(~expand).select(F.col("path").alias("above"))
        under = kept.select("path", F.explode(paths.ancestors("path")).alias("above")).where("path <> above").join(closed, "above", "left_semi").select("path").distinct()
        kept = kept.join(under, "path", "left_anti")
    return kept.select("path", "a", "b", "status")


def unzip(zipped: DataFrame, side: str) -> DataFrame:
    """One side's tree."""
    return zipped.where(F.col(side).isNotNull()).select("path", f"{side}.*")


def reverse(zipped: DataFrame) -> DataFrame:
    """a and b swapped."""
    status = F.when(F.col("status") == "a", "b").when(F.col("status") == "b", "a").otherwise("both")
    return zipped.select("path", F.col("b").alias("a"), F.col("a").alias("b"), status.alias("status"))


def same_stat(columns: tuple[str, ...] = STAT) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out


def update(old: DataFrame, new: DataFrame, unchanged: DataFrame | None = None, stat: tuple[str, ...] = STAT) -> DataFrame:
    """path, action, from old and new tree.

    add: every node of a new subtree. delete: the root of a subtree that is gone, once. reuse: files of
    equal stat, or directories that `unchanged` (path) names, whose subtrees are then not looked into.
    dir: other pairs of directories of equal stat. modify: pairs of unequal stat.
    """
    rows = zip_flat(old, new).withColumn("dir", F.when(F.col("path") == "", F.lit(None)).otherwise(paths.parent("path")))
    here = rows.select(F.col("path").alias("dir"), F.col("a").isNotNull().alias("old_parent"), F.col("b").isNotNull().alias("new_parent"))
    rows = rows.join(here, "dir", "left")
    top = F.col("dir").isNull()
    action = (
        F.when(F.col("a").isNull(), "add")
        .when(F.col("b").isNull(), F.when(top | F.coalesce("new_parent", F.lit(False)), "delete"))
        .when(F.col("a.is_dir") & F.col("b.is_dir"), F.when(same_stat(stat), "dir").otherwise("modify"))
        .otherwise(F.when(same_stat(stat), "reuse").otherwise("modify"))
    )
    rows = rows.select("path", "a", "b", action.alias("action")).where("action is not null")
    if unchanged is not None:
        calm = unchanged.select(F.col("path").alias("above"))
        under = rows.select("path", F.explode(paths.ancestors("path")).alias("above")).where("path <> above").join(calm, "above", "left_semi").select("path").distinct()
        rows = rows.join(under, "path", "left_anti")
        mark = unchanged.select("path", F.lit(True).alias("calm"))
        pair = F.coalesce("calm", F.lit(False)) & F.col("a.is_dir") & F.col("b.is_dir")
        rows = rows.join(mark, "path", "left").withColumn("action", F.when(pair, "reuse").otherwise(F.col("action"))).drop("calm")
    return rows.select("path", "action", "a", "b")


def updated_tree(changes: DataFrame) -> DataFrame:
    """The tree after update(): reused nodes from the old side (their contents are not read again), others from the new one."""
    pick = F.when(F.col("action") == "reuse", F.col("a")).otherwise(F.col("b"))
    return changes.where("action <> 'delete'").select("path", pick.alias("n")).select("path", "n.*")


def differences(a: DataFrame, b: DataFrame, checks: tuple[str, ...] = (*STAT, "content_hash")) -> DataFrame:
    """path and the first check that fails: missing, then each of checks in order. No rows: the trees are equal."""
    reason = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing")
    for c in checks:
        reason = reason.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c)
    return zip_flat(a, b).select("path", reason.alias("reason")).where("reason is not null")


def equal(a: DataFrame, b: DataFrame, checks: tuple[str, ...] = (*STAT, "content_hash")) -> bool:
    return differences(a, b, checks).isEmpty()


def find(tree: DataFrame, path: str) -> DataFrame:
    return tree.where(F.col("path") == path)


def children(tree: DataFrame, path: str) -> DataFrame:
    """Nodes directly in a directory, by name."""
    return tree.where((paths.parent("path") == path) & (F.col("path") != "")).orderBy("path")


def pack(tree: DataFrame, threshold: int = PACK) -> DataFrame:
    """Children of each directory in runs of `threshold` by name: dir, pack, min, max, size, n, height 2. Shorter rests stay unpacked; a directory of more children is ordered within itself."""
    nodes = tree.where("path <> ''").select(paths.parent("path").alias("dir"), paths.name("path").alias("name"), "size")
    w = Window.partitionBy("dir").orderBy("name")
    runs = nodes.withColumn("pack", F.floor((F.row_number().over(w) - 1) / threshold).cast("long"))
    packs = runs.groupBy("dir", "pack").agg(F.min("name").alias("min"), F.max("name").alias("max"), F.sum("size").cast("long").alias("size"), F.count("*").alias("n"))
    return packs.where(F.col("n") == threshold).withColumn("height", F.lit(2))


def upsert(tree: DataFrame, new: DataFrame) -> DataFrame:
    """tree with the nodes of new put into their directories: a node of the same path is replaced."""
    rows = tree.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    every = [c for c in tree.columns if c != "path"]
    picked = rows.groupBy("path").agg(F.min_by(F.struct(*every), "_old").alias("n"))
    return picked.select("path", "n.*").select(*tree.columns)


def without_ignored(tree: DataFrame, ignored: DataFrame) -> DataFrame:
    """tree without the paths in ignored (path) and all below them."""
    gone = ignored.select(F.col("path").alias("above"))
    under = tree.select("path", F.explode(paths.ancestors("path", itself=True)).alias("above")).join(gone, "above", "left_semi").select("path").distinct()
    return tree.join(under, "path", "left_anti")


def walk(tree: DataFrame) -> DataFrame:
    """All nodes in pre-order: a directory before what is in it, siblings by name."""
    return tree.orderBy(F.split("path", "/"))
