"""What the operators share: the shared folder, written intermediate tables, fixed-size filters, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds at most: whole texts are long, and a batch is held twice.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a session inside one process (master local) may do without and gets a folder of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/keyloom"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application inside the shared one; drop_run() deletes it."""
    return f"{shared_dir(spark)}/keyloom/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors, fixes what is not deterministic."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that are no longer referenced now, not when the driver next runs out of heap."""
    gc.collect()
    spark._jvm.System.gc()


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and nothing needs any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def drop_run(spark: SparkSession) -> None:
    """Delete all tables and archives that this application wrote: its results can't be read after that."""
    delete(spark, run_dir(spark))


def own(documents: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns of an input, whatever else it has."""
    return documents.select(*columns)


def row_key(*columns: str) -> Column:
    """128 bits that stand for the values of columns, nulls included: two chained 64-bit hashes that begin differently."""
    nulls = F.concat(*[F.isnull(c).cast("int").cast("string") for c in columns])
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), nulls, *columns)), 16, "0") for k in (1, 2)]))


def row_id() -> Column:
    """A distinct id for every row; stable once the table is written."""
    return F.monotonically_increasing_id().alias("uid")


def bit_filter(df: DataFrame, column: str, bits: int = 25, shifts: tuple[int, ...] = (0,)):
    """Broadcast a bitmap of 2**bits bits (4 MB at 25, whatever the input) of the hashes in `column`; each sets the bit that its digits from every shift on name.

    A membership test on it has no false negatives, so it only spares a shuffle work; with more
    hashes than bits it passes everything on and the exact joins behind it do all the work.
    """
    places = F.array(*[F.shiftright(F.col(column), s).bitwiseAND(F.lit((1 << bits) - 1)) for s in shifts])
    rows = (
        df.select((F.explode(places) if len(shifts) > 1 else places[0]).alias("low"))
        .select(F.shiftright("low", 15).alias("bucket"), F.col("low").bitwiseAND(F.lit(32767)).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()  # at most 2**(bits - 15) rows of 4 KB
    )
    found = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        found[r.bucket << 12 : (r.bucket + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return df.sparkSession.sparkContext.broadcast(found)


def in_filter(found: np.ndarray, h: np.ndarray, shifts: tuple[int, ...] = (0,)) -> np.ndarray:
    out = np.ones(len(h), bool)
    for s in shifts:
        low = (h >> np.uint64(s)) & np.uint64(len(found) * 8 - 1)
        out &= (found[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges a-b: (node, smallest node), without the smallest themselves."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        old = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        if (old == label).all():
            break
        keep = label[x] != label[y]
        x, y = x[keep], y[keep]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the task's edges, folded again whenever they have grown to a few million."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 1 << 21:
            a, b = forest(a, b)
            if len(a) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a = b = np.zeros(0, np.int64)
    a, b = forest(a, b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


#: A forest of at most so many edges is finished in one task.
EDGES_IN_TASK = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a long, b long) by alternating large-star and small-star steps.

    Returns (node, component) with the smallest node of each component as its id; nodes without
    edges do not appear. Each task first folds its edges to a forest. Each step is a grouped minimum
    and a join on a node, so a node with very many neighbours is pre-aggregated and its rows may be
    split over tasks. Steps run on as few partitions as hold EDGES_IN_TASK edges each; what fits into
    one is a forest of whole components already.
    """
    forests = "a long, b long"
    first = materialize(edges.select("a", "b").where("a <> b").mapInArrow(_forests, forests), "edges")
    tasks = -(-first.count() // EDGES_IN_TASK)
    now = materialize(first.coalesce(max(1, tasks)).mapInArrow(_forests, forests), "edges")
    discard(first)
    if tasks <= 1:
        return now.toDF("node", "component")

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m")).where("a <> b")
        new = materialize(small.distinct(), "edges")
        discard(now)
        now, after = new, state(new)
        if after == before:
            return now.toDF("node", "component")
        before = after


def tiles(items: DataFrame, group: str, rung: Column, most: int, weight: str | None = None) -> DataFrame:
    """Spread the comparison of all items (uid, ...) of a group over tasks of bounded size. Give it light rows and join what is compared to its result.

    A group of up to `most` items (or of so much weight in all) is one tile. A larger one is cut into
    blocks by rung and hash of uid, where items that may match lie at most one rung apart; every two
    such blocks share a tile. Adds block, x and y: a row for each tile (group, x, y) that the item's
    block belongs to.
    """
    size = F.sum(weight) if weight else F.count("*")
    whole = items.groupBy(group).agg(size.alias("all"))
    items = items.join(whole, group).withColumn("rung", F.when(F.col("all") > most, rung).otherwise(F.lit(0).cast("long")))
    blocks = items.groupBy(group, "rung").agg(F.ceil(size * 2 / most).cast("long").alias("blocks"), F.first("all").alias("all"))
    blocks = blocks.withColumn("blocks", F.when(F.col("all") > most, F.col("blocks")).otherwise(F.lit(1).cast("long"))).drop("all")
    steps = (("below", -1), ("same", 0), ("above", 1))
    kept = [c for c in items.columns if c not in ("all", "rung")]
    for name, step in steps:
        items = items.join(blocks.select(group, (F.col("rung") - step).alias("rung"), F.col("blocks").alias(name)), [group, "rung"], "left")

    def place(rung: Column, block: Column) -> Column:
        return rung * F.lit(1 << 32) + block

    def neighbours(name: str, step: int) -> Column:
        # transform() would hand a second parameter of the lambda the index, so the step is bound here
        every = F.transform(F.sequence(F.lit(0).cast("long"), F.col(name) - 1), lambda b: place(F.col("rung") + step, b))
        return F.when(F.col(name).isNotNull(), every).otherwise(F.array().cast("array<bigint>"))

    partners = [neighbours(name, step) for name, step in steps]
    block = place(F.col("rung"), F.pmod(F.xxhash64("uid"), F.col("same")))
    rows = items.select(*kept, block.alias("block"), F.explode(F.concat(*partners)).alias("other"))
    return rows.select(*kept, "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
