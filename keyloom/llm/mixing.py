"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts, repeated epochs.

Every document gets a key that depends on a seed, its id and its text only. The rows are sorted by
range on (source, key), so a source with a third of all rows is spread over a third of the ranges.
Each range sums its words from its beginning within a source as it passes; the totals of the ranges,
a row for each source and range, are small, and their running sums give every range its start. A
source's budget is its target in words: whole epochs first, then the documents whose running sum stays
inside what is left, and the one document on the edge gives the words up to the edge, so a source's
total is exact.

Defined results: null or blank text has size 0 and gives 0 words; a null source is a source of its
own, last in order; rows repeated in full share a key and are cut in either order, which gives the
same rows; texts of any length are counted whole; an empty table gives no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.llm.common import discard, materialize, own, table
from keyloom.operators import keyset

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("-"))), 256)


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sizes: source, source_size. Adds `target`: the total shared by weight; what lies above most * source_size is shared again among the others until nothing does.

    One small aggregate per round; a round ends with more sources at their cap or is the last.
    """
    n = len(weights)
    sizes = materialize(sizes, "sources")
    named = sizes.where("source is not null")
    last = sizes.where("source is null").withColumn("position", F.lit(named.count()).cast("long"))
    placed = keyset.positions(named, "source").unionByName(last)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % n + 1).cast("int")).cast("long")
    weighed = materialize(placed.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap")), "weights")
    discard(sizes)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rest, weight = total, None
    while True:
        # a source is at its cap if its share of the rest, rest * w / weight, lies above it
        capped = F.lit(False) if weight is None else (F.lit(rest).cast("decimal(38,0)") * F.col("weight") >= F.col("cap").cast("decimal(20,0)") * F.lit(weight))
        x = weighed.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        caps, left = x[0] or 0, x[1] or 0
        if (total - caps, left) == (rest, weight) or not left:
            break
        rest, weight = total - caps, left
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(weight or 1))
    return weighed.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(share)).drop("cap", "weight")


def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, source, size, key) in order of source and key -> the range, and the words before each row of its source in the range."""
    part, last, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(2).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(size)])
        source = batch.column(1).to_pylist()
        new = np.array([i == 0 or source[i] != source[i - 1] for i in range(len(source))])
        carried = np.where(np.cumsum(new) == 1, total, 0) if last == (source[0],) else 0
        head = np.maximum.accumulate(np.where(new, np.arange(len(size)), 0))
        inside = before[:-1] - before[head] + carried
        total, last = int(inside[-1] + size[-1]), (source[-1],)
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(np.full(len(size), part, np.int32)), pa.array(inside)], ["doc_id", "source", "size", "part", "inside"])


def mix(documents: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents (doc_id, text, source)."""
    rows = materialize(own(documents, "doc_id", "text", "source").select("doc_id", "source", size_of(F.col("text")).alias("size"), order_key(seed).alias("key")), "sizes")
    kind = rows.schema["source"].dataType.simpleString()
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(ranges, "source", "key").sortWithinPartitions("source", "key", "doc_id", "size")
    placed = materialize(ordered.mapInArrow(running, f"doc_id long, source {kind}, size long, part int, inside long"), "ranges")
    discard(rows)
    sums = materialize(placed.groupBy("source", "part").agg(F.sum("size").alias("words")), "sums")  # at most sources + ranges rows
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    starts = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.join(plan, starts["source"].eqNullSafe(plan["source"])).select(starts["source"], "part", F.coalesce("before", F.lit(0)).alias("before"), "source_size", "target")
    starts = starts.toDF("s", "p", "before", "source_size", "target")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    left = budget - epochs * F.col("source_size") - F.col("before") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.join(starts, placed["source"].eqNullSafe(starts["s"]) & (placed["part"] == starts["p"])).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  sha256(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, '-'), coalesce(text, '-'))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
r AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS k FROM w),
p AS (SELECT *, coalesce(sum(cap) OVER o, 0)::BIGINT AS caps, coalesce(sum(weight) OVER o, 0)::BIGINT AS used, (SELECT sum(source_size) FROM w)::BIGINT AS total, (SELECT sum(weight) FROM w)::BIGINT AS weights
      FROM r WINDOW o AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (SELECT caps, used, total, weights, k FROM p WHERE (total - caps)::HUGEINT * weight < cap::HUGEINT * (weights - used) ORDER BY k LIMIT 1),
t AS (SELECT r.source, r.source_size, CASE WHEN r.k < first.k THEN cap::DOUBLE ELSE (total - caps)::DOUBLE * r.weight / (weights - used)::DOUBLE END AS target FROM r, first),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken FROM o
"""
