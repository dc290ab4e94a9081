"""Embedding near-dedup: vectors of equal label whose cosine in double precision is 0.93 or more.

Equal vectors of a label form a class with a count, and only classes are compared, tile by tile. In
a tile every unit vector u is rounded to int8 with a scale of its own, u = q / s + e. The products of
the int8 tiles are exact sums of integers (kept in float32 they stay below 2**24; longer vectors are
summed in pieces), and |u.v - (q/s).(q'/s')| <= |e|(1+|e'|) + |e'|(1+|e|) + |e||e'| bounds the error
of each pair rigorously. Only pairs whose upper bound reaches the threshold are computed again in
double precision. A tile returns the number of links of each of its classes and a spanning forest of
them, never all pairs.

A label of more than `TILE` classes is cut into blocks. The angle of a vector to a fixed direction
differs by no more than acos(0.93) between linked vectors, so blocks lie on rungs of that width and
only neighbouring rungs meet. Within a label the work still grows with the square of what lies on a
few rungs; it is spread over tasks of bounded size.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label, link with nothing and are components of their own; vectors of different lengths
never link; repeated rows and ids are rows of their own; cosines that equal the threshold link; vectors of
any length are compared whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import components, forest, materialize, own, row_id, table, tiles

THRESHOLD = 0.93
TILE = 3000
STRIP = 512
PIECE = 1024


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales and the norms of what rounding took away."""
    scale = 127 / np.abs(v).max(1, keepdims=True)
    q = np.rint(v * scale).astype(np.int8)
    return q, scale, np.linalg.norm(v - q / scale, axis=1)


def pairs_above(v: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float):
    """(i, j) positions in v of linked vectors, i in x and j in y, each pair once; strip by strip. Cosines are those of the given vectors."""
    norm = np.linalg.norm(v, axis=1)
    q, scale, error = quantised(v / norm[:, None])
    rows, cols = np.flatnonzero(x), np.flatnonzero(y)
    right = [q[cols, p : p + PIECE].astype(np.float32).T for p in range(0, v.shape[1], PIECE)]
    for at in range(0, len(rows), STRIP):
        own_rows = rows[at : at + STRIP]
        dots = sum(q[own_rows, k * PIECE : (k + 1) * PIECE].astype(np.float32) @ r for k, r in enumerate(right))
        e, f = error[own_rows][:, None], error[cols][None, :]
        upper = dots / (scale[own_rows] * scale[cols].T) + (e * (1 + f) + f * (1 + e) + e * f)
        i, j = np.nonzero(upper >= threshold - 1e-9)
        i, j = own_rows[i], cols[j]
        once = (i != j) & ((i < j) | ~(x[j] & y[i]))
        i, j = i[once], j[once]
        for part in range(0, len(i), 1 << 16):
            a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            cosine = np.einsum("ij,ij->i", v[a], v[b]) / (norm[a] * norm[b])
            yield a[cosine >= threshold], b[cosine >= threshold]


def tile_links(threshold: float):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        uid, many, block = (tile[c].to_numpy() for c in ("uid", "many", "block"))
        v = np.stack(tile["embedding"].to_numpy()).astype(np.float64)
        count, a, b = np.zeros(len(uid), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in pairs_above(v, block == tile["x"].iloc[0], block == tile["y"].iloc[0], threshold):
            np.add.at(count, i, many[j])
            np.add.at(count, j, many[i])
            a, b = forest(np.concatenate([a, uid[i]]), np.concatenate([b, uid[j]]))
        has = np.flatnonzero(count)
        edges = pd.DataFrame({"a": a, "b": b, "n": 0})
        return pd.concat([edges, pd.DataFrame({"a": uid[has], "b": uid[has], "n": count[has]})])

    return run


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding, label)."""
    v = F.col("embedding")
    fine = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = own(embeddings, "vec_id", "embedding", "label").withColumn("fine", F.coalesce(fine, F.lit(False)))
    # equal labels and vectors share a key; its 16 bytes stand for them from here on
    rows = rows.withColumn("class", F.when(F.col("fine"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform(v, lambda x: F.when(x == 0, F.lit(0).cast("float")).otherwise(x).cast("string"))), 256)))
    classes = rows.where("fine").groupBy("class").agg(F.first("embedding").alias("embedding"), F.first("label").alias("label"), F.count("*").alias("many"), F.min("vec_id").alias("first"))
    classes = materialize(classes.select(row_id(), "*"), "vectors")
    width = math.acos(threshold) + 1e-6
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda s, x: F.struct((s["s"] + x).alias("s"), (s["q"] + x * x).alias("q")), lambda s: s["s"] / F.sqrt(s["q"]))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / F.sqrt(F.size("embedding").cast("double")))))
    place = tiles(classes.select("uid", F.concat_ws("/", "label", F.size("embedding")).alias("group"), F.floor(angle / width).cast("long").alias("angle")), "group", F.col("angle"), TILE).drop("angle")
    work = place.join(classes.select("uid", "many", "embedding"), "uid")
    found = materialize(work.groupBy("group", "x", "y").applyInPandas(tile_links(threshold), "a long, b long, n long"), "links")
    parts = components(found.where("a <> b").select("a", "b"))
    counts = found.where("a = b").groupBy("a").agg(F.sum("n").alias("n"))
    label = classes.join(parts, classes["uid"] == parts["node"], "left").join(counts, classes["uid"] == counts["a"], "left")
    label = label.select("class", "first", F.coalesce("component", "uid").alias("part"), (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    smallest = label.groupBy("part").agg(F.min("first").alias("component_id"))
    named = label.join(smallest, "part").select("class", "n_links", "component_id")
    out = rows.select("vec_id", "class").join(named, "class", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
