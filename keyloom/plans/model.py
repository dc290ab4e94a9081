"""The tables in terms of the model: entities, references, indexes, trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.hashing import content_hash
from keyloom.operators.index import IndexSpec

#: (table, its key, the column that refers, the table referred to): the foreign keys are the references.
EDGES = [
    ("lineitem", "l_orderkey", "l_orderkey", "orders"),
    ("lineitem", "l_orderkey", "l_partkey", "part"),
    ("lineitem", "l_orderkey", "l_suppkey", "supplier"),
    ("orders", "o_orderkey", "o_custkey", "customer"),
    ("customer", "c_custkey", "c_nationkey", "nation"),
    ("supplier", "s_suppkey", "s_nationkey", "nation"),
    ("nation", "n_nationkey", "n_regionkey", "region"),
    ("labels", "doc_id", "doc_id", "documents"),
]
#: The column whose value names an entity of a table; rows that share it are parts of one entity.
KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": "l_orderkey",
    "events": "event_id",
    "documents": "doc_id",
    "embeddings": "vec_id",
    "pages": "page_id",
    "benchmark": "item_id",
    "labels": "doc_id",
    "conversations": "conv_id",
}
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
PART_INDEX = IndexSpec("part_shape", (("p_brand", "string"), ("p_type", "string"), ("p_size", "int")))
ORDER_INDEX = IndexSpec("order_status", (("o_orderstatus", "string"), ("o_orderdate", "timestamp_ntz")))
SEGMENT_INDEX = IndexSpec("segment", (("c_mktsegment", "string"),))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(ns: str, column: str) -> Column:
    return F.concat(F.lit(f"{ns}:"), F.col(column).cast("string"))


def edges(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """(src, dst) of the references of the given tables, or of all, each once."""
    return repeated_edges(spark, sf_dir, *tables).distinct()


def repeated_edges(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """The same, an edge for each row that refers."""
    parts = [table(spark, sf_dir, t).select(node(t, k).alias("src"), node(to, c).alias("dst")) for t, k, c, to in EDGES if not tables or t in tables]
    return reduce(DataFrame.union, parts)


def edges_sql(*tables: str) -> str:
    return " UNION ".join(f"SELECT '{t}:' || {k} AS src, '{to}:' || {c} AS dst FROM {t}" for t, k, c, to in EDGES if not tables or t in tables)


def nodes(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    return reduce(DataFrame.union, [table(spark, sf_dir, t).select(node(t, KEYS[t]).alias("node")) for t in tables])


def nodes_sql(*tables: str) -> str:
    return " UNION ALL ".join(f"SELECT '{t}:' || {KEYS[t]} AS node FROM {t}" for t in tables)


def part_key() -> Column:
    return F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))


def part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lit("main").alias("store_id"), "p_brand", "p_type", "p_size", part_key().alias("key"))


def order_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.lit("main").alias("store_id"), "o_orderstatus", "o_orderdate", node("orders", "o_orderkey").alias("key"))


def orders_with_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("hash", content_hash(*ORDERS, money=("o_totalprice",)))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files brand/type/p<key>; the retail price in cents is the size."""
    path = F.concat_ws("/", "p_brand", "p_type", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), F.col("p_size").cast("long").alias("size"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the part tree: path, is_dir, size. The second lacks some parts, has others, and some of another size."""
    parts = part_files(spark, sf_dir)

    def state(files: DataFrame) -> DataFrame:
        from keyloom.functions.paths import ancestors

        up = files.select(F.explode(ancestors("path")).alias("path")).distinct()
        return files.select("path", F.lit(False).alias("is_dir"), "size").unionByName(up.select("path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size")))

    a = parts.where("p_partkey % 7 <> 0 and not (path like 'Brand#2/%' and p_partkey % 2 = 0) and path not like 'Brand#5/%'")
    b = parts.where("p_partkey % 5 <> 0 and path not like 'Brand#3/%'").withColumn("size", F.when(F.col("p_partkey") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return state(a), state(b)


def documents_with_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("hash", F.sha2("text", 256))


def events_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), "ts")
