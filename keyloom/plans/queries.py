"""queries() and oracle_sql(): every operator on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import codecs, hashing, paths
from keyloom.operators import content, entity, graph, index, keyset, tree
from keyloom.plans import model
from keyloom.plans.model import ORDER_INDEX, PART_INDEX, table
from keyloom.sources import stores
from keyloom.streaming import watch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


ORDER_TEXT = "concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice::DECIMAL(18,2), o_orderdate, o_orderpriority)"


@query(f"SELECT o_orderkey, sha256({ORDER_TEXT}) AS hash FROM orders")
def content_keys_orders(spark: SparkSession, d: str) -> DataFrame:
    return model.orders_with_hash(spark, d).select("o_orderkey", "hash")


@query("SELECT doc_id, 'document:' || sha256(text) AS key FROM documents")
def content_keys_documents(spark, d):
    return model.documents_with_hash(spark, d).select("doc_id", hashing.key_text(F.lit("document"), F.col("hash")).alias("key"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_documents(spark, d):
    return entity.duplicates(model.documents_with_hash(spark, d), "hash", "doc_id")


@query("SELECT sum(n_chars)::BIGINT AS raw_chars, (SELECT sum(n)::BIGINT FROM (SELECT min(n_chars) AS n FROM documents GROUP BY sha256(text))) AS unique_chars FROM documents")
def dedup_ratio(spark, d):
    each = model.documents_with_hash(spark, d).groupBy("hash").agg(F.sum("n_chars").alias("raw"), F.min("n_chars").alias("one"))
    return each.agg(F.sum("raw").alias("raw_chars"), F.sum("one").alias("unique_chars"))


@query("SELECT DISTINCT sha256(text) AS hash, octet_length(encode(text))::BIGINT AS bytes FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def write_if_absent(spark, d):
    docs = model.documents_with_hash(spark, d).select(F.lit("document").alias("ns"), "hash", F.encode("text", "UTF-8").alias("payload"), "doc_id")
    there = docs.where("doc_id % 2 = 0")
    return entity.write_if_absent(there, docs.drop("doc_id")).select("hash", F.octet_length("payload").cast("long").alias("bytes"))


@query("SELECT count(*)::BIGINT AS offered, (SELECT count(DISTINCT sha256(text)) FROM documents)::BIGINT AS written, (SELECT sum(octet_length(encode(t)))::BIGINT FROM (SELECT DISTINCT text AS t FROM documents)) AS bytes_written FROM documents")
def write_result(spark, d):
    docs = model.documents_with_hash(spark, d).select(F.lit("document").alias("ns"), "hash", F.encode("text", "UTF-8").alias("payload"))
    return entity.write_result(docs, entity.write_if_absent(None, docs))


@query("SELECT p_brand, p_type, p_size, 'part:' || p_partkey AS key FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'")
def index_match_prefix(spark, d):
    return index.select(PART_INDEX, model.part_index(spark, d), match=("Brand#2", "ECONOMY"))


@query("SELECT p_brand, p_type, p_size, 'part:' || p_partkey AS key FROM part WHERE p_partkey = 17")
def index_match_pre(spark, d):
    return index.select(PART_INDEX, model.part_index(spark, d), match_key="part:17")


@query("""SELECT o_orderstatus, o_orderdate, 'orders:' || o_orderkey AS key FROM orders WHERE (o_orderstatus > 'F' OR (o_orderstatus = 'F' AND o_orderdate >= timestamp '1996-03-01')) AND (o_orderstatus < 'O' OR (o_orderstatus = 'O' AND o_orderdate < timestamp '1997-01-01'))
ORDER BY o_orderstatus DESC, o_orderdate DESC, key DESC LIMIT 20 OFFSET 5""")
def index_range_desc(spark, d):
    from datetime import datetime

    return index.select(ORDER_INDEX, model.order_index(spark, d), lower=("F", datetime(1996, 3, 1)), upper=("O", datetime(1997, 1, 1)), order="desc", offset=5, limit=20)


@query("SELECT p_brand, p_type, p_size, 'part:' || p_partkey AS key FROM part WHERE p_partkey = 3")
def index_exact(spark, d):
    row = table(spark, d, "part").where("p_partkey = 3").first()
    return index.select(PART_INDEX, model.part_index(spark, d), exact=(row.p_brand, row.p_type, row.p_size, "part:3"))


@query("SELECT count(*) AS n FROM part WHERE p_brand = 'Brand#7' AND p_size % 2 = 0 AND p_size > 10")
def index_where_count(spark, d):
    return index.count(index.select(PART_INDEX, model.part_index(spark, d), match=("Brand#7",), where=(F.col("p_size") % 2 == 0, F.col("p_size") > 10)))


@query("SELECT p_brand, p_type, p_size, 'part:' || p_partkey AS key FROM part WHERE p_brand = 'Brand#9' ORDER BY p_type, p_size, key LIMIT 7 OFFSET 3")
def index_offset_limit(spark, d):
    return index.select(PART_INDEX, model.part_index(spark, d), match=("Brand#9",), order="asc", offset=3, limit=7)


@query("SELECT p_brand, p_type, p_size, 'part:' || p_partkey AS key FROM part WHERE false")
def index_inverted_bounds(spark, d):
    return index.select(PART_INDEX, model.part_index(spark, d), lower=("Brand#9",), upper=("Brand#1",))


@query(f"SELECT split_part(node, ':', 1) AS idx, count(DISTINCT node) AS n FROM ({model.nodes_sql(*model.KEYS)}) GROUP BY 1")
def index_types(spark, d):
    rows = model.nodes(spark, d, *model.KEYS).select(F.split("node", ":")[0].alias("idx"), F.col("node").alias("key")).distinct()
    return rows.groupBy("idx").agg(F.count("*").alias("n"))


@query("SELECT 'segment' AS idx, c_mktsegment || ',customer:' || c_custkey AS tuple FROM customer")
def index_unknown(spark, d):
    rows = table(spark, d, "customer").select(F.lit("segment").alias("idx"), "c_mktsegment", model.node("customer", "c_custkey").alias("key"))
    _, unknown = index.Registry({"part_shape": PART_INDEX}).split_unknown(rows)
    return index.unknown_rows(unknown.select("idx", "c_mktsegment", "key")).select("idx", F.array_join("tuple", ",").alias("tuple"))


@query(f"SELECT src AS \"from\", dst AS \"to\" FROM ({model.edges_sql()})")
def refs_out(spark, d):
    return entity.refer_to(model.edges(spark, d).select(F.col("src").alias("key"), F.col("dst").alias("ref")))


@query(f"SELECT dst AS \"from\", src AS \"to\" FROM ({model.edges_sql()})")
def refs_in(spark, d):
    return entity.referred_by(model.edges(spark, d).select(F.col("src").alias("key"), F.col("dst").alias("ref")))


@query("SELECT 'orders:' || l_orderkey AS key, array_to_string(list_sort(list(DISTINCT 'part:' || l_partkey)), ',') AS refs FROM lineitem GROUP BY 1")
def referred_keys(spark, d):
    return entity.referred_keys(table(spark, d, "lineitem").select(model.node("orders", "l_orderkey").alias("key"), model.node("part", "l_partkey").alias("ref"))).select("key", F.array_join("refs", ",").alias("refs"))


@query("SELECT DISTINCT 'part:' || l_partkey AS embedded, 'orders:' || l_orderkey AS root FROM lineitem")
def embedded_by(spark, d):
    return entity.embedded_by(table(spark, d, "lineitem").select(model.node("orders", "l_orderkey").alias("key"), F.array(model.node("part", "l_partkey")).alias("path")))


@query("""SELECT DISTINCT 'shape' AS idx, p_brand AS fields, 'part:' || l_partkey AS key FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 50 <> 0
AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 50 = 0)""")
def last_embedder(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    summaries = rows.select(model.node("orders", "l_orderkey").alias("key"), F.array(model.node("part", "l_partkey")).alias("path"), F.lit("shape").alias("idx"), F.col("p_brand").alias("fields"))
    gone = table(spark, d, "lineitem").where("l_orderkey % 50 <> 0").select(model.node("orders", "l_orderkey").alias("key")).distinct()
    return entity.delete_summary_index(summaries, gone)


@query("SELECT count(*) FILTER (p_partkey % 5 = 0 OR p_partkey % 7 = 0) AS missing, count(*) FILTER (p_partkey % 7 = 0 AND p_partkey % 5 <> 0) AS surplus, count(*) FILTER (p_partkey % 5 <> 0) AS n FROM part")
def rebuild_equals_live(spark, d):
    """What a rebuilt index has more and less than a live one that lost rows and kept outdated ones."""
    size = F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 100).otherwise(F.col("p_size"))
    live = index.save(PART_INDEX, table(spark, d, "part").where("p_partkey % 5 <> 0").withColumn("p_size", size).withColumn("key", model.part_key()))
    again = model.part_index(spark, d)
    n = live.agg(F.count("*").alias("n"))
    return n.join(entity.minus(again, live).agg(F.count("*").alias("missing"))).join(entity.minus(live, again).agg(F.count("*").alias("surplus")))


@query("""WITH o AS (SELECT p_brand, p_size, 'part:' || p_partkey AS key FROM part WHERE p_partkey % 4 <> 0), n AS (SELECT p_brand, p_size + (p_partkey % 10 = 3)::INT AS p_size, 'part:' || p_partkey AS key FROM part)
SELECT *, 'del' AS change FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL SELECT *, 'add' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)""")
def index_diff_on_resave(spark, d):
    p = table(spark, d, "part")
    old = p.where("p_partkey % 4 <> 0").select("p_brand", "p_size", model.part_key().alias("key"))
    new = p.select("p_brand", (F.col("p_size") + (F.col("p_partkey") % 10 == 3).cast("int")).alias("p_size"), model.part_key().alias("key"))
    return entity.index_diff(old, new)


@query("SELECT CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS p_brand, p_type, p_size, 'part:' || p_partkey AS key FROM part WHERE p_size > 20 AND p_partkey % 3 = 0")
def index_gc(spark, d):
    brand = F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("p_brand")  # null in every eleventh row, live ones too
    live = table(spark, d, "part").select(brand, "p_type", "p_size", model.part_key().alias("key"))
    rebuilt = table(spark, d, "part").where("not (p_size > 20 and p_partkey % 3 = 0)").select(brand, "p_type", "p_size", model.part_key().alias("key"))
    return entity.index_gc(live, rebuilt)


@query("SELECT 'orders:' || o_orderkey AS key, CASE WHEN o_orderkey % 19 <> 0 THEN 'customer:' || o_custkey END AS customer FROM orders WHERE o_custkey % 13 = 0 AND o_orderkey % 19 <> 0 OR o_orderkey % 17 = 0")
def clean_index(spark, d):
    customer = F.when(F.col("o_orderkey") % 19 != 0, model.node("customer", "o_custkey"))  # a null refers to nothing
    entries = table(spark, d, "orders").select(model.node("orders", "o_orderkey").alias("key"), customer.alias("customer"))
    objects = model.nodes(spark, d, "orders", "customer").withColumn("n", F.split("node", ":")[1].cast("long"))
    objects = objects.where("not (node like 'orders:%' and n % 17 = 0) and not (node like 'customer:%' and n % 13 = 0)").select(F.col("node").alias("key"))
    return entity.clean_index(entries, ["key", "customer"], objects)


@query("SELECT p_brand, p_type, p_size, 'part:' || p_partkey AS key FROM part WHERE NOT p_type = 'SMALL'")
def delete_index(spark, d):
    return entity.delete_index(model.part_index(spark, d).drop("store_id"), F.col("p_type") == "SMALL")


@query(f"""WITH o AS (SELECT node FROM ({model.nodes_sql(*model.KEYS)}) WHERE NOT (node LIKE 'orders:%' AND split_part(node, ':', 2)::BIGINT % 97 = 0) AND NOT (node LIKE 'nation:%' AND split_part(node, ':', 2)::BIGINT % 9 = 0))
SELECT src AS key, dst AS ref FROM ({model.edges_sql()}) WHERE dst NOT IN (SELECT node FROM o)""")
def check_ref_violations(spark, d):
    """All references of all tables, against objects of which some orders and nations are lost."""
    refs = model.edges(spark, d).select(F.col("src").alias("key"), F.col("dst").alias("ref"))
    n = F.split("node", ":")[1].try_cast("bigint")
    lost = (F.col("node").startswith("orders:") & (n % 97 == 0)) | (F.col("node").startswith("nation:") & (n % 9 == 0))
    return entity.violations(refs, model.nodes(spark, d, *model.KEYS).where(~F.coalesce(lost, F.lit(False))).select(F.col("node").alias("key")))


@query(f"""SELECT key, coalesce(n, 0)::BIGINT AS referrers, n IS NULL AS deletable FROM (SELECT DISTINCT node AS key FROM ({model.nodes_sql(*model.KEYS)}))
LEFT JOIN (SELECT dst, count(*) AS n FROM ({model.edges_sql()}) WHERE src <> dst GROUP BY 1) ON dst = key""")
def delete_restrict(spark, d):
    refs = model.edges(spark, d).select(F.col("src").alias("key"), F.col("dst").alias("ref"))
    return entity.referrers(model.nodes(spark, d, *model.KEYS).distinct().withColumnRenamed("node", "key"), refs)


REACH = f"""WITH RECURSIVE e AS ({model.edges_sql()}), r AS (SELECT 'orders:' || o_orderkey AS node FROM orders WHERE o_orderkey % 50 = 0 UNION SELECT dst FROM r JOIN e ON src = node)"""


@query(f"{REACH} SELECT node FROM r")
def gc_reachable(spark, d):
    roots = table(spark, d, "orders").where("o_orderkey % 50 = 0").select(model.node("orders", "o_orderkey").alias("node"))
    return graph.closure(roots, model.repeated_edges(spark, d))


@query(f"{REACH} SELECT DISTINCT node FROM ({model.nodes_sql(*model.KEYS)}) WHERE node NOT IN (SELECT node FROM r)")
def gc_dead(spark, d):
    roots = table(spark, d, "orders").where("o_orderkey % 50 = 0").select(model.node("orders", "o_orderkey").alias("node"))
    return graph.dead(model.nodes(spark, d, *model.KEYS).distinct(), roots, model.repeated_edges(spark, d))


@query(f"""WITH RECURSIVE e AS ({model.edges_sql()}), there AS (SELECT 'customer:' || c_custkey AS node FROM customer WHERE c_custkey % 3 = 0 UNION SELECT 'part:' || p_partkey FROM part WHERE p_partkey % 2 = 0),
r AS (SELECT 'lineitem:' || l_orderkey AS node FROM lineitem WHERE l_orderkey % 40 = 0 UNION SELECT dst FROM r JOIN e ON src = node WHERE dst NOT IN (SELECT node FROM there)) SELECT DISTINCT node FROM r""")
def push_plan(spark, d):
    roots = table(spark, d, "lineitem").where("l_orderkey % 40 = 0").select(model.node("lineitem", "l_orderkey").alias("node"))
    there = table(spark, d, "customer").where("c_custkey % 3 = 0").select(model.node("customer", "c_custkey").alias("node"))
    there = there.union(table(spark, d, "part").where("p_partkey % 2 = 0").select(model.node("part", "p_partkey").alias("node")))
    return graph.push(roots, model.repeated_edges(spark, d), there)


@query(f"{REACH} SELECT 'part:' || p_partkey AS node, p_size AS size FROM part WHERE 'part:' || p_partkey IN (SELECT node FROM r) OR p_partkey % 2 = 0")
def gc_sweep(spark, d):
    """Parts after a sweep whose candidates are the odd ones: an even part isn't in the summary index, so it stays."""
    roots = table(spark, d, "orders").where("o_orderkey % 50 = 0").select(model.node("orders", "o_orderkey").alias("node"))
    parts = table(spark, d, "part").select(model.part_key().alias("node"), F.col("p_size").alias("size"), "p_partkey")
    return graph.sweep(parts.drop("p_partkey"), parts.where("p_partkey % 2 = 1").select("node"), roots, model.repeated_edges(spark, d))


@query("""WITH c AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer WHERE c_custkey % 7 = 0)
SELECT DISTINCT node FROM (SELECT 'customer:' || c_custkey AS node FROM c UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_nationkey < 5 OR n_nationkey IN (SELECT c_nationkey FROM c)
UNION ALL SELECT 'region:' || n_regionkey FROM nation WHERE n_nationkey >= 5 AND n_nationkey IN (SELECT c_nationkey FROM c))""")
def push_copy(spark, d):
    """A destination with five nations after every seventh customer was pushed: what those nations refer to is not looked into."""
    source = model.nodes(spark, d, "customer", "nation", "region")
    there = table(spark, d, "nation").where("n_nationkey < 5").select(model.node("nation", "n_nationkey").alias("node"))
    roots = table(spark, d, "customer").where("c_custkey % 7 = 0").select(model.node("customer", "c_custkey").alias("node"))
    return graph.copy(source, there, roots, model.repeated_edges(spark, d, "customer", "nation")).distinct()


SAVED = """WITH e AS (SELECT 'orders:' || sha256(o_orderkey::VARCHAR) AS key, 'order-' || o_orderkey AS name, 'customer:' || o_custkey AS ref FROM orders),
s AS (SELECT *, 'c-sumary:' || sha256(concat_ws('|', key, 'order', name, '1', ref)) AS summary FROM e)"""


def _orders_as_entities(spark, d):
    return table(spark, d, "orders").select(F.lit("orders").alias("ns"), F.encode(F.col("o_orderkey").cast("string"), "UTF-8").alias("payload"), F.lit("order").alias("type"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("name"), F.lit(1).alias("version"), F.array(model.node("customer", "o_custkey")).alias("refs"), "o_orderkey")


@query(f"""{SAVED} SELECT DISTINCT * FROM (SELECT 'type' AS idx, 'order' AS field, key FROM s UNION ALL SELECT 'name', name, key FROM s UNION ALL SELECT 'version', '1', key FROM s
UNION ALL SELECT 'summary_key', key, summary FROM s UNION ALL SELECT 'summary_of', summary, key FROM s UNION ALL SELECT 'refer_to', summary, key FROM s UNION ALL SELECT 'refered_by', key, summary FROM s
UNION ALL SELECT 'refer_to', key, ref FROM s UNION ALL SELECT 'refered_by', ref, key FROM s)""")
def save_index(spark, d):
    """All built-in index rows of the orders saved as entities."""
    _, _, changes = entity.save(None, _orders_as_entities(spark, d).drop("o_orderkey"))
    return changes.select("idx", "field", "key")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0) AS objects, count(*) AS summaries, (SELECT count(*) FILTER (o_orderkey % 4 = 0) * 9 + count(*) FILTER (o_orderkey % 4 <> 0 AND o_orderkey % 6 = 0) * 5 FROM orders) AS added, (SELECT count(*) FILTER (o_orderkey % 4 <> 0 AND o_orderkey % 6 = 0) * 5 FROM orders) AS deleted FROM orders")
def save_again(spark, d):
    """Orders saved over three quarters of them, every sixth of another version: a changed one gets a new summary, and with it the four rows that name the summary and its version row; the others change nothing."""
    rows = _orders_as_entities(spark, d)
    _, held, _ = entity.save(None, rows.where("o_orderkey % 4 <> 0").drop("o_orderkey"))
    version = F.when(F.col("o_orderkey") % 6 == 0, F.lit(2)).otherwise(F.lit(1))
    objects, after, changes = entity.save(held, rows.withColumn("version", version).drop("o_orderkey"))
    count = changes.agg(F.count_if(F.col("change") == "add").alias("added"), F.count_if(F.col("change") == "del").alias("deleted"))
    return objects.agg(F.count("*").alias("objects")).join(after.agg(F.count("*").alias("summaries"))).join(count)


@query("SELECT DISTINCT 'document' AS ns, sha256(text) AS hash, sha256(text || '!') AS found FROM documents WHERE doc_id % 97 = 0")
def scrub_bad(spark, d):
    docs = model.documents_with_hash(spark, d)
    payload = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return entity.scrub(docs.select(F.lit("document").alias("ns"), "hash", F.encode(payload, "UTF-8").alias("payload"))).distinct()


@query("SELECT 'document:' || sha256(text) AS old_key, 'document:' || sha256(text || '!') AS new_key FROM documents WHERE lang = 'en'")
def resave_keys(spark, d):
    docs = model.documents_with_hash(spark, d).where("lang = 'en'").select(F.lit("document").alias("ns"), hashing.key_text(F.lit("document"), F.col("hash")).alias("key"), "text")
    return entity.resave(docs, "document", F.concat("text", F.lit("!")))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'customer:' || o_custkey ELSE 'orders:' || o_orderkey END AS key FROM orders")
def fetch_by_path(spark, d):
    orders = table(spark, d, "orders")
    objects = model.nodes(spark, d, "orders", "customer").where("node like 'orders:%' or cast(split(node, ':')[1] as bigint) % 2 = 0").select(F.col("node").alias("key"), F.lit("").alias("payload"))
    steps = orders.select(F.col("o_orderkey").alias("id"), F.array(model.node("orders", "o_orderkey"), model.node("customer", "o_custkey")).alias("path"))
    return entity.fetch(steps, objects).select("id", "key")


@query("SELECT 'labels:' || doc_id AS key FROM labels WHERE quality <> 1 UNION ALL SELECT 'labels:' || doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def update_index_stale(spark, d):
    saved = table(spark, d, "labels").select(model.node("labels", "doc_id").alias("key"), F.col("quality").alias("version"))
    return entity.stale(table(spark, d, "documents").select(model.node("labels", "doc_id").alias("key")), saved, 1)


@query("SELECT count(*) FILTER (o_orderkey % 6 <> 0) AS resaved, count(*) AS summaries, 5 * count(*) FILTER (o_orderkey % 6 <> 0) AS added, 5 * count(*) FILTER (o_orderkey % 6 <> 0) AS deleted FROM orders")
def update_index(spark, d):
    """Every sixth order is up to date; of the others the four rows that name the summary and the version row change."""
    version = F.when(F.col("o_orderkey") % 6 == 0, F.lit(2)).when(F.col("o_orderkey") % 6 == 1, F.lit(1))
    rows = _orders_as_entities(spark, d).withColumn("version", F.coalesce(version, F.lit(0)))
    _, held, _ = entity.save(None, rows.drop("o_orderkey"))
    after, changes, resaved = entity.update_index(held, 2)
    count = changes.agg(F.count_if(F.col("change") == "add").alias("added"), F.count_if(F.col("change") == "del").alias("deleted"))
    return resaved.join(after.where("version = 2").agg(F.count("*").alias("summaries"))).join(count)


@query("""WITH e AS (SELECT DISTINCT 'orders:' || sha256(o_orderkey::VARCHAR) AS key, 'order-' || o_orderkey AS name, 'customer:' || o_custkey AS ref FROM orders)
SELECT 'digits' AS idx, right(name, 1) AS field, key FROM e UNION SELECT 'owner', ref, key FROM e""")
def index_providers(spark, d):
    _, held, _ = entity.save(None, _orders_as_entities(spark, d).drop("o_orderkey"))

    def digits(summaries):
        return summaries.select(F.lit("digits").alias("idx"), F.right("name", F.lit(1)).alias("field"), "key")

    def owner(summaries):
        return summaries.select(F.lit("owner").alias("idx"), F.explode("refs").alias("field"), "key")

    return entity.provided_index(held, [digits, owner])


@query("SELECT sha256(o_custkey || '|' || o_orderstatus) AS slot, count(*) AS versions FROM orders GROUP BY 1")
def slot_versions(spark, d):
    return entity.slots(table(spark, d, "orders"), "o_custkey", "o_orderstatus").groupBy("slot").agg(F.count("*").alias("versions"))


@query("SELECT DISTINCT 'conversations:' || conv_id AS key, sha256(text) AS hash, text AS payload FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def fetch_sub_values(spark, d):
    turns = table(spark, d, "conversations").select(model.node("conversations", "conv_id").alias("key"), F.sha2("text", 256).alias("hash"), "text", "role")
    subs = turns.select("key", "hash", F.col("text").alias("payload"))
    return entity.sub_values(turns.where("role = 'user' and text is not null"), subs)


LEVELS = "WITH f AS (SELECT p_brand || '/' || p_type || '/p' || p_partkey AS path, p_brand AS b, p_brand || '/' || p_type AS t, p_size::BIGINT AS size FROM part), n AS (SELECT '' AS path, size, true AS dir FROM f UNION ALL SELECT b, size, true FROM f UNION ALL SELECT t, size, true FROM f UNION ALL SELECT path, size, false FROM f)"


@query(f"{LEVELS}, s AS (SELECT path, bool_or(dir) AS is_dir, sum(size)::BIGINT AS tree_size, count(*) AS n_files FROM n GROUP BY path) SELECT s.*, (SELECT count(*) FROM s x WHERE s.path = '' OR x.path = s.path OR starts_with(x.path, s.path || '/')) AS weight FROM s")
def tree_build(spark, d):
    return tree.build(model.part_files(spark, d))


def _state(where: str, size: str = "p_size") -> str:
    files = f"SELECT p_brand || '/' || p_type || '/p' || p_partkey AS path, p_brand AS b, p_brand || '/' || p_type AS t, ({size})::BIGINT AS size FROM part WHERE {where}"
    return f"(SELECT path, false AS is_dir, size FROM ({files}) UNION ALL SELECT DISTINCT '' AS path, true, 0 FROM ({files}) UNION ALL SELECT DISTINCT b, true, 0 FROM ({files}) UNION ALL SELECT DISTINCT t, true, 0 FROM ({files}))"


STATES = f"""WITH a AS {_state("p_partkey % 7 <> 0 AND NOT (p_brand = 'Brand#2' AND p_partkey % 2 = 0) AND p_brand <> 'Brand#5'")}, b AS {_state("p_partkey % 5 <> 0 AND p_brand <> 'Brand#3'", "p_size + (p_partkey % 11 = 0)::INT")},
z AS (SELECT coalesce(a.path, b.path) AS path, a.path IS NOT NULL AS in_a, b.path IS NOT NULL AS in_b, a.size AS sa, b.size AS sb, a.is_dir AS da, b.is_dir AS db FROM a FULL JOIN b ON a.path = b.path),
p AS (SELECT *, CASE WHEN path = '' THEN NULL WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM z),
q AS (SELECT p.*, x.in_a AS pa, x.in_b AS pb FROM p LEFT JOIN z x ON x.path = p.dir)"""
STATUS = "CASE WHEN in_a AND in_b THEN 'both' WHEN in_a THEN 'a' ELSE 'b' END AS status"


@query(f"{STATES} SELECT path, {STATUS} FROM q WHERE dir IS NULL OR (pa AND pb)")
def tree_zip(spark, d):
    return tree.zip_trees(*model.snapshots(spark, d)).select("path", "status")


@query(f"{STATES} SELECT path, {STATUS} FROM q WHERE (dir IS NULL OR (pa AND pb)) AND NOT path LIKE 'Brand#4/%'")
def tree_zip_closed(spark, d):
    a, b = (t.withColumn("closed", F.col("path") == "Brand#4") for t in model.snapshots(spark, d))
    return tree.zip_trees(a, b, expand=~F.col("a.closed")).select("path", "status")


@query(f"{STATES} SELECT path, {STATUS} FROM z")
def tree_zip_flat(spark, d):
    return tree.zip_flat(*model.snapshots(spark, d)).select("path", "status")


@query(f"""{STATES} SELECT path, CASE WHEN NOT in_a THEN 'add' WHEN NOT in_b THEN 'delete' WHEN da AND db THEN 'dir' WHEN da = db AND sa = sb THEN 'reuse' ELSE 'modify' END AS action FROM q WHERE in_b OR dir IS NULL OR pb""")
def tree_update(spark, d):
    return tree.update(*model.snapshots(spark, d), stat=("is_dir", "size")).select("path", "action")


@query(f"""{STATES} SELECT path, CASE WHEN NOT in_a THEN 'add' WHEN NOT in_b THEN 'delete' WHEN path = 'Brand#6' THEN 'reuse' WHEN da AND db THEN 'dir' WHEN da = db AND sa = sb THEN 'reuse' ELSE 'modify' END AS action
FROM q WHERE (in_b OR dir IS NULL OR pb) AND NOT path LIKE 'Brand#6/%'""")
def tree_update_watched(spark, d):
    return tree.update(*model.snapshots(spark, d), unchanged=spark.createDataFrame([("Brand#6",)], "path string"), stat=("is_dir", "size")).select("path", "action")


@query(f"{STATES} SELECT path, CASE WHEN NOT (in_a AND in_b) THEN 'missing' WHEN da <> db THEN 'is_dir' ELSE 'size' END AS reason FROM z WHERE NOT (in_a AND in_b) OR da <> db OR sa <> sb")
def tree_equal(spark, d):
    return tree.differences(*model.snapshots(spark, d), checks=("is_dir", "size"))


@query(f"{STATES} SELECT path, is_dir, size FROM b")
def tree_reverse_unzip(spark, d):
    return tree.unzip(tree.reverse(tree.zip_flat(*model.snapshots(spark, d))), "a")


@query(f"{STATES} SELECT path, is_dir, size FROM b WHERE path = 'Brand#1/SMALL' OR regexp_matches(path, '^Brand#1/[^/]*$')")
def tree_children(spark, d):
    _, b = model.snapshots(spark, d)
    return tree.children(b, "Brand#1").unionByName(tree.find(b, "Brand#1/SMALL")).distinct()


@query(f"{STATES} SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NOT NULL THEN b.is_dir ELSE a.is_dir END AS is_dir, coalesce(b.size, a.size) AS size FROM a FULL JOIN b ON a.path = b.path")
def tree_upsert(spark, d):
    return tree.upsert(*model.snapshots(spark, d))


@query("""WITH r AS (SELECT p_brand || '/' || p_type AS dir, 'p' || p_partkey AS name, p_size, (row_number() OVER (PARTITION BY p_brand, p_type ORDER BY 'p' || p_partkey) - 1) // 4 AS pack FROM part)
SELECT dir, pack::BIGINT AS pack, min(name) AS min, max(name) AS max, sum(p_size)::BIGINT AS size, count(*) AS n, 2 AS height FROM r GROUP BY dir, pack HAVING count(*) = 4""")
def tree_pack(spark, d):
    return tree.pack(model.part_files(spark, d), 4)


@query("WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 48 AS pack FROM orders) SELECT 2 AS height, pack::BIGINT AS pack, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, count(*) AS n FROM r GROUP BY pack HAVING count(*) = 48")
def keyset_pack(spark, d):
    return keyset.pack(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")))


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 7 = 0 UNION SELECT 1 UNION SELECT 2")
def keyset_add_del_has(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    held = keyset.delete(keyset.add(keys.where("key % 10 = 0"), keys.where("key % 10 = 0 or key % 4 = 1")), keys.where("key % 4 = 1 and key % 10 <> 0"))
    extra = spark.createDataFrame([(1,), (2,)], "key long")
    return keyset.add(keyset.has(keys.where("key % 7 = 0"), held), extra)


@query("SELECT DISTINCT 'orders' AS ns, 'o' || o_orderkey AS hash FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def stacked_iter(spark, d):
    keys = table(spark, d, "orders").select(F.lit("orders").alias("ns"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("hash"), "o_orderkey")
    return stores.stacked_keys(keys.where("o_orderkey % 2 = 0").drop("o_orderkey"), keys.where("o_orderkey % 3 = 0").drop("o_orderkey"))


@query("SELECT 'orders' AS ns, 'o' || o_orderkey AS hash, (CASE WHEN o_orderkey % 2 = 0 THEN 'back' ELSE 'up' END) AS payload, o_orderkey % 2 = 0 AS from_backing FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def stacked_read(spark, d):
    keys = table(spark, d, "orders").select(F.lit("orders").alias("ns"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("hash"), "o_orderkey")
    back, up = (keys.where(f"o_orderkey % {n} = 0").select("ns", "hash", F.lit(p).alias("payload")) for n, p in ((2, "back"), (3, "up")))
    return stores.stacked_read(back, up)


@query("SELECT 'customer' AS ns, 'c' || c_custkey AS hash, 'default' AS route FROM customer UNION ALL SELECT 'orders', 'o' || o_orderkey, 'orders' FROM orders")
def nssharded_iter(spark, d):
    customers = table(spark, d, "customer").select(F.lit("customer").alias("ns"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("hash"))
    orders = table(spark, d, "orders").select(F.lit("orders").alias("ns"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("hash"))
    return stores.sharded_keys(customers, {"orders": orders, "customer": customers})


@query("SELECT doc_id, sha256(text) AS hash, n_chars > 5000 AS is_offloaded FROM documents")
def offload_roundtrip(spark, d):
    docs = model.documents_with_hash(spark, d).select(F.col("doc_id").cast("string").alias("ns"), "hash", F.encode("text", "UTF-8").alias("payload"), "n_chars")
    main, away = stores.offload(docs, F.col("n_chars") > 5000)
    back = stores.read_offloaded(main.select("ns", "hash", "payload"), away)
    return back.join(main.select("ns", "is_offloaded"), "ns").select(F.col("ns").cast("long").alias("doc_id"), F.sha2("payload", 256).alias("hash"), "is_offloaded")


CHUNKS = "SELECT doc_id, i::INT AS i, substr(text, i * 4096 + 1, 4096) AS chunk FROM (SELECT doc_id, text, unnest(range(greatest(1, (length(text) + 4095) // 4096))) AS i FROM documents)"


@query(f"SELECT doc_id, i, chunk, length(chunk)::INT AS length FROM ({CHUNKS})")
def chunk_fixed(spark, d):
    return content.chunk_fixed(table(spark, d, "documents"), "doc_id", "text", 4096)


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def chunk_reassemble(spark, d):
    parts = content.chunk_fixed(table(spark, d, "documents"), "doc_id", "text", 1000)
    return content.reassemble(parts, "doc_id").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT doc_id::VARCHAR AS key, sha256(text) AS hash FROM documents")
def chunk_cdc(spark, d):
    parts = content.chunk_cdc(table(spark, d, "documents"), "doc_id", "text", small=256, most=1024)
    objects, files = content.store_chunks(parts)
    return content.reassemble(files.join(objects, "hash").select("key", "i", "chunk"), "key").select("key", F.sha2("text", 256).alias("hash"))


@query("SELECT doc_id, substr(text, 701, 900) AS part FROM documents WHERE length(text) > 700")
def read_range(spark, d):
    return content.read_range(content.chunk_fixed(table(spark, d, "documents"), "doc_id", "text", 512), "doc_id", 700, 900)


ROLLUP = "SELECT path, max(ts) AS last_change FROM (SELECT '' AS path, ts FROM events UNION ALL SELECT user_id::VARCHAR, ts FROM events UNION ALL SELECT user_id || '/' || event_type, ts FROM events) GROUP BY path"


@query(ROLLUP)
def watch_rollup(spark, d):
    return watch.rollup(model.events_by_path(spark, d))


@query(f"WITH w AS ({ROLLUP}) SELECT p.path, coalesce(last_change < timestamp '2024-01-29', false) AS unchanged FROM (SELECT DISTINCT user_id || '/' || event_type AS path FROM events UNION ALL SELECT 'nowhere') p LEFT JOIN w ON w.path = p.path")
def path_not_changed(spark, d):
    from datetime import datetime

    events = model.events_by_path(spark, d)
    probes = events.select("path").distinct().union(spark.createDataFrame([("nowhere",)], "path string"))
    return watch.not_changed(probes, watch.rollup(events), datetime(2024, 1, 29))


@query("SELECT doc_id, sha256(text) AS hash, true AS hidden FROM documents")
def codec_roundtrip(spark, d):
    codec = codecs.AesGcm(b"0123456789abcdef")
    plain = F.encode("text", "UTF-8")
    stored = graph.checkpoint(table(spark, d, "documents").select("doc_id", codec.encode(plain).alias("stored"), F.sha2(plain, 256).alias("was")))  # as a store would: written, then read
    return stored.select("doc_id", F.sha2(codec.decode(F.col("stored")), 256).alias("hash"), (F.sha2("stored", 256) != F.col("was")).alias("hidden"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def codec_hybrid_roundtrip(spark, d):
    codec = codecs.Stacked(codecs.Hybrid(codecs.Deflate()), codecs.Segmented(codecs.AesGcm(b"0123456789abcdef"), 4096))
    stored = graph.checkpoint(table(spark, d, "documents").select("doc_id", codec.encode(F.encode("text", "UTF-8")).alias("stored")))
    return stored.select("doc_id", F.sha2(codec.decode(F.col("stored")), 256).alias("hash"))


@query("SELECT DISTINCT user_id || '/' || event_type AS path FROM events WHERE NOT (user_id % 3 = 0) AND NOT (user_id || '/' || event_type = '1/click')")
def restricted_paths(spark, d):
    events = table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), "user_id")
    denied = events.where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("path")).distinct().union(spark.createDataFrame([("1/click",)], "path string"))
    return tree.without_ignored(events.select("path").distinct(), denied)


@query("SELECT p_partkey, p_type = 'SMALL' OR p_partkey % 10 = 5 AS ignored FROM part")
def ignore_rules(spark, d):
    files = model.part_files(spark, d)
    return files.select("p_partkey", paths.ignored("path", ["# comment", "SMALL/", "p*5", "!p15"]).alias("ignored"))


@query("SELECT n_nationkey, 'nation:' || sha256(n_name) AS key, 'nation' AS ns, sha256(n_name) AS hash, sha256(n_name)[:2] || '/' || sha256(n_name) AS stored_at FROM nation")
def key_codec(spark, d):
    text = hashing.key_text(F.lit("nation"), F.sha2("n_name", 256))
    rows = table(spark, d, "nation").select("n_nationkey", text.alias("key")).withColumn("k", hashing.key_of(F.col("key")))
    return rows.select("n_nationkey", "key", "k.ns", "k.hash", paths.fan_out("k.hash").alias("stored_at"))
