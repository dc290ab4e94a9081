"""Entities: content-addressed rows with summaries, references and derived indexes, and their upkeep.

Tables
  objects    ns, hash, payload
  summaries  key, summary, path, idx, fields, version      a row for each index entry of an entity or sub-value
  refs       key, ref                                       an entity and a key that it refers to
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions.hashing import content_hash, key_text


def minus(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of a that b doesn't hold, compared in columns (all of a's), nulls included; repeated rows of a stay."""
    columns = columns or a.columns
    other = b.select(*[F.col(c).alias(f"_{c}") for c in columns])
    match = F.lit(True)
    for c in columns:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, match, "left_anti")


class BeingReferred(RuntimeError):
    """A key can't be deleted: others refer to it."""


class KeyNotFound(LookupError):
    """A reference leads nowhere."""


def identify(rows: DataFrame, ns: str, payload: Column) -> DataFrame:
    """rows with ns, hash, payload and key."""
    return rows.withColumns({"ns": F.lit(ns), "hash": F.sha2(payload, 256), "payload": payload}).withColumn("key", key_text("ns", "hash"))


def write_if_absent(objects: DataFrame | None, new: DataFrame) -> DataFrame:
    """What must be appended to objects so that it holds new (ns, hash, payload): each key once, none that is there."""
    once = new.dropDuplicates(["ns", "hash"])
    return once if objects is None else once.join(objects.select("ns", "hash"), ["ns", "hash"], "left_anti")


def write_result(new: DataFrame, appended: DataFrame) -> DataFrame:
    """rows offered, rows written, bytes written."""
    offered = new.agg(F.count("*").alias("offered"))
    written = appended.agg(F.count("*").alias("written"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("long").alias("bytes_written"))
    return offered.join(written)


def duplicates(rows: DataFrame, digest: str, row_key: str) -> DataFrame:
    """hash, the smallest id with it, how many rows share it; shared ones only."""
    return rows.groupBy(digest).agg(F.min(row_key).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def refer_to(refs: DataFrame) -> DataFrame:
    """(from, to), each once; referred_by is the same with the columns swapped."""
    return refs.select(F.col("key").alias("from"), F.col("ref").alias("to")).distinct()


def referred_by(refs: DataFrame) -> DataFrame:
    return refs.select(F.col("ref").alias("from"), F.col("key").alias("to")).distinct()


def referred_keys(refs: DataFrame) -> DataFrame:
    """key and the sorted set of the keys it refers to."""
    return refs.groupBy("key").agg(F.array_sort(F.collect_set("ref")).alias("refs"))


def embedded_by(summaries: DataFrame) -> DataFrame:
    """(sub-value, root) for every index entry of a sub-value: path is the key path from the root."""
    return summaries.where(F.size("path") > 0).select(F.element_at("path", -1).alias("embedded"), F.col("key").alias("root")).distinct()


def index_rows(summaries: DataFrame) -> DataFrame:
    """Index rows that summaries imply: idx, fields, key (of the sub-value where there is one)."""
    owner = F.when(F.size("path") > 0, F.element_at("path", -1)).otherwise(F.col("key"))
    return summaries.select("idx", "fields", owner.alias("key")).distinct()


def delete_summary_index(summaries: DataFrame, gone: DataFrame) -> DataFrame:
    """Index rows to delete when the entities `gone` (key) go: a sub-value's rows stay while another entity embeds it."""
    lost = index_rows(summaries.join(gone, "key", "left_semi"))
    kept = index_rows(summaries.join(gone, "key", "left_anti"))
    return minus(lost, kept)


#: The namespace of summaries, and what the index rows of one derive from.
SUMMARIES = "c-sumary"
INDEXED = ("summary", "type", "name", "version", "refs")


def summary_key(of: Callable[[str], Column] = F.col) -> Column:
    return key_text(F.lit(SUMMARIES), content_hash(of("key"), of("type"), of("name"), of("version").cast("string"), F.array_join(of("refs"), ",")))


def identified(entities: DataFrame) -> DataFrame:
    refs = F.array_sort(F.array_distinct(F.coalesce("refs", F.array().cast("array<string>"))))
    return entities.withColumns({"key": key_text("ns", "hash"), "refs": refs})


def summarize(entities: DataFrame) -> DataFrame:
    """Entities (ns, hash, type, name, version, refs: array of keys) with `key` and the key of their summary, whose hash covers all that is indexed."""
    return identified(entities).withColumn("summary", summary_key())


def _row(idx: str, field: Column, key: Column, **more: Column) -> Column:
    return F.struct(F.lit(idx).alias("idx"), field.cast("string").alias("field"), key.alias("key"), *[c.alias(n) for n, c in more.items()])


def _around(key: Column, summary: Column, **more: Column) -> list[Column]:
    return [_row("summary_key", key, summary, **more), _row("summary_of", summary, key, **more), _row("refer_to", summary, key, **more), _row("refered_by", key, summary, **more)]


def _of_refs(key: Column, refs: Column, **more: Column) -> Column:
    return F.flatten(F.transform(refs, lambda r: F.array(_row("refer_to", key, r, **more), _row("refered_by", r, key, **more))))


def entity_index(summaries: DataFrame) -> DataFrame:
    """The built-in index rows (idx, field, key) that summaries imply: type, name and version of each entity, the two
    directions between it and its summary, and between whatever refers and is referred to. Seven for an entity with a
    name and without references. The key-first rows are the same with field and key swapped, so none are stored."""
    key = F.col("key")
    one = F.array(*[_row(c, F.col(c), key) for c in ("type", "name", "version")], *_around(key, F.col("summary")))
    return summaries.select(F.inline(F.concat(one, _of_refs(key, F.col("refs"))))).where("field is not null").distinct()


def _by_key(summaries: DataFrame, name: str) -> DataFrame:
    """key, the number of its summaries (name_n), the columns of one if it has one (name_*)."""
    return summaries.groupBy("key").agg(F.count("*").alias(f"{name}_n"), *[F.first(c).alias(f"{name}_{c}") for c in INDEXED])


def _more(a: str, b: str, change: str) -> Column:
    """Index rows of the summary a that b lacks, others with a null field; a or b may be null."""
    key, mark, none = F.col("key"), {"change": F.lit(change)}, F.array().cast("array<string>")
    has, lacks = ({c: F.col(f"{side}_{c}") for c in INDEXED} for side in (a, b))
    differs = F.col(f"{a}_n").isNotNull() & ~has["summary"].eqNullSafe(lacks["summary"])
    one = [F.when(~has[c].eqNullSafe(lacks[c]), _row(c, has[c], key, **mark)) for c in ("type", "name", "version")]
    refs = F.array_except(F.coalesce(has["refs"], none), F.coalesce(lacks["refs"], none))
    return F.when(differs, F.concat(F.array(*one, *_around(key, has["summary"], **mark)), _of_refs(key, refs, **mark))).otherwise(F.array().cast("array<struct<idx:string,field:string,key:string,change:string>>"))


def index_changes(old: DataFrame, new: DataFrame, both: DataFrame) -> DataFrame:
    """What index_diff() finds between the index rows of two sets of summaries, those of old whose keys new lacks left out.

    both: as _by_key() gives it, of old and new side by side. Every row names its entity or its summary, so one summary
    of a key is compared with the one before it, column by column, and only summaries are shuffled. A row has two owners
    only if a key has several summaries or a summary is itself an entity; such keys, and what those summaries refer to,
    are compared row by row.
    """
    single = (F.col("new_n") == 1) & (F.coalesce("old_n", F.lit(1)) == 1)
    nested = old.select("ns", "key", "refs").unionByName(new.select("ns", "key", "refs")).where(F.col("ns") == SUMMARIES)
    nested = nested.select(F.explode(F.concat(F.array("key"), "refs")).alias("key")).where("key is not null").distinct()
    shared = both.where(~single).select("key").unionByName(nested).distinct()
    rest = new.join(shared, "key", "left_semi")
    before = old.join(shared, "key", "left_semi").join(new.select("key"), "key", "left_semi")
    apart = both.where(single).join(nested, "key", "left_anti").select(F.inline(F.concat(_more("new", "old", "add"), _more("old", "new", "del"))))
    return apart.where("field is not null").unionByName(index_diff(entity_index(before), entity_index(rest)))


def save(held: DataFrame | None, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Save entities (ns, payload, type, name, version, refs) over the summaries held so far.

    Returns (objects to append: ns, hash, payload; summaries after it; index changes: idx, field, key, change). The newest summary of an entity
    replaces its older ones, common index rows are not touched, and saving the same again changes nothing.
    """
    rows = identified(new.withColumn("hash", F.sha2("payload", 256)))
    # all that follows goes by key, so summaries are dealt once, and made only after that
    latest_ = rows.drop("payload").repartition("key").withColumn("summary", summary_key()).dropDuplicates(["key", "summary", "ns", "hash"])
    old = latest_.where("false") if held is None else held
    objects = rows.select("key", "ns", "hash", "payload").repartition("key").dropDuplicates(["key", "ns", "hash"])
    objects = objects.join(old.where("ns is not null and hash is not null").select("key"), "key", "left_anti").select("ns", "hash", "payload")
    after = old.join(latest_.select("key"), "key", "left_anti").select(*latest_.columns).unionByName(latest_)
    return objects, after, index_changes(old, latest_, _by_key(latest_, "new").join(_by_key(old, "old"), "key", "left"))


def latest(rows: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """One row of each key: the newest."""
    w = Window.partitionBy(key).orderBy(*newest_first)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def index_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a re-save changes: rows of old that are not in new ('del') and of new that are not in old ('add')."""
    return old.exceptAll(new).withColumn("change", F.lit("del")).unionByName(new.exceptAll(old).withColumn("change", F.lit("add")))


def apply_diff(index: DataFrame, diff: DataFrame) -> DataFrame:
    columns = index.columns
    gone, come = (diff.where(F.col("change") == c).select(*columns) for c in ("del", "add"))
    return minus(index, gone).unionByName(come).distinct()


def index_gc(actual: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Index rows that no summary implies."""
    return minus(actual, rebuilt)


def clean_index(entries: DataFrame, keys: list[str], objects: DataFrame) -> DataFrame:
    """Entries in which any of the key columns leads to no object; a null refers to nothing. objects: key."""
    tagged = entries.select("*", F.explode(F.array(*keys)).alias("_k")).where("_k is not null")
    return tagged.join(objects.select(F.col("key").alias("_k")), "_k", "left_anti").drop("_k").distinct()


def delete_index(entries: DataFrame, predicate: Column) -> DataFrame:
    """The index without the entries that satisfy predicate."""
    return entries.where(~F.coalesce(predicate, F.lit(False)))


def violations(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """References that lead to no object. refs: key, ref; objects: key."""
    return refs.join(objects.select(F.col("key").alias("ref")), "ref", "left_anti").select("key", "ref")


def check_refs(refs: DataFrame, objects: DataFrame) -> None:
    bad = violations(refs, objects).orderBy("key", "ref").limit(1).collect()
    if bad:
        raise KeyNotFound(f"{bad[0]['key']} refers to {bad[0]['ref']}")


def referrers(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """key, how many others refer to it, whether it may be deleted. A key's own summary does not count."""
    counts = refs.where("key <> ref").groupBy(F.col("ref").alias("key")).agg(F.count("*").alias("referrers"))
    n = F.coalesce("referrers", F.lit(0)).cast("long")
    return candidates.join(counts, "key", "left").select("key", n.alias("referrers"), (n == 0).alias("deletable"))


def delete(keys: DataFrame, objects: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, refs) without keys; an error if others refer to any of them."""
    bad = referrers(keys, refs.join(keys, "key", "left_anti")).where("not deletable").orderBy("key").limit(1).collect()
    if bad:
        raise BeingReferred(f"{bad[0]['key']} is referred to by {bad[0]['referrers']}")
    return objects.join(keys, "key", "left_anti"), refs.join(keys, "key", "left_anti")


def stale(entities: DataFrame, indexed: DataFrame, version: int) -> DataFrame:
    """Entities (key) whose index is missing or of another version. indexed: key, version."""
    return entities.join(indexed, "key", "left").where(F.col("version").isNull() | (F.col("version") != version)).select("key")


def update_index(held: DataFrame, version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries of another version, or of none, derived anew as `version`; the others are not touched.

    held as save() returns it. Returns (summaries after it, index changes: idx, field, key, change; the number of summaries saved again: resaved).
    """
    outdated = ~F.col("version").eqNullSafe(F.lit(version))
    old = held.where(outdated)
    new = old.withColumn("version", F.lit(version)).withColumn("summary", summary_key())
    now = {c: F.col(f"old_{c}") for c in INDEXED} | {"key": F.col("key"), "version": F.lit(version), "n": F.col("old_n")}
    now["summary"] = summary_key(now.__getitem__)
    both = _by_key(old, "old").select("*", *[now[c].alias(f"new_{c}") for c in (*INDEXED, "n")])
    return held.where(~outdated).unionByName(new), index_changes(old, new, both), old.agg(F.count("*").alias("resaved"))


def provided_index(summaries: DataFrame, providers: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The index rows (idx, field, key) of all providers together, each once; a provider derives rows from summaries, as entity_index() does."""
    return reduce(DataFrame.unionByName, [p(summaries).select("idx", "field", "key") for p in providers]).distinct()


def slots(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with `slot`, the hash of the columns that say which place an entity takes; entities of one slot are versions of each other."""
    return rows.withColumn("slot", content_hash(*columns))


def resave(objects: DataFrame, ns: str, again: Column) -> DataFrame:
    """Objects of one namespace encoded anew: their old and new keys."""
    rows = objects.where(F.col("ns") == ns)
    return rows.select(F.col("key").alias("old_key"), key_text("ns", F.sha2(again, 256)).alias("new_key"))


def scrub(objects: DataFrame) -> DataFrame:
    """Keys whose payload does not have their hash."""
    return objects.withColumn("found", F.sha2("payload", 256)).where("found <> hash").select("ns", "hash", "found")


def fetch(paths: DataFrame, objects: DataFrame) -> DataFrame:
    """First object on each path (id, path: array of keys), tried from both ends: last, first, last but one, second, ...; with the key found."""
    n = F.size("path")
    order = F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(n / 2).cast("int") - 1), lambda i: F.array(n - i, i + 1)))
    tries = paths.where(n > 0).select("id", F.posexplode(F.array_distinct(F.transform(order, lambda i: F.element_at("path", i)))).alias("turn", "key"))
    found = tries.join(objects.select("key", "payload"), "key")
    return found.groupBy("id").agg(F.min_by(F.struct("key", "payload"), "turn").alias("f")).select("id", "f.*")


def sub_values(wanted: DataFrame, subs: DataFrame) -> DataFrame:
    """key, hash and payload of each wanted (key, hash) that its container holds. subs: a row (key, hash, payload) for each sub-value of a container, however many it has."""
    found = subs.join(wanted.select("key", "hash").distinct(), ["key", "hash"], "left_semi")
    return found.select("key", "hash", "payload").dropDuplicates(["key", "hash"])


def new_name(prefix: str, machine: str) -> Column:
    """prefix/machine-YYYYMMDDhhmmssmmm-xxxx; check it against the names in use and draw again."""
    now = F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSS")
    return F.concat(F.lit(f"{prefix}/{machine}-"), now, F.lit("-"), F.lpad(F.lower(F.hex(F.floor(F.rand() * 65536).cast("long"))), 4, "0"))


def summary_hash(*columns: str) -> Column:
    return content_hash(*columns)
