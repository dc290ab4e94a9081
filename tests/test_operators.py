"""Errors and state that queries() can't show: stores, transactions, deletes, keys, codecs, streaming, files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keyloom.functions import codecs, hashing, paths
from keyloom.operators import content, entity, graph, index, keyset, tree
from keyloom.sources import files, stores, variables
from keyloom.streaming import watch

SPEC = index.IndexSpec("testing", (("s1", "string"), ("s2", "string"), ("i", "int")))


@pytest.fixture(scope="module")
def composite(spark):
    rows = spark.createDataFrame([("foo", "foo", 1), ("foo", "foo", 2), ("foo", "bar", 3)], "s1 string, s2 string, i int")
    return index.save(SPEC, rows.withColumn("key", F.lit("foo:beef")))


@pytest.mark.parametrize(("match", "n"), [(("foo",), 3), (("foo", "foo"), 2), (("foo", "foo", 1), 1), (("bar",), 0)])
def test_prefix_match(composite, match, n):
    assert index.select(SPEC, composite, match=match).count() == n


def test_offset_before_limit_and_inverted_bounds(composite):
    assert [r.i for r in index.select(SPEC, composite, order="asc", offset=1, limit=1).collect()] == [1]
    assert index.select(SPEC, composite, lower=("z",), upper=("a",)).isEmpty()


def test_resaving_changes_nothing(composite):
    assert index.save(SPEC, composite.drop("store_id"), composite).count() == 3
    assert index.delete(composite, composite).isEmpty()


def test_incomplete_entries_are_errors(spark, composite):
    with pytest.raises(index.InvalidEntry):
        index.save(SPEC, composite.drop("i"))
    with pytest.raises(Exception, match="without a key"):
        index.save(SPEC, composite.withColumn("key", F.lit(None).cast("string"))).collect()


def test_store_is_idempotent_and_verifies(spark, tmp_path):
    store = stores.ParquetStore(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("foo", b"42"), ("foo", b"43"), ("bar", b"42")], "ns string, payload binary")
    assert store.write(rows).where("written").count() == 3
    assert store.write(rows).where("written").isEmpty()
    assert store.keys("foo").count() == 2 and store.id() == store.id()
    with pytest.raises(entity.KeyNotFound):
        store.read(spark.createDataFrame([("foo", "0" * 64)], "ns string, hash string"))
    store.delete(store.keys("foo"))
    assert [r.ns for r in store.keys().collect()] == ["bar"]
    store.readable = False
    with pytest.raises(stores.ReadDisabled):
        store.keys()


def test_scrub_finds_altered_payloads(spark, tmp_path):
    store = stores.ParquetStore(spark, f"file://{tmp_path}/store")
    bad = spark.createDataFrame([("foo", "ab" * 32, b"42")], "ns string, hash string, payload binary")
    store.publish([store.append(bad)])
    assert store.scrub().count() == 1
    with pytest.raises(stores.KeyNotMatch):
        store.read(bad.select("ns", "hash"))


def test_transactions_commit_or_vanish(spark, tmp_path):
    store = stores.ParquetStore(spark, f"file://{tmp_path}/store")
    row = lambda x: spark.createDataFrame([("foo", x)], "ns string, payload binary")
    with pytest.raises(ZeroDivisionError), stores.Transaction(store) as t:
        t.write(row(b"1"))
        assert t.objects().count() == 1 and store.keys().isEmpty()
        raise ZeroDivisionError
    assert store.keys().isEmpty()
    with stores.Transaction(store) as t:
        t.write(row(b"1"))
        t.write(row(b"1"))
    assert store.keys().count() == 1


def test_delete_is_restricted(spark):
    refs = spark.createDataFrame([("a", "b")], "key string, ref string")
    objects = spark.createDataFrame([("a",), ("b",)], "key string")
    with pytest.raises(entity.BeingReferred):
        entity.delete(objects.where("key = 'b'"), objects, refs)
    left, refs_left = entity.delete(objects.where("key = 'a'"), objects, refs)
    assert [r.key for r in left.collect()] == ["b"] and refs_left.isEmpty()
    with pytest.raises(entity.KeyNotFound):
        entity.check_refs(refs, left.where("key = 'z'"))


def test_closure_of_a_cycle_and_no_roots(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {r.node for r in graph.closure(roots, edges).collect()} == {"a", "b", "c"}
    with pytest.raises(graph.NoRoots):
        graph.dead(roots, roots.where("false"), edges)


def test_keys_and_namespaces(spark):
    row = spark.range(1).select(hashing.key_of(F.lit("abc:010203")).alias("k"), hashing.namespace_ok(F.lit("")).alias("empty"), hashing.integer_hash(F.lit(42).cast("long")).alias("h")).first()
    assert row.k.ns == "abc" and row.k.hash == "010203" + "0" * 58 and not row.empty and len(row.h) == 64
    with pytest.raises(Exception, match="bad key"):
        spark.range(1).select(hashing.key_of(F.lit("abc"))).collect()
    with pytest.raises(Exception, match="too long"):
        spark.range(1).select(hashing.namespace(F.lit("123456789"))).collect()


def test_packs_of_packs(spark):
    levels = keyset.pack_all(spark.range(100).toDF("key"), threshold=4)
    assert [x.count() for x in levels] == [25, 6, 1]


def test_onion_needs_its_codecs(spark):
    onion = codecs.Onion([codecs.AesGcm(b"0" * 16)])
    row = spark.createDataFrame([(b"abc",)], "p binary").select(onion.encode(F.col("p")).alias("r"))
    ids = [c.id for c in onion.codecs]
    assert bytes(row.select(onion.decode(F.col("r"), ids, {ids[0]: onion.codecs[0]}).alias("p")).first().p) == b"abc"
    with pytest.raises(codecs.CodecNotFound):
        onion.decode(F.col("r"), ids, {})


def test_shifted_copies_share_chunks(spark):
    import random

    body = random.Random(1).randbytes(200_000)
    docs = spark.createDataFrame([("a", body), ("b", b"foo" + body), ("c", body + b"foo")], "id string, content binary")
    objects, uses = content.store_chunks(content.chunk_cdc(docs, "id", "content", small=256, most=1024))
    stored, total = objects.agg(F.sum(F.length("chunk"))).first()[0], uses.agg(F.sum("length")).first()[0]
    assert total == 600_006 and stored / total <= 0.85


def test_files_to_tree_and_back(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/a.txt").write_bytes(b"abc")
    (tmp_path / "d/e/b.txt").write_bytes(b"defg")
    (tmp_path / "d/skip.tmp").write_bytes(b"x")
    found = files.scan(spark, f"file://{tmp_path}/d", ignore=["*.tmp"])
    assert {(r.path, r.size) for r in found.where("not is_dir").collect()} == {("a.txt", 3), ("e/b.txt", 4)}
    texts = files.contents(spark, f"file://{tmp_path}/d")
    assert texts.where(F.col("content_hash") == F.sha2(F.lit(b"abc"), 256)).count() == 1


def test_equal_trees_and_update(spark):
    one = spark.createDataFrame([("a", 1), ("d/b", 2)], "path string, size long").withColumns({"mode": F.lit(0).cast("long"), "mod_time": F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")})
    t = tree.with_directories(one)
    assert tree.equal(t, t, tree.STAT)
    two = tree.with_directories(one.where("path <> 'd/b'"))
    changes = tree.update(t, two)
    assert {r.path: r.action for r in changes.collect()} == {"": "dir", "a": "reuse", "d": "delete"}
    assert tree.updated_tree(changes).count() == two.count()


def test_variables(spark):
    none = spark.createDataFrame([], variables.SCHEMA)
    held = variables.set_value(variables.set_value(none, "foo", "41"), "foo", "42")
    assert variables.get_value(held, "foo") == "42"
    with pytest.raises(variables.NotFound):
        variables.get_value(held, "bar")


def test_stream_equals_batch(spark, tmp_path):
    rows = [("foo/a", datetime(2024, 1, d)) for d in (1, 3, 2)] + [("bar", datetime(2024, 1, 1))]
    for r in rows:
        spark.createDataFrame([r], "path string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    query = watch.watch(watch.read_changes(spark, f"{tmp_path}/events"), "changes", "0 seconds")
    query.processAllAvailable()
    query.stop()
    batch = watch.rollup(spark.createDataFrame(rows, "path string, ts timestamp_ntz"))
    assert {tuple(r) for r in spark.table("changes").collect()} == {tuple(r) for r in batch.collect()}


def test_paths(spark):
    row = spark.range(1).select(paths.ancestors(F.lit("a/b/c")).alias("up"), paths.ancestors(F.lit(""), itself=True).alias("root"), paths.depth(F.lit("")).alias("d")).first()
    assert row.up == ["", "a", "a/b"] and row.root == [""] and row.d == 0


def test_null_fields_are_equal_in_index_upkeep(spark):
    schema = "a string, b int, key string"
    rows = spark.createDataFrame([(None, 1, "k"), ("x", None, "l"), ("y", 2, "m")], schema)
    assert entity.index_gc(rows, rows).isEmpty()
    gone = rows.where("a is null").withColumn("change", F.lit("del"))
    assert entity.apply_diff(rows, gone).count() == 2
    objects = spark.createDataFrame([("k",), ("l",)], "key string")
    assert entity.clean_index(rows.select(F.col("a").alias("ref"), "key").where("a is null"), ["ref", "key"], objects).isEmpty()
    assert keyset.delete(rows.select("a"), rows.select("a").where("a is null")).count() == 2
    assert keyset.has(rows.select("a"), rows.select("a")).count() == 3


def test_an_entity_has_seven_index_rows(spark):
    new = spark.createDataFrame([("foo", b"42", "int", "foo", 1, [])], "ns string, payload binary, type string, name string, version int, refs array<string>")
    objects, held, changes = entity.save(None, new)
    assert objects.count() == 1 and changes.count() == 7
    assert [x.count() for x in entity.save(held, new)] == [0, 1, 0]
    more = new.withColumn("payload", F.lit(b"43"))
    objects, held, changes = entity.save(held, more)
    assert held.count() == 2 and entity.entity_index(held).count() == 14


def test_a_second_writer_fails(spark, tmp_path):
    one = stores.ParquetStore(spark, f"file://{tmp_path}/store")
    row = lambda x: spark.createDataFrame([("foo", x)], "ns string, payload binary")
    batch = one.append(one_row := row(b"1").withColumn("hash", F.sha2("payload", 256)))
    one.publish([batch], 0)
    with pytest.raises(RuntimeError, match="another writer"):
        one.publish([one.append(one_row)], 0)
    one.write(row(b"2"))
    keys = one.keys()
    assert keys.count() == 2
    one.delete(one_row.select("ns", "hash"))
    assert one.keys().count() == 1
    assert one.write(row(b"1")).where("written").count() == 1 and one.keys().count() == 2
    one.compact()
    assert one.keys().count() == 2 and len(one.batches()) == 1


def test_variables_stay(spark, tmp_path):
    held = variables.Variables(spark, f"file://{tmp_path}/vars")
    held.set("foo", "41")
    held.set("foo", "42")
    assert variables.Variables(spark, f"file://{tmp_path}/vars").get("foo") == "42"


def test_pushing_what_the_source_lacks_is_an_error(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    a = spark.createDataFrame([("a",)], "node string")
    with pytest.raises(LookupError, match="b is referred"):
        graph.copy(a, a.where("false"), a, edges)


def test_index_changes_equal_a_comparison_of_all_rows(spark):
    """Also with several summaries of a key, summaries that are entities themselves, nulls and repeated rows; only summaries are shuffled."""
    schema = "ns string, payload binary, type string, name string, version int, refs array<string>"
    first = [("a", b"1", "t", "n", 1, ["x", "y", None]), ("a", b"2", "t", None, 1, None), ("a", b"3", "t", "n", 1, ["x"]), ("a", b"3", "t", "m", 1, ["x"]), ("a", b"3", "t", "m", 1, ["x"]), ("a", None, "t", "n", 1, [])]
    _, held, _ = entity.save(None, spark.createDataFrame(first, schema))
    one = held.where("name = 'n' and version = 1").join(held.groupBy("key").count().where("count = 1"), "key").where("hash is not null").first()
    refs = "".join(f",{r}" for r in one.refs if r)[1:]
    told = f"{one.key}|{one.type}|{one.name}|{one.version}|{refs}".encode()  # its payload has the hash of that summary
    second = [("a", b"1", "t", "n", 2, ["y", "z"]), ("a", b"3", "t", "k", 1, ["x"]), ("a", b"4", None, "n", None, []), ("c-sumary", told, "s", "n", 1, [one.key])]
    third = [("a", b"1", "t", "n", 1, ["x", "y", None]), ("a", b"2", "t", None, 1, []), ("c-sumary", told, "s", "m", 1, [one.key]), ("a", b"3", "t", "l", 1, ["x"]), ("a", b"3", "t", "o", 3, [])]
    for rows in (second, third):
        _, after, changes = entity.save(held, spark.createDataFrame(rows, schema))
        new = entity.summarize(spark.createDataFrame(rows, schema).withColumn("hash", F.sha2("payload", 256)))
        whole = entity.index_diff(entity.entity_index(held.join(new, "key", "left_semi")), entity.entity_index(new))
        assert sorted(map(str, changes.collect())) == sorted(map(str, whole.collect()))
        _, again, _ = entity.update_index(after, 2)
        old = after.where("version is null or version <> 2")
        whole = entity.index_diff(entity.entity_index(old), entity.entity_index(entity.summarize(old.withColumn("version", F.lit(2)))))
        assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))
        held = after.localCheckpoint()
    assert one.summary == "c-sumary:" + spark.range(1).select(F.sha2(F.lit(told), 256)).first()[0]


def test_a_save_deals_summaries_not_index_rows(spark, capsys):
    new = spark.range(3000).select(F.lit("a").alias("ns"), F.encode(F.col("id").cast("string"), "UTF-8").alias("payload"), F.lit("t").alias("type"), F.col("id").cast("string").alias("name"), F.lit(1).alias("version"), F.array(F.lit("b")).alias("refs"))
    _, _, changes = entity.save(None, new)
    assert changes.count() == 27000
    changes.explain()
    plan = capsys.readouterr().out.split("replicaterows")[0]  # up to the comparison row by row, which has nothing to do here
    assert plan.count("Exchange") == 1 and "inline" in plan


def test_closure_writes_repeated_edges_without_a_shuffle(spark, monkeypatch, capsys):
    written, write = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: written.append(df) or write(df))
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("x", "a")] * 2, "src string, dst string")
    roots = spark.createDataFrame([("a",), ("a",)], "node string")
    assert sorted(r.node for r in graph.closure(roots, edges).collect()) == ["a", "b", "c"]
    written[0].explain()
    assert "Exchange" not in capsys.readouterr().out


def test_payloads_are_compressed_in_small_batches(spark, capsys):
    codec = codecs.Hybrid(codecs.Deflate())
    rows = spark.createDataFrame([(b"",), (b"ab" * 50000,), (b"\x00\xff",), (None,)], "p binary")
    stored = rows.select("p", codec.encode(F.col("p")).alias("s"))
    stored.explain()
    assert "ArrowEvalPython" not in capsys.readouterr().out
    assert stored.where("length(s) < length(p)").count() == 1
    assert stored.select(codec.decode(F.col("s")).eqNullSafe(F.col("p"))).distinct().collect() == [(True,)]
