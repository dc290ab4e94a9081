"""Object stores on Parquet: (ns, hash, payload), partitioned by namespace, and compositions of them.

A store is a folder of batches, tombstones and manifests. A manifest is one file that names, in order, the
batches and tombstones that are live; it is created only if no file of its number exists, so of two writers
that saw the same state one fails and nothing is lost in silence. A batch whose commit never came is ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.codecs import Codec
from keyloom.operators.entity import KeyNotFound, scrub, write_if_absent

SCHEMA = "ns string, hash string, payload binary"
KEY = ["ns", "hash"]


class KeyNotMatch(ValueError):
    """A payload does not have the hash of its key."""


class ReadDisabled(RuntimeError):
    pass


class WriteDisabled(RuntimeError):
    pass


@dataclass
class ParquetStore:
    """Put-if-absent object store in a folder that Spark reads and writes."""

    spark: SparkSession
    folder: str
    codec: Codec = field(default_factory=Codec)
    readable: bool = True
    writable: bool = True

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def manifests(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifests")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []

    def batches(self) -> list[str]:
        """What the newest manifest names: batches, and tombstones with a leading minus."""
        found = self.manifests()
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{found[-1]}", wholetext=True).first()[0]) if found else []

    def publish(self, batches: list[str], seen: int | None = None) -> None:
        """Make batches the live ones, as the manifest after number `seen` (the newest now). Fails if another writer made that one."""
        version = ((self.manifests() or [0])[-1] if seen is None else seen) + 1
        try:
            out = self._fs().create(self._path(f"manifests/{version}"), False)
        except Exception as e:
            raise RuntimeError(f"manifest {version} was published by another writer") from e
        out.write(bytearray(json.dumps(batches).encode()))
        out.close()

    def id(self) -> str:
        """A stable identity, made when first asked for."""
        path = f"{self.folder}/id"
        if not self._fs().exists(self._path("id")):
            self.spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.text(path)
        return self.spark.read.text(path).first()[0]

    def stored(self) -> DataFrame:
        """ns, hash, payload as stored (encoded): a tombstone takes keys out of the batches before it."""
        if not self.readable:
            raise ReadDisabled(self.folder)
        out, run = self.spark.createDataFrame([], SCHEMA), []

        def read(names: list[str]) -> DataFrame:
            live = [f"{self.folder}/batches/batch={b}" for b in names]
            return self.spark.read.schema(SCHEMA).option("basePath", f"{self.folder}/batches").parquet(*live).select("ns", "hash", "payload")

        for name in self.batches():
            if not name.startswith("-"):
                run.append(name)
                continue
            out = out.unionByName(read(run)) if run else out
            gone, run = self.spark.read.schema("ns string, hash string").parquet(f"{self.folder}/gone/{name[1:]}"), []
            out = out.join(gone, KEY, "left_anti")
        return out.unionByName(read(run)) if run else out

    def objects(self) -> DataFrame:
        return self.stored().withColumn("payload", self.codec.decode(F.col("payload")))

    def append(self, objects: DataFrame) -> str:
        """Write a batch without publishing it."""
        if not self.writable:
            raise WriteDisabled(self.folder)
        name = uuid.uuid4().hex
        objects.select("ns", "hash", self.codec.encode(F.col("payload")).alias("payload")).write.partitionBy("ns").parquet(f"{self.folder}/batches/batch={name}")
        return name

    def write(self, objects: DataFrame) -> DataFrame:
        """Add objects (ns, payload); returns ns, hash, written of each key offered. Keys that are there are not written again."""
        before, seen = self.batches(), (self.manifests() or [0])[-1]
        hashed = objects.select("ns", F.sha2("payload", 256).alias("hash"), "payload")
        known = self.stored().select(*KEY)
        name = self.append(write_if_absent(known, hashed))
        added = self.spark.read.schema(SCHEMA).option("basePath", f"{self.folder}/batches").parquet(f"{self.folder}/batches/batch={name}").select(*KEY)
        if not added.isEmpty():
            self.publish([*before, name], seen)
        return hashed.select(*KEY).distinct().join(added.withColumn("new", F.lit(True)), KEY, "left").select(*KEY, F.col("new").isNotNull().alias("written"))

    def read(self, keys: DataFrame) -> DataFrame:
        """Payloads of keys (ns, hash). A missing key is KeyNotFound, a payload of another hash KeyNotMatch."""
        found = keys.distinct().join(self.objects(), KEY, "left")
        bad = found.where(F.col("payload").isNull() | (F.sha2("payload", 256) != F.col("hash"))).limit(1).collect()
        if bad:
            raise (KeyNotFound if bad[0]["payload"] is None else KeyNotMatch)(f"{bad[0]['ns']}:{bad[0]['hash']}")
        return found

    def exists(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.stored().select(*KEY), KEY, "left_semi")

    def keys(self, ns: str | None = None, prefix: str = "") -> DataFrame:
        """Keys of a namespace (the others' partitions are not read), or all; of them those whose hash begins with prefix."""
        rows = self.stored().select(*KEY).where(F.col("hash").startswith(prefix))
        return rows if ns is None else rows.where(F.col("ns") == ns)

    def delete(self, keys: DataFrame) -> None:
        """Write a tombstone for keys; payloads stay until compact(). Keys that aren't there change nothing."""
        before, seen, name = self.batches(), (self.manifests() or [0])[-1], uuid.uuid4().hex
        keys.select(*KEY).distinct().write.parquet(f"{self.folder}/gone/{name}")
        self.publish([*before, f"-{name}"], seen)

    def compact(self) -> None:
        """Rewrite what is live as one batch."""
        seen, name = (self.manifests() or [0])[-1], uuid.uuid4().hex
        self.stored().write.partitionBy("ns").parquet(f"{self.folder}/batches/batch={name}")
        self.publish([name], seen)

    def scrub(self) -> DataFrame:
        return scrub(self.objects())


@dataclass
class Transaction:
    """Batches staged on a store: read-your-writes, visible to others on commit only. A nested one commits by itself."""

    store: ParquetStore
    staged: list[str] = field(default_factory=list)

    def objects(self) -> DataFrame:
        out = self.store.objects()
        for b in self.staged:
            part = self.store.spark.read.schema(SCHEMA).parquet(f"{self.store.folder}/batches/batch={b}")
            out = out.unionByName(part.withColumn("payload", self.store.codec.decode(F.col("payload"))))
        return out

    def write(self, objects: DataFrame) -> None:
        hashed = objects.select("ns", F.sha2("payload", 256).alias("hash"), "payload")
        self.staged.append(self.store.append(write_if_absent(self.objects().select(*KEY), hashed)))

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self.staged:
            self.store.publish([*self.store.batches(), *self.staged])
        self.staged = []


def stacked_read(backing: DataFrame, upstream: DataFrame) -> DataFrame:
    """Backing first, then upstream: ns, hash, payload, from_backing."""
    rows = upstream.withColumnRenamed("payload", "up").join(backing.withColumnRenamed("payload", "back"), KEY, "full_outer")
    return rows.select(*KEY, F.coalesce("back", "up").alias("payload"), F.col("back").isNotNull().alias("from_backing"))


def stacked_keys(backing: DataFrame, upstream: DataFrame, through: bool = True) -> DataFrame:
    """Keys of upstream and those only backing has; around: upstream's only."""
    return upstream.unionByName(backing.join(upstream, backing.columns, "left_anti")) if through else upstream


def to_cache(backing: DataFrame, upstream: DataFrame, read: DataFrame) -> DataFrame:
    """What reading keys `read` through a caching stack adds to backing."""
    return upstream.join(read, KEY, "left_semi").join(backing.select(*KEY), KEY, "left_anti")


def sharded_keys(default: DataFrame, shards: dict[str, DataFrame]) -> DataFrame:
    """Keys of the default store and of each namespace's shard, unless the default has that namespace; with the route."""
    out = default.withColumn("route", F.lit("default"))
    seen = default.select("ns").distinct()
    for ns, rows in shards.items():
        out = out.unionByName(rows.where(F.col("ns") == ns).join(seen, "ns", "left_anti").select(*default.columns).withColumn("route", F.lit(ns)))
    return out


def sharded_read(keys: DataFrame, default: DataFrame, shards: dict[str, DataFrame]) -> DataFrame:
    """ns, hash, payload of keys: a namespace with a shard is read there, any other from the default store."""
    out = default.where(~F.col("ns").isin(sorted(shards))) if shards else default
    for ns, rows in shards.items():
        out = out.unionByName(rows.where(F.col("ns") == ns).select(*default.columns))
    return keys.select(*KEY).distinct().join(out, KEY)


def offload(objects: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(stubs and small objects, offloaded payloads): payloads that satisfy predicate go elsewhere and leave a stub."""
    away = F.coalesce(predicate, F.lit(False))
    main = objects.select(*KEY, F.when(~away, F.col("payload")).alias("payload"), away.alias("is_offloaded"))
    return main, objects.where(away)


def read_offloaded(main: DataFrame, *stores: DataFrame) -> DataFrame:
    """Payloads, those of stubs from the first store that has them."""
    out = main
    for i, s in enumerate(stores):
        out = out.join(s.select(*KEY, F.col("payload").alias(f"p{i}")), KEY, "left")
    return out.select(*KEY, F.coalesce("payload", *[f"p{i}" for i in range(len(stores))]).alias("payload"))


def tapped(rows: DataFrame, name: str, on: Callable[[dict], None] | None = None, **metrics: Column):
    """rows observed: metrics arrive with the action that reads them. Returns (rows, observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen
