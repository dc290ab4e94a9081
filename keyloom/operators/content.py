"""Contents in chunks: fixed or content-defined, put together again, read by range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SMALL = 1 << 20
MOST = 32 << 20


def chunk_fixed(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, i, chunk, length: pieces of `size` characters; an empty text is one empty chunk."""
    last = F.greatest(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1)
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return rows.where(F.col(text).isNotNull()).select(key, F.posexplode(cut).alias("i", "chunk")).withColumn("length", F.length("chunk"))


def boundaries(data: np.ndarray, least: int, average: int, most: int) -> list[int]:
    """Ends of content-defined chunks: where a rolling hash of 32 bytes has its low bits clear, at least `least` and at most `most` bytes apart."""
    n = len(data)
    values = (np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15)) * np.uint64(0xC4CEB9FE1A85EC53)
    v = values[data] >> np.uint64(11)
    rolled = np.zeros(max(0, n - 31), np.uint64)
    for i in range(32 if n >= 32 else 0):  # a polynomial of the 32 values: their order counts
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + v[i : n - 31 + i]
    cuts = np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(max(1, average - least)) == 0) + 32
    ends, at = [], 0
    while n - at > most or (n - at > least and at < n):
        k = np.searchsorted(cuts, at + least)
        end = int(cuts[k]) if k < len(cuts) and cuts[k] <= at + most else min(n, at + most)
        if end >= n:
            break
        ends.append(end)
        at = end
    return [*ends, n]


def chunk_cdc(rows: DataFrame, key: str, content: str, small: int = SMALL, most: int = MOST) -> DataFrame:
    """key (string), i, chunk, length: contents smaller than `small` bytes whole, others cut at places that depend on their bytes.

    The largest chunk is min(size, most), the average half and the smallest a quarter of it. Cutting is sequential in
    a content, so it runs in Arrow batches, a content at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, c in zip(batch.column(0), batch.column(1)):
                raw = c.as_py() or b""
                top = max(1, min(len(raw), most))
                ends = [len(raw)] if len(raw) < small else boundaries(np.frombuffer(raw, np.uint8), max(1, top // 4), max(2, top // 2), top)
                starts = [0, *ends[:-1]]
                rows += [(k.as_py(), i, raw[a:b]) for i, (a, b) in enumerate(zip(starts, ends))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.int32(), pa.binary()))], ["key", "i", "chunk"])

    cut = rows.select(F.col(key).cast("string").alias("key"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "key string, i int, chunk binary")
    return cut.withColumn("length", F.length("chunk"))


def store_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects: hash, chunk once; files: key, i, hash, length)."""
    hashed = chunks.withColumn("hash", F.sha2(F.col("chunk").cast("binary"), 256))
    return hashed.select("hash", "chunk").dropDuplicates(["hash"]), hashed.select("key", "i", "hash", "length")


def reassemble(chunks: DataFrame, key: str, chunk: str = "chunk") -> DataFrame:
    """key, text: chunks in order of i, of the chunks' own type (string or binary)."""
    ordered = F.array_sort(F.collect_list(F.struct("i", F.col(chunk).alias("c"))))
    kind = chunks.schema[chunk].dataType.simpleString()
    parts = F.transform(ordered, lambda x: x["c"])
    whole = F.array_join(parts, "") if kind == "string" else F.unhex(F.array_join(F.transform(parts, F.hex), ""))
    return chunks.groupBy(key).agg(whole.alias("text"))


def read_range(chunks: DataFrame, key: str, start: int, length: int) -> DataFrame:
    """key, part: characters start..start+length of each text; only chunks that lie in the range are put together."""
    before = F.coalesce(F.sum("length").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = chunks.withColumn("at", before).where((F.col("at") < start + length) & (F.col("at") + F.col("length") > start))
    low = F.greatest(F.lit(start), F.col("at")) - F.col("at")
    high = F.least(F.lit(start + length), F.col("at") + F.col("length")) - F.col("at")
    piece = F.substring("chunk", (low + 1).cast("int"), (high - low).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("i", piece.alias("c"))))
    return placed.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["c"]), "").alias("part"))
