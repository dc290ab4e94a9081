"""Suffix-array dedup: remove every byte covered by a 200-byte string that also starts anywhere else.

1. Shards. Every window of `LENGTH` bytes has a smallest hash among its `GRAM`-byte strings; equal windows
   have the same. Neighbouring windows of a text with the same smallest hash form a stretch, and a
   stretch goes to the shard of its hash, so all equal windows meet in one shard. A first scan counts
   the hashes by shuffle; only hashes that occur twice, or twice within one stretch, go on.
2. A stretch whose hash has only one content is repeated as a whole and needs no sorting. Of the others
   each distinct content goes to its shard once, cut from the text.
3. A task takes whole hashes, about `SHARD` bytes at a time, and builds the suffix array of their
   stretches by induced sorting (see suffixes.py): suffixes are classified, leftmost-smaller substrings
   are sorted and named recursively, and the array is induced from them in linear passes. Permuted common
   prefixes of 200 bytes and more mark the windows that repeat. Contents seen twice or more repeat as a whole.
4. A hash with more than `MOST` bytes of contents, such as that of a passage which very many texts share,
   is split into shards by further bytes: the windows whose smallest string lies at nearly the same place in
   them have bytes around it in common, and the hash of these is their shard. Equal windows have them in
   common too. Pieces that have become equal are one, and a shard that is still too large is split again,
   down to single windows; each shard goes through step 3.
5. The marked bytes of a document are merged and cut out.

Matches never cross documents; a text of fewer than 200 bytes keeps all. Windows are compared by their
bytes inside a shard. Whole stretches are compared by two independent 64-bit hashes, that of their smallest
string and that of their content, which different stretches share with a chance of about 2**-64 a pair of
one shard. Texts are scanned in segments of `SEGMENT` bytes, so scanning takes memory for one text.

Defined results: null is empty, an empty text keeps the hash of the empty string; repeated rows and ids
are rows of their own and repeat each other, so all their bytes from 200 on go, in every copy; texts of any
length are scanned whole; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import bit_filter, discard, in_filter, materialize, own, row_id, table
from keyloom.llm.suffixes import common_prefixes, suffix_array
from keyloom.llm.words import M1, M2, M3, S33, chunks, fmix

LENGTH = 200
GRAM = 32
SEGMENT = 1 << 20
SHARD = 2 << 20
MOST = 8 << 20
#: How far apart the places of the smallest string may lie in the windows of a shard, as it is split again and again.
WIDTHS = (85, 22, 6, 1)
BITS = 26
SEPARATOR = 1


@cache
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of an odd number and of its inverse modulo 2**64."""
    values = fmix(np.arange(1, 257, dtype=np.uint64) * M3)
    n = SEGMENT + 4 * LENGTH
    ones = np.full(n, M1)
    ones[0] = 1
    inverse = np.full(n, pow(int(M1), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return values, np.cumprod(ones), np.cumprod(inverse)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    h = eights[:n] * M1
    for k, m in ((8, M2), (16, M3), (24, M1 ^ M3)):
        h ^= h >> S33
        h += eights[k : k + n] * m
    h = (h ^ (h >> S33)) * M2
    return h ^ (h >> S33)


def sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    padded = np.append(h, np.full(-len(h) % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    down = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    up = np.minimum.accumulate(padded, 1).ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, inner: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start in it, windows, hash, content hash, whether the hash occurs twice inside) of the stretches of a run of texts."""
    width = length - GRAM + 1
    step = SEGMENT
    for low in range(0, max(0, len(data) - length + 1), step):
        part = data[low : low + step + length - 1]
        starts = np.arange(len(part) - length + 1)
        text = np.searchsorted(offsets, starts + low, "right") - 1
        fits = starts + low + length <= offsets[text + 1]
        grams = gram_hashes(part)
        least = sliding_minimum(grams, width)
        p = starts[fits]
        if not len(p):
            continue
        m = least[p]
        new = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (m[1:] != m[:-1])])
        first = np.flatnonzero(new)
        s, h = p[first], m[first]
        n = np.diff(np.append(first, len(p)))
        values, power, inverse = powers()
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[part] * power[: len(part)])])
        end = s + n + length - 1
        content = fmix(((sums[end] - sums[s]) * inverse[s]) ^ (n.astype(np.uint64) * M3))
        twice = n > width
        if inner:
            for at in range(0, len(s), 2048):
                rows = slice(at, at + 2048)
                span = np.minimum(s[rows, None] + np.arange(2 * width - 1), len(grams) - 1)
                hit = (grams[span] == h[rows, None]) & (np.arange(2 * width - 1) < (n[rows] + width - 1)[:, None])
                twice[rows] |= hit.sum(1) > 1
        yield text[s], s + low - offsets[text[s]], n, h, content, twice


def first_scan(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), SEGMENT):
                for _, _, _, h, content, twice in stretches(data, offsets, length, True):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(content.view(np.int64)), pa.array(twice)], ["hash", "content", "twice"])

    return run


STRETCHES = pa.list_(pa.struct([("hash", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))


def second_scan(found, length: int):
    """A row for each text: its length, and either the hash of its bytes or the bytes and their stretches that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1), SEGMENT):
                parts = [(x, s, n, h, c) for x, s, n, h, c, _ in stretches(data, offsets, length, False)]
                text, s, n, h, c = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
                hit = in_filter(found.value, h)
                text, s, n, h, c = text[hit], s[hit], n[hit], h[hit], c[hit]
                cut = np.searchsorted(text, np.arange(b - a + 1))
                inside = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], ["hash", "content", "start", "n"])
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), inside)
                raw = [data[x:y].tobytes() for x, y in zip(offsets, offsets[1:])]
                has = np.diff(cut) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array([None if y else hashlib.sha256(x).hexdigest() for x, y in zip(raw, has)], pa.string()), pa.array([x if y else None for x, y in zip(raw, has)], pa.binary()), lists],
                    ["doc_id", "n_bytes", "sha256", "text", "stretches"],
                )

    return run


STRINGS = "hash long, gram long, content long, many boolean, bytes binary"


def cuts(length: int):
    """Cut stretches out of their texts: (text, list of stretches) -> STRINGS; gram: the smallest hash of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column(0), batch.column(1)):
                view = text.as_buffer()
                for p in parts.as_py():
                    rows.append((p["hash"], p["hash"], p["content"], p["many"], view[p["start"] : p["start"] + p["n"] + length - 1].to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["hash", "gram", "content", "many", "bytes"])

    return run


def spans_of(starts: np.ndarray, length: int) -> list[dict[str, int]]:
    """Merged spans of the windows at the given places, in order."""
    if not len(starts):
        return []
    head = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + length]))
    tail = np.append(head[1:], len(starts)) - 1
    return [{"a": int(x), "b": int(y)} for x, y in zip(starts[head], starts[tail] + length)]


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def repeated(strings: list[bytes], many: list[bool], length: int) -> list[list[dict[str, int]]]:
    """For each string the merged spans of its windows that start anywhere else too."""
    size = np.array([len(s) for s in strings])
    start = np.concatenate([[0], np.cumsum(size + 1)])
    data = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    symbols = data.astype(np.uint16) + 2
    symbols[start[1:] - 1] = SEPARATOR
    sa = suffix_array(symbols, 258)
    prefix, before = common_prefixes(data, sa, length)
    whole = np.zeros(len(data), bool)
    for s, n in zip(start.tolist(), size.tolist()):
        whole[s : s + n - length + 1] = True
    hit = np.flatnonzero((prefix >= length) & whole & whole[before])
    twice = np.zeros(len(data), bool)
    twice[hit] = True
    twice[before[hit]] = True
    return [[{"a": 0, "b": n}] if m else spans_of(np.flatnonzero(twice[s : s + n]), length) for s, n, m in zip(start.tolist(), size.tolist(), many)]


def shard_arrays(length: int):
    """Rows in order of hash -> (hash, content, spans): suffix arrays over whole hashes, about SHARD bytes at a time."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        spans = repeated([r[4] for r in rows], [r[3] for r in rows], length)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows]), pa.array(spans, SPANS)], ["hash", "content", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= SHARD and row[0] != rows[-1][0]:
                    yield emit(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield emit(rows)

    return run


def pieces(length: int, width: int):
    """Cut strings into runs of windows whose smallest string lies within `width` places: (hash, content, offset) of each piece, its shard and content there, and the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "content", "offset", "gram", "shard", "piece", "many", "bytes"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            rows = []
            for h, gram, content, many, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                n = len(data) - length + 1
                at = np.flatnonzero(gram_hashes(np.frombuffer(data, np.uint8)).view(np.int64) == gram)
                place = at[np.searchsorted(at, np.arange(n))]  # of the first such string in each window
                rung = (place - np.arange(n)) // width
                first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (rung[1:] != rung[:-1])]))
                for a, b, p, r in zip(first.tolist(), np.append(first[1:], n).tolist(), place[first].tolist(), rung[first].tolist()):
                    common = data[p - r * width : p - (r + 1) * width + 1 + length]  # of all windows of this rung
                    whole = data[a : b - 1 + length]
                    shard = hashlib.blake2b(common + struct.pack("<qq", gram, r), digest_size=8).digest()
                    rows.append((h, content, a, gram, *struct.unpack("<qq", shard + hashlib.blake2b(whole, digest_size=8).digest()), many, whole))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names)

    return run


def marked_spans(strings: DataFrame, length: int, most: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """hash, content, a, b: the spans of windows that repeat, of every content (step 3; of large hashes step 4)."""
    large = strings.groupBy("hash").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > most).select("hash")
    large = materialize(large if widths else large.where("false"), "large")
    cold = strings.join(large, "hash", "left_anti").repartition("hash").sortWithinPartitions("hash").select("hash", "gram", "content", "many", "bytes")
    spans = cold.mapInArrow(shard_arrays(length), "hash long, content long, spans array<struct<a:int,b:int>>").select("hash", "content", F.explode("spans").alias("x")).select("hash", "content", "x.a", "x.b")
    spans = materialize(spans, "marked")
    if large.isEmpty():
        return spans
    hot = strings.join(large, "hash").select("hash", "gram", "content", "many", "bytes")
    parts = materialize(hot.mapInArrow(pieces(length, widths[0]), "hash long, content long, offset int, gram long, shard long, piece long, many boolean, bytes binary"), "pieces")
    below = parts.groupBy("shard", "piece").agg(F.first("gram").alias("gram"), (F.max("many") | (F.count("*") > 1)).alias("many"), F.first("bytes").alias("bytes"))
    below = materialize(below.select(F.col("shard").alias("hash"), "gram", F.col("piece").alias("content"), "many", "bytes"), "strings")
    found = marked_spans(below, length, most, widths[1:]).toDF("shard", "piece", "a", "b")
    back = parts.select("hash", "content", "offset", "shard", "piece").join(found, ["shard", "piece"])
    return spans.unionByName(back.select("hash", "content", (F.col("a") + F.col("offset")).alias("a"), (F.col("b") + F.col("offset")).alias("b")))


def removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, n, sha, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist()):
            if text.as_py() is None:
                out.append((doc, n, 0, 0, sha, []))
                continue
            raw, kept, at, runs = text.as_py(), hashlib.sha256(), 0, []
            for x in sorted((x["a"], x["b"]) for x in spans or []):
                if runs and x[0] <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(x[1], runs[-1][1]))
                else:
                    runs.append(x)
            for a, b in runs:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((doc, n, sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"a": a, "b": b} for a, b in runs]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), SPANS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def counted_hashes(docs: DataFrame, length: int) -> DataFrame:
    """hash, several: the hashes that occur twice or more, and whether their stretches differ or repeat inside."""
    rows = docs.select("text").mapInArrow(first_scan(length), "hash long, content long, twice boolean")
    by = rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("twice").alias("twice"))
    return materialize(by.where("n > 1 or twice").select("hash", (F.col("twice") | (F.col("lo") != F.col("hi"))).alias("several")), "hashes")


def repeated_spans(docs: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(texts: uid, doc_id, n_bytes, sha256, text; spans: uid, a, b, which may overlap)."""
    hashes = counted_hashes(docs, length)
    found = bit_filter(hashes, "hash", BITS)
    texts = materialize(docs.mapInArrow(second_scan(found, length), "doc_id long, n_bytes long, sha256 string, text binary, stretches array<struct<hash:long,content:long,start:int,n:int>>").select(row_id(), "*"), "texts")
    found.destroy()
    rows = texts.select("uid", F.explode("stretches").alias("s")).select("uid", "s.*").join(hashes, "hash")
    rows = materialize(rows, "stretches")
    discard(hashes)
    whole = rows.where("not several").select("uid", F.col("start").alias("a"), (F.col("start") + F.col("n") + length - 1).alias("b"))
    some = rows.where("several")
    contents = some.groupBy("hash", "content").agg(F.count("*").alias("c"), F.min(F.struct("uid", "start", "n")).alias("at"))
    contents = contents.select("hash", "content", "at.*", (F.col("c") > 1).alias("many"))
    pick = contents.groupBy("uid").agg(F.collect_list(F.struct("hash", "content", "start", "n", "many")).alias("parts"))
    strings = materialize(texts.select("uid", "text").join(pick, "uid").select("text", "parts").mapInArrow(cuts(length), STRINGS), "strings")
    marked = materialize(marked_spans(strings, length, most), "marked")
    part = some.join(marked, ["hash", "content"]).select("uid", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    spans = materialize(whole.unionByName(part), "spans")
    for done in (strings, marked, rows):
        discard(done)
    return texts, spans


def remove_repeats(documents: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (byte spans) for every row of documents (doc_id, text)."""
    texts, spans = repeated_spans(own(documents, "doc_id", "text"), length, most)
    each = spans.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    out = texts.join(each, "uid", "left").select("doc_id", "n_bytes", "sha256", F.when(F.col("text").isNotNull(), F.col("text")).alias("text"), "spans")
    return out.mapInArrow(removal, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a:int,b:int>>")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")
