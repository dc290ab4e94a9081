r"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows.

Words are the runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z. A window is `window`
consecutive words of an item; an item of fewer words, but some, is one window. A window is treated as
the set of its shingles (up to three words long). A document that holds the window holds all of its
shingles, so one is enough as the necessary prefix: the rarest, by its count over all documents. Only
those prefix tokens are joined. A joined occurrence must leave room for the window on both sides
(length and positional bounds) and then the words around it are compared one by one, to the left and
to the right, as far as they agree; every stretch of at least the window's length is a hit.

1. Count the benchmark's shingles over all documents (tasks drop other shingles by a 4 MB bitmap).
2. Choose each window's rarest shingle and list (shingle, item, position, the words around it).
3. Scan the documents again and emit one row each: its word count and, for every prefix token in it,
   the place and the words around it.
4. Join on the token, verify, merge the hits of each document.

Defined results: null has no words; empty texts have none either and hash the empty string; repeated
rows are documents of their own; repeated item ids count once; items with a null id hit words but are
not listed; an empty benchmark hits nothing; of equally rare shingles of a window the leftmost is its
prefix; texts of any length are read whole; further columns are ignored, whatever their names; an empty
table gives no rows. doc_id may be of any type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import bit_filter, in_filter, materialize, own, row_id, table
from keyloom.llm.words import ALNUM, LOWER, M1, chunks, fmix, word_hashes, word_spans

WINDOW = 10
GRAM = 3
BITS = 25


def grams(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on; 0 where the text ends before."""
    out = np.zeros(len(h), np.uint64)
    n = len(h) - k + 1
    if n > 0:
        acc = h[:n] * M1 + np.uint64(k)
        for j in range(1, k):
            acc = fmix(acc * M1 + h[j : j + n])
        end = np.repeat(first[1:], np.diff(first))[:n]
        out[:n] = np.where(np.arange(n) + k <= end, acc | np.uint64(1), 0)
    return out


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def around(text: bytes, starts, ends, a: int, b: int) -> list[str]:
    return [text[s:e].decode("utf-8", "replace") for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]


def item_tokens(window: int):
    """Every shingle of every item: a key of the item's text (ids may be null or repeated), its hash, its size, where it lies, and the item's words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = [hashlib.sha256((t or "").encode()).hexdigest() for t in batch.column(1).to_pylist()]
            for a, b, data, offsets in chunks(batch.column(1)):
                starts, ends, first = word_spans(data, offsets, ALNUM)
                h, text = word_hashes(data, starts, ends), LOWER[data].tobytes()
                sized = {k: grams(h, first, k) for k in range(1, GRAM + 1)}
                rows = []
                for i in range(b - a):
                    lo, hi = int(first[i]), int(first[i + 1])
                    need = min(window, hi - lo)  # words of this item's windows
                    k = min(GRAM, need)
                    for p in range(lo, hi - k + 1) if need else ():
                        left, right = max(lo, p - need + k), min(hi, p + need)
                        rows.append((batch.column(0)[a + i].as_py(), sha[a + i], int(sized[k][p : p + 1].view(np.int64)[0]), k, need, p - lo, hi - lo, p - left, around(text, starts, ends, left, right)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, TOKEN_TYPES)], TOKEN_NAMES)

    return run


TOKEN_NAMES = ["item", "row", "token", "k", "need", "at", "item_words", "left", "around"]
TOKEN_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]


def counts_of(found):
    """(token, n) of the benchmark's shingles in the texts of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for _, _, data, offsets in chunks(batch.column(0)):
                starts, ends, first = word_spans(data, offsets, ALNUM)
                h = word_hashes(data, starts, ends)
                for k in range(1, GRAM + 1):
                    g = grams(h, first, k)
                    hits.append(g[(g != 0) & in_filter(found.value, g)])
            t, n = np.unique(np.concatenate(hits or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(t), pa.array(n)], ["token", "n"])

    return run


HITS = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("around", pa.list_(pa.string()))]))


def occurrences(found, window: int):
    """One row for each document: its word count and the occurrences of prefix tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for a, b, data, offsets in chunks(batch.column(1)):
                starts, ends, first = word_spans(data, offsets, ALNUM)
                h, text = word_hashes(data, starts, ends), None
                counts[a:b] = np.diff(first)
                for k in range(1, GRAM + 1):
                    g = grams(h, first, k)
                    hit = np.flatnonzero((g != 0) & in_filter(found.value, g))
                    text = text or (len(hit) and LOWER[data].tobytes())
                    for p, i in zip(hit.tolist(), (np.searchsorted(first, hit, "right") - 1).tolist()):
                        left, right = max(int(first[i]), p - window + k), min(int(first[i + 1]), p + window)
                        lists[a + i].append({"token": int(g[p : p + 1].view(np.int64)[0]), "at": p - int(first[i]), "left": p - left, "around": around(text, starts, ends, left, right)})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(lists, HITS)], ["doc_id", "n_words", "hits"])

    return run


def agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verify joined occurrences: extend from the token while the words agree; keep stretches of a window's length."""
    for batch in batches:
        uid, item, start, end = [], [], [], []
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for u, at, dl, doc, it, k, need, il, words in zip(*cols):
            if doc[dl : dl + k] != words[il : il + k]:
                continue  # only the hashes agree
            l = r = 0
            while l < min(dl, il) and doc[dl - l - 1] == words[il - l - 1]:
                l += 1
            while r < min(len(doc) - dl, len(words) - il) - k and doc[dl + k + r] == words[il + k + r]:
                r += 1
            if l + k + r >= need:
                uid.append(u), item.append(it), start.append(at - l), end.append(at + k + r)
        yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(item, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["uid", "item", "start", "end"])


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(documents: uid, doc_id, n_words; hits: uid, item, start, end in words, each a stretch of verified windows)."""
    docs = own(documents, "doc_id", "text")
    tokens = own(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text")
    tokens = materialize(tokens.mapInArrow(item_tokens(window), "item string, row string, token long, k int, need int, at int, item_words int, left int, around array<string>"), "tokens")
    every = bit_filter(tokens.select("token").distinct(), "token", BITS)
    seen = docs.select("text").mapInArrow(counts_of(every), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = materialize(tokens.join(seen, "token"), "counted")  # tokens in no document need no row: their windows occur nowhere
    every.destroy()
    # A window is the tokens at at..at+need-k of its item; its rarest token is chosen, the leftmost of equally rare ones.
    token = counted.select("row", "item_words", "at", "k", "need", "n", "token").distinct()
    windows = token.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("need") + F.col("k")), F.least(F.col("at"), F.col("item_words") - F.col("need")))))
    chosen = windows.groupBy("row", "w").agg(F.min(F.struct("n", "at", "token")).alias("m"), F.count("*").alias("there"), F.first("need").alias("need"), F.first("k").alias("k"))
    chosen = chosen.where("there >= need - k + 1").select("row", F.col("m.token").alias("token"), F.col("m.at").alias("at")).distinct()
    prefix = materialize(counted.select("item", "row", "token", "at", "k", "need", "left", "around").distinct().join(chosen, ["row", "token", "at"]), "prefix")
    rare = bit_filter(prefix.select("token").distinct(), "token", BITS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = materialize(docs.mapInArrow(occurrences(rare, window), f"doc_id {kind}, n_words long, hits array<struct<token:long,at:int,left:int,around:array<string>>>").select(row_id(), "*"), "occurrences")
    rare.destroy()
    hit = found.select("uid", F.explode("hits").alias("h")).select("uid", "h.*")
    joined = hit.join(prefix.select("token", "item", "k", "need", F.col("left").alias("il"), F.col("around").alias("words")), "token")
    # the length bound and the positional bounds: both sides have room for a window around the token, to the left and to the right
    before = F.least(F.col("left"), F.col("il"))
    behind = F.least(F.size("around") - F.col("left"), F.size("words") - F.col("il")) - F.col("k")
    joined = joined.where((behind >= 0) & (before + F.col("k") + behind >= F.col("need")))
    hits = joined.select("uid", "at", "left", "around", "item", "k", "need", "il", "words").mapInArrow(agreement, "uid long, item string, start int, end int")
    return found.drop("hits"), hits


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for every document."""
    docs, hits = contamination(documents, benchmark, window)
    # union of a document's stretches: in the order of their starts, what each adds beyond the furthest end so far
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    merged = F.aggregate(spans, F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(F.greatest(s["to"], x["end"]).alias("to"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["start"]))).cast("long").alias("n")), lambda s: s["n"])
    each = hits.groupBy("uid").agg(merged.alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    out = docs.join(each, "uid", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT u, n, p, array_to_string(w[p : p + n - 1], ' ') AS s FROM (SELECT u, n, w, unnest(range(1, greatest(1, len(w) - n + 2))) AS p FROM d, n)),
hit AS (SELECT u, dw.n, p, item FROM dw JOIN iw USING (n, s)),
pos AS (SELECT u, count(DISTINCT q) AS n_hit FROM (SELECT u, unnest(range(p, p + n)) AS q FROM hit) GROUP BY u),
its AS (SELECT u, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT u, item FROM hit WHERE item IS NOT NULL) GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (u) LEFT JOIN its USING (u)
"""
