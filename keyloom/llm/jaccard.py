r"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Words are `[^\x20\x09-\x0D]+` after lower-casing A-Z; a document of fewer words than a shingle is one
shingle, a document without words has an empty set and links with nothing. Documents with equal sets
form one class, and only classes are compared. With T(n) = ceil(0.8 n), two linked sets of sizes m <= n
share at least T(n) shingles.

1. Filter. In the order of hashes, each set's first n - T(n) + l(n) shingles, with l(n) = 1 + n / 10,
   hold at least min(l(m), l(n)) shingles of any partner's. So a set stays only if that many of them are
   counted twice or more over all documents (counts by shuffle; a fixed 8 MB bitmap of them goes back
   to the tasks, and what it passes wrongly is only work).
2. Candidates. Of what stays, count shingles exactly, order each set by rarity and list the first
   n - T(n) + 1 of each (shingles in one set only fall away). Linked sets meet in a list. Every set is
   tied to the smallest of its lists, and the components of these ties are candidate clusters: linked
   sets lie in one cluster.
3. T-occurrence search by DivideSkip inside a cluster: for each query set, its short inverted lists are
   merged by a heap that skips ids which can't reach the overlap any more, and the longest lists are
   left out and then probed by binary search for the ids that still may. Exact overlaps decide. Ids that
   are already connected with the query are masked out, since components are what is asked for. A
   cluster with more than `TILE` shingles is cut into blocks by size and hash, and every two blocks of
   compatible sizes meet in one task, so no task holds an unbounded cluster; each returns a spanning
   forest of its links, not all pairs.
4. Components of the links, then the smallest doc_id of each.

Defined results: a null text is empty; a row of an empty set is its own component; repeated rows and
repeated ids are rows of their own; a null doc_id never names a component unless all ids there are
null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import bit_filter, components, discard, in_filter, materialize, row_id, row_key, table, tiles
from keyloom.llm.words import chunks, shingles, word_hashes, word_spans

WORDS_IN_SHINGLE = 5
PERCENT = 80
BITS = 26
TILE = 1 << 21
#: Weighs how many lists are left out against the length of the longest.
MU = 0.0085


def least_overlap(n, percent: int):
    return -(-percent * n // 100)


def extra(n):
    return 1 + n // 10


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for a, b, data, offsets in chunks(column):
        starts, ends, first = word_spans(data, offsets)
        h, _, of = shingles(word_hashes(data, starts, ends), first, k)
        order = np.argsort(of, kind="stable")
        h, cut = h[order], np.searchsorted(of[order], np.arange(b - a + 1))
        for i in range(b - a):
            s = np.sort(h[cut[i] : cut[i + 1]])
            yield a + i, s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def filter_tokens(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, out = set(), []
            for _, s in sets_of(batch.column(0), k):
                if len(s) and (d := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) not in seen:
                    seen.add(d)
                    out.append(s[: len(s) - least_overlap(len(s), percent) + extra(len(s))])
            t, n = np.unique(np.concatenate(out or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], ["token", "n"])

    return run


def classes_of(shared, k: int, percent: int):
    """doc_id, size and class of every text; its set, where it may have a partner (once a batch for each class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, kept, seen = [], [], [], set()
            for _, s in sets_of(batch.column(1), k):
                size = len(s)
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                n.append(size)
                cls.append(d)
                first = s[: size - least_overlap(size, percent) + extra(size)]
                may = size and d not in seen and in_filter(shared.value, first).sum() >= extra(least_overlap(size, percent))
                kept.append(s.tobytes() if may else None)
                seen.add(d)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "key", "n_shingles", "class", "tokens"])

    return run


def each_token(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            sets = [np.frombuffer(b.as_py(), np.int64) for b in part.column(1)]
            uid = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(uid)], ["token", "uid"])


def merge_short(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(id, count) of the ids that stand in at least `least` of the ascending lists."""
    heap = [(ids[0], k, 0) for k, ids in enumerate(lists)]
    heapq.heapify(heap)
    out = []
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            out.append((top, len(popped)))
            reach = top + 1
        else:  # an id below the next one stands in the popped lists only, and these are too few
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            reach = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(lists[k], reach, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))
    return out


def divide_skip(sets: list[np.ndarray], query: np.ndarray, indexed: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (positions in sets) between query sets and indexed sets; `query` and `indexed` are masks over sets."""
    size = np.array([len(s) for s in sets])
    every = np.arange(len(sets))
    ids = np.repeat(every, size)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[token] >= 2
    ids, token = ids[keep], token[keep]
    mine = np.searchsorted(ids, np.arange(len(sets) + 1))
    post = indexed[ids]
    order = np.lexsort((ids[post], token[post]))
    lists = ids[post][order]
    start = np.searchsorted(token[post][order], np.arange(len(df) + 1))
    part, out_a, out_b = every.copy(), [], []  # part: the smallest position of a set's component so far
    for q in np.flatnonzero(query).tolist():
        own_tokens, least = token[mine[q] : mine[q + 1]], int(least_overlap(size[q], percent))
        allowed = (part != part[q]) & (100 * np.minimum(size, size[q]) >= percent * np.maximum(size, size[q]))
        if indexed[q]:
            allowed &= (every > q) | ~query
        if len(own_tokens) < least or not allowed.any():
            continue
        length = start[own_tokens + 1] - start[own_tokens]
        by = np.argsort(length, kind="stable")
        skip = int(min(least - 1, least / (MU * np.log2(max(2, length[by[-1]])) + 1)))
        short, long = own_tokens[by[: len(by) - skip]], own_tokens[by[len(by) - skip :]]
        parts = [lists[start[t] : start[t + 1]] for t in short.tolist()]
        merged = merge_short([x.tolist() for x in (p[allowed[p]] for p in parts) if len(x)], least - skip)
        if not merged:
            continue
        found, have = (np.array(x) for x in zip(*merged))
        for t in long.tolist():
            ids_t = lists[start[t] : start[t + 1]]
            if len(ids_t):
                have = have + (ids_t[np.minimum(np.searchsorted(ids_t, found), len(ids_t) - 1)] == found)
        for hit in found[100 * have >= percent * (size[found] + size[q] - have)].tolist():
            if part[hit] != part[q]:
                out_a.append(q)
                out_b.append(hit)
                low, high = sorted((int(part[hit]), int(part[q])))
                part[part == high] = low
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def tile_links(percent: int):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values(["n", "uid"])
        sets = [np.frombuffer(b, np.uint64) for b in tile["tokens"]]
        block, x, y = tile["block"].to_numpy(), tile["x"].iloc[0], tile["y"].iloc[0]
        a, b = divide_skip(sets, block == x, block == y, percent)
        uid = tile["uid"].to_numpy()
        return pd.DataFrame({"a": uid[a], "b": uid[b]})

    return run


def class_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Step 1: doc_id, key, n_shingles, class of every row, and the tokens of those that may have a partner."""
    counted = docs.select("text").mapInArrow(filter_tokens(k, percent), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 2")
    shared = bit_filter(counted.select("token"), "token", BITS)
    out = materialize(docs.mapInArrow(classes_of(shared, k, percent), "doc_id long, key binary, n_shingles long, class binary, tokens binary"), "classes")
    shared.destroy()
    return out


def candidate_sets(rows: DataFrame) -> DataFrame:
    """uid, class, n, tokens: each class that may have a partner once."""
    sets = rows.where("tokens is not null").groupBy("class").agg(F.any_value("tokens").alias("tokens"), F.max("n_shingles").alias("n"))
    return materialize(sets.select(row_id(), "class", "n", "tokens"), "sets")


def prefix_lists(sets: DataFrame, percent: int) -> DataFrame:
    """uid, token: the rarest n - T(n) + 1 shingles of each set, without those that no other set has."""
    tokens = sets.select("uid", "tokens").mapInArrow(each_token, "token long, uid long")
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df >= 2")
    mine = tokens.join(df, "token").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t")).join(sets.select("uid", "n"), "uid")
    least = F.ceil(F.col("n") * percent / 100.0).cast("int")
    some = mine.select("uid", F.size("t").alias("c"), "t", least.alias("least")).where("c >= least")
    return materialize(some.select("uid", F.explode(F.slice("t", 1, F.col("c") - F.col("least") + 1)).alias("t")).select("uid", F.col("t.token").alias("token")), "prefix")


def candidate_clusters(prefix: DataFrame) -> DataFrame:
    """uid, cluster: every set tied to the smallest set of each of its lists, and the components of these ties."""
    heads = prefix.groupBy("token").agg(F.min("uid").alias("head"), F.count("*").alias("n")).where("n >= 2")
    ties = prefix.join(heads, "token").where("uid <> head").select(F.col("uid").alias("a"), F.col("head").alias("b")).distinct()
    clusters = components(ties)
    return clusters.select(F.col("node").alias("uid"), F.col("component").alias("cluster")).union(clusters.select("component", "component").distinct())


def links(documents: DataFrame, k: int, percent: int, key: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, key, n_shingles, class; sets: uid, class; a spanning forest of the links between sets: a, b as uid)."""
    docs = documents.select("doc_id", "text", key.alias("key"))
    every = class_rows(docs, k, percent)
    sets = candidate_sets(every)
    rows = materialize(every.drop("tokens"), "rows")
    discard(every)
    prefix = prefix_lists(sets, percent)
    linked = candidate_clusters(prefix)
    # linked sizes differ by a factor of 1.25 at most, so by one rung
    rung = F.floor(F.log("n") / F.log(F.lit(1.26))).cast("long")
    place = tiles(sets.select("uid", "n").join(linked, "uid"), "cluster", rung, TILE, "n")
    work = place.join(sets.select("uid", "tokens"), "uid")
    found = materialize(work.groupBy("cluster", "x", "y").applyInPandas(tile_links(percent), "a long, b long"), "links")
    ids = materialize(sets.select("uid", "class"), "ids")
    discard(sets)
    discard(prefix)
    return rows, ids, found


def labelled(sets: DataFrame, found: DataFrame) -> DataFrame:
    """class, part: the component of every class that may have a partner."""
    parts = components(found)
    return sets.join(parts.withColumnRenamed("node", "uid"), "uid", "left").select("class", F.coalesce("component", "uid").alias("part"))


def near_duplicates(documents: DataFrame, k: int = WORDS_IN_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of documents (doc_id, text)."""
    rows, sets, found = links(documents, k, percent, F.lit(None).cast("binary"))
    first = rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first"))
    label = labelled(sets, found)
    smallest = label.join(first, "class").groupBy("part").agg(F.min("first").alias("component_id"))
    named = first.join(label.join(smallest, "part"), "class", "left").select("class", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(named, (rows["class"] == named["class"]) & (F.col("n_shingles") > 0), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def without_copies(documents: DataFrame, k: int = WORDS_IN_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """documents with one row of each component: that of the smallest doc_id (nulls last), of equal ones the smallest row key. Rows without words all stay."""
    columns = documents.columns
    docs = documents.withColumn("_key", row_key(*columns))
    rows, sets, found = links(docs, k, percent, F.col("_key"))
    held = rows.where("n_shingles > 0").groupBy("class", "key").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    first = held.groupBy("class").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key", "n")).alias("first"))
    part = first.join(labelled(sets, found), "class", "left").select(F.coalesce(F.col("part").cast("string").cast("binary"), "class").alias("part"), "first")
    kept = part.groupBy("part").agg(F.min("first").alias("first")).select(F.col("first.key").alias("_key"), F.col("first.n").alias("_n"))
    kept = materialize(kept.union(rows.where("n_shingles = 0").select("key", F.lit(1).cast("long")).distinct()), "kept")
    joined = docs.join(kept, "_key")
    once, more = joined.where("_n = 1"), joined.where("_n > 1").dropDuplicates(["_key"])  # rows equal in every column
    return once.unionByName(more).select(*columns)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE a = doc_id)::BIGINT AS component_id FROM documents LEFT JOIN n USING (doc_id)
"""
