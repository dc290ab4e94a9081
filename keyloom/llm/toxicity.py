"""Toxicity: a convolutional text classifier over hashed words, trained in numpy, scored in tasks.

Words (runs of letters and digits after lower-casing A-Z) are hashed into `BUCKETS` embeddings, and a
word's vector is the sum of those of the word and of its beginnings of `STEMS` bytes, so that inflected
and compounded words share what their stems mean. Filters of several widths slide over the whole text, each keeps its maximum, and a logistic layer weighs the
maxima. Embeddings start with the smoothed log-odds of their bucket in one component and small noise
in the others; everything is then trained by Adam.

Training takes at most `SAMPLE` labelled rows, those of the smallest hash of doc_id among the rows whose
crc32(doc_id as text) mod 5 is not 0, and ends that sample where its texts hold `WORDS` words together;
both bounds are parameters. Every fourth of these only calibrates. A small sample is gone through more
often, for at least `STEPS` steps of Adam. Scoring reads every whole text.

Thresholds by language: the language is guessed from the text (the function words it uses), never read
from `lang`. For each guessed language the threshold of the raw score is set on the calibration rows,
drawn towards the common threshold where a language has few, and the score is shifted so that 0.5 is
that threshold.

Defined results: null and empty texts score as a text without words (all maxima 0); repeated rows score
alike; labels of one id that disagree are all learnt from; without labels every score is 0; a null doc_id
is not held out; very long texts are scored whole, and learnt from whole where they fit into the sample's
words; an empty table gives no rows; further columns, also of the names used here, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.llm.common import own, shared_dir, table
from keyloom.llm.words import ALNUM, chunks, word_hashes, word_spans

BUCKETS = 1 << 15
SIZE = 8
STEMS = (4, 6)
WIDTHS = (1, 2, 3)
FILTERS = 8
SAMPLE = 6000
WORDS = 4_000_000
EPOCHS = 4
STEPS = 160
BATCH = 32
#: Labelled texts that the prior of a bucket's log-odds weighs as much as.
PRIOR = 3
SEED = 7

# Frequent function words of four languages.
FUNCTION_WORDS = {
    "de": "der die das und ist von zu den mit nicht ein eine auf für im dem auch sich als",
    "en": "the of and to in is that for it was on are as with his they at be this from",
    "es": "el la los de que y en las con por una del se es para como más su al lo",
    "fr": "le les des et est une pour que dans qui sur pas par plus au ce il ne se du",
}


def hashes_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    return word_hashes(data, starts, ends)


def language_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of function words and the language of each; words of several languages are left out."""
    seen: dict[int, list[int]] = {}
    for i, name in enumerate(sorted(FUNCTION_WORDS)):
        for h in hashes_of(FUNCTION_WORDS[name].split()).tolist():
            seen.setdefault(h, []).append(i)
    own_words = sorted((h, ls[0]) for h, ls in seen.items() if len(ls) == 1)
    return np.array([h for h, _ in own_words], np.uint64), np.array([i for _, i in own_words])


def encoded(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets of the words and their stems, index of each text's first word, guessed languages) in runs of rows."""
    known, of = language_table()
    for a, b, data, offsets in chunks(column):
        starts, ends, first = word_spans(data, offsets, ALNUM)
        h = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = np.flatnonzero(known[at] == h)
        text = np.searchsorted(first, hit, "right") - 1
        votes = np.zeros((b - a, len(FUNCTION_WORDS)), np.int64)
        np.add.at(votes, (text, of[at[hit]]), 1)
        parts = [h]
        for n in STEMS:
            stem = word_hashes(data, starts, np.minimum(ends, starts + n))
            parts.append(stem ^ np.uint64(n))
        yield a, b, (np.stack(parts, 1) % np.uint64(BUCKETS)).astype(np.int32), first, np.where(votes.max(1) > 0, votes.argmax(1), len(FUNCTION_WORDS))


class Net:
    """Embeddings, filters by width, and the logistic layer."""

    def __init__(self, odds: np.ndarray, bias: float):
        rng = np.random.default_rng(SEED)
        embed = rng.normal(0, 0.05, (BUCKETS, SIZE))
        embed[:, 0] = odds
        self.p = {"embed": embed.astype(np.float32), "out": np.full(FILTERS * len(WIDTHS), 0.3, np.float32), "bias": np.array([bias], np.float32)}
        for w in WIDTHS:
            f = rng.normal(0, 0.1, (w * SIZE, FILTERS))
            f[::SIZE] += 1 / w
            self.p[f"filter{w}"] = f.astype(np.float32)

    def pooled(self, ids: np.ndarray, first: np.ndarray):
        """Maxima (texts, filters), and for each the word where it stands (-1: a text shorter than the filter)."""
        n = len(first) - 1
        x = self.p["embed"][ids].sum(1)
        values, places = [], []
        for w in WIDTHS:
            best, at = np.zeros((n, FILTERS), np.float32), np.full((n, FILTERS), -1)
            m = len(ids) - w + 1
            rows = np.flatnonzero(first[1:] - first[:-1] >= w)
            if len(rows):
                y = x[:m] @ self.p[f"filter{w}"][:SIZE]
                for j in range(1, w):
                    y += x[j : j + m] @ self.p[f"filter{w}"][j * SIZE : (j + 1) * SIZE]
                bounds = np.minimum(np.stack([first[:-1][rows], first[1:][rows] - w + 1], 1).ravel(), m)
                top = np.maximum.reduceat(np.vstack([y, np.full((1, FILTERS), -np.inf, np.float32)]), bounds, 0)[::2]
                best[rows] = np.maximum(top, 0)
                at[rows] = -2
            values.append(best)
            places.append((at, y if len(rows) else None))
        return np.concatenate(values, 1), places, x

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first)[0] @ self.p["out"] + self.p["bias"][0]

    def gradients(self, ids: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        v, places, x = self.pooled(ids, first)
        error = ((1 / (1 + np.exp(-(v @ self.p["out"] + self.p["bias"][0]))) - label) * weight / weight.sum()).astype(np.float32)
        g = {"out": v.T @ error, "bias": np.array([error.sum()], np.float32), "embed": np.zeros_like(self.p["embed"])}
        back = error[:, None] * self.p["out"][None, :]
        for k, w in enumerate(WIDTHS):
            at, y = places[k]
            g[f"filter{w}"] = np.zeros_like(self.p[f"filter{w}"])
            if y is None:
                continue
            for text in np.flatnonzero(at[:, 0] == -2).tolist():
                part = y[first[text] : first[text + 1] - w + 1]
                p = part.argmax(0)
                on = np.flatnonzero(v[text, k * FILTERS : (k + 1) * FILTERS] > 0)
                for f in on.tolist():
                    where = first[text] + p[f]
                    d = back[text, k * FILTERS + f]
                    g[f"filter{w}"][:, f] += d * x[where : where + w].ravel()
                    np.add.at(g["embed"], ids[where : where + w], d * self.p[f"filter{w}"][:, f].reshape(w, 1, SIZE))
        return g


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*texts, np.zeros((0, 1 + len(STEMS)), np.int32)]).astype(np.int32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def threshold(logit: np.ndarray, label: np.ndarray) -> float:
    """The raw score that divides the labels with the fewest errors; between the two scores beside it."""
    order = np.argsort(logit)
    errors = np.concatenate([[0], np.cumsum(np.where(label[order] == 1, 1, -1))])
    best = np.flatnonzero(errors == errors.min())
    k = best[len(best) // 2]
    edge = np.concatenate([[logit[order[0]] - 1], logit[order], [logit[order[-1]] + 1]])
    return float((edge[k] + edge[k + 1]) / 2)


def train(texts: list[np.ndarray], label: np.ndarray, language: np.ndarray) -> tuple[Net, np.ndarray]:
    """The net, and the threshold of the raw score for each guessed language (the last: none)."""
    holds = np.arange(len(texts)) % 4 == 3
    learn = np.flatnonzero(~holds)
    good, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i in learn:
        (bad if label[i] else good)[np.unique(texts[i])] += 1
    positive = max(1, int(label[learn].sum()))
    negative = max(1, len(learn) - positive)
    share = positive / (positive + negative)
    odds = np.log((bad + PRIOR * share) / (good + PRIOR * (1 - share)) * negative / positive)
    net = Net(np.clip(odds, -1, 6), -3.0)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    weight = np.where(label == 1, min(4.0, negative / positive), 1.0)
    rng, step = np.random.default_rng(SEED), 0
    batches = max(1, len(learn) // BATCH)
    for _ in range(max(EPOCHS, -(-STEPS // batches)) if len(np.unique(label[learn])) == 2 else 0):
        order = rng.permutation(learn)
        for part in np.array_split(order, batches):
            ids, first = joined([texts[i] for i in part])
            grads = net.gradients(ids, first, label[part], weight[part])
            step += 1
            for k, g in grads.items():
                m, s = state[k]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                rate = 0.001 if k == "embed" else 0.01
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    calm = np.flatnonzero(holds) if holds.any() else learn
    logit = np.array([net.logits(*joined([texts[i]]))[0] for i in calm])
    common = threshold(logit, label[calm]) if len(calm) else 0.0
    cuts = np.full(len(FUNCTION_WORDS) + 1, common)
    for k in range(len(FUNCTION_WORDS)):
        mine = language[calm] == k
        n = int(label[calm][mine].sum())
        if 0 < n < mine.sum():
            cuts[k] = (n * threshold(logit[mine], label[calm][mine]) + 20 * common) / (n + 20)
    return net, cuts


def held_out(divisor: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == remainder, F.lit(False))


def encodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, languages = [], []
        for a, b, buckets, first, language in encoded(batch.column(1)):
            ids += [buckets[x:y].astype(np.int16).tobytes() for x, y in zip(first, first[1:])]
            languages += language.tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(languages, pa.int32()), batch.column(2)], ["doc_id", "ids", "language", "label"])


def fit(documents: DataFrame, labels: DataFrame, column: str = "toxic", divisor: int = 5, remainder: int = 0, sample: int = SAMPLE, words: int = WORDS) -> tuple[Net, np.ndarray] | None:
    """Train on at most `sample` labels that aren't held out and `words` words of their texts; None if there are none."""
    shared_dir(documents.sparkSession)
    chosen = own(labels, "doc_id", column).where(F.col(column).isNotNull() & ~held_out(divisor, remainder)).select("doc_id", F.col(column).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = own(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"), F.xxhash64("ids")]
    some = rows.mapInArrow(encodes, "doc_id long, ids binary, language int, label int").where(F.length("ids") <= 2 * (1 + len(STEMS)) * words).orderBy(*order).limit(sample)
    so_far = F.sum(F.length("ids")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # of at most `sample` rows
    got = some.withColumn("so_far", so_far).where(F.col("so_far") <= 2 * (1 + len(STEMS)) * words).select("ids", "language", "label").toArrow()
    if not got.num_rows:
        return None
    texts = [np.frombuffer(b.as_buffer(), np.int16).astype(np.int32).reshape(-1, 1 + len(STEMS)) for b in got.column("ids")]
    return train(texts, got.column("label").to_numpy().astype(np.float32), got.column("language").to_numpy())


def scores(documents: DataFrame, model: tuple[Net, np.ndarray] | None) -> DataFrame:
    """All columns of documents and a score from 0 to 1 of its whole text."""
    if model is None:
        return documents.withColumn("score", F.lit(0.0))
    spark = documents.sparkSession
    shared_dir(spark)
    sent = spark.sparkContext.broadcast(({k: v for k, v in model[0].p.items()}, model[1]))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net.__new__(Net)
        net.p, cuts = sent.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, ids, first, language in encoded(batch.column(batch.num_columns - 1)):
                z = net.logits(ids, first).astype(np.float64) - cuts[language]
                out[a:b] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], "score"])

    kept = [f"c{i}" for i in range(len(documents.columns))]  # any names, clashing ones too
    plain = documents.toDF(*kept)
    text = kept[documents.columns.index("text")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", score double"
    scored = plain.select(*kept, F.col(text).alias("to_score")).mapInArrow(run, schema)
    return scored.toDF(*documents.columns, "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = scores(own(documents, "doc_id", "text"), fit(documents, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
