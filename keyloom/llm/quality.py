r"""Quality classifier: a sparse ensemble of rules over statistics of the text, compiled into Spark columns.

The statistics are Spark columns over the whole text. On a sample of labelled rows small boosted trees
are grown; every path from the root to a node is a rule, a conjunction of comparisons. A logistic
regression with an L1 penalty weighs the rules, most of them with 0, and its penalty is the one that
does best on every fourth row of the sample. The rules that remain become one column expression, so
scoring is a projection without Python.

Training takes at most `SAMPLE` labelled rows (a parameter), those of the smallest hash of doc_id among
the rows whose crc32(doc_id as text) mod 4 is not 2; only their statistics reach the driver.

Defined results: null is scored as an empty text, whose statistics are all 0; repeated rows score
alike; without labels, or with labels of one kind only, the score is the share of label 1 (0 without
any); a null doc_id is not held out; of equally good cuts of a tree the first statistic's lowest is taken;
texts of any length are scored whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import own, table

SAMPLE = 8000
TREES = 40
DEPTH = 3
BINS = 24
SHRINK = 0.2
LEAST = 12
SEED = 3

Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """name -> statistic of a text, never null."""
    t = F.coalesce(text, F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("double")

    words = count(r"\S+")
    per_word = {
        "symbol_runs": count(r"[^\p{L}\p{N}\s]{2,}"),
        "shouted": count(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})"),
        "stutter": count(r"(?<!\S)(\S{1,40}) \1(?!\S)"),
        "bars": count(r"\|"),
        "numbers": count(r"[0-9]+"),
        "sentences": count(r"[.!?](?=\s|$)"),
        "lines": count(r"\n"),
        "capitalised": count(r"(?<!\S)\p{Lu}\p{Ll}"),
        "distinct": F.size(F.array_distinct(F.split(t, r"\s+"))).cast("double"),
    }
    lines = F.split(t, "\n")
    found = {"words": words, "word_length": F.length(t) / F.greatest(words, F.lit(1.0)), "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines)}
    return found | {k: v / F.greatest(words, F.lit(1.0)) for k, v in per_word.items()}


NAMES = ["words", "word_length", "repeated_lines", "symbol_runs", "shouted", "stutter", "bars", "numbers", "sentences", "lines", "capitalised", "distinct"]


def with_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.withColumns({f"stat_{k}": v for k, v in statistics(F.col(text)).items()})


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, features: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple, paths: list) -> np.ndarray:
    """Grow one node; returns the step of every row below it and appends the path of each node."""
    step = np.zeros(len(x))
    step[rows] = -gradient[rows].sum() / (hessian[rows].sum() + 1)
    if depth == 0:
        return step
    best, g, h = (1e-6, -1, 0.0), gradient[rows], hessian[rows]
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in features:
        for c in cuts[f]:
            above = x[rows, f] > c
            n = above.sum()
            if LEAST <= n <= len(rows) - LEAST:
                ga, ha = g[above].sum(), h[above].sum()
                gain = ga**2 / (ha + 1) + (g.sum() - ga) ** 2 / (h.sum() - ha + 1) - whole
                if gain > best[0]:
                    best = (gain, f, c)
    _, f, c = best
    if f < 0:
        return step
    for side in (True, False):
        part = rows[(x[rows, f] > c) == side]
        way = (*path, (int(f), side, float(c)))
        paths.append(way)
        step[part] = grow(x, gradient, hessian, part, features, cuts, depth - 1, way, paths)[part]
    return step


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, NAMES.index(f)] > c) == side for f, side, c in rule])


def shorter(path: tuple) -> Rule:
    """The rule of a path: for each statistic and side only the binding bound, in a fixed order."""
    bound: dict[tuple[int, bool], float] = {}
    for f, side, c in path:
        bound[f, side] = c if (f, side) not in bound else (max if side else min)(bound[f, side], c)
    return tuple((NAMES[f], side, c) for (f, side), c in sorted(bound.items()))


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    rng = np.random.default_rng(SEED)
    cuts = [np.array([(a + b) / 2 for a, b in pairwise(np.unique(np.quantile(v, np.linspace(0, 1, BINS))))]) for v in x.T]
    score, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.sort(rng.permutation(len(y))[: max(2 * LEAST, len(y) // 2)])
        features = rng.permutation(len(NAMES))[: len(NAMES) * 2 // 3]
        step = grow(x, p - y, p * (1 - p), rows, features, cuts, DEPTH, (), way := [])
        score += SHRINK * step
        paths += way
    return sorted({shorter(p) for p in paths})


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic regression with an L1 penalty on all weights but the last (the intercept), by accelerated proximal steps."""
    z = np.hstack([z, np.ones((len(z), 1))])
    rate = 4 / (np.linalg.norm(z, 2) ** 2 / len(y))
    w, v, t = start, start, 1.0
    for _ in range(steps):
        new = v - rate * (z.T @ (1 / (1 + np.exp(-(z @ v))) - y) / len(y))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (before - 1) / t * (new - w)
        w = new
    return w


def train(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """Weighted rules and the intercept."""
    if not len(y) or len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return [], float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    rules = tree_rules(x, y)
    z = np.stack([holds(r, x) for r in rules], 1).astype(float)
    some = (z.mean(0) > 0.005) & (z.mean(0) < 0.995)
    rules, z = [r for r, s in zip(rules, some) if s], z[:, some]
    _, once = np.unique(z, axis=1, return_index=True)  # rules that hold for the same rows are one
    rules, z = [rules[i] for i in sorted(once)], z[:, sorted(once)]
    test = np.arange(len(y)) % 4 == 3
    best, w, start = (np.inf, 0.01), None, np.zeros(z.shape[1] + 1)
    for penalty in (0.03, 0.02, 0.01, 0.006, 0.004, 0.002, 0.001):
        start = lasso(z[~test], y[~test], penalty, start)
        logit = z[test] @ start[:-1] + start[-1]
        best = min(best, (float(np.mean(np.logaddexp(0, np.where(y[test] == 1, -logit, logit)))), penalty))
    w = lasso(z, y, best[1], np.zeros(z.shape[1] + 1), 600)
    return [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6], float(w[-1])


def score_column(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The model as a column over stat_ columns."""

    def one(rule: Rule) -> Column:
        return reduce(lambda a, b: a & b, [(F.col(f"stat_{f}") > c) if side else (F.col(f"stat_{f}") <= c) for f, side, c in rule])

    total = reduce(lambda a, b: a + b, [F.when(one(r), w).otherwise(0.0) for r, w in rules], F.lit(intercept))
    return 1 / (1 + F.exp(-total))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[tuple[Rule, float]], float]:
    chosen = own(labels, "doc_id", "quality").where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = with_statistics(own(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # at most `sample` ids
    got = rows.select(F.xxhash64("doc_id").alias("h"), "label", *[F.col(f"stat_{n}").alias(n) for n in NAMES]).orderBy("h", *NAMES).limit(2 * sample).toPandas()
    return train(got[NAMES].to_numpy(float).reshape(-1, len(NAMES)), got["label"].to_numpy(float))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules, intercept = fit(documents, table(spark, sf_dir, "labels"))
    out = with_statistics(own(documents, "doc_id", "text")).withColumn("score", score_column(rules, intercept))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
