"""The corpus pipeline: five stages over documents, each written and read again before the next.

toxicity      documents that the classifier rejects go
near_copies   of each group of documents linked by 5-word shingles (Jaccard 0.8), the smallest doc_id stays
benchmark     documents that hold a window of a benchmark item go
pii           personal data becomes surrogates; n_chars follows the new text
mixture       words taken of each document so that sources reach their target weights

Every stage but the last returns the columns of documents; further columns are ignored, whatever their
names. Null and empty texts pass all stages and count 0 words. Texts of any length are read whole.
Rows that are equal in all columns get equal decisions, and of equal rows with words one stays; of rows
that share the smallest doc_id of a group the one of the smallest row key stays; a null doc_id comes
last. Empty tables give no rows; without labels nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, jaccard, mixing, pii, toxicity
from keyloom.llm.common import materialize, row_key, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs.select(*COLUMNS), model).where("score < 0.5").drop("score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.without_copies(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(*COLUMNS).withColumn("key", row_key("text"))
    found = decontaminate.report(rows.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = materialize(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct(), "hit")
    return rows.join(hit, "key", "left_anti").drop("key")


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.replace(docs.select(*COLUMNS)).drop("found")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_contaminated),
    ("pii", replace_pii),
    ("mixture", mix_sources),
]

#: The first stage is a trained model, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: doc_id, size, source_size, target, taken."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
