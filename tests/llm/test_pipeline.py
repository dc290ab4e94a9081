"""Every stage of the pipeline on its own input, and the rows of run()."""

import random

import corpus_pipeline
import pytest

from keyloom.llm import mixing
from tests.llm.tables import documents, put
from tests.oracle import assert_same

rng = random.Random(9)


def prose(n):
    return " ".join(rng.choice("river house garden window letter morning paper music stone bridge summer market".split()) + rng.choice("abcdefgh") for _ in range(n))


ITEM = "which of these twelve rivers flows through the old town of stones"
CLEAN = [prose(60) for _ in range(30)]
COPY = " ".join([*CLEAN[3].split()[:-1], "end"])


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    texts = [*CLEAN, CLEAN[3], COPY, f"{prose(20)} {ITEM} {prose(20)}", f"{prose(30)} write to lena@example.com now", None, ""]
    labels = [(i, 1, 0) for i in range(20)]
    return put(spark, tmp_path_factory.mktemp("pipeline"), documents=[r for r in documents(texts)], labels=labels, benchmark=[(1, ITEM)])


def test_stages_decide_on_their_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    every = ids(docs)
    assert ids(stages["toxicity"](spark, docs, sf)) == every
    assert ids(stages["near_copies"](spark, docs, sf)) == every - {30, 31}
    assert ids(stages["benchmark"](spark, docs, sf)) == every - {32}
    clean = {r.doc_id: r.text for r in stages["pii"](spark, docs, sf).collect()}
    assert set(clean) == every and "lena@" not in clean[33] and clean[0] == CLEAN[0]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == corpus_pipeline.COLUMNS, name


def test_run_is_the_mixture_of_what_is_left(spark, sf, tmp_path):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(rows) == set(range(36)) - {30, 31, 32}
    last = put(spark, tmp_path, documents=[r for r in documents(CLEAN)])
    docs = spark.read.parquet(f"{last}/documents.parquet")
    assert_same(corpus_pipeline.mix_sources(spark, docs, last), mixing.ORACLE, last)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, put(spark, tmp_path)).count() == 0
