"""Queries against their SQL, and all of them on empty and awkward tables."""

import pytest

from keyloom.llm import entries
from tests.llm.tables import documents, put
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
AWKWARD = [None, "", " \n\t", "a", "one two three", "one two three", "ONE two three", "x" * 300_000, "été naïve Straße " * 3000, "word " * 20_000, "é" * 500, *["the same passage again and again until it is long enough to count " * 5] * 3]


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(entries.QUERIES[name](spark, SF), entries.ORACLES[name], SF)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return put(
        spark, tmp_path_factory.mktemp("awkward"), documents=[*documents(AWKWARD), (None, "no id", None, None, None)], labels=[(3, 1, 0), (4, None, None), (None, 1, 1)],
        benchmark=[(1, "one two three"), (2, None), (3, ""), (4, "the same passage again and again until it is long enough")],
        pages=[(1, "u", "<p>a</p>"), (2, None, None), (3, "u", "<p>a</p>"), (4, "v", ""), (5, "v", "é" * 100_000)],
        embeddings=[(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 0.1], None), (7, [1.0, 0.1], 1), (8, [], 1), (9, [1.0, None], 1), (10, [1.0, 0.0, 0.0], 1)],
    )


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_awkward_rows(spark, awkward, name):
    rows = entries.QUERIES[name](spark, awkward).collect()
    expected = {"op1_warc": 5, "op6_embedding_dedup": 10}.get(name, len(AWKWARD) + 1)
    assert len(rows) == expected or name == "op9_chaining"


@pytest.mark.parametrize("name", ["op1_warc", "op6_embedding_dedup", "op7_mixing"])
def test_awkward_rows_equal_sql(spark, awkward, name):
    df = entries.QUERIES[name](spark, awkward)
    if name == "op6_embedding_dedup":  # the SQL knows no odd vectors
        assert {r.vec_id: (r.n_links, r.component_id) for r in df.collect()} == {1: (2, 1), 2: (2, 1), 7: (2, 1)} | {k: (0, k) for k in (3, 4, 5, 6, 8, 9, 10)}
    else:
        assert_same(df, entries.ORACLES[name], awkward)


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    assert entries.QUERIES[name](spark, put(spark, tmp_path)).count() == 0


def test_benchmark_rows_without_distinct_ids_equal_sql(spark, tmp_path):
    rows = ["alpha beta gamma delta", "one two three four", "red green blue black", "north east south west"]
    texts = [f"so {t} it is" for t in rows for _ in range(2)] + ["nothing of it"]
    sf = put(spark, tmp_path, documents=documents(texts), benchmark=[(None, rows[0]), (None, rows[1]), (7, rows[2]), (7, rows[3])])
    out = entries.QUERIES["op5_decontamination"](spark, sf)
    assert out.where("n_hit = 4").count() == 8
    assert_same(out, entries.ORACLES["op5_decontamination"], sf)
