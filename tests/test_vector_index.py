"""The vector index against all cosines."""

import numpy as np
import pytest

from mnemospark import plans
from mnemospark.operators import retrieval, vector_index
from mnemospark.storage import shared_folder

from .test_plans import plan_of


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(7)
    mean = rng.normal(size=(30, 16)) * 2
    rows = mean[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))
    rows[100:140] = rows[99]  # ties go by path
    data = [(f"p{k:04d}", r.tolist()) for k, r in enumerate(rows)] + [("none", None), ("empty", [])]
    vectors = spark.createDataFrame(data, "path string, embedding array<double>").repartition(5).cache()
    queries = spark.createDataFrame([(k, (rows[k] if k % 2 else rng.normal(size=16)).tolist()) for k in range(0, 3000, 41)] + [(99, rows[99].tolist()), (-1, None)], "qid long, embedding array<double>")
    index = vector_index.build(vectors, f"{shared_folder(spark)}/v", cells=40)
    yield vectors, queries, index
    vectors.unpersist()


def rows_of(df):
    return sorted(map(tuple, df.select("qid", "rank", "path", "score").collect()))


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_search_equals_the_scan(made, monkeypatch, block):
    monkeypatch.setattr(vector_index, "BLOCK", block)
    vectors, queries, index = made
    want = rows_of(retrieval.dense(vectors.where("size(embedding) > 0"), queries.where("embedding is not null"), 10))
    assert rows_of(index.search(queries, 10, probes=3, exact=True)) == want
    assert rows_of(index.search(queries, 10, probes=40)) == want


def test_every_vector_is_indexed_once(made):
    vectors, _, index = made
    assert sorted(r.path for r in index.vectors().collect()) == sorted(r.path for r in vectors.where("size(embedding) > 0").collect())


def test_recall(made, spark, sf):
    vectors, queries, index = made
    want = {(q, p) for q, _, p, _ in rows_of(retrieval.dense(vectors.where("size(embedding) > 0"), queries.where("embedding is not null"), 10))}
    got = {(q, p) for q, _, p, _ in rows_of(index.search(queries, 10, probes=8))}
    assert len(want & got) >= 0.9 * len(want)
    rows = plans.QUERIES["t1_indexed_probes"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.hit for r in rows) >= 0.9 * len(rows) and len(rows) == 250


def test_rows_added_later_are_found(spark, made):
    vectors, queries, _ = made
    index = vector_index.build(vectors.where("path < 'p1500'"), f"{shared_folder(spark)}/v", cells=20)
    index.add(vectors.where("path >= 'p1500'"))
    assert rows_of(index.search(queries, 5, probes=2, exact=True)) == rows_of(retrieval.dense(vectors.where("size(embedding) > 0"), queries.where("embedding is not null"), 5))


def test_only_wanted_cells_are_read(made):
    _, _, index = made
    asked = np.eye(16)[:1]
    wanted = np.zeros((1, 3), bool)
    wanted[0, 1] = True
    plan = plan_of(index._probe(asked, np.array([4, 5, 6]), wanted, 3, 1))
    assert "PartitionFilters: [isnotnull(cell" in plan and "= 5)" in plan.split("PartitionFilters")[1][:80]


def test_empty(spark):
    none = spark.createDataFrame([], "path string, embedding array<double>")
    index = vector_index.build(none, f"{shared_folder(spark)}/v", cells=4)
    assert index.search(spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>"), 3, probes=2).collect() == []
