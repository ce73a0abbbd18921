"""The vector index against all pairs: exact with all lists, near enough with few."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import neighbours
from tessella.operators.neighbours import build, recall, search

SCHEMA = "id long, v array<float>"


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, row) for i, row in enumerate(x.astype(np.float32).tolist())], SCHEMA)


def exact(x, queries, k):
    x = x.astype(np.float32).astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for q in queries:
        near = np.round(x @ x[q], 6)
        order = sorted((-s, i) for i, s in enumerate(near) if i != q)[:k]
        out += [(q, r, i) for r, (_, i) in enumerate(order, 1)]
    return out


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(30, 12))[rng.integers(30, size=n)] + 0.1 * rng.normal(size=(n, 12))


@pytest.fixture(scope="module")
def indexed(spark):
    x = clustered(900)
    return x, build(frame(spark, x), "id", "v")


def test_all_lists_give_the_exact_answer(spark, indexed, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 7)
    x, index = indexed
    queries = frame(spark, x).where("id % 50 = 0")
    got = search(index, queries, "id", "v", probes=len(index.centres))
    assert sorted((r.query_id, r.rank, r.id) for r in got.collect()) == exact(x, range(0, 900, 50), 10)


def test_few_lists_are_enough_where_vectors_cluster(spark, indexed):
    x, index = indexed
    assert index.probes <= len(index.centres) // 3
    assert index.rows.count() == 900
    assert recall(index, frame(spark, x).where("id % 10 = 0"), "id", "v") >= 0.9


def test_probes_follow_the_data(spark):
    x = np.random.default_rng(3).normal(size=(600, 40))
    index = build(frame(spark, x), "id", "v")
    assert index.probes > len(index.centres) // 3
    assert recall(index, frame(spark, x).where("id % 20 = 0"), "id", "v") >= 0.9


def test_a_list_of_copies_is_split(spark, monkeypatch):
    """A third of all vectors are equal: their list has many chunks, and ties go to the smallest ids."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)
    x = clustered(600, 5)
    x[:200] = x[0]
    index = build(frame(spark, x), "id", "v")
    sizes = [r["count"] for r in index.rows.groupBy("list", "chunk").count().collect()]
    assert max(sizes) <= 80
    got = search(index, frame(spark, x).where("id = 150"), "id", "v", k=5)
    assert sorted((r.rank, r.id, r.similarity) for r in got.collect()) == [(r, r - 1, 1.0) for r in range(1, 6)]


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("list", F.lit("own"))
    index = build(df, "id", "v")
    got = sorted((r.query_id, r.rank, r.id, r.similarity) for r in search(index, df, "id", "v", k=5, probes=99).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]
    empty = build(df.where("false"), "id", "v")
    assert search(empty, df, "id", "v").collect() == []
