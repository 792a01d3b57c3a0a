"""Vector search through cells against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import retrieval, vectors


def clustered(n, dim, clusters, seed, spread):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(clusters, dim))
    return centre[r.integers(clusters, size=n)] + spread * r.normal(size=(n, dim))


def table(spark, x, labels):
    rows = [(i, labels[i % len(labels)], [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").repartition(4)


def plain(rows, every, k):
    want = set()
    for q in rows:
        if q.vec_id % every == 0:
            a = np.array(q.embedding)
            found = sorted((-round(float(a @ np.array(r.embedding) / np.linalg.norm(a) / np.linalg.norm(r.embedding)), 6), r.vec_id)
                           for r in rows if r.label == q.label)[:k]
            want |= {(q.vec_id, v, n + 1) for n, (_, v) in enumerate(found)}
    return want


@pytest.mark.parametrize("spread,block,most", [(0.05, 4096, 16_384), (5.0, 40, 16_384), (0.05, 16, 3)])
def test_cells_give_the_plain_result(spark, monkeypatch, spread, block, most):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "MOST_PIVOTS", most)
    x = clustered(900, 12, 15, 1, spread)
    x[100:140] = x[100]    # ties, told apart by id alone
    v = table(spark, x, ["a", "a", "b", "c", "dé"])
    got = vectors.vector_topk(retrieval.sampled_vectors(v, 30), v, 5).collect()
    assert {(r.query_id, r.vec_id, r.rank) for r in got} == plain(v.collect(), 30, 5) and len(got) == 5 * 30


def test_bounds_pass_over_cells_of_clustered_vectors(spark):
    v = table(spark, clustered(3000, 8, 40, 2, 0.02), ["a"])
    pivots = vectors.fit_pivots(v, "label", "vec_id", "embedding")
    cells = vectors.assign(v, pivots, "label", "vec_id", "embedding")
    queries = retrieval.sampled_vectors(v, 50)
    _, more = vectors.wanted_cells(queries, cells, pivots, "vec_id", "label", 5)
    every = queries.count() * len(pivots["a"])
    assert len(pivots["a"]) == 55 and more.count() < 0.2 * every


def test_null_and_zero_vectors_are_no_hits(spark):
    rows = [(0, "a", [1.0, 0.0]), (1, "a", None), (2, "a", [0.0, 0.0]), (3, "a", [1.0, 1.0]), (50, "b", [1.0, 2.0]), (100, None, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = vectors.vector_topk(retrieval.sampled_vectors(v), v, 5)
    assert {(r.query_id, r.vec_id, r.rank) for r in got.collect()} == {(0, 0, 1), (0, 3, 2), (50, 50, 1)}
    assert vectors.vector_topk(retrieval.sampled_vectors(v.limit(0)), v.limit(0), 5).collect() == []
    assert v.where(F.col("label").isNull()).count() == 1
