"""Inner products over a ball partition against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from granary.operators import balls, retrieval


def _best(q, own, x, ids, k):
    out = set()
    for i, scores in enumerate(q @ x.T):
        scores = np.where(ids == own[i], -np.inf, scores)
        last = np.sort(scores)[-min(k, len(scores))]
        out |= {(i, j) for j in np.flatnonzero((scores >= last - balls.NOISE) & (scores > -np.inf)).tolist()}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_top_against_all_pairs(seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(r.integers(1, 200), 5))
    x[: len(x) // 3] = x[0]  # equal vectors
    cell = r.integers(0, 7, len(x))
    q, own = np.concatenate([x[:9], np.zeros((1, 5))]), np.append(np.arange(len(x[:9])), -1)
    row, at, score, _ = balls.top(q, own, x, np.arange(len(x)), cell, 3)
    if len(x) > 3:
        assert set(zip(row.tolist(), at.tolist(), strict=True)) == _best(q, own, x, np.arange(len(x)), 3)
    assert np.allclose(score, (q[row] * x[at]).sum(axis=1))


def test_clustered_vectors_skip_most_pairs():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16)) * 5
    x = centres[np.arange(8000) % 40] + r.normal(size=(8000, 16)) * 0.1
    batch = pa.record_batch({"embedding": x.tolist()})
    cell = next(balls.nearest(x[:90])(iter([batch]))).column("cell").to_numpy()
    row, at, _, multiplied = balls.top(x[:50], np.arange(50), x, np.arange(8000), cell, 5)
    assert set(zip(row.tolist(), at.tolist(), strict=True)) == _best(x[:50], np.arange(50), x, np.arange(8000), 5)
    assert multiplied < 50 * 8000 / 5


def test_dense_topk_of_hot_vectors_and_of_nothing(spark):
    rows = [(i, [1.0, 0.0]) for i in range(90)] + [(100 + i, [0.0, float(i)]) for i in range(30)]
    index = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(5, [1.0, 0.0]), (-1, [0.0, 1.0])], "query_id long, embedding array<double>")
    got = {(r.query_id, r.chunk_id, r["rank"]) for r in retrieval.dense_topk(queries, index, 3, 1, 7).collect()}
    assert got == {(5, 0, 1), (5, 1, 2), (5, 2, 3), (-1, 129, 1), (-1, 128, 2), (-1, 127, 3)}
    assert retrieval.dense_topk(queries, index.limit(0), 3).collect() == retrieval.dense_topk(queries.limit(0), index, 3).collect() == []
