"""Batches that fit are added whole, others leave the index as it was."""

import os

import pytest

from granary.sources import vector_index as v


def test_batches_are_checked(spark, tmp_path):
    path = str(tmp_path / "index")
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "chunk_id long")
    vectors = lambda *rows: spark.createDataFrame(list(rows), "chunk_id long, embedding array<double>")
    found = v.append_batch(ids(1, 2), vectors((1, [1.0, 0.0]), (2, [0.0, 0.0])), path, 2)
    assert (found["rows"], found["zero"], found["missing"]) == (2, 1, 0)
    v.append_batch(ids(3), vectors((3, [0.0, 1.0])), path, 2)
    before = sorted(map(str, v.read_index(spark, path).collect()))
    assert len(before) == 3
    for batch in (
        (ids(4, 5), vectors((4, [1.0, 0.0]))), (ids(4), vectors((4, [1.0, 0.0]), (5, [1.0, 0.0]))), (ids(4), vectors((4, [1.0]))), (ids(4), vectors((4, [1.0, float("nan")]))),
        (ids(4), vectors((4, [1.0, None]))), (ids(4), vectors((4, None))), (ids(4), vectors((4, [1.0, 0.0]), (4, [0.0, 1.0]))), (ids(4, 4), vectors((4, [1.0, 0.0]))),
    ):
        with pytest.raises(v.RefusedBatch):
            v.append_batch(*batch, path, 2)
    assert sorted(map(str, v.read_index(spark, path).collect())) == before
    assert os.listdir(tmp_path / "index" / v.STAGED) == []
    v.append_batch(ids(), vectors(), path, 2)
    assert v.read_index(spark, path).count() == 3
