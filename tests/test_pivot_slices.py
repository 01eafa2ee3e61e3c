"""Distances to the pivots are made in slices of bounded size, with the same neighbours and groups."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from contrasieve.operators import neighbours


def batch_of(m):
    return pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(m))]), pa.array(list(m))], names=["h", "v"])


def rows_df(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")


def test_distances_to_many_pivots_take_bounded_memory():
    rng = np.random.default_rng(1)
    pivots, batch = rng.normal(size=(neighbours.MAX_PIVOTS, 8)), batch_of(rng.normal(size=(10_000, 8)))
    shelf = neighbours._shelves(np.full(len(pivots), 10), 100_000)
    seen = 0
    tracemalloc.start()
    try:
        for part in neighbours._slices(batch, len(pivots)):
            far = neighbours._far(part, pivots)
            for sent in neighbours._sent(part, far >= 0, shelf, ["h", "v"]):
                seen += sent.num_rows
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen == 10_000
    assert peak < 3 * 8 * neighbours.PRODUCT < 8 * len(pivots) * 10_000


def test_rows_sent_are_those_of_the_open_shelves():
    batch = batch_of(np.arange(6.0).reshape(3, 2))
    open_cells = np.array([[True, False, False], [False, False, True], [True, True, False]])
    sent = list(neighbours._sent(batch, open_cells, np.array([0, 0, 1], np.int32), ["h", "v"]))
    assert [(p["target"].to_pylist(), p["h"].to_pylist()) for p in sent] == [([0, 0], ["0", "2"]), ([1], ["1"])]
    assert sent[0]["v"].to_pylist() == [[0.0, 1.0], [4.0, 5.0]]


def test_vectors_of_different_lengths_are_an_error():
    batch = pa.RecordBatch.from_arrays([pa.array([[1.0], [1.0, 2.0, 3.0]])], names=["v"])
    with pytest.raises(ValueError, match="length"):
        neighbours._far(batch, np.ones((2, 2)))


def test_slices_of_a_few_rows_give_the_exact_neighbours_and_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_CELLS", 6 * 16)
    rng = np.random.default_rng(7)
    m = np.concatenate([rng.normal(size=(1, 6)) + 0.2 * rng.normal(size=(25, 6)) for _ in range(4)])
    m[30:35] = m[3]
    rows = rows_df(spark, m)
    with_all = {r.vertex: r.component for r in neighbours.similarity_groups(rows, "id", "v", 0.95).collect()}
    near_all = sorted(map(tuple, neighbours.knn_graph(rows, "id", "v", 4).collect()))
    monkeypatch.setattr(neighbours, "PRODUCT", 40)
    assert {r.vertex: r.component for r in neighbours.similarity_groups(rows, "id", "v", 0.95, broadcast_cells=0).collect()} == with_all
    assert sorted(map(tuple, neighbours.knn_graph(rows, "id", "v", 4, broadcast_cells=0).collect())) == near_all
