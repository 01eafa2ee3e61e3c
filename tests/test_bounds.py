"""Steps whose memory or traffic must not grow faster than the input."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from contrasieve.operators import neighbours


def points_df(spark, m, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(m)), m)], "id long, v array<double>")


def test_a_vector_travels_once_per_shelf():
    shelf = neighbours._shelves(np.full(400, 10), 1000)
    assert shelf.max() + 1 == 4
    batch = pd.DataFrame({"h": list("abc"), "v": [[1.0]] * 3})
    parts = list(neighbours._visits(batch, np.ones((3, 400), bool), shelf, ["h", "v"]))
    assert [len(p) for p in parts] == [3] * 4
    assert neighbours._shelves(np.array([50, 5, 5]), 10).tolist() == [0, 1, 1]


@pytest.mark.parametrize("cells", [8 * 16, 8 * 50])
def test_blocks_of_shelves_give_the_exact_neighbours(spark, monkeypatch, cells):
    monkeypatch.setattr(neighbours, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(150, 8))
    m[100:110] = m[0]
    got = {}
    for r in neighbours.knn_graph(points_df(spark, m), "id", "v", 4, broadcast_cells=0).collect():
        got.setdefault(r.src, []).append((-r.sim, r.dst))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 9)
    for i in range(len(m)):
        want = sorted((-sims[i, j], j) for j in range(len(m)) if j != i)[:4]
        assert [d for _, d in sorted(got[i])] == [d for _, d in want]


def test_groups_over_shelves_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_CELLS", 6 * 16)
    rng = np.random.default_rng(5)
    m = np.concatenate([rng.normal(size=(1, 6)) + 0.15 * rng.normal(size=(30, 6)) for _ in range(4)])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    linked, want = np.round(u @ u.T, 9) >= 0.95, np.arange(len(m))
    for _ in range(len(m)):
        want = np.array([want[linked[i]].min() for i in range(len(m))])
    got = {r.vertex: r.component for r in neighbours.similarity_groups(points_df(spark, m), "id", "v", 0.95, broadcast_cells=0).collect()}
    assert [got[i] for i in range(len(m))] == want.tolist()


def test_a_stream_reads_a_table_of_one_file_or_of_part_files(spark, tmp_path):
    from contrasieve.plans import streams
    from contrasieve.streaming import contracts as st

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "single").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "single" / "documents.parquet")
    for name in ("many", "single"):
        st.run(streams.stream_of(spark, str(tmp_path / name), "documents"), str(tmp_path / f"out_{name}"), str(tmp_path / f"at_{name}"))
        assert spark.read.parquet(str(tmp_path / f"out_{name}")).count() == 10


def test_red_flags_takes_every_contract_of_small_suppliers():
    from contrasieve import plans
    from contrasieve.plans.registry import ORACLES

    plans.load()
    assert "URGENT" not in ORACLES["g8_red_flags"] and "qty" not in ORACLES["g8_red_flags"].split("dg AS")[1]


def test_outlier_flags_do_not_deal_rows_by_label(spark):
    from pyspark.sql import functions as F

    from contrasieve.operators import pairs

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")
    try:
        df = spark.range(20_000).select("id", (F.col("id") % 3).alias("label"), (F.col("id") * 7 % 1000).cast("double").alias("value"))
        out = pairs.outlier_flags(df, ["label"], "value")
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 20_000 and out.filter("z_flag IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
