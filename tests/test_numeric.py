import itertools

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contrasieve.operators import graph, joins, learn, metrics, neighbours, outliers, sampling, totals


def brute_knn(ids, m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 9)
    out = {}
    for i, a in enumerate(ids):
        order = sorted((-sims[i, j], ids[j]) for j in range(len(ids)) if j != i)
        out[a] = [x[1] for x in order[:k]]
    return out


def vectors_df(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")


@pytest.mark.parametrize("options", [{}, {"broadcast_cells": 0}, {"broadcast_cells": 0, "n_pivots": 3}])
def test_knn_equals_brute_force_with_copies(spark, options):
    rng = np.random.default_rng(1)
    m = np.round(rng.normal(size=(60, 5)), 3)
    m = np.vstack([m, np.repeat(m[:1], 30, axis=0)])  # a third of the rows are copies
    df = vectors_df(spark, m)
    found = {}
    for row in neighbours.knn_graph(df, "id", "v", 4, **options).collect():
        found.setdefault(row.src, []).append((-row.sim, row.dst))
    expect = brute_knn(list(range(len(m))), m, 4)
    assert {s: [d for _, d in sorted(v)] for s, v in found.items()} == expect


def test_zero_vectors_have_no_neighbours(spark):
    df = vectors_df(spark, np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 0.1]]))
    assert {r.src for r in neighbours.knn_graph(df, "id", "v", 1).collect()} == {1, 2}


@pytest.mark.parametrize("options", [{}, {"broadcast_cells": 0, "n_pivots": 4}])
def test_similarity_groups(spark, options):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 3))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    parent = list(range(40))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(40), 2):
        if round(float(u[i] @ u[j]), 9) >= 0.95:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    got = {r.vertex: r.component for r in neighbours.similarity_groups(vectors_df(spark, m), "id", "v", 0.95, **options).collect()}
    assert got == {i: find(i) for i in range(40)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(-3, 3))), min_size=1, max_size=60))
def test_quantiles_and_ranks(spark, data):
    df = spark.createDataFrame(data, "g string, v int")
    got = {r.g: (r.q1, r.q5) for r in totals.exact_quantiles(df, ["g"], "v", {"q1": 0.1, "q5": 0.5}).collect()}
    for g in "ab":
        vals = [v for k, v in data if k == g and v is not None]
        if vals:
            assert got[g] == pytest.approx((np.quantile(vals, 0.1), np.quantile(vals, 0.5)))
        else:
            assert g not in got


def test_running_totals_with_a_hot_value(spark):
    values = [5.0] * 500 + [float(x) for x in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    out = totals.running_totals(df, [], "v", {"n": F.count("*")}).orderBy("v").collect()
    assert [r.cum_n for r in out] == list(np.cumsum([r.n for r in out])) and all(r.all_n == 1500 for r in out)


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 400, "hot").otherwise("cold"))
    for g, part in itertools.groupby(sampling.hash_rank(df, ["g"], "id").orderBy("g", "_rank").collect(), key=lambda r: r.g):
        part = list(part)
        assert [r["_rank"] for r in part] == list(range(len(part))) and {r["_size"] for r in part} == {len(part)}


def test_co_occurrence_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    edges = {(int(a), int(b)) for a, b in zip(rng.integers(0, 25, 150), rng.integers(0, 15, 150))}
    edges |= {(a, 99) for a in range(25)}  # a hub that every member belongs to
    groups = {a: {g for x, g in edges if x == a} for a in range(25)}
    expect = {
        (a, b): len(groups[a] & groups[b]) for a, b in itertools.combinations(range(25), 2) if len(groups[a] & groups[b]) >= 2
    }
    df = spark.createDataFrame(sorted(edges), "m int, g int")
    assert {(r.a, r.b): r.weight for r in joins.co_occurrence(df, "m", "g").collect()} == expect


def edges_df(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


def test_components(spark):
    chain = [(f"n{i:02d}", f"n{i+1:02d}") for i in range(20)]
    df = edges_df(spark, chain + [("x", "y"), ("z", "z")])
    got = {r.vertex: r.component for r in graph.connected_components(df).collect()}
    assert all(got[f"n{i:02d}"] == "n00" for i in range(21)) and got["y"] == got["x"] == "x" and got["z"] == "z"


def test_page_rank_sums_to_one(spark):
    df = edges_df(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    ranks = {r.vertex: r["rank"] for r in graph.page_rank(df, rounds=60).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and max(ranks, key=ranks.get) == "c"


def test_betweenness_of_a_path(spark):
    df = edges_df(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    got = {r.vertex: r.betweenness for r in graph.betweenness(df, sources=5).collect()}
    assert got == {"a": 0.0, "b": 3.0, "c": 4.0, "d": 3.0, "e": 0.0}


def test_communities_of_two_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i, j in itertools.combinations(range(5), 2)]
    df = edges_df(spark, clique("a") + clique("b") + [("a0", "b0")])
    for find in (graph.modularity_communities, graph.label_propagation):
        got = {r.vertex: r.community for r in find(df).collect()}
        assert set(got) == {f"{p}{i}" for p in "ab" for i in range(5)}
    found = graph.modularity_communities(df)
    assert graph.modularity(df, found).first()[0] > 0.3


def test_curve_metrics(spark):
    data = [(0.9, True), (0.8, False), (0.8, True), (0.3, False), (0.1, False)]
    df = spark.createDataFrame(data, "s double, y boolean")
    row = metrics.curve_areas(df, [], "s", "y").first()
    assert row.roc_auc == pytest.approx((1 + 1 + 1 + 1 + 1 + 0.5) / 6)
    sweep = {r.threshold: (r.tp, r.fp) for r in metrics.threshold_sweep(df, "s", "y", [0.2, 0.8, 0.95]).collect()}
    assert sweep == {0.2: (2, 2), 0.8: (2, 1), 0.95: (0, 0)}


def test_p_value(spark):
    row = spark.range(1).select(metrics.erfc(F.sqrt(F.lit(3.841458820694124) / 2)).alias("p")).first()
    assert row.p == pytest.approx(0.05, abs=1e-5)


def test_bootstrap_brackets_the_estimate(spark):
    cells = spark.createDataFrame([(40, 10, 10, 40)], "tp long, fp long, fn long, tn long")
    out = {r.metric: r for r in metrics.bootstrap(cells, 300).collect()}
    assert out["f1"].low < 0.8 < out["f1"].high and out["f1"].high - out["f1"].low < 0.3


def test_isolation_forest_finds_the_far_point(spark):
    rng = np.random.default_rng(0)
    df = vectors_df(spark, np.vstack([rng.normal(size=(150, 3)), [[9.0, 9.0, 9.0]]]))
    scores = {r.id: r.score for r in outliers.isolation_forest(df, "id", "v", df, trees=50).collect()}
    assert max(scores, key=scores.get) == 150 and all(0 < s <= 1 for s in scores.values())


def test_local_outlier_factor(spark):
    rng = np.random.default_rng(2)
    angles = np.concatenate([rng.normal(0.3, 0.02, 40), [1.4]])
    df = vectors_df(spark, np.stack([np.cos(angles), np.sin(angles)], axis=1))
    scores = {r.id: r.lof for r in outliers.local_outlier_factor(df, "id", "v", 5).collect()}
    assert max(scores, key=scores.get) == 40 and scores[40] > 3


def test_calibrated_probabilities_are_probabilities(spark):
    df = spark.createDataFrame([(i, int(i > 500), i / 1000.0) for i in range(1000)], "id int, y int, p double")
    for floor in (800, 5000):
        out = learn.calibrate(df, df, min_isotonic=floor).agg(F.min("calibrated"), F.max("calibrated"), F.corr("calibrated", "y")).first()
        assert 0 <= out[0] and out[1] <= 1 and out[2] > 0.8


def test_oversample_balances(spark):
    df = spark.range(100).withColumn("y", (F.col("id") < 30).cast("int"))
    counts = {r.y: r["count"] for r in learn.oversample(df, "y", "id").groupBy("y").count().collect()}
    assert counts == {0: 70, 1: 70}
