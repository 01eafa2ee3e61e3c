"""Iterative and stateful mechanisms: communities, label shares, co-occurrence, folds, factors, mixtures, streams."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrasieve.operators import clusters, graph, joins, learn, sampling, topics
from contrasieve.streaming import contracts as st


def edge_frame(spark, pairs):
    return spark.createDataFrame([(str(a), str(b), 1.0) for a, b in pairs], "src string, dst string, weight double")


def groups(found):
    out = defaultdict(set)
    for r in found.collect():
        out[r["community"]].add(r["vertex"])
    return {frozenset(v) for v in out.values()}


def test_two_cliques_are_two_communities(spark):
    cliques = [[f"{c}{i}" for i in range(5)] for c in "ab"]
    pairs = [p for c in cliques for p in itertools.combinations(c, 2)] + [("a0", "b0")]
    trace = []
    found = graph.modularity_communities(edge_frame(spark, pairs), trace=trace)
    assert groups(found) == {frozenset(c) for c in cliques}
    assert all(b > a for (x, a), (y, b) in zip(trace, trace[1:]) if x == y)
    assert all(b >= a - 1e-9 for (_, a), (_, b) in zip(trace, trace[1:]))
    assert abs(trace[-1][1] - graph.modularity(edge_frame(spark, pairs), found).first()[0]) < 1e-9


def test_ring_of_cliques(spark):
    cliques = [[f"{c}{i}" for i in range(5)] for c in range(6)]
    pairs = [p for c in cliques for p in itertools.combinations(c, 2)] + [(cliques[i][0], cliques[(i + 1) % 6][1]) for i in range(6)]
    assert groups(graph.modularity_communities(edge_frame(spark, pairs))) == {frozenset(c) for c in cliques}


def test_apart_moves_touch_no_community_twice(spark):
    rows = [(f"v{i}", f"c{i % 7}", f"c{(i * 3 + 1) % 7}") for i in range(60) if i % 7 != (i * 3 + 1) % 7]
    movers = spark.createDataFrame(rows, "vertex string, community string, to string")
    chosen = {r["vertex"] for r in graph._apart(movers, 1).collect()}
    touched = Counter(c for v, a, b in rows if v in chosen for c in (a, b))
    assert chosen and max(touched.values()) == 1


def test_label_propagation_rests_on_a_dense_bipartite_graph(spark):
    r = random.Random(1)
    pairs = {(f"A{r.randrange(12)}", f"S{r.randrange(12)}") for _ in range(90)}
    found = {x["vertex"]: x["community"] for x in graph.label_propagation(edge_frame(spark, sorted(pairs))).collect()}
    votes = defaultdict(Counter)
    for a, b in pairs:
        votes[a][found[b]] += 1
        votes[b][found[a]] += 1
    assert all(v[found[x]] == max(v.values()) for x, v in votes.items())


def test_label_shares_are_harmonic(spark):
    # a path of 12 between two labels, and a component that no label reaches
    e = edge_frame(spark, [(i, i + 1) for i in range(11)] + [("x", "y")])
    labels = spark.createDataFrame([("0", "a"), ("11", "b")], "vertex string, label string")
    out = {(r["vertex"], r["label"]): r["share"] for r in graph.spread_labels(e, labels, tolerance=1e-9).collect()}
    assert all(abs(out[str(i), "b"] - i / 11) < 1e-5 for i in range(1, 11))
    assert not {v for v, _ in out} & {"x", "y"}
    with pytest.raises(RuntimeError):
        graph.spread_labels(e, labels, tolerance=1e-9, max_rounds=5)


@pytest.mark.parametrize("least", [1, 2, 3, 4])
def test_co_occurrence_with_three_hubs(spark, least):
    r = random.Random(2)
    rows = [(m, h) for m in range(60) for h in ("h1", "h2", "h3") if r.random() < 0.7]
    rows += [(m, f"g{r.randrange(25)}") for m in range(60) for _ in range(3)] + [(None, "h1"), (3, None), (1, "h1"), (1, "h1")]
    have = defaultdict(set)
    for m, g in rows:
        if m is not None and g is not None:
            have[m].add(g)
    want = {(a, b): n for a, b in itertools.combinations(sorted(have), 2) if (n := len(have[a] & have[b])) >= least}
    df = spark.createDataFrame(rows, "m int, g string")
    for block in (4096, 7) if least == 2 else (7,):
        got = {(x["a"], x["b"]): x["weight"] for x in joins.co_occurrence(df, "m", "g", least, block).collect()}
        assert got == want


def test_proportional_sample_has_the_size_asked_for(spark):
    sizes = {"a": 701, "b": 100, "c": 99, "d": 77, "e": 23}
    df = spark.createDataFrame([(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)], "id string, s string")
    got = Counter(r["s"] for r in sampling.stratified_sample(df, "s", "id", 333).collect())
    assert sum(got.values()) == 333 and all(abs(got[s] - 333 * n / 1000) < 1 for s, n in sizes.items())
    assert sampling.stratified_sample(df, "s", "id", 5000).count() == 1000
    assert Counter(r["s"] for r in sampling.even_sample(df, "s", "id", 100).collect()) == dict.fromkeys(sizes, 20)


def test_group_folds_keep_texts_together(spark):
    r = random.Random(3)
    rows, n = [], 0
    for g in range(700):
        label = "pos" if r.random() < 0.3 else "neg"
        for _ in range(r.choice([1, 1, 1, 2, 5])):
            n += 1
            rows.append((n, label if r.random() < 0.95 else "neg", f"g{g}"))
    out = sampling.group_folds(spark.createDataFrame(rows, "id int, label string, g string"), "label", "g", 5).collect()
    assert len(out) == n and max(len({x["fold"] for x in out if x["g"] == g}) for g in {x["g"] for x in out}) == 1
    whole = sum(x["label"] == "pos" for x in out) / n
    for f in range(5):
        part = [x for x in out if x["fold"] == f]
        assert abs(len(part) / n - 0.2) < 0.02
        assert abs(sum(x["label"] == "pos" for x in part) / len(part) - whole) < 0.02


def planted(spark):
    r = random.Random(4)
    rows = [(f"d{i}", f"t{i % 3}_{j}", r.uniform(1, 2)) for i in range(30) for j in range(6) if r.random() < 0.8]
    return rows, spark.createDataFrame(rows, "doc string, term string, weight double")


def test_factors_equal_numpy_and_find_planted_blocks(spark):
    rows, df = planted(spark)
    docs, terms = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    a = np.zeros((len(docs), len(terms)))
    for d, t, x in rows:
        a[docs.index(d), terms.index(t)] = x
    scale = (np.mean([x for *_, x in rows]) / 3) ** 0.5
    w, h = (
        np.array([x["f"] for x in topics._seeded(df.select(c).distinct(), c, 3, scale, s).orderBy(c).collect()]) for c, s in (("doc", 42), ("term", 43))
    )
    errors = []
    for _ in range(30):
        w *= a @ h / np.maximum(w @ (h.T @ h), 1e-12)
        errors.append(np.linalg.norm(a - w @ h.T))
        h *= a.T @ w / np.maximum(h @ (w.T @ w), 1e-12)
    trace = []
    got_w, got_h = topics.non_negative_factors(df, "doc", "term", "weight", 3, 30, tolerance=0.0, trace=trace)
    assert np.allclose(trace, errors, rtol=1e-6) and all(y <= x + 1e-9 for x, y in zip(trace, trace[1:]))
    assert np.allclose([r["f"] for r in got_w.orderBy("doc").collect()], w, rtol=1e-6, atol=1e-9)
    assert np.allclose([r["f"] for r in got_h.orderBy("term").collect()], h, rtol=1e-6, atol=1e-9)
    named = topics.nmf_topics(df, "doc", 3, 60, top=6).collect()
    assert sorted({w.split("_")[0] for w in r["words"].split()}.pop() for r in named) == ["t0", "t1", "t2"]


def test_diagonal_mixture_equals_numpy(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 1, (80, 4)), r.normal(4, 0.5, (50, 4)), r.normal(-3, 2, (40, 4))])
    start = x[[0, 90, 140]]
    resp = np.eye(3)[((x[:, None] - start[None]) ** 2).sum(axis=2).argmin(axis=1)]
    likes = []
    for _ in range(200):
        n = resp.sum(axis=0) + 10 * np.finfo(float).eps
        mean = resp.T @ x / n[:, None]
        var = resp.T @ x**2 / n[:, None] - mean**2 + 1e-6
        logs = np.log(n / len(x)) + np.stack([-0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(axis=1) for m, v in zip(mean, var)], axis=1)
        like = np.log(np.exp(logs).sum(axis=1))
        resp = np.exp(logs - like[:, None])
        likes.append(like.mean())
        if len(likes) > 1 and likes[-1] - likes[-2] < 1e-3:
            break
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(3)
    trace = []
    out = clusters.diagonal_mixture(df, "id", "v", start, trace=trace).orderBy("id").collect()
    assert np.allclose(trace, likes, atol=1e-9) and all(b >= a - 1e-9 for a, b in zip(trace, trace[1:]))
    # the labels come from the parameters after the last round
    assert np.mean([o["cluster"] == c for o, c in zip(out, resp.argmax(axis=1))]) > 0.99
    assert all(0 <= o["entropy"] <= np.log(3) + 1e-9 and 1 / 3 <= o["confidence"] <= 1 + 1e-9 for o in out)


def test_few_strong_labels_are_helped_by_weak_ones(spark):
    r = random.Random(6)
    rows = [("m", i % 3, i, int(r.random() < i / 120), i / 120) for i in range(120)]
    p = spark.createDataFrame(rows, "model string, fold int, id int, y int, p double")
    weak = spark.createDataFrame([("m", 1, 0.1)] * 500, "model string, y int, p double")
    plain, mixed = ({x["id"]: x["calibrated"] for x in learn.calibrate_folds(p, w).collect()} for w in (None, weak))
    assert plain.keys() == mixed.keys() == set(range(120)) and mixed[12] > plain[12] + 0.2
    assert learn.calibrate_folds(p, weak, min_strong=10).filter("id = 12").first()["calibrated"] == pytest.approx(plain[12])


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_insert_new_looks_up_only_its_own_keys(spark, tmp_path):
    folder, sink, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    schema, read = "k bigint", []
    for lot in range(4):
        land(spark, folder, [(i,) for i in range(lot * 500, lot * 500 + 600)], schema)
        st.insert_new(st.read_landed(spark, folder, spark.read.parquet(folder).schema, "*.parquet"), ["k"], sink, progress)
        read.append(spark.read.parquet(sink).count())
    assert read == [600, 1100, 1600, 2100]
    assert spark.read.parquet(sink).distinct().count() == 2100
    # once more with nothing new: the table stays as it is
    st.insert_new(st.read_landed(spark, folder, spark.read.parquet(folder).schema, "*.parquet"), ["k"], sink, progress)
    assert spark.read.parquet(sink).count() == 2100


def test_case_states_release_old_spans(spark, tmp_path):
    folder, sink, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    schema = "case string, event string, ts timestamp, event_id bigint"
    names = list(st.EVENT_STATES)
    events = [(f"c{i % 5}", names[i % len(names)], d, i) for i, d in enumerate(np.datetime64("2024-01-01") + np.arange(0, 400) * np.timedelta64(12, "h"))]
    events = [(c, e, d.astype("datetime64[us]").item(), i) for c, e, d, i in events]
    sizes = []
    for at in range(0, 400, 100):
        land(spark, folder, events[at : at + 100], schema)
        states = st.case_states(st.read_landed(spark, folder, spark.read.parquet(folder).schema, "*.parquet"), "case", "event", "ts", "event_id", "2 days", "10 days")
        step = st.latest_table(sink)
        query = states.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else 0)
    got = {r["case_id"]: (r["state"], r["n_events"]) for r in st.read_cases(spark, sink).collect()}
    last = {c: (st.EVENT_STATES[e], 80) for c, e, _, _ in events}
    assert got == last
    assert max(sizes) <= 5 * 6  # five cases, the spans of one lot: not those of all lots


def test_scores_of_new_rows_leave_out_engineering_categories(spark):
    rows = [(i, [float(i)], int(i > 5), c) for i, c in enumerate(["x", "Obras", None] * 4)]
    df = spark.createDataFrame(rows, "id int, a array<double>, y int, category string")
    from contrasieve.operators.features import to_vector

    v = to_vector(df, "a")
    model = learn.estimators(1, None)["logistic"].fit(v.select("y", "features"))
    out = {r["id"]: r for r in learn.score_new(model, v.drop("y"), "id", "category", 0.5).collect()}
    assert len(out) == 12 and all(r["suspect"] == (r["p"] >= 0.5 and not r["already"]) for r in out.values())
    assert {i for i, r in out.items() if r["already"]} == {1, 4, 7, 10} and any(r["suspect"] for r in out.values())


def test_days_still_open_are_counted(spark, tmp_path):
    folder, sink, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    land(spark, folder, [("a",), ("a",), ("b",)], "label string")
    rows = st.read_landed(spark, folder, spark.read.parquet(folder).schema, "*.parquet").withColumn("ts", F.to_timestamp(F.lit("2024-03-05 10:00:00")))
    st.run_batches(st.daily_counts(rows, "ts", "label"), st.latest_table(sink), progress, mode="update")
    got = {tuple(r) for r in st.monthly_rollup(st.read_latest(spark, sink, "day", "label"), "label").collect()}
    assert got == {("2024-03", "a", 2), ("2024-03", "b", 1)}


def test_projected_neighbours_reach_the_recall_asked_for(spark):
    from contrasieve.operators import neighbours, projected

    r = np.random.default_rng(7)
    x = r.normal(size=(20, 12))[r.integers(0, 20, 1500)] * 2 + r.normal(size=(1500, 12))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(2000 + i, [float(c) for c in x[3]]) for i in range(40)] + [(5000, [0.0] * 12)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(4)
    report = {}
    out = projected.knn_graph_projected(df, "id", "v", 5, leaf=64, report=report)
    exact = neighbours.knn_graph(df, "id", "v", 5)
    assert report["recall"] >= 0.95 and report["trees"] >= 8
    assert exact.join(out, ["src", "dst"]).count() / exact.count() >= 0.93
    assert out.count() == exact.count() and out.filter("src = dst").isEmpty()
    assert projected.knn_graph_projected(df.limit(0), "id", "v", 5).isEmpty()
