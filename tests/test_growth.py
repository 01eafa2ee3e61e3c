"""Level-wise n-grams and the sweep of cluster numbers against plain computations."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrasieve.operators import clusters, terms


@pytest.mark.parametrize("bits", [24, 6])  # with 64 slots nearly every candidate gets through
def test_grown_ngrams_equal_plain_counts(spark, bits):
    r = random.Random(4)
    docs = [(i, r.choice(["a", "b"]), [r.choice(["x", "y", "z", "é", f"rare{i}"]) for _ in range(r.randint(0, 25))]) for i in range(300)]
    docs += [(300, "a", None), (300, "a", ["x", None, "y"]), (None, None, ["x", "y", "x", "y"])]
    expected = defaultdict(lambda: [0, 0, None])
    for key, label, words in docs:
        words = [w for w in words or [] if w is not None]
        for term in {" ".join(words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1)}:
            seen = expected[term]
            seen[0] += 1
            seen[1] += label == "a"
            seen[2] = key if seen[2] is None else min(x for x in (key, seen[2]) if x is not None)
    df = spark.createDataFrame(docs, "doc bigint, label string, words array<string>").repartition(4)
    sums = {"n_a": F.count_if(F.col("label") == "a"), "least": F.min("doc")}
    got = {t["term"]: [t["n_docs"], t["n_a"], t["least"]] for t in terms.grown_ngrams(df, "doc", F.col("words"), sums, carry=["label"], bits=bits).collect()}
    assert got == {t: v for t, v in expected.items() if v[0] >= 5}
    assert {len(t.split()) for t in got} == {1, 2, 3, 4}
    assert terms.grown_ngrams(df.where("false"), "doc", F.col("words"), sums, carry=["label"]).isEmpty()


def plain_kmeans(x, centres, rounds=300):
    for _ in range(rounds):
        near = x @ centres.T
        which = near.argmax(axis=1)
        sums = np.array([x[which == c].sum(axis=0) if (which == c).any() else centres[c] for c in range(len(centres))])
        new = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        if np.linalg.norm(new - centres, axis=1).max() <= 1e-4:
            centres = new
            break
        centres = new
    which = (x @ centres.T).argmax(axis=1)
    far = 1 - x @ x.T
    widths = []
    for i, c in enumerate(which):
        own = far[i][(which == c) & (np.arange(len(x)) != i)]
        others = [far[i][which == o].mean() for o in set(which) - {c}]
        widths.append(0.0 if not len(own) or not others else (min(others) - own.mean()) / max(min(others), own.mean()))
    return (1 - (x @ centres.T).max(axis=1)).sum(), float(np.mean(widths))


def test_sweep_equals_single_fits(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(4, 6))
    x = np.concatenate([m * 3 + rng.normal(size=(60, 6)) for m in middles])
    rows = [(v.tolist(),) for v in x] + [(None,), ([0.0] * 6,)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    starts = {k: unit[:: len(unit) // k][:k] for k in (2, 3, 4, 7)}
    got = {r["k"]: r for r in clusters.kmeans_sweep(df, "v", [2, 3, 4, 7], starts=starts).collect()}
    for k, s in starts.items():
        inertia, silhouette = plain_kmeans(unit, s)
        assert got[k]["inertia"] == pytest.approx(inertia, rel=1e-9) and got[k]["silhouette"] == pytest.approx(silhouette, abs=1e-9), k
    assert [r["best"] for r in got.values()].count(True) == 1
    own = clusters.kmeans_sweep(df, "v", range(2, 6)).collect()
    assert [r["k"] for r in own] == [2, 3, 4, 5] and [r["k"] for r in own if r["best"]] == [4]
    assert clusters.kmeans_sweep(df.where("false"), "v", [2]).isEmpty()


def test_reads_of_the_sweep_do_not_grow_with_the_numbers_of_clusters(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(v.tolist(),) for v in rng.normal(size=(200, 5))], "v array<double>")
    passes = []
    kind = type(df)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: passes.append(1) or real(self, *a, **k))
    out = clusters.kmeans_sweep(df, "v", range(2, 9), rounds=5).collect()
    assert len(out) == 7 and len(passes) <= 5 + 2
