"""TF-IDF weights against brute force, and that no (document, term) row is shuffled for them."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrasieve.operators import terms


def brute(rows, min_df, max_terms):
    docs = {}
    for key, _, words in rows:
        grams = docs.setdefault(key, Counter())
        grams.update(words or [])
        grams.update(f"{a} {b}" for a, b in zip(words or [], (words or [])[1:]))
    df, total = Counter(), Counter()
    for grams in docs.values():
        df.update(grams.keys())
        total.update(grams)
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-total[t], t))[:max_terms]
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for key, grams in docs.items():
        w = {t: (1 + math.log(n)) * idf[t] for t, n in grams.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out |= {(key, t): x / norm for t, x in w.items()}
    return out


def some_rows(twice):
    r = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], [f"w{j}" for j in r.zipf(1.4, r.integers(0, 30)) % 40]) for i in range(60)] + [(60, "a", None)]
    if twice:  # rows of one key are one document, whose pairs of words end with each row
        rows += [(3, "b", ["w1", "w2"]), (3, "a", ["w2", "w1"]), (None, "a", ["w1", "w2", "w3"]), (None, "b", ["w1"])]
    return rows


@pytest.mark.parametrize("twice", [False, True])
def test_weights_equal_brute_force_and_shuffle_no_terms(spark, twice):
    rows = some_rows(twice)
    df = spark.createDataFrame(rows, "k long, label string, words array<string>")
    want = brute(rows, 3, 50)
    plain = terms.tfidf(df, "k", F.col("words"), min_df=3, max_terms=50)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    got = {(x["k"], x["term"]): x["weight"] for x in plain.collect()}
    assert len(got) == plain.count() and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    carried = terms.tfidf(df, "k", F.col("words"), min_df=3, max_terms=50, carry=["label"])
    labels = df.select("k", "label")
    for how in ("inner", "left"):
        joined = plain.join(labels, "k", how).select("k", "label", "term", F.round("weight", 9))
        ready = terms._labelled(carried, labels, "k", "label", how).select("k", "label", "term", F.round("weight", 9))
        assert sorted(map(str, joined.collect())) == sorted(map(str, ready.collect()))


@pytest.mark.parametrize("lead", [1, 64])
def test_top_words_and_pairs_equal_brute_force_and_send_few_pairs(spark, lead):
    rows = some_rows(True)
    df = spark.createDataFrame(rows, "k long, label string, words array<string>")
    want = set()
    for label in "ab":
        for n in (1, 2):
            counts = Counter(" ".join(w[i : i + n]) for _, x, w in rows if x == label for i in range(len(w or []) - n + 1))
            want |= {(label, n, t, c) for t, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5]}
    got = terms.top_words_and_pairs(df, F.col("words"), ["label"], 5, lead)
    assert {tuple(x) for x in got.select("label", "n_words", "term", "n").collect()} == want
    assert terms.top_words_and_pairs(df.where("false"), F.col("words"), ["label"], 5, lead).isEmpty()
    lists = df.select("label", F.array(F.coalesce("words", F.array().cast("array<string>"))).alias("_lists"))
    marked = terms._bitmap(spark.createDataFrame([("w1",), ("w2",)], "term string"), 1, 24)
    pairs = terms.gram_counts(lists, 2, ["label"], marked)
    assert {x["term"] for x in pairs.collect()} <= {"w1 w1", "w1 w2", "w2 w1", "w2 w2"}
