"""The vocabulary of topics against plain counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contrasieve.operators import topics


def test_vocabulary_is_counted_without_cached_lists(spark):
    r = random.Random(7)
    docs = [[r.choice("abcdefghij") + r.choice(["", "x", "y"]) for _ in range(r.randint(0, 6))] + ["all"] for _ in range(120)]
    n, rows = Counter(w for d in docs for w in d), Counter(w for d in docs for w in set(d))
    expected = sorted((w for w in n if 5 <= rows[w] <= 0.85 * len(docs)), key=lambda w: (-n[w], w))
    df = spark.createDataFrame([(d,) for d in docs], "t array<string>").repartition(5)
    for size in (3, 1000):
        assert topics.vocabulary(df, "t", size, 5.0, 0.85) == expected[:size]
    with pytest.raises(ValueError):
        topics.vocabulary(df.limit(3), "t", 10, 5.0, 0.85)


def test_topics_read_no_cached_lists(spark, monkeypatch):
    kept = []
    df = spark.createDataFrame([(i, f"a{i % 3} b{i % 4} c{i % 5}") for i in range(60)], "id bigint, text string")
    real = topics.LDA.fit

    def fit(self, counts):
        kept.extend(counts.inputFiles())
        return real(self, counts)

    monkeypatch.setattr(topics.LDA, "fit", fit)
    before = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    out = topics.lda_topics(df, "id", F.split("text", " "), F.col("id") % 2 == 0, k=2, rounds=2).collect()
    assert len(out) == 2 and sum(r["n_docs"] for r in out) == 60
    assert kept and len(spark.sparkContext._jsc.sc().getRDDStorageInfo()) == len(before)
