"""Factors whose column side is sent to the tasks equal those made by joins."""

import numpy as np

from contrasieve.operators import topics


def test_factors_of_both_ways_are_equal(spark):
    r = np.random.default_rng(4)
    rows = [(int(d), f"t{c}", float(r.random())) for d in range(40) for c in r.choice(25, 6, replace=False)] + [(None, "t1", 0.5), (None, "only", 0.5), (3, None, 0.2)]
    df = spark.createDataFrame(rows, "doc long, term string, weight double")
    errors, found = [], []
    for limit in (0, 10**6):
        errors.append([])
        found.append(topics.non_negative_factors(df, "doc", "term", "weight", 3, 20, trace=errors[-1], broadcast_cells=limit))
    assert np.allclose(errors[0], errors[1], rtol=1e-8)
    for (x, y), key in zip(zip(*found), ("doc", "term")):
        x, y = ({v[key]: v["f"] for v in t.collect()} for t in (x, y))
        assert x.keys() == y.keys() and all(np.allclose(x[i], y[i], rtol=1e-6, atol=1e-9) for i in x)
