"""Documents per slot, added up over tasks, against a plain sum."""

import numpy as np

from contrasieve.operators import terms

def test_only_slots_that_reach_the_minimum_leave_their_task(spark):
    r = np.random.default_rng(3)
    tasks = r.integers(0, 3, (4, 1 << 10)).astype(np.uint8)
    rows = [(0, bytes(t)) for t in tasks]
    found = terms._reached(spark.createDataFrame(rows, "part int, counts binary").repartition(3), 10, 5)
    slot = np.arange(1 << 10)
    assert np.array_equal(terms._has(found, slot), tasks.sum(axis=0) >= 5)
