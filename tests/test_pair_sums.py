"""Sums of pairs that travel packed."""

import itertools
import random
from collections import defaultdict

import pytest

from contrasieve.operators import joins


@pytest.mark.parametrize("kind, least, most", [("string", 1, 50), ("bigint", 2, 8_000_000), ("bigint", 3, 200)])
def test_meetings_are_added_up_without_a_row_for_each(spark, monkeypatch, kind, least, most):
    monkeypatch.setattr(joins, "TASK_PAIRS", most)
    r = random.Random(9)
    name = (lambda i: f"m{i}é") if kind == "string" else (lambda i: (i - 30) * 10**15)
    rows = [(name(int(70 * r.random() ** 2)), g) for g in range(90) for _ in range(r.randint(1, 9))]
    rows += [(name(i), 777) for i in range(70)] + [(name(1), None), (None, 5), (name(2), 5), (name(2), 5)]
    have = defaultdict(set)
    for m, g in rows:
        if m is not None and g is not None:
            have[m].add(g)
    want = {(a, b): n for a, b in itertools.combinations(sorted(have), 2) if (n := len(have[a] & have[b])) >= least}
    for block in (4096, 11):
        out = joins.co_occurrence(spark.createDataFrame(rows, f"m {kind}, g int"), "m", "g", least, block)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "HashAggregate" not in plan
        got = [((x["a"], x["b"]), x["weight"]) for x in out.collect()]
        assert len(got) == len(want) and dict(got) == want
    assert joins.co_occurrence(spark.createDataFrame([], f"m {kind}, g int"), "m", "g", least).count() == 0
