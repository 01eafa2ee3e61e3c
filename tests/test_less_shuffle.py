"""Queries that add up before they shuffle."""

import datetime
import random
from collections import defaultdict

from pyspark.sql import functions as F

from contrasieve.operators import joins
from contrasieve.plans import aggregates


def test_co_occurrence_deals_groups_by_their_first_members(spark):
    r = random.Random(5)
    rows = [(200 * c + m, f"g{c}_{g}") for c in range(6) for g in range(60) for m in r.sample(range(20), 8)] + [(7, f"g{c}_{g}") for c in range(6) for g in range(9)]
    have = defaultdict(set)
    for m, g in rows:
        have[g].add(m)
    want = defaultdict(int)
    for members in have.values():
        for a in members:
            for b in members:
                if a < b:
                    want[a, b] += 1
    out = joins.co_occurrence(spark.createDataFrame(rows, "m int, g string"), "m", "g", 1)
    assert {(x["a"], x["b"]): x["weight"] for x in out.collect()} == want
    assert "rangepartitioning(slice(xs" in out._jdf.queryExecution().executedPlan().toString()


def test_summary_joins_purchases_once_and_not_contracts(spark, tmp_path, monkeypatch):
    day = datetime.date(2024, 1, 1)
    lines = [(o, i, 1, s, "RAN"[i % 3], 0.1 * (i % 2), day + datetime.timedelta(o)) for o, s in ((1, 5), (2, 6), (3, 5), (3, 7), (9, 8)) for i in range(4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_discount double, l_shipdate date").selectExpr(
        "*", "'F' AS l_linestatus", "1.0 AS l_quantity", "2.0 AS l_extendedprice", "0.0 AS l_tax"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    tables = {
        "orders": ([(1, 10), (2, 11), (3, 10), (3, 11), (4, 12)], "o_orderkey long, o_custkey long"),
        "customer": ([(10, 1), (11, 2), (11, 1), (12, 1)], "c_custkey long, c_nationkey int"),
        "nation": ([(1, 1), (2, 2)], "n_nationkey int, n_regionkey int"),
        "region": ([(1, "X"), (2, "Y")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        extra = {"customer": ["'s' AS c_mktsegment", "'n' AS c_name"], "nation": ["'m' AS n_name"]}.get(name, [])
        spark.createDataFrame(rows, schema).selectExpr("*", *extra).write.parquet(f"{tmp_path}/{name}.parquet")
    written = []
    cut = aggregates.cut_lineage
    monkeypatch.setattr(aggregates, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    got = aggregates.a24(spark, str(tmp_path)).first()
    # order 1 once; 2 at both places of customer 11; 3 (two suppliers) at 10 and twice at 11
    assert (got["n"], got["n_agencies"], got["n_suppliers"], got["top_state"]) == (4 + 8 + 8 * 3, 2, 3, "X")
    assert (got["first_day"], got["last_day"]) == ("2024-01-02", "2024-01-04")
    assert got["n_geral"] == 9 and got["n_discount"] == 18
    assert written[0].count() == 6
    assert aggregates.a24(spark, str(tmp_path)).filter(F.col("n_clf") <= F.col("n")).count() == 1
