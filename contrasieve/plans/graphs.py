"""Queries on graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrasieve.functions import text as tx
from contrasieve.operators import graph, pairs
from contrasieve.plans.aggregates import A14_BODY, FACT_NAMES, fact_names, name_hint
from contrasieve.plans.registry import query, table
from contrasieve.plans.standin import FACT_GEO, R, fact_geo, r

EDGES = f"{FACT_NAMES}, {A14_BODY}, ed AS (SELECT 'A:' || agency AS src, 'S:' || supplier AS dst, n::DOUBLE AS weight, name_hint, name_hint AND n_geral > 0 AS red_flag FROM pairs)"
BOTH = EDGES + ", b AS (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed)"


def pair_table(spark, d):
    return pairs.pair_aggregate(fact_names(spark, d), "agency", "supplier", "label", "value", name_hint())


def edges(spark, d):
    return graph.bipartite_edges(pair_table(spark, d), "agency", "supplier", "n")


@query(
    "g1_bipartite_graph",
    f"WITH {EDGES} SELECT count(DISTINCT src) AS n_agencies, count(DISTINCT dst) AS n_suppliers, count(*) AS n_edges, {R('sum(weight)')} AS total_weight FROM ed",
)
def g1(spark, d):
    return edges(spark, d).agg(
        F.countDistinct("src").alias("n_agencies"), F.countDistinct("dst").alias("n_suppliers"), F.count("*").alias("n_edges"), r(F.sum("weight")).alias("total_weight")
    )


@query("g2_degrees", f"WITH {BOTH} SELECT src AS vertex, CASE WHEN src LIKE 'A:%' THEN 'agency' ELSE 'supplier' END AS side, count(*) AS degree, {R('sum(weight)')} AS strength FROM b GROUP BY 1, 2")
def g2(spark, d):
    side = F.when(F.col("vertex").startswith("A:"), "agency").otherwise("supplier")
    return graph.degrees(edges(spark, d)).withColumn("strength", r(F.col("strength"))).withColumn("side", side)


#: Ranks after each round; the answer is the first multiple of 5 rounds whose ranks moved by less than the tolerance.
RANK_SQL = f"""WITH RECURSIVE {BOTH}, l AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM b), n AS (SELECT count(DISTINCT src)::DOUBLE AS n FROM b),
  p AS (SELECT DISTINCT src AS v, 1.0 / n AS x, 0 AS i FROM b, n UNION ALL SELECT dst, 0.15 / max(n) + 0.85 * sum(x * share), max(i) + 1 FROM p JOIN l ON src = v, n WHERE i < 200 GROUP BY dst),
  m AS (SELECT a.i, sum(abs(a.x - z.x)) AS moved FROM p a JOIN p z ON a.v = z.v AND z.i = a.i - 5 WHERE a.i % 5 = 0 AND a.i >= 10 GROUP BY 1),
  k AS (SELECT coalesce(min(i), 200) AS k FROM m, n WHERE moved < 1e-6 * n)
  SELECT v AS vertex, {R('x', 9)} AS rank FROM p, k WHERE i = k"""


@query("g3_page_rank", RANK_SQL)
def g3(spark, d):
    return graph.page_rank(edges(spark, d)).withColumn("rank", r(F.col("rank"), 9))


@query("g4_betweenness")
def g4(spark, d):
    return graph.betweenness(edges(spark, d))


@query("g5_label_propagation")
def g5(spark, d):
    return graph.label_propagation(edges(spark, d))


@query("g6_modularity_communities")
def g6(spark, d):
    e = edges(spark, d)
    found = graph.modularity_communities(e)
    return found.withColumn("modularity", graph.modularity(e, found).scalar())


@query(
    "g7_community_summary",
    f"""WITH {FACT_NAMES}, {A14_BODY}, ag AS (SELECT agency, max(name_hint) AS h, max(name_hint AND n_geral > 0) AS f FROM pairs GROUP BY 1), sp AS (SELECT supplier, max(name_hint) AS h, max(name_hint AND n_geral > 0) AS f FROM pairs GROUP BY 1),
    v AS (SELECT c_nationkey AS community, 'agency' AS side, h, f FROM ag JOIN customer ON agency = c_custkey UNION ALL SELECT s_nationkey, 'supplier', h, f FROM sp JOIN supplier ON supplier = s_suppkey)
    SELECT community, count(*) AS n_vertices, count(*) FILTER (WHERE side = 'agency') AS n_agencies, count(*) FILTER (WHERE side = 'supplier') AS n_suppliers, count(*) FILTER (WHERE h) AS n_hints, count(*) FILTER (WHERE f) AS n_flags FROM v GROUP BY 1""",
)
def g7(spark, d):
    p = pair_table(spark, d)

    def side(key, name, places, place_key, place):
        v = p.groupBy(key).agg(F.max("name_hint").alias("hint"), F.max("red_flag").alias("flag"))
        return v.join(table(spark, d, places), F.col(key) == F.col(place_key)).select(F.col(place).alias("community"), F.lit(name).alias("side"), "hint", "flag")

    v = side("agency", "agency", "customer", "c_custkey", "c_nationkey").unionByName(side("supplier", "supplier", "supplier", "s_suppkey", "s_nationkey"))
    return graph.community_summary(v, "community", "side", "hint", "flag")


@query(
    "g8_red_flags",
    f"""WITH {FACT_GEO}, e AS (SELECT DISTINCT agency, supplier FROM factg), dg AS (SELECT supplier FROM e GROUP BY 1 HAVING count(*) <= 450)
    SELECT id, agency FROM factg JOIN part ON part = p_partkey WHERE label = 'geral' AND contains(p_name, 'ring') AND supplier IN (SELECT supplier FROM dg)""",
)
def g8(spark, d):
    f = fact_geo(spark, d)
    few = f.groupBy("supplier").agg(F.countDistinct("agency").alias("degree")).filter("degree <= 450")
    names = table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name")
    hits = f.filter("label = 'geral'").join(names, "part").filter(tx.domain_term_count(F.col("p_name"), ["ring"]) >= 1)
    return hits.join(few, "supplier", "left_semi").select("id", "agency")


@query(
    "g9_connected_components",
    f"""WITH RECURSIVE {BOTH}, s AS (SELECT src, dst FROM b WHERE weight >= 4), reach AS (SELECT src AS a, src AS c FROM s UNION SELECT reach.a, s.dst FROM reach JOIN s ON reach.c = s.src)
    SELECT a AS vertex, min(c) AS component FROM reach GROUP BY 1""",
)
def g9(spark, d):
    return graph.connected_components(edges(spark, d).filter("weight >= 4"))
