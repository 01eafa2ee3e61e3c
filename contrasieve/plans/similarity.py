"""Queries on similarity, clusters, outliers and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrasieve.functions import text as tx
from contrasieve.operators import clusters, features, graph, neighbours, outliers, profile, projected, terms
from contrasieve.plans.learning import vectors
from contrasieve.plans.registry import query, table
from contrasieve.plans.standin import FACT_AGENCY, R, SCORE, TEXTS, fact_agency, r, score, texts
from contrasieve.plans.text import TOKENS_SQL

UNIT = """u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings)"""
SIMS = UNIT + ", s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.e, b.e), 9) AS sim FROM u a, u b WHERE a.vec_id <> b.vec_id)"


def KNN(k: int) -> str:
    return SIMS + f", knn AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= {k})"


def knn(spark, d, k):
    return neighbours.knn_graph(vectors(spark, d), "vec_id", "embedding", k)


@query("k1_knn_graph", f"WITH {KNN(5)} SELECT src, dst, {R('sim')} AS sim FROM knn")
def k1(spark, d):
    return knn(spark, d, 5).withColumn("sim", r(F.col("sim")))


@query("k1_knn_graph_cells", f"WITH {KNN(5)} SELECT src, dst, {R('sim')} AS sim FROM knn")
def k1c(spark, d):
    out = neighbours.knn_graph(vectors(spark, d), "vec_id", "embedding", 5, broadcast_cells=0)
    return out.withColumn("sim", r(F.col("sim")))


@query("k1_knn_graph_projected")
def k1p(spark, d):
    return projected.knn_graph_projected(vectors(spark, d), "vec_id", "embedding", 5)


@query(
    "k2_top_similar",
    f"""WITH {UNIT}, q AS (SELECT list_transform(range(1, 65), lambda i: (i % 7 - 3)::DOUBLE) AS q)
    SELECT vec_id, {R('sim')} AS sim FROM (SELECT vec_id, round(list_dot_product(e, q) / sqrt(list_dot_product(q, q)), 9) AS sim FROM u, q ORDER BY sim DESC, vec_id LIMIT 10)""",
)
def k2(spark, d):
    probe = [float(i % 7 - 3) for i in range(1, 65)]
    return neighbours.top_similar(vectors(spark, d), probe, "vec_id", "embedding", 10).withColumn("sim", r(F.col("sim")))


@query(
    "k3_neighbour_vote",
    f"""WITH {KNN(5)}, b AS (SELECT src, dst FROM knn UNION SELECT dst, src FROM knn)
    SELECT b.src AS vec_id, count(*) AS n_neighbours, {R('avg((label IN (0, 1, 2))::INT)')} AS vote FROM b JOIN embeddings ON vec_id = dst GROUP BY 1""",
)
def k3(spark, d):
    edges = knn(spark, d, 5).select("src", "dst", F.lit(1.0).alias("weight"))
    both = graph.both_ways(edges).select("src", "dst").distinct()
    y = vectors(spark, d).select(F.col("vec_id").alias("dst"), "y")
    return both.join(y, "dst").groupBy(F.col("src").alias("vec_id")).agg(F.count("*").alias("n_neighbours"), r(F.avg("y")).alias("vote"))


@query("k4_kmeans_sweep")
def k4(spark, d):
    return clusters.kmeans_sweep(features.to_vector(vectors(spark, d), "embedding"), "features", range(2, 11))


@query(
    "k5_characterise",
    f"""WITH {TEXTS}, w AS (SELECT lang, unnest({TOKENS_SQL}) AS term FROM texts), c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2),
    t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 8), l AS (SELECT lang, string_agg(term, ' ' ORDER BY n DESC, term) AS terms FROM t GROUP BY 1)
    SELECT x.lang, count(*) AS n, count(*) FILTER (WHERE label <> 'geral') AS n_pos, {R("100.0 * avg((label <> 'geral')::INT)")} AS pct_pos, terms FROM texts x JOIN l ON x.lang = l.lang GROUP BY 1, terms""",
)
def k5(spark, d):
    t = texts(spark, d)
    words = terms.term_table(t, "doc_id", tx.tokens(F.col("text")))
    out = clusters.characterise(t.select("doc_id", "lang", "label"), words, "doc_id", "lang", F.col("label") != "geral")
    return out.withColumn("pct_pos", r(F.col("pct_pos")))


@query("k6_gaussian_mixture")
def k6(spark, d):
    return clusters.gaussian_mixture(features.to_vector(vectors(spark, d), "embedding"), "vec_id", "features")


LINKED = f"""WITH RECURSIVE {SIMS}, e AS (SELECT src, dst FROM s WHERE sim >= 0.6), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, e.dst FROM reach JOIN e ON reach.b = e.src)
  SELECT a AS vertex, min(b) AS component FROM reach GROUP BY 1"""


@query("k7_single_link", LINKED)
def k7(spark, d):
    return neighbours.similarity_groups(vectors(spark, d), "vec_id", "embedding", 0.6)


@query("k7_single_link_cells", LINKED)
def k7c(spark, d):
    return neighbours.similarity_groups(vectors(spark, d), "vec_id", "embedding", 0.6, broadcast_cells=0)


@query("k8_reduce_dimensions")
def k8(spark, d):
    return clusters.reduce_dimensions(features.to_vector(vectors(spark, d), "embedding"), "vec_id", "features", 2)[0]


@query(
    "k9_pair_rules",
    f"""WITH {FACT_AGENCY}, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM facta),
    x AS (SELECT label, status, priority, CASE WHEN value <= a THEN 'q1' WHEN value <= b THEN 'q2' WHEN value <= c THEN 'q3' ELSE 'q4' END AS quartile FROM facta, q),
    p AS (SELECT 'status=' || status AS a, label FROM x UNION ALL SELECT 'priority=' || priority, label FROM x UNION ALL SELECT 'quartile=' || quartile, label FROM x),
    ab AS (SELECT a, 'label=' || label AS b, count(*)::DOUBLE AS n_ab FROM p GROUP BY 1, 2), na AS (SELECT a, sum(n_ab) AS n_a FROM ab GROUP BY 1), nb AS (SELECT 'label=' || label AS b, count(*)::DOUBLE AS n_b FROM x GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM x)
    SELECT a, b, {R('n_ab / n')} AS support, {R('n_ab / n_a')} AS confidence, {R('n_ab / n_a / (n_b / n)')} AS lift FROM ab JOIN na USING (a) JOIN nb USING (b), n WHERE n_ab / n >= 0.01""",
)
def k9(spark, d):
    x = profile.quartile_bands(fact_agency(spark, d), "value", "quartile")
    out = clusters.pair_rules(x, ["status", "priority", "quartile", "label"], "label")
    return out.select("a", "b", *[r(F.col(c)).alias(c) for c in ("support", "confidence", "lift")])


@query("k9_frequent_rules")
def k9f(spark, d):
    return clusters.frequent_rules(fact_agency(spark, d), ["status", "priority", "label"])


@query("k10_isolation_forest")
def k10(spark, d):
    v = vectors(spark, d)
    return outliers.isolation_forest(v, "vec_id", "embedding", v.filter("y = 0"))


@query(
    "k11_local_outlier_factor",
    f"""WITH {KNN(20)}, e AS (SELECT src, dst, greatest(0, 1 - sim) AS d FROM knn), kd AS (SELECT src AS dst, max(d) AS kd FROM e GROUP BY 1),
    l AS (SELECT src, count(*) / greatest(sum(greatest(d, kd)), 1e-10)::DOUBLE AS lrd FROM e JOIN kd USING (dst) GROUP BY 1)
    SELECT e.src AS vec_id, {R('avg(b.lrd) / max(a.lrd)', 5)} AS lof FROM e JOIN l b ON e.dst = b.src JOIN l a ON e.src = a.src GROUP BY 1""",
)
def k11(spark, d):
    return outliers.local_outlier_factor(vectors(spark, d), "vec_id", "embedding").withColumn("lof", r(F.col("lof"), 5))


@query("k12_novelty")
def k12(spark, d):
    v = vectors(spark, d).withColumn("general", F.col("y") == 0)
    return outliers.novelty(v, "vec_id", "embedding", "general")


#: Shares after each round; the answer is the first multiple of 5 rounds whose shares moved by less than the tolerance.
SPREAD_SQL = f"""WITH RECURSIVE {KNN(7)}, g AS MATERIALIZED (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, sim AS w FROM knn UNION ALL SELECT dst, src, sim FROM knn) GROUP BY 1, 2),
  lab AS MATERIALIZED (SELECT vec_id AS v, label FROM embeddings WHERE {SCORE('vec_id', 'h')} >= 0.3),
  inner_g AS MATERIALIZED (SELECT * FROM g WHERE src NOT IN (SELECT v FROM lab)),
  p AS (SELECT v, label, 1.0::DOUBLE AS share, 0 AS i FROM lab
    UNION ALL SELECT v, label, share, i FROM (
      SELECT src AS v, label, m / sum(m) OVER (PARTITION BY src) AS share, i FROM (SELECT src, p.label, sum(w * share) AS m, max(i) + 1 AS i FROM inner_g JOIN p ON dst = v WHERE i < 200 GROUP BY 1, 2)
      UNION ALL SELECT lab.v, lab.label, 1.0::DOUBLE, n.i FROM lab, (SELECT max(i) + 1 AS i FROM p WHERE i < 200) n WHERE n.i IS NOT NULL)),
  c AS (SELECT coalesce(a.i, b.i + 1) AS i, max(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) AS gap
    FROM (SELECT * FROM p WHERE i % 5 = 0 AND i > 0) a FULL JOIN (SELECT * FROM p WHERE i % 5 = 4) b ON a.v = b.v AND a.label = b.label AND a.i = b.i + 1 GROUP BY 1),
  k AS (SELECT min(i) AS k FROM c WHERE gap < 1e-6), spread AS (SELECT v, label, share FROM p, k WHERE i = k AND v NOT IN (SELECT v FROM lab))"""


def known_labels(spark, d):
    e = table(spark, d, "embeddings").filter(score(F.col("vec_id"), "h") >= 0.3)
    return e.select(F.col("vec_id").alias("vertex"), "label")


@query("k14_label_spread", f"{SPREAD_SQL} SELECT v AS vec_id, label, {R('share')} AS share FROM spread")
def k14(spark, d):
    known = known_labels(spark, d)
    edges = knn(spark, d, 7).select("src", "dst", F.col("sim").alias("weight"))
    out = graph.spread_labels(edges, known).join(known.select("vertex"), "vertex", "left_anti")
    return out.select(F.col("vertex").alias("vec_id"), "label", r(F.col("share")).alias("share"))


@query(
    "k14_spread_report",
    SPREAD_SQL
    + f""", best AS (SELECT v, label, share FROM spread QUALIFY row_number() OVER (PARTITION BY v ORDER BY round(share, 9) DESC, label) = 1)
    SELECT count(*) AS n_reached, {R('avg((b.label = e.label)::INT)')} AS accuracy, count(*) FILTER (WHERE b.label <> e.label AND round(share, 9) > 0.8) AS n_suspects FROM best b JOIN embeddings e ON vec_id = v""",
)
def k14r(spark, d):
    known = known_labels(spark, d)
    edges = knn(spark, d, 7).select("src", "dst", F.col("sim").alias("weight"))
    hidden = table(spark, d, "embeddings").select(F.col("vec_id").alias("vertex"), "label").join(known.select("vertex"), "vertex", "left_anti")
    out = graph.spread_report(graph.spread_labels(edges, known), hidden)
    return out.withColumn("accuracy", r(F.col("accuracy")))


def _regular_sql(rounds=30):
    steps = [f"""WITH {KNN(5)}, g AS (SELECT src, dst FROM knn UNION SELECT dst, src FROM knn), seed AS (SELECT vec_id AS v FROM embeddings WHERE label IN (0, 1, 2)),
      s0 AS (SELECT DISTINCT src AS v, CASE WHEN src IN (SELECT v FROM seed) THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM g)"""]
    for i in range(1, rounds + 1):
        steps.append(f"s{i} AS (SELECT g.src AS v, CASE WHEN g.src IN (SELECT v FROM seed) THEN 1.0::DOUBLE ELSE avg(p.x) END AS x FROM g JOIN s{i-1} p ON g.dst = p.v GROUP BY 1)")
    return ", ".join(steps) + f" SELECT v AS vec_id, {R('x')} AS score FROM s{rounds}"


@query("k15_regularise", _regular_sql())
def k15(spark, d):
    edges = knn(spark, d, 5).select("src", "dst", F.lit(1.0).alias("weight"))
    seeds = vectors(spark, d).filter("y = 1").select(F.col("vec_id").alias("vertex"))
    out = graph.regularise_from_seeds(edges, seeds)
    return out.select(F.col("vertex").alias("vec_id"), r(F.col("score")).alias("score"))


@query(
    "k16_cluster_spread",
    f"""SELECT vec_id, label AS cluster, {SCORE('vec_id')} >= 0.985 AS is_seed FROM embeddings WHERE label IN (SELECT label FROM embeddings WHERE {SCORE('vec_id')} >= 0.985)""",
)
def k16(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    seeds = e.filter(score(F.col("vec_id")) >= 0.985)
    return clusters.spread_from_seeds(e, seeds, "vec_id", "cluster").select("vec_id", "cluster", "is_seed")
