"""Queries whose signals are those of other operators: similarity, neighbour votes, outliers.

A vector belongs to the text of the same number. Trusted classes 0-2 are the positives.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contrasieve.functions import vector as vx
from contrasieve.operators import graph, learn, outliers, pairs, rules
from contrasieve.plans.learning import PU, is_geral, vectors
from contrasieve.plans.registry import query
from contrasieve.plans.rules import TRIAGED, triaged
from contrasieve.plans.similarity import KNN, knn
from contrasieve.plans.standin import R, TEXTS, r, texts
from contrasieve.session import cut_lineage
from contrasieve.sources.tables import keep_first

#: Vectors whose numbers are below this are the centres that clusters start from.
CENTRES = 8

#: pos, sim to the positives, candidate, p: margin of the two centroids from 0 to 1, vote of 5 neighbours, lone: distance of 20.
SIGNALS = f"""pu0 AS (WITH {PU} SELECT vec_id, sim, candidate, pos FROM pu),
  away AS (WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label IN (0, 1, 2) AS pos FROM embeddings),
    m AS (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE NOT pos) GROUP BY 1), c AS (SELECT list(m ORDER BY i) AS c FROM m)
    SELECT vec_id, round(list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)), 9) AS away FROM e, c),
  nn AS MATERIALIZED (WITH {KNN(20)} SELECT src, dst, sim FROM knn), n5 AS (SELECT src, dst FROM nn QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 5),
  vt AS (SELECT b.src AS vec_id, avg((label IN (0, 1, 2))::INT) AS vote FROM (SELECT src, dst FROM n5 UNION SELECT dst, src FROM n5) b JOIN embeddings ON vec_id = dst GROUP BY 1),
  ln AS (SELECT src AS vec_id, round(1 - avg(sim), 9) AS lone FROM nn GROUP BY 1), mg AS (SELECT *, round(sim - away, 9) AS margin FROM pu0 JOIN away USING (vec_id)),
  sig AS (SELECT vec_id, pos, sim, candidate, (margin - min(margin) OVER ()) / nullif(max(margin) OVER () - min(margin) OVER (), 0) AS p, vote, lone
    FROM mg LEFT JOIN vt USING (vec_id) LEFT JOIN ln USING (vec_id))"""


def signals(spark, d):
    """As :data:`SIGNALS`; one graph of 20 neighbours serves the votes and the distances."""
    v = vectors(spark, d)
    near_y = learn.pu_centroid(v, "embedding", F.col("y") == 1)
    near_y = near_y.withColumn("_c", learn.centroid(v.filter("y = 0"), "embedding"))
    away = F.round(vx.cosine(F.col("embedding"), F.col("_c")), 9)
    margins = cut_lineage(near_y.select("vec_id", "y", "sim", "candidate", F.round(F.col("sim") - away, 9).alias("margin")))
    ends = margins.agg(F.struct(F.min("margin").alias("lo"), F.max("margin").alias("hi"))).scalar()
    p = (F.col("margin") - ends["lo"]) / F.nullif(ends["hi"] - ends["lo"], F.lit(0.0))
    edges = cut_lineage(knn(spark, d, 20).select("src", "dst", "sim"))
    nearest = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    closest = edges.withColumn("place", nearest).filter("place <= 5").select("src", "dst", F.lit(1.0).alias("weight"))
    both = graph.both_ways(closest).select("src", "dst").distinct()
    votes = both.join(v.select(F.col("vec_id").alias("dst"), "y"), "dst").groupBy(F.col("src").alias("vec_id")).agg(F.avg("y").alias("vote"))
    lone = edges.groupBy(F.col("src").alias("vec_id")).agg(F.round(1 - F.avg("sim"), 9).alias("lone"))
    return margins.withColumn("p", p).drop("margin").join(votes, "vec_id", "left").join(lone, "vec_id", "left")


def agreement(spark, d):
    """Vectors that are no positives, with the number of scorers that point at them."""
    g = signals(spark, d).filter("y = 0")
    return g.withColumn("votes", rules.count_flags([F.col("p") >= 0.5, F.col("vote") >= 0.5, F.col("candidate")]))


AGREEMENT = SIGNALS + """, ag AS (SELECT *, coalesce(p >= 0.5, false)::INT + coalesce(vote >= 0.5, false)::INT + candidate::INT AS votes FROM sig WHERE NOT pos)"""


@query("m15_vote_consensus", f"WITH {AGREEMENT} SELECT vec_id, votes FROM ag WHERE votes >= 2")
def m15(spark, d):
    return agreement(spark, d).filter("votes >= 2").select("vec_id", "votes")


@query("r15_high_precision", f"WITH {AGREEMENT} SELECT vec_id, {R('p')} AS p, votes FROM ag WHERE p >= 0.75 AND votes >= 2")
def r15(spark, d):
    g = cut_lineage(agreement(spark, d).select("vec_id", "p", "votes"))
    consensus = g.filter("votes >= 2").select("vec_id", "votes")
    out = pairs.intersect_suspects(g.filter("p >= 0.75").select("vec_id", "p"), consensus, "vec_id")
    return out.withColumn("p", r(F.col("p")))


@query(
    "m19_suspicion",
    f"""WITH {SIGNALS}, g AS (SELECT vec_id, vote, rank() OVER (ORDER BY sim) AS k, count(*) OVER (PARTITION BY sim) AS c, count(*) OVER () AS n FROM sig WHERE NOT pos)
    SELECT vec_id, {R('vote * (0.5 + 0.5 * (k + (c - 1) / 2.0) / n)')} AS suspicion FROM g""",
)
def m19(spark, d):
    g = signals(spark, d).filter("y = 0").select("vec_id", "sim", "vote")
    return learn.suspicion(g, "vote", "sim").select("vec_id", r(F.col("suspicion")).alias("suspicion"))


@query(
    "m20_ranking",
    f"""WITH {TEXTS}, {SIGNALS}, x AS (SELECT doc_id, source, left(lower(text), 80) AS k, p FROM texts JOIN sig ON vec_id = doc_id WHERE label = 'geral')
    SELECT doc_id, {R('p')} AS p FROM (SELECT * FROM x WHERE p >= 0.4 QUALIFY row_number() OVER (PARTITION BY k, source ORDER BY p DESC, doc_id) = 1) ORDER BY p DESC, doc_id LIMIT 5000""",
)
def m20(spark, d):
    p = signals(spark, d).select(F.col("vec_id").alias("doc_id"), "p")
    x = texts(spark, d).filter(is_geral()).select("doc_id", "source", F.substring(F.lower("text"), 1, 80).alias("k")).join(p, "doc_id")
    best = pairs.keep_best(x.filter("p >= 0.4"), ["k", "source"], "p", "doc_id")
    return pairs.ranked(best, ["p"], "doc_id").limit(5000).select("doc_id", r(F.col("p")).alias("p"))


@query(
    "k13_detector_ensemble",
    f"""WITH {SIGNALS}, e AS (SELECT src, dst, greatest(0, 1 - sim) AS d FROM nn), kd AS (SELECT src AS dst, max(d) AS kd FROM e GROUP BY 1),
    l AS (SELECT src, count(*) / greatest(sum(greatest(d, kd)), 1e-10)::DOUBLE AS lrd FROM e JOIN kd USING (dst) GROUP BY 1),
    f AS (SELECT e.src AS vec_id, {R('avg(b.lrd) / max(a.lrd)', 5)} AS lof FROM e JOIN l b ON e.dst = b.src JOIN l a ON e.src = a.src GROUP BY 1),
    x AS (SELECT vec_id, lof AS a, lone AS b, 1 - sim AS c FROM sig JOIN f USING (vec_id)),
    n AS (SELECT vec_id, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS a, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS b, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS c,
      row_number() OVER (ORDER BY a DESC, vec_id) AS ra, row_number() OVER (ORDER BY b DESC, vec_id) AS rb, row_number() OVER (ORDER BY c DESC, vec_id) AS rc FROM x)
    SELECT vec_id, {R('(a + b + c) / 3')} AS mean_score, {R('greatest(a, b, c)')} AS max_score, CAST((ra <= 100)::INT + (rb <= 100)::INT + (rc <= 100)::INT AS BIGINT) AS votes, (ra <= 100)::INT + (rb <= 100)::INT + (rc <= 100)::INT >= 2 AS consensus FROM n""",
)
def k13(spark, d):
    lof = outliers.local_outlier_factor(vectors(spark, d), "vec_id", "embedding").select("vec_id", r(F.col("lof"), 5).alias("a"))
    others = signals(spark, d).select("vec_id", F.col("lone").alias("b"), (1 - F.col("sim")).alias("c"))
    out = outliers.detector_ensemble(cut_lineage(lof.join(others, "vec_id")), "vec_id", ["a", "b", "c"], 100)
    return out.withColumn("mean_score", r(F.col("mean_score"))).withColumn("max_score", r(F.col("max_score")))


#: Clusters around the first vectors; suspicious where no fewer than the usual share are positives.
CLUSTERS = f"""cl AS (SELECT a.vec_id, b.vec_id AS centre FROM embeddings a, embeddings b WHERE b.vec_id < {CENTRES} QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY
    round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) DESC, b.vec_id) = 1),
  pc AS (SELECT centre, avg(pos::INT) >= (SELECT avg(pos::INT) FROM sig) AS bad FROM cl JOIN sig USING (vec_id) GROUP BY 1), cs AS (SELECT vec_id, bad FROM cl JOIN pc USING (centre))"""


def suspicious_clusters(spark, d, y):
    """(doc_id, bad) for every vector; ``y`` has vec_id and y."""
    v = vectors(spark, d)
    starts = v.filter(F.col("vec_id") < CENTRES).agg(F.collect_list(F.struct("vec_id", F.col("embedding").alias("e")))).scalar()
    sims = F.transform("_starts", lambda s: F.struct(F.round(vx.cosine(F.col("embedding"), s["e"]), 9).alias("sim"), (-s["vec_id"]).alias("centre")))
    placed = v.withColumn("_starts", starts).select("vec_id", F.array_max(sims)["centre"].alias("centre")).join(y.select("vec_id", "y"), "vec_id")
    share = placed.groupBy("centre").agg(F.avg("y").alias("share"))
    bad = share.select("centre", (F.col("share") >= placed.agg(F.avg("y")).scalar()).alias("bad"))
    return placed.join(bad, "centre").select(F.col("vec_id").alias("doc_id"), "bad")


@query(
    "r8_four_signals",
    f"""WITH {TEXTS}, {TRIAGED}, {SIGNALS}, {CLUSTERS}, x AS (SELECT t.doc_id, d.source, left(lower(d.text), 80) AS k, p,
        coalesce(p >= 0.6, false)::INT + coalesce(vote >= 0.5, false)::INT + bad::INT + (t.pattern IS NOT NULL)::INT AS n_signals
      FROM tri t JOIN documents d ON t.doc_id = d.doc_id JOIN sig ON sig.vec_id = t.doc_id JOIN cs ON cs.vec_id = t.doc_id WHERE t.label = 'geral')
    SELECT doc_id, n_signals, {R('p')} AS p FROM x QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY n_signals DESC, p DESC, doc_id) = 1""",
)
def r8(spark, d):
    s = cut_lineage(signals(spark, d))
    scored = s.select(F.col("vec_id").alias("doc_id"), "p", "vote").join(suspicious_clusters(spark, d, s), "doc_id")
    keys = texts(spark, d).select("doc_id", "source", F.substring(F.lower("text"), 1, 80).alias("k"))
    t = triaged(spark, d).filter(is_geral()).select("doc_id", "pattern").join(scored, "doc_id").join(keys, "doc_id")
    n = rules.count_flags([F.col("p") >= 0.6, F.col("vote") >= 0.5, F.col("bad"), F.col("pattern").isNotNull()])
    best = keep_first(t.withColumn("n_signals", n), ["source", "k"], [-F.col("n_signals"), -F.col("p"), F.col("doc_id")])
    return best.select("doc_id", "n_signals", r(F.col("p")).alias("p"))
