"""Queries on supervised and positive-unlabelled learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrasieve.functions import text as tx
from contrasieve.operators import features, learn, metrics, sampling
from contrasieve.plans.joins import SCORED, scored
from contrasieve.session import cut_lineage
from contrasieve.plans.registry import query, table
from contrasieve.plans.standin import FACT, FACT_GEO, R, SCORE, TEXTS, fact, fact_geo, r, score, texts
from contrasieve.plans.text import COMPAT_SQL

def is_geral():
    return F.col("label") == "geral"

def is_pos():
    return F.col("label") != "geral"



def vectors(spark, d):
    """Embeddings with y = 1 for the trusted classes 0-2."""
    return table(spark, d, "embeddings").select(
        "vec_id", "embedding", F.col("label").alias("cls"), F.col("label").isin(0, 1, 2).cast("int").alias("y")
    )


def featured(spark, d, k=3):
    """Vectors as features with folds and class weights."""
    v = features.to_vector(vectors(spark, d), "embedding").select("vec_id", "y", "features")
    return learn.with_class_weights(sampling.fold_ids(v, "y", "vec_id", k), "y")


@query(
    "m1_holdout_split",
    f"""WITH {FACT}, x AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) - 1 AS k, count(*) OVER (PARTITION BY label) AS s FROM fact)
    SELECT id, k < CAST(round(s * 0.2) AS BIGINT) AS is_test FROM x""",
)
def m1(spark, d):
    return sampling.split_holdout(fact(spark, d).select("id", "label"), "label", "id").select("id", "is_test")


@query(
    "m1_temporal_split",
    f"""WITH {FACT}, g AS (SELECT label, count(*) FILTER (WHERE year >= 2000) AS a, count(*) FILTER (WHERE year < 2000) AS b FROM fact GROUP BY 1)
    SELECT label, year >= 2000 AS is_test, count(*) AS n FROM fact GROUP BY 1, 2""",
)
def m1t(spark, d):
    split = sampling.split_by_period(fact(spark, d), "label", "id", F.col("year") >= 2000)
    return split.groupBy("label", "is_test").agg(F.count("*").alias("n"))


@query(
    "m2_stratified_sample",
    f"""WITH {FACT_GEO}, x AS (SELECT id, state, row_number() OVER (PARTITION BY state ORDER BY md5('42|' || id), id) - 1 AS k FROM factg),
    z AS (SELECT state, count(*) AS s, (SELECT count(*) FROM factg) AS n FROM factg GROUP BY 1), q AS (SELECT state, s, 3000 * s // n AS w, 3000 * s % n AS rest FROM z),
    o AS (SELECT *, row_number() OVER (ORDER BY rest DESC, state) AS pos, 3000 - sum(w) OVER () AS spare FROM q)
    SELECT id, x.state FROM x JOIN o ON x.state = o.state WHERE k < least(s, w + (pos <= spare)::INT)""",
)
def m2(spark, d):
    return sampling.stratified_sample(fact_geo(spark, d).select("id", "state"), "state", "id", 3000)


@query(
    "m2_even_sample",
    f"""WITH {FACT}, x AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) - 1 AS k FROM fact)
    SELECT id, label FROM x WHERE k < 3000 // (SELECT count(DISTINCT label) FROM fact)""",
)
def m2e(spark, d):
    return sampling.even_sample(fact(spark, d).select("id", "label"), "label", "id", 3000)


@query(
    "m3_fold_ids",
    f"""WITH {FACT} SELECT id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) - 1) % 5 AS INTEGER) AS fold FROM fact""",
)
def m3(spark, d):
    return sampling.fold_ids(fact(spark, d).select("id", "label"), "label", "id", 5).select("id", "fold")


TEXT_KEY = "md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')))"


def keyed_texts(spark, d):
    """Texts with a key that copies share."""
    return texts(spark, d).withColumn("text_key", F.md5(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))))


@query(
    "m3_group_folds",
    f"""WITH {TEXTS}, t AS (SELECT doc_id, label, {TEXT_KEY} AS g FROM texts), c AS (SELECT g, label, count(*) AS n FROM t GROUP BY 1, 2),
    p AS (SELECT g, sum(n) AS size, arg_min(label, (-n, label)) AS label FROM c GROUP BY 1),
    o AS (SELECT g, (row_number() OVER (PARTITION BY label ORDER BY size DESC, md5('42|' || g), g) - 1) % 10 AS turn FROM p)
    SELECT doc_id, CAST(CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS INTEGER) AS fold FROM t JOIN o USING (g)""",
)
def m3g(spark, d):
    return sampling.group_folds(keyed_texts(spark, d).select("doc_id", "label", "text_key"), "label", "text_key", 5).select("doc_id", "fold")


@query(
    "m4_class_weights",
    f"WITH {FACT}, c AS (SELECT label, count(*) AS n FROM fact GROUP BY 1) SELECT label, {R('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE')} AS weight FROM c",
)
def m4(spark, d):
    return learn.class_weights(fact(spark, d), "label").withColumn("weight", r(F.col("weight")))


@query("m5_classifiers")
def m5(spark, d):
    data = sampling.split_holdout(features.to_vector(vectors(spark, d), "embedding").select("vec_id", "y", "features"), "y", "vec_id")
    data = learn.with_class_weights(data, "y")
    train, test = data.filter("NOT is_test"), data.filter("is_test")
    out = learn.dummy_predictions(test, "vec_id").withColumn("model", F.lit("dummy"))
    for name, model in learn.fit_all(train, learn.estimators(64)).items():
        out = out.unionByName(learn.predict(model, test, "vec_id").withColumn("model", F.lit(name)))
    return out


def out_of_fold(spark, d):
    return learn.out_of_fold(featured(spark, d, 3), "vec_id", learn.estimators(64), 3)


@query("m6_out_of_fold")
def m6(spark, d):
    scores = learn.model_metrics(out_of_fold(spark, d))
    best = learn.best_models(scores, 1).withColumnRenamed("model", "_best")
    return scores.join(F.broadcast(best), F.col("model") == F.col("_best"), "left").withColumn("best", F.col("_best").isNotNull()).drop("_best")


@query("m7_grid_search")
def m7(spark, d):
    return learn.grid_search(featured(spark, d))


PREDICTED = FACT + f", pred AS (SELECT *, CASE WHEN {SCORE('id')} < 0.6 THEN label WHEN discount > 0.05 THEN 'geral' ELSE 'obras' END AS guess FROM fact)"


def predicted(spark, d):
    guess = F.when(score(F.col("id")) < 0.6, F.col("label")).when(F.col("discount") > 0.05, "geral").otherwise("obras")
    return fact(spark, d).withColumn("guess", guess)


M8_SQL = f"""WITH {PREDICTED}, l AS (SELECT DISTINCT label FROM pred), c AS (SELECT l.label, count(*) FILTER (WHERE p.label = l.label) AS support, count(*) FILTER (WHERE guess = l.label) AS np,
    count(*) FILTER (WHERE guess = l.label AND p.label = l.label) AS hit FROM l CROSS JOIN pred p GROUP BY 1)
  SELECT label, support, {R('hit / np::DOUBLE')} AS precision, {R('hit / support::DOUBLE')} AS recall, {R('2.0 * hit / (np + support)')} AS f1 FROM c"""


@query("m8_class_report", M8_SQL)
def m8(spark, d):
    out = metrics.class_report(predicted(spark, d), "label", "guess")
    return out.select("label", "support", *[r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


CELLS = "count(*) FILTER (WHERE y AND h) AS tp, count(*) FILTER (WHERE NOT y AND h) AS fp, count(*) FILTER (WHERE y AND NOT h) AS fn, count(*) FILTER (WHERE NOT y AND NOT h) AS tn"
PRF = f"""{R('CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END')} AS precision, {R('CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END')} AS recall,
  {R('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END')} AS f1"""


@query(
    "m8_confusion",
    f"""WITH {PREDICTED}, b AS (SELECT status, label <> 'geral' AS y, guess <> 'geral' AS h FROM pred), c AS (SELECT status, {CELLS} FROM b GROUP BY 1)
    SELECT status, tp, fp, fn, tn, {PRF}, {R('(tp + tn) / (tp + fp + fn + tn)::DOUBLE')} AS accuracy FROM c""",
)
def m8c(spark, d):
    out = metrics.confusion(predicted(spark, d), ["status"], is_pos(), F.col("guess") != "geral")
    for c in ("precision", "recall", "f1", "accuracy"):
        out = out.withColumn(c, r(F.col(c)))
    return out


# A score with many ties: hashed noise plus the truth, cut to two digits.
TIED = FACT + f", tied AS (SELECT id, status, label <> 'geral' AS y, round(0.7 * {SCORE('id')} + CASE WHEN label <> 'geral' THEN 0.2 ELSE 0 END, 2) AS s FROM fact)"


def tied(spark, d):
    s = F.round(0.7 * score(F.col("id")) + F.when(is_pos(), 0.2).otherwise(0.0), 2)
    return fact(spark, d).select("id", "status", is_pos().alias("y"), s.alias("s"))


@query(
    "m9_curve_areas",
    f"""WITH {TIED}, g AS (SELECT status, s, count(*) FILTER (WHERE y)::DOUBLE AS p, count(*) FILTER (WHERE NOT y)::DOUBLE AS n FROM tied GROUP BY 1, 2),
    c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER t AS np, sum(n) OVER t AS nn FROM g WINDOW w AS (PARTITION BY status ORDER BY s DESC), t AS (PARTITION BY status))
    SELECT status, {R('sum(n * (tp - p) + 0.5 * n * p) / max(np * nn)')} AS roc_auc, {R('sum(p * tp / (tp + fp)) / max(np)')} AS average_precision FROM c GROUP BY 1""",
)
def m9(spark, d):
    out = metrics.curve_areas(tied(spark, d), ["status"], "s", "y")
    return out.select("status", r(F.col("roc_auc")).alias("roc_auc"), r(F.col("average_precision")).alias("average_precision"))


GRID = [round(0.30 + 0.05 * i, 2) for i in range(14)]
SWEEP = TIED + f""", grid AS (SELECT unnest([{', '.join(str(g) for g in GRID)}]::DOUBLE[]) AS threshold),
  c AS (SELECT threshold, count(*) FILTER (WHERE y AND s >= threshold) AS tp, count(*) FILTER (WHERE NOT y AND s >= threshold) AS fp,
    count(*) FILTER (WHERE y AND s < threshold) AS fn, count(*) FILTER (WHERE NOT y AND s < threshold) AS tn FROM tied CROSS JOIN grid GROUP BY 1)"""


@query("m10_threshold_sweep", f"WITH {SWEEP} SELECT threshold, tp, fp, fn, tn, {PRF} FROM c")
def m10(spark, d):
    out = metrics.threshold_sweep(tied(spark, d), "s", "y", GRID).drop("accuracy")
    for c in ("precision", "recall", "f1"):
        out = out.withColumn(c, r(F.col(c)))
    return out


@query(
    "m10_pick_threshold",
    f"""WITH {SWEEP}, x AS (SELECT threshold, tp / greatest(tp + fp, 1)::DOUBLE AS pr, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM c)
    SELECT (SELECT threshold FROM x ORDER BY f1 DESC, threshold LIMIT 1) AS best_f1_threshold,
      coalesce((SELECT min(threshold) FROM x WHERE pr >= 0.9), (SELECT threshold FROM x ORDER BY pr DESC, threshold LIMIT 1)) AS precise_threshold""",
)
def m10p(spark, d):
    return metrics.pick_threshold(metrics.threshold_sweep(tied(spark, d), "s", "y", GRID))


@query("m11_bootstrap")
def m11(spark, d):
    cells = metrics.confusion(predicted(spark, d), [], is_pos(), F.col("guess") != "geral")
    return metrics.bootstrap(cells, 200)


@query(
    "m12_mcnemar",
    f"""WITH {PREDICTED}, x AS (SELECT label <> 'geral' AS y, guess <> 'geral' AS a, discount > 0.03 AS b FROM pred), c AS (SELECT count(*) FILTER (WHERE a = y AND b <> y) AS only_a, count(*) FILTER (WHERE a <> y AND b = y) AS only_b FROM x)
    SELECT only_a, only_b, {R('CASE WHEN only_a + only_b > 0 THEN greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b)::DOUBLE ELSE 0 END')} AS chi2 FROM c""",
)
def m12(spark, d):
    out = metrics.mcnemar(predicted(spark, d), is_pos(), F.col("guess") != "geral", F.col("discount") > 0.03)
    return out.select("only_a", "only_b", r(F.col("chi2")).alias("chi2"))


@query("m13_calibration")
def m13(spark, d):
    models = {"logistic": learn.estimators(64)["logistic"]}
    p = learn.out_of_fold(featured(spark, d, 3), "vec_id", models, 3)
    # where strong labels are few: rows that a rule labels, here the closest ones to the positives
    rule = learn.pu_centroid(vectors(spark, d), "embedding", F.col("y") == 1).select("vec_id", F.col("candidate").cast("int").alias("y"))
    return learn.calibrate_folds(p, p.drop("y").join(rule, "vec_id"))


@query("m14_ensemble")
def m14(spark, d):
    p = out_of_fold(spark, d)
    quality = cut_lineage(learn.model_metrics(p))
    best = p.join(F.broadcast(learn.best_models(quality)), "model")
    return learn.mean_of_best(learn.calibrate_folds(cut_lineage(best)), quality, "vec_id", score="calibrated")


PU = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, label IN (0, 1, 2) AS pos FROM embeddings),
  m AS (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE pos) GROUP BY 1), c AS (SELECT list(m ORDER BY i) AS c FROM m),
  s AS (SELECT vec_id, label, pos, round(list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)), 9) AS sim FROM e, c),
  pu AS (SELECT *, NOT pos AND sim >= (SELECT quantile_cont(sim, 0.7) FROM s WHERE NOT pos) AS candidate FROM s)"""


def pu(spark, d):
    return learn.pu_centroid(vectors(spark, d), "embedding", F.col("y") == 1)


@query("m16_pu_centroid", f"WITH {PU} SELECT vec_id, {R('sim')} AS sim, candidate FROM pu")
def m16(spark, d):
    return pu(spark, d).select("vec_id", r(F.col("sim")).alias("sim"), "candidate")


@query("m17_pu_prototypes")
def m17(spark, d):
    return learn.pu_prototypes(vectors(spark, d), "embedding", F.col("y") == 1).select("vec_id", "y", "prototype", "sim", "candidate")


@query(
    "m18_weak_labels",
    f"WITH {PU} SELECT vec_id, CASE WHEN pos THEN 'eng_obra' WHEN NOT candidate THEN 'nao' END AS weak FROM pu",
)
def m18(spark, d):
    return pu(spark, d).select("vec_id", learn.weak_labels(F.col("y") == 1, F.col("candidate")).alias("weak"))


@query(
    "m21_active_sample",
    f"""WITH {SCORED}, g AS (SELECT id, p FROM scored WHERE label = 'geral'), u AS (SELECT 'uncertainty' AS strategy, id, round(-greatest(p, 1 - p), 9) AS s FROM g UNION ALL SELECT 'margin', id, round(-abs(2 * p - 1), 9) FROM g
      UNION ALL SELECT 'entropy', id, round(-(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) - (CASE WHEN p < 1 THEN (1 - p) * ln(1 - p) ELSE 0 END), 9) FROM g)
    SELECT strategy, id, {R('s')} AS s FROM u QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY s DESC, id) <= 50""",
)
def m21(spark, d):
    g = scored(spark, d).filter(is_geral()).select("id", F.array("p", 1 - F.col("p")).alias("q"))
    out = None
    for name in ("uncertainty", "margin", "entropy"):
        s = g.select(F.lit(name).alias("strategy"), "id", F.round(learn.uncertainty(F.col("q"), name), 9).alias("s"))
        s = s.orderBy(F.desc("s"), "id").limit(50)
        out = s if out is None else out.unionByName(s)
    return out.withColumn("s", r(F.col("s")))


M22_SQL = f"""WITH k AS (SELECT doc_id, source, md5(trim(regexp_replace({COMPAT_SQL}, '[^a-z0-9]+', ' ', 'g'))) AS tk, {SCORE('doc_id')} AS p, md5('42|' || doc_id) AS h FROM documents),
  u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY tk ORDER BY doc_id) = 1),
  s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS rk, count(*) OVER (PARTITION BY source) AS sz, count(*) OVER () AS n FROM u WHERE p >= 0.7),
  a AS (SELECT doc_id, 'suspeito' AS stratum FROM (SELECT * FROM s WHERE rk < greatest(1, ceil(100 * sz / n::DOUBLE)) ORDER BY h, doc_id LIMIT 100)),
  b AS (SELECT doc_id, 'incerto' AS stratum FROM (SELECT * FROM u WHERE p >= 0.3 AND p < 0.7 ORDER BY h, doc_id LIMIT 50)),
  c AS (SELECT doc_id, 'resto' AS stratum FROM (SELECT * FROM u WHERE doc_id NOT IN (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b) ORDER BY h, doc_id LIMIT 50))
  SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""


@query("m22_validation_sample", M22_SQL)
def m22(spark, d):
    k = table(spark, d, "documents").select("doc_id", "source", F.md5(tx.text_key(F.col("text"))).alias("tk"), score(F.col("doc_id")).alias("p"))
    return learn.validation_sample(k, "doc_id", "tk", "source", "p", 0.7).select("doc_id", "stratum")


@query(
    "m23_quadrant_sample",
    f"""WITH {FACT}, x AS (SELECT id, label = 'geral' AS q_label, discount > 0.05 AS q_code, row_number() OVER (PARTITION BY label = 'geral', discount > 0.05 ORDER BY md5('42|' || id), id) AS k FROM fact)
    SELECT id, q_label, q_code FROM x WHERE k <= CASE WHEN q_label THEN 10 ELSE 5 END""",
)
def m23(spark, d):
    quotas = {(True, True): 10, (True, False): 10, (False, True): 5, (False, False): 5}
    out = learn.quadrant_sample(fact(spark, d).select("id", "label", "discount"), is_geral(), F.col("discount") > 0.05, "id", quotas)
    return out.select("id", "q_label", "q_code")


@query(
    "m24_training_set",
    f"""WITH k AS (SELECT d.doc_id, md5(trim(regexp_replace({COMPAT_SQL}, '[^a-z0-9]+', ' ', 'g'))) AS tk, quality, {SCORE('d.doc_id')} AS p, {SCORE('d.doc_id', 'c')} AS conf FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    h AS (SELECT tk, max(quality) AS hy FROM k WHERE quality IS NOT NULL GROUP BY 1), m AS (SELECT tk, max((p > 0.5)::INT) AS my FROM k WHERE conf >= 0.6 GROUP BY 1)
    SELECT doc_id, coalesce(hy, my, wy) AS y, CASE WHEN hy IS NOT NULL THEN 3.0::DOUBLE WHEN my IS NOT NULL THEN 2.0 ELSE 1.0 END AS weight, CASE WHEN hy IS NOT NULL THEN 'human' WHEN my IS NOT NULL THEN 'model' ELSE 'weak' END AS origin
    FROM (SELECT doc_id, tk, CASE WHEN p > 0.8 THEN 1 WHEN p < 0.4 THEN 0 END AS wy FROM k) LEFT JOIN h USING (tk) LEFT JOIN m USING (tk) WHERE coalesce(hy, my, wy) IS NOT NULL""",
)
def m24(spark, d):
    k = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", F.md5(tx.text_key(F.col("text"))).alias("tk"), "quality", score(F.col("doc_id")).alias("p"), score(F.col("doc_id"), "c").alias("conf")
    )
    weak = k.select("doc_id", "tk", F.when(F.col("p") > 0.8, 1).when(F.col("p") < 0.4, 0).alias("y"))
    human = k.filter("quality IS NOT NULL").select("tk", F.col("quality").alias("y"))
    model = k.select("tk", (F.col("p") > 0.5).cast("int").alias("y"), "conf")
    return learn.review_training_set(weak, human, model, "doc_id", "tk")


@query(
    "m25_signal_scores",
    f"""WITH {SCORED}, x AS (SELECT label <> 'geral' AS y, p > 0.5 AS a, discount > 0.05 AS b FROM scored WHERE qty > 5), u AS (SELECT 'clf' AS signal, y, a AS h FROM x UNION ALL SELECT 'code', y, b FROM x UNION ALL SELECT 'clf_and_code', y, a AND b FROM x),
    c AS (SELECT signal, {CELLS} FROM u GROUP BY 1) SELECT signal, tp, fp, fn, tn, {PRF} FROM c""",
)
def m25(spark, d):
    a, b = F.col("p") > 0.5, F.col("discount") > 0.05
    out = metrics.signal_scores(scored(spark, d).filter("qty > 5"), is_pos(), {"clf": a, "code": b, "clf_and_code": a & b}).drop("accuracy")
    for c in ("precision", "recall", "f1"):
        out = out.withColumn(c, r(F.col(c)))
    return out


@query(
    "m26_oversample",
    """WITH x AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS s FROM events), g AS (SELECT max(s) AS g FROM x)
    SELECT event_id, event_type, CAST(unnest(range(1, CAST(floor(g / s) + CASE WHEN k < g % s THEN 1 ELSE 0 END AS BIGINT) + 1)) AS INTEGER) AS copy FROM x, g""",
)
def m26o(spark, d):
    return learn.oversample(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")


@query(
    "m26_undersample",
    """WITH x AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS s FROM events)
    SELECT event_id, event_type FROM x WHERE k < (SELECT min(s) FROM x)""",
)
def m26u(spark, d):
    return learn.undersample(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")


@query("m26_synthetic_minority")
def m26s(spark, d):
    return learn.synthetic_minority(vectors(spark, d).filter("y = 1"), "vec_id", "embedding")


@query("m27_representation_comparison")
def m27(spark, d):
    t = cut_lineage(sampling.group_folds(keyed_texts(spark, d).filter(is_pos()), "label", "text_key", 5).withColumn("y", (F.col("label") == "engenharia").cast("int")))
    clean = tx.tokens(F.col("text"))
    sides = {
        "clean": features.hashed_tfidf(t, clean),
        "raw": features.hashed_tfidf(t, F.concat(tx.raw_tokens(F.col("text")), F.array("source", "lang"))),
        "embedding": features.to_vector(t.join(features.text_vectors(t, "doc_id", clean), "doc_id"), "embedding"),
    }
    return learn.compare_representations({n: v.select("doc_id", "y", "fold", "features") for n, v in sides.items()}, "doc_id", learn.estimators(2)["logistic"], 5)


@query("m28_term_coefficients")
def m28(spark, d):
    t = texts(spark, d).withColumn("y", is_pos().cast("int"))
    return learn.term_coefficients(t, tx.tokens(F.col("text")))


M29_SQL = f"""WITH v AS (SELECT vec_id, label IN (0, 1, 2) AS pos, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
  ref AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY pos ORDER BY md5('42|' || vec_id), vec_id) <= 1000),
  s AS (SELECT a.vec_id, b.pos, b.vec_id AS dst, round(list_dot_product(a.e, b.e), 9) AS sim FROM v a, ref b WHERE NOT a.pos),
  t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id, pos ORDER BY sim DESC, dst) <= 10)
  SELECT vec_id, {R('avg(sim) FILTER (WHERE pos)', 5)} AS to_positive, {R('avg(sim) FILTER (WHERE NOT pos)', 5)} AS to_general, {R('avg(sim) FILTER (WHERE pos) - avg(sim) FILTER (WHERE NOT pos)', 5)} AS coherence FROM t GROUP BY 1"""


@query("m29_coherence", M29_SQL)
def m29(spark, d):
    v = vectors(spark, d)
    out = learn.coherence(v.filter("y = 0"), "vec_id", "embedding", v.filter("y = 1"), v.filter("y = 0"))
    return out.select("vec_id", *[r(F.col(c), 5).alias(c) for c in ("to_positive", "to_general", "coherence")])


@query("m30_score_new_rows")
def m30(spark, d):
    v = features.to_vector(vectors(spark, d), "embedding")
    is_new = score(F.col("vec_id"), "new") < 0.3
    known = learn.with_class_weights(v.filter(~is_new), "y")
    model = learn.estimators(64)["logistic"].fit(known.select("y", "features", "weight"))
    category = F.when(F.col("cls") == 0, "Obras").when(F.col("cls") == 1, "Serviços de Engenharia").otherwise("Compras")
    return learn.score_new(model, v.filter(is_new).drop("y").withColumn("category", category), "vec_id", "category")
