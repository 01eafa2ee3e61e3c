"""Positive-unlabelled learning: reliable negatives, classifiers, folds, calibration, training sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasieve.functions import vector as vx
from contrasieve.operators import metrics
from contrasieve.operators.features import to_vector
from contrasieve.operators.sampling import hash_order, hash_rank, quota_sample, sample_rows
from contrasieve.operators.totals import average_ranks, exact_quantiles
from contrasieve.session import cut_lineage
from contrasieve.sources.tables import keep_first


# --- weights and training sets --------------------------------------------------------


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes * class size) per label."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    total = sizes.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return sizes.select(label, (total["n"] / (total["k"] * F.col("n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    return df.join(class_weights(df, label).withColumnRenamed("weight", name), label)


def weak_labels(is_positive: Column, is_candidate: Column) -> Column:
    """``eng_obra`` for positives, ``nao`` for reliable negatives, null for candidates."""
    return F.when(is_positive, "eng_obra").when(~is_candidate, "nao")


def review_training_set(weak: DataFrame, human: DataFrame, model: DataFrame, key: str, text_key: str, min_conf: float = 0.6) -> DataFrame:
    """Training rows from three sources: human verdicts (x3) win over model verdicts (x2) over weak labels (x1).

    Verdicts reach every row with the same text. ``weak`` has (key, text_key, y), ``human``
    (text_key, y), ``model`` (text_key, y, conf).
    """
    h = human.groupBy(text_key).agg(F.max("y").alias("_hy"))
    m = model.filter(F.col("conf") >= min_conf).groupBy(text_key).agg(F.max("y").alias("_my"))
    out = weak.join(h, text_key, "left").join(m, text_key, "left")
    origin = F.when(F.col("_hy").isNotNull(), "human").when(F.col("_my").isNotNull(), "model").otherwise("weak")
    weight = F.when(F.col("_hy").isNotNull(), 3.0).when(F.col("_my").isNotNull(), 2.0).otherwise(1.0)
    y = F.coalesce("_hy", "_my", "y")
    return out.select(key, y.alias("y"), weight.alias("weight"), origin.alias("origin")).filter("y IS NOT NULL")


def oversample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Repeat rows of smaller classes until all have the size of the largest."""
    ranked = hash_rank(df, [label], key, seed)
    goal = df.groupBy(label).count().agg(F.max("count")).scalar()
    ranked = ranked.withColumn("_goal", goal)
    copies = F.floor(F.col("_goal") / F.col("_size")) + F.when(F.col("_rank") < F.col("_goal") % F.col("_size"), 1).otherwise(0)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_rank", "_size", "_goal")


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows per class as the smallest has, in hash order."""
    least = df.groupBy(label).count().agg(F.min("count")).scalar()
    return hash_rank(df, [label], key, seed).filter(F.col("_rank") < least).drop("_rank", "_size")


def synthetic_minority(df: DataFrame, key: str, vector: str, k: int = 3, seed: int = 42) -> DataFrame:
    """One new point per minority row and neighbour, at a hashed place on the line between them."""
    from contrasieve.operators.neighbours import knn_graph

    edges = knn_graph(df, key, vector, k)
    a = df.select(F.col(key).alias("src"), F.col(vector).alias("_a"))
    b = df.select(F.col(key).alias("dst"), F.col(vector).alias("_b"))
    share = F.conv(F.substring(hash_order(F.concat_ws("|", "src", "dst"), seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    lines = edges.join(a, "src").join(b, "dst").withColumn("_t", share)
    point = F.zip_with("_a", "_b", lambda x, y: x.cast("double") + F.col("_t") * (y.cast("double") - x.cast("double")))
    return lines.select("src", "dst", point.alias(vector))


# --- positive-unlabelled filters ------------------------------------------------------


def centroid(df: DataFrame, vector: str) -> Column:
    """Unit mean vector as a scalar array; dimensions are averaged apart."""
    means = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    one = means.agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("l")).select(F.transform("l", lambda s: s["m"]).alias("c"))
    return one.select(vx.normalise(F.col("c"))).scalar()


def pu_centroid(df: DataFrame, vector: str, positive: Column, share: float = 0.3) -> DataFrame:
    """Adds ``sim`` to the positive centroid and ``candidate`` for the closest share of the others."""
    sims = df.withColumn("_pos", positive).withColumn("_c", centroid(df.filter(positive), vector))
    sims = sims.withColumn("sim", F.round(vx.cosine(F.col(vector), F.col("_c")), 9)).drop("_c")
    return mark_candidates(sims, share)


def pu_prototypes(df: DataFrame, vector: str, positive: Column, k: int = 8, share: float = 0.3, seed: int = 42) -> DataFrame:
    """As :func:`pu_centroid` with the closest of ``k`` prototypes of the positives."""
    unit = cut_lineage(df.withColumn("_pos", positive).withColumn("_u", vx.normalise(F.col(vector))))
    featured = to_vector(unit, "_u", "_f")
    model = KMeans(k=k, featuresCol="_f", predictionCol="_p", seed=seed).fit(featured.filter("_pos"))
    centres = [(c / max(float((c**2).sum()) ** 0.5, 1e-12)).tolist() for c in model.clusterCenters()]  # k vectors
    sims = F.array(*[F.struct(vx.dot(F.col("_u"), vx.literal(c)).alias("sim"), F.lit(i).alias("prototype")) for i, c in enumerate(centres)])
    best = unit.withColumn("_best", F.array_max(sims))
    out = best.withColumn("sim", F.round("_best.sim", 9)).withColumn("prototype", F.col("_best.prototype")).drop("_best", "_u")
    return mark_candidates(out, share)


def mark_candidates(sims: DataFrame, share: float) -> DataFrame:
    """Candidates are the unlabelled rows in the top share of ``sim``; all others stay negatives."""
    cut = exact_quantiles(sims.filter("NOT _pos"), [], "sim", {"q": 1 - share}).scalar()
    return sims.withColumn("candidate", ~F.col("_pos") & (F.col("sim") >= cut)).drop("_pos")


def suspicion(df: DataFrame, probability: str, similarity: str) -> DataFrame:
    """Adds ``suspicion`` = p * (0.5 + 0.5 * percentile rank of similarity)."""
    ranked = average_ranks(df, [], similarity, "_pct", pct=True)
    return ranked.withColumn("suspicion", F.col(probability) * (0.5 + 0.5 * F.col("_pct"))).drop("_pct")


# --- classifiers ----------------------------------------------------------------------


def estimators(n_features: int, weight: str | None = "weight") -> dict:
    """The classifier set; all but the perceptron take class weights."""
    w = {"weightCol": weight} if weight else {}
    common = {"labelCol": "y", "featuresCol": "features"}
    return {
        "logistic": LogisticRegression(maxIter=50, regParam=0.01, **common, **w),
        "linear_svm": LinearSVC(maxIter=50, regParam=0.01, tol=1e-4, **common, **w),
        "decision_tree": DecisionTreeClassifier(maxDepth=8, seed=42, **common, **w),
        "random_forest": RandomForestClassifier(numTrees=50, maxDepth=8, seed=42, **common, **w),
        "gradient_boosting": GBTClassifier(maxIter=20, maxDepth=4, seed=42, **common, **w),
        "naive_bayes": NaiveBayes(modelType="gaussian", **common, **w),
        "perceptron": MultilayerPerceptronClassifier(layers=[n_features, 16, 2], maxIter=50, seed=42, **common),
    }


def predict(model, df: DataFrame, key: str) -> DataFrame:
    """(key, y, p): probability of the positive class; margins go through the logistic function."""
    out = model.transform(df)
    p = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select(key, "y", p.alias("p"))


def fit_all(train: DataFrame, models: Mapping, parallelism: int = 3) -> dict:
    """Fit models side by side; each fit is a distributed job."""
    with ThreadPoolExecutor(parallelism) as pool:
        bound = inheritable_thread_target(train.sparkSession)
        jobs = {n: pool.submit(bound(lambda e=e: e.fit(train))) for n, e in models.items()}
        return {n: job.result() for n, job in jobs.items()}


def out_of_fold(df: DataFrame, key: str, models: Mapping, k: int) -> DataFrame:
    """(model, fold, key, y, p) with every row predicted by a model that did not see its fold."""
    data = cut_lineage(df)
    out = None
    for fold in range(k):
        train, test = data.filter(F.col("fold") != fold), data.filter(F.col("fold") == fold)
        for name, model in fit_all(train, models).items():
            part = predict(model, test, key).withColumns({"model": F.lit(name), "fold": F.lit(fold)})
            out = part if out is None else out.unionByName(part)
    return cut_lineage(out.select("model", "fold", key, "y", "p"))  # every user reads it more than once


def model_metrics(predictions: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Seven metrics per model."""
    scored = predictions.withColumn("_y", F.col("y") == 1)
    cells = metrics.confusion(scored, keys, F.col("_y"), F.col("p") >= 0.5)
    balanced = (F.col("recall") + F.when(F.col("tn") + F.col("fp") > 0, F.col("tn") / (F.col("tn") + F.col("fp"))).otherwise(0.0)) / 2
    areas = metrics.curve_areas(scored, list(keys), "p", "_y")
    return cells.withColumn("balanced_accuracy", balanced).join(areas, list(keys))


def compare_representations(sides: Mapping[str, DataFrame], key: str, model, k: int) -> DataFrame:
    """Metrics of one model on the same folds for each representation, and how they differ from those of the first."""
    out = None
    for name, df in sides.items():
        scores = model_metrics(out_of_fold(with_class_weights(df, "y"), key, {name: model}, k)).withColumnRenamed("model", "representation")
        out = scores if out is None else out.unionByName(scores)
    out = cut_lineage(out.select("representation", "f1", "precision", "recall", "balanced_accuracy", "roc_auc"))
    base = out.filter(F.col("representation") == next(iter(sides))).select(*[F.col(c).alias(f"_{c}") for c in out.columns[1:]])
    gaps = [(F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in out.columns[1:]]
    return out.join(F.broadcast(base), F.lit(True)).select(*out.columns, *gaps)  # base is one row


def dummy_predictions(df: DataFrame, key: str, strategy: str = "majority", seed: int = 42) -> DataFrame:
    """Baseline: the label share as probability, or a hashed draw from it."""
    share = df.agg(F.avg("y")).scalar()
    draw = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    p = share if strategy == "majority" else F.when(draw < share, 1.0).otherwise(0.0)
    return df.select(key, "y", p.alias("p"))


def grid_search(df: DataFrame, fold: str = "fold", regs: Sequence[float] = (0.02, 0.1, 1.0), parallelism: int = 3) -> DataFrame:
    """Mean area under the ROC curve of each regularisation, on given folds."""
    base = LogisticRegression(labelCol="y", featuresCol="features", maxIter=30)
    grid = ParamGridBuilder().addGrid(base.regParam, list(regs)).build()
    search = CrossValidator(
        estimator=base, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="y"), foldCol=fold,
        numFolds=df.agg(F.max(fold)).first()[0] + 1, parallelism=parallelism,
    )
    scores = search.fit(df).avgMetrics
    return df.sparkSession.createDataFrame([(float(c), float(s)) for c, s in zip(regs, scores)], "reg double, roc_auc double")


def calibrate(train: DataFrame, df: DataFrame, score: str = "p", min_isotonic: int = 800) -> DataFrame:
    """Adds ``calibrated``: isotonic from 800 labelled rows on, logistic below."""
    n = train.count()
    fitted = train.select(F.col("y").cast("double").alias("y"), F.array(score).alias("_a"))
    if n >= min_isotonic:
        model = IsotonicRegression(labelCol="y", featuresCol="_f").fit(to_vector(fitted, "_a", "_f"))
        out = model.transform(to_vector(df.withColumn("_a", F.array(score)), "_a", "_f"))
        return out.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction"))).drop("_a", "_f", "prediction")
    model = LogisticRegression(labelCol="y", featuresCol="_f").fit(to_vector(fitted, "_a", "_f"))
    slope, bias = float(model.coefficients[0]), float(model.intercept)
    return df.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(slope) * F.col(score) + bias))))


def calibrate_folds(predictions: DataFrame, weak: DataFrame | None = None, min_strong: int = 300) -> DataFrame:
    """Adds ``calibrated`` to out-of-fold predictions (model, fold, y, p): each fold by the others of its model.

    Below ``min_strong`` labelled rows the rows of ``weak`` (model, y, p), labelled by rules, are used as well.
    """
    out = None
    for model, fold in sorted((r["model"], r["fold"]) for r in predictions.select("model", "fold").distinct().collect()):
        own = predictions.filter(F.col("model") == model)
        train = own.filter(F.col("fold") != fold).select("y", "p")
        if weak is not None and train.count() < min_strong:
            train = train.unionByName(weak.filter(F.col("model") == model).select("y", "p"))
        part = calibrate(train, own.filter(F.col("fold") == fold))
        out = part if out is None else out.unionByName(part)
    return out


def score_new(model, df: DataFrame, key: str, category: str, limit: float = 0.6) -> DataFrame:
    """(key, p, already, suspect) of rows the model has not seen: likely, and not in a works or engineering category."""
    rows = df if "y" in df.columns else df.withColumn("y", F.lit(0))
    scored = predict(model, rows, key).drop("y").join(df.select(key, category), key)
    already = F.coalesce(F.lower(category).rlike("obra|engenharia"), F.lit(False))
    return scored.select(key, "p", already.alias("already"), ((F.col("p") >= limit) & ~already).alias("suspect"))


def best_models(quality: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` models by F1, ties by name."""
    return quality.orderBy(F.desc("f1"), "model").limit(top).select("model")


def mean_of_best(predictions: DataFrame, quality: DataFrame, key: str, top: int = 3, score: str = "p") -> DataFrame:
    """Mean probability of the ``top`` models by F1."""
    best = best_models(quality, top)
    return predictions.join(F.broadcast(best), "model").groupBy(key).agg(F.avg(score).alias("p"), F.max("y").alias("y"), F.count("*").alias("n_models"))


def term_coefficients(df: DataFrame, tokens: Column, vocab_size: int = 5000, min_df: float = 5.0, top: int = 20) -> DataFrame:
    """Terms with the strongest logistic weights on both sides."""
    from pyspark.ml.feature import CountVectorizer

    words = df.select(F.col("y").cast("double").alias("y"), tokens.alias("_t"))
    counter = CountVectorizer(inputCol="_t", outputCol="features", vocabSize=vocab_size, minDF=min_df, binary=True).fit(words)
    model = LogisticRegression(labelCol="y", maxIter=30, regParam=0.05, elasticNetParam=0.0).fit(counter.transform(words))
    rows = [(w, float(c)) for w, c in zip(counter.vocabulary, model.coefficients)]  # at most vocab_size
    table = df.sparkSession.createDataFrame(rows, "term string, weight double")
    strongest = table.orderBy(F.desc("weight"), "term").limit(top).unionByName(table.orderBy("weight", "term").limit(top))
    return strongest.withColumn("side", F.when(F.col("weight") > 0, "positive").otherwise("negative"))


# --- samples for reviewers ------------------------------------------------------------


def uncertainty(probabilities: Column, strategy: str = "uncertainty") -> Column:
    """Higher = less certain. The entropy form puts the least certain rows first."""
    ordered = F.reverse(F.array_sort(probabilities))
    if strategy == "margin":
        return -(F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))
    if strategy == "entropy":
        return F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0)))
    return -F.array_max(probabilities)


def validation_sample(
    df: DataFrame, key: str, text_key: str, cluster: str, p: str, limit: float, sizes: tuple[int, int, int] = (100, 50, 50), seed: int = 42
) -> DataFrame:
    """One row per text: suspects by cluster quota, uncertain rows below the limit, and rest."""
    unique = keep_first(df, [text_key], [F.col(key)])
    suspects = unique.filter(F.col(p) >= limit)
    total = suspects.agg(F.count("*")).scalar()
    quota = F.greatest(F.lit(1), F.ceil(F.lit(sizes[0]) * F.col("_size") / total))
    # quotas are rounded up, so the first of the hash order are taken in the end
    a = sample_rows(quota_sample(suspects, [cluster], key, quota, seed), key, sizes[0], seed).withColumn("stratum", F.lit("suspeito"))
    b = sample_rows(unique.filter((F.col(p) >= 0.3) & (F.col(p) < limit)), key, sizes[1], seed).withColumn("stratum", F.lit("incerto"))
    taken = a.select(key).unionByName(b.select(key))
    c = sample_rows(unique.join(taken, key, "left_anti"), key, sizes[2], seed).withColumn("stratum", F.lit("resto"))
    return a.unionByName(b).unionByName(c).withColumn("_h", hash_order(key, seed)).orderBy("_h", key).drop("_h")


def quadrant_sample(df: DataFrame, label: Column, code: Column, key: str, quotas: Mapping[tuple[bool, bool], int], seed: int = 42) -> DataFrame:
    """A fixed number of rows per (label, code) quadrant."""
    tagged = df.withColumn("q_label", label).withColumn("q_code", code)
    quota = F.lit(0)
    for (a, b), n in quotas.items():
        quota = F.when((F.col("q_label") == a) & (F.col("q_code") == b), n).otherwise(quota)
    return quota_sample(tagged, ["q_label", "q_code"], key, quota, seed)


def coherence(df: DataFrame, key: str, vector: str, positives: DataFrame, generals: DataFrame, k: int = 10, refs: int = 1000, seed: int = 42) -> DataFrame:
    """Mean similarity to the ``k`` nearest positive references minus that to general ones."""
    from contrasieve.operators.neighbours import knn_search, unit_rows

    queries = cut_lineage(unit_rows(df, key, vector))

    def side(stock: DataFrame, name: str) -> DataFrame:
        found = knn_search(queries, unit_rows(sample_rows(stock, key, refs, seed), key, vector), k)
        return found.groupBy(F.col("src").alias(key)).agg(F.avg("sim").alias(name))

    out = side(positives, "to_positive").join(side(generals, "to_general"), key)
    return out.withColumn("coherence", F.col("to_positive") - F.col("to_general"))
