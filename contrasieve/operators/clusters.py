"""Reading clusters: purity, suspicion, spread of seeds, membership entropy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasieve.session import cut_lineage


def purity(df: DataFrame, cluster: str, positive: Column, min_share: float = 0.6, min_rows: int = 5) -> DataFrame:
    """Rows, positives and percent per cluster; suspicious = mostly positive with some general rows."""
    out = df.groupBy(cluster).agg(
        F.count("*").alias("n"), F.count_if(positive).alias("n_pos"), (100 * F.avg(positive.cast("int"))).alias("pct_pos")
    )
    rule = (F.col("n_pos") / F.col("n") >= min_share) & (F.col("n") > F.col("n_pos")) & (F.col("n") >= min_rows)
    return out.withColumn("suspicious", rule)


def spread_from_seeds(df: DataFrame, seeds: DataFrame, key: str, cluster: str) -> DataFrame:
    """Every member of a cluster that holds at least one seed, the seeds themselves marked."""
    marked = df.join(seeds.select(key).distinct().withColumn("is_seed", F.lit(True)), key, "left")
    hit = marked.filter("is_seed").select(cluster).distinct()
    return marked.join(hit, cluster, "left_semi").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))


def membership_entropy(probabilities: Column) -> Column:
    """Entropy (nats) of an array of membership probabilities."""
    return F.aggregate(
        probabilities, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))
    )


def sample_starts(data: DataFrame, vector: str, k: int, seed: int, sample: int = 4096) -> np.ndarray:
    """k spread-out rows: each next one is drawn by squared distance to the nearest before.

    They are drawn from the first ``sample`` different rows by hash, which bounds what reaches the driver.
    """
    rows = data.select(vector).distinct().orderBy(F.xxhash64(vector, F.lit(seed)), vector).limit(sample).collect()
    x = np.array([r[0] for r in rows], dtype=float)
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(x)):
        chosen.append(int(rng.choice(len(x), p=near / near.sum())))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def kmeans_sweep(
    df: DataFrame, features: str, ks, seed: int = 42, rounds: int = 300, tolerance: float = 1e-4, starts: dict[int, np.ndarray] | None = None
) -> DataFrame:
    """(k, inertia, silhouette, rounds, best) of clusters by cosine distance, one row per ``k``.

    One pass of the rows a round serves every ``k``: a task multiplies its rows by all centres at once and adds up vectors and
    counts per centre, and the driver holds these sums alone. A ``k`` rests when no centre moved by more than ``tolerance``;
    a centre without rows stays where it is. Zero and null vectors take no part. The silhouette needs one more pass, linear in the rows.
    A ``k`` above the number of different rows gets as many centres as there are; without rows there are no results.
    """
    unit = F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, y: acc + y * y)))
    rows = df.select(F.col(features).cast("array<double>").alias("v")) if dict(df.dtypes)[features].startswith("array") else _as_arrays(df, features)
    data = cut_lineage(rows.where(F.exists("v", lambda x: x != 0)).select(unit.alias("v")))
    schema = "k int, inertia double, silhouette double, rounds int, best boolean"
    if data.isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    ks = sorted(set(ks))
    if starts is None:
        spread = sample_starts(data, "v", max(ks), seed)
        starts = {k: spread[:k] for k in ks}
    centres = {k: c / np.linalg.norm(c, axis=1, keepdims=True) for k, c in starts.items()}
    dims = next(iter(centres.values())).shape[1]

    def one_pass(width: dict[int, int], measure) -> dict[int, np.ndarray]:
        """Per k, ``width`` sums over all rows of what ``measure`` (rows -> k -> sums) gives."""
        offset = dict(zip(width, np.cumsum([0, *width.values()])))
        size = sum(width.values())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                x = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                for k, part in measure(x):
                    out[offset[k] : offset[k] + width[k]] += part
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out)], ["slot", "part"])

        parts = data.mapInArrow(run, "slot bigint, part double").groupBy("slot").agg(F.sum("part").alias("part")).toArrow()
        out = np.zeros(size)
        out[parts["slot"].to_numpy()] = parts["part"].to_numpy()
        return {k: out[offset[k] : offset[k] + width[k]] for k in width}

    def assign(x: np.ndarray, models: dict[int, np.ndarray]):
        """For every k of ``models``, the nearest centre and its cosine, out of one product."""
        near = x @ np.concatenate(list(models.values())).T
        for k, part in zip(models, np.split(near, np.cumsum([len(c) for c in models.values()])[:-1], axis=1)):
            yield k, part.argmax(axis=1), part.max(axis=1)

    def totals(models: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        def measure(x: np.ndarray):
            for k, which, cosine in assign(x, models):
                hot = np.eye(len(models[k]))[which]
                yield k, np.concatenate([[(1 - cosine).sum()], hot.sum(axis=0), (hot.T @ x).ravel()])

        flat = one_pass({k: 1 + len(c) * (1 + dims) for k, c in models.items()}, measure)
        return {k: (v[0], v[1 : 1 + len(models[k])], v[1 + len(models[k]) :].reshape(-1, dims)) for k, v in flat.items()}

    took, moving = dict.fromkeys(ks, 0), list(ks)
    for _ in range(rounds):
        if not moving:
            break
        for k, (_, n, sums) in totals({k: centres[k] for k in moving}).items():
            norm = np.linalg.norm(sums, axis=1)
            new = np.where(((n > 0) & (norm > 0))[:, None], sums / np.where(norm > 0, norm, 1)[:, None], centres[k])
            took[k] += 1
            if np.linalg.norm(new - centres[k], axis=1).max() <= tolerance:
                moving.remove(k)
            centres[k] = new
    final = totals(centres)

    def widths(x: np.ndarray):
        for k, which, _ in assign(x, centres):
            _, n, sums = final[k]
            mean = 1 - x @ np.where(n > 0, sums.T / np.maximum(n, 1), 0)
            mean[:, n == 0] = np.inf
            at = np.arange(len(x)), which
            own = mean[at] * n[which] / np.maximum(n[which] - 1, 1)
            mean[at] = np.inf
            other = mean.min(axis=1)
            most = np.maximum(own, other)
            fine = (n[which] > 1) & np.isfinite(other) & (most > 0)
            yield k, np.array([np.where(fine, (other - own) / np.where(fine, most, 1), 0).sum(), len(x)])

    judged = one_pass(dict.fromkeys(ks, 2), widths)
    shape = {k: float(total / n) for k, (total, n) in judged.items()}
    best = max(ks, key=lambda k: (shape[k], -k))
    return df.sparkSession.createDataFrame([(int(k), float(final[k][0]), shape[k], took[k], k == best) for k in ks], schema)


def _as_arrays(df: DataFrame, features: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return df.select(vector_to_array(features).alias("v"))


def diagonal_mixture(
    df: DataFrame, key: str, vector: str, means: np.ndarray, rounds: int = 200, tolerance: float = 1e-3, floor: float = 1e-6, trace: list[float] | None = None
) -> DataFrame:
    """(key, cluster, confidence, entropy) of a mixture of normal distributions with diagonal covariance.

    ``means`` (a row per component) is the start: rows count for the nearest one at first. Each round sums
    responsibilities, values and squares per component in the tasks; the driver holds the k x dims sums. Rounds end when the
    mean log-likelihood rises by less than ``tolerance``; ``trace`` collects it.
    """
    data = cut_lineage(df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")))
    k, dims = means.shape

    def weigh(x: np.ndarray, model: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        if model is None:
            near = ((x[:, None, :] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
            return np.eye(k)[near], np.zeros(len(x))
        share, mean, var = model
        with np.errstate(divide="ignore"):
            logs = np.log(share) - 0.5 * (np.log(2 * np.pi * var).sum(axis=1) + (x**2) @ (1 / var).T - 2 * x @ (mean / var).T + (mean**2 / var).sum(axis=1))
        most = logs.max(axis=1, keepdims=True)
        like = most[:, 0] + np.log(np.exp(logs - most).sum(axis=1))
        return np.exp(logs - like[:, None]), like

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)

    def sums(model: tuple | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(2 + k + 2 * k * dims)
            for batch in batches:
                x = matrix(batch)
                r, like = weigh(x, model)
                out += np.concatenate([[len(x), like.sum()], r.sum(axis=0), (r.T @ x).ravel(), (r.T @ x**2).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["slot", "part"])

        rows = data.mapInArrow(run, "slot bigint, part double").groupBy("slot").agg(F.sum("part").alias("part")).collect()
        out = np.zeros(2 + k + 2 * k * dims)
        out[[r["slot"] for r in rows]] = [r["part"] for r in rows]
        return out

    model, last = None, None
    for _ in range(rounds + 1):
        flat = sums(model)
        n, like = flat[0], flat[1] / max(flat[0], 1)
        if model is not None:
            if trace is not None:
                trace.append(like)
            if last is not None and like - last < tolerance:
                break
            last = like
        weight = flat[2 : 2 + k] + 10 * np.finfo(float).eps
        mean = flat[2 + k : 2 + k + k * dims].reshape(k, dims) / weight[:, None]
        var = np.maximum(flat[2 + k + k * dims :].reshape(k, dims) / weight[:, None] - mean**2, 0) + floor
        model = (weight / max(n, 1), mean, var)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, _ = weigh(matrix(batch), model)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, r.size + 1, k), pa.int32()), pa.array(r.ravel()))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(r.argmax(axis=1).astype(np.int32)), cells], ["key", "cluster", "m"])

    kind = dict(data.dtypes)["key"]
    out = data.mapInArrow(label, f"key {kind}, cluster int, m array<double>")
    return out.select(F.col("key").alias(key), "cluster", F.array_max("m").alias("confidence"), membership_entropy(F.col("m")).alias("entropy"))


def gaussian_mixture(df: DataFrame, key: str, features: str, k: int = 3, dims: int = 50, rounds: int = 200, seed: int = 42) -> DataFrame:
    """Soft clusters after a principal-component reduction: (key, cluster, confidence, entropy)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    reduced = cut_lineage(PCA(k=dims, inputCol=features, outputCol="_p").fit(df).transform(df).select(key, "_p"))
    start = np.array(KMeans(k=k, featuresCol="_p", seed=seed).fit(reduced).clusterCenters())
    return diagonal_mixture(reduced.select(key, vector_to_array("_p").alias("_a")), key, "_a", start, rounds)


def reduce_dimensions(df: DataFrame, key: str, features: str, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """(key, components) and the explained variance of each component."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    model = PCA(k=k, inputCol=features, outputCol="_p").fit(df)
    shares = [(i, float(x)) for i, x in enumerate(model.explainedVariance)]
    return (
        model.transform(df).select(key, vector_to_array("_p").alias("components")),
        df.sparkSession.createDataFrame(shares, "component int, explained double"),
    )


def characterise(groups: DataFrame, words: DataFrame, key: str, cluster: str, positive: Column, top: int = 8) -> DataFrame:
    """Rows, positives, percent and the most frequent terms of each cluster."""
    from contrasieve.operators.terms import frequencies

    sizes = groups.groupBy(cluster).agg(
        F.count("*").alias("n"), F.count_if(positive).alias("n_pos"), (100 * F.avg(positive.cast("int"))).alias("pct_pos")
    )
    best = frequencies(words.join(groups.select(key, cluster), key), [cluster], top)
    listed = best.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "term"))).alias("_l"))
    return sizes.join(listed, cluster).withColumn("terms", F.array_join(F.transform("_l", lambda x: x["term"]), " ")).drop("_l")


def item_rows(df: DataFrame, columns) -> DataFrame:
    """Array of ``column=value`` items per row, one per non-null column."""
    items = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns])
    return df.select(F.array_compact(items).alias("items"))


def pair_rules(df: DataFrame, columns, consequent: str, min_support: float = 0.01, top: int = 100) -> DataFrame:
    """Rules ``a -> consequent value`` with support, confidence and lift.

    Items of a row are its few columns, so the pairs of a row are as many as the columns.
    """
    n = df.agg(F.count("*")).scalar()
    right = F.concat(F.lit(f"{consequent}="), F.col(consequent).cast("string"))
    left = F.explode(F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns if c != consequent]))
    pairs = df.select(left.alias("a"), right.alias("b")).groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    n_a = pairs.groupBy("a").agg(F.sum("n_ab").alias("n_a"))
    n_b = df.groupBy(right.alias("b")).agg(F.count("*").alias("n_b"))
    out = pairs.join(n_a, "a").join(n_b, "b").withColumn("_n", n)
    out = out.select(
        "a", "b",
        (F.col("n_ab") / F.col("_n")).alias("support"),
        (F.col("n_ab") / F.col("n_a")).alias("confidence"),
        (F.col("n_ab") / F.col("n_a") / (F.col("n_b") / F.col("_n"))).alias("lift"),
    )
    return out.filter(F.col("support") >= min_support).orderBy(F.desc(F.round("lift", 9)), "a", "b").limit(top)


def frequent_rules(df: DataFrame, columns, min_support: float = 0.05, min_confidence: float = 0.3, top: int = 100) -> DataFrame:
    """Association rules over item sets of any size, by lift."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(item_rows(df, columns))
    flat = model.associationRules.select(
        F.array_join(F.array_sort("antecedent"), " & ").alias("antecedent"), F.get("consequent", F.lit(0)).alias("consequent"), "confidence", "lift", "support"
    )
    return flat.orderBy(F.desc("lift"), "antecedent", "consequent").limit(top)
