"""Outlier detectors: local density, isolation trees, novelty against the general class, ensembles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasieve.operators.neighbours import knn_graph
from contrasieve.operators.sampling import top_per_group
from contrasieve.operators.totals import exact_quantiles
from contrasieve.session import cut_lineage


def local_outlier_factor(df: DataFrame, key: str, vector: str, k: int = 20) -> DataFrame:
    """(key, lof) with cosine distance; 1 = as dense as the neighbours, higher = isolated."""
    edges = cut_lineage(knn_graph(df, key, vector, k).select("src", "dst", F.greatest(F.lit(0.0), 1 - F.col("sim")).alias("d")))
    k_dist = edges.groupBy(F.col("src").alias("dst")).agg(F.max("d").alias("kd"))
    reach = edges.join(k_dist, "dst").select("src", "dst", F.greatest("d", "kd").alias("r"))
    lrd = reach.groupBy("src").agg((F.count("*") / F.greatest(F.sum("r"), F.lit(1e-10))).alias("lrd"))
    lrd = cut_lineage(lrd)
    near = edges.select("src", "dst").join(lrd.select(F.col("src").alias("dst"), F.col("lrd").alias("_n")), "dst")
    means = near.groupBy("src").agg(F.avg("_n").alias("_n"))
    return means.join(lrd, "src").select(F.col("src").alias(key), (F.col("_n") / F.col("lrd")).alias("lof"))


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe))


def isolation_forest(df: DataFrame, key: str, vector: str, train: DataFrame, trees: int = 200, rows: int = 256, seed: int = 42) -> DataFrame:
    """(key, score) in (0, 1]; higher = easier to isolate.

    Each tree sees its own hashed sample of ``rows`` training rows and is grown in its own
    task; the forest is at most ``trees`` * 2 * ``rows`` nodes and is sent to the scoring tasks.
    """
    n = train.count()
    rate = min(1.0, 1.5 * rows / max(n, 1))
    spot = lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6)
    picked = train.select(key, vector, F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: spot(t) < rate)).alias("tree"))
    sample = top_per_group(
        picked.withColumn("_o", F.xxhash64(key, "tree", F.lit(seed))), ["tree"], [F.col("_o"), F.col(key)], rows, key, slices=1
    )

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = np.stack(pdf.sort_values("_o")[vector].to_numpy()).astype(float)
        limit = math.ceil(math.log2(max(2, len(x))))
        nodes, todo = [], [(0, np.arange(len(x)), 0)]
        nodes.append([-1, 0.0, -1, -1, 0.0])
        while todo:
            at, members, depth = todo.pop()
            part = x[members]
            spread = part.max(axis=0) - part.min(axis=0)
            usable = np.flatnonzero(spread > 0)
            if depth >= limit or len(members) <= 1 or not len(usable):
                nodes[at][4] = depth + float(_average_path(len(members)))
                continue
            dim = int(rng.choice(usable))
            cut = float(rng.uniform(part[:, dim].min(), part[:, dim].max()))
            left = part[:, dim] < cut
            nodes[at][:4] = [dim, cut, len(nodes), len(nodes) + 1]
            nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
            todo += [(len(nodes) - 2, members[left], depth + 1), (len(nodes) - 1, members[~left], depth + 1)]
        table = np.array(nodes)
        return pd.DataFrame({
            "tree": tree, "node": np.arange(len(table)), "dim": table[:, 0].astype(int), "cut": table[:, 1],
            "l": table[:, 2].astype(int), "r": table[:, 3].astype(int), "depth": table[:, 4],
        })

    grown = sample.groupBy("tree").applyInPandas(grow, "tree int, node int, dim int, cut double, l int, r int, depth double")
    forest = [g.sort_values("node") for _, g in grown.toPandas().groupby("tree")]  # bounded: trees * 2 * rows nodes
    shared = df.sparkSession.sparkContext.broadcast([tuple(f[c].to_numpy() for c in ("dim", "cut", "l", "r", "depth")) for f in forest])
    norm = float(_average_path(min(rows, n))) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch[vector].to_numpy()).astype(float)
            total = np.zeros(len(x))
            for dim, cut, left, right, depth in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    inner = dim[at] >= 0
                    if not inner.any():
                        break
                    go = x[np.arange(len(x)), np.maximum(dim[at], 0)] < cut[at]
                    at = np.where(inner, np.where(go, left[at], right[at]), at)
                total += depth[at]
            yield pd.DataFrame({key: batch[key], "score": 2.0 ** (-total / len(shared.value) / norm)})

    return df.select(key, vector).mapInPandas(score, f"`{key}` {dict(df.dtypes)[key]}, score double")


def novelty(df: DataFrame, key: str, vector: str, general: str, features: int = 128, gamma: float | None = None, share: float = 0.05, seed: int = 42) -> DataFrame:
    """(key, score, novel): closeness to the general class in random Fourier features.

    The class is summarised by the mean of its features, a vector of fixed size; rows below
    the ``share`` quantile of the class are novel.
    """
    dim = df.select(F.size(vector)).first()[0]
    rng = np.random.default_rng(seed)
    width = gamma if gamma is not None else 1.0
    w = rng.normal(scale=math.sqrt(2 * width), size=(dim, features))
    b = rng.uniform(0, 2 * math.pi, size=features)
    shared = df.sparkSession.sparkContext.broadcast((w, b))

    def project(x: np.ndarray) -> np.ndarray:
        return math.sqrt(2.0 / features) * np.cos(x @ shared.value[0] + shared.value[1])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(features), 0
        for batch in batches:
            if len(batch):
                total += project(np.stack(batch[vector].to_numpy()).astype(float)).sum(axis=0)
                n += len(batch)
        yield pd.DataFrame({"i": np.arange(features), "s": total, "n": n})

    parts = df.filter(general).select(vector).mapInPandas(sums, "i int, s double, n long")
    mean = parts.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("i").toPandas()["m"].to_numpy()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = project(np.stack(batch[vector].to_numpy()).astype(float))
                yield batch[[key, general]].assign(score=x @ mean)

    types = dict(df.dtypes)
    scored = cut_lineage(df.select(key, vector, general).mapInPandas(score, f"`{key}` {types[key]}, `{general}` {types[general]}, score double"))
    cut = exact_quantiles(scored.filter(general), [], "score", {"q": share}).scalar()
    return scored.select(key, "score", (F.col("score") < cut).alias("novel"))


def detector_ensemble(df: DataFrame, key: str, detectors: Sequence[str], top: int) -> DataFrame:
    """Mean and maximum of the detectors scaled to 0..1, and how many put a row in their top."""
    ranges = df.agg(F.struct(*[F.min(c).alias(f"lo_{c}") for c in detectors], *[F.max(c).alias(f"hi_{c}") for c in detectors])).scalar()
    scaled = df.withColumn("_r", ranges)
    for c in detectors:
        span = F.col("_r")[f"hi_{c}"] - F.col("_r")[f"lo_{c}"]
        scaled = scaled.withColumn(f"_{c}", F.when(span > 0, (F.col(c) - F.col("_r")[f"lo_{c}"]) / span).otherwise(0.0))
    votes = None
    for c in detectors:
        best = df.orderBy(F.desc(c), key).limit(top).select(key)
        votes = best if votes is None else votes.unionByName(best)
    votes = votes.groupBy(key).agg(F.count("*").alias("votes"))
    names = [F.col(f"_{c}") for c in detectors]
    out = scaled.select(key, (sum(names[1:], names[0]) / len(names)).alias("mean_score"), F.greatest(*names).alias("max_score"))
    out = out.join(votes, key, "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    return out.withColumn("consensus", F.col("votes") >= 2)
