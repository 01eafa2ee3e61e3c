"""Quality rules: plain limits, then robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics. Per group the minimum-covariance-determinant estimate is
found by concentration steps over all rows: distances from the present centre, the share ``CORE`` of rows that
are nearest, their mean and covariance as the next centre. A step is one aggregation by group and distance class
(classes are 1/16 octave wide and taken whole), so no group is gathered and none is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrasieve.llm._stats import COUNTS, with_counts
from contrasieve.session import cut_lineage

#: Share of a group's rows that the estimate rests on.
CORE = 0.6
#: A row is rejected if a normal one of its group would lie so far out with this probability.
TAIL = 1e-9
#: Groups with fewer rows are pooled by language, and then all together; fewer rows than that reject nothing.
LEAST = 60
#: (statistic, least standard deviation): a group whose rows all agree must not reject a small difference.
STATISTICS = {
    "log_words": ("ln(1 + n_words)", 0.5),
    "log_word_length": ("ln(1 + word_chars / greatest(n_words, 1))", 0.12),
    "root_symbols": ("sqrt(n_symbols / greatest(word_chars, 1))", 0.03),
    "log_dup_lines": ("ln(1 + n_dup_lines)", 0.25),
    "root_repeats": ("sqrt(n_repeat_words / greatest(n_words, 1))", 0.1),
}
P = len(STATISTICS)
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
FLOORS = np.array([floor for _, floor in STATISTICS.values()])


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


def base_failed():
    """Too few words, or over a fifth of them in five-word windows that occur twice."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _grouped(rows: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """Column g: the group of each row that passed the plain limits, null where even the pool is small."""
    own = F.to_json(F.array(F.col("__lang"), F.col("__source")))
    by_lang = F.to_json(F.array(F.col("__lang")))
    rows = rows.withColumns({"__lang": F.col(lang_col).cast("string"), "__source": F.col(source_col).cast("string")})
    rows = rows.withColumns({"__own": own, "__by": by_lang}).drop("__lang", "__source")
    sizes = rows.where("NOT base_failed").groupBy("__own", "__by").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < LEAST)
    langs = small.groupBy("__by").agg(F.sum("n").alias("n"))
    tiny = langs.where(F.col("n") < LEAST).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    g = F.when(F.col("n") >= LEAST, F.col("__own")).when(F.col("n_lang") >= LEAST, F.col("__by"))
    names = cut_lineage(sizes.join(langs.withColumnRenamed("n", "n_lang"), "__by", "left").select("__own", g.otherwise(F.when(tiny >= LEAST, F.lit("all"))).alias("g")))
    return rows.join(names, "__own", "left").drop("__own", "__by")


def _invert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of each group's core to its centre, inverse covariance and log determinant."""
    spread = CORE / chi2_cdf(chi2_quantile(CORE, P), P + 2) if CORE < 1 else 1.0
    for part in parts:
        out = []
        for row in part.itertuples(index=False):
            centre = np.array([getattr(row, f"s{i}") for i in range(P)]) / row.n
            cov = np.zeros((P, P))
            for i, j in PAIRS:
                cov[i, j] = cov[j, i] = getattr(row, f"q{i}_{j}") / row.n - centre[i] * centre[j]
            cov = cov * (spread if row.core else 1.0)
            lift = np.maximum(FLOORS**2 - np.diag(cov), 0)
            cov += np.diag(lift)
            inverse = np.linalg.inv(cov)
            out.append((row.g, centre.tolist(), [inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS], float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(out, columns=["g", "centre", "inverse", "logdet"])


_ESTIMATE = "g string, centre array<double>, inverse array<double>, logdet double"
_SUMS = [*(f"s{i}" for i in range(P)), *(f"q{i}_{j}" for i, j in PAIRS)]


def _sums() -> list:
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(X)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}_{j}") for i, j in PAIRS)]


def _distance():
    d = [F.col(x) - F.col("centre")[i] for i, x in enumerate(X)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + d[i] * d[j] * F.col("inverse")[k]
    return total


def _start(rows: DataFrame) -> DataFrame:
    """Centre: the median of each statistic; spread: half the middle half. The first distances ignore covariance."""
    middle = rows.groupBy("g").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in X))
    inverse = []
    for i, j in PAIRS:
        scale = F.greatest((F.col(X[i])[2] - F.col(X[i])[0]) / 1.349, F.lit(float(FLOORS[i])))
        inverse.append(1 / (scale * scale) if i == j else F.lit(0.0))
    return middle.select("g", F.array(*(F.col(x)[1] for x in X)).alias("centre"), F.array(*inverse).alias("inverse"), F.lit(float("inf")).alias("logdet"))


def concentrate(rows: DataFrame, steps: int = 12) -> DataFrame:
    """(g, centre, inverse, logdet): the estimate of each group of ``rows`` (g and the statistics X)."""
    estimate = cut_lineage(_start(rows))
    nearest = Window.partitionBy("g").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("g")
    for _ in range(steps):
        classes = rows.join(estimate, "g").withColumn("class", F.floor(16 * F.log2(_distance() + 1e-6)))
        sums = classes.groupBy("g", "class").agg(*_sums())
        sums = sums.withColumns({"before": F.coalesce(F.sum("n").over(nearest), F.lit(0)), "all": F.sum("n").over(whole)})
        core = sums.where(F.col("before") < CORE * F.col("all")).groupBy("g").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in _SUMS))
        last, estimate = estimate, cut_lineage(core.withColumn("core", F.lit(True)).mapInPandas(_invert, _ESTIMATE))
        moved = estimate.join(last.select("g", F.col("logdet").alias("was")), "g").agg(F.max(F.abs(F.col("was") - F.col("logdet"))))
        if (moved.first()[0] or 0) < 1e-3:
            break
    return estimate


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, the five counts, base_failed, distance (squared) and kept.

    Null or empty text has no words and fails. A null language or source is a value like any other. Rows that
    repeat an id are judged each by their own text. ``kept`` is false for rows that fail the plain limits and for
    rows whose squared distance from their group's estimate is over the chi-square quantile of 1 - ``TAIL``;
    rows of no group (see ``LEAST``) have a null distance and are kept if they pass the limits.
    """
    renamed = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__l"), F.col(source_col).cast("string").alias("__s"), F.col(text_col).alias("__t"))
    counted = with_counts(renamed, "__id", "__t", "__l", "__s").withColumn("base_failed", base_failed())
    counted = cut_lineage(counted.withColumns({x: F.expr(e) for x, (e, _) in zip(X, STATISTICS.values())}))
    rows = _grouped(counted, "__l", "__s")
    estimate = concentrate(cut_lineage(rows.where("NOT base_failed AND g IS NOT NULL").select("g", *X)))
    limit = chi2_quantile(1 - TAIL, P)
    far = rows.join(estimate, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= limit))
    return far.select(F.col("__id").alias(id_col), *COUNTS, "base_failed", "distance", kept.alias("kept"))
