"""Column and distribution profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasieve.config import vocab
from contrasieve.functions import clean as cl
from contrasieve.operators.sampling import top_per_group
from contrasieve.operators.totals import average_ranks, exact_quantiles


def missing_profile(df: DataFrame) -> DataFrame:
    """Share of nulls per column in percent, columns without nulls left out; one pass."""
    shares = df.agg(*[(100 * F.avg(F.col(c).isNull().cast("int"))).alias(c) for c in df.columns])
    long = shares.unpivot([], df.columns, "column_name", "pct_missing")
    return long.filter("pct_missing > 0")


def quartile_bands(df: DataFrame, value: str, name: str) -> DataFrame:
    """``q1``..``q4`` by quartile; equal edges merge, so ties always share a band."""
    cuts = exact_quantiles(df, [], value, {"a": 0.25, "b": 0.5, "c": 0.75})
    edges = df.withColumn("_q", cuts.select(F.struct("a", "b", "c")).scalar())
    v, q = F.col(value), F.col("_q")
    band = F.when(v <= q["a"], "q1").when(v <= q["b"], "q2").when(v <= q["c"], "q3").when(v.isNotNull(), "q4")
    return edges.withColumn(name, band).drop("_q")


def best_documents(df: DataFrame, keys: Sequence[str], type_id: str, order: Sequence[str], k: int = 3) -> DataFrame:
    """Documents of relevant types, the ``k`` of highest priority per contract."""
    rank = cl.lookup(F.col(type_id), {t: i for i, t in enumerate(vocab.DOCUMENT_TYPE_PRIORITY)})
    ranked = df.withColumn("_p", rank).filter(F.col("_p").isNotNull())
    return top_per_group(ranked, keys, [F.col("_p"), *[F.col(c) for c in order]], k, order[0]).drop("_p")


def value_profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, sd, min, max, CV %, bias-adjusted skew and excess kurtosis, and quantiles."""
    if not keys:
        return value_profile(df.withColumn("_all", F.lit(1)), ["_all"], value).drop("_all")
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    centred = df.join(mean, list(keys)).withColumn("_d", F.col(value) - F.col("_m"))
    powers = centred.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(F.col("_d") * F.col("_d")).alias("m2"),
        F.avg(F.pow("_d", F.lit(3.0))).alias("m3"),
        F.avg(F.pow("_d", F.lit(4.0))).alias("m4"),
    )
    n = F.col("n").cast("double")
    skew = F.when((n > 2) & (F.col("m2") > 0), F.sqrt(n * (n - 1)) / (n - 2) * F.col("m3") / F.pow("m2", F.lit(1.5)))
    kurt = F.when(
        (n > 3) & (F.col("m2") > 0),
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("m4") / (F.col("m2") * F.col("m2")) - 3 * (n - 1)),
    )
    q = exact_quantiles(df, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95})
    return (
        powers.withColumn("cv_pct", F.when(F.col("mean") != 0, 100 * F.col("sd") / F.col("mean")))
        .withColumn("skew", skew)
        .withColumn("kurtosis", kurt)
        .drop("m2", "m3", "m4")
        .join(q, list(keys))
    )


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins over [low, high); the last bin is closed."""
    width = (high - low) / bins
    index = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    inside = df.filter((value >= low) & (value <= high))
    return inside.groupBy(index.alias("bin")).agg(F.count("*").alias("n"))


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair of columns, nulls dropped pair by pair."""
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            pair = df.select(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).dropna()
            ranked = average_ranks(average_ranks(pair, [], "_a", "_ra"), [], "_b", "_rb")
            row = ranked.agg(F.corr("_ra", "_rb").alias("rho")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "rho")
            out = row if out is None else out.unionByName(row)
    return out


def composition(df: DataFrame, period: str, label: str) -> DataFrame:
    """Count and row percent of every label in every period."""
    counts = df.groupBy(period, label).agg(F.count("*").alias("n"))
    totals = counts.groupBy(period).agg(F.sum("n").alias("_t"))
    return counts.join(totals, period).withColumn("pct", 100 * F.col("n") / F.col("_t")).drop("_t")


def crosstab(df: DataFrame, row: str, col: str, names: Sequence[str], total: str = "Total") -> DataFrame:
    """Counts of ``col`` values by ``row`` with both margins."""
    cube = df.cube(row, col).agg(F.count("*").alias("n"), F.grouping(row).alias("_gr"), F.grouping(col).alias("_gc"))
    tagged = cube.select(
        F.when(F.col("_gr") == 1, total).otherwise(F.col(row).cast("string")).alias(row),
        F.when(F.col("_gc") == 1, total).otherwise(F.col(col).cast("string")).alias("_c"),
        "n",
    )
    return tagged.groupBy(row).pivot("_c", [*names, total]).agg(F.sum("n")).fillna(0)


def flag_counts(keys: Sequence[str], df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Rows per key and rows for which each flag holds."""
    sums = [F.sum(F.coalesce(c.cast("int"), F.lit(0))).alias(n) for n, c in flags.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
