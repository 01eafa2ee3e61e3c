"""Ordered totals and exact quantiles that never sort a group inside one task.

Rows are first reduced to distinct (key, value) pairs, so a value shared by a third of the
table is one row. The pairs are written once, so the base table is scanned once. They are cut
into value ranges at sketched boundaries; running sums are taken inside a range and shifted by
the sums of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrasieve.session import cut_lineage

MIN_RANGES, MAX_RANGES = 64, 4096


def _range_count(df: DataFrame) -> int:
    """Ranges follow the shuffle width the cluster was given, within fixed limits."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_RANGES, min(MAX_RANGES, 4 * width))


def running_totals(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column], descending: bool = False
) -> DataFrame:
    """One row per distinct (keys, value): each sum, its running total ``cum_*`` and ``all_*``."""
    keys = list(keys)
    pairs = cut_lineage(df.groupBy(*keys, value).agg(*[c.alias(n) for n, c in sums.items()])).filter(F.col(value).isNotNull())
    n = _range_count(df)
    cuts = [i / n for i in range(1, n)]
    bounds = pairs.agg(F.percentile_approx(F.col(value).cast("double"), cuts, 10_000)).first()[0] or []  # n numbers
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    ranged = pairs.withColumn("_as_double", F.col(value).cast("double"))
    if len(splits) > 2:
        ranged = Bucketizer(splits=splits, inputCol="_as_double", outputCol="_bucket").transform(ranged)
        ranged = ranged.withColumn("_range", F.coalesce(F.col("_bucket").cast("int"), F.lit(0))).drop("_as_double", "_bucket")
    else:
        ranged = ranged.withColumn("_range", F.lit(0)).drop("_as_double")
    order = F.col(value).desc() if descending else F.col(value).asc()
    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    inside = W.partitionBy(*keys, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    per_range = ranged.groupBy(*keys, "_range").agg(*[F.sum(n).alias(n) for n in sums])
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = group.orderBy(range_order).rowsBetween(W.unboundedPreceding, -1)
    shifts = per_range.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.sum(n).over(group).alias(f"all_{n}") for n in sums],
    )
    out = ranged.select("*", *[F.sum(n).over(inside).alias(f"_in_{n}") for n in sums]).join(shifts, [*keys, "_range"])
    return out.select(
        *keys,
        value,
        *sums,
        *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(f"cum_{n}") for n in sums],
        *[f"all_{n}" for n in sums],
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key, one column per entry of ``probs``."""
    totals = running_totals(df, keys, value, {"n": F.count(F.lit(1))})
    columns = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("all_n") - 1)
        low, high = F.floor(pos), F.ceil(pos)

        def at(index: Column) -> Column:
            return F.max(F.when((F.col("cum_n") - F.col("n") <= index) & (index < F.col("cum_n")), F.col(value)))

        share = F.max(pos - low)
        columns.append((at(low) + (at(high) - at(low)) * share).alias(name))
    return totals.groupBy(*keys).agg(*columns) if keys else totals.agg(*columns)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "avg_rank", pct: bool = False) -> DataFrame:
    """Rank of ``value`` with ties averaged, on every row; ``pct`` divides by the group size."""
    totals = running_totals(df, keys, value, {"n": F.count(F.lit(1))})
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
    ranks = totals.select(*keys, value, (rank / F.col("all_n") if pct else rank).alias(name))
    return df.join(ranks, [*keys, value], "left")
