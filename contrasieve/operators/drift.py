"""Changes of class shares over time and over the largest agencies or places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrasieve.operators.profile import composition


def year_jumps(df: DataFrame, year: str, label: str, positive: Column, limit_pp: float = 0.5) -> DataFrame:
    """Year-to-year changes of a class share of at least ``limit_pp`` points.

    ``cut_year`` is the first year whose positive share is under half the mean share.
    """
    shares = composition(df, year, label)
    before = F.lag("pct").over(W.partitionBy(label).orderBy(year))
    jumps = shares.withColumn("pct_before", before).withColumn("change", F.col("pct") - F.col("pct_before"))
    yearly = shares.filter(positive).groupBy(year).agg(F.sum("pct").alias("_p"))
    low = yearly.filter(F.col("_p") < 0.5 * yearly.agg(F.avg("_p")).scalar()).agg(F.min(year)).scalar()
    return jumps.filter(F.abs("change") >= limit_pp).withColumn("cut_year", low)


def top_levels(df: DataFrame, level: str, label: str, labels: Sequence[str], n: int) -> DataFrame:
    """The ``n`` most frequent levels with their total and one count per label; one shuffle."""
    counts = [F.count_if(F.col(label) == x).alias(x) for x in labels]
    return df.groupBy(level).agg(F.count("*").alias("n"), *counts).orderBy(F.desc("n"), level).limit(n)
