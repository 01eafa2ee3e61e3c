"""Monthly series per key: calendar fill, decomposition, breaks, forecasts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def monthly_counts(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows per key and month; months without rows between first and last show 0."""
    month = F.trunc(F.col(ts).cast("date"), "month")
    have = df.filter(F.col(ts).isNotNull()).groupBy(*keys, month.alias("_d")).agg(F.count("*").alias("n"))
    span = have.groupBy(*keys).agg(F.min("_d").alias("_a"), F.max("_d").alias("_b"))
    calendar = span.select(*keys, F.explode(F.expr("sequence(_a, _b, INTERVAL 1 MONTH)")).alias("_d"))
    out = calendar.join(have, [*keys, "_d"], "left")
    return out.select(*keys, F.date_format("_d", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def centred_average(df: DataFrame, keys: Sequence[str], order: str, value: str, period: int = 12) -> DataFrame:
    """Adds ``trend``: centred moving average with half weights at both ends, null near the ends."""
    w = W.partitionBy(*keys).orderBy(order)
    half = period // 2
    inner = F.sum(value).over(w.rowsBetween(1 - half, half - 1))
    ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
    return df.withColumn("trend", (inner + 0.5 * ends) / period)


def decompose(df: DataFrame, keys: Sequence[str], month: str, value: str, period: int = 12) -> DataFrame:
    """Additive trend, seasonal and residual parts of series with two full periods.

    Trend ends are extended by the straight line through the nearest ``period`` trend points.
    Series are a few hundred months, so windows per key stay small.
    """
    whole = W.partitionBy(*keys)
    base = df.withColumn("_n", F.count("*").over(whole)).filter(F.col("_n") >= 2 * period)
    base = centred_average(base, keys, month, value, period)
    base = base.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(month)))
    half = period // 2
    lo, hi = half + 1, F.col("_n") - half
    inside = F.col("trend").isNotNull()

    def line(where) -> tuple:
        x = F.when(inside & where, F.col("_i").cast("double"))
        y = F.when(inside & where, F.col("trend"))
        return F.regr_slope(y, x).over(whole), F.regr_intercept(y, x).over(whole)

    s1, c1 = line(F.col("_i") < lo + period)
    s2, c2 = line(F.col("_i") > hi - period)
    filled = base.withColumn("_s1", s1).withColumn("_c1", c1).withColumn("_s2", s2).withColumn("_c2", c2)
    filled = filled.withColumn("_raw", F.col("trend")).withColumn(
        "trend",
        F.when(F.col("_i") < lo, F.col("_c1") + F.col("_s1") * F.col("_i"))
        .when(F.col("_i") > hi, F.col("_c2") + F.col("_s2") * F.col("_i"))
        .otherwise(F.col("trend")),
    )
    filled = filled.withColumn("_season", F.pmod(F.col("_i") - 1, F.lit(period)))
    detrended = F.when(F.col("_raw").isNotNull(), F.col(value) - F.col("_raw"))
    means = filled.withColumn("_m", F.avg(detrended).over(W.partitionBy(*keys, "_season")))
    first = means.filter(F.col("_i") <= period).groupBy(*keys).agg(F.avg("_m").alias("_grand"))
    out = means.join(first, list(keys)).withColumn("seasonal", F.col("_m") - F.col("_grand"))
    return out.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).select(
        *keys, month, value, "trend", "seasonal", "residual"
    )


def mean_shift(df: DataFrame, keys: Sequence[str], month: str, value: str) -> DataFrame:
    """Single break per series: the month after which the cumulative deviation is largest."""
    whole = W.partitionBy(*keys)
    run = W.partitionBy(*keys).orderBy(month).rowsBetween(W.unboundedPreceding, 0)
    dev = df.withColumn("_mean", F.avg(value).over(whole)).withColumn("_sd", F.stddev_samp(value).over(whole))
    cusum = dev.withColumn("cusum", F.sum(F.col(value) - F.col("_mean")).over(run))
    best = cusum.groupBy(*keys).agg(
        F.min(F.struct((-F.round(F.abs("cusum"), 6)).alias("a"), F.col(month).alias("m"), F.col("cusum"))).alias("b"),
        F.max("_sd").alias("_sd"), F.count("*").alias("n"),
    )
    stat = F.abs("b.cusum") / (F.col("_sd") * F.sqrt("n"))
    return best.select(*keys, F.col("b.m").alias("break_after"), stat.alias("strength"))


def change_points(df: DataFrame, keys: Sequence[str], month: str, value: str, penalty: float = 10.0) -> DataFrame:
    """Breaks of each series by penalised least-squares segmentation of the scaled values.

    A series is one row per month, so a group is bounded by the calendar, not by the data.
    """

    def segment(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(month).reset_index(drop=True)
        y = pdf[value].to_numpy(dtype=float)
        y = (y - y.mean()) / (y.std() or 1.0)
        n = len(y)
        s, q = np.concatenate([[0], y.cumsum()]), np.concatenate([[0], (y * y).cumsum()])
        cost, back = np.zeros(n + 1), np.zeros(n + 1, dtype=int)
        cost[0] = -penalty
        for end in range(1, n + 1):
            start = np.arange(end)
            seg = q[end] - q[start] - (s[end] - s[start]) ** 2 / (end - start)
            total = cost[start] + seg + penalty
            back[end] = int(total.argmin())
            cost[end] = total[back[end]]
        breaks, end = [], n
        while back[end] > 0:
            end = back[end]
            breaks.append(end)
        keep = pdf.loc[sorted(breaks), [*keys, month]] if breaks else pdf.iloc[:0][[*keys, month]]
        return keep.rename(columns={month: "break_at"})

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", break_at {types[month]}"
    return df.select(*keys, month, value).groupBy(*keys).applyInPandas(segment, schema)


def forecast(df: DataFrame, keys: Sequence[str], month: str, value: str, horizon: int = 12, z: float = 1.96) -> DataFrame:
    """Seasonal-naive forecast plus drift, with an interval from the spread of yearly changes."""
    w = W.partitionBy(*keys).orderBy(month)
    whole = W.partitionBy(*keys)
    base = df.withColumn("_change", F.col(value) - F.lag(value, 12).over(w))
    base = base.withColumn("_drift", F.avg("_change").over(whole)).withColumn("_sd", F.stddev_samp("_change").over(whole))
    last = base.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(month)))).filter(F.col("_r") <= horizon)
    mid = F.col(value) + F.col("_drift")
    ahead = F.date_format(F.add_months(F.to_date(F.concat(F.col(month), F.lit("-01"))), 12), "yyyy-MM")
    return last.select(
        *keys,
        ahead.alias("month"),
        mid.alias("forecast"),
        (mid - z * F.col("_sd")).alias("low"),
        (mid + z * F.col("_sd")).alias("high"),
    )
