"""Agency-supplier aggregates, suspect lists and their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasieve.config import vocab
from contrasieve.operators.totals import exact_quantiles
from contrasieve.sources.tables import keep_first
from contrasieve.session import cut_lineage


def keep_best(df: DataFrame, keys: Sequence[str], score: str, key: str) -> DataFrame:
    """One row per key, the highest score; ties go to the smaller id."""
    return keep_first(df, keys, [-F.col(score), F.col(key)])


def ranked(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Descending by the columns, nulls last, ties by key."""
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in columns], F.col(key))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).limit(offset + limit).orderBy(*order).offset(offset)


def intersect_suspects(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows found by both detectors with the columns of both."""
    return a.join(b, key)


def outlier_flags(
    df: DataFrame, keys: Sequence[str], value: str, z_limit: float = 3.0, iqr_factor: float = 1.5
) -> DataFrame:
    """z score inside the group, |z| >= limit, and value above Q3 + factor * IQR."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    q = exact_quantiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75})
    # One row per group, written so that the planner knows how few they are: dealing the rows by group would fill one task per label.
    out = df.join(cut_lineage(stats.join(q, list(keys))), list(keys))
    z = (F.col(value) - F.col("_m")) / F.greatest(F.col("_s"), F.lit(1e-9))
    return (
        out.withColumn("z", z)
        .withColumn("z_flag", F.abs("z") >= z_limit)
        .withColumn("iqr_flag", F.col(value) > F.col("_q3") + iqr_factor * (F.col("_q3") - F.col("_q1")))
        .drop("_m", "_s", "_q1", "_q3")
    )


def pair_aggregate(
    df: DataFrame, agency: str, supplier: str, label: str, value: str, name_hint: Column, min_contracts: int = 2
) -> DataFrame:
    """Edges of the agency-supplier graph with counts, value, general rate and a red flag."""
    pos = F.col(label).isin(*vocab.POSITIVE_LABELS)
    general = F.col(label) == vocab.UNLABELLED
    out = df.filter(F.col(supplier).isNotNull()).groupBy(agency, supplier).agg(
        F.count("*").alias("n"),
        F.count_if(pos).alias("n_eng"),
        F.count_if(general).alias("n_geral"),
        F.sum(value).alias("total_value"),
        F.max(name_hint).alias("name_hint"),
    )
    return (
        out.filter(F.col("n") >= min_contracts)
        .withColumn("geral_rate", F.col("n_geral") / F.col("n"))
        .withColumn("red_flag", F.col("name_hint") & (F.col("n_geral") > 0))
    )


def ghost_suppliers(
    df: DataFrame, supplier: str, agency: str, label: str, value: str, name_hint: Column, min_general: int = 3
) -> DataFrame:
    """Suppliers whose name hints at engineering but who hold general contracts."""
    general = F.col(label) == vocab.UNLABELLED
    out = df.groupBy(supplier).agg(
        F.count("*").alias("n_total"),
        F.count_if(general).alias("n_geral"),
        F.sum(F.when(general, F.col(value)).otherwise(0.0)).alias("value_geral"),
        F.sum(F.when(~general, F.col(value)).otherwise(0.0)).alias("value_eng"),
        F.countDistinct(agency).alias("n_agencies"),
        F.max(name_hint).alias("_hint"),
    )
    kept = out.filter(F.col("_hint") & (F.col("n_geral") >= min_general)).drop("_hint")
    return kept.withColumn("pct_geral", 100 * F.col("n_geral") / F.col("n_total"))


def flag_concentration(df: DataFrame, keys: Sequence[str], flag: Column, min_rows: int = 5) -> DataFrame:
    """Rows, flagged rows and percent flagged per key, small keys left out."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n_total"), F.count_if(flag).alias("n_flag"))
    return out.filter(F.col("n_total") >= min_rows).withColumn("pct_flag", 100 * F.col("n_flag") / F.col("n_total"))
