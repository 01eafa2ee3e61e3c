"""Deterministic samples: rows are ordered by a hash of seed and key, never by a random generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(key: str | Column, seed: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order (top-n, no full sort)."""
    return df.withColumn("_h", hash_order(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def hash_rank(df: DataFrame, groups: Sequence[str], key: str, seed: int = 42, name: str = "_rank") -> DataFrame:
    """Position of every row in the hash order of its group, from 0.

    A group may hold most of the table, so ranks are built from hash ranges: the first three
    digits of the hash split each group into 4096 even slices, ranked apart and shifted by
    the sizes of the slices before.
    """
    groups = list(groups)
    hashed = df.withColumn("_h", hash_order(key, seed)).withColumn("_slice", F.substring("_h", 1, 3))
    inner = W.partitionBy(*groups, "_slice").orderBy("_h", key)
    sizes = hashed.groupBy(*groups, "_slice").agg(F.count("*").alias("_n"))
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    before = whole.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        *groups, "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_size"),
    )
    ranked = hashed.withColumn("_in", F.row_number().over(inner)).join(shifts, [*groups, "_slice"])
    return ranked.withColumn(name, F.col("_before") + F.col("_in") - 1).drop("_h", "_slice", "_in", "_before")


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, salt: str, slices: int = 64) -> DataFrame:
    """First ``k`` rows per group: best ``k`` of each salted slice, then of the group.

    Spark already drops rows beyond ``k`` on the map side of a ranked window; the slices
    spread what is left of a hot group, and the second step sees at most slices * k rows.
    """
    groups = list(groups)
    first = W.partitionBy(*groups, "_salt").orderBy(*order)
    second = W.partitionBy(*groups).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(slices)))
        .withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= k)
        .withColumn("_r", F.row_number().over(second))
        .filter(F.col("_r") <= k)
        .drop("_salt", "_r")
    )


def split_holdout(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the first share of every label in hash order."""
    ranked = hash_rank(df, [label], key, seed)
    quota = F.round(F.col("_size") * test_share).cast("long")
    return ranked.withColumn("is_test", F.col("_rank") < quota).drop("_rank", "_size")


def split_by_period(df: DataFrame, label: str, key: str, is_late: Column, min_rows: int = 10, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: late rows, or the hashed hold-out when either side is too small."""
    sizes = df.agg(F.count_if(is_late).alias("late"), F.count_if(~is_late).alias("early")).first()
    if min(sizes.late, sizes.early) < min_rows:
        return split_holdout(df, label, key, seed=seed)
    return df.withColumn("is_test", is_late)


def apportion(sizes: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, quota): ``n`` seats shared in proportion to ``_size`` by largest remainder.

    ``sizes`` has one row per stratum. Equal remainders go to the stratum that comes first.
    """
    total = sizes.agg(F.sum("_size")).scalar()
    shared = sizes.withColumn("_t", total).select(
        stratum, "_size", F.expr(f"cast({int(n)} as bigint) * _size div _t").alias("_whole"), F.expr(f"cast({int(n)} as bigint) * _size % _t").alias("_rest")
    )
    left = shared.agg(F.lit(int(n)) - F.sum("_whole")).scalar()
    placed = shared.withColumn("_left", left).withColumn("_at", F.row_number().over(W.orderBy(F.desc("_rest"), stratum)))
    quota = F.least("_size", F.col("_whole") + (F.col("_at") <= F.col("_left")).cast("long"))
    return placed.select(stratum, quota.alias("quota"))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if there are fewer), every stratum in proportion to its size."""
    quotas = apportion(df.groupBy(stratum).agg(F.count("*").alias("_size")), stratum, n)
    ranked = hash_rank(df, [stratum], key, seed)
    same = ranked[stratum].eqNullSafe(quotas[stratum])
    return ranked.join(F.broadcast(quotas), same).filter(F.col("_rank") < F.col("quota")).drop(quotas[stratum]).drop("_rank", "_size", "quota")


def even_sample(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """The same number of rows of every label, ``n`` in all if each label has enough."""
    kinds = df.agg(F.countDistinct(label)).scalar()
    return quota_sample(df, [label], key, F.floor(F.lit(n) / kinds), seed)


def quota_sample(df: DataFrame, groups: Sequence[str], key: str, quota: Column, seed: int = 42) -> DataFrame:
    """First ``quota`` rows per group in hash order; the quota may use ``_size``."""
    return hash_rank(df, groups, key, seed).filter(F.col("_rank") < quota).drop("_rank", "_size")


def fold_ids(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``: labels spread evenly over ``k`` folds."""
    ranked = hash_rank(df, [label], key, seed)
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_size")


def group_folds(df: DataFrame, label: str, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``; the rows of a group are all in one fold, and labels are spread evenly.

    A group counts for its most frequent label (the first of several). The groups of a label are dealt from large
    to small, forth and back over the folds, equal sizes in hash order. Places in that order are
    counted in cells of one size and hash slice, so no task ranks all groups of a label.
    """
    per = df.groupBy(group, label).agg(F.count("*").alias("_n")).groupBy(group).agg(
        F.sum("_n").alias("_size"), F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("l")))["l"].alias("_label")
    )
    hashed = per.withColumn("_h", hash_order(group, seed)).withColumn("_slice", F.substring("_h", 1, 3))
    cell = ["_label", "_size", "_slice"]
    before = W.partitionBy("_label").orderBy(F.desc("_size"), "_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = hashed.groupBy(*cell).agg(F.count("*").alias("_c")).select(*cell, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*cell).orderBy("_h", group)).alias("_in")
    ranked = hashed.select(group, *cell, "_h", inside)
    place = ranked.join(shifts, [ranked[c].eqNullSafe(shifts[c]) for c in cell]).select(ranked[group], (F.col("_before") + F.col("_in") - 1).alias("_place"))
    turn = F.col("_place") % (2 * k)
    folds = place.select(F.col(group).alias("_group"), F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))
    return df.join(folds, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def train_scope(df: DataFrame, target: Column, key: str, n_rest: int, seed: int = 42) -> DataFrame:
    """All target rows (``detect`` true) plus a sample of the rest."""
    rest = sample_rows(df.filter(~target), key, n_rest, seed)
    return df.filter(target).withColumn("detect", F.lit(True)).unionByName(rest.withColumn("detect", F.lit(False)))
