"""A key for every row of a table whose ids are null or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasieve.session import cut_lineage

KEY = "__key"


def own_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """``docs`` with a bigint KEY in a written table, or None if every row has an id of its own already.

    Keys are in the order of ids, null first; rows that share an id stand by a hash of their text, and rows
    that share both in any order. Rows of one id are dealt over partitions like all others.
    """
    spark = docs.sparkSession
    own = F.col(id_col).cast("bigint")
    if docs.groupBy(own.alias("id")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return None
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [own.asc_nulls_first(), F.xxhash64(F.col(text_col).cast("string")).asc(), F.col("__row").asc()]
    rows = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut_lineage(placed.drop("__row").withColumn(KEY, F.monotonically_increasing_id()))


def with_ids(judged: DataFrame, keyed: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """``judged`` with the ids of ``keyed`` in place of the keys in ``columns``."""
    shown = judged.columns
    for c in columns:
        ids = keyed.select(F.col(KEY).alias("__of"), F.col(id_col).cast("bigint").alias("__id"))
        judged = judged.join(ids, judged[c] == ids["__of"]).drop(c, "__of").withColumnRenamed("__id", c)
    return judged.select(shown)
