"""From documents to contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roll_up(df: DataFrame, key: str, text: str, kind: str, seq: str, families: Sequence[str], separator: str = "\n", prefix: str = "mk_", with_text: bool = True) -> DataFrame:
    """One row per contract: documents, characters, marker sums, families present, types, text.

    The joined text is one value per contract, so it only fits contracts with few documents;
    ``with_text=False`` leaves it out, and everything else is summed on the map side.
    """
    marks = [F.sum(f"{prefix}{f}").alias(f"{prefix}{f}") for f in families]
    out = df.groupBy(key).agg(
        F.count("*").alias("n_docs"),
        F.sum(F.length(text)).alias("n_chars"),
        *marks,
        F.array_join(F.array_sort(F.collect_set(kind)), " | ").alias("types"),
        *([F.array_sort(F.collect_list(F.struct(seq, text))).alias("_parts")] if with_text else []),
    )
    present = [(F.col(f"{prefix}{f}") > 0).cast("int") for f in families]
    out = out.withColumn("mk_score", sum(present[1:], present[0]))
    if not with_text:
        return out
    return out.withColumn("text", F.array_join(F.transform("_parts", lambda p: p[text]), separator)).drop("_parts")
