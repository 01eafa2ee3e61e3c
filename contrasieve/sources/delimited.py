"""CSV in the two dialects reviewers use: plain, and ``;`` with decimal comma."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_review_csv(spark: SparkSession, path: str, numbers: Sequence[str] = ()) -> DataFrame:
    """All columns as text except ``numbers``; separator and decimal mark follow the header.

    A ``;`` file has decimal commas and thousands points, a ``,`` file plain numbers. What is no number is null; signs
    stay, as rules on them belong to the amount parser.
    """
    head = spark.read.text(path).first()
    header = head[0] if head else ""
    sep = ";" if header.count(";") > header.count(",") else ","
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, multiLine=False, escape='"')
    df = df.toDF(*[c.lstrip("﻿").strip().strip('"') for c in df.columns])
    for name in numbers:
        plain = F.trim(F.col(name))
        if sep == ";":
            plain = F.translate(plain, ",.", ".")
        df = df.withColumn(name, plain.try_cast("double"))
    return df


def write_csv(df: DataFrame, path: str, brazilian: bool = False) -> None:
    """Comma CSV, or ``;`` with decimal comma when ``brazilian``."""
    if brazilian:
        for name, kind in df.dtypes:
            if kind in ("double", "float"):
                df = df.withColumn(name, F.translate(F.col(name).cast("string"), ".", ","))
    df.write.mode("errorifexists").csv(path, sep=";" if brazilian else ",", header=True, escape='"')
