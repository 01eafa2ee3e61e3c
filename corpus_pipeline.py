"""The corpus pipeline: stages over the documents table, each written as Parquet and read again by the next.

Decisions are joined back by ``doc_id``, so all stages but the last return the columns of documents. Where ids are
null or repeated, each row has a key of its own instead, and its fate depends on its own text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrasieve.llm import decontaminate, packing, quality_mcd, recompression, weighted_minhash
from contrasieve.llm._keys import KEY, own_keys
from contrasieve.llm._tokens import tokenizer_path
from contrasieve.session import shared_folder

#: Vocabulary of the last stage.
TOKENIZER = "byte_bpe_50k.json"


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the column that tells their rows apart: doc_id if it does, else a key in a written table."""
    keyed = own_keys(docs, "doc_id", "text")
    return (docs, "doc_id") if keyed is None else (keyed, KEY)


def _only(docs: DataFrame, keys: DataFrame, key: str, how: str, columns: list[str]) -> DataFrame:
    """Rows of ``docs`` with (left_semi) or without (left_anti) a row of ``keys``."""
    keys = keys.select(F.col(key).alias("__of")).distinct()
    return docs.join(keys, F.col(key).eqNullSafe(F.col("__of")), how).select(columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows, key = _keyed(docs)
    return _only(rows, quality_mcd.judge(rows, key).where("kept"), key, "left_semi", docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies."""
    rows, key = _keyed(docs)
    classes = weighted_minhash.near_copies(rows, key)
    return _only(rows, classes.where(F.col(key).eqNullSafe(F.col("class_id"))), key, "left_semi", docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents before them have; n_chars follows the text."""
    rows, key = _keyed(docs)
    kept = recompression.drop_repeats(rows, key).where("n_removed > 0").select(F.col(key).alias("__of"), F.col("kept").alias("__kept"))
    joined = rows.join(kept, F.col(key).eqNullSafe(F.col("__of")), "left")
    cut = F.col("__kept").isNotNull()
    new = {
        "text": F.coalesce("__kept", "text"),
        "n_chars": F.when(cut, F.length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")),
    }
    return joined.withColumns(new).select(docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows, key = _keyed(docs)
    found = decontaminate.find(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key)
    return _only(rows, found, key, "left_anti", docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into token sequences."""
    return packing.pack_documents(docs, tokenizer_path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near copies", near_copies),
    ("repeated passages", substrings),
    ("decontamination", clean_of_benchmark),
    ("packing", sequences),
]

#: The stages fit robust estimates, sample shingles, tokenize and pack; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        folder = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
