"""How the supplied tables play the roles of contracts, agencies, suppliers and texts.

Each view has a Spark form and an SQL form (a CTE body) with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrasieve.plans.registry import table


def r(col: Column, n: int = 6) -> Column:
    """Presentation rounding, without a negative zero."""
    return F.round(col.cast("double"), n) + F.lit(0.0)


def R(expr: str, n: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {n}) + 0.0)"


def fact(spark: SparkSession, d: str) -> DataFrame:
    """Contracts: one row per line item."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_orderkey").alias("purchase"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.when(F.col("l_returnflag") == "R", "engenharia")
        .when(F.col("l_returnflag") == "A", "obras")
        .otherwise("geral")
        .alias("label"),
        F.col("l_linestatus").alias("status"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_shipdate").alias("date"),
        F.year("l_shipdate").alias("year"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
    )


FACT = """fact AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS purchase,
         l_partkey AS part, l_suppkey AS supplier,
         CASE l_returnflag WHEN 'R' THEN 'engenharia' WHEN 'A' THEN 'obras' ELSE 'geral' END AS label,
         l_linestatus AS status, l_quantity AS qty, l_extendedprice AS value, l_discount AS discount,
         l_tax AS tax, l_shipdate AS date, CAST(year(l_shipdate) AS INTEGER) AS year,
         strftime(l_shipdate, '%Y-%m') AS month
  FROM lineitem)"""


def fact_agency(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("purchase"),
        F.col("o_custkey").alias("agency"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("order_date"),
    )
    return fact(spark, d).join(orders, "purchase")


FACT_AGENCY = FACT + """, facta AS (
  SELECT f.*, o_custkey AS agency, o_orderpriority AS priority, o_orderdate AS order_date
  FROM fact f JOIN orders ON purchase = o_orderkey)"""


def places(spark: SparkSession, d: str) -> DataFrame:
    """Agencies with municipality, state, sphere and name."""
    return (
        table(spark, d, "customer")
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("agency"),
            F.col("n_name").alias("municipality"),
            F.col("r_name").alias("state"),
            F.col("c_mktsegment").alias("sphere"),
            F.col("c_name").alias("agency_name"),
        )
    )


def fact_geo(spark: SparkSession, d: str) -> DataFrame:
    return fact_agency(spark, d).join(places(spark, d), "agency")


FACT_GEO = FACT_AGENCY + """, factg AS (
  SELECT f.*, n_name AS municipality, r_name AS state, c_mktsegment AS sphere, c_name AS agency_name
  FROM facta f JOIN customer ON agency = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a label: judged good = positive, judged bad = works, not judged = unlabelled."""
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return (
        table(spark, d, "documents")
        .join(labels, "doc_id", "left")
        .select(
            "doc_id",
            "text",
            "lang",
            "source",
            "n_chars",
            F.when(F.col("quality") == 1, "engenharia")
            .when(F.col("quality") == 0, "obras")
            .otherwise("geral")
            .alias("label"),
        )
    )


TEXTS = """texts AS (
  SELECT d.doc_id, text, lang, source, n_chars,
         CASE quality WHEN 1 THEN 'engenharia' WHEN 0 THEN 'obras' ELSE 'geral' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def score(key: Column, seed: str = "s") -> Column:
    """Deterministic score in [0, 1) from a key, equal in both engines."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), key.cast("string"))), 1, 8), 16, 10).cast(
        "double"
    ) / F.lit(4294967296.0)


def SCORE(key: str, seed: str = "s") -> str:
    return f"(CAST(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


# Pattern families and phrases that occur in the supplied prose, in place of the legal ones.
CORPUS_FAMILIES = {
    "DEFINITE": [r"\bthe\b", r"\bder\b", r"\bles\b"],
    "LINK": [r"\bthat\s+(?:the|it|is)\b", r"\bund\s+[a-z]", r"\bque\s+la\b"],
    "PREP": [r"\bof\s+the\b", r"\bvon\s+der\b", r"\bde\s+la\b"],
    "RARE": [r"\bwhat\b", r"\bnoch\b", r"\bmas\b"],
}
CORPUS_OBVIOUS = [r"\bthe\s+of\b", r"\bto\s+(?:the|and)\b", r"\bder\s+und\b", r"\bla\s+que\b", r"\bthe\s+(?:is|was)\b"]
CORPUS_PREFIXES = (r"^\s*the\s+(of\s+)?", r"^\s*and\s+", r"^\s*(die|der|das)\s+", r"^\s*l[ae]\s+(\w+\s+)?")
CORPUS_KEYWORDS = ["the", "that", "with", "der", "und", "que", "les", "from", "this", "which"]
CORPUS_TERMS = ["tion", "that", "ing the", "und", "des", "erth", "with the", "heit", "ment"]
