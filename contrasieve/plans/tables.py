"""Queries on sources, sinks and table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contrasieve.plans.registry import query, table
from contrasieve.plans.standin import FACT, R, fact, r
from contrasieve.session import shared_folder
from contrasieve.sources import delimited, tables


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"


def day(col):
    return F.date_format(col, "yyyy-MM-dd")


@query("s1_read_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def s1(spark, d):
    return tables.read_columns(spark, f"{d}/orders.parquet", ["o_orderkey", "o_orderstatus", "not_there"])


S2_SQL = """WITH u AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, NULL AS l_tax, 0 AS src FROM lineitem WHERE l_returnflag <> 'N'
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, NULL, l_tax, 1 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax FROM u
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY src, l_partkey, l_suppkey) = 1"""


@query("s2_merge_tables", S2_SQL)
def s2(spark, d):
    li = table(spark, d, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    first = li.filter("l_returnflag <> 'N'").select(*key, "l_extendedprice")
    second = li.select(*key, "l_tax")
    return tables.merge_tables([first, second], key[:2], key[2:])


@query(
    "s3_file_summary",
    """WITH c AS (SELECT role, count(*) AS n FROM conversations GROUP BY 1)
    SELECT 'conversations.parquet' AS file, (SELECT count(*) FROM conversations) AS n_rows, 4 AS n_filled_columns,
      (SELECT string_agg(role, ',' ORDER BY n DESC, role) FROM c) AS top_role
    UNION ALL SELECT 'documents.parquet', (SELECT count(*) FROM documents), 5, NULL""",
)
def s3(spark, d):
    paths = [f"{d}/documents.parquet", f"{d}/conversations.parquet"]
    return tables.file_summary(spark.read.option("mergeSchema", "true").parquet(*paths), "role")


@query("s4_flatten_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '' AS note FROM events")
def s4(spark, d):
    rec = table(spark, d, "events").select(
        "event_id", F.from_json("props", "k INT, note STRING").alias("props")
    )
    return tables.flatten_record(rec)


@query(
    "s5_partitioned_write",
    f"WITH {FACT} SELECT status AS uf, month AS ano_mes, count(*) AS n, {R('sum(value)', 2)} AS value FROM fact GROUP BY 1, 2",
)
def s5(spark, d):
    path = scratch(spark)
    tables.write_partitions(fact(spark, d).select("id", "value", "status", "date"), path, "date", "status")
    back = spark.read.option("partitionColumnTypeInference.enabled", "false").parquet(path)
    return back.groupBy("uf", F.col("ano_mes").cast("string").alias("ano_mes")).agg(
        F.count("*").alias("n"), r(F.sum("value"), 2).alias("value")
    )


@query("s6_review_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, o_totalprice FROM orders")
def s6(spark, d):
    path = scratch(spark)
    cols = ["o_orderkey", "o_orderpriority", "o_totalprice"]
    delimited.write_csv(table(spark, d, "orders").select(*cols), path, brazilian=True)
    return delimited.read_review_csv(spark, path, ["o_totalprice"])


@query("s7_csv_sink", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_acctbal FROM customer")
def s7(spark, d):
    path = scratch(spark)
    delimited.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return delimited.read_review_csv(spark, path, ["c_acctbal"])


@query("s8_first_present", "SELECT s_suppkey AS id, s_name AS supplier FROM supplier")
def s8(spark, d):
    s = table(spark, d, "supplier")
    name = tables.first_present(s, ["nome_fornecedor", "S_NAME", "s_suppkey"])
    return s.select(tables.first_present(s, ["id", "s_suppkey"]).alias("id"), name.alias("supplier"))


OLD = "o_orderdate < TIMESTAMP '1999-01-01'"
NEW = "o_orderdate >= TIMESTAMP '1998-01-01'"


def batches(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    old = o.filter(F.expr("o_orderdate < TIMESTAMP_NTZ '1999-01-01'")).drop("o_orderdate")
    new = o.filter(F.expr("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'")).drop("o_orderdate")
    return old, new.withColumn("o_orderstatus", F.lit("X"))


@query(
    "s9_accumulate",
    f"""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {OLD} AND NOT ({NEW})
    UNION ALL SELECT o_orderkey, 'X', o_totalprice FROM orders WHERE {NEW}""",
)
def s9(spark, d):
    old, new = batches(spark, d)
    return tables.accumulate(old, new, ["o_orderkey"])


@query(
    "s10_insert_absent",
    f"""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {OLD}
    UNION ALL SELECT o_orderkey, 'X', o_totalprice FROM orders WHERE {NEW} AND NOT ({OLD})""",
)
def s10(spark, d):
    old, new = batches(spark, d)
    return tables.insert_absent(old, new, ["o_orderkey"])


@query(
    "s11_upsert",
    f"""SELECT o_orderkey, CASE WHEN {NEW} THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders""",
)
def s11(spark, d):
    old, new = batches(spark, d)
    return tables.upsert(old, new, ["o_orderkey"], ["o_orderstatus"])


@query(
    "s12_keep_reviewed",
    """SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'ok' END, '') AS review
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def s12(spark, d):
    prev = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise(" ").alias("review"))
    sample = table(spark, d, "documents").select("doc_id", F.lit("").alias("review"))
    return tables.keep_reviewed(prev, sample, ["doc_id"], "review")


@query(
    "s13_duplicate_audit",
    """WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT 'total' AS kind, NULL AS l_orderkey, NULL AS l_linenumber, CAST(sum(n) AS BIGINT) AS rows_, count(*) AS distinct_keys,
           CAST(sum(n) - count(*) AS BIGINT) AS duplicates FROM c
    UNION ALL (SELECT 'key', l_orderkey, l_linenumber, n, NULL, NULL FROM c WHERE n > 1 ORDER BY n DESC, l_orderkey, l_linenumber LIMIT 5)""",
)
def s13(spark, d):
    totals, worst = tables.duplicate_audit(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    head = totals.select(F.lit("total").alias("kind"), F.col("total").alias("rows_"), "distinct_keys", "duplicates")
    tail = worst.select(F.lit("key").alias("kind"), "l_orderkey", "l_linenumber", F.col("copies").alias("rows_"))
    return head.unionByName(tail, allowMissingColumns=True)


@query(
    "s14_coverage",
    f"""WITH {FACT}, cal AS (SELECT strftime(unnest(generate_series(TIMESTAMP '1994-10-01', TIMESTAMP '2002-03-01', INTERVAL 1 MONTH)), '%Y-%m') AS month),
    h AS (SELECT month, count(*) AS n FROM fact WHERE label = 'geral' GROUP BY 1)
    SELECT cal.month, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'ausente' WHEN n < 235 THEN 'parcial' ELSE 'completo' END AS status
    FROM cal LEFT JOIN h ON cal.month = h.month""",
)
def s14(spark, d):
    return tables.coverage(fact(spark, d).filter("label = 'geral'"), "month", "1994-10-01", "2002-03-01", 235)


@query(
    "s15_fingerprint",
    """SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(sha256(concat(coalesce(length(o_orderkey::VARCHAR) || ':' || o_orderkey, '-'), coalesce(length(o_orderstatus) || ':' || o_orderstatus, '-'), coalesce('10:' || strftime(o_orderdate, '%Y-%m-%d'), '-'))), 1, 15) AS BIGINT)::HUGEINT) AS VARCHAR) AS fingerprint FROM orders""",
)
def s15(spark, d):
    cols = [F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), day("o_orderdate")]
    return tables.fingerprint(table(spark, d, "orders"), cols)


@query(
    "s16_export_cap",
    f"WITH {FACT} SELECT id, value FROM fact WHERE label = 'geral' ORDER BY value DESC, id LIMIT 2000",
)
def s16(spark, d):
    rows = fact(spark, d).filter("label = 'geral'").select("id", "value")
    return tables.top_rows(rows, [F.desc("value"), F.asc("id")], 2000)
