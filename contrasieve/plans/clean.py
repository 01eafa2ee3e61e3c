"""Queries on projections, filters and bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrasieve.config import vocab
from contrasieve.functions import clean as cl
from contrasieve.operators import profile, sampling
from contrasieve.plans.registry import query, table
from contrasieve.plans.standin import FACT, FACT_GEO, R, fact, fact_geo, r

# The part size (1..50) stands for the category code and priority for the modality.
def category():
    return F.col("p_size") % 12



@query(
    "f1_labels",
    """WITH p AS (SELECT p_partkey, p_size % 12 AS c FROM part)
    SELECT p_partkey, CASE c WHEN 7 THEN 'obras' WHEN 8 THEN 'geral' ELSE 'engenharia' END AS label,
      CASE c WHEN 8 THEN 'geral' ELSE 'engenharia' END AS label2,
      CASE c WHEN 7 THEN 'obra' WHEN 8 THEN 'serv_geral' ELSE 'serv_engenharia' END AS subclass
    FROM p WHERE c IN (7, 8, 9)""",
)
def f1(spark, d):
    p = table(spark, d, "part").select("p_partkey", category().alias("c")).filter(F.col("c").isin(*vocab.CATEGORIES_IN_SCOPE))
    label = cl.label_from_category(F.col("c"))
    return p.select(
        "p_partkey",
        label.alias("label"),
        cl.collapse_label(label).alias("label2"),
        cl.lookup(F.col("c"), vocab.SUBCLASS_BY_CATEGORY).alias("subclass"),
    )


def _case(col, names):
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE CAST({col} AS VARCHAR) END"


@query(
    "f2_code_names",
    f"SELECT p_partkey, {_case('p_size', vocab.CATEGORY_NAMES)} AS category, {_case('p_size', vocab.MODALITY_NAMES)} AS modality, "
    f"{_case('p_size', vocab.CRITERION_NAMES)} AS criterion FROM part",
)
def f2(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey",
        cl.code_name(size, vocab.CATEGORY_NAMES).alias("category"),
        cl.code_name(size, vocab.MODALITY_NAMES).alias("modality"),
        cl.code_name(size, vocab.CRITERION_NAMES).alias("criterion"),
    )


@query(
    "f3_compose_text",
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ' | ' || p_type ELSE p_name END AS text FROM part",
)
def f3(spark, d):
    extra = F.when(F.col("p_size") > 25, F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", cl.compose_text(F.col("p_name"), extra).alias("text"))


@query(
    "f4_dates",
    """SELECT event_id, CAST(CASE WHEN event_type <> 'error' THEN year(ts) END AS INTEGER) AS year,
       CAST(CASE WHEN event_type <> 'error' THEN month(ts) END AS INTEGER) AS month,
       CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m') END AS period FROM events""",
)
def f4(spark, d):
    raw = F.when(F.col("event_type") == "error", "31/02/24?").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    e = table(spark, d, "events").select("event_id", cl.parse_date(raw).alias("t"))
    return e.select("event_id", F.year("t").alias("year"), F.month("t").alias("month"), cl.period(F.col("t")).alias("period"))


@query(
    "f5_numbers",
    "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE c_custkey::DOUBLE END AS value FROM customer",
)
def f5(spark, d):
    glob = F.when(F.col("c_nationkey") == 3, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    first = F.when(F.col("c_nationkey") == 3, F.col("c_acctbal")).otherwise(F.col("c_custkey")).cast("string")
    c = table(spark, d, "customer")
    value = F.coalesce(cl.parse_number(glob), cl.parse_number(first), F.col("c_custkey").cast("double"))
    return c.select("c_custkey", value.alias("value"))


@query("f6_min_length", "SELECT doc_id, n_chars FROM documents WHERE length(trim(text)) >= 200")
def f6(spark, d):
    return table(spark, d, "documents").filter(F.length(F.trim("text")) >= 200).select("doc_id", "n_chars")


@query(
    "f7_state_years",
    f"WITH {FACT_GEO} SELECT id, state, year FROM factg WHERE upper(state) IN ('ASIA', 'EUROPE') AND year BETWEEN 1997 AND 1999",
)
def f7(spark, d):
    return (
        fact_geo(spark, d)
        .filter(F.upper("state").isin("ASIA", "EUROPE") & F.col("year").between(1997, 1999))
        .select("id", "state", "year")
    )


@query(
    "f8_duration",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN date_diff('day', o_orderdate, l_shipdate) >= 0
       THEN date_diff('day', o_orderdate, l_shipdate) END AS INTEGER) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def f8(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = cl.days_between(F.col("o_orderdate"), F.col("l_shipdate"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", days.alias("days"))


@query(
    "f9_collapse_labels",
    f"WITH {FACT} SELECT CASE WHEN label = 'geral' THEN 'geral' ELSE 'engenharia' END AS label2, count(*) AS n FROM fact GROUP BY 1",
)
def f9(spark, d):
    return fact(spark, d).groupBy(cl.collapse_label(F.col("label")).alias("label2")).agg(F.count("*").alias("n"))


@query(
    "f10_three_classes",
    """WITH p AS (SELECT p_partkey, p_size % 3 + 7 AS c, regexp_extract_all(strip_accents(lower(p_name)), '[a-z0-9]+') AS n FROM part)
    SELECT p_partkey, CASE WHEN c = 8 THEN 'geral' WHEN c = 7 THEN 'eng_especial'
      WHEN list_has_any(n, ['ring', 'small']) THEN 'eng_especial' ELSE 'eng_comum' END AS label3 FROM p""",
)
def f10(spark, d):
    label3 = cl.three_class_label(F.col("p_size") % 3 + 7, F.col("p_name"), ["ring", "small"])
    return table(spark, d, "part").select("p_partkey", label3.alias("label3"))


@query(
    "f11_missing_profile",
    f"""WITH j AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT 'quality' AS column_name, {R("100.0 * avg((quality IS NULL)::INT)")} AS pct_missing FROM j
    UNION ALL SELECT 'toxic', {R("100.0 * avg((toxic IS NULL)::INT)")} FROM j""",
)
def f11(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return profile.missing_profile(j).withColumn("pct_missing", r(F.col("pct_missing")))


@query(
    "f12_control_key",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN lpad(CAST(o_custkey AS VARCHAR), 14, '0') END AS cnpj,
       CASE WHEN o_orderstatus <> 'P' THEN 2 END AS kind, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey AS INTEGER) END AS seq,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders""",
)
def f12(spark, d):
    good = F.concat(
        F.lpad(F.col("o_custkey").cast("string"), 14, "0"), F.lit("-2-"),
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit("/"), F.year("o_orderdate").cast("string"),
    )
    key = F.when(F.col("o_orderstatus") == "P", F.concat(good, F.lit("x"))).otherwise(good)
    return table(spark, d, "orders").select("o_orderkey", cl.control_key_parts(key).alias("k")).select("o_orderkey", "k.*")


@query("f13_digits", "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 14, '0') AS cnpj FROM supplier")
def f13(spark, d):
    noisy = F.concat_ws(".", F.lit("#"), F.col("s_suppkey").cast("string"), F.lit("/-"))
    return table(spark, d, "supplier").select("s_suppkey", cl.digits(noisy, 14).alias("cnpj"))


@query("f14_log_value", f"SELECT c_custkey, {R('ln(1 + greatest(coalesce(c_acctbal, 0), 0))')} AS log_value FROM customer")
def f14(spark, d):
    return table(spark, d, "customer").select("c_custkey", r(cl.log_value(F.col("c_acctbal"))).alias("log_value"))


@query(
    "f15_bands",
    f"""WITH {FACT}, b AS (SELECT CASE WHEN value < 0 THEN NULL WHEN value <= 10000 THEN '≤10k' WHEN value <= 50000 THEN '10-50k'
      WHEN value <= 100000 THEN '50-100k' WHEN value <= 500000 THEN '100-500k' ELSE '500k-1M' END AS money,
      CASE linenumber WHEN 0 THEN 'sem_sinal' WHEN 1 THEN 'fraco_1' WHEN 2 THEN 'moderado_2' ELSE 'forte_3+' END AS confidence
      FROM (SELECT *, CAST(split_part(id, '-', 2) AS INTEGER) AS linenumber FROM fact))
    SELECT money, confidence, count(*) AS n FROM b GROUP BY 1, 2""",
)
def f15(spark, d):
    signals = F.split("id", "-")[1].cast("int")
    return (
        fact(spark, d)
        .groupBy(cl.money_band(F.col("value")).alias("money"), cl.confidence_band(signals).alias("confidence"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "f16_quartile_bands",
    f"""WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS b, quantile_cont(l_quantity, 0.75) AS c FROM lineitem)
    SELECT CASE WHEN l_quantity <= a THEN 'q1' WHEN l_quantity <= b THEN 'q2' WHEN l_quantity <= c THEN 'q3' ELSE 'q4' END AS band,
      count(*) AS n, {R("sum(l_quantity)", 2)} AS qty FROM lineitem, q GROUP BY 1""",
)
def f16(spark, d):
    li = profile.quartile_bands(table(spark, d, "lineitem"), "l_quantity", "band")
    return li.groupBy("band").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("qty"))


# Document types: line number stands for the document sequence, part size for the type id.
F17_SQL = f"""WITH p(t, pr) AS (VALUES (4,0),(6,1),(7,2),(8,3),(5,4),(2,5),(3,6),(12,7),(14,8)),
  d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_size % 18 AS t FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, d.t AS type_id FROM d JOIN p ON d.t = p.t
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY pr, l_linenumber, l_partkey, l_suppkey) <= 3"""


@query("f17_document_priority", F17_SQL)
def f17(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    raw = F.col("p_size") % 18
    named = cl.lookup(raw, vocab.DOCUMENT_TYPE_NAMES)
    docs = j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        cl.document_type(F.when(F.col("p_size") > 25, raw), F.upper(named)).alias("type_id"),
    )
    return profile.best_documents(docs, ["l_orderkey"], "type_id", ["l_linenumber", "l_partkey", "l_suppkey"])


@query(
    "f18_amendments",
    f"SELECT p_partkey, p_size % 18 = 14 OR (p_size % 18 = 17 AND p_type = 'PROMO') AS amendment FROM part",
)
def f18(spark, d):
    t = F.col("p_size") % 18
    name = F.when((t == 17) & (F.col("p_type") == "PROMO"), "2º Termo de Aditamento").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", cl.is_amendment(t, name).alias("amendment"))


@query(
    "f19_scope",
    f"""WITH {FACT_GEO}, rest AS (SELECT id, state, false AS detect FROM factg WHERE state <> 'ASIA' ORDER BY md5('42|' || id), id LIMIT 5000)
    SELECT id, state, true AS detect FROM factg WHERE state = 'ASIA' UNION ALL SELECT * FROM rest""",
)
def f19(spark, d):
    return sampling.train_scope(fact_geo(spark, d).select("id", "state"), F.col("state") == "ASIA", "id", 5000, seed=42)
