"""Queries on aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrasieve.functions import text as tx
from contrasieve.operators import joins, pairs, profile, rules, sampling, totals
from contrasieve.plans.joins import EVIDENCE, SCORED, reference_codes, registry, scored
from contrasieve.plans.registry import query, table
from contrasieve.plans.standin import (
    CORPUS_TERMS, FACT, FACT_AGENCY, FACT_GEO, R, SCORE, TEXTS, fact, fact_agency, fact_geo, places, r, score, texts,
)
from contrasieve.plans.text import CLEAN_SQL, FOLD_SQL, MARKERS_SQL, TOKENS_SQL, _term_sum, markers
from contrasieve.session import cut_lineage

def is_pos():
    return F.col("label").isin("engenharia", "obras")

def is_geral():
    return F.col("label") == "geral"

NAME_HINT = [r"7$", r"3$"]


@query(
    "a1_label_balance",
    f"""WITH {FACT}, c AS (SELECT label, count(*) AS n FROM fact GROUP BY 1), m AS (SELECT max(n) / min(n)::DOUBLE AS ratio, sum(n) AS t FROM c)
    SELECT label, n, {R('100.0 * n / t')} AS pct, {R('ratio')} AS imbalance,
      CASE WHEN ratio > 10 THEN 'severo' WHEN ratio > 3 THEN 'desbalanceado' ELSE 'ok' END AS status FROM c, m""",
)
def a1(spark, d):
    c = fact(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    ratio = c.agg(F.max("n") / F.min("n")).scalar()
    total = c.agg(F.sum("n")).scalar()
    status = F.when(ratio > 10, "severo").when(ratio > 3, "desbalanceado").otherwise("ok")
    return c.select("label", "n", r(100 * F.col("n") / total).alias("pct"), r(ratio).alias("imbalance"), status.alias("status"))


@query(
    "a2_crosstab",
    f"""WITH {FACT}, x AS (SELECT coalesce(label, 'Total') AS label, coalesce(status, 'Total') AS s, count(*) AS n FROM fact GROUP BY CUBE(label, status))
    SELECT label, CAST(sum(n) FILTER (WHERE s = 'F') AS BIGINT) AS "F", CAST(sum(n) FILTER (WHERE s = 'O') AS BIGINT) AS "O",
      CAST(sum(n) FILTER (WHERE s = 'Total') AS BIGINT) AS "Total" FROM x GROUP BY 1""",
)
def a2(spark, d):
    return profile.crosstab(fact(spark, d), "label", "status", ["F", "O"])


A3_SQL = f"""WITH {FACT}, m AS (SELECT label, avg(value) AS mean FROM fact GROUP BY 1),
  p AS (SELECT f.label, count(*)::DOUBLE AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx,
    avg((value - mean) ** 2) AS m2, avg((value - mean) ** 3) AS m3, avg((value - mean) ** 4) AS m4,
    quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95
    FROM fact f JOIN m ON f.label = m.label GROUP BY 1)
  SELECT label, CAST(n AS BIGINT) AS n, {R('mean', 4)} AS mean, {R('sd', 4)} AS sd, {R('mn', 2)} AS min, {R('mx', 2)} AS max, {R('100 * sd / mean', 4)} AS cv_pct,
    {R('sqrt(n * (n - 1)) / (n - 2) * m3 / m2 ** 1.5', 5)} AS skew,
    {R('(n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / (m2 * m2) - 3 * (n - 1))', 5)} AS kurtosis,
    {R('p25', 4)} AS p25, {R('p50', 4)} AS p50, {R('p75', 4)} AS p75, {R('p90', 4)} AS p90, {R('p95', 4)} AS p95 FROM p"""


@query("a3_value_profile", A3_SQL)
def a3(spark, d):
    out = profile.value_profile(fact(spark, d), ["label"], "value")
    digits = {"min": 2, "max": 2, "skew": 5, "kurtosis": 5}
    return out.select("label", "n", *[r(F.col(c), digits.get(c, 4)).alias(c) for c in out.columns if c not in ("label", "n")])


@query(
    "a4_large_general",
    f"WITH {FACT} SELECT id, value FROM fact WHERE label = 'geral' AND value >= (SELECT quantile_cont(value, 0.75) FROM fact WHERE label = 'engenharia')",
)
def a4(spark, d):
    f = fact(spark, d)
    cut = totals.exact_quantiles(f.filter("label = 'engenharia'"), [], "value", {"p75": 0.75}).scalar()
    return f.filter(is_geral() & (F.col("value") >= cut)).select("id", "value")


A5_SQL = f"""WITH {FACT}, c AS (SELECT month, label, count(*) AS n FROM fact GROUP BY 1, 2)
  SELECT month, label, n, {R('100.0 * n / sum(n) OVER (PARTITION BY month)')} AS pct FROM c"""


@query("a5_period_composition", A5_SQL)
def a5(spark, d):
    return profile.composition(fact(spark, d), "month", "label").withColumn("pct", r(F.col("pct")))


@query(
    "a6_drift_alerts",
    f"""WITH {FACT}, c AS (SELECT month, avg((label = 'geral')::INT) AS share, count(*) AS n FROM fact GROUP BY 1)
    SELECT month, n, {R('100 * share')} AS pct_geral, share > 0.36 AS severe FROM c WHERE share > 0.35""",
)
def a6(spark, d):
    c = fact(spark, d).groupBy("month").agg(F.avg(is_geral().cast("int")).alias("share"), F.count("*").alias("n"))
    return c.filter("share > 0.35").select("month", "n", r(100 * F.col("share")).alias("pct_geral"), (F.col("share") > 0.36).alias("severe"))


A7_SQL = f"""WITH {FACT}, c AS (SELECT year, label, count(*) AS n FROM fact GROUP BY 1, 2), p AS (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY year) AS pct FROM c),
  j AS (SELECT label, year, pct, lag(pct) OVER (PARTITION BY label ORDER BY year) AS prev FROM p),
  e AS (SELECT year, sum(pct) AS pe FROM p WHERE label <> 'geral' GROUP BY 1)
  SELECT label, year, {R('prev')} AS pct_before, {R('pct')} AS pct, {R('pct - prev')} AS change,
    (SELECT min(year) FROM e WHERE pe < 0.5 * (SELECT avg(pe) FROM e)) AS cut_year FROM j WHERE abs(pct - prev) >= 0.5"""


@query("a7_year_jumps", A7_SQL)
def a7(spark, d):
    from contrasieve.operators import drift

    out = drift.year_jumps(fact(spark, d), "year", "label", is_pos(), 0.5)
    return out.select("label", "year", *[r(F.col(c)).alias(c) for c in ("pct_before", "pct", "change")], "cut_year")


A8_SQL = f"""WITH {FACT_GEO}, t AS (SELECT agency, count(*) AS n FROM factg GROUP BY 1 ORDER BY n DESC, agency LIMIT 15)
  SELECT agency, left(agency_name, 45) AS name, count(*) AS n, count(*) FILTER (WHERE label = 'engenharia') AS engenharia,
    count(*) FILTER (WHERE label = 'obras') AS obras, count(*) FILTER (WHERE label = 'geral') AS geral FROM factg WHERE agency IN (SELECT agency FROM t) GROUP BY 1, 2"""


@query("a8_top_agencies", A8_SQL)
def a8(spark, d):
    from contrasieve.operators import drift

    g = fact_geo(spark, d)
    out = drift.top_levels(g, "agency", "label", ["engenharia", "obras", "geral"], 15)
    names = g.groupBy("agency").agg(F.substring(F.min("agency_name"), 1, 45).alias("name"))
    return out.join(names, "agency")


@query(
    "a9_level_by_label",
    f"""WITH {FACT_AGENCY}, c AS (SELECT priority, label, count(*) AS n FROM facta GROUP BY 1, 2), t AS (SELECT priority, sum(n) AS t FROM c GROUP BY 1 ORDER BY t DESC, priority LIMIT 8)
    SELECT priority, label, n, {R('100.0 * n / t')} AS pct FROM c JOIN t USING (priority)""",
)
def a9(spark, d):
    c = profile.composition(fact_agency(spark, d), "priority", "label")
    top = c.groupBy("priority").agg(F.sum("n").alias("_t")).orderBy(F.desc("_t"), "priority").limit(8)
    return c.join(top.select("priority"), "priority", "left_semi").withColumn("pct", r(F.col("pct")))


A10_SQL = f"""WITH {TEXTS}, t AS (SELECT label, {TOKENS_SQL} AS k, length(text) AS chars FROM texts), s AS (SELECT label, chars, len(k) AS words,
    len(list_distinct(k)) / greatest(len(k), 1)::DOUBLE AS ttr FROM t),
  q AS (SELECT label, count(*) AS n, avg(chars) AS c, avg(words) AS w, avg(ttr) AS t, quantile_cont(words, 0.5) AS med FROM s GROUP BY 1),
  h AS (SELECT least(floor(chars / 50.0), 39) AS bin, count(*) AS n FROM s WHERE chars <= 2000 GROUP BY 1)
  SELECT label, CAST(NULL AS INTEGER) AS bin, n, {R('c')} AS mean_chars, {R('w')} AS mean_words, {R('t')} AS mean_ttr, {R('med')} AS median_words FROM q
  UNION ALL SELECT 'hist', CAST(bin AS INTEGER), n, NULL, NULL, NULL, NULL FROM h"""


@query("a10_text_length", A10_SQL)
def a10(spark, d):
    from contrasieve.session import cut_lineage

    t = texts(spark, d).select("label", tx.tokens(F.col("text")).alias("k"), F.length("text").alias("chars"))
    s = cut_lineage(t.select("label", "chars", F.size("k").alias("words"), tx.type_token_ratio(F.col("k")).alias("ttr")))
    means = s.groupBy("label").agg(
        F.count("*").alias("n"), r(F.avg("chars")).alias("mean_chars"), r(F.avg("words")).alias("mean_words"), r(F.avg("ttr")).alias("mean_ttr")
    )
    med = totals.exact_quantiles(s, ["label"], "words", {"m": 0.5}).select("label", r(F.col("m")).alias("median_words"))
    hist = profile.histogram(s, F.col("chars"), 0, 2000, 40).withColumn("label", F.lit("hist"))
    return means.join(med, "label").unionByName(hist, allowMissingColumns=True)


@query(
    "a11_trimmed_values",
    f"WITH {FACT} SELECT label, count(*) AS n, {R('sum(value)', 2)} AS total FROM fact WHERE value <= (SELECT quantile_cont(value, 0.95) FROM fact) GROUP BY 1",
)
def a11(spark, d):
    f = fact(spark, d)
    cut = totals.exact_quantiles(f, [], "value", {"p": 0.95}).scalar()
    return f.filter(F.col("value") <= cut).groupBy("label").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))


def _rank_sql(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(
    "a12_spearman",
    f"""WITH x AS (SELECT {_rank_sql('l_quantity')} AS q, {_rank_sql('l_extendedprice')} AS p, {_rank_sql('l_discount')} AS c FROM lineitem)
    SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, {R('corr(q, p)')} AS rho FROM x UNION ALL SELECT 'l_quantity', 'l_discount', {R('corr(q, c)')} FROM x
    UNION ALL SELECT 'l_extendedprice', 'l_discount', {R('corr(p, c)')} FROM x""",
)
def a12(spark, d):
    out = profile.spearman(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("rho", r(F.col("rho")))


@query(
    "a13_term_hits",
    f"""WITH {TEXTS}, t AS (SELECT {CLEAN_SQL} AS c FROM texts WHERE label = 'geral') SELECT CAST(least({_term_sum('c')}, 10) AS INTEGER) AS hits, count(*) AS n FROM t GROUP BY 1""",
)
def a13(spark, d):
    c = texts(spark, d).filter(is_geral()).select(tx.clean(F.col("text")).alias("c"))
    hits = F.least(tx.domain_term_count(F.col("c"), CORPUS_TERMS), F.lit(10))
    return c.groupBy(hits.alias("hits")).agg(F.count("*").alias("n"))


def fact_names(spark, d):
    """Contracts with agency and supplier name."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_name").alias("supplier_name"))
    return fact_agency(spark, d).join(s, "supplier")


FACT_NAMES = FACT_AGENCY + ", factn AS (SELECT f.*, s_name AS supplier_name, regexp_matches(lower(s_name), '7$|3$') AS hint FROM facta f JOIN supplier ON supplier = s_suppkey)"


def name_hint():
    return tx.has_any(tx.fold(F.col("supplier_name")), NAME_HINT)


A14_BODY = """pairs AS (SELECT agency, supplier, count(*) AS n, count(*) FILTER (WHERE label <> 'geral') AS n_eng, count(*) FILTER (WHERE label = 'geral') AS n_geral,
  sum(value) AS total_value, bool_or(hint) AS name_hint FROM factn GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query(
    "a14_pair_aggregate",
    f"""WITH {FACT_NAMES}, {A14_BODY} SELECT agency, supplier, n, n_eng, n_geral, {R('total_value', 2)} AS total_value, name_hint,
    {R('n_geral / n::DOUBLE')} AS geral_rate, name_hint AND n_geral > 0 AS red_flag FROM pairs""",
)
def a14(spark, d):
    out = pairs.pair_aggregate(fact_names(spark, d), "agency", "supplier", "label", "value", name_hint())
    return out.withColumn("total_value", r(F.col("total_value"), 2)).withColumn("geral_rate", r(F.col("geral_rate")))


@query(
    "a15_ghost_suppliers",
    f"""WITH {FACT_NAMES} SELECT supplier, count(*) AS n_total, count(*) FILTER (WHERE label = 'geral') AS n_geral,
    {R("sum(CASE WHEN label = 'geral' THEN value ELSE 0 END)", 2)} AS value_geral, {R("sum(CASE WHEN label <> 'geral' THEN value ELSE 0 END)", 2)} AS value_eng,
    count(DISTINCT agency) AS n_agencies, {R("100.0 * count(*) FILTER (WHERE label = 'geral') / count(*)")} AS pct_geral
    FROM factn GROUP BY 1 HAVING bool_or(hint) AND count(*) FILTER (WHERE label = 'geral') >= 3""",
)
def a15(spark, d):
    out = pairs.ghost_suppliers(fact_names(spark, d), "supplier", "agency", "label", "value", name_hint())
    for c, n in (("value_geral", 2), ("value_eng", 2), ("pct_geral", 6)):
        out = out.withColumn(c, r(F.col(c), n))
    return out


@query(
    "a16_flag_concentration",
    f"""WITH {FACT_NAMES} SELECT agency, count(*) AS n_total, count(*) FILTER (WHERE hint AND label = 'geral') AS n_flag,
    {R("100.0 * count(*) FILTER (WHERE hint AND label = 'geral') / count(*)")} AS pct_flag FROM factn GROUP BY 1 HAVING count(*) >= 5""",
)
def a16(spark, d):
    return pairs.flag_concentration(fact_names(spark, d), ["agency"], name_hint() & is_geral()).withColumn("pct_flag", r(F.col("pct_flag")))


def evidence(spark, d):
    refs = reference_codes(spark, d).select("code", "strong")
    return joins.code_evidence(registry(spark, d), "supplier", "principal", "others", refs)


@query(
    "a17_code_evidence",
    f"""WITH {EVIDENCE}, {FACT}, g AS (SELECT supplier, count(*) AS n_geral FROM fact WHERE label = 'geral' GROUP BY 1)
    SELECT g.supplier, {R('coalesce(code_score, 0)')} AS code_score, n_geral, {R('coalesce(code_score, 0) * n_geral')} AS ranking FROM g LEFT JOIN ev USING (supplier)""",
)
def a17(spark, d):
    g = fact(spark, d).filter(is_geral()).groupBy("supplier").agg(F.count("*").alias("n_geral"))
    j = g.join(evidence(spark, d), "supplier")
    return j.select("supplier", r(F.col("code_score")).alias("code_score"), "n_geral", r(F.col("code_score") * F.col("n_geral")).alias("ranking"))


# Detector A: strong code evidence; detector B: supplier name.
CODE = FACT_NAMES + ", " + EVIDENCE + ", coded AS (SELECT f.*, coalesce(code_score, 0) >= 3 AS code_eng FROM factn f LEFT JOIN ev USING (supplier))"


def coded(spark, d):
    e = evidence(spark, d).select("supplier", (F.col("code_score") >= 3).alias("code_eng"))
    return fact_names(spark, d).join(e, "supplier", "left").withColumn("code_eng", F.coalesce("code_eng", F.lit(False))).withColumn("hint", name_hint())


@query(
    "a18_detector_overlap",
    f"""WITH {CODE} SELECT label, count(*) AS n, count(*) FILTER (WHERE code_eng AND NOT hint) AS only_code, count(*) FILTER (WHERE hint AND NOT code_eng) AS only_name,
    count(*) FILTER (WHERE hint AND code_eng) AS both_, count(*) FILTER (WHERE NOT hint AND NOT code_eng) AS neither FROM coded GROUP BY 1""",
)
def a18(spark, d):
    a, b = F.col("code_eng"), F.col("hint")
    flags = {"only_code": a & ~b, "only_name": b & ~a, "both_": a & b, "neither": ~a & ~b}
    return profile.flag_counts(["label"], coded(spark, d), flags)


@query(
    "a19_consistency_matrix",
    f"""WITH {CODE} SELECT label, code_eng, count(*) AS n, {R('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct,
    CASE WHEN label = 'geral' AND code_eng THEN 'subenquadramento' WHEN label <> 'geral' AND NOT code_eng THEN 'anomalia' ELSE 'consistente' END AS kind FROM coded GROUP BY 1, 2""",
)
def a19(spark, d):
    c = coded(spark, d).groupBy("label", "code_eng").agg(F.count("*").alias("n"))
    kind = F.when(is_geral() & F.col("code_eng"), "subenquadramento").when(~is_geral() & ~F.col("code_eng"), "anomalia").otherwise("consistente")
    total = c.agg(F.sum("n")).scalar()
    return c.select("label", "code_eng", "n", r(100 * F.col("n") / total).alias("pct"), kind.alias("kind"))


@query(
    "a20_agency_ranking",
    f"""WITH {CODE} SELECT agency, count(*) AS n_total, count(*) FILTER (WHERE label = 'geral' AND code_eng) AS n_flag,
    {R("100.0 * count(*) FILTER (WHERE label = 'geral' AND code_eng) / count(*)")} AS pct_flag FROM coded GROUP BY 1 HAVING count(*) >= 10""",
)
def a20(spark, d):
    out = pairs.flag_concentration(coded(spark, d), ["agency"], is_geral() & F.col("code_eng"), 10)
    return out.withColumn("pct_flag", r(F.col("pct_flag")))


@query(
    "a21_rate_by_year",
    f"""WITH {CODE} SELECT year, count(*) AS n_total, count(*) FILTER (WHERE label = 'geral' AND code_eng) AS n_flag,
    {R("100.0 * count(*) FILTER (WHERE label = 'geral' AND code_eng) / count(*)")} AS pct_flag FROM coded GROUP BY 1""",
)
def a21(spark, d):
    out = pairs.flag_concentration(coded(spark, d), ["year"], is_geral() & F.col("code_eng"), 1)
    return out.withColumn("pct_flag", r(F.col("pct_flag")))


@query(
    "a22_signal_groups",
    f"""WITH {CODE}, s AS (SELECT *, {SCORE('id')} > 0.5 AS clf FROM coded), g AS (SELECT *, CASE WHEN label = 'geral' AND clf AND code_eng THEN 'Q1' WHEN label <> 'geral' AND code_eng THEN 'Q2'
      WHEN label = 'geral' AND code_eng THEN 'Q3' WHEN label <> 'geral' THEN 'Q4' ELSE 'resto' END AS grp FROM s)
    SELECT grp, count(*) AS n, count(*) FILTER (WHERE hint) AS with_name_hint, {R('sum(value)', 2)} AS value FROM g GROUP BY 1""",
)
def a22(spark, d):
    clf, code = score(F.col("id")) > 0.5, F.col("code_eng")
    grp = (
        F.when(is_geral() & clf & code, "Q1").when(~is_geral() & code, "Q2").when(is_geral() & code, "Q3").when(~is_geral(), "Q4").otherwise("resto")
    )
    return coded(spark, d).groupBy(grp.alias("grp")).agg(
        F.count("*").alias("n"), F.count_if("hint").alias("with_name_hint"), r(F.sum("value"), 2).alias("value")
    )


@query(
    "a23_money_by_class",
    f"""WITH {FACT}, s AS (SELECT *, {SCORE('id')} >= 0.5 AND label = 'geral' AS suspect FROM fact)
    SELECT label, count(*) AS n, {R('sum(value)', 2)} AS total, {R('avg(value)', 4)} AS mean, {R('quantile_cont(value, 0.5)', 4)} AS median, {R('max(value)', 2)} AS max,
    {R('sum(CASE WHEN suspect THEN value ELSE 0 END)', 2)} AS at_stake, {R('100 * sum(CASE WHEN suspect THEN value ELSE 0 END) / (SELECT sum(value) FROM fact)')} AS pct_at_stake FROM s GROUP BY 1""",
)
def a23(spark, d):
    f = fact(spark, d).withColumn("stake", F.when(is_geral() & (score(F.col("id")) >= 0.5), F.col("value")).otherwise(0.0))
    total = f.agg(F.sum("value")).scalar()
    med = totals.exact_quantiles(f, ["label"], "value", {"median": 0.5})
    out = f.groupBy("label").agg(
        F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"), r(F.avg("value"), 4).alias("mean"), r(F.max("value"), 2).alias("max"),
        r(F.sum("stake"), 2).alias("at_stake"), F.sum("stake").alias("_s"),
    )
    return out.join(med, "label").withColumn("median", r(F.col("median"), 4)).withColumn("pct_at_stake", r(100 * F.col("_s") / total)).drop("_s")


@query(
    "a24_executive_summary",
    f"""WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (WHERE label = 'geral') AS n_geral, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day,
    (SELECT state FROM factg GROUP BY 1 ORDER BY count(*) DESC, state LIMIT 1) AS top_state, count(*) FILTER (WHERE p > 0.5) AS n_clf, count(*) FILTER (WHERE discount > 0.08) AS n_discount,
    count(DISTINCT agency) AS n_agencies, count(DISTINCT supplier) AS n_suppliers FROM scored""",
)
def a24(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    contracts = fact(spark, d).withColumn("p", score(F.col("id")))
    # Contracts are added up per purchase before that meets its agency and place.
    per = contracts.groupBy("purchase").agg(
        F.count("*").alias("n"), F.count_if(is_geral()).alias("n_geral"), F.min("date").alias("lo"), F.max("date").alias("hi"),
        F.count_if(F.col("p") > 0.5).alias("n_clf"), F.count_if(F.col("discount") > 0.08).alias("n_discount"), F.collect_set("supplier").alias("suppliers"),
    )
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("purchase"), F.col("o_custkey").alias("agency"))
    s = cut_lineage(per.join(orders.join(places(spark, d).select("agency", "state"), "agency"), "purchase").drop("purchase"))
    sums = [F.sum(c).alias(c) for c in ("n", "n_geral", "n_clf", "n_discount")]
    spans = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    top = s.groupBy("state").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "state").limit(1).select("state").scalar()
    n_suppliers = s.select(F.explode("suppliers").alias("supplier")).agg(F.countDistinct("supplier")).scalar()
    out = s.agg(*sums, *spans, F.countDistinct("agency").alias("n_agencies"))
    n = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n", "n_geral", "n_clf", "n_discount")}
    return out.select(
        n["n"], n["n_geral"], day(F.col("lo")).alias("first_day"), day(F.col("hi")).alias("last_day"), n["n_clf"], n["n_discount"],
        "n_agencies", n_suppliers.alias("n_suppliers"), top.alias("top_state"),
    )


A25_SQL = f"""WITH b AS (SELECT conv_id, turn, role, text, len(regexp_extract_all(strip_accents(lower(text)), '\\bthe\\b')) AS c1,
    len(regexp_extract_all(strip_accents(lower(text)), '\\bde\\b')) AS c2 FROM conversations)
  SELECT conv_id, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(c1) AS BIGINT) AS mk_the, CAST(sum(c2) AS BIGINT) AS mk_de,
    CAST(max(c1 > 0)::INT + max(c2 > 0)::INT AS INTEGER) AS mk_score, string_agg(DISTINCT role, ' | ' ORDER BY role) AS types, md5(string_agg(text, '|' ORDER BY turn)) AS text_md5 FROM b GROUP BY 1"""


@query("a25_documents_to_contract", A25_SQL)
def a25(spark, d):
    from contrasieve.operators import documents

    c = table(spark, d, "conversations")
    fams = {"the": [r"\bthe\b"], "de": [r"\bde\b"]}
    marked = c.select("*", *tx.marker_columns(tx.fold(F.col("text")), fams, flags="(?i)"))
    out = documents.roll_up(marked, "conv_id", "text", "role", "turn", list(fams), "|")
    return out.withColumn("text_md5", F.md5("text")).drop("text")


@query(
    "a26_marker_share",
    f"""WITH b AS (SELECT doc_id, {FOLD_SQL} AS f FROM documents), m AS (SELECT doc_id, {MARKERS_SQL} FROM b), {TEXTS}, j AS (SELECT label, m.* FROM texts t JOIN m USING (doc_id))
    """ + " UNION ALL ".join(
        f"SELECT label, '{n}' AS marker, {R(f'100.0 * avg(({n} > 0)::INT)')} AS pct FROM j GROUP BY 1" for n in ("mk_definite", "mk_link", "mk_prep", "mk_rare")
    ),
)
def a26(spark, d):
    names = ["mk_definite", "mk_link", "mk_prep", "mk_rare"]
    j = texts(spark, d).select("doc_id", "label").join(markers(spark, d), "doc_id")
    wide = j.groupBy("label").agg(*[(100 * F.avg((F.col(n) > 0).cast("int"))).alias(n) for n in names])
    return wide.unpivot("label", names, "marker", "pct").withColumn("pct", r(F.col("pct")))


@query(
    "a27_label_profile",
    f"""WITH {FACT} SELECT label, count(*) AS n, {R('quantile_cont(qty, 0.5)')} AS median_qty, {R('quantile_cont(value, 0.5)', 4)} AS median_value, {R('quantile_cont(value, 0.9)', 4)} AS p90_value FROM fact GROUP BY 1""",
)
def a27(spark, d):
    f = fact(spark, d)
    q = totals.exact_quantiles(f, ["label"], "value", {"median_value": 0.5, "p90_value": 0.9})
    w = totals.exact_quantiles(f, ["label"], "qty", {"median_qty": 0.5})
    n = f.groupBy("label").agg(F.count("*").alias("n"))
    out = n.join(q, "label").join(w, "label")
    return out.select("label", "n", r(F.col("median_qty")).alias("median_qty"), r(F.col("median_value"), 4).alias("median_value"), r(F.col("p90_value"), 4).alias("p90_value"))


@query(
    "a28_funnel",
    f"""WITH {SCORED}, s AS (SELECT *, label = 'geral' AS g, label = 'geral' AND p >= 0.6 AS sus, label = 'geral' AND p >= 0.6 AND qty >= 20 AS conf FROM scored)
    SELECT 0 AS position, 'base' AS step, count(*) AS n FROM s UNION ALL SELECT 1, 'positivos', count(*) FILTER (WHERE NOT g) FROM s UNION ALL SELECT 2, 'geral', count(*) FILTER (WHERE g) FROM s
    UNION ALL SELECT 3, 'suspeitos', count(*) FILTER (WHERE sus) FROM s UNION ALL SELECT 4, 'nao_suspeitos', count(*) FILTER (WHERE g AND NOT sus) FROM s
    UNION ALL SELECT 5, 'confirmados', count(*) FILTER (WHERE conf) FROM s UNION ALL SELECT 6, 'descartados', count(*) FILTER (WHERE sus AND NOT conf) FROM s
    UNION ALL SELECT 7, 'analisados', count(*) FILTER (WHERE conf AND status = 'F') FROM s UNION ALL SELECT 8, 'aguardando', count(*) FILTER (WHERE conf AND status <> 'F') FROM s""",
)
def a28(spark, d):
    sus = is_geral() & (F.col("p") >= 0.6)
    conf = sus & (F.col("qty") >= 20)
    steps = {
        "base": F.lit(True), "positivos": ~is_geral(), "geral": is_geral(), "suspeitos": sus, "nao_suspeitos": is_geral() & ~sus, "confirmados": conf,
        "descartados": sus & ~conf, "analisados": conf & (F.col("status") == "F"), "aguardando": conf & (F.col("status") != "F"),
    }
    return rules.funnel(scored(spark, d), steps)


@query(
    "a29_outcome_by_agency",
    f"""WITH {FACT_GEO} SELECT sphere, label, CAST(floor(log10(value)) AS INTEGER) AS log_bin, count(*) AS n, {R('sum(value)', 2)} AS value FROM factg GROUP BY 1, 2, 3""",
)
def a29(spark, d):
    b = F.floor(F.log10("value")).cast("int").alias("log_bin")
    return fact_geo(spark, d).groupBy("sphere", "label", b).agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("value"))


@query(
    "a30_queue_dashboard",
    f"""WITH {SCORED}, c AS (SELECT *, CASE WHEN label <> 'geral' THEN 'referencia' WHEN p >= 0.6 THEN 'novo' ELSE 'baixa' END AS state_ FROM scored),
    t AS (SELECT sphere, count(*) AS n FROM c WHERE state_ = 'novo' GROUP BY 1 ORDER BY n DESC, sphere LIMIT 8)
    SELECT 'estado' AS kind, state_ AS name, count(*) AS n, {R('sum(value)', 2)} AS value FROM c GROUP BY 2 UNION ALL SELECT 'fila', sphere, n, NULL FROM t""",
)
def a30(spark, d):
    c = scored(spark, d).withColumn("name", rules.initial_state(F.col("label"), F.col("p")))
    states = c.groupBy("name").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("value")).withColumn("kind", F.lit("estado"))
    queue = c.filter("name = 'novo'").groupBy(F.col("sphere").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(8)
    return states.unionByName(queue.withColumn("kind", F.lit("fila")), allowMissingColumns=True)


@query(
    "a31_suspects_by_place",
    f"""WITH {SCORED}, s AS (SELECT municipality, (p > 0.5)::INT + (discount > 0.05)::INT + (qty > 25)::INT AS k FROM scored WHERE label = 'geral')
    SELECT n_name AS municipality, n_regionkey AS lat, count(*) AS n FROM s JOIN nation ON municipality = n_name WHERE k >= 2 GROUP BY 1, 2""",
)
def a31(spark, d):
    k = rules.count_flags([F.col("p") > 0.5, F.col("discount") > 0.05, F.col("qty") > 25])
    s = scored(spark, d).filter(is_geral()).filter(k >= 2).groupBy("municipality").agg(F.count("*").alias("n"))
    places = table(spark, d, "nation").select(F.col("n_name").alias("municipality"), F.col("n_regionkey").alias("lat"))
    return s.join(places, "municipality")


@query(
    "a32_cluster_purity",
    f"""SELECT label AS cluster, count(*) AS n, count(*) FILTER (WHERE {SCORE('vec_id')} < 0.55) AS n_pos, {R(f"100.0 * avg(({SCORE('vec_id')} < 0.55)::INT)")} AS pct_pos,
    avg(({SCORE('vec_id')} < 0.55)::INT) >= 0.6 AND count(*) FILTER (WHERE {SCORE('vec_id')} >= 0.55) >= 1 AND count(*) >= 5 AS suspicious FROM embeddings GROUP BY 1""",
)
def a32(spark, d):
    from contrasieve.operators import clusters

    e = table(spark, d, "embeddings").select(F.col("label").alias("cluster"), (score(F.col("vec_id")) < 0.55).alias("pos"))
    return clusters.purity(e, "cluster", F.col("pos")).withColumn("pct_pos", r(F.col("pct_pos")))
