"""Queries on joins (J1-J13), windows (W1-W9), sorts (O1-O4) and sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrasieve.functions import text as tx
from contrasieve.operators import joins, neighbours, pairs, sampling, totals
from contrasieve.plans.registry import query, table
from contrasieve.plans.standin import (
    FACT, FACT_AGENCY, FACT_GEO, R, SCORE, TEXTS, fact, fact_agency, fact_geo, r, score, texts,
)
from contrasieve.plans.text import COMPAT_SQL, FOLD_SQL, MARKERS_SQL, TOKENS_SQL, markers


def scored(spark, d):
    """General contracts with a deterministic probability."""
    return fact_geo(spark, d).withColumn("p", score(F.col("id")))


SCORED = FACT_GEO + f", scored AS (SELECT *, {SCORE('id')} AS p FROM factg)"


@query(
    "j1_attach_signals",
    f"""WITH {FACT}, e AS (SELECT user_id AS supplier, max(event_type = 'error') AS scope_change, count(*) AS n_events FROM events GROUP BY 1),
    p AS (SELECT l_suppkey AS supplier, max(l_tax) AS top_tax FROM lineitem GROUP BY 1)
    SELECT s_suppkey AS supplier, scope_change, n_events, top_tax, CAST(NULL AS DOUBLE) AS verdict FROM supplier
    LEFT JOIN e ON s_suppkey = e.supplier LEFT JOIN p ON s_suppkey = p.supplier""",
)
def j1(spark, d):
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"))
    events = table(spark, d, "events").withColumnRenamed("user_id", "supplier")
    items = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "supplier")
    return joins.attach_signals(
        base,
        "supplier",
        [
            (events, {"scope_change": F.max(F.col("event_type") == "error"), "n_events": F.count("*")}),
            (items, {"top_tax": F.max("l_tax")}),
            (None, {"verdict": F.lit(None)}),
        ],
    )


@query(
    "j2_inner_features",
    f"""WITH b AS (SELECT doc_id, {FOLD_SQL} AS f FROM documents), m AS (SELECT doc_id, {MARKERS_SQL} FROM b), {TEXTS}
    SELECT t.label, count(*) AS n, CAST(sum(mk_definite) AS BIGINT) AS definite FROM texts t JOIN m ON t.doc_id = m.doc_id WHERE mk_definite > 0 GROUP BY 1""",
)
def j2(spark, d):
    feats = markers(spark, d).filter("mk_definite > 0").select("doc_id", "mk_definite")
    j = texts(spark, d).select("doc_id", "label").join(feats, "doc_id")
    return j.groupBy("label").agg(F.count("*").alias("n"), F.sum("mk_definite").alias("definite"))


@query(
    "j3_join_first",
    """WITH f AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1)
    SELECT o_orderkey, l_partkey FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""",
)
def j3(spark, d):
    right = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    left = table(spark, d, "orders").select("o_orderkey")
    return joins.join_first(left, right, ["o_orderkey"], order).select("o_orderkey", "l_partkey")


@query(
    "j4_flag_in",
    "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09) AS flagged FROM orders",
)
def j4(spark, d):
    members = table(spark, d, "lineitem").filter("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.flag_in(table(spark, d, "orders").select("o_orderkey"), members, ["o_orderkey"], "flagged")


@query("j5_not_judged", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j5(spark, d):
    return joins.not_in(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


def registry(spark, d):
    """Supplier registry: the brand a supplier sells most is its principal code, brands above its mean are the others."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    code = F.regexp_extract("p_brand", r"(\d+)", 1).alias("code")
    sold = j.groupBy(F.col("l_suppkey").alias("supplier"), code).agg(F.sum("l_quantity").alias("q"))
    # One row per supplier and brand code; the arrays are bounded by the code list.
    per = sold.groupBy("supplier").agg(
        F.max_by("code", F.struct("q", "code")).alias("principal"),
        F.avg("q").alias("m"),
        F.collect_list(F.struct("q", "code")).alias("all"),
    )
    codes = F.array_sort(F.transform(F.filter("all", lambda x: x["q"] >= F.col("m")), lambda x: x["code"]))
    out = per.select("supplier", "principal", codes.alias("codes"))
    return out.withColumn("others", F.filter("codes", lambda c: c != F.col("principal")))


def reference_codes(spark, d):
    """Reference list: brand codes 11-17, strong from 15."""
    brands = table(spark, d, "part").select(F.regexp_extract("p_brand", r"(\d+)", 1).alias("c"), "p_brand").distinct()
    listed = brands.filter(F.col("c").try_cast("int").between(11, 17))
    return listed.select(
        F.lpad("c", 7, "0").alias("code"), F.col("p_brand").alias("description"), (F.col("c").cast("int") >= 15).alias("strong")
    )


REGISTRY = """sold AS (SELECT l_suppkey AS supplier, regexp_extract(p_brand, '(\\d+)', 1) AS code, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  reg AS (SELECT supplier, code FROM sold QUALIFY q >= avg(q) OVER (PARTITION BY supplier)),
  prin AS (SELECT supplier, code AS principal FROM sold QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY q DESC, code DESC) = 1),
  refc AS (SELECT DISTINCT regexp_extract(p_brand, '(\\d+)', 1) AS code, p_brand AS description,
    CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) >= 15 AS strong FROM part WHERE CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) BETWEEN 11 AND 17)"""
EVIDENCE = REGISTRY + """, ev AS (SELECT reg.supplier, sum(CASE WHEN reg.code = principal THEN CASE WHEN strong THEN 3.0 ELSE 2.0 END
    ELSE CASE WHEN strong THEN 1.0 ELSE 0.5 END END)::DOUBLE AS code_score
  FROM reg JOIN prin USING (supplier) JOIN refc ON reg.code = refc.code GROUP BY 1)"""


@query(
    "j6_match_codes",
    f"""WITH {REGISTRY}, h AS (SELECT supplier, count(*) AS n_codes, array_to_string(list_sort(list(lpad(reg.code, 7, '0') || ' ' || description))[1:3], ' | ') AS detail
      FROM reg JOIN refc ON reg.code = refc.code GROUP BY 1)
    SELECT prin.supplier, coalesce(n_codes, 0) AS n_codes, n_codes IS NOT NULL AS has_code, coalesce(detail, '') AS detail FROM prin LEFT JOIN h USING (supplier)""",
)
def j6(spark, d):
    return joins.match_codes(registry(spark, d), "supplier", "codes", reference_codes(spark, d))


@query(
    "j7_prefer_new",
    """SELECT o_orderkey, coalesce(CASE WHEN l_tax > 0.04 THEN 'T' END, o_orderstatus) AS o_orderstatus FROM orders
    LEFT JOIN (SELECT l_orderkey, max(l_tax) AS l_tax FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
)
def j7(spark, d):
    new = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_tax").alias("t"))
    new = new.select("o_orderkey", F.when(F.col("t") > 0.04, "T").alias("o_orderstatus"))
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return joins.prefer_new(old, new, ["o_orderkey"], ["o_orderstatus"])


KEYED_DOCS = f"kd AS (SELECT doc_id, trim(regexp_replace({COMPAT_SQL}, '[^a-z0-9]+', ' ', 'g')) AS k FROM documents)"


@query(
    "j8_propagate_text",
    f"""WITH {KEYED_DOCS}, j AS (SELECT k, quality, kd.doc_id FROM kd JOIN labels USING (doc_id)),
    u AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1)
    SELECT kd.doc_id, quality, CASE WHEN u.doc_id = kd.doc_id THEN 'analisado' WHEN quality IS NOT NULL THEN 'propagado' END AS origin
    FROM kd LEFT JOIN u USING (k)""",
)
def j8(spark, d):
    keyed = table(spark, d, "documents").select("doc_id", tx.text_key(F.col("text")).alias("k"))
    judged = keyed.join(table(spark, d, "labels"), "doc_id")
    out = joins.propagate_by_key(keyed, judged, "k", "quality", [F.col("doc_id")], row_id="doc_id")
    return out.select("doc_id", "quality", "origin")


@query(
    "j9_propagate_purchase",
    f"""WITH {FACT}, j AS (SELECT purchase, id, tax FROM fact WHERE label = 'geral'),
    u AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY purchase ORDER BY id) = 1)
    SELECT f.id, u.tax AS verdict, CASE WHEN u.id = f.id THEN 'analisado' WHEN u.tax IS NOT NULL THEN 'propagado' END AS origin
    FROM fact f LEFT JOIN u USING (purchase)""",
)
def j9(spark, d):
    f = fact(spark, d)
    judged = f.filter("label = 'geral'").select("purchase", "id", F.col("tax").alias("verdict"))
    rows = f.select("purchase", "id")
    out = joins.propagate_by_key(rows, judged, "purchase", "verdict", [F.col("id")], row_id="id")
    return out.select("id", "verdict", "origin")


@query(
    "j10_resolve_purchase",
    """WITH k AS (SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 14, '0') || CASE o_orderstatus WHEN 'F' THEN '-1-' ELSE '-2-' END ||
        lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '/' || year(o_orderdate) AS key, CASE WHEN o_orderstatus = 'P' THEN 'own' || o_orderkey END AS own FROM orders),
      t AS (SELECT l_orderkey, min('det' || l_partkey) AS det FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(own, CASE WHEN contains(key, '-1-') THEN key END, det) AS resolved FROM k LEFT JOIN t ON o_orderkey = l_orderkey""",
)
def j10(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "-1-").otherwise("-2-")
    key = F.concat(F.lpad(F.col("o_custkey").cast("string"), 14, "0"), kind, F.lpad(F.col("o_orderkey").cast("string"), 6, "0"),
                   F.lit("/"), F.year("o_orderdate").cast("string"))
    own = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("own"), F.col("o_orderkey")))
    o = table(spark, d, "orders").select("o_orderkey", key.alias("key"), own.alias("own"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("det"), F.col("l_partkey")).alias("detail_purchase"))
    details = items.join(o, "o_orderkey").select("key", "detail_purchase")
    return joins.resolve_purchase(o, "key", "own", details).select("o_orderkey", "resolved")


@query(
    "j11_co_occurrence",
    f"""WITH {FACT_AGENCY}, e AS (SELECT DISTINCT supplier, agency FROM facta)
    SELECT x.supplier AS a, y.supplier AS b, count(*) AS weight FROM e x JOIN e y ON x.agency = y.agency AND x.supplier < y.supplier
    GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def j11(spark, d):
    return joins.co_occurrence(fact_agency(spark, d), "supplier", "agency")


@query(
    "j12_similar_to_seeds",
    f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, {SCORE('vec_id')} AS p FROM embeddings), seeds AS (SELECT * FROM v ORDER BY p DESC, vec_id LIMIT 20),
    s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 9) AS sim
      FROM seeds a, v b WHERE a.vec_id <> b.vec_id)
    SELECT src, dst, {R('sim')} AS sim FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 5""",
)
def j12(spark, d):
    e = table(spark, d, "embeddings")
    seeds = e.withColumn("p", score(F.col("vec_id"))).orderBy(F.desc("p"), "vec_id").limit(20)
    return neighbours.top_matches(e, seeds, "vec_id", "embedding", 5).withColumn("sim", r(F.col("sim")))


@query(
    "j13_vocabulary",
    f"""WITH {TEXTS}, w AS (SELECT label <> 'geral' AS pos, unnest({TOKENS_SQL}) AS term FROM texts)
    SELECT term, count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg FROM w GROUP BY 1""",
)
def j13(spark, d):
    w = texts(spark, d).select((F.col("label") != "geral").alias("pos"), F.explode(tx.tokens(F.col("text"))).alias("term"))
    return w.groupBy("term").agg(F.count_if("pos").alias("n_pos"), F.count_if(~F.col("pos")).alias("n_neg"))


@query(
    "w1_period_change",
    f"""WITH {FACT}, c AS (SELECT label, year, count(*) AS n FROM fact GROUP BY 1, 2)
    SELECT label, year, n, n - lag(n) OVER (PARTITION BY label ORDER BY year) AS change FROM c""",
)
def w1(spark, d):
    c = fact(spark, d).groupBy("label", "year").agg(F.count("*").alias("n"))
    return c.withColumn("change", F.col("n") - F.lag("n").over(W.partitionBy("label").orderBy("year")))


@query(
    "w2_dedup_keep_best",
    f"""WITH s AS (SELECT doc_id, source, left(lower(text), 80) AS k, {SCORE('doc_id')} AS p FROM documents)
    SELECT doc_id, {R('p')} AS p FROM s QUALIFY row_number() OVER (PARTITION BY k, source ORDER BY p DESC, doc_id) = 1""",
)
def w2(spark, d):
    s = table(spark, d, "documents").select("doc_id", "source", F.substring(F.lower("text"), 1, 80).alias("k"), score(F.col("doc_id")).alias("p"))
    return pairs.keep_best(s, ["k", "source"], "p", "doc_id").select("doc_id", r(F.col("p")).alias("p"))


@query(
    "w3_at_most_k",
    f"""WITH {SCORED}, t AS (SELECT id, agency, p FROM scored WHERE label = 'geral' QUALIFY row_number() OVER (PARTITION BY agency ORDER BY p DESC, id) <= 3)
    SELECT id, agency, {R('p')} AS p FROM (SELECT * FROM t ORDER BY p DESC, id LIMIT 100)""",
)
def w3(spark, d):
    g = scored(spark, d).filter("label = 'geral'").select("id", "agency", "p")
    capped = sampling.top_per_group(g, ["agency"], [F.desc("p"), F.col("id")], 3, "id")
    return capped.orderBy(F.desc("p"), "id").limit(100).withColumn("p", r(F.col("p")))


@query(
    "w4_percentile_rank",
    f"""WITH {FACT}, x AS (SELECT id, qty, rank() OVER (ORDER BY qty) AS k, count(*) OVER (PARTITION BY qty) AS c, count(*) OVER () AS n FROM fact)
    SELECT id, {R('(k + (c - 1) / 2.0) / n', 9)} AS pct_rank FROM x""",
)
def w4(spark, d):
    out = totals.average_ranks(fact(spark, d).select("id", "qty"), [], "qty", "pct_rank", pct=True)
    return out.select("id", r(F.col("pct_rank"), 9).alias("pct_rank"))


@query(
    "w5_outlier_flags",
    f"""WITH {FACT}, g AS (SELECT label, avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM fact GROUP BY 1)
    SELECT id, {R('(value - m) / greatest(s, 1e-9)')} AS z, abs((value - m) / greatest(s, 1e-9)) >= 1.7 AS z_flag, value > q3 + 0.4 * (q3 - q1) AS iqr_flag
    FROM fact JOIN g USING (label)""",
)
def w5(spark, d):
    out = pairs.outlier_flags(fact(spark, d), ["label"], "value", z_limit=1.7, iqr_factor=0.4)
    return out.select("id", r(F.col("z")).alias("z"), "z_flag", "iqr_flag")


@query(
    "w6_cluster_quota",
    f"""WITH {FACT_GEO}, x AS (SELECT id, municipality, row_number() OVER (PARTITION BY municipality ORDER BY md5('42|' || id), id) - 1 AS k,
      count(*) OVER (PARTITION BY municipality) AS s, count(*) OVER () AS n FROM factg WHERE label = 'geral')
    SELECT id, municipality FROM x WHERE k < greatest(1, ceil(200 * s / n::DOUBLE)) ORDER BY md5('42|' || id), id LIMIT 200""",
)
def w6(spark, d):
    g = fact_geo(spark, d).filter("label = 'geral'").select("id", "municipality")
    total = g.agg(F.count("*")).scalar()
    quota = F.greatest(F.lit(1), F.ceil(F.lit(200) * F.col("_size") / total))
    return sampling.sample_rows(sampling.quota_sample(g, ["municipality"], "id", quota), "id", 200)


W7_SQL = f"""WITH w AS (SELECT unnest({TOKENS_SQL}) AS term FROM documents), c AS (SELECT term, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, term LIMIT 200),
    k AS (SELECT *, row_number() OVER (ORDER BY n DESC, term) AS rnk FROM c)
    SELECT term, n, CAST(rnk AS INTEGER) AS rnk, {R('(SELECT regr_slope(ln(n), ln(rnk)) FROM k)')} AS slope FROM k"""


@query("w7_rank_frequency", W7_SQL)
def w7(spark, d):
    from contrasieve.operators import terms

    words = table(spark, d, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    return terms.zipf(words, [], top=200).withColumn("slope", r(F.col("slope")))


MONTHS = FACT + """, m AS (SELECT label, month, count(*) AS n FROM fact GROUP BY 1, 2)"""


@query(
    "w8_centred_average",
    f"""WITH {MONTHS}, x AS (SELECT label, month, n, row_number() OVER w AS i, count(*) OVER (PARTITION BY label) AS t,
      sum(n) OVER (PARTITION BY label ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + 0.5 * (lag(n, 6) OVER w + lead(n, 6) OVER w) AS s
      FROM m WINDOW w AS (PARTITION BY label ORDER BY month))
    SELECT label, month, n, CASE WHEN i > 6 AND i <= t - 6 THEN {R('s / 12.0')} END AS trend FROM x""",
)
def w8(spark, d):
    from contrasieve.operators import series

    m = series.monthly_counts(fact(spark, d), ["label"], "date")
    return series.centred_average(m, ["label"], "month", "n").select("label", "month", "n", r(F.col("trend")).alias("trend"))


@query(
    "w9_cumulative_confusion",
    f"""WITH {FACT}, s AS (SELECT discount AS sc, label <> 'geral' AS y FROM fact),
    g AS (SELECT sc, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM s GROUP BY 1)
    SELECT sc AS score, CAST(sum(pos) OVER (ORDER BY sc DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY sc DESC) AS BIGINT) AS fp FROM g""",
)
def w9(spark, d):
    from contrasieve.operators import metrics

    f = fact(spark, d).select(F.col("discount").alias("score"), (F.col("label") != "geral").alias("y"))
    return metrics.cumulative_confusion(f, [], "score", "y").select("score", "tp", "fp")


@query(
    "o1_rank_suspects",
    f"""WITH {SCORED} SELECT id, CAST(p > 0.5 AS INT) + CAST(discount > 0.05 AS INT) AS n_signals, {R('p')} AS p FROM scored WHERE label = 'geral' AND p > 0.4
    ORDER BY n_signals DESC NULLS LAST, p DESC NULLS LAST, id""",
)
def o1(spark, d):
    n = (F.col("p") > 0.5).cast("int") + (F.col("discount") > 0.05).cast("int")
    g = scored(spark, d).filter("label = 'geral' AND p > 0.4").select("id", n.alias("n_signals"), "p")
    return pairs.ranked(g, ["n_signals", "p"], "id").withColumn("p", r(F.col("p")))


@query(
    "o2_page",
    f"WITH {SCORED} SELECT id, {R('p')} AS p FROM (SELECT * FROM scored WHERE state = 'ASIA' AND label = 'geral' ORDER BY p DESC, id LIMIT 50 OFFSET 100)",
)
def o2(spark, d):
    g = scored(spark, d).filter("state = 'ASIA' AND label = 'geral'").select("id", "p")
    return pairs.page(g, [F.desc("p"), F.col("id")], 50, 100).withColumn("p", r(F.col("p")))


@query(
    "o3_work_queue",
    f"WITH {FACT} SELECT id, strftime(date, '%Y-%m-%d') AS day FROM (SELECT * FROM fact WHERE label = 'geral' ORDER BY date, id LIMIT 300)",
)
def o3(spark, d):
    g = fact(spark, d).filter("label = 'geral'").select("id", "date").orderBy("date", "id").limit(300)
    return g.select("id", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query(
    "o4_top_k",
    f"WITH {FACT_AGENCY} SELECT agency, count(*) AS n FROM facta GROUP BY 1 ORDER BY n DESC, agency LIMIT 20",
)
def o4(spark, d):
    return fact_agency(spark, d).groupBy("agency").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "agency").limit(20)


@query(
    "u1_union_strata",
    """SELECT CAST(doc_id AS VARCHAR) AS key, text, 'documents' AS origin FROM documents
    UNION ALL SELECT conv_id || ':' || turn, text, 'conversations' FROM conversations""",
)
def u1(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "text", F.lit("documents").alias("origin"))
    b = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text", F.lit("conversations").alias("origin"))
    return a.unionByName(b)


@query(
    "u2_intersect_suspects",
    f"WITH {SCORED} SELECT id, {R('p')} AS p, CAST(qty AS INTEGER) AS votes FROM scored WHERE label = 'geral' AND p >= 0.7 AND qty >= 30",
)
def u2(spark, d):
    g = scored(spark, d).filter("label = 'geral'")
    by_score = g.filter("p >= 0.7").select("id", "p")
    by_vote = g.filter("qty >= 30").select("id", F.col("qty").cast("int").alias("votes"))
    return pairs.intersect_suspects(by_score, by_vote, "id").withColumn("p", r(F.col("p")))


@query(
    "u3_difference",
    f"WITH {FACT}, s AS (SELECT id FROM fact ORDER BY md5('7|' || id), id LIMIT 1000) SELECT id FROM fact WHERE id NOT IN (SELECT id FROM s)",
)
def u3(spark, d):
    f = fact(spark, d).select("id")
    return joins.not_in(f, sampling.sample_rows(f, "id", 1000, seed=7), ["id"])


@query(
    "u4_distinct_tokens",
    f"SELECT term, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY 1",
)
def u4(spark, d):
    from contrasieve.operators import terms

    return terms.document_frequency(table(spark, d, "documents"), "doc_id", tx.tokens(F.col("text")))
