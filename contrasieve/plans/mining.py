"""Queries on text mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrasieve.functions import text as tx
from contrasieve.operators import features, terms, topics
from contrasieve.plans.registry import query, table
from contrasieve.plans.standin import CORPUS_KEYWORDS, R, TEXTS, r, texts
from contrasieve.plans.text import COMPAT_SQL, TOKENS_SQL, _stem_sql, sql_list

def doc_tokens():
    return tx.tokens(F.col("text"))

def is_pos():
    return F.col("label") != "geral"


WORDS = f"{TEXTS}, tk AS (SELECT doc_id, label, source, text, {TOKENS_SQL} AS k FROM texts)"
BIGRAMS = "unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i+1]))"


@query(
    "x1_frequencies",
    f"""WITH {WORDS}, w AS (SELECT label, 'word' AS kind, unnest(k) AS term FROM tk UNION ALL SELECT label, 'bigram', {BIGRAMS} FROM tk),
    s AS (SELECT label, kind, term, count(*) AS n FROM w GROUP BY 1, 2, 3)
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label, kind ORDER BY n DESC, term) <= 25""",
)
def x1(spark, d):
    t = texts(spark, d)
    found = terms.top_words_and_pairs(t, doc_tokens(), ["label"], 25)
    return found.select("label", F.when(F.col("n_words") == 1, "word").otherwise("bigram").alias("kind"), "term", "n")


@query(
    "x1_stem_frequencies",
    f"WITH {WORDS}, w AS (SELECT unnest(k) AS word FROM tk) SELECT {_stem_sql('word')} AS term, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, term LIMIT 50",
)
def x1s(spark, d):
    w = terms.term_table(texts(spark, d), "doc_id", doc_tokens())
    # Count words first, so the stemmer runs once per distinct word.
    counted = w.groupBy("term").agg(F.count("*").alias("n"))
    return counted.groupBy(tx.stem(F.col("term")).alias("term")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(50)


TFIDF = WORDS + f""", occ AS (SELECT doc_id, unnest(k) AS term FROM tk UNION ALL SELECT doc_id, {BIGRAMS} FROM tk),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY 1, 2), nd AS (SELECT count(*) AS n FROM texts),
  voc AS (SELECT term, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf, sum(tf) AS total FROM tf, nd GROUP BY term, n HAVING count(*) >= 10 ORDER BY total DESC, term LIMIT 30000),
  raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (term)),
  wt AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def weights(spark, d, carry=()):
    return terms.tfidf(texts(spark, d), "doc_id", doc_tokens(), carry=carry)


@query("x2_tfidf", f"WITH {TFIDF} SELECT doc_id, term, {R('weight')} AS weight FROM wt")
def x2(spark, d):
    return weights(spark, d).withColumn("weight", r(F.col("weight")))


@query(
    "x3_metadata_features",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()')} AS z_qty,
    {R('(ln(1 + l_extendedprice) - avg(ln(1 + l_extendedprice)) OVER ()) / stddev_pop(ln(1 + l_extendedprice)) OVER ()')} AS z_value FROM lineitem""",
)
def x3(spark, d):
    li = table(spark, d, "lineitem").withColumn("log_value", F.log1p("l_extendedprice"))
    z = features.z_scores(li, {"z_qty": "l_quantity", "z_value": "log_value"})
    return z.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(F.col("z_qty")).alias("z_qty"), r(F.col("z_value")).alias("z_value"))


@query(
    "x4_chi_square",
    f"""WITH {TFIDF}, p AS (SELECT label, count(*) / (SELECT count(*) FROM texts)::DOUBLE AS p FROM texts GROUP BY 1), t AS (SELECT term, sum(weight) AS t FROM wt GROUP BY 1),
    o AS (SELECT term, label, sum(weight) AS o FROM wt JOIN texts USING (doc_id) GROUP BY 1, 2),
    x AS (SELECT t.term, sum((coalesce(o, 0) - t * p) ** 2 / (t * p)) AS chi2 FROM t CROSS JOIN p LEFT JOIN o ON o.term = t.term AND o.label = p.label GROUP BY 1)
    SELECT term, {R('chi2')} AS chi2 FROM (SELECT * FROM x ORDER BY chi2 DESC, term LIMIT 10000)""",
)
def x4(spark, d):
    out = terms.chi_square(weights(spark, d, ["label"]), texts(spark, d).select("doc_id", "label"), "doc_id", "label")
    return out.withColumn("chi2", r(F.col("chi2")))


PRESENCE = WORDS + """, pr AS (SELECT DISTINCT doc_id, label, unnest(k) AS term FROM tk),
  cn AS (SELECT term, count(*) FILTER (WHERE label <> 'geral') AS n_pos, count(*) FILTER (WHERE label = 'geral') AS n_neg FROM pr GROUP BY 1),
  nn AS (SELECT count(*) FILTER (WHERE label <> 'geral')::DOUBLE AS a, count(*) FILTER (WHERE label = 'geral')::DOUBLE AS b FROM texts)"""


def counts(spark, d, n_min=1, n_max=1):
    t = texts(spark, d)
    presence = terms.presence_table(t, "doc_id", doc_tokens(), n_min, n_max, carry=["label"])
    n_pos, n_neg = terms.class_sizes(t, is_pos())
    return terms.class_presence(presence, is_pos()), n_pos, n_neg


def _mi(joint, row, col):
    return f"CASE WHEN {joint} > 0 THEN {joint} / n * ln(n * {joint} / ({row} * {col})) ELSE 0 END"


@query(
    "x5_mutual_information",
    f"""WITH {PRESENCE}, q AS (SELECT term, n_pos::DOUBLE AS p, n_neg::DOUBLE AS g, a, b, a + b AS n FROM cn, nn),
    m AS (SELECT term, {_mi('p', '(p + g)', 'a')} + {_mi('g', '(p + g)', 'b')} + {_mi('(a - p)', '(n - p - g)', 'a')} + {_mi('(b - g)', '(n - p - g)', 'b')} AS mi FROM q)
    SELECT term, {R('mi')} AS mi FROM (SELECT * FROM m ORDER BY round(mi, 9) DESC, term LIMIT 30)""",
)
def x5(spark, d):
    return terms.mutual_information(*counts(spark, d)).withColumn("mi", r(F.col("mi")))


@query(
    "x6_log_odds",
    f"""WITH {PRESENCE}, l AS (SELECT term, n_pos, n_neg, ln(((n_pos + 1) / (a + 1)) / ((n_neg + 1) / (b + 1))) AS lo FROM cn, nn WHERE n_pos + n_neg >= greatest(3, floor(0.005 * (a + b))))
    SELECT term, n_pos, n_neg, {R('lo')} AS log_odds, {R('lo * ln(1 + n_pos + n_neg)')} AS score FROM l""",
)
def x6(spark, d):
    out = terms.log_odds(*counts(spark, d))
    return out.select("term", "n_pos", "n_neg", r(F.col("log_odds")).alias("log_odds"), r(F.col("score")).alias("score"))


@query(
    "x6_works_vs_services",
    f"""WITH {WORDS}, pr AS (SELECT DISTINCT doc_id, label, unnest(k) AS term FROM tk WHERE label <> 'geral'),
    cn AS (SELECT term, count(*) FILTER (WHERE label = 'obras') AS n_pos, count(*) FILTER (WHERE label <> 'obras') AS n_neg FROM pr GROUP BY 1),
    nn AS (SELECT count(*) FILTER (WHERE label = 'obras')::DOUBLE AS a, count(*) FILTER (WHERE label = 'engenharia')::DOUBLE AS b FROM texts),
    l AS (SELECT term, n_pos, n_neg, ln(((n_pos + 1) / (a + 1)) / ((n_neg + 1) / (b + 1))) AS lo FROM cn, nn WHERE n_pos + n_neg >= greatest(3, floor(0.01 * (a + b))))
    SELECT term, n_pos, n_neg, {R('lo')} AS log_odds, {R('lo * ln(1 + n_pos + n_neg)')} AS score FROM l""",
)
def x6w(spark, d):
    t = texts(spark, d).filter(is_pos())
    works = F.col("label") == "obras"
    presence = terms.presence_table(t, "doc_id", doc_tokens(), carry=["label"])
    out = terms.log_odds(terms.class_presence(presence, works), *terms.class_sizes(t, works), min_share=0.01)
    return out.select("term", "n_pos", "n_neg", r(F.col("log_odds")).alias("log_odds"), r(F.col("score")).alias("score"))


@query(
    "x7_domain_terms",
    f"""WITH {WORDS}, g AS (SELECT doc_id, label, unnest(k) AS term FROM tk UNION ALL SELECT doc_id, label, {BIGRAMS} FROM tk
      UNION ALL SELECT doc_id, label, unnest(list_transform(range(1, len(k)-1), lambda i: k[i] || ' ' || k[i+1] || ' ' || k[i+2])) FROM tk
      UNION ALL SELECT doc_id, label, unnest(list_transform(range(1, len(k)-2), lambda i: k[i] || ' ' || k[i+1] || ' ' || k[i+2] || ' ' || k[i+3])) FROM tk),
    cn AS (SELECT term, count(DISTINCT doc_id) FILTER (WHERE label <> 'geral') AS n_pos, count(DISTINCT doc_id) FILTER (WHERE label = 'geral') AS n_neg, min(doc_id) FILTER (WHERE label <> 'geral') AS example FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
    nn AS (SELECT count(*) FILTER (WHERE label <> 'geral')::DOUBLE AS a, count(*) FILTER (WHERE label = 'geral')::DOUBLE AS b FROM texts),
    s AS (SELECT term, n_pos, n_neg, example, len(string_split(term, ' ')) AS n_words, ln(((n_pos + 1) / (a + 2)) / ((n_neg + 1) / (b + 2))) AS lo FROM cn, nn)
    SELECT term, n_pos, n_neg, CAST(n_words AS INTEGER) AS n_words, example, text AS example_text, {R('lo * (1 + (n_words - 1) * 0.3)')} AS score FROM s LEFT JOIN texts ON doc_id = example WHERE lo > 0""",
)
def x7(spark, d):
    t = texts(spark, d)
    sums = {"n_pos": F.count_if(is_pos()), "n_neg": F.count_if(~is_pos()), "example": F.min(F.when(is_pos(), F.col("doc_id")))}
    counted = terms.grown_ngrams(t, "doc_id", doc_tokens(), sums, carry=["label"])
    out = terms.domain_terms(counted, *terms.class_sizes(t, is_pos()))
    shown = t.select(F.col("doc_id").alias("example"), F.col("text").alias("example_text"))
    out = out.join(shown, "example", "left")
    return out.select("term", "n_pos", "n_neg", "n_words", "example", "example_text", r(F.col("score")).alias("score"))


@query(
    "x8_class_share_ratio",
    f"""WITH {TFIDF}, s AS (SELECT term, sum(CASE WHEN label = 'engenharia' THEN weight ELSE 0 END) AS sa, sum(CASE WHEN label = 'obras' THEN weight ELSE 0 END) AS sb FROM wt JOIN texts USING (doc_id) GROUP BY 1),
    m AS (SELECT sum(sa) AS ma, sum(sb) AS mb, count(*) AS n FROM s)
    SELECT term, {R('ln(((sa + 0.5) / (ma + 0.5 * n)) / ((sb + 0.5) / (mb + 0.5 * n)))')} AS log_ratio FROM s, m""",
)
def x8(spark, d):
    out = terms.class_share_ratio(weights(spark, d, ["label"]), texts(spark, d), "doc_id", "label", "engenharia", "obras")
    return out.withColumn("log_ratio", r(F.col("log_ratio")))


@query(
    "x9_class_descriptors",
    f"""WITH {TFIDF}, s AS (SELECT label, term, sum(weight) AS mass FROM wt JOIN texts USING (doc_id) GROUP BY 1, 2)
    SELECT label, term, {R('mass')} AS mass FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(mass, 9) DESC, term) <= 8""",
)
def x9(spark, d):
    return terms.top_terms(weights(spark, d, ["label"]), texts(spark, d), "doc_id", "label").withColumn("mass", r(F.col("mass")))


@query(
    "x10_keyword_table",
    f"""WITH {PRESENCE} SELECT term, n_pos, n_neg, {R('100 * n_pos / a')} AS pct_pos, {R('100 * n_neg / b')} AS pct_neg,
    CASE WHEN n_neg > 0 THEN {R('(100 * n_pos / a) / (100 * n_neg / b)')} END AS lift FROM cn, nn WHERE term IN ({sql_list(CORPUS_KEYWORDS)})""",
)
def x10(spark, d):
    t = texts(spark, d)
    presence = terms.presence_table(t, "doc_id", doc_tokens(), carry=["label"])
    out = terms.keyword_table(presence, CORPUS_KEYWORDS, is_pos(), *terms.class_sizes(t, is_pos()))
    return out.select("term", "n_pos", "n_neg", *[r(F.col(c)).alias(c) for c in ("pct_pos", "pct_neg", "lift")])


@query(
    "x11_zipf_by_class",
    f"""WITH {WORDS}, c AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest(k) AS term FROM tk) GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS rnk FROM c QUALIFY rnk <= 200)
    SELECT label, term, n, CAST(rnk AS INTEGER) AS rnk, {R('regr_slope(ln(n), ln(rnk)) OVER (PARTITION BY label)')} AS slope FROM k""",
)
def x11(spark, d):
    out = terms.zipf(terms.term_table(texts(spark, d), "doc_id", doc_tokens(), carry=["label"]), ["label"], 200)
    return out.withColumn("slope", r(F.col("slope")))


@query("x12_lda_topics")
def x12(spark, d):
    return topics.lda_topics(texts(spark, d), "doc_id", doc_tokens(), is_pos(), k=8, rounds=10)


@query("x13_nmf_topics")
def x13(spark, d):
    return topics.nmf_topics(weights(spark, d), "doc_id", k=8)


@query(
    "x14_duplicate_texts",
    f"""WITH k AS (SELECT doc_id, source, md5(trim(regexp_replace({COMPAT_SQL}, '[^a-z0-9]+', ' ', 'g'))) AS text_key FROM documents)
    SELECT text_key, count(*) AS n_rows, count(DISTINCT source) AS n_agencies, min(doc_id) AS first_id FROM k GROUP BY 1 HAVING count(*) > 1""",
)
def x14(spark, d):
    return terms.duplicate_texts(table(spark, d, "documents"), "doc_id", F.col("text"), "source")


@query("x15_text_vectors")
def x15(spark, d):
    return features.text_vectors(texts(spark, d), "doc_id", doc_tokens())
