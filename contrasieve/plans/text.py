"""Queries on text functions (T1-T20) and the triage flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrasieve.config import vocab
from contrasieve.functions import text as tx
from contrasieve.functions import vector as vx
from contrasieve.plans.registry import query, table
from contrasieve.plans.standin import (
    CORPUS_FAMILIES, CORPUS_KEYWORDS, CORPUS_OBVIOUS, CORPUS_PREFIXES, CORPUS_TERMS, R, r,
)


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP_T = sql_list(sorted({tx.fold_word(w) for w in vocab.STOPWORDS_TOKEN}))
STOP_C = sql_list(sorted({tx.fold_word(w) for w in vocab.STOPWORDS_CLEAN}))
FOLD_SQL = "strip_accents(lower(text))"
COMPAT_SQL = "strip_accents(lower(translate(text, 'ºª²³¹', 'oa231')))"
CLEAN_SQL = (
    f"array_to_string(list_filter(string_split(trim(regexp_replace({COMPAT_SQL}, '[^a-z0-9]+', ' ', 'g')), ' '), "
    f"lambda w: length(w) > 2 AND w NOT IN ({STOP_C})), ' ')"
)
TOKENS_SQL = f"list_filter(regexp_extract_all({FOLD_SQL}, '[a-z]{{3,}}'), lambda w: w NOT IN ({STOP_T}))"


def docs(spark, d):
    return table(spark, d, "documents")


@query("t1_fold", f"SELECT doc_id, md5({FOLD_SQL}) AS folded FROM documents")
def t1(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.fold(F.col("text"))).alias("folded"))


@query("t2_clean", f"SELECT doc_id, {CLEAN_SQL} AS cleaned FROM documents")
def t2(spark, d):
    return docs(spark, d).select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query("t3_tokens", f"SELECT doc_id, array_to_string({TOKENS_SQL}, ' ') AS tokens FROM documents")
def t3(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(tx.tokens(F.col("text")), " ").alias("tokens"))


def _strip_sql(rounds=3):
    out = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
    for _ in range(rounds):
        for p in CORPUS_PREFIXES:
            out = f"regexp_replace({out}, '(?i){p}', '')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("t4_strip_boilerplate", f"SELECT conv_id, turn, {_strip_sql()} AS stripped FROM conversations")
def t4(spark, d):
    stripped = tx.strip_boilerplate(F.col("text"), CORPUS_PREFIXES)
    return table(spark, d, "conversations").select("conv_id", "turn", stripped.alias("stripped"))


@query(
    "t5_text_key",
    f"SELECT doc_id, trim(regexp_replace({COMPAT_SQL}, '[^a-z0-9]+', ' ', 'g')) AS text_key FROM documents",
)
def t5(spark, d):
    return docs(spark, d).select("doc_id", tx.text_key(F.col("text")).alias("text_key"))


@query(
    "t6_ngrams",
    f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS k FROM documents),
    g AS (SELECT doc_id, unnest(k) AS gram, 1 AS n FROM t
      UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i+1])), 2 FROM t
      UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(k)-1), lambda i: k[i] || ' ' || k[i+1] || ' ' || k[i+2])), 3 FROM t
      UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(k)-2), lambda i: k[i] || ' ' || k[i+1] || ' ' || k[i+2] || ' ' || k[i+3])), 4 FROM t)
    SELECT doc_id, CAST(n AS INTEGER) AS n, count(*) AS grams, count(DISTINCT gram) AS distinct_grams FROM g GROUP BY 1, 2""",
)
def t6(spark, d):
    words = docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("k"))
    arrays = words.select("doc_id", *[tx.ngrams(F.col("k"), n, n).alias(f"g{n}") for n in range(1, 5)])
    sizes = [
        F.struct(F.lit(n).alias("n"), F.size(f"g{n}").cast("long").alias("grams"), F.size(F.array_distinct(f"g{n}")).cast("long").alias("distinct_grams"))
        for n in range(1, 5)
    ]
    return arrays.select("doc_id", F.inline(F.array(*sizes))).filter("grams > 0")


@query(
    "t7_token_stats",
    f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS k FROM documents)
    SELECT doc_id, CAST(len(k) AS INTEGER) AS n_tokens, CAST(len(list_distinct(k)) AS INTEGER) AS n_distinct,
           {R("len(list_distinct(k)) / greatest(len(k), 1)::DOUBLE")} AS ttr FROM t""",
)
def t7(spark, d):
    t = docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("k"))
    return t.select(
        "doc_id",
        F.size("k").alias("n_tokens"),
        F.size(F.array_distinct("k")).alias("n_distinct"),
        r(tx.type_token_ratio(F.col("k"))).alias("ttr"),
    )


@query(
    "t8_keyword_overlap",
    f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS k FROM documents)
    SELECT doc_id, CAST(len(list_distinct(list_filter(k, lambda w: w IN ({sql_list(CORPUS_KEYWORDS)})))) AS INTEGER) AS overlap FROM t""",
)
def t8(spark, d):
    overlap = tx.keyword_overlap(tx.tokens(F.col("text")), CORPUS_KEYWORDS)
    return docs(spark, d).select("doc_id", overlap.alias("overlap"))


def _term_sum(col, whole=False):
    if whole:
        return " + ".join(f"contains(' ' || {col} || ' ', ' {t} ')::INTEGER" for t in CORPUS_TERMS)
    return " + ".join(f"contains({col}, '{t}')::INTEGER" for t in CORPUS_TERMS)


@query(
    "t9_domain_terms",
    f"""WITH t AS (SELECT doc_id, {CLEAN_SQL} AS c FROM documents)
    SELECT doc_id, {_term_sum("c")} AS n_terms, {_term_sum("c", True)} AS n_whole_terms FROM t""",
)
def t9(spark, d):
    t = docs(spark, d).select("doc_id", tx.clean(F.col("text")).alias("c"))
    return t.select(
        "doc_id",
        tx.domain_term_count(F.col("c"), CORPUS_TERMS).alias("n_terms"),
        tx.domain_term_count(F.col("c"), CORPUS_TERMS, whole_word=True).alias("n_whole_terms"),
    )


@query(
    "t10_normalise_document",
    r"""SELECT doc_id, md5(regexp_replace(
          array_to_string(list_transform(regexp_extract_all(regexp_replace(text, '-\s*\n\s*', '', 'g'), '\n+|[^\n]+'),
            lambda p: CASE WHEN p = chr(10) THEN ' ' ELSE p END), ''), '[ \t]+', ' ', 'g')) AS x FROM documents""",
)
def t10(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.normalise_document(F.col("text"))).alias("x"))


def _count_sql(patterns):
    return " + ".join(f"len(regexp_extract_all(f, '(?i){p}'))" for p in patterns)


MARKERS_SQL = ", ".join(f"CAST({_count_sql(ps)} AS INTEGER) AS mk_{n.lower()}" for n, ps in CORPUS_FAMILIES.items())


def markers(spark, d):
    """Marker counts and score over folded text, on documents."""
    base = docs(spark, d).select("doc_id", tx.fold(F.col("text")).alias("f"))
    families = {k.lower(): v for k, v in CORPUS_FAMILIES.items()}
    counted = base.select("doc_id", "f", *tx.marker_columns(F.col("f"), families, flags="(?i)"))
    return counted.withColumn("mk_score", tx.marker_score(families))


@query(
    "t11_markers",
    f"""WITH b AS (SELECT doc_id, {FOLD_SQL} AS f FROM documents), m AS (SELECT doc_id, {MARKERS_SQL} FROM b)
    SELECT *, (mk_definite > 0)::INT + (mk_link > 0)::INT + (mk_prep > 0)::INT + (mk_rare > 0)::INT AS mk_score FROM m""",
)
def t11(spark, d):
    return markers(spark, d).drop("f")


OBVIOUS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(f, '(?i){p}') THEN '{p}'" for p in CORPUS_OBVIOUS) + " END"


@query(
    "t12_obvious_pattern",
    f"WITH b AS (SELECT doc_id, {FOLD_SQL} AS f FROM documents) SELECT doc_id, {OBVIOUS_SQL} AS pattern FROM b",
)
def t12(spark, d):
    return docs(spark, d).select("doc_id", tx.first_pattern(tx.fold(F.col("text")), CORPUS_OBVIOUS).alias("pattern"))


NAME_PATTERNS = [r"\brings?\b", r"\bwidgets?\b", r"\bsmall\b"]


@query(
    "t13_name_hint",
    "SELECT p_partkey, regexp_matches(strip_accents(lower(p_name)), '\\brings?\\b|\\bwidgets?\\b|\\bsmall\\b') AS hint FROM part",
)
def t13(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.has_any(tx.fold(F.col("p_name")), NAME_PATTERNS).alias("hint"))


NATURE_SPECIAL = ["inter", "struct", "thing"]
NATURE_COMMON = ["tion of", "der "]


@query(
    "t14_work_nature",
    """WITH b AS (SELECT doc_id, strip_accents(lower(text)) AS f FROM documents) SELECT doc_id, CASE WHEN contains(f, 'inter') OR contains(f, 'struct') OR contains(f, 'thing')
       THEN 'obra_ou_especial' WHEN contains(f, 'tion of') OR contains(f, 'der ') THEN 'comum'
       ELSE 'indeterminado' END AS nature FROM b""",
)
def t14(spark, d):
    return docs(spark, d).select("doc_id", tx.work_nature(F.col("text"), NATURE_SPECIAL, NATURE_COMMON).alias("nature"))


EXCERPT_PATTERNS = [r"\bof\s+the\b", r"\bund\s+der\b", r"\bthis\b"]


def _excerpt_sql():
    steps = ["s0 AS (SELECT doc_id, f, length(f) AS n, [[0, 1200]] AS used, substr(f, 1, 1200) AS out,"
             " least(length(f), 1200) AS size, false AS over_ FROM b)"]
    for i, p in enumerate(EXCERPT_PATTERNS, 1):
        steps.append(
            f"""h{i} AS (SELECT *, CASE WHEN regexp_matches(f, '(?i){p}') THEN length(regexp_extract(f, '(?is)^(.*?)(?:{p})', 1)) END AS a0,
                 length(regexp_extract(f, '(?i){p}')) AS m FROM s{i-1}),
            g{i} AS (SELECT *, greatest(0, a0 - 400) AS a, least(n, a0 + m + 400) AS z FROM h{i}),
            t{i} AS (SELECT *, a0 IS NOT NULL AND NOT over_ AND len(list_filter(used, lambda u: a < u[2] AND z > u[1])) = 0 AS ok FROM g{i}),
            s{i} AS (SELECT doc_id, f, n, CASE WHEN ok THEN list_append(used, [a, z]) ELSE used END AS used,
               CASE WHEN ok THEN out || chr(10) || '[...] ' || substr(f, a + 1, z - a) ELSE out END AS out,
               CASE WHEN ok THEN size + 6 + z - a ELSE size END AS size,
               CASE WHEN ok THEN size + 6 + z - a > 5000 ELSE over_ END AS over_ FROM t{i})"""
        )
    return (f"WITH b AS (SELECT doc_id, {FOLD_SQL} AS f FROM documents), " + ", ".join(steps)
            + f" SELECT doc_id, md5(substr(out, 1, 5000)) AS excerpt FROM s{len(EXCERPT_PATTERNS)}")


@query("t15_excerpts", _excerpt_sql())
def t15(spark, d):
    base = docs(spark, d).select("doc_id", tx.fold(F.col("text")).alias("f"))
    return base.select("doc_id", F.md5(tx.evidence_excerpts(F.col("f"), EXCERPT_PATTERNS)).alias("excerpt"))


@query(
    "t16_json_from_text",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events""",
)
def t16(spark, d):
    props = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.translate("props", '"', "'"))
    answer = F.when(F.col("event_id") % 5 == 0, "no json here").otherwise(
        F.concat(F.lit("Answer:\n"), props, F.lit(" - end"))
    )
    parsed = tx.json_from_text(answer, "k INT")
    return table(spark, d, "events").select("event_id", F.coalesce(parsed["k"], F.lit(-1)).alias("k"))


@query(
    "t17_verdict_value",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'sim' WHEN 'view' THEN 'nao' WHEN 'error' THEN 'parcial' ELSE '' END AS verdict
       FROM events""",
)
def t17(spark, d):
    spoken = (
        F.when(F.col("event_type") == "click", " Sim ")
        .when(F.col("event_type") == "view", "NÃO")
        .when(F.col("event_type") == "error", "parcial")
        .otherwise(F.col("event_type"))
    )
    return table(spark, d, "events").select("event_id", tx.normalise_verdict(spoken).alias("verdict"))


@query(
    "t18_report_text",
    """SELECT o_orderkey, 'Contrato ' || o_orderkey || ' | ' || o_orderpriority || ' | R$ ' ||
       translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS line FROM orders""",
)
def t18(spark, d):
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("Contrato "), F.col("o_orderkey")),
        F.col("o_orderpriority"),
        tx.money_br(F.col("o_totalprice")),
    )
    return table(spark, d, "orders").select("o_orderkey", line.alias("line"))


def _stem_sql(w):
    for p, s in tx.STEM_RULES:
        w = f"regexp_replace({w}, '{p}', '{s.replace('$', chr(92))}')"
    return w


@query(
    "t19_stem",
    f"""WITH w AS (SELECT unnest({TOKENS_SQL}) AS word FROM documents)
    SELECT word, {_stem_sql("word")} AS stem, count(*) AS n FROM w GROUP BY 1, 2""",
)
def t19(spark, d):
    words = docs(spark, d).select(F.explode(tx.tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", tx.stem(F.col("word")).alias("stem"), "n")


@query(
    "t20_cosine",
    f"""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, {R("list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)))")} AS cosine,
      {R("sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))")} AS norm FROM embeddings, q""",
)
def t20(spark, d):
    e = table(spark, d, "embeddings")
    probe = e.filter("vec_id = 0").select("embedding").scalar()
    return e.withColumn("probe", probe).select(
        "vec_id",
        r(vx.cosine(F.col("embedding"), F.col("probe"))).alias("cosine"),
        r(vx.l2_norm(F.col("embedding"))).alias("norm"),
    )
