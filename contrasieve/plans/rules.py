"""Queries on decision rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrasieve.functions import clean as cl
from contrasieve.functions import text as tx
from contrasieve.operators import joins, metrics, neighbours, pairs, rules
from contrasieve.plans.aggregates import CODE, coded
from contrasieve.plans.registry import query, table
from contrasieve.plans.standin import (
    CORPUS_FAMILIES, CORPUS_OBVIOUS, FACT, FACT_AGENCY, R, SCORE, TEXTS, fact, fact_agency, r, score, texts,
)
from contrasieve.plans.text import COMPAT_SQL, FOLD_SQL, MARKERS_SQL, OBVIOUS_SQL
from contrasieve.session import cut_lineage

def is_geral():
    return F.col("label") == "geral"


TRIAGED = f"""b AS (SELECT doc_id, label, {FOLD_SQL} AS f FROM texts), m AS (SELECT doc_id, label, f, {MARKERS_SQL}, {OBVIOUS_SQL} AS pattern FROM b),
  s AS (SELECT doc_id, label, pattern, (mk_definite > 0)::INT + (mk_link > 0)::INT + (mk_prep > 0)::INT + (mk_rare > 0)::INT AS mk_score FROM m),
  tri AS (SELECT *, CASE WHEN label <> 'geral' THEN 'fora_escopo' WHEN pattern IS NOT NULL AND mk_score >= 2 THEN 'rotulacao_incorreta_processo_ok'
    WHEN pattern IS NOT NULL THEN 'subenquadramento_real' ELSE 'ambiguo' END AS outcome FROM s)"""


def triaged(spark, d):
    """Texts with obvious pattern, number of marker families and triage outcome; one pass, no shuffle but the label join."""
    fams = {k.lower(): v for k, v in CORPUS_FAMILIES.items()}
    folded = texts(spark, d).select("doc_id", "label", tx.fold(F.col("text")).alias("f"))
    marked = folded.select(
        "doc_id", "label", tx.first_pattern(F.col("f"), CORPUS_OBVIOUS).alias("pattern"),
        *tx.marker_columns(F.col("f"), fams, flags="(?i)"),
    )
    scored_ = marked.select("doc_id", "label", "pattern", tx.marker_score(fams).alias("mk_score"))
    return scored_.withColumn("outcome", rules.triage(F.col("label"), F.col("pattern").isNotNull(), F.col("mk_score")))


@query("r1_triage", f"WITH {TEXTS}, {TRIAGED} SELECT doc_id, label, pattern, mk_score, outcome FROM tri")
def r1(spark, d):
    # A range sort reads its input twice (sampling, then sorting): the texts are matched once.
    return pairs.ranked(cut_lineage(triaged(spark, d)), ["mk_score"], "doc_id")


@query(
    "r1_triage_summary",
    f"""WITH {TEXTS}, {TRIAGED}, p AS (SELECT pattern, count(*) AS n FROM tri WHERE label = 'geral' AND pattern IS NOT NULL GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10)
    SELECT 'outcome' AS kind, outcome AS name, count(*) AS n FROM tri GROUP BY 2 UNION ALL SELECT 'pattern', pattern, n FROM p""",
)
def r1s(spark, d):
    t = cut_lineage(triaged(spark, d))
    counts = t.groupBy(F.lit("outcome").alias("kind"), F.col("outcome").alias("name")).agg(F.count("*").alias("n"))
    top = t.filter(is_geral() & F.col("pattern").isNotNull()).groupBy(F.lit("pattern").alias("kind"), F.col("pattern").alias("name"))
    return counts.unionByName(top.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10))


@query("r2_to_model", f"WITH {TEXTS}, {TRIAGED} SELECT doc_id FROM tri WHERE outcome = 'ambiguo'")
def r2(spark, d):
    return triaged(spark, d).filter("outcome = 'ambiguo'").select("doc_id")


# Modality and criterion codes come from quantity and tax, nature from the supplier's part.
R3_SQL = """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity <= 40 THEN CAST(l_quantity AS INTEGER) % 9 END AS modality,
    CASE WHEN l_tax < 0.08 THEN CAST(round(l_tax * 100) AS INTEGER) + 1 END AS criterion, CASE WHEN p_type = 'PROMO' THEN 'obra_ou_especial' WHEN p_type IN ('SMALL', 'LARGE') THEN 'comum' ELSE 'indeterminado' END AS nature,
    l_linestatus = 'F' AND l_discount > 0.05 AS has_project, CAST(round(l_discount * 100) AS INTEGER) AS n_markers FROM lineitem JOIN part ON l_partkey = p_partkey),
  v AS (SELECT *, CASE WHEN modality IS NULL THEN 'modalidade_desconhecida' WHEN modality IN (6, 7) THEN CASE nature WHEN 'obra_ou_especial' THEN 'pregao_em_obra' WHEN 'comum' THEN 'pregao_em_comum_ok' ELSE 'pregao_natureza_indet' END
      WHEN modality IN (4, 5) THEN 'concorrencia_ok' WHEN modality = 2 THEN 'dialogo_competitivo' ELSE 'outra_modalidade' END AS m,
    CASE WHEN modality IS NULL OR criterion IS NULL THEN 'criterio_ou_modalidade_desconhecida' WHEN modality IN (6, 7) AND criterion IN (1, 2) THEN 'criterio_ok_pregao'
      WHEN modality IN (4, 5) AND criterion IN (1, 2, 4, 6, 8) THEN 'criterio_ok_concorrencia' ELSE 'criterio_inadequado' END AS c FROM c),
  s AS (SELECT *, CASE WHEN m = 'pregao_em_obra' THEN 2 ELSE 0 END + CASE WHEN c = 'criterio_inadequado' THEN 1 ELSE 0 END
    - CASE WHEN m IN ('concorrencia_ok', 'dialogo_competitivo', 'pregao_em_comum_ok') THEN 1 ELSE 0 END - CASE WHEN has_project THEN 2 WHEN n_markers >= 3 THEN 1 ELSE 0 END AS score FROM v)
  SELECT m AS modality_state, c AS criterion_state, CAST(score AS INTEGER) AS score, count(*) AS n FROM s GROUP BY 1, 2, 3"""


@query("r3_tender_rigour", R3_SQL)
def r3(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = j.select(
        F.when(F.col("l_quantity") <= 40, F.col("l_quantity").cast("int") % 9).alias("modality"),
        F.when(F.col("l_tax") < 0.08, F.round(F.col("l_tax") * 100).cast("int") + 1).alias("criterion"),
        tx.work_nature(F.col("p_type"), ["promo"], ["small", "large"]).alias("nature"),
        ((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.05)).alias("has_project"),
        F.round(F.col("l_discount") * 100).cast("int").alias("n_markers"),
    )
    s = c.withColumn("modality_state", rules.modality_verdict(F.col("nature"), F.col("modality"))).withColumn(
        "criterion_state", rules.criterion_verdict(F.col("modality"), F.col("criterion"))
    )
    total = rules.rigour_score(F.col("modality_state"), F.col("criterion_state"), F.col("has_project"), F.col("n_markers"))
    return s.groupBy("modality_state", "criterion_state", total.alias("score")).agg(F.count("*").alias("n"))


@query(
    "r4_scope_change",
    f"""WITH {FACT}, a AS (SELECT user_id AS supplier, count(DISTINCT event_type) AS fams FROM events WHERE value > 18 GROUP BY 1)
    SELECT id, label = 'geral' AND coalesce(fams, 0) >= 2 AS scope_change FROM fact f LEFT JOIN a ON f.supplier = a.supplier""",
)
def r4(spark, d):
    a = table(spark, d, "events").filter("value > 18").groupBy(F.col("user_id").alias("supplier")).agg(
        F.countDistinct("event_type").alias("fams")
    )
    j = fact(spark, d).join(a, "supplier", "left")
    return j.select("id", rules.scope_change(F.col("label"), F.col("fams")).alias("scope_change"))


CONSOLIDATED = f"""sig AS (SELECT id, label, agency, supplier, status, date, value, {SCORE('id')} AS p, CASE WHEN discount > 0.05 THEN 1 END AS markers, tax > 0.06 AS scope_change, code_eng,
    CASE WHEN qty > 40 THEN 'engenharia' WHEN qty > 35 THEN 'obras' WHEN qty > 20 THEN 'geral' END AS verdict, {SCORE('id', 'c')} AS conf, qty FROM coded),
  con AS (SELECT *, (coalesce(p, 0) > 0.5)::INT + (coalesce(markers, 0) > 0)::INT + coalesce(scope_change, false)::INT + coalesce(code_eng, false)::INT
    + coalesce(verdict IN ('engenharia', 'obras') AND conf >= 0.6, false)::INT AS n_signals FROM sig)"""


def consolidated(spark, d):
    s = coded(spark, d).select(
        "id", "label", "agency", "supplier", "status", "date", "value", "qty", "code_eng",
        score(F.col("id")).alias("p"),
        F.when(F.col("discount") > 0.05, 1).alias("markers"),
        (F.col("tax") > 0.06).alias("scope_change"),
        F.when(F.col("qty") > 40, "engenharia").when(F.col("qty") > 35, "obras").when(F.col("qty") > 20, "geral").alias("verdict"),
        score(F.col("id"), "c").alias("conf"),
    )
    flags = [
        F.col("p") > 0.5, F.coalesce("markers", F.lit(0)) > 0, F.col("scope_change"), F.col("code_eng"),
        rules.verdict_points_out(F.col("verdict"), F.col("conf")),
    ]
    return s.withColumn("n_signals", rules.count_flags(flags))


@query(
    "r5_signal_count",
    f"WITH {CODE}, {CONSOLIDATED} SELECT id, n_signals, {R('p')} AS p FROM (SELECT * FROM con WHERE label = 'geral' ORDER BY n_signals DESC, p DESC, id LIMIT 2000)",
)
def r5(spark, d):
    top = pairs.ranked(consolidated(spark, d).filter(is_geral()), ["n_signals", "p"], "id").limit(2000)
    return top.select("id", "n_signals", r(F.col("p")).alias("p"))


@query(
    "r6_final_verdict",
    f"""WITH {CODE}, {CONSOLIDATED}, o AS (SELECT *, CASE WHEN qty > 30 AND status = 'F' THEN 'rotulacao_incorreta_processo_ok' WHEN qty > 30 THEN 'subenquadramento_real' ELSE 'ambiguo' END AS outcome FROM con WHERE label = 'geral')
    SELECT id, CASE WHEN outcome = 'ambiguo' THEN CASE WHEN n_signals >= 2 THEN 'subenquadramento_provavel_ml' ELSE 'provavel_geral_real' END ELSE outcome END AS verdict FROM o""",
)
def r6(spark, d):
    c = consolidated(spark, d).filter(is_geral())
    outcome = rules.triage(F.col("label"), F.col("qty") > 30, F.when(F.col("status") == "F", 2).otherwise(0))
    return c.select("id", rules.ambiguous_verdict(outcome, F.col("n_signals")).alias("verdict"))


@query(
    "r7_six_methods",
    f"""WITH {CODE}, {CONSOLIDATED}, x AS (SELECT c.id, (c.p > 0.7)::INT + coalesce(k.hint, false)::INT + c.code_eng::INT + (c.qty > 30)::INT + c.scope_change::INT + (k.discount > 0.08)::INT AS n
      FROM con c JOIN coded k ON c.id = k.id WHERE c.label = 'geral')
    SELECT n AS n_signals, count(*) AS n_rows, n >= 2 AS robust2, n >= 3 AS robust3, n >= 4 AS robust4 FROM x WHERE n >= 1 GROUP BY 1""",
)
def r7(spark, d):
    g = coded(spark, d).filter(is_geral()).withColumn("p", score(F.col("id")))
    n = rules.count_flags([F.col("p") > 0.7, F.col("hint"), F.col("code_eng"), F.col("qty") > 30, F.col("tax") > 0.06, F.col("discount") > 0.08])
    c = g.select(n.alias("n_signals")).filter("n_signals >= 1").groupBy("n_signals").agg(F.count("*").alias("n_rows"))
    return c.select("*", *[(F.col("n_signals") >= k).alias(f"robust{k}") for k in (2, 3, 4)])


@query(
    "r9_confidence_bands",
    f"""WITH {CODE}, {CONSOLIDATED} SELECT CASE WHEN n_signals <= 0 THEN 'sem_sinal' WHEN n_signals <= 1 THEN 'fraco_1' WHEN n_signals <= 2 THEN 'moderado_2' ELSE 'forte_3+' END AS band, count(*) AS n
    FROM con WHERE label = 'geral' GROUP BY 1""",
)
def r9(spark, d):
    return consolidated(spark, d).filter(is_geral()).groupBy(cl.confidence_band(F.col("n_signals")).alias("band")).agg(F.count("*").alias("n"))


PROCEDURE = """pr AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus, o_orderdate, o_custkey % 11 <> 0 AS has_purchase, coalesce(n_docs, 0) AS n_docs, coalesce(chars, 0) AS chars, coalesce(mk, 0) AS mk,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'sim' WHEN '2-HIGH' THEN 'parcial' WHEN '3-MEDIUM' THEN '' ELSE 'nao' END AS verdict, o_orderstatus = 'P' AS second FROM orders
    LEFT JOIN (SELECT l_orderkey, count(*) AS n_docs, CAST(sum(l_quantity) * 5 AS BIGINT) AS chars, count(*) FILTER (WHERE l_discount > 0.07) AS mk FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
  rito AS (SELECT *, CASE WHEN NOT has_purchase THEN 'indeterminado_sem_compra' WHEN n_docs = 0 THEN 'indeterminado_sem_documento' WHEN chars < 300 THEN 'indeterminado_pdf_ilegivel'
    WHEN mk >= 2 OR verdict = 'sim' THEN 'rotulacao_incorreta_processo_ok' WHEN verdict IN ('parcial', '') THEN 'rito_parcial' WHEN second THEN 'rito_parcial' ELSE 'subenquadramento_real' END AS outcome FROM pr)"""


def procedure(spark, d):
    """Orders as purchases: line items are documents, quantities their length, priority the reader's verdict."""
    docs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n_docs"), (F.sum("l_quantity") * 5).cast("long").alias("chars"), F.count_if(F.col("l_discount") > 0.07).alias("mk")
    )
    pr = F.col("o_orderpriority")
    verdict = F.when(pr == "1-URGENT", "sim").when(pr == "2-HIGH", "parcial").when(pr == "3-MEDIUM", "").otherwise("nao")
    o = table(spark, d, "orders").join(docs, "o_orderkey", "left").withColumn("verdict", verdict)
    o = o.withColumn("second", F.col("o_orderstatus") == "P").withColumn("has_purchase", F.col("o_custkey") % 11 != 0)
    outcome = rules.procedure_verdict(
        F.col("has_purchase"), F.col("n_docs"), F.col("chars"), F.col("mk"), F.col("verdict"), F.col("second")
    )
    return o.withColumn("outcome", outcome)


@query("r10_procedure_verdict", f"WITH {PROCEDURE} SELECT o_orderkey, outcome FROM rito")
def r10(spark, d):
    return procedure(spark, d).select("o_orderkey", "outcome")


@query(
    "r11_reapply_rules",
    f"""WITH {PROCEDURE}, s AS (SELECT o_orderkey, mk, CASE WHEN o_orderkey % 7 = 0 THEN 'indeterminado_llm_falhou' ELSE outcome END AS cur,
      CASE o_orderkey % 5 WHEN 0 THEN ' Sim' WHEN 1 THEN 'Não' WHEN 2 THEN 'parcial' WHEN 3 THEN 'talvez' END AS said FROM rito),
      n AS (SELECT *, CASE WHEN said = 'Não' THEN 'nao' ELSE trim(lower(coalesce(said, ''))) END AS v FROM s),
      u AS (SELECT *, cur = 'indeterminado_llm_falhou' OR (cur = 'subenquadramento_real' AND v NOT IN ('sim', 'nao', 'parcial')) AS unread FROM n)
    SELECT o_orderkey, CASE WHEN unread AND (coalesce(mk, 0) >= 2 OR v = 'sim') THEN 'rotulacao_incorreta_processo_ok' WHEN unread THEN 'rito_parcial'
      WHEN cur = 'subenquadramento_real' AND v = 'parcial' THEN 'rito_parcial' ELSE cur END AS outcome FROM u""",
)
def r11(spark, d):
    k = F.col("o_orderkey")
    current = F.when(k % 7 == 0, "indeterminado_llm_falhou").otherwise(F.col("outcome"))
    said = F.when(k % 5 == 0, " Sim").when(k % 5 == 1, "Não").when(k % 5 == 2, "parcial").when(k % 5 == 3, "talvez")
    return procedure(spark, d).select("o_orderkey", rules.reapply_verdict(current, F.col("mk"), said).alias("outcome"))


@query(
    "r12_verdict_queue",
    f"""WITH k AS (SELECT doc_id, md5(trim(regexp_replace({COMPAT_SQL}, '[^a-z0-9]+', ' ', 'g'))) AS k, {SCORE('doc_id')} AS p, {SCORE('doc_id', 'u')} AS sus FROM documents),
    j AS (SELECT k FROM k JOIN labels USING (doc_id)) SELECT doc_id, {R('sus')} AS suspicion FROM k WHERE p >= 0.4 AND k NOT IN (SELECT k FROM j)
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY sus DESC, doc_id) = 1""",
)
def r12(spark, d):
    k = table(spark, d, "documents").select(
        "doc_id", F.md5(tx.text_key(F.col("text"))).alias("k"), score(F.col("doc_id")).alias("p"), score(F.col("doc_id"), "u").alias("sus")
    )
    judged = k.join(table(spark, d, "labels"), "doc_id", "left_semi")
    queue = rules.verdict_queue(k, judged, "k", "doc_id", "p", "sus", 0.4)
    return queue.select("doc_id", r(F.col("sus")).alias("suspicion"))


@query(
    "r13_final_table",
    f"WITH {PROCEDURE} SELECT o_orderkey, outcome, o_totalprice AS value, c_name AS agency, c_mktsegment AS kind FROM rito JOIN customer ON o_custkey = c_custkey",
)
def r13(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("agency"), F.col("c_mktsegment").alias("kind"))
    out = procedure(spark, d).join(c, "o_custkey").select("o_orderkey", "outcome", F.col("o_totalprice").alias("value"), "agency", "kind")
    return out.orderBy("outcome", F.desc_nulls_last("value"), "o_orderkey")


@query(
    "r14_manual_confusion",
    f"""WITH {CODE}, {CONSOLIDATED}, m AS (SELECT id, CASE WHEN qty > 33 THEN 'subenq' WHEN qty > 5 THEN 'ok' ELSE 'duv' END AS review, n_signals >= 2 AS pred FROM con WHERE label = 'geral')
    SELECT CASE WHEN review = 'subenq' AND pred THEN 'TP' WHEN pred THEN 'FP' WHEN review = 'subenq' THEN 'FN' ELSE 'TN' END AS cell, count(*) AS n FROM m WHERE review <> 'duv' GROUP BY 1""",
)
def r14(spark, d):
    review = F.when(F.col("qty") > 33, "subenq").when(F.col("qty") > 5, "ok").otherwise("duv")
    m = consolidated(spark, d).filter(is_geral()).withColumn("review", review).filter("review <> 'duv'")
    cell = metrics.error_type(F.col("review") == "subenq", F.col("n_signals") >= 2)
    return m.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


@query(
    "r16_evidence_sheet",
    f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, {SCORE('vec_id')} AS p FROM embeddings), seeds AS (SELECT * FROM v ORDER BY p DESC, vec_id LIMIT 15),
    s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 9) AS sim FROM seeds a, v b WHERE a.vec_id <> b.vec_id),
    k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 5),
    a AS (SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY sim DESC, dst) AS near_ids FROM k GROUP BY 1)
    SELECT vec_id AS id, {R('p')} AS p, near_ids, CASE WHEN label % 4 >= 2 THEN 'alto_risco' WHEN label % 4 = 1 THEN 'indicios' ELSE 'baixo_risco' END AS verdict FROM seeds JOIN a ON vec_id = src""",
)
def r16(spark, d):
    e = table(spark, d, "embeddings").withColumn("p", score(F.col("vec_id")))
    seeds = e.orderBy(F.desc("p"), "vec_id").limit(15)
    near = neighbours.top_matches(e, seeds, "vec_id", "embedding", 5)
    listed = near.groupBy(F.col("src").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "dst"))).alias("l"))
    listed = listed.select("vec_id", F.array_join(F.transform("l", lambda x: x["dst"].cast("string")), ",").alias("near_ids"))
    out = seeds.join(listed, "vec_id")
    return out.select(F.col("vec_id").alias("id"), r(F.col("p")).alias("p"), "near_ids", rules.suggested_verdict(F.col("label") % 4).alias("verdict"))


EVENT_CASE = "CASE event_type WHEN 'click' THEN 'aguarda_rito' WHEN 'view' THEN 'triagem_nao' WHEN 'purchase' THEN 'rito_seguido' WHEN 'error' THEN 'subenq_real' END"


def review_event():
    e = F.col("event_type")
    return F.when(e == "click", "triagem_sim").when(e == "view", "triagem_nao").when(e == "purchase", "rito_sim").when(e == "error", "rito_nao")


@query(
    "r17_case_state",
    f"""WITH e AS (SELECT user_id, {EVENT_CASE} AS s, ts, event_id FROM events), k AS (SELECT * FROM e WHERE s IS NOT NULL)
    SELECT user_id, arg_max(s, (ts, event_id)) AS state, count(*) AS n_events FROM k GROUP BY 1""",
)
def r17(spark, d):
    e = table(spark, d, "events").withColumn("event", review_event())
    return rules.latest_state(e, "user_id", "event", "ts", "event_id")
