"""Decision tables: from many weak signals to one outcome per contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasieve.config import vocab
from contrasieve.operators.pairs import keep_best


def _flag(col: Column) -> Column:
    return F.coalesce(col.cast("boolean"), F.lit(False))


def triage(label: Column, obvious: Column, n_families: Column, limit: int = 2) -> Column:
    """Outcome from label, obvious wording and the number of procedure markers."""
    followed = F.coalesce(n_families, F.lit(0)) >= limit
    return (
        F.when(label != vocab.UNLABELLED, "fora_escopo")
        .when(_flag(obvious) & followed, "rotulacao_incorreta_processo_ok")
        .when(_flag(obvious), "subenquadramento_real")
        .otherwise("ambiguo")
    )


def modality_verdict(nature: Column, modality: Column) -> Column:
    auction = modality.isin(*vocab.MODALITY_AUCTION)
    return (
        F.when(modality.isNull(), "modalidade_desconhecida")
        .when(auction & (nature == "obra_ou_especial"), "pregao_em_obra")
        .when(auction & (nature == "comum"), "pregao_em_comum_ok")
        .when(auction, "pregao_natureza_indet")
        .when(modality.isin(*vocab.MODALITY_COMPETITION), "concorrencia_ok")
        .when(modality.isin(*vocab.MODALITY_DIALOGUE), "dialogo_competitivo")
        .otherwise("outra_modalidade")
    )


def criterion_verdict(modality: Column, criterion: Column) -> Column:
    return (
        F.when(modality.isNull() | criterion.isNull(), "criterio_ou_modalidade_desconhecida")
        .when(
            modality.isin(*vocab.MODALITY_AUCTION) & criterion.isin(*vocab.CRITERIA_AUCTION), "criterio_ok_pregao"
        )
        .when(
            modality.isin(*vocab.MODALITY_COMPETITION) & criterion.isin(*vocab.CRITERIA_COMPETITION),
            "criterio_ok_concorrencia",
        )
        .otherwise("criterio_inadequado")
    )


def rigour_score(modality_state: Column, criterion_state: Column, has_project: Column, n_markers: Column) -> Column:
    """Positive when the procedure was too light for the object, negative when it was observed."""
    evidence = F.when(_flag(has_project), -2).when(F.coalesce(n_markers, F.lit(0)) >= 3, -1).otherwise(0)
    return (
        F.when(modality_state == "pregao_em_obra", 2).otherwise(0)
        + F.when(criterion_state == "criterio_inadequado", 1).otherwise(0)
        + F.when(modality_state.isin("concorrencia_ok", "dialogo_competitivo", "pregao_em_comum_ok"), -1).otherwise(0)
        + evidence
    )


# Short interpretation texts of the rigour table.
MODALITY_TEXT = {
    "pregao_em_obra": "⚠ Pregão usado para objeto com indicativos de obra/eng. especial (art. 29 § único veda)",
    "pregao_em_comum_ok": "✓ Pregão admissível p/ serv. comum de eng.",
    "concorrencia_ok": "✓ Concorrência (compatível c/ qualquer engenharia)",
    "dialogo_competitivo": "✓ Diálogo competitivo (caso especial)",
    "modalidade_desconhecida": "? Modalidade não disponível nos dados",
}
NO_SIGNAL_TEXT = "Sem sinais conclusivos — enriquecer com modalidade/critério ou PDFs"


def rigour_text(modality_state: Column, criterion_state: Column, criterion_name: Column, has_project: Column, n_markers: Column) -> Column:
    pairs = [F.lit(x) for kv in MODALITY_TEXT.items() for x in kv]
    about_criterion = F.when(
        criterion_state == "criterio_inadequado",
        F.concat(F.lit("⚠ Critério "), F.coalesce(criterion_name, F.lit("?")), F.lit(" incompatível com a modalidade")),
    )
    about_documents = F.when(_flag(has_project), "📄 PDFs com Projeto Básico/ART — rito de eng. observado").when(
        F.coalesce(n_markers, F.lit(0)) >= 3, "📄 Diversos marcadores de engenharia nos PDFs"
    )
    text = F.concat_ws(" | ", F.element_at(F.create_map(*pairs), modality_state), about_criterion, about_documents)
    return F.when(text == "", NO_SIGNAL_TEXT).otherwise(text)


def scope_change(label: Column, n_families: Column, limit: int = 2) -> Column:
    """A general contract whose amendment carries engineering markers."""
    return (label == vocab.UNLABELLED) & (F.coalesce(n_families, F.lit(0)) >= limit)


def verdict_points_out(verdict: Column, confidence: Column, limit: float = 0.6) -> Column:
    return _flag(verdict.isin(*vocab.POSITIVE_LABELS) & (confidence >= limit))


def count_flags(flags: Sequence[Column]) -> Column:
    total = F.lit(0)
    for flag in flags:
        total = total + _flag(flag).cast("int")
    return total


def ambiguous_verdict(outcome: Column, n_signals: Column) -> Column:
    decided = F.when(n_signals >= 2, "subenquadramento_provavel_ml").otherwise("provavel_geral_real")
    return F.when(outcome == "ambiguo", decided).otherwise(outcome)


def procedure_verdict(
    has_purchase: Column, n_documents: Column, n_chars: Column, n_markers: Column, verdict: Column, second_check: Column
) -> Column:
    """Outcome of the document check of one purchase.

    Two markers settle the case without a reader; a silent reader sends it to review; a
    negative reading must be confirmed by the second check.
    """
    return (
        F.when(~_flag(has_purchase), "indeterminado_sem_compra")
        .when(F.coalesce(n_documents, F.lit(0)) == 0, "indeterminado_sem_documento")
        .when(F.coalesce(n_chars, F.lit(0)) < 300, "indeterminado_pdf_ilegivel")
        .when((F.coalesce(n_markers, F.lit(0)) >= 2) | (verdict == "sim"), "rotulacao_incorreta_processo_ok")
        .when((verdict == "parcial") | (F.coalesce(verdict, F.lit("")) == ""), "rito_parcial")
        .when(_flag(second_check), "rito_parcial")
        .otherwise("subenquadramento_real")
    )


def reapply_verdict(current: Column, n_markers: Column, verdict: Column) -> Column:
    """Bring stored outcomes in line with the present rules; only two outcomes are looked at again.

    A confirmed violation falls to review if the reader said ``parcial``, and counts as unread if the answer is none
    of the three. Unread cases are in order with two markers or a ``sim``, and go to review otherwise.
    """
    answer = F.lower(F.trim(F.coalesce(verdict, F.lit(""))))
    answer = F.when(answer == "não", "nao").otherwise(answer)
    violation = current == "subenquadramento_real"
    unread = (current == "indeterminado_llm_falhou") | (violation & ~answer.isin("sim", "nao", "parcial"))
    in_order = (F.coalesce(n_markers, F.lit(0)) >= 2) | (answer == "sim")
    return (
        F.when(unread & in_order, "rotulacao_incorreta_processo_ok")
        .when(unread | (violation & (answer == "parcial")), "rito_parcial")
        .otherwise(current)
    )


def verdict_queue(df: DataFrame, judged: DataFrame, text_key: str, key: str, score: str, suspicion: str, limit: float) -> DataFrame:
    """Suspects whose text has no verdict yet, one per text, most suspicious first."""
    open_rows = df.filter(F.col(score) >= limit).join(judged.select(text_key).distinct(), text_key, "left_anti")
    return keep_best(open_rows, [text_key], suspicion, key).orderBy(F.desc(suspicion), key)


def funnel(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """(position, step, n) from one pass of conditional counts."""
    one = df.agg(*[F.count_if(c).alias(n) for n, c in steps.items()])
    long = one.unpivot([], list(steps), "step", "n")
    order = {n: i for i, n in enumerate(steps)}
    pairs = [F.lit(x) for kv in order.items() for x in kv]
    return long.select(F.element_at(F.create_map(*pairs), F.col("step")).alias("position"), "step", "n")


# States of a case and what each event does.
CASE_STATES = (
    "referencia", "baixa", "novo", "triagem_nao", "aguarda_rito", "rito_seguido", "subenq_real", "rito_indeterminado",
)
EVENT_STATES = {
    "triagem_sim": "aguarda_rito",
    "triagem_nao": "triagem_nao",
    "rito_sim": "rito_seguido",
    "rito_nao": "subenq_real",
    "rito_ilegivel": "rito_indeterminado",
}


def initial_state(category: Column, score: Column, limit: float = 0.6) -> Column:
    return (
        F.when(category.isin(*vocab.POSITIVE_LABELS), "referencia")
        .when(F.coalesce(score, F.lit(0.0)) >= limit, "novo")
        .otherwise("baixa")
    )


def latest_state(events: DataFrame, case: str, event: str, ts: str, tie: str) -> DataFrame:
    """State of each case after its last event."""
    pairs = [F.lit(x) for kv in EVENT_STATES.items() for x in kv]
    known = events.withColumn("_to", F.element_at(F.create_map(*pairs), F.col(event))).filter(F.col("_to").isNotNull())
    return known.groupBy(case).agg(F.max_by("_to", F.struct(ts, tie)).alias("state"), F.count("*").alias("n_events"))


def suggested_verdict(score: Column) -> Column:
    return F.when(score >= 2, "alto_risco").when(score == 1, "indicios").otherwise("baixo_risco")
