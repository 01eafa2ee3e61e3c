"""Column functions that type, repair, label and band contract fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from contrasieve.config import vocab
from contrasieve.functions import text as tx


def label_from_category(category: Column, labels: Mapping[int, str] = vocab.LABEL_BY_CATEGORY) -> Column:
    """Three-way label; codes outside the map become ``outro``."""
    return F.coalesce(lookup(category, labels), F.lit("outro"))


def lookup(code: Column, names: Mapping) -> Column:
    """Literal map lookup, null when the code is unknown."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.element_at(F.create_map(*pairs), code)


def code_name(code: Column, names: Mapping) -> Column:
    """Name of a code; an unknown code shows as itself."""
    return F.coalesce(lookup(code, names), code.cast("string"))


def collapse_label(label: Column, positive: Sequence[str] = vocab.POSITIVE_LABELS, name: str = "engenharia") -> Column:
    return F.when(label.isin(list(positive)), name).otherwise(vocab.UNLABELLED)


def is_positive(label: Column, positive: Sequence[str] = vocab.POSITIVE_LABELS) -> Column:
    return label.isin(list(positive))


def three_class_label(category: Column, text: Column, keywords: Sequence[str] = vocab.SPECIAL_KEYWORDS) -> Column:
    """``geral``, ``eng_especial`` or ``eng_comum`` from the category and special keywords (whole folded words)."""
    tokens = F.split(F.trim(F.regexp_replace(tx.fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    special = F.arrays_overlap(tokens, F.array(*[F.lit(tx.fold_word(k)) for k in keywords]))
    return (
        F.when(category == vocab.CATEGORY_GENERAL, "geral")
        .when(category == vocab.CATEGORY_WORKS, "eng_especial")
        .when((category == vocab.CATEGORY_ENGINEERING) & special, "eng_especial")
        .when(category == vocab.CATEGORY_ENGINEERING, "eng_comum")
    )


def compose_text(first: Column, second: Column) -> Column:
    """``first | second`` without a dangling separator."""
    joined = F.concat(F.coalesce(first, F.lit("")), F.lit(" | "), F.coalesce(second, F.lit("")))
    return F.trim(F.regexp_replace(joined, r"^\s*\|\s*|\s*\|\s*$", ""))


def parse_date(value: Column) -> Column:
    return F.try_to_timestamp(value)


def period(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def parse_number(value: Column, decimal_comma: bool = False) -> Column:
    """Double, or null for text that is not a number and for negative amounts."""
    raw = F.regexp_replace(F.regexp_replace(value, r"\.", ""), ",", ".") if decimal_comma else value
    number = raw.try_cast("double")
    return F.when(number >= 0, number)


def days_between(start: Column, end: Column) -> Column:
    days = F.datediff(end, start)
    return F.when(days >= 0, days)


def control_key_parts(key: Column) -> Column:
    """Struct (cnpj, kind, seq, year) of a ``14 digits-type-seq/year`` key, null if it differs."""
    part = lambda i: F.regexp_extract(key, vocab.CONTROL_KEY_PATTERN, i)
    return F.when(
        key.rlike(vocab.CONTROL_KEY_PATTERN),
        F.struct(
            part(1).alias("cnpj"),
            part(2).try_cast("int").alias("kind"),
            part(3).try_cast("int").alias("seq"),
            part(4).try_cast("int").alias("year"),
        ),
    )


def digits(value: Column, width: int | None = None) -> Column:
    """Digits only, left-padded with zeros but never cut to ``width``."""
    only = F.regexp_replace(value.cast("string"), r"\D", "")
    return F.when(F.length(only) < width, F.lpad(only, width, "0")).otherwise(only) if width else only


def log_value(value: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)))


def band(value: Column, edges: Sequence[float], labels: Sequence[str], low: float | None = None) -> Column:
    """Right-closed bands: ``labels[i]`` for values up to ``edges[i]``, the last label beyond."""
    out = F.when(value < low, None) if low is not None else F.when(value.isNull(), None)
    for edge, label in zip(edges, labels):
        out = out.when(value <= edge, label)
    return out.when(value.isNotNull(), labels[-1])


def money_band(value: Column) -> Column:
    return band(value, vocab.MONEY_EDGES, vocab.MONEY_LABELS, low=0)


def confidence_band(n_signals: Column) -> Column:
    return band(n_signals, vocab.CONFIDENCE_EDGES, vocab.CONFIDENCE_LABELS)


def is_amendment(type_id: Column, type_name: Column) -> Column:
    by_name = tx.contains_any(F.lower(type_name), vocab.AMENDMENT_PHRASES)
    return F.coalesce(type_id == vocab.AMENDMENT_TYPE, F.lit(False)) | by_name


def document_type(type_id: Column, type_name: Column) -> Column:
    """Type id, or the id whose official name equals the given name."""
    by_name = {name.lower(): i for i, name in vocab.DOCUMENT_TYPE_NAMES.items()}
    return F.coalesce(type_id, lookup(F.lower(F.trim(type_name)), by_name))
