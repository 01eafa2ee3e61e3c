"""Counts of words, symbols, repeated lines and repeated five-word windows of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasieve.llm._scan import Rolling, mix, raw, slices, spare_memory, word_hashes, words

_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def _again(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member whether its (text, value) came before, and whether it comes twice at all."""
    order = np.argsort(mix(value + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = (value[order][1:] == value[order][:-1]) & (text[order][1:] == text[order][:-1])
    before, twice = np.zeros(len(order), bool), np.zeros(len(order), bool)
    before[order] = same
    twice[order] = same | np.append(same[1:], False) if len(order) else same
    return before, twice


def counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    begin, end, first_word = words(data, bounds)
    n_texts = len(bounds) - 1
    out = {"n_words": np.diff(first_word)}
    solid = np.zeros(len(data) + 1, np.int32)
    solid[begin] += 1
    np.subtract.at(solid, end, 1)
    solid = np.cumsum(solid)[:-1] > 0
    out["word_chars"] = _per_text(solid & ((data & 0xC0) != 0x80), bounds)
    out["n_symbols"] = _per_text(_SYMBOLS[data], bounds)
    # lines: every text begins one, and so does the byte after each \n
    cut = np.flatnonzero(data == 0x0A)
    a = np.sort(np.concatenate([bounds[:-1], cut + 1]), kind="stable")
    text = np.empty(len(a), np.int64)
    starts = np.concatenate([bounds[:-1], cut + 1])
    owner = np.concatenate([np.arange(n_texts), np.searchsorted(bounds, cut, "right") - 1])
    order = np.lexsort((starts, owner))
    a, text = starts[order], owner[order]
    b = np.append(a[1:] - 1, len(data))
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    b[last] = bounds[1:][text[last]]
    has_word = np.searchsorted(begin, b) > np.searchsorted(begin, a)
    a, b, text = a[has_word], b[has_word], text[has_word]
    before, _ = _again(text, mix(Rolling(data).of(a, b) + (b - a).astype(np.uint64)))
    out["n_dup_lines"] = np.bincount(text[before], minlength=n_texts)
    repeat = np.zeros(n_texts, np.int64)
    if len(begin) >= WINDOW:
        window = mix(Rolling(word_hashes(data, begin, end)).every(WINDOW))
        owner = np.repeat(np.arange(n_texts), np.diff(first_word))
        inside = np.flatnonzero(owner[: len(window)] == owner[WINDOW - 1 :])
        _, twice = _again(owner[inside], window[inside])
        hit = inside[twice]
        mark = np.zeros(len(begin), bool)
        for k in range(WINDOW):
            mark[hit + k] = True
        repeat = np.bincount(owner[mark], minlength=n_texts)
    out["n_repeat_words"] = repeat
    return out


def with_counts(docs: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """``others`` under their own names after id_col, and the five counts of each text."""
    fields = [docs.schema[c] for c in (id_col, *others)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        for batch in batches:
            for part in slices(batch, "__text"):
                found = counts(*raw(part["__text"]))
                own = [part.column(i) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], [*(f.name for f in fields), *COUNTS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} bigint" for c in COUNTS)])
    return docs.select(id_col, *others, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


__all__ = ["COUNTS", "counts", "with_counts"]
