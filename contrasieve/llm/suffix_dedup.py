"""Repeated byte strings, found with a logarithmic family of sparse suffix arrays.

The indexed suffixes start at places that their own content chooses: of each ``length`` bytes, where the
24 bytes with the least hash begin (the leftmost of equals). Equal strings choose the same place, so an index
of about one suffix per 39 bytes loses no repeat of ``length`` bytes. Each scan task sorts its suffixes into
batches, its new suffix arrays; per key range they are scanned against the levels before them and merged
geometrically (``_repeats.Family``). Where contents differ around one suffix, the windows are settled one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasieve.llm._keys import KEY, own_keys, with_ids
from contrasieve.llm._repeats import repeated_windows, unpack, windows_of
from contrasieve.llm._scan import NO_ID, Rolling, mix, sliding_min

SEED = 24
_PLACE = np.uint64((1 << 28) - 1)


def suffix_runs(length: int):
    """Runs of windows by their sampled suffix, for ``repeated_windows``."""
    width = length - SEED + 1

    def runs(data: np.ndarray, bounds: np.ndarray):
        n = len(data) - length + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        key = mix(Rolling(data).every(SEED))
        place = np.arange(len(key), dtype=np.uint64)
        at = (sliding_min((key & ~_PLACE) | place, width) & _PLACE).astype(np.int64)
        ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
        valid = np.arange(length, length + n) <= ends
        change = np.ones(n + 1, bool)
        change[1:n] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(change[:n])
        last = np.append(first[1:], n)
        keep = valid[first]
        first, last = first[keep], last[keep]
        content = Rolling(data, 1).of(first, last - 1 + length)
        row = np.searchsorted(bounds, first, "right") - 1
        return row, first - bounds[row], last - first, key[at[first]], mix(content)

    return runs


def units(data: np.ndarray) -> np.ndarray:
    return data.reshape(-1, 1)


def window_hashes(length: int):
    def hashes(units: np.ndarray):
        data = units.reshape(-1)
        return mix(Rolling(data).every(length)), mix(Rolling(data, 1).every(length))

    return hashes


def cover(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` places lie in a window that starts at one of ``starts``."""
    step = np.zeros(n + length + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step)[:n] > 0


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts earlier.

    Earlier: in a document with a smaller id or one of the same id that stands before, or before in the same one.
    Overlaps count; strings are judged on the input. Returns ``id_col``, n_bytes, n_removed, n_spans (longest removed stretches), kept (binary), and
    kept_sha256. Null text is empty; null ids come first of all and return as null. Rows that share
    an id are documents of their own, in an order that is fixed once (see ``own_keys``). Other columns are ignored.
    """
    if (keyed := own_keys(docs.select(id_col, text_col), id_col, text_col)) is not None:
        return with_ids(drop_repeats(keyed, KEY, text_col, length), keyed, id_col, KEY).withColumnRenamed(KEY, id_col)
    spans, texts = repeated_windows(docs, id_col, text_col, suffix_runs(length), units, 1, window_hashes(length), length, same_doc=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, size, body, found in zip(batch["doc"].to_pylist(), batch["size"].to_pylist(), batch["body"], batch["spans"]):
                data = unpack(size, body.as_py())
                if found.is_valid:
                    at = windows_of(found)
                    gone = cover(size, at[at + length <= size], length)
                    edges = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = data[~gone].tobytes()
                    out.append((doc, size, int(gone.sum()), edges, kept, hashlib.sha256(kept).hexdigest()))
                else:
                    kept = data.tobytes()
                    out.append((doc, size, 0, 0, kept, hashlib.sha256(kept).hexdigest()))
                if sum(len(x[4]) for x in out[-1:]) > 1 << 20 or len(out) >= 256:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    joined = texts.join(spans, "doc", "left")
    done = joined.mapInArrow(finish, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
    return done.select(F.nullif("doc", F.lit(NO_ID)).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    doc, size, gone, spans, kept, digest = zip(*out)
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    cols = [pa.array(x, pa.int64()) for x in (doc, size, gone, spans)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.binary()), pa.array(digest)], names)
