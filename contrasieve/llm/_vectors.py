"""Arrow columns of vectors as integer matrices, and integer vectors as binary keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled entries beyond this size are held at it.
LARGEST = 1 << 62


def as_doubles(name: str) -> Column:
    return F.col(name).cast("array<double>")


def width(df: DataFrame, name: str) -> int:
    """Entries of the longest vector; shorter ones count as ending in zeros."""
    return df.agg(F.max(F.size(name)).alias("w")).first()["w"] or 0


def scaled(column: pa.Array, factor: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of usable vectors, and floor(factor * entry) of each as a row of ``dims`` longs.

    A vector is usable if it is not null and holds no null, NaN or infinity.
    """
    lists = column.cast(pa.large_list(pa.float64()))
    flat = lists.flatten()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    usable = pc.is_valid(lists).to_numpy(zero_copy_only=False).copy()
    usable[owner[~np.isfinite(values)]] = False
    out = np.zeros((len(sizes), dims), np.int64)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fine = np.flatnonzero(usable[owner])
    with np.errstate(over="ignore"):
        out[owner[fine], place[fine]] = np.clip(np.floor(factor * values[fine]), -LARGEST, LARGEST).astype(np.int64)
    at = np.flatnonzero(usable)
    return at, out[at]


def pack(rows: np.ndarray) -> pa.Array:
    """One key for each row: the least number of bytes (1, 2, 4, 8) that hold its entries, then the entries."""
    keys = np.empty(len(rows), object)
    size = np.full(len(rows), 8)
    for w in (4, 2, 1):
        limit = 1 << (8 * w - 1)
        size[((rows >= -limit) & (rows < limit)).all(axis=1)] = w
    for w in (1, 2, 4, 8):
        at = np.flatnonzero(size == w)
        if len(at):
            body = np.ascontiguousarray(rows[at].astype(f"<i{w}")).view(np.uint8).reshape(len(at), -1)
            whole = np.concatenate([np.full((len(at), 1), w, np.uint8), body], axis=1)
            data, step = whole.tobytes(), whole.shape[1]
            keys[at] = [data[i : i + step] for i in range(0, len(data), step)]
    return pa.array(keys.tolist(), pa.binary())


def unpack(keys: pa.Array, dims: int) -> np.ndarray:
    """The rows of longs that ``pack`` made keys of."""
    out = np.zeros((len(keys), dims), np.int64)
    found = keys.to_pylist()
    size = np.fromiter((k[0] for k in found), np.int64, len(found))
    for w in (1, 2, 4, 8):
        at = np.flatnonzero(size == w)
        if len(at):
            out[at] = np.frombuffer(b"".join(found[i][1:] for i in at.tolist()), f"<i{w}").reshape(len(at), dims)
    return out


def largest(x: np.ndarray) -> int:
    """Size of the largest entry as an unbounded integer."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product of integers without rounding: by doubles where they hold every sum, else by unbounded integers."""
    if largest(a) * largest(b) * max(a.shape[1], 1) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a.astype(object).dot(b.astype(object))
