"""Whole Arrow columns of texts as numpy arrays: slices, words, rolling hashes, sliding minima.

Everything here works on a slice of a batch at a time (about ``SLICE`` bytes, one text at least), so a
task's memory follows its longest text and not its partition.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
NO_ID = -(1 << 63)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_POWERS: dict = {}


def spare_memory() -> None:
    """Give back what earlier tasks of this Python process left for later ones: token tables and freed pages.

    Called where a task holds much and tokenizes nothing; the process stays in use for tasks of all kinds.
    """
    held = sys.modules.get("_contrasieve_process")
    if held is not None and held.__dict__.pop("encoders", None):
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with at most ``limit`` bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield batch.slice(a, b - a)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 places where texts begin; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def longs(column: pa.Array) -> np.ndarray:
    """A column of ids; null becomes the smallest long."""
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[which]
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        have = (tables[0], tables[1])
        if size <= 4 * SLICE:
            _POWERS[which] = have
    return have


class Rolling:
    """Hashes of any stretch ``[a, b)`` of a sequence from one running sum (arithmetic modulo 2**64)."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        up, self.down = _powers(n + 1, which)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def every(self, k: int) -> np.ndarray:
        """Hashes of all stretches of length ``k``."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]


def words(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the number of words before each text (n + 1 places).

    A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D, or those marked in ``between``; words never cross texts.
    """
    solid = ~between[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    after = np.zeros(len(data) + 1, bool)
    after[1:] = ~solid
    after[bounds] = True
    begin = np.flatnonzero(solid & after[:-1])
    after[:-1] = ~solid
    after[bounds[1:]] = True
    after[-1] = True
    end = np.flatnonzero(solid & after[1:]) + 1
    return begin, end, np.searchsorted(begin, bounds)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(Rolling(data).of(begin, end) + (end - begin).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:]) if len(x) > have else x[:0]
        have *= 2
    rest = width - have
    if rest:
        x = np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]
    return x


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group and the place in it of every member."""
    group = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - np.repeat(first, counts)
