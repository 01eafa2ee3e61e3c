"""Benchmark passages in documents, with edits: q-gram lemma filter, then banded alignment.

Texts are compared in lower case with every stretch of other characters than letters and digits as one space. An
item of m characters may have ``rate`` * m edits. Edits destroy at most k * q of its q-grams, so a document region
that holds it shares m - q + 1 - k * q of them, all within k diagonals of each other. Shared q-grams are counted in
overlapping diagonal bands; bands that reach the bound are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasieve.llm._scan import NO_ID, Rolling, longs, mix, raw, slices, spread

RATE = 0.05
LONGEST_Q = 16
#: Characters of benchmark text that are sent to the tasks at once; a larger benchmark takes more passes.
PART = 4_000_000
_BITS = 22


def _letters() -> np.ndarray:
    """Letters and digits among the first 65,536 code points (those beyond count as letters)."""
    solid = np.ones(1 << 16, bool)
    solid[:128] = [chr(c).isalnum() for c in range(128)]
    solid[0x80:0xC0] = False
    solid[[0xAA, 0xB5, 0xBA]] = True
    solid[[0xD7, 0xF7, 0xFEFF]] = False
    solid[0x2000:0x2070] = False
    solid[0x2190:0x2C00] = False
    solid[0x3000:0x3004] = False
    return solid


def normalise(texts: pa.Array, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts and the n + 1 places where texts begin; for each its character in the slice, and
    the character at which each text begins."""
    data, bounds = raw(pc.utf8_lower(pc.fill_null(texts, "")))
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    places = heads[bounds]
    letter = solid[np.minimum(points, 0xFFFF)]
    first = np.zeros(len(points) + 1, bool)
    first[places] = True
    keep = letter.copy()
    keep[1:] |= ~letter[1:] & letter[:-1] & ~first[1:-1]
    at = np.flatnonzero(keep)
    return np.where(letter[at], points[at], np.uint32(0x20)), np.searchsorted(at, places), at, places


class Index:
    """q-grams of benchmark items for one q."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray, int]]):
        self.q, self.items = q, items
        grams = [mix(Rolling(p).every(q)) for _, p, _ in items]
        value = np.concatenate(grams)
        item, place = spread(np.array([len(g) for g in grams]))
        order = np.argsort(value, kind="stable")
        self.value, self.item, self.place = value[order], item[order], place[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(value & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        self.size = np.array([len(p) for _, p, _ in items])
        self.edits = np.array([k for _, _, k in items])
        self.bound = self.size - q + 1 - self.edits * q

    def bands(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands that reach the bound. A band is twice as wide as edits can shift."""
        value = mix(Rolling(points).every(self.q))
        at = np.flatnonzero(self.seen[(value & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        low, high = (np.searchsorted(self.value, value[at], side) for side in ("left", "right"))
        hit, nth = spread(high - low)
        which = low[hit] + nth
        item, diagonal = self.item[which], at[hit] - self.place[which]
        step = self.edits[item] + 1
        band = diagonal // step
        both = np.stack([np.concatenate([item, item]), np.concatenate([band, band - 1])])
        if not both.shape[1]:
            return both[0], both[1]
        order = np.lexsort((both[1], both[0]))
        both = both[:, order]
        new = np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(axis=0)])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, both.shape[1]))
        item, band = both[0][head], both[1][head]
        good = count >= self.bound[item]
        return item[good], band[good] * (self.edits[item[good]] + 1)


def align(item: np.ndarray, text: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """Best (edits, begin, end) of the whole item inside ``text`` with at most ``edits`` edits.

    Row by row over the item, only along diagonals that a match can use; begins are carried along.
    """
    m, n = len(item), len(text)
    whole = np.lib.stride_tricks.sliding_window_view(text, m) if n >= m else np.zeros((0, m), text.dtype)
    same = np.flatnonzero((whole == item).all(axis=1)) if len(whole) else []
    if len(same):
        return 0, int(same[0]), int(same[0]) + m
    if not edits:
        return None
    width = max(n - m, 0) + 2 * edits + 1  # column j of row i is text place i + j - edits
    column = np.arange(width)
    far = m + n + 1
    cost = np.where((column - edits >= 0) & (column - edits <= n), 0, far)
    begin = column - edits
    for i in range(1, m + 1):
        place = i + column - edits
        inside = (place >= 1) & (place <= n)
        match = np.zeros(width, bool)
        match[inside] = text[place[inside] - 1] == item[i - 1]
        best, start = np.where(inside, cost + ~match, far), begin
        above, above_start = np.append(cost[1:], far) + 1, np.append(begin[1:], 0)
        up = above < best
        best, start = np.where(up, above, best), np.where(up, above_start, start)
        best = np.where((place >= 0) & (place <= n), best, far)
        # insertions run along the row: the running minimum of cost less column
        flat = best - column
        low = np.minimum.accumulate(flat)
        source = np.maximum.accumulate(np.where(flat == low, column, 0))
        cost, begin = np.minimum(low + column, far), start[source]
    cost = np.where(m + column - edits <= n, cost, far)
    j = int(np.argmin(cost))
    if cost[j] > edits:
        return None
    return int(cost[j]), int(begin[j]), m + j - edits


MATCHES = "doc bigint, item bigint, begin bigint, end bigint, edits int"


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """Rows id_col, item_col, begin, end, edits: where (in characters) each document holds a benchmark item.

    The best place of each band is reported, once per place. Null or wordless items and documents match nothing;
    repeated items match each for itself; repeated rows of documents too. Null ids return as null. Other columns are
    ignored. Empty tables give no rows.
    """
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    passes = max(1, -(-total // PART))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).collect()  # about PART characters
        one = source.mapInArrow(_search(_indexes([(r["item"], r["text"]) for r in part], rate)), MATCHES)
        found = one if found is None else found.unionByName(one)
    return found.select(F.nullif("doc", F.lit(NO_ID)).alias(id_col), F.nullif("item", F.lit(NO_ID)).alias(item_col), "begin", "end", "edits").distinct()


def _indexes(items: list[tuple[int | None, str]], rate: float) -> list[Index]:
    solid, by_q = _letters(), {}
    for key, text in items:
        points = normalise(pa.array([text], pa.string()), solid)[0]
        if len(points) and points[-1] == 0x20:
            points = points[:-1]
        if len(points):
            edits = int(rate * len(points))
            by_q.setdefault(min(LONGEST_Q, len(points) // (edits + 1)), []).append((NO_ID if key is None else key, points, edits))
    return [Index(q, rows) for q, rows in sorted(by_q.items())]


def _search(indexes: list[Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solid = _letters()
        for batch in batches:
            out = set()
            for part in slices(batch, "text"):
                points, bounds, chars, heads = normalise(part["text"], solid)
                if not len(points):
                    continue
                ids = longs(part["doc"])
                for index in indexes:
                    for i, diagonal in zip(*(x.tolist() for x in index.bands(points))):
                        key, item, edits = index.items[i]
                        middle = min(max(diagonal + len(item) // 2, 0), len(points) - 1)
                        low, high = diagonal - edits, diagonal + 2 * (edits + 1) + len(item) + edits
                        rows = np.unique(np.searchsorted(bounds, [max(low, 0), middle, min(high, len(points)) - 1], "right") - 1)
                        for row in range(int(rows[0]), int(rows[-1]) + 1):
                            a, b = max(low, int(bounds[row])), min(high, int(bounds[row + 1]))
                            if b - a < len(item) - edits or row >= len(ids):
                                continue
                            if best := align(item, points[a:b], edits):
                                begin, end = chars[a + best[1]] - heads[row], chars[a + best[2] - 1] + 1 - heads[row]
                                out.add((int(ids[row]), key, int(begin), int(end), best[0]))
            cols = list(zip(*sorted(out))) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.int32())], ["doc", "item", "begin", "end", "edits"])

    return run

