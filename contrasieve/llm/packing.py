"""Token sequences of at most ``LENGTH`` ids with as few of them as possible: swap-based local search.

Documents longer than a sequence are cut so that only their first piece is shorter. Full pieces are sequences. The
others are dealt by hash into groups of ``GROUP``; each group is packed best fit first and then improved: documents move,
or are exchanged one for one, two for one or one for two, out of the emptiest bins into fuller ones. Each exchange
increases the sum of squared fills, until bins are empty. A second round repacks what the groups left underfull.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasieve.llm._scan import NO_ID, longs, slices
from contrasieve.llm._tokens import SLICE, Encoder
from contrasieve.session import cut_lineage

LENGTH, END_ID = 1024, 2
#: Pieces that are packed together.
GROUP = 8192
PASSES = 3

PIECES = "doc bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document's ids with the end id. ``row`` tells apart rows that share an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, ends = encoder.column(part["text"])
                rows, cut = [], ends.tolist()
                for doc, row, a, b in zip(longs(part["doc"]).tolist(), part["row"].to_pylist(), cut[:-1], cut[1:]):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    first = len(own) % length or length
                    at = [0, *range(first, len(own), length)]
                    rows += [(doc, row, k, s, e - s, zlib.crc32(own[s:e])) for k, (s, e) in enumerate(zip(at, [*at[1:], len(own)]))]
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc", "row", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, PIECES)


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of places in ``sizes``: longest first, each into the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(length + 1)]
    open_rooms, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = open_rooms >> sizes[i]
        if fits:
            left = sizes[i] + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
            left -= sizes[i]
            bins[b].append(i)
        else:
            b, left = len(bins), length - sizes[i]
            bins.append([i])
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bins


class Search:
    """Local search over the underfull bins of one group."""

    def __init__(self, sizes: list[int], bins: list[list[int]], length: int):
        self.sizes, self.bins, self.length = sizes, bins, length
        self.fill = [sum(sizes[i] for i in b) for b in bins]

    def run(self, passes: int) -> list[list[int]]:
        for _ in range(passes):
            under = sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.length), key=lambda b: (self.fill[b], b))
            spare = sum(self.length - self.fill[b] for b in under) // self.length  # no more bins than this can be emptied
            if not spare or not any([self._give(b, under[k + 1 :]) for k, b in enumerate(under[: spare + 1])]):
                break
        return [b for b in self.bins if b]

    def _give(self, donor: int, others: list[int]) -> bool:
        """Raise the fill of fuller bins at the donor's cost, the largest step of each bin; whether anything changed."""
        changed = False
        for b in reversed(others):
            while self.bins[donor] and 0 < self.length - self.fill[b] and self.fill[b] >= self.fill[donor]:
                step = self._best(donor, b)
                if not step:
                    break
                out, back = step
                gain = sum(self.sizes[i] for i in out) - sum(self.sizes[i] for i in back)
                self.bins[donor] = [i for i in self.bins[donor] if i not in out] + back
                self.bins[b] = [i for i in self.bins[b] if i not in back] + out
                self.fill[donor] -= gain
                self.fill[b] += gain
                changed = True
            if not self.bins[donor]:
                break
        return changed

    def _best(self, donor: int, b: int) -> tuple[list[int], list[int]] | None:
        """Documents to give and to take so that bin ``b`` gains most and still fits."""
        room, size = self.length - self.fill[b], self.sizes
        ours = [[i] for i in self.bins[donor]] + [[i, j] for k, i in enumerate(self.bins[donor]) for j in self.bins[donor][:k]]
        theirs = [[]] + [[i] for i in self.bins[b]] + [[i, j] for k, i in enumerate(self.bins[b]) for j in self.bins[b][:k]]
        if len(ours) * len(theirs) > 4096:  # bins of very many tiny documents: single ones are enough
            ours, theirs = [[i] for i in self.bins[donor]], [[]] + [[i] for i in self.bins[b]]
        best, found = 0, None
        for out in ours:
            given = sum(size[i] for i in out)
            for back in theirs:
                if len(out) + len(back) > 3:
                    continue
                gain = given - sum(size[i] for i in back)
                if best < gain <= room:
                    best, found = gain, (out, back)
                    if best == room:
                        return found
        return found


def pack_group(sizes: list[int], length: int = LENGTH, passes: int = PASSES) -> list[list[int]]:
    return Search(sizes, best_fit(sizes, length), length).run(passes)


def _packed(rows: DataFrame, groups: int, length: int, name: str) -> DataFrame:
    """bin (a string, unique with ``name``), offset and fill for rows (doc, row, piece, length)."""
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc", "row", "piece"), F.lit(groups)).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        sizes = table["length"].to_pylist()
        bins, offset, fill = [None] * len(sizes), [0] * len(sizes), [0] * len(sizes)
        for k, members in enumerate(pack_group(sizes, length)):
            total = sum(sizes[i] for i in members)
            at = 0
            for i in members:
                bins[i], offset[i], fill[i] = f"{name}{key[0].as_py()}-{k}", at, total
                at += sizes[i]
        cols = [table[c] for c in ("doc", "row", "piece", "length")]
        return pa.table([*cols, pa.array(bins, pa.string()), pa.array(offset, pa.int64()), pa.array(fill, pa.int64())], ["doc", "row", "piece", "length", "bin", "offset", "fill"])

    return dealt.groupBy("g").applyInArrow(run, "doc bigint, row bigint, piece int, length bigint, bin string, offset bigint, fill bigint")


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` with sequence_id (any number) and offset: every piece once, no sequence over ``length``.

    A group is bounded by ``GROUP``, whatever the keys are: pieces are dealt by a hash of their own.
    """
    part = cut.where(F.col("length") < length).select("doc", "row", "piece", "length")
    groups = max(1, -(-part.count() // GROUP))
    first = cut_lineage(_packed(part, groups, length, "a"))
    rest = first.where(F.col("fill") < length).select("doc", "row", "piece", "length")
    left = rest.count()
    if groups > 1 and left:
        again = _packed(rest, max(1, -(-left // GROUP)), length, "b")
        first = cut_lineage(first.where(F.col("fill") == length).unionByName(again))
    full = cut.where(F.col("length") >= length).select("doc", "row", "piece", "length", F.concat_ws("-", F.lit("c"), "doc", "row", "piece").alias("bin"), F.lit(0).cast("bigint").alias("offset"), F.col("length").alias("fill"))
    placed = first.unionByName(full).select("doc", "row", "piece", F.xxhash64("bin").alias("sequence_id"), "offset")
    return cut.join(placed, ["doc", "row", "piece"])


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty: its document is the end id alone. Repeated rows are documents of their own, null ids return
    as null. An empty table gives no rows. Other columns are ignored.
    """
    packed = pack(cut_lineage(pieces(docs, path, id_col, text_col, length)), length)
    return packed.select(F.nullif("doc", F.lit(NO_ID)).alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
