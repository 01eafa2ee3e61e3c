"""Exact first-occurrence test for all windows of a fixed length, over documents of any number.

Shipping every window would cost many times the input. So windows are shipped in *runs*: consecutive
windows of one text that share an anchor, a place inside them that their own content decides. Equal windows
have equal anchors. A run is one entry (anchor key, content fingerprint, document, start, windows).

* Entries with equal content: all but the first only repeat what starts earlier.
* Entries with one key and different contents (a repeat begins or ends there): settled window by window in
  a second pass over these entries alone, with the window itself as key and content. What such a run holds is
  smaller than its windows, so runs travel whole and become windows after the shuffle; those of a key with
  ``SAME_KEY`` contents or more become windows before it, as no key then gathers them.

In each task of a scan, entries form sorted batches; equal contents meet there first, so a content that
every document has leaves a task once. After the shuffle by key range the batches go through a logarithmic
family of sorted levels (see ``Family``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasieve.llm._scan import NO_ID, longs, mix, raw, slices, spare_memory, spread
from contrasieve.session import cut_lineage

ENTRY = np.dtype([("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])
#: So many contents of one key a task sends on; further ones are settled window by window at once.
SAME_KEY = 64
BATCH = 1 << 19
#: Repeats; runs to settle window by window, of keys with few and with many contents.
REPEATED, OPEN, CROWDED = 1, 2, 3

FOUND = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("kind", pa.int8()), ("key", pa.int64())])
SHIPPED = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("entries", pa.binary()), ("body", pa.binary())])


def entries(key, content, doc, start, n) -> np.ndarray:
    out = np.empty(len(key), ENTRY)
    out["key"], out["content"], out["doc"], out["start"], out["n"] = key, content, doc, start, n
    return out


def in_order(e: np.ndarray) -> np.ndarray:
    """By key, content, document and start. Most keys are alone, so only equal ones are compared further."""
    key = np.ascontiguousarray(e["key"])
    order = np.argsort(key)
    key = key[order]
    tied = np.zeros(len(e) + 1, bool)
    tied[1:-1] = key[1:] == key[:-1]
    tied = np.flatnonzero(tied[1:] | tied[:-1])
    part = e[order[tied]]
    order[tied] = order[tied][np.lexsort((part["start"], part["doc"], part["content"], part["key"]))]
    return e[order]


def found(e: np.ndarray, kind: int) -> pa.RecordBatch:
    key = pa.array(np.ascontiguousarray(e["key"]).view(np.int64)) if kind == OPEN else pa.nulls(len(e), pa.int64())
    cols = [pa.array(e["doc"]), pa.array(e["start"]), pa.array(e["n"]), pa.array(np.full(len(e), kind, np.int8)), key]
    return pa.RecordBatch.from_arrays(cols, schema=FOUND)


def first_of_content(e: np.ndarray, same_doc: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ordered entries without repeats, and the repeats. Without ``same_doc`` a text does not repeat itself."""
    if not len(e):
        return e, e
    new = np.ones(len(e), bool)
    new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["content"][1:] != e["content"][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    if same_doc:
        again = ~new & ((e["doc"] != e["doc"][head]) | (e["start"] != e["start"][head]))
    else:
        again = ~new & (e["doc"] != e["doc"][head])
    return e[new], e[again]


class Family:
    """A logarithmic family of suffix arrays: sorted levels of entries, each larger than all after it.

    A new batch is scanned against every level. Where equal contents meet, the later one is reported and
    only the earlier one stays in the index. Then the batch becomes the last level, and levels of like size
    are merged, so an entry is rewritten a logarithmic number of times.
    """

    def __init__(self, same_doc: bool = True):
        self.levels: list[np.ndarray] = []
        self.same_doc = same_doc

    def add(self, batch: np.ndarray) -> list[np.ndarray]:
        """Take in an ordered batch without repeats; returns the entries found to be repeats."""
        later = []
        for level in self.levels:
            at, here = self._scan(level, batch)
            old, new = level[at], batch[here]
            newer = (new["doc"] > old["doc"]) | ((new["doc"] == old["doc"]) & (new["start"] >= old["start"]))
            twin = (new["doc"] == old["doc"]) & ((new["start"] == old["start"]) | (not self.same_doc))
            later += [new[newer & ~twin], old[~newer & ~twin]]
            level[at[~newer]] = new[~newer]
            keep = np.ones(len(batch), bool)
            keep[here] = False
            batch = batch[keep]
        if len(batch):
            self.levels.append(batch.copy())
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels.append(in_order(np.concatenate([self.levels.pop(), last])))
        return [x for x in later if len(x)]

    @staticmethod
    def _scan(level: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in level and batch with equal key and content."""
        low = np.searchsorted(level["key"], batch["key"], "left")
        high = np.searchsorted(level["key"], batch["key"], "right")
        here = np.flatnonzero(high > low)
        low, high, want = low[here], high[here], batch["content"][here]
        content = level["content"]
        top = high.copy()
        while len(low) and (wide := low < high).any():
            mid = (low + high) >> 1
            less = content[np.minimum(mid, len(content) - 1)] < want
            low = np.where(wide & less, mid + 1, low)
            high = np.where(wide & ~less, mid, high)
        same = low < top
        same[same] = content[low[same]] == want[same]
        return low[same], here[same]

    def close(self) -> np.ndarray:
        """All entries as one ordered array."""
        if not self.levels:
            return np.zeros(0, ENTRY)
        self.levels = [in_order(np.concatenate(self.levels))] if len(self.levels) > 1 else self.levels
        return self.levels[0]


def contents_of_key(e: np.ndarray) -> np.ndarray:
    """For each ordered entry without repeats, how many contents its key has."""
    if not len(e):
        return np.zeros(0, np.int64)
    new = np.ones(len(e), bool)
    new[1:] = e["key"][1:] != e["key"][:-1]
    sizes = np.diff(np.append(np.flatnonzero(new), len(e)))
    return np.repeat(sizes, sizes)


Runs = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]
Units = Callable[[np.ndarray], np.ndarray]
Hashes = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _ship(parts: list[np.ndarray], buckets: int, same_doc: bool) -> Iterator[pa.RecordBatch]:
    """One sorted batch, cut by key range into buckets; what is settled already is dealt by document."""
    batch, again = first_of_content(in_order(np.concatenate(parts)), same_doc)
    new = np.ones(len(batch), bool)
    new[1:] = batch["key"][1:] != batch["key"][:-1]
    _, place = spread(np.diff(np.append(np.flatnonzero(new), len(batch))))
    for kind, told in ((REPEATED, again), (CROWDED, batch[place >= SAME_KEY])):
        told = told[np.argsort(told["doc"] % buckets, kind="stable")]
        yield _cut(told, told["doc"] % buckets, kind, buckets)
    batch = batch[place < SAME_KEY]
    yield _cut(batch, _owner(batch["key"], buckets), 0, buckets)


def _owner(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(e: np.ndarray) -> bytes:
    """Entries byte plane by byte plane, so that places and counts take little room."""
    planes = np.ascontiguousarray(e.view(np.uint8).reshape(len(e), ENTRY.itemsize).T)
    return len(e).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[4:], n * ENTRY.itemsize, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(ENTRY.itemsize, n).T).reshape(-1).view(ENTRY)


def _cut(e: np.ndarray, owner: np.ndarray, kind: int, buckets: int) -> pa.RecordBatch:
    cuts = np.searchsorted(owner, np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cuts))
    blobs = [packed(e[cuts[b] : cuts[b + 1]]) for b in some.tolist()]
    return _shipped(some, kind, blobs, None)


def _cut_bodies(e: np.ndarray, bodies: list[bytes], buckets: int) -> pa.RecordBatch:
    """Runs with their bytes, dealt by the key that all runs of equal windows share."""
    owner = _owner(e["key"], buckets)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cuts))
    parts = [order[cuts[b] : cuts[b + 1]] for b in some.tolist()]
    codec = pa.Codec("zstd", compression_level=1)
    return _shipped(some, OPEN, [packed(e[p]) for p in parts], [codec.compress(b"".join(bodies[i] for i in p.tolist()), asbytes=True) for p in parts])


def _shipped(buckets: np.ndarray, kind: int, blobs: list[bytes], bodies: list[bytes] | None) -> pa.RecordBatch:
    body = pa.nulls(len(blobs), pa.binary()) if bodies is None else pa.array(bodies, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(np.full(len(blobs), kind, np.int8)), pa.array(blobs, pa.binary()), body], schema=SHIPPED)


def _batches(produce: Callable, buckets: int, same_doc: bool):
    """mapInArrow body: collects the entries that ``produce`` yields into sorted batches and ships them.

    ``produce`` may also yield pairs (entries, bytes of each run).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        parts, size, runs, bodies, held = [], 0, [], [], 0
        for batch in batches:
            for e in produce(batch):
                if isinstance(e, tuple):
                    runs.append(e[0])
                    bodies += e[1]
                    held += sum(map(len, e[1]))
                else:
                    parts.append(e)
                    size += len(e)
                if size >= BATCH:
                    yield from _ship(parts, buckets, same_doc)
                    parts, size = [], 0
                if held >= 1 << 23:
                    yield _cut_bodies(np.concatenate(runs), bodies, buckets)
                    runs, bodies, held = [], [], 0
        if size:
            yield from _ship(parts, buckets, same_doc)
        if bodies:
            yield _cut_bodies(np.concatenate(runs), bodies, buckets)

    return run


def _as_windows(e: np.ndarray, body: bytes, span: int, width: int, hashes: Hashes) -> np.ndarray:
    """All windows of runs that lie end to end in ``body``."""
    size = e["n"].astype(np.int64) + span - 1
    at = np.cumsum(size) - size
    flat = np.frombuffer(pa.Codec("zstd").decompress(body, width * int(size.sum()), asbytes=True), np.uint8)
    one, two = hashes(flat.reshape(-1, width))
    run, place = spread(e["n"])
    where = at[run] + place
    # equal windows are in runs of one key
    return entries(one[where], two[where] ^ e["key"][run], e["doc"][run], e["start"][run] + place, np.ones(len(run), np.int32))


def _settle(same_doc: bool, span: int, width: int, hashes: Hashes, final: bool):
    """mapInArrow body after the shuffle, bucket by bucket: all batches of a key range through one family."""

    def end(family: Family) -> Iterator[pa.RecordBatch]:
        if not final:
            index = family.close()
            several = contents_of_key(index)
            for kind, rows in ((OPEN, index[(several > 1) & (several < SAME_KEY)]), (CROWDED, index[several >= SAME_KEY])):
                for a in range(0, len(rows), 1 << 16):
                    yield found(rows[a : a + (1 << 16)], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        family, now = Family(same_doc), None
        for batch in batches:
            for bucket, kind, blob, body in zip(batch["bucket"].to_pylist(), batch["kind"].to_pylist(), batch["entries"], batch["body"]):
                if bucket != now:
                    yield from end(family)
                    family, now = Family(same_doc), bucket
                e = unpacked(blob.as_py())
                if body.is_valid:
                    e, again = first_of_content(in_order(_as_windows(e, body.as_py(), span, width, hashes)), same_doc)
                    yield found(again, REPEATED)
                elif kind:
                    yield found(e, kind)
                    continue
                for later in family.add(e):
                    yield found(later, REPEATED)
        yield from end(family)

    return run


def _schema(s: pa.Schema) -> str:
    kinds = {pa.int8(): "tinyint", pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in s)


def packed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, body): texts under a compressor of their own, for shuffles; null ids get a stand-in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                data, ends = raw(part["text"])
                view = memoryview(data)
                cut = ends.tolist()
                body = [codec.compress(view[a:b], asbytes=True) if b > a else b"" for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(longs(part["doc"])), pa.array(np.diff(ends)), pa.array(body, pa.binary())], ["doc", "size", "body"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc bigint, size bigint, body binary")


def unpack(size: int, body: bytes) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(body, size, asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)


def span_lists(rows: DataFrame, *more: str) -> DataFrame:
    """(doc, spans): per document, its (start, n) pairs; a list is at most as long as its document."""
    return rows.groupBy("doc").agg(F.collect_list(F.struct("start", "n", *more)).alias("spans"))


def window_starts(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ordered distinct window starts of spans."""
    group, place = spread(n)
    return np.unique(start[group].astype(np.int64) + place)


def windows_of(spans: pa.Scalar) -> np.ndarray:
    """Ordered distinct window starts of a list of (start, n)."""
    start, n = (x.to_numpy(zero_copy_only=False) for x in spans.values.flatten()[:2])
    return window_starts(start, n)


def one_per_partition(spark, parts: int) -> list[int]:
    """For each of ``parts`` partitions a number that ``repartition`` deals to it, so that none gets two ranges."""
    numbers = spark.range(16 * parts + 64).select(F.col("id").cast("int").alias("k"))
    found = numbers.groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("p")).agg(F.min("k").alias("k")).orderBy("p")
    return [r["k"] for r in found.collect()]  # one row per partition


def repeated_windows(
    docs: DataFrame, id_col: str, text_col: str, runs: Runs, units: Units, width: int, hashes: Hashes, span: int, same_doc: bool
) -> tuple[DataFrame, DataFrame]:
    """Windows that repeat an earlier one: (doc, spans of window starts), and the packed texts.

    ``runs(bytes, bounds)`` gives text number, start, windows, key and content of each run of a slice.
    ``units(bytes)`` gives what windows are made of, ``width`` bytes each, one per row; ``hashes(units)`` gives two
    fingerprints of every window of ``span`` of them.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = one_per_partition(spark, parts)
    buckets = len(names)

    def scan(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in slices(batch, "text"):
            data, bounds = raw(part["text"])
            row, start, n, key, content = runs(data, bounds)
            # anchors are least hashes, so small ones are common; mixed again, they spread evenly over key ranges
            yield entries(mix(key), content, longs(part["doc"])[row], start, n)

    def rescan(batch: pa.RecordBatch) -> Iterator:
        for doc, size, body, spans in zip(batch["doc"].to_pylist(), batch["size"].to_pylist(), batch["body"], batch["spans"]):
            data = unpack(size, body.as_py())
            flat = spans.values.flatten()
            start, n, kind, key = (flat[i].to_numpy(zero_copy_only=False) for i in range(4))
            made_of = units(data)
            fits = start.astype(np.int64) + n + span - 1 <= len(made_of)
            whole = fits & (kind == OPEN)
            if whole.any():
                whole_runs = entries(key[whole].astype(np.int64).view(np.uint64), 0, np.full(whole.sum(), doc, np.int64), start[whole], n[whole])
                yield whole_runs, [made_of[a : a + b + span - 1].tobytes() for a, b in zip(start[whole].tolist(), n[whole].tolist())]
            if (rest := fits & ~whole).any():
                one, two = hashes(made_of)
                at = window_starts(start[rest], n[rest])
                yield entries(one[at], two[at], np.full(len(at), doc, np.int64), at, np.ones(len(at), np.int32))

    def through_family(shipped: DataFrame, final: bool) -> DataFrame:
        named = F.element_at(F.lit(names), F.col("bucket") + 1)
        dealt = shipped.repartition(parts, named).sortWithinPartitions("bucket")
        return dealt.mapInArrow(_settle(same_doc, span, width, hashes, final), _schema(FOUND))

    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    first = cut_lineage(through_family(source.mapInArrow(_batches(scan, buckets, same_doc), _schema(SHIPPED)), final=False))
    texts = packed_texts(docs, id_col, text_col)
    keyed = F.coalesce("key", F.lit(0)).alias("key")
    unsure = texts.join(span_lists(first.where(F.col("kind") != REPEATED).select("doc", "start", "n", "kind", keyed), "kind", "key"), "doc")
    second = through_family(unsure.mapInArrow(_batches(rescan, buckets, same_doc), _schema(SHIPPED)), final=True)
    return span_lists(first.where(F.col("kind") == REPEATED).unionByName(second.where(F.col("kind") == REPEATED))), texts

