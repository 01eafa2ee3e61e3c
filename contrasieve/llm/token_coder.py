"""Token ids in compressed blocks: an adaptive context-mixing range coder.

A table of chunks is the file format. A chunk has whole documents (ids and lengths), the order-0 frequencies of its
ids, and blocks of ``BLOCK`` ids, each with its count, its CRC-32 and its words. Blocks are coded from a fresh start
and do not depend on each other, so any one can be read alone.

Order-2 and order-1 contexts each predict one id: the last that followed them in this block. How often such a
prediction was right, by how long it has been right in a row, is the weight of the order it came from; order 0 has the
rest. The three shares are laid end to end, and the id's part of them drives a range coder. All blocks of a chunk are
coded in step, one numpy lane each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contrasieve.llm._scan import NO_ID, longs, slices
from contrasieve.llm._tokens import SLICE, Encoder

BLOCK, CHUNK, END_ID = 2048, 1 << 23, 2
#: Steps prepared together when coding.
TILE = 64
#: Bits of the shares of one step, of the order-0 frequencies, and slots of a block's context tables.
SHARE, BASE, SLOTS = 24, 20, 256
#: A span below the first may have its upper 32 bits settled; none is below the second when a step begins.
_TOP, _LEAST, _ALL = np.uint64(1 << 32), np.uint64(1 << 30), np.uint64((1 << 64) - 1)
_U = np.uint64


def base_frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and frequencies that add up to 2 ** BASE, each at least 1."""
    value, count = np.unique(ids, return_counts=True)
    if len(value) > 1 << (BASE - 1):
        raise ValueError("more distinct ids in one chunk than the order-0 table holds")
    spare = (1 << BASE) - len(value)
    share = 1 + count * spare // count.sum()
    share[np.argmax(share)] += (1 << BASE) - share.sum()
    return value.astype(np.uint32), share.astype(np.uint32)


class Model:
    """Predictions and their weights, one lane per block; the rows of all arrays are order 2 and order 1."""

    def __init__(self, lanes: int):
        places = np.arange(2 * lanes, dtype=np.int32).reshape(2, lanes)
        self.slots, self.row = places * np.int32(SLOTS), places * np.int32(4)
        # 4 * (id + 1) + how often in a row the guess was right (3 at most); 0: none yet
        self.guess = np.zeros(2 * lanes * SLOTS, np.int32)
        self.right = np.full(2 * lanes * 4, 1 << 15, np.int32)  # 16-bit chance by that count

    def contexts(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Slots after the ids ``one`` and ``two`` (the one before), for the lanes along their last axis."""
        n = one.shape[-1]
        mixed = ((one * np.int32(40503) + two * np.int32(30011)) >> 3) & (SLOTS - 1)
        return np.stack([self.slots[0, :n] + mixed, self.slots[1, :n] + (one & (SLOTS - 1))], axis=-2)

    def predict(self, at: np.ndarray):
        """Predicted ids (plus 1) of both orders, and where their shares end."""
        self.at, self.seen = at, self.guess.take(at)
        self.cell = (self.seen & 3) + self.row[:, : at.shape[1]]
        self.chance, self.known = self.right.take(self.cell), self.seen > 0
        self.guessed = self.seen >> 2
        w2, w1 = self.chance * self.known
        w1 *= self.guessed[0] != self.guessed[1]
        most = (1 << SHARE) - (1 << BASE)
        end2 = w2.astype(np.int64) * most >> 16
        return end2, end2 + (w1 * (most - end2) >> 16)

    def learn(self, new: np.ndarray) -> np.ndarray:
        """Take in the ids (plus 1) that came; returns which guesses were right."""
        hit = self.guessed == new
        # an empty slot tells nothing: its step is 0
        step = ((hit * np.int32(65535) - self.chance) >> 4) * self.known
        self.right[self.cell] = np.minimum(np.maximum(self.chance + step, 64), 65000)
        self.guess[self.at] = (new << 2) + np.minimum((self.seen & 3) + 1, 3) * hit
        return hit


def _shares(start0, width0, hit, end2, end1):
    """Begin and width of each id's part of the 2 ** SHARE, from its part of order 0 and which guesses named it."""
    rest = (1 << SHARE) - end1
    a = start0 * rest >> BASE
    b = (start0 + width0) * rest >> BASE
    is2, is1 = hit[0] & (end2 > 0), hit[1] & (end1 > end2)
    begin = np.where(is2, 0, np.where(is1, end2, end1 + a))
    return begin, np.where(is2, end2, np.where(is1, end1 - end2, b - a))


def _tables(value: np.ndarray, share: np.ndarray):
    size = int(value.max()) + 1 if len(value) else 1
    width = np.zeros(size, np.int64)
    width[value] = share
    return np.cumsum(width) - width, width


def _lengths(total: int, block: int) -> np.ndarray:
    full, rest = divmod(total, block)
    return np.array([block] * full + [rest] * bool(rest), np.int64)


def encode(ids: np.ndarray, value: np.ndarray, share: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The words of each block of ``ids``."""
    sizes = _lengths(len(ids), block)
    lanes = len(sizes)
    if not lanes:
        return []
    grid = np.zeros(lanes * block, np.int32)
    grid[: len(ids)] = ids
    # two rows of zeros ahead: what comes before a block
    grid = np.concatenate([np.zeros((2, lanes), np.int32), grid.reshape(lanes, block).T])
    (start0, width0), model = _tables(value, share), Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _ALL, np.uint64)
    words, count = np.zeros((lanes, block + 2), np.uint32), np.zeros(lanes, np.int64)
    for first in range(0, block, TILE):
        # contexts and order-0 parts of some steps at once: all ids are known here
        last = min(first + TILE, block)
        at = model.contexts(grid[first + 1 : last + 1], grid[first:last])
        start, width = start0[grid[first + 2 : last + 2]], width0[grid[first + 2 : last + 2]]
        for t in range(first, last):
            n = lanes if t < sizes[-1] else lanes - 1
            if not n:
                break
            end2, end1 = model.predict(at[t - first, :, :n])
            hit = model.learn(grid[t + 2, :n] + np.int32(1))
            begin, size = _shares(start[t - first, :n], width[t - first, :n], hit, end2, end1)
            part = span[:n] >> _U(SHARE)
            low[:n] += part * begin.view(np.uint64)
            span[:n] = part * size.view(np.uint64)
            go, words_out = _renormalise(low, span, n)
            words[go, count[go]] = words_out
            count[go] += 1
    every = np.arange(lanes)
    for shift in (32, 0):
        words[every, count] = (low >> _U(shift)).astype(np.uint32)
        count += 1
    return [words[k, : count[k]].tobytes() for k in range(lanes)]


def _renormalise(low: np.ndarray, span: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shift out the upper word of the first ``n`` lanes where it is settled or the span too small; lanes and words.

    One word a step is enough: no step takes more than 24 bits of a span, so 2 ** 30 leaves 2 ** 6, and 2 ** 38 when shifted.
    """
    go = np.flatnonzero(span[:n] < _TOP)
    a, b = low[go], span[go]
    open_ = (a ^ (a + b)) >= _TOP  # the lane's range lies across a change of the upper word
    cut = open_ & (b < _LEAST)
    stay = open_ & ~cut
    if stay.any():
        keep = np.flatnonzero(~stay)
        go, a, b, cut = go[keep], a[keep], b[keep], cut[keep]
    # a small span that lies across the change ends there
    span[go] = np.where(cut, (~a + _U(1)) & (_LEAST - _U(1)), b) << _U(32)
    low[go] = a << _U(32)
    return go, (a >> _U(32)).astype(np.uint32)


def decode(blocks: list[bytes], total: int, value: np.ndarray, share: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids that ``encode`` was given."""
    sizes = _lengths(total, block)
    lanes = len(sizes)
    if not lanes:
        return np.zeros(0, np.uint32)
    data = np.frombuffer(b"".join(blocks) + bytes(8), np.uint32)
    counts = np.array([len(b) >> 2 for b in blocks], np.int64)
    at = np.cumsum(counts) - counts
    (start0, width0), model = _tables(value, share), Model(lanes)
    slot = np.repeat(value, share).astype(np.int32)
    one, two = np.zeros((2, lanes), np.int32)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _ALL, np.uint64)
    code = np.zeros(lanes, np.uint64)
    for _ in range(2):
        code = (code << _U(32)) | data[at]
        at += 1
    out = np.zeros((block, lanes), np.uint32)
    for t in range(block):
        n = lanes if t < sizes[-1] else lanes - 1
        if not n:
            break
        end2, end1 = model.predict(model.contexts(one[:n], two[:n]))
        g2, g1 = model.guessed
        part = span[:n] >> _U(SHARE)
        target = np.minimum(((code[:n] - low[:n]) // part).astype(np.int64), (1 << SHARE) - 1)
        rest = (1 << SHARE) - end1
        place = (((np.maximum(target - end1, 0) + 1) << BASE) - 1) // rest
        now = slot[np.minimum(place, (1 << BASE) - 1)]
        now = np.where(target < end2, g2 - 1, np.where(target < end1, g1 - 1, now))
        begin, width = _shares(start0[now], width0[now], model.learn(now + np.int32(1)), end2, end1)
        out[t, :n] = now
        one, two = now, one[:n]
        low[:n] += part * begin.view(np.uint64)
        span[:n] = part * width.view(np.uint64)
        go, _ = _renormalise(low, span, n)
        place = at[go]
        code[go] = (code[go] << _U(32)) | data[np.minimum(place, len(data) - 1)]
        at[go] = place + 1
    return np.ascontiguousarray(out.T).reshape(-1)[_kept(sizes, block)]


def _kept(sizes: np.ndarray, block: int) -> slice:
    return slice(0, int((len(sizes) - 1) * block + sizes[-1]))


FILE = "shard int, chunk int, docs array<bigint>, lengths array<bigint>, total bigint, base binary, sums array<bigint>, blocks array<binary>"
_HEAD = "<4sI"


def _base_bytes(value: np.ndarray, share: np.ndarray) -> bytes:
    steps = np.diff(value, prepend=value[:1] * 0).astype(np.uint32)
    return struct.pack(_HEAD, b"CMR2", len(value)) + zlib.compress(steps.tobytes() + share.tobytes(), 6)


def _base_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    mark, n = struct.unpack_from(_HEAD, data)
    if mark != b"CMR2":
        raise ValueError("not a chunk of this format")
    both = np.frombuffer(zlib.decompress(data[struct.calcsize(_HEAD) :]), np.uint32)
    return np.cumsum(both[:n], dtype=np.uint64).astype(np.uint32), both[n:]


def write(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write the ids of all documents, in ascending id order, with ``end_id`` after each.

    Shards are ranges of ids. Null text is empty, a null id comes first; rows that share an id stand side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, chunk = Encoder(path), TaskContext.get().partitionId(), 0
        held, names, lengths, size = [], [], [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, ends = encoder.column(part["text"])
                # the end id goes in after each text
                own = np.insert(ids, ends[1:], np.uint32(end_id))
                n = np.diff(ends) + 1
                held.append(own)
                names.append(longs(part["doc"]))
                lengths.append(n)
                size += len(own)
                if size >= CHUNK - (CHUNK >> 3):
                    yield _chunk(shard, chunk, held, names, lengths)
                    chunk, held, names, lengths, size = chunk + 1, [], [], [], 0
        if names:
            yield _chunk(shard, chunk, held, names, lengths)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange(parts, "doc").sortWithinPartitions("doc")
    ordered.mapInArrow(run, FILE).write.parquet(folder)


def _chunk(shard: int, chunk: int, held, names, lengths) -> pa.RecordBatch:
    ids = np.concatenate(held)
    value, share = base_frequencies(ids)
    blocks = encode(ids, value, share)
    sums = [zlib.crc32(ids[a : a + BLOCK].astype("<u4")) for a in range(0, len(ids), BLOCK)]
    cols = [
        pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([np.concatenate(names)], pa.list_(pa.int64())),
        pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([_base_bytes(value, share)], pa.binary()),
        pa.array([sums], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary())),
    ]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in FILE.split(", ")])


def read(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the file: id_col, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                total = row["total"][0].as_py()
                ids = decode(row["blocks"][0].as_py(), total, *_base_of(row["base"][0].as_py())).astype("<u4")
                for a, told in zip(range(0, total, BLOCK), row["sums"][0].as_py()):
                    if zlib.crc32(ids[a : a + BLOCK]) != told:
                        raise ValueError(f"block {a // BLOCK} of chunk {row['chunk'][0]} is damaged")
                ends = np.cumsum(row["lengths"][0].values.to_numpy())
                cut = [0, *ends.tolist()]
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:])]
                n = len(sums)
                cols = [pa.array(np.full(n, row[c][0].as_py(), np.int32)) for c in ("shard", "chunk")]
                cols += [row["docs"][0].values, pa.array(np.array(cut[:-1], np.int64)), row["lengths"][0].values, pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "chunk", "doc", "place", "n_tokens", "ids_crc32"])

    table = spark.read.schema(FILE).parquet(folder)
    # ids before each shard, then before each chunk in it; neither window sees more than one row per shard or chunk
    shards = table.groupBy("shard").agg(F.sum("total").alias("all"))
    before = shards.select("shard", (F.sum("all").over(Window.partitionBy().orderBy("shard")) - F.col("all")).alias("s0"))
    chunks = table.select("shard", "chunk", (F.sum("total").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("total")).alias("c0"))
    docs = table.mapInArrow(run, "shard int, chunk int, doc bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    start = F.col("s0") + F.col("c0") + F.col("place")
    return docs.join(chunks.join(before, "shard"), ["shard", "chunk"]).select(F.nullif("doc", F.lit(NO_ID)).alias(id_col), start.alias("start"), "n_tokens", "ids_crc32")
