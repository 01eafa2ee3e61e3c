"""Phrases of two to five words that are frequent within a language, scored by their weakest cut.

Texts are coded once: a row of the coded table holds some megabytes of text of one language as places in a dictionary
of its own words, pieces parted by 0. A word's symbol is a 64-bit hash; the symbols of all different words are compared,
and another seed is taken until no two words share one, so symbols stand for words exactly.

Levels follow the Apriori rule. A phrase of k words is a candidate if its first and last k - 1 words are frequent, if it
occurs, and if both of its counters in a table of hashed counts, summed over all texts, reach the least count; none of the
three can miss a frequent phrase. Candidates become double-array tries (a root per language, a slot per node, base and check),
built in tasks. Each trie is broadcast in turn; numpy advances the states of all text positions at once, word by word,
counts accepting states with bincount, and the arrays of all tasks are added chunk by chunk.

Bounds: a trie holds about ``SHARD`` phrases, however many there are; more candidates mean more tries, one pass each.
The bucket table has at most ``1 << BUCKET_BITS`` counters; on larger inputs it lets more candidates through, and the
counts stay exact. A hot word or language is summed within tasks first.

Cases: null texts are empty, a null lang is ``und``. Repeated rows and ids count each time (ids are not read). Phrases
with equal scores and counts are ordered by their bytes. Tables without a candidate give no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contrasieve.llm._scan import Rolling, mix, raw, slices, spare_memory, words
from contrasieve.session import cut_lineage

LONGEST = 5
LEAST = 100
FIRST = 2000
SHARD = 1 << 19
BUCKET_BITS = 24
#: Words of the text for each bucket of hashed counts, about.
POSITIONS_PER_BUCKET = 32
CHUNK = 1 << 16
TASKS_PER_CORE = 2
SLICE = 2 << 20
SALTS = 64
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True


# --- coded texts --------------------------------------------------------------------------------------------------


def code(data: np.ndarray, bounds: np.ndarray, seed: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of some texts, their symbols, and all words in order as 1 + place among those, 0 between pieces."""
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    begin, end, _ = words(lower, bounds, _SPACE | _BREAK)
    if not len(begin):
        return pa.array([], pa.large_string()), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    solid = lower[~(_SPACE | _BREAK)[lower]]
    ends = np.concatenate([[0], np.cumsum(end - begin)])
    column = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(solid)))
    coded = column.dictionary_encode()
    own, at = raw(coded.dictionary)
    symbols = mix(Rolling(own).of(at[:-1], at[1:]) + np.diff(at).astype(np.uint64) * _ODD + np.uint64(seed))
    piece = np.cumsum(_BREAK[lower])[begin] + np.searchsorted(bounds, begin, "right")
    new = np.flatnonzero(np.diff(piece)) + 1
    return coded.dictionary, symbols, np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32) + 1, new, 0)


def _coded(docs: DataFrame, text_col: str, lang_col: str, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                for part in slices(batch.filter(pa.array(langs.indices.to_numpy() == i)), "text", SLICE):
                    found, symbols, places = code(*raw(part["text"]), seed)
                    if not len(found):
                        continue
                    counts = np.bincount(places, minlength=len(found) + 1)[1:]
                    small = np.uint16 if len(found) < 1 << 16 else np.uint32
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found.cast(pa.string())),
                            pa.array([symbols.view(np.int64)], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                            pa.array([places.astype(small).tobytes()], pa.binary()),
                        ],
                        ["lang", "words", "symbols", "counts", "places"],
                    )

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, words array<string>, symbols array<bigint>, counts array<bigint>, places binary")


def _words(coded: DataFrame) -> DataFrame:
    each = coded.select("lang", F.inline(F.arrays_zip("words", "symbols", "counts")))
    return each.groupBy("lang", "words", "symbols").agg(F.sum("counts").alias("f")).toDF("lang", "word", "symbol", "f")


# --- tries --------------------------------------------------------------------------------------------------------


class Trie:
    """Double array over phrases of one length: the child of node s by letter c is slot base[s] + c if check there is s.

    A word takes two steps, by the upper and the lower half of its number, so that a node's children lie close together.
    """

    def __init__(self, langs: np.ndarray, symbols: np.ndarray):
        """``langs`` (strings) and ``symbols`` (a row of unsigned longs for each phrase)."""
        self.length = symbols.shape[1]
        self.names, lang = np.unique(langs, return_inverse=True)
        self.alphabet, dense = np.unique(symbols, return_inverse=True)
        dense = dense.reshape(symbols.shape)
        # common symbols get small numbers, so that nodes with many children stay narrow
        rank = np.argsort(np.argsort(-np.bincount(dense.ravel(), minlength=len(self.alphabet)), kind="stable"), kind="stable")
        self.number, self.half = rank.astype(np.int32), max(1, (len(self.alphabet).bit_length() + 1) // 2)
        dense = np.stack([rank[dense] >> self.half, rank[dense] & ((1 << self.half) - 1)], axis=2).reshape(len(symbols), -1)
        letters, roots = 1 << self.half, len(self.names)
        lowest = roots + letters
        used = np.zeros(max(2 * lowest, 1 << 12), bool)
        used[:lowest] = True
        base, check = np.full(len(used), lowest, np.int64), np.full(len(used), -1, np.int64)
        order = np.lexsort((*dense.T[::-1], lang))
        dense, lang = dense[order], lang[order]
        node = lang.astype(np.int64)  # of each phrase, so far
        hint = top = lowest
        for depth in range(2 * self.length):
            c = dense[:, depth]
            new = np.ones(len(c), bool)
            new[1:] = (node[1:] != node[:-1]) | (c[1:] != c[:-1])
            parent, child = node[new], c[new]
            heads = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(heads, len(parent)))
            slot = np.empty(len(parent), np.int64)
            for g in np.argsort(-sizes, kind="stable").tolist():
                if sizes[g] < 2:
                    break
                a, b = heads[g], heads[g] + sizes[g]
                own = child[a:b]
                if top + 2 * letters + 256 > len(used):
                    grow = len(used)
                    used = np.concatenate([used, np.zeros(grow, bool)])
                    base, check = np.concatenate([base, np.full(grow, lowest)]), np.concatenate([check, np.full(grow, -1)])
                least, at = int(own.min()), -1
                for attempt in range(8):
                    bases = hint - least + 64 * attempt + np.arange(64)
                    if bases[-1] + letters >= len(used):
                        break
                    free = ~used[bases[:, None] + own[None, :]].any(axis=1)
                    if free.any():
                        at = int(bases[free.argmax()])
                        break
                if at < 0:
                    at = top - least
                    hint = max(hint, top - 4 * letters - 512)
                slot[a:b] = at + own
                used[slot[a:b]] = True
                top = max(top, int(slot[a:b].max()) + 1)
                base[parent[a]], check[slot[a:b]] = at, parent[a]
                while hint < top and used[hint]:
                    hint += 1
            alone = heads[sizes == 1]
            free = np.flatnonzero(~used[lowest:])[: len(alone)] + lowest
            short = len(alone) - len(free)
            if short > 0 or len(alone) and free[-1] + letters >= len(used):
                grow = max(short, 0) + 2 * letters + len(used)
                used = np.concatenate([used, np.zeros(grow, bool)])
                base, check = np.concatenate([base, np.full(grow, lowest)]), np.concatenate([check, np.full(grow, -1)])
                free = np.flatnonzero(~used[lowest:])[: len(alone)] + lowest
            slot[alone] = free
            used[free] = True
            top = max(top, int(free[-1]) + 1) if len(free) else top
            base[parent[alone]], check[free] = free - child[alone], parent[alone]
            node = slot[np.cumsum(new) - 1]
        size = int(base.max(initial=0)) + letters + 1
        size = max(size, top)
        pad = max(0, size - len(base))
        self.base = np.concatenate([base, np.full(pad, lowest)])[:size].astype(np.int32)
        self.check = np.concatenate([check, np.full(pad, -1)])[:size].astype(np.int32)
        self.accept = np.full(size, -1, np.int32)
        self.accept[node] = order

    def run(self, lang: str, symbols: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of this trie begin in a coded text, and their numbers."""
        root = int(np.searchsorted(self.names, lang))
        if root == len(self.names) or self.names[root] != lang or not len(self.alphabet):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        near = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        own = np.where(self.alphabet[near] == symbols, self.number[near], -1)
        letter = np.append(np.append(np.int32(-1), own.astype(np.int32))[places], np.full(self.length, -1, np.int32))
        at = np.flatnonzero(letter[: len(places)] >= 0)
        state = np.full(len(at), root, np.int32)
        for depth in range(self.length):
            step = letter[at + depth]
            fine = step >= 0
            at, state, step = at[fine], state[fine], step[fine]
            for shift, mask in ((self.half, -1), (0, (1 << self.half) - 1)):
                to = self.base[state] + ((step >> shift) & mask)
                fine = self.check[to] == state
                at, state, step = at[fine], to[fine], step[fine]
        return at, self.accept[state]


def _tries(phrases: DataFrame, shards: int) -> DataFrame:
    """One row for each shard: its phrases, numbered by place, and their trie."""

    def run(table: pa.Table) -> pa.Table:
        keys, langs = table["key"].to_pylist(), table["lang"].to_pylist()
        symbols = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(len(keys), -1)
        trie = Trie(np.array(langs, object), symbols)
        return pa.table(
            {
                "shard": table["shard"][:1], "langs": pa.array([langs], pa.list_(pa.string())),
                "keys": pa.array([keys], pa.list_(pa.binary())), "trie": pa.array([pickle.dumps(trie.__dict__, protocol=5)], pa.binary()),
            }
        )

    dealt = phrases.select("lang", "key", F.pmod(F.xxhash64("lang", "key"), F.lit(shards)).cast("int").alias("shard"))
    return cut_lineage(dealt.groupBy("shard").applyInArrow(run, "shard int, langs array<string>, keys array<binary>, trie binary"))


def _load(body: bytes) -> Trie:
    trie = Trie.__new__(Trie)
    trie.__dict__.update(pickle.loads(body))
    return trie


# --- passes over the coded texts ----------------------------------------------------------------------------------


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            symbols = batch["symbols"][i].values.to_numpy(zero_copy_only=False).view(np.uint64)
            body = batch["places"][i].as_buffer()
            yield batch["lang"][i].as_py(), symbols, np.frombuffer(body, np.uint16 if len(symbols) < 1 << 16 else np.uint32)


def _chunks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Chunks of an array of counts that hold any, in the least width."""
    for at in range(0, len(counts), CHUNK):
        part = counts[at : at + CHUNK]
        most = int(part.max(initial=0))
        if most:
            kind = "<u1" if most < 1 << 8 else "<u4" if most < 1 << 32 else "<u8"
            yield pa.RecordBatch.from_arrays(
                [pa.array([at // CHUNK], pa.int32()), pa.array([int(kind[2])], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())],
                ["chunk", "width", "counts"],
            )


def _reached(parts: DataFrame, least: int, marks: bool = False) -> DataFrame:
    """(place, f) of the counters whose sum over all tasks is at least ``least``, or for each chunk a bit for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                part = np.frombuffer(batch["counts"][i].as_buffer(), f"<u{batch['width'][i].as_py()}").astype(np.int64)
                chunk = batch["chunk"][i].as_py()
                if chunk in total:
                    total[chunk] += part
                else:
                    total[chunk] = part
        for chunk, sums in total.items():
            at = np.flatnonzero(sums >= least)
            if marks:
                bits = pa.array([np.packbits(sums >= least).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), bits], ["chunk", "bits"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(chunk * CHUNK + at), pa.array(sums[at])], ["place", "f"])

    return parts.repartition("chunk").mapInArrow(run, "chunk int, bits binary" if marks else "place bigint, f bigint")


class _Counter:
    """Counts of numbers under ``size``, in place."""

    def __init__(self, size: int):
        self.total = np.zeros(size, np.uint32)  # a task reads fewer words than that holds

    def add(self, places: np.ndarray) -> None:
        np.add.at(self.total, places, 1)


def _safe(trie: Trie, lone: bool, lang: str, symbols: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins of phrases one word longer than the trie's that may be frequent, numbers of their first parts, and hashes.

    With one trie both parts are looked up; else the last words are left to a join.
    """
    at, number = trie.run(lang, symbols, places)
    k = trie.length + 1
    fine = at + k <= len(places)
    at, number = at[fine], number[fine]
    if lone:
        begins = np.zeros(len(places) + 1, bool)
        begins[at] = True
        # the last place that can begin was cut above, though it can still begin the last words
        begins[trie.run(lang, symbols, places[-trie.length :])[0] + len(places) - trie.length] = True
        fine = begins[at + 1]
    else:
        fine = places[at + k - 1] > 0
    at, number = at[fine], number[fine]
    h = np.zeros(len(at), np.uint64)
    full = np.append(np.uint64(0), symbols)
    for j in range(k):
        h = mix(h * _ODD + full[places[at + j]])
    return at, number, h


def _buckets(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of each phrase, one in each half of ``1 << bits``."""
    shift = np.uint64(65 - bits)
    return (h >> shift).astype(np.int64), ((h * _ODD) >> shift).astype(np.int64) + (1 << (bits - 1))


def _frequent(spark: SparkSession, coded: DataFrame, before: DataFrame, total: int, k: int, least: int, shard: int) -> DataFrame:
    """(lang, key, f) of the phrases of ``k`` words that occur ``least`` times, from those of k - 1 words."""
    # each task ships tables of its own, so there are a few tasks for each core and not one for each file
    texts = coded.select("lang", "symbols", "places").coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    n = before.count()
    shards = max(1, -(-n // shard))
    tries = _tries(before, shards)
    bits = min(BUCKET_BITS, max(17, (total // POSITIONS_PER_BUCKET).bit_length()))
    lone, empty = shards == 1, spark.createDataFrame([], "lang string, key binary, f bigint")

    def bodies(table: DataFrame) -> Iterator[tuple[int, Broadcast]]:
        """One trie after another, broadcast while the loop's body runs."""
        for r in sorted(x["shard"] for x in table.select("shard").collect()):
            shared = spark.sparkContext.broadcast(bytes(table.where(F.col("shard") == r).select("trie").first()["trie"]))
            yield r, shared
            shared.unpersist()

    def buckets(shared: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spare_memory()
            trie, count = _load(shared.value), _Counter(1 << bits)
            for text in _texts(batches):
                for place in _buckets(_safe(trie, lone, *text)[2], bits):
                    count.add(place)
            yield from _chunks(count.total)

        return run

    parts = None
    for _, shared in bodies(tries):
        found = cut_lineage(texts.mapInArrow(buckets(shared), "chunk int, width int, counts binary"))
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return empty
    packed = bytearray(max(1 << bits, CHUNK) // 8)
    for r in _reached(parts, least, marks=True).collect():
        packed[r["chunk"] * CHUNK // 8 : r["chunk"] * CHUNK // 8 + len(r["bits"])] = r["bits"]
    marks = spark.sparkContext.broadcast(bytes(packed))

    def new(shared: Broadcast, phrases: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spare_memory()
            trie, own = _load(shared.value), np.frombuffer(phrases.value, ">u8").reshape(-1, k - 1)
            hot = np.unpackbits(np.frombuffer(marks.value, np.uint8)).view(bool)
            seen: dict[str, list] = {}

            def settle(lang: str) -> tuple[np.ndarray, np.ndarray]:
                number, last = (np.concatenate(x) for x in zip(*seen[lang]))
                order = np.lexsort((last, number))
                number, last = number[order], last[order]
                fresh = np.ones(len(number), bool)
                fresh[1:] = (number[1:] != number[:-1]) | (last[1:] != last[:-1])
                return number[fresh], last[fresh]

            for lang, symbols, places in _texts(batches):
                at, number, h = _safe(trie, lone, lang, symbols, places)
                one, two = _buckets(h, bits)
                fine = hot[one] & hot[two]
                seen.setdefault(lang, []).append((number[fine], np.append(np.uint64(0), symbols)[places[at[fine] + k - 1]]))
                if sum(len(x[0]) for x in seen[lang]) > 1 << 21:
                    seen[lang] = [settle(lang)]
            for lang in seen:
                number, last = settle(lang)
                for i in range(0, len(number), 1 << 16):
                    whole = np.concatenate([own[number[i : i + (1 << 16)]], last[i : i + (1 << 16), None].astype(">u8")], axis=1).astype(">u8")
                    body, step = whole.tobytes(), 8 * k
                    keys = pa.array([body[j : j + step] for j in range(0, len(body), step)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), keys], ["lang", "key"])

        return run

    candidates = None
    for r, shared in bodies(tries):
        keys = b"".join(bytes(x) for x in tries.where(F.col("shard") == r).select("keys").first()["keys"])
        found = cut_lineage(texts.mapInArrow(new(shared, spark.sparkContext.broadcast(keys)), "lang string, key binary").distinct())
        candidates = found if candidates is None else candidates.unionByName(found)
    if not lone:
        last = before.select("lang", F.col("key").alias("tail"))
        candidates = candidates.withColumn("tail", F.substring("key", 9, 8 * k)).join(last, ["lang", "tail"], "left_semi").drop("tail")
        candidates = cut_lineage(candidates)
    n = candidates.count()
    if not n:
        return empty
    tries = _tries(candidates, -(-n // shard))

    def accepted(shared: Broadcast, size: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spare_memory()
            trie, count = _load(shared.value), _Counter(size)
            for text in _texts(batches):
                count.add(trie.run(*text)[1])
            yield from _chunks(count.total)

        return run

    out = None
    sizes = {r["shard"]: r["n"] for r in tries.select("shard", F.size("keys").alias("n")).collect()}
    for r, shared in bodies(tries):
        found = cut_lineage(_reached(texts.mapInArrow(accepted(shared, sizes[r]), "chunk int, width int, counts binary"), least))
        found = found.withColumn("shard", F.lit(r))
        out = found if out is None else out.unionByName(found)
    numbered = tries.select("shard", F.posexplode(F.arrays_zip("langs", "keys")).alias("place", "p")).select(
        "shard", F.col("place").cast("bigint").alias("place"), F.col("p.langs").alias("lang"), F.col("p.keys").alias("key")
    )
    return cut_lineage(out.join(numbered, ["shard", "place"]).select("lang", "key", "f"))


# --- scores -------------------------------------------------------------------------------------------------------


def _symbol_key(symbol: str) -> F.Column:
    return F.unhex(F.lpad(F.hex(symbol), 16, "0"))


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, first: int = FIRST, longest: int = LONGEST, shard: int = SHARD
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``first`` best phrases of each language."""
    spark, seed = docs.sparkSession, 0
    while True:
        coded = cut_lineage(_coded(docs, text_col, lang_col, seed))
        vocabulary = cut_lineage(_words(coded))
        shared = vocabulary.groupBy("symbol").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a <> b")
        if shared.isEmpty():
            break
        seed += 1
    totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    common = cut_lineage(vocabulary.where(F.col("f") >= least).withColumn("key", _symbol_key("symbol")))
    levels = [common.select("lang", "key", "f")]
    for k in range(2, longest + 1):
        found = _frequent(spark, coded, levels[-1], total, k, least, shard)
        if found.isEmpty():
            break
        levels.append(found)
    if len(levels) < 2:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    every = union(levels)
    phrases = union(levels[1:]).withColumn("size", F.expr("length(key) div 8"))
    # a phrase inside a longer one that is as common is inside one with just one word more that is as common, too
    longer = phrases.where("size > 2").select(
        "lang", "f", F.explode(F.array(F.expr("substring(key, 1, 8 * size - 8)"), F.expr("substring(key, 9, 8 * size - 8)"))).alias("key")
    )
    kept = phrases.join(longer, ["lang", "key", "f"], "left_anti")
    cuts = kept.withColumn("cut", F.explode(F.expr("sequence(1L, size - 1L)"))).withColumns(
        {"left": F.expr("substring(key, 1, cast(8 * cut as int))"), "right": F.expr("substring(key, cast(8 * cut + 1 as int), cast(8 * (size - cut) as int))")}
    )
    left = every.select("lang", F.col("key").alias("left"), F.col("f").alias("l"))
    right = every.select("lang", F.col("key").alias("right"), F.col("f").alias("r"))
    exact = "(cast(1000 as decimal(4,0)) * cast(f as decimal(14,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))"
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang").withColumn("score", F.expr(exact))
    worst = scored.groupBy("lang", "key").agg(F.min(F.struct("score", "cut", "f", "l", "r", "n")).alias("w")).select("lang", "key", "w.*")
    at = F.posexplode(F.expr("transform(sequence(1, length(key) div 8), i -> substring(key, 8 * i - 7, 8))")).alias("i", "part")
    spelt = worst.select("lang", "key", at).join(common.select("lang", F.col("key").alias("part"), "word"), ["lang", "part"])
    text = spelt.groupBy("lang", "key").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("ws"))
    text = text.select("lang", "key", F.array_join(F.col("ws.word"), " ").alias("phrase"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = worst.join(text, ["lang", "key"]).select("lang", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= first)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
