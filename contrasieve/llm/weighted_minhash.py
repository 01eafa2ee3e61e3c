"""Near copies by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words. Its weight in a text is its count times an inverse document frequency from a count-min
sketch of the whole corpus: the sketch has a fixed size, its error is a fixed share of the corpus, and shingles rarer
than ``COMMON`` of all documents weigh the same. Samples collide with the probability of the weighted Jaccard
similarity; ``BANDS`` bands of ``ROWS`` samples find candidates, and the exact weighted similarity decides.

Equal texts are one vertex. Each bucket's members are first compared with its smallest id. Members of a bucket that
this leaves in different classes are then compared with each other, in blocks, so no link is lost to the choice of
the one they were compared with. A pair of similarity s is missed with probability (1 - s**ROWS)**BANDS:
2e-4 at 0.8, 7e-6 at 0.85.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasieve.llm._keys import KEY, own_keys, with_ids
from contrasieve.llm._repeats import packed_texts, unpack
from contrasieve.llm._scan import NO_ID, Rolling, longs, mix, raw, slices, spare_memory, word_hashes, words
from contrasieve.operators.graph import connected_components
from contrasieve.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 3
#: Document share from which a shingle weighs less; two sketch rows of this many counters.
COMMON = 0.01
WIDTH = 1 << 19
#: Members of a bucket that one task compares at a time.
BLOCK = 384


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), ordered by text and shingle. A text of one to four words is one shingle."""
    begin, end, first_word = words(data, bounds)
    n_words = np.diff(first_word)
    tokens = Rolling(word_hashes(data, begin, end)) if len(begin) else None
    if tokens is None:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), n_words)
    at = np.flatnonzero(np.arange(len(begin)) + SHINGLE <= first_word[1:][owner])
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    a = np.concatenate([at, first_word[short]])
    b = np.concatenate([at + SHINGLE, first_word[short + 1]])
    value, text = mix(tokens.of(a, b)), np.concatenate([owner[at], short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    return text[head], value[head], np.diff(np.append(head, len(value)))


def _cells(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (value & np.uint64(WIDTH - 1)).astype(np.int64), ((value >> np.uint64(32)) & np.uint64(WIDTH - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """The sketch (two rows of WIDTH counts) and the number of documents. It has the same size for any corpus."""
    piece = 1 << 15

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        sketch, rows = np.zeros(2 * WIDTH, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for part in slices(batch, "text"):
                one, two = _cells(shingles(*raw(part["text"]))[1])
                sketch[:WIDTH] += np.bincount(one, minlength=WIDTH)
                sketch[WIDTH:] += np.bincount(two, minlength=WIDTH)
        if rows:
            yield out([*enumerate(sketch.reshape(-1, piece)), (-1, np.array([rows]))])

    def out(parts) -> pa.RecordBatch:
        codec = pa.Codec("zstd")
        cells = [codec.compress(np.ascontiguousarray(p), asbytes=True) for _, p in parts]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array(cells, pa.binary())], ["piece", "cells"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sums = pa.Codec("zstd"), {}
        for batch in batches:
            for k, cells in zip(batch["piece"].to_pylist(), batch["cells"]):
                sums[k] = sums.get(k, 0) + np.frombuffer(codec.decompress(cells.as_py(), 8 * (piece if k >= 0 else 1), asbytes=True), np.int64)
        if sums:
            yield out(list(sums.items()))

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    parts = texts.mapInArrow(count, "piece int, cells binary").repartition("piece").mapInArrow(total, "piece int, cells binary").collect()
    codec = pa.Codec("zstd")
    found = {r["piece"]: np.frombuffer(codec.decompress(bytes(r["cells"]), 8 * (piece if r["piece"] >= 0 else 1), asbytes=True), np.int64) for r in parts}
    if -1 not in found:
        return np.zeros((2, WIDTH), np.int64), 0
    return np.concatenate([found[k] for k in range(2 * WIDTH // piece)]).reshape(2, WIDTH), int(found[-1][0])


def inverse_frequencies(sketch: np.ndarray, n: int) -> np.ndarray:
    """1 + log(n / df) for each counter, with rare shingles all alike."""
    return (1 + np.log(max(n, 1) / np.clip(sketch, max(1, COMMON * n), max(n, 1)))).astype(np.float32)


def weights(value: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    one, two = _cells(value)
    return count.astype(np.float32) * np.maximum(idf[0][one], idf[1][two])


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """65,536 equally likely values of Gamma(2, 1), and their logarithms."""
    grid = np.linspace(0, 40, 400_001)
    value = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + grid) * np.exp(-grid), grid)
    return value.astype(np.float32), np.log(value).astype(np.float32)


def samples(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n_texts: int, tables) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and for each of them BANDS * ROWS consistent samples (shingle and quantum)."""
    gamma, log_gamma = tables
    if not len(text):
        return np.zeros(0, np.int64), np.zeros((0, BANDS * ROWS), np.uint64)
    head = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.append(head, len(text)))
    log_w = np.log(weight)
    out = np.empty((len(head), BANDS * ROWS), np.uint64)
    for j in range(BANDS * ROWS):
        x = value * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3)) % (1 << 64) | 1)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        lanes = x.view(np.uint16).reshape(-1, 4)
        r = gamma[lanes[:, 0]]
        quantum = np.floor(log_w / r + lanes[:, 2] * np.float32(2**-16))
        log_a = log_gamma[lanes[:, 1]] - r * (quantum - lanes[:, 2] * np.float32(2**-16) + 1)
        least = np.minimum.reduceat(log_a, head)
        hit = np.flatnonzero(log_a == np.repeat(least, size))
        first = hit[np.searchsorted(hit, head)]
        out[:, j] = mix(value[first] + mix(quantum[first].astype(np.int64).view(np.uint64) + np.uint64(j)))
    return text[head], out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (ordered shingles, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    low = np.minimum(a[1][at[both]], b[1][both]).sum(dtype=np.float64)
    return low / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - low)


class _Vectors:
    """Shingle vectors of packed texts."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf

    def of(self, size: int, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        data = unpack(size, body)
        _, value, count = shingles(data, np.array([0, size]))
        return value, weights(value, count, self.idf)


EDGES = "src bigint, dst bigint"


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    src, dst = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _with_leads(edges: DataFrame, texts: DataFrame, idf, least: float, parts: int) -> DataFrame:
    """Edges (lead, doc) whose similarity reaches ``least``. A lead's edges are cut into portions of some hundreds."""
    many = edges.groupBy("lead").agg(F.ceil(F.count("*") / (4 * BLOCK)).alias("portions"))
    dealt = edges.join(many, "lead").withColumn("portion", F.pmod(F.xxhash64("doc"), F.col("portions"))).select("lead", "portion", "doc")
    own = dealt.select("lead", "portion").distinct().withColumn("doc", F.col("lead"))
    rows = own.withColumn("own", F.lit(0)).unionByName(dealt.withColumn("own", F.lit(1))).join(texts, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        vectors, lead, now = _Vectors(idf.value), None, None
        for batch in batches:
            found = []
            for doc, head, own_, size, body in zip(*(batch[c].to_pylist() for c in ("doc", "lead", "own", "size")), batch["body"]):
                vector = vectors.of(size, body.as_py())
                if own_ == 0:
                    lead, now = head, vector
                elif lead == head and similarity(now, vector) >= least:
                    found.append((head, doc))
            yield _edges(found)

    return rows.repartition(parts, "lead", "portion").sortWithinPartitions("lead", "portion", "own").mapInArrow(run, EDGES)


def _among(members: DataFrame, texts: DataFrame, idf, least: float, parts: int) -> DataFrame:
    """Links between members (bucket, doc, class) of one bucket that are not in one class yet.

    The largest class of a bucket is its main one. The others' documents, in blocks, meet every portion of the main
    class and every block of their own, and each meeting is one group of bounded size. Inside it, classes that a link
    joins are one from then on, so a group gives fewer edges than it has members.
    """
    sizes = members.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    plans = sizes.groupBy("bucket").agg(F.max_by("class", F.struct("n", -F.col("class"))).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    plans = plans.select("bucket", "main", F.ceil(F.col("n_main") / (4 * BLOCK)).cast("int").alias("portions"), F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(plans, "bucket").withColumn("is_main", F.col("class") == F.col("main"))
    placed = placed.withColumn("b", F.pmod(F.xxhash64("doc"), F.when(F.col("is_main"), F.col("portions")).otherwise(F.col("blocks"))).cast("int"))

    def numbers(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("k")

    others = placed.where("NOT is_main")
    shown = ["bucket", "doc", "class"]
    with_main = placed.where("is_main").select(*shown, "b", numbers("blocks")).select(*shown, F.col("k").alias("i"), (-1 - F.col("b")).alias("j"), F.lit(1).alias("side"))
    to_main = others.select(*shown, "b", numbers("portions")).select(*shown, F.col("b").alias("i"), (-1 - F.col("k")).alias("j"), F.lit(0).alias("side"))
    among = others.select(*shown, "b", numbers("blocks")).select(*shown, F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j"), F.when(F.col("b") <= F.col("k"), 0).otherwise(1).alias("side"))
    met = with_main.unionByName(to_main).unionByName(among).join(texts, "doc")

    def close(first: list, second: list, mixed: bool) -> list[tuple[int, int]]:
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        found = []
        pairs = ((x, y) for y in second for x in first) if mixed else ((first[k], y) for n, y in enumerate(first) for k in range(n))
        for (doc, kind, vector), (doc2, kind2, vector2) in pairs:
            if root(kind) != root(kind2) and similarity(vector, vector2) >= least:
                parent[root(kind)] = root(kind2)
                found.append((doc, doc2))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        vectors, now, sides = _Vectors(idf.value), (0, 0, 0), ([], [])
        for batch in batches:
            found = []
            for bucket, i, j, side, doc, kind, size, body in zip(*(batch[c].to_pylist() for c in ("bucket", "i", "j", "side", "doc", "class", "size")), batch["body"]):
                if (bucket, i, j) != now:
                    found += close(*sides, now[1] != now[2])
                    now, sides = (bucket, i, j), ([], [])
                sides[side].append((doc, kind, vectors.of(size, body.as_py())))
            yield _edges(found)
        yield _edges(close(*sides, now[1] != now[2]))

    return met.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, EDGES)


def signatures(docs: DataFrame, id_col: str, text_col: str, idf) -> DataFrame:
    """(doc, h1, h2, bands): a fingerprint of each text and its band keys (none without words)."""
    tables = _quantiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = raw(part["text"])
                view, cut = memoryview(data), bounds.tolist()
                prints = np.frombuffer(b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:])), np.int64).reshape(-1, 2)
                text, value, count = shingles(data, bounds)
                who, found = samples(text, value, weights(value, count, idf.value), part.num_rows, tables)
                keys = found[:, 0::ROWS].copy()
                for k in range(1, ROWS):
                    keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + found[:, k::ROWS])
                sizes = np.zeros(part.num_rows + 1, np.int32)
                sizes[who + 1] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.ascontiguousarray(keys).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(longs(part["doc"])), pa.array(np.ascontiguousarray(prints[:, 0])), pa.array(np.ascontiguousarray(prints[:, 1])), bands], ["doc", "h1", "h2", "bands"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc bigint, h1 bigint, h2 bigint, bands array<bigint>")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: id, same_text (smallest id with this text) and class_id (smallest id of its class).

    Documents are linked if their weighted Jaccard similarity is at least ``least``; classes are what links connect.
    Null text is empty; texts without words are linked to equal texts only, shorter ones than five words to texts of
    the same words. Null ids come first of all and return as null. Rows that share an id are vertices of their own.
    An empty table gives no rows. Other columns are ignored.
    """
    if (keyed := own_keys(docs.select(id_col, text_col), id_col, text_col)) is not None:
        found = near_copies(keyed, KEY, text_col, least)
        return with_ids(found, keyed, id_col, KEY, "same_text", "class_id").withColumnRenamed(KEY, id_col)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch, n = document_frequencies(docs, text_col)
    idf = spark.sparkContext.broadcast(inverse_frequencies(sketch, n))
    signed = cut_lineage(signatures(docs, id_col, text_col, idf))
    texts_of = signed.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.first("bands").alias("bands"))
    distinct = cut_lineage(texts_of)
    keyed = distinct.select(F.col("rep").alias("doc"), F.posexplode("bands").alias("band", "value")).select("doc", F.xxhash64("band", "value").alias("bucket"))
    buckets = keyed.groupBy("bucket").agg(F.min("doc").alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(keyed.join(buckets.select("bucket", "lead"), "bucket"))
    texts = packed_texts(docs, id_col, text_col)
    stars = members.where("doc <> lead").select("lead", "doc").distinct()
    linked = cut_lineage(_with_leads(stars, texts, idf, least, parts))
    classes = cut_lineage(connected_components(linked)) if not linked.isEmpty() else None

    def class_of(rows: DataFrame, key: str, out: str) -> DataFrame:
        if classes is None:
            return rows.withColumn(out, F.col(key))
        return rows.join(classes.select(F.col("vertex").alias(key), F.col("component").alias(out)), key, "left").withColumn(out, F.coalesce(out, key))

    classed = cut_lineage(class_of(members.select("bucket", "doc"), "doc", "class"))
    split = classed.groupBy("bucket").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z").select("bucket")
    more = cut_lineage(_among(classed.join(split, "bucket"), texts, idf, least, parts))
    if not more.isEmpty():
        classes = cut_lineage(connected_components(linked.unionByName(more)))
    reps = distinct.select("h1", "h2", "rep")
    out = class_of(signed.select("doc", "h1", "h2").join(reps, ["h1", "h2"]), "rep", "class_id")
    shown = [F.nullif(F.col(c), F.lit(NO_ID)).alias(a) for c, a in (("doc", id_col), ("rep", "same_text"), ("class_id", "class_id"))]
    return out.select(*shown)
