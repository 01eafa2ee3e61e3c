"""Topic models on term tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasieve.operators.sampling import top_per_group
from contrasieve.session import cut_lineage, discard

#: Numbers of column factors that are sent to every task; more are joined.
BROADCAST_CELLS = 2_000_000


def vocabulary(lists: DataFrame, tokens: str, size: int, min_df: float, max_df: float) -> list[str]:
    """The ``size`` most frequent words, ties by word, of those in ``min_df`` to ``max_df`` rows (below 1: share of the rows).

    Each task adds up its words; token lists are neither cached nor brought together.
    """
    n = lists.count()
    least, most = (x if x >= 1 else x * n for x in (min_df, max_df))
    if most < least:
        raise ValueError(f"max_df gives {most} rows, fewer than the {least} of min_df")
    found = F.transform(tokens, lambda w: F.struct(w.alias("word"), F.lit(1).alias("n"), F.lit(0).alias("rows")))
    rows = F.transform(F.array_distinct(tokens), lambda w: F.struct(w.alias("word"), F.lit(0).alias("n"), F.lit(1).alias("rows")))
    counts = lists.select(F.inline(F.concat(found, rows))).groupBy("word").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    best = counts.filter(F.col("rows").between(least, most)).orderBy(F.desc("n"), "word").limit(size).collect()
    if not best:
        raise ValueError("no word is left; lower min_df")
    return [r["word"] for r in best]


def lda_topics(
    df: DataFrame, key: str, tokens: Column, positive: Column, k: int = 8, vocab_size: int = 5000, min_df: float = 5.0,
    max_df: float = 0.85, rounds: int = 20, top: int = 10, seed: int = 42,
) -> DataFrame:
    """Per topic: top words, documents it dominates, percent positive among them.

    Each of the ``rounds`` of the online optimiser draws as many documents as there are.
    """
    lists = cut_lineage(df.select(positive.alias("_pos"), tokens.alias("_tokens")), compression="zstd")
    counter = CountVectorizerModel.from_vocabulary(vocabulary(lists, "_tokens", vocab_size, min_df, max_df), "_tokens", "features")
    counts = cut_lineage(counter.transform(lists).select("_pos", "features"))  # read once per round
    model = LDA(k=k, maxIter=rounds, optimizer="online", subsamplingRate=1.0, seed=seed).fit(counts)
    words = F.array(*[F.lit(w) for w in counter.vocabulary])  # at most vocab_size words
    named = model.describeTopics(top).withColumn("_v", words).select(
        "topic", F.array_join(F.transform("termIndices", lambda i: F.get("_v", i)), " ").alias("words")
    )
    dist = vector_to_array("topicDistribution")
    best = model.transform(counts).select("_pos", (F.array_position(dist, F.array_max(dist)) - 1).cast("int").alias("topic"))
    sizes = best.groupBy("topic").agg(F.count("*").alias("n_docs"), (100 * F.avg(F.col("_pos").cast("int"))).alias("pct_pos"))
    return named.join(sizes, "topic", "left").fillna(0, ["n_docs"])


def _seeded(df: DataFrame, key: str, k: int, scale: float, seed: int) -> DataFrame:
    """(key, f): start values between 0.5 and 1.5 times ``scale`` from a hash of the key."""
    draws = [scale * (0.5 + F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(j)), F.lit(1 << 30)) / float(1 << 30)) for j in range(k)]
    return df.select(key, F.array(*draws).alias("f"))


def _gram(factors: DataFrame, k: int) -> list[list[float]]:
    cells = [F.sum(F.get("f", F.lit(i)) * F.get("f", F.lit(j))).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    row = factors.agg(*cells).first()
    return [[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]


def non_negative_factors(
    weights: DataFrame, row: str, column: str, weight: str, k: int, rounds: int = 200, tolerance: float = 1e-3, seed: int = 42,
    check_every: int = 10, trace: list[float] | None = None, broadcast_cells: int = BROADCAST_CELLS,
) -> tuple[DataFrame, DataFrame]:
    """(row, f) and (column, f) with non-negative f of length ``k`` whose products come close to the weights.

    Multiplicative updates of the Frobenius loss; pairs that are absent are zeros. Only the weights
    that are there are read; the rest enters through k x k matrices of sums. Column factors of at most
    ``broadcast_cells`` numbers go to the tasks, others are joined. The error is looked at every
    ``check_every`` rounds, and they end when it has fallen by less than ``tolerance`` of the first one. Keys may have any
    type. ``trace`` collects the error of each round.
    """
    a = cut_lineage(weights.select(row, column, F.col(weight).cast("double").alias("x")).filter("x > 0"))
    total = a.agg(F.sum(F.col("x") * F.col("x")).alias("q"), F.avg("x").alias("m")).first()
    scale = ((total["m"] or 0.0) / k) ** 0.5
    w = cut_lineage(_seeded(a.select(row).distinct(), row, k, scale, seed))
    h = cut_lineage(_seeded(a.select(column).distinct(), column, k, scale, seed + 1))
    if not total["q"]:
        return w, h
    if h.count() * k <= broadcast_cells:
        return _factors_by_row(a, w, h, row, column, total["q"], k, rounds, tolerance, check_every, trace)

    def pulled(own: str, other: str, factors: DataFrame) -> DataFrame:
        sums = [F.sum(F.col("x") * F.get("f", F.lit(j))).alias(f"n{j}") for j in range(k)]
        return a.join(factors, other).groupBy(own).agg(*sums).select(own, F.array(*[f"n{j}" for j in range(k)]).alias("n"))

    def updated(factors: DataFrame, sums: DataFrame, own: str, gram: list[list[float]]) -> DataFrame:
        g = np.array(gram)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f, n = (batch[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, k) for c in ("f", "n"))
                new = f * n / np.maximum(f @ g, 1e-12)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, new.size + 1, k), pa.int32()), pa.array(new.ravel()))
                yield pa.RecordBatch.from_arrays([batch[own], cells], [own, "f"])

        both = factors.join(sums, own)
        return both.mapInArrow(run, f"`{own}` {dict(both.dtypes)[own]}, f array<double>")

    errors: list[float] = []
    first = last = None
    gram_h = _gram(h, k)
    for i in range(1, rounds + 1):
        old, w = w, cut_lineage(updated(w, pulled(row, column, h), row, gram_h))
        discard(old)
        gram_w, sums = _gram(w, k), pulled(column, row, w)
        look = trace is not None or i % check_every == 0
        if look:
            sums = cut_lineage(sums)
            met = h.join(sums, column).agg(F.sum(sum(F.get("f", F.lit(j)) * F.get("n", F.lit(j)) for j in range(k)))).first()[0]
            square = total["q"] - 2 * met + sum(gram_w[x][y] * gram_h[x][y] for x in range(k) for y in range(k))
            errors.append(max(square, 0.0) ** 0.5)
        old, h = h, cut_lineage(updated(h, sums, column, gram_w))
        discard(old, sums)
        gram_h = _gram(h, k)
        if i % check_every == 0:
            if last is not None and last - errors[-1] < tolerance * first:
                break
            first, last = first or errors[-1], errors[-1]
    if trace is not None:
        trace += errors
    return w, h


def _factors_by_row(
    a: DataFrame, w: DataFrame, h: DataFrame, row: str, column: str, q: float, k: int, rounds: int, tolerance: float, check_every: int, trace: list[float] | None
) -> tuple[DataFrame, DataFrame]:
    """The updates of :func:`non_negative_factors` in one pass over the rows a round.

    A row's weights stay together on disk, dealt by row. A task makes new row factors from the column factors, adds up
    what its rows pull at each column, and only these sums and the small row factors are written.
    """
    spark = a.sparkSession
    start = h.toArrow()
    names, cols = start[column].combine_chunks(), start["f"].combine_chunks().flatten().to_numpy().reshape(-1, k)
    met = np.array([x is not None for x in names.to_pylist()])
    places = spark.createDataFrame(pa.table({column: names, "_c": pa.array(np.arange(len(names)), pa.int32())}))
    parts = spark.sparkContext.defaultParallelism
    cells = a.filter(F.col(row).isNotNull()).join(F.broadcast(places), column).groupBy(row).agg(F.collect_list(F.struct("_c", "x")).alias("cells"))
    held = cells.select(row, F.col("cells._c").alias("c"), F.col("cells.x").alias("x")).repartition(parts, row).persist(StorageLevel.DISK_ONLY)
    kind = dict(a.dtypes)[row]
    errors: list[float] = []
    first = last = None
    for i in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast((cols, cols[met].T @ cols[met] if i > 1 else cols.T @ cols))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, gram = shared.value
            pull, square = np.zeros_like(own), np.zeros((k, k))
            listed = lambda f: pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, k), pa.int32()), pa.array(f.ravel()))
            keys = None
            for batch in batches:
                keys = batch[row]
                c, x = (batch[n].flatten().to_numpy(zero_copy_only=False) for n in ("c", "x"))
                of = np.repeat(np.arange(batch.num_rows), batch["c"].value_lengths().to_numpy(zero_copy_only=False))
                f = batch["f"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                n = np.column_stack([np.bincount(of, x * own[c, j], batch.num_rows) for j in range(k)])
                new = f * n / np.maximum(f @ gram, 1e-12)
                for j in range(k):
                    pull[:, j] += np.bincount(c, x * new[of, j], len(own))
                square += new.T @ new
                yield pa.RecordBatch.from_arrays([keys, listed(new), pa.nulls(len(new), pa.int32())], [row, "f", "c"])
            if keys is not None:
                sums = np.concatenate([pull, square])
                at = pa.array(np.arange(len(sums)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(sums), keys.type), listed(sums), at], [row, "f", "c"])

        both = held.join(w.hint("shuffle_hash"), row).select(row, "c", "x", "f")
        written = cut_lineage(both.mapInArrow(run, f"`{row}` {kind}, f array<double>, c int"))
        discard(w)
        w = written.filter("c IS NULL").select(row, "f")
        w.__dict__["_cut_at"] = written.__dict__["_cut_at"]
        sums = written.filter("c IS NOT NULL").groupBy("c").agg(*[F.sum(F.get("f", F.lit(j))).alias(f"n{j}") for j in range(k)]).orderBy("c").toArrow()
        pulls = np.column_stack([sums[f"n{j}"].to_numpy() for j in range(k)])
        pulls, gram_w = pulls[: len(cols)], pulls[len(cols) :]
        met &= (pulls > 0).any(axis=1) if i == 1 else True
        if trace is not None or i % check_every == 0:
            before = cols[met].T @ cols[met] if i > 1 else cols.T @ cols
            errors.append(max(q - 2 * float((cols * pulls)[met].sum()) + float((gram_w * before).sum()), 0.0) ** 0.5)
        cols = cols * pulls / np.maximum(cols @ gram_w, 1e-12)
        shared.unpersist()
        if i % check_every == 0:
            if last is not None and last - errors[-1] < tolerance * first:
                break
            first, last = first or errors[-1], errors[-1]
    held.unpersist()
    if trace is not None:
        trace += errors
    f = cols[met]
    table = pa.table({column: names.filter(pa.array(met)), "f": pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, k), pa.int32()), pa.array(f.ravel()))})
    return w, spark.createDataFrame(table)


def nmf_topics(weights: DataFrame, key: str, k: int = 8, rounds: int = 200, top: int = 10, seed: int = 42) -> DataFrame:
    """Top terms of each factor of a non-negative factorisation of the (document, term) weights."""
    _, terms = non_negative_factors(weights, key, "term", "weight", k, rounds, seed=seed)
    loads = terms.select("term", F.posexplode("f").alias("topic", "load"))
    best = top_per_group(loads, ["topic"], [F.desc("load"), F.col("term")], top, "term")
    return best.groupBy("topic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("load")).alias("l"), "term"))), lambda s: s["term"]), " ").alias("words")
    )
