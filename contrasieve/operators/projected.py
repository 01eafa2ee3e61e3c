"""Nearest neighbours by random projections, with recall measured on the table itself.

A tree halves the points again and again at the median of their projections on the line between two of them; the medians
come from a bounded sample, so a tree is a table of fixed size. Points that meet in a leaf are compared as one matrix.
Only ids and similarities leave a leaf. Trees are added in lots until the lists of a sample of queries, compared
with their exact lists, hold the share of true neighbours that was asked for. Vectors move once per tree, so the
work grows with the rows times the trees and not with the number of cells a query might have to visit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasieve.operators.neighbours import DIGITS, unit_rows
from contrasieve.operators.sampling import top_per_group
from contrasieve.session import cut_lineage, discard

LEAF = 2048
LOT = 8
MAX_TREES = 64
SAMPLE = 16384
DEEPEST = 12
QUERIES = 256


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def plant(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and medians of the 2**depth - 1 inner nodes of a tree, the children of node i being 2i + 1 and 2i + 2."""
    draw = np.random.default_rng(seed)
    lines, cuts = np.zeros(((1 << depth) - 1, sample.shape[1])), np.zeros((1 << depth) - 1)
    inside = [np.arange(len(sample))]
    for node in range(len(cuts)):
        own = inside[node]
        if len(own) > 1:
            a, b = draw.choice(own, 2, replace=False)
            lines[node] = sample[a] - sample[b]
            shadow = sample[own] @ lines[node]
            cuts[node] = np.median(shadow)
            right = shadow > cuts[node]
            inside += [own[~right], own[right]]
        else:
            inside += [own, own[:0]]
    return lines, cuts


def leaves(x: np.ndarray, lines: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range((len(cuts) + 1).bit_length() - 1):
        shadow = np.einsum("ij,ij->i", x, lines[node])
        node = 2 * node + 1 + (shadow > cuts[node])
    return node - len(cuts)


def _meet(ids: np.ndarray, x: np.ndarray, k: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, other, similarity) of the ``k`` best others of each point; larger groups are halved first."""
    if len(ids) > limit:
        far = x[0] - x[int(((x - x[0]) ** 2).sum(axis=1).argmax())]
        order = np.argsort(x @ far, kind="stable")
        for half in (order[: len(order) // 2], order[len(order) // 2 :]):
            yield from _meet(ids[half], x[half], k, limit)
        return
    take = min(k, len(ids) - 1)
    if take < 1:
        return
    for lo in range(0, len(ids), 512):
        sims = np.round(x[lo : lo + 512] @ x.T, DIGITS)
        sims[np.arange(len(sims)), lo + np.arange(len(sims))] = -2
        best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        yield np.repeat(ids[lo : lo + 512], take), ids[best.ravel()], np.take_along_axis(sims, best, axis=1).ravel()


def _tree_lists(points: DataFrame, trees: list[tuple[np.ndarray, np.ndarray]], k: int, leaf: int) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(trees)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["v"])
                for t, tree in enumerate(shared.value):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, np.int32)), pa.array(leaves(x, *tree).astype(np.int32)), batch["id"], batch["v"]], ["tree", "leaf", "id", "v"]
                    )

    def meet(table: pa.Table) -> pa.Table:
        found = list(_meet(table["id"].to_numpy(), _matrix(table["v"].combine_chunks()), k, 2 * leaf))
        parts = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("id", "other", "sim"), parts)))

    placed = points.select("id", "v").mapInArrow(assign, "tree int, leaf int, id bigint, v array<double>")
    return placed.groupBy("tree", "leaf").applyInArrow(meet, "id bigint, other bigint, sim double")


def _best(lists: DataFrame, k: int) -> DataFrame:
    return top_per_group(lists.distinct(), ["id"], [F.desc("sim"), F.col("other")], k, "other", slices=1)


def _exact(points: DataFrame, queries: list, k: int) -> DataFrame:
    """Exact lists of a bounded number of queries: a stated set against all points, batch by batch."""
    ids, x = np.array([r["id"] for r in queries]), np.array([r["v"] for r in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["id"].to_numpy()
            sims = np.round(x @ _matrix(batch["v"]).T, DIGITS) if batch.num_rows else np.zeros((len(x), 0))
            sims[ids[:, None] == own[None, :]] = -2
            take = min(k, sims.shape[1])
            if take:
                best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, take)), pa.array(own[best.ravel()]), pa.array(np.take_along_axis(sims, best, axis=1).ravel())], ["id", "other", "sim"]
                )

    found = points.select("id", "v").mapInArrow(run, "id bigint, other bigint, sim double").filter("sim > -2")
    return top_per_group(found, ["id"], [F.desc("sim"), F.col("other")], k, "other")


def knn_graph_projected(
    df: DataFrame, key: str, vector: str, k: int = 5, recall: float = 0.95, leaf: int = LEAF, seed: int = 42, report: dict | None = None
) -> DataFrame:
    """(src, dst, sim): ``k`` near other rows of every row, with at least ``recall`` of the true ones.

    Recall is measured on ``QUERIES`` hashed points against all rows (a neighbour counts if its similarity reaches that of the
    true k-th). Equal vectors are one point with its k + 1 smallest keys. An error is raised if ``MAX_TREES`` trees
    do not reach it. ``report`` receives the recall and the number of trees.
    """
    rows = cut_lineage(unit_rows(df, key, vector))
    near = top_per_group(rows, ["h"], [F.col("key")], k + 1, "key")
    grouped = near.groupBy("h").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("key")).alias("keys"))
    points = cut_lineage(grouped.withColumn("id", F.monotonically_increasing_id()))
    n = points.count()
    if not n:
        if report is not None:
            report |= {"recall": 1.0, "trees": 0, "points": 0}
        return rows.select(F.col("key").alias("src"), F.col("key").alias("dst"), F.lit(0.0).alias("sim"))
    share = min(1.0, 2 * SAMPLE / max(n, 1))
    sample = points.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("v").limit(SAMPLE).collect()
    sample = np.array([r["v"] for r in sample], dtype=np.float64).reshape(len(sample), -1)
    depth = 0 if n <= 2 * leaf else min(DEEPEST, int(np.ceil(np.log2(n / leaf))))
    queries = points.orderBy(F.xxhash64("h", F.lit(seed)), "h").limit(QUERIES).select("id", "v").collect()
    truth = cut_lineage(_exact(points, queries, k))
    lists, planted, found = None, 0, 0.0
    while True:
        lot = 1 if depth == 0 else LOT
        trees = [plant(sample, depth, seed + planted + t) for t in range(lot)]
        fresh = _best(_tree_lists(points, trees, k, leaf), k)
        old, lists = lists, cut_lineage(_best(lists.unionByName(fresh), k) if lists is not None else fresh)
        discard(old)
        planted += lot
        kth = truth.groupBy("id").agg(F.min("sim").alias("kth"), F.count("*").alias("n"))
        hits = lists.join(kth, "id").filter(F.col("sim") >= F.col("kth")).count()
        found = hits / max(truth.count(), 1)
        if depth == 0 or found >= recall:
            break
        if planted >= MAX_TREES:
            raise RuntimeError(f"{planted} trees reach a recall of {found:.3f}, not {recall}")
    if report is not None:
        report |= {"recall": min(found, 1.0), "trees": planted, "points": n}
    keys = points.select("id", "keys")
    own = points.select(F.col("id"), F.col("id").alias("other"), F.lit(1.0).alias("sim"))
    every = lists.unionByName(own).join(keys.withColumnRenamed("id", "other"), "other").select("id", "sim", F.explode("keys").alias("dst"))
    every = top_per_group(every, ["id"], [F.desc("sim"), F.col("dst")], k + 1, "dst", slices=1)
    ids = points.select("id", "h")
    out = rows.select(F.col("key").alias("src"), "h").join(ids, "h").join(every, "id").filter("src <> dst").select("src", "dst", "sim")
    return top_per_group(out, ["src"], [F.desc("sim"), F.col("dst")], k, "dst", slices=1)
