"""Exact nearest neighbours by cosine.

Vectors are put on the unit sphere and equal ones are merged, so a group of copies is compared
once. A stock that is small (counted first) is sent to every task. A larger one is split into
cells around pivots, and cells are put together on shelves of at most ``BLOCK_CELLS`` numbers: each query
searches its own shelf, then only the shelves with a cell that the triangle inequality cannot rule out, so a
vector travels once per shelf and not once per cell. Inside a task one block of queries meets one block of
stock in matrix products of bounded size, and only the best ``k`` per query leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasieve.functions import vector as vx
from contrasieve.operators.sampling import top_per_group
from contrasieve.session import cut_lineage

BLOCK_CELLS = 4_000_000
LEAST_BLOCK = 1024
SHARES = 6
PRODUCT = 2_000_000
BROADCAST_CELLS = 2_000_000
MAX_PIVOTS = 1024
SLACK = 1e-6
DIGITS = 9


def unit_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, h, v): unit vectors and a hash that copies share; zero vectors have no direction."""
    rows = df.filter(vx.l2_norm(F.col(vector)) > 0).select(F.col(key).alias("key"), vx.normalise(F.col(vector)).alias("v"))
    text = F.array_join(F.transform("v", lambda x: F.round(x, 12).cast("string")), ",")
    return rows.select("key", F.md5(text).alias("h"), "v")


def _cells(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _far(batch: pa.RecordBatch, pivots: np.ndarray) -> np.ndarray:
    """Distance of every vector to every pivot; the product is changed in place."""
    if pc.count_distinct(batch["v"].value_lengths()).as_py() > 1:
        raise ValueError("vectors differ in length")
    far = _cells(pa.chunked_array([batch["v"]])) @ pivots.T
    far *= -2
    far += 2
    np.maximum(far, 0.0, out=far)
    return np.sqrt(far, out=far)


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose products with ``width`` pivots hold at most ``PRODUCT`` numbers."""
    step = max(1, PRODUCT // max(1, width))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def _with(batch: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns.values())], names=[*batch.schema.names, *columns])


def _placed(df: DataFrame, shared) -> DataFrame:
    """Adds cell, the nearest of the broadcast pivots, and dist, how far it is."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, len(shared.value)):
                far = _far(part, shared.value)
                cell = far.argmin(axis=1)
                yield _with(part, cell=cell.astype(np.int32), dist=far[np.arange(len(cell)), cell])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(assign, f"{schema}, cell int, dist double")


def _least(sims: np.ndarray, k: int) -> np.ndarray:
    """A bound per row that at least ``k`` of its entries reach: the ``k``-th largest of the maxima of apart groups."""
    n = sims.shape[1]
    wide = max(1, min(64, n // (4 * k)))
    tops = sims[:, : n // wide * wide].reshape(len(sims), wide, -1).max(axis=1) if wide > 1 else sims
    at = max(0, tops.shape[1] - k)
    return np.partition(tops, at, axis=1)[:, at]


def _best(query_ids: pa.Array, queries: np.ndarray, stock: np.ndarray, keys: pa.ListArray, k: int) -> pa.Table:
    """Top ``k`` (h, dst, sim) of every query against a block; ties by key."""
    step = max(1, PRODUCT // max(1, len(stock)))
    copies = keys.value_lengths().to_numpy(zero_copy_only=False)
    flat = keys.flatten()
    offsets = np.concatenate([[0], np.cumsum(copies)])
    empty = pa.array([], pa.int64())
    parts = [pa.table({"q": empty, "dst": flat.take(empty), "sim": pa.array([], pa.float64())})]
    for lo in range(0, len(queries), step):
        sims = queries[lo : lo + step] @ stock.T
        row, col = np.nonzero(sims >= _least(sims, k)[:, None] - 2 * 10.0**-DIGITS)
        sim = np.round(sims[row, col], DIGITS)
        order = np.lexsort((-sim, row))
        row, col, sim = row[order], col[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kth = np.full(len(sims), -2.0)
        kth[row[place == k - 1]] = sim[place == k - 1]
        near = sim >= kth[row]
        row, col, sim = row[near], col[near], sim[near]
        n = copies[col]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        dst = flat.take(pa.array(np.repeat(offsets[col], n) + inside))
        found = pa.table({"q": np.repeat(lo + row, n), "dst": dst, "sim": np.repeat(sim, n)})
        found = found.sort_by([("q", "ascending"), ("sim", "descending"), ("dst", "ascending")])
        q = found["q"].to_numpy()
        parts.append(found.take(pa.array(np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) < k))))
    out = pa.concat_tables(parts)
    return pa.table({"h": query_ids.take(out["q"]), "dst": out["dst"], "sim": out["sim"]})


def knn_search(
    queries: DataFrame, stock: DataFrame, k: int, broadcast_cells: int = BROADCAST_CELLS, n_pivots: int | None = None
) -> DataFrame:
    """(src, dst, sim): for every query row the ``k`` most similar stock rows.

    Both inputs come from :func:`unit_rows`. Similarities are rounded to nine digits, equal
    ones are ordered by key.
    """
    near = top_per_group(stock, ["h"], [F.col("key")], k, "key")
    points = cut_lineage(near.groupBy("h").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("key")).alias("keys")))
    asked = queries.dropDuplicates(["h"]).select("h", "v")
    kind = dict(stock.dtypes)["key"]
    size = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if size.n == 0:
        lists = points.select("h", F.explode("keys").alias("dst"), F.lit(0.0).alias("sim"))
    elif size.n * size.dim <= broadcast_cells:
        lists = _search_broadcast(asked, points, k, kind)
    else:
        pivots = n_pivots or int(min(MAX_PIVOTS, max(2, round(size.n**0.5))))
        lists = _search_cells(asked, points, k, kind, pivots, _block_rows(size.n, size.dim))
    return queries.select(F.col("key").alias("src"), "h").join(lists, "h").select("src", "dst", "sim")


def knn_graph(df: DataFrame, key: str, vector: str, k: int = 5, **options) -> DataFrame:
    """(src, dst, sim): the ``k`` nearest other rows of every row."""
    rows = cut_lineage(unit_rows(df, key, vector))
    found = knn_search(rows, rows, k + 1, **options).filter("src <> dst")
    return top_per_group(found, ["src"], [F.desc("sim"), F.col("dst")], k, "dst", slices=1)


def top_matches(corpus: DataFrame, seeds: DataFrame, key: str, vector: str, k: int, **options) -> DataFrame:
    """(src, dst, sim): the ``k`` corpus rows most similar to each seed, the seed itself excluded."""
    found = knn_search(unit_rows(seeds, key, vector), unit_rows(corpus, key, vector), k + 1, **options)
    return top_per_group(found.filter("src <> dst"), ["src"], [F.desc("sim"), F.col("dst")], k, "dst", slices=1)


def similarity_groups(df: DataFrame, key: str, vector: str, threshold: float, broadcast_cells: int = BROADCAST_CELLS, n_pivots: int | None = None) -> DataFrame:
    """(vertex, component): single-link groups of rows whose similarity reaches ``threshold``.

    Comparing a block of rows with a block of stock yields at most a spanning forest of its
    links, never all its pairs; copies take the group of their first row.
    """
    from contrasieve.operators.graph import connected_components

    rows = cut_lineage(unit_rows(df, key, vector))
    first = rows.groupBy("h").agg(F.min("key").alias("first"), F.first("v").alias("v"))
    points = cut_lineage(first.select(F.col("first").alias("key"), "h", "v"))
    kind = dict(points.dtypes)["key"]
    size = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if size.n * (size.dim or 1) <= broadcast_cells:
        stock = points.select("key", "v").toArrow()
        shared = df.sparkSession.sparkContext.broadcast((stock["key"].combine_chunks(), _cells(stock["v"]) if size.n else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, matrix = shared.value
            for batch in batches:
                if batch.num_rows:
                    table = pa.Table.from_batches([batch])
                    yield from _forest(batch["key"], _cells(table["v"]), keys, matrix, threshold).to_batches()

        links = points.repartition("h").select("key", "v").mapInArrow(run, f"src {kind}, dst {kind}")
    else:
        pivots = n_pivots or int(min(MAX_PIVOTS, max(2, round(size.n**0.5))))
        links = _links_by_cell(points, threshold, kind, pivots, size.n, _block_rows(size.n, size.dim))
    links = links.filter("src <> dst")
    found = points.select("h", F.col("key").alias("vertex")).join(connected_components(links), "vertex", "left")
    groups = found.select("h", F.coalesce("component", "vertex").alias("component"))
    return rows.select(F.col("key").alias("vertex"), "h").join(groups, "h").select("vertex", "component")


def _forest(a_keys: pa.Array, a: np.ndarray, b_keys: pa.Array, b: np.ndarray, threshold: float) -> pa.Table:
    """(src, dst): spanning forest of the links between two blocks, a row at a time."""
    group = np.arange(len(b))  # groups of stock rows that the rows so far tie together
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, PRODUCT // max(1, len(b)))
    for lo in range(0, len(a), step):
        linked = np.round(a[lo : lo + step] @ b.T, DIGITS) >= threshold
        for i in np.flatnonzero(linked.any(axis=1)):
            near = np.flatnonzero(linked[i])
            met, first = np.unique(group[near], return_index=True)
            src.append(np.full(len(met), lo + i))
            dst.append(near[first])
            if len(met) > 1:
                joined = np.zeros(len(b), bool)
                joined[met] = True
                group[joined[group]] = met[0]
    return pa.table({"src": a_keys.take(pa.array(np.concatenate(src))), "dst": b_keys.take(pa.array(np.concatenate(dst)))})


def _block_rows(n: int, dim: int) -> int:
    """Rows of a block: a sixth of the table, but never more than ``BLOCK_CELLS`` numbers."""
    return int(max(1, min(BLOCK_CELLS // max(1, dim), max(LEAST_BLOCK, -(-n // SHARES)))))


def _shelves(sizes: np.ndarray, rows: int) -> np.ndarray:
    """Shelf of every cell: cells in a row share one while they hold at most ``rows`` points together."""
    shelf, full, at = np.zeros(len(sizes), np.int32), 0, 0
    for cell, n in enumerate(sizes):
        if full and full + n > rows:
            at, full = at + 1, 0
        shelf[cell], full = at, full + n
    return shelf


def _measured(stock: DataFrame, n_cells: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Radius (-1: empty) and shelf of every cell."""
    radius, sizes = np.full(n_cells, -1.0), np.zeros(n_cells, np.int64)
    for row in stock.groupBy("cell").agg(F.max("dist").alias("r"), F.count("*").alias("n")).collect():
        radius[row.cell], sizes[row.cell] = row.r, row.n
    return radius, _shelves(sizes, rows)


def _on_shelf(shelf: np.ndarray):
    return F.get(F.array(*[F.lit(int(s)) for s in shelf]), F.col("cell"))


def _visits(batch: pd.DataFrame, open_cells: np.ndarray, shelf: np.ndarray, columns: list) -> Iterator[pd.DataFrame]:
    """The rows of a batch once per shelf with an open cell, one shelf at a time."""
    starts = np.searchsorted(shelf, np.arange(shelf[-1] + 1))
    wanted = np.logical_or.reduceat(open_cells, starts, axis=1)
    for at in range(wanted.shape[1]):
        if wanted[:, at].any():
            yield batch.loc[wanted[:, at], columns].assign(target=np.int32(at))


def _sent(batch: pa.RecordBatch, open_cells: np.ndarray, shelf: np.ndarray, columns: list) -> Iterator[pa.RecordBatch]:
    """As :func:`_visits` in Arrow: only row numbers pass through a frame, no vectors."""
    kept = batch.select(columns)
    for rows in _visits(pd.DataFrame({"row": np.arange(batch.num_rows)}), open_cells, shelf, ["row"]):
        yield _with(kept.take(pa.array(rows["row"])), target=rows["target"].to_numpy(np.int32))


def _links_by_cell(points: DataFrame, threshold: float, kind: str, n_pivots: int, n: int, rows: int) -> DataFrame:
    spark = points.sparkSession
    pivots = np.array([row.v for row in points.orderBy("h").limit(n_pivots).select("v").collect()])
    shared = spark.sparkContext.broadcast(pivots)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK

    stock = cut_lineage(_placed(points, shared))
    radius, shelf = _measured(stock, len(pivots), rows)
    bounds = spark.sparkContext.broadcast((radius, shelf))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, shelf = bounds.value
        for batch in batches:
            for part in _slices(batch, len(r)):
                far = _far(part, shared.value)
                far -= r
                yield from _sent(part, (far <= reach) & (r >= 0), shelf, ["key", "h", "v"])

    asked = stock.mapInArrow(visits, f"key {kind}, h string, v array<double>, target int")
    kept = stock.withColumn("target", _on_shelf(shelf))
    left, right = _pair_blocks(asked, kept, ["key", "v"], ["key", "v"], rows, -(-n // rows))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({"src": a["key"].slice(0, 0), "dst": b["key"].slice(0, 0)})
        return _forest(a["key"].combine_chunks(), _cells(a["v"]), b["key"].combine_chunks(), _cells(b["v"]), threshold)

    by = ["target", "q", "s"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"src {kind}, dst {kind}")


def top_similar(corpus: DataFrame, query: list[float], key: str, vector: str, k: int) -> DataFrame:
    """The ``k`` corpus rows most similar to one free vector."""
    sim = F.round(vx.cosine(F.col(vector), vx.literal(query)), DIGITS)
    return corpus.select(key, sim.alias("sim")).orderBy(F.desc("sim"), key).limit(k)


def _search_broadcast(asked: DataFrame, points: DataFrame, k: int, kind: str) -> DataFrame:
    rows = points.select("v", "keys").toArrow()
    shared = asked.sparkSession.sparkContext.broadcast((_cells(rows["v"]), rows["keys"].combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, keys = shared.value
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                yield from _best(batch["h"], _cells(table["v"]), matrix, keys, k).to_batches()

    spread = asked.repartition("h")
    return spread.mapInArrow(run, f"h string, dst {kind}, sim double")


def _search_cells(asked: DataFrame, points: DataFrame, k: int, kind: str, n_pivots: int, rows: int) -> DataFrame:
    spark = asked.sparkSession
    pivots = np.array([row.v for row in points.orderBy("h").limit(n_pivots).select("v").collect()])
    shared = spark.sparkContext.broadcast(pivots)

    stock = cut_lineage(_placed(points, shared))
    seekers = cut_lineage(_placed(asked, shared))
    radius, shelf = _measured(stock, len(pivots), rows)
    kept = stock.withColumn("target", _on_shelf(shelf))

    own = seekers.select("h", "v", _on_shelf(shelf).alias("target"))
    most = max((r["n"] for r in own.groupBy("target").agg(F.count("*").alias("n")).collect()), default=1)
    first = cut_lineage(_search_blocks(own, kept, k, kind, rows, -(-most // rows)))
    reach = first.groupBy("h").agg(F.when(F.count("*") >= k, F.min("sim")).alias("worst"))
    bounds = spark.sparkContext.broadcast((radius, shelf))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, shelf = bounds.value
        for batch in batches:
            for part in _slices(batch, len(r)):
                far = _far(part, shared.value)
                far -= r
                worst = part["worst"].to_numpy(zero_copy_only=False)
                limit = np.sqrt(np.maximum(0.0, 2 - 2 * np.where(np.isnan(worst), -1.0, worst))) + SLACK
                open_cells = (far <= limit[:, None]) & (r >= 0)
                open_cells &= shelf != shelf[part["cell"].to_numpy()][:, None]
                yield from _sent(part, open_cells, shelf, ["h", "v"])

    wide = seekers.join(reach, "h", "left").select("h", "v", "cell", "worst")
    more = wide.mapInArrow(visits, "h string, v array<double>, target int")
    second = _search_blocks(more, kept, k, kind, rows, -(-max(1, seekers.count()) // rows))
    return top_per_group(first.unionByName(second), ["h"], [F.desc("sim"), F.col("dst")], k, "dst", slices=1)


def _pair_blocks(
    visits: DataFrame, stock: DataFrame, left_columns: list, right_columns: list, rows: int, n_q: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides of every (shelf, query block, stock block): queries in ``n_q`` blocks, shelves of hot cells in as many as they need."""
    plan = stock.groupBy("target").agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("n_s"))
    plan = F.broadcast(plan)  # one row per shelf, at most MAX_PIVOTS
    slot = F.pmod(F.xxhash64("h"), F.lit(n_q)).cast("int")
    shelf = F.pmod(F.xxhash64("h"), F.col("n_s")).cast("int")
    left = visits.join(plan, "target").select(
        "target", slot.alias("q"), F.explode(F.sequence(F.lit(0), F.col("n_s") - 1)).alias("s"), *left_columns
    )
    right = stock.join(plan, "target").select(
        "target", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), shelf.alias("s"), *right_columns
    )
    return left, right


def _search_blocks(visits: DataFrame, stock: DataFrame, k: int, kind: str, rows: int, n_q: int) -> DataFrame:
    """Search each visit's target shelf and keep the best ``k`` per query."""
    left, right = _pair_blocks(visits, stock, ["h", "v"], ["v", "keys"], rows, n_q)

    def run(asked: pa.Table, kept: pa.Table) -> pa.Table:
        if not (asked.num_rows and kept.num_rows):
            none = kept["keys"].combine_chunks().flatten().slice(0, 0)
            return pa.table({"h": asked["h"].slice(0, 0), "dst": none, "sim": pa.array([], pa.float64())})
        return _best(asked["h"].combine_chunks(), _cells(asked["v"]), _cells(kept["v"]), kept["keys"].combine_chunks(), k)

    by = ["target", "q", "s"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"h string, dst {kind}, sim double")
    return top_per_group(found, ["h"], [F.desc("sim"), F.col("dst")], k, "dst", slices=1)
