"""Exact top-k inner products by dual-tree search over cover trees.

Entries become integers. Equal vectors are one point with its k + 1 smallest ids (no more can reach a list), so copies
cost nothing. Pivots fitted on a bounded sample deal all points into cells and cells into blocks of about ``BLOCK``
points; the sample steers only where points lie, every point is indexed and the result is exact. A block holds a cover
tree: the children of a node are a net of half its radius, greedily chosen, and each node knows its true covering radius.
Queries are gathered in blocks with trees of their own.

A query block first meets the block nearest to it, which gives each query a k-th score to beat. Then it is sent to every
block that the bound ``q.c + rq |c| + rc |q| + rq rc`` does not rule out, with q and c the centres and rq and rc the
radii; inside, node pairs fall by the same bound against the worst k-th score of the queries below the query node. Only
strictly smaller bounds are pruned, so ties are kept and fall to the smaller id.

Bounds: a task holds one block and one query block at a time; the driver holds the sample, at most ``CELLS`` pivots,
and a number, centre and radius per cell. A query block is copied for every block it is sent to, so these copies are
dealt to the tasks of the blocks and never pass the driver; nothing joins them, as a join would repeat the block, too.

Cases: a null vector, or one with a null, NaN or infinite entry, takes no part. Shorter vectors end in zeros. Rows that
share an id are different rows: each is a candidate for the others, and each is a query if the id is divisible. A null
id is never a query, and comes before all others in ties. Scores that pass a long are held at its ends. An empty table,
or a query with no other row, gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrasieve.llm import _vectors as vec
from contrasieve.llm._keys import KEY, own_keys
from contrasieve.llm._scan import NO_ID
from contrasieve.session import cut_lineage, discard

SCALE = 256
EVERY = 50
TOP = 5
#: Points in a block of candidates and of queries (physical sizes, not limits).
BLOCK, QUERY_BLOCK = 8192, 1024
CELLS = 1024
SAMPLE = 8192
#: Nodes of so few points are not divided further.
LEAF = 48
#: Equal queries are dealt over so many keys when their lists come back.
SALTS = 32
#: Candidates scored at a time for one query leaf.
STRIP = 4096
_LOWEST = -(1 << 63)


# --- trees --------------------------------------------------------------------------------------------------------


def _net(x: np.ndarray, radius: float) -> np.ndarray:
    """A centre for each point within ``radius``; centres (the first point is one) lie farther apart than that."""
    owner = np.full(len(x), -1)
    left = np.arange(len(x))
    while len(left):
        some = left[:128]
        c = x[some]
        near = _distances(c, c) <= radius
        chosen: list[int] = []
        for i in range(len(some)):
            if not near[i, chosen].any():
                chosen.append(i)
        gaps = _distances(x[left], c[chosen])
        best = gaps.argmin(axis=1)
        inside = gaps[np.arange(len(left)), best] <= radius
        owner[left[inside]] = some[np.array(chosen)[best[inside]]]
        owner[some[chosen]] = some[chosen]
        left = left[owner[left] < 0]
    return owner


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _nearest(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivot of each row."""
    step = max(1, (1 << 22) // len(pivots))
    return np.concatenate([_distances(rows[i : i + step].astype(float), pivots).argmin(axis=1) for i in range(0, len(rows), step)])


def build(points: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree: ``order`` lists the points so that each node holds a stretch [begin, end) of it.

    Node 0 is the root; the children of node i are the nodes [child, child + children). Radii are true covering radii,
    rounded up. A node whose net would part most of its points stays a leaf: bounds could not tell them apart.
    """
    x = points.astype(np.float64)
    order = np.arange(len(x))
    if len(x):
        order[[0, i]] = order[[(i := int(_distances(x.mean(axis=0)[None], x).argmin())), 0]]
    begin, end, centre, radius, child, children = [0], [len(x)], [0], [0.0], [0], [0]
    at = 0
    while at < len(begin):
        a, b = begin[at], end[at]
        inside = order[a:b]
        centre[at] = int(inside[0]) if len(inside) else 0
        gap = _distances(x[inside[:1]], x[inside])[0] if len(inside) else np.zeros(1)
        radius[at] = float(gap.max())
        if b - a > LEAF and radius[at] > 0:
            owner = _net(x[inside], radius[at] / 2)
            heads = np.unique(owner)
            if 2 * len(heads) <= b - a or not at:
                place = np.lexsort((np.arange(b - a) != owner, owner))  # centres come first
                order[a:b] = inside[place]
                sizes = np.unique(owner, return_counts=True)[1]
                child[at], children[at] = len(begin), len(heads)
                stops = a + np.cumsum(sizes)
                if len(heads) > 1:
                    begin += (stops - sizes).tolist()
                    end += stops.tolist()
                    for store in (centre, radius, child, children):
                        store += [0] * len(heads)
                else:
                    children[at] = 0
        at += 1
    return {
        "order": order, "begin": np.array(begin), "end": np.array(end), "centre": np.array(centre),
        "radius": np.array(radius, float) * (1 + 1e-9) + 1e-6 + 1e-7 * float(np.sqrt((x * x).sum(axis=1).max(initial=0))), "child": np.array(child), "children": np.array(children),
    }


class Lists:
    """The best (score, id) pairs of each query so far, best first."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), _LOWEST, np.int64)
        self.id = np.full((n, k), NO_ID, np.int64)
        self.count = np.zeros(n, np.int64)

    def worst(self) -> np.ndarray:
        """The score to reach; lowest while a list is not full."""
        return self.score[:, -1]

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray, owner: np.ndarray) -> None:
        """Candidates ``ids`` (owner: place of their score) to query ``q``."""
        k, have = self.score.shape[1], self.count[q]
        s = np.concatenate([self.score[q, :have], scores[owner]])
        i = np.concatenate([self.id[q, :have], ids])
        best = np.lexsort((i, -s.astype(np.float64) if vec.largest(s) < 1 << 52 else [-int(v) for v in s]))[:k]
        self.count[q] = len(best)
        self.score[q, : len(best)], self.id[q, : len(best)] = s[best], i[best]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, held within longs."""
    out = vec.exact_product(a, b.T)
    return out if out.dtype == np.int64 else np.clip(out, _LOWEST, (1 << 63) - 1).astype(np.int64)


def search(queries: dict, block: dict, lists: Lists, beat: np.ndarray) -> None:
    """Fill ``lists`` with all candidates of ``block`` that can enter the lists of ``queries``.

    ``beat`` holds a score for each query, in the order of its tree, that candidates must reach at least.
    """
    qt, ct = queries["tree"], block["tree"]
    qx, cx = queries["points"][qt["order"]], block["points"][ct["order"]]
    first = np.concatenate([[0], np.cumsum(block["n_ids"][ct["order"]])])
    cids = block["ids"][np.repeat(block["first"][ct["order"]], np.diff(first)) + np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))]
    qc, cc = queries["points"][qt["centre"]].astype(float), block["points"][ct["centre"]].astype(float)
    qn, cn = np.sqrt((qc * qc).sum(axis=1)), np.sqrt((cc * cc).sum(axis=1))
    qr, cr = qt["radius"], ct["radius"]

    def need() -> np.ndarray:
        each = np.maximum(beat, lists.worst())
        return np.array([each[a:b].min() for a, b in zip(qt["begin"], qt["end"])]).astype(float)

    def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dot = np.concatenate([np.einsum("ij,ij->i", qc[a[i : i + 65536]], cc[b[i : i + 65536]]) for i in range(0, len(a), 65536)])
        top = dot + qr[a] * cn[b] + cr[b] * qn[a] + qr[a] * cr[b]
        return top + 1e-9 * (qn[a] + qr[a]) * (cn[b] + cr[b]) + 1e-3  # what rounding may have taken

    def expand(tree: dict, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = tree["children"][nodes]
        return np.repeat(np.arange(len(nodes)), n), np.repeat(tree["child"][nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    ready_a, ready_b, ready_top = [], [], []
    worst = need()
    while len(a):
        top = bounds(a, b)
        keep = top >= worst[a]
        a, b, top = a[keep], b[keep], top[keep]
        q_inner, c_inner = qt["children"][a] > 0, ct["children"][b] > 0
        both = ~q_inner & ~c_inner
        ready_a.append(a[both]), ready_b.append(b[both]), ready_top.append(top[both])
        split_q = q_inner & (~c_inner | (qr[a] >= cr[b]))
        split_c = c_inner & ~split_q
        at, nodes = expand(qt, a[split_q])
        at2, nodes2 = expand(ct, b[split_c])
        a, b = np.concatenate([nodes, a[split_c][at2]]), np.concatenate([b[split_q][at], nodes2])
    a, b, top = np.concatenate(ready_a), np.concatenate(ready_b), np.concatenate(ready_top)
    order = np.lexsort((-top, a))
    a, b, top = a[order], b[order], top[order]
    cuts = np.flatnonzero(np.diff(a)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(a)]]).tolist()):
        if lo == hi:
            continue
        rows = np.arange(qt["begin"][a[lo]], qt["end"][a[lo]])
        sizes = (ct["end"] - ct["begin"])[b[lo:hi]]
        strip = (np.cumsum(sizes) - sizes) // STRIP
        for s in np.unique(strip).tolist():
            part = lo + np.flatnonzero(strip == s)
            least = np.maximum(beat[rows], lists.worst()[rows])
            part = part[top[part] >= least.min()]
            if not len(part):
                break  # bounds only fall from here
            cols = np.concatenate([np.arange(ct["begin"][c], ct["end"][c]) for c in b[part].tolist()])
            scores = _dots(qx[rows], cx[cols])
            for i, q in enumerate(rows.tolist()):
                fine = scores[i] >= least[i]
                if np.count_nonzero(fine) > lists.score.shape[1]:
                    kth = np.partition(scores[i], -lists.score.shape[1])[-lists.score.shape[1]]
                    fine &= scores[i] >= kth
                hit = np.flatnonzero(fine)
                if len(hit):
                    n = np.diff(first)[cols[hit]]
                    owner = np.repeat(np.arange(len(hit)), n)
                    ids = cids[np.repeat(first[cols[hit]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    lists.offer(q, scores[i][hit], ids, owner)


# --- Spark --------------------------------------------------------------------------------------------------------


def _points(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """Usable rows as (key, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = vec.scaled(batch["v"], scale, dims)
            yield pa.RecordBatch.from_arrays([vec.pack(rows), batch["id"].take(pa.array(at))], ["key", "id"])

    rows = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), vec.as_doubles(vector_col).alias("v"))
    return rows.mapInArrow(run, "key binary, id bigint")


def _classes(points: DataFrame, k: int) -> DataFrame:
    """One row for each different vector, with its k smallest ids; the limit works before the shuffle, too."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    return points.withColumn("r", rank).where(F.col("r") <= k).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _pivots(classes: DataFrame, n: int, dims: int) -> np.ndarray:
    """Far-apart members of a bounded sample, one for each block that the points will need, at most ``CELLS``."""
    share = min(1.0, 2 * SAMPLE / max(n, 1))
    found = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("key").limit(SAMPLE).collect()
    x = vec.unpack(pa.array([bytes(r["key"]) for r in found], pa.binary()), dims).astype(float)
    if not len(x):
        return np.zeros((1, dims))
    want = min(CELLS, max(1, -(-2 * n // BLOCK)), len(x))
    chosen, gap = [0], _distances(x[:1], x)[0]
    while len(chosen) < want and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(x[chosen[-1:]], x)[0])
    return x[chosen]


def _dealt(rows: DataFrame, cells: dict[int, int], size: int) -> DataFrame:
    """``rows`` with the part of their cell they belong to, parts having about ``size`` points."""
    parts = F.create_map([F.lit(x) for c, n in cells.items() for x in (c, max(1, -(-n // size)))])
    return rows.withColumn("part", F.pmod(F.xxhash64("key"), parts[F.col("cell")]).cast("int"))


def _block(table: pa.Table, dims: int) -> dict:
    points = vec.unpack(table["key"].combine_chunks(), dims)
    small = 1 if vec.largest(points) < 1 << 15 else 0
    out = {"points": points.astype(np.int16) if small else points, "tree": build(points)}
    if "ids" in table.column_names:
        lists = table["ids"].combine_chunks().cast(pa.large_list(pa.int64()))
        out["ids"] = lists.flatten().to_numpy(zero_copy_only=False)
        out["first"] = np.asarray(lists.offsets)[:-1] - np.asarray(lists.offsets)[0]
        out["n_ids"] = np.diff(np.asarray(lists.offsets))
    return out


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        made = _block(table, dims)
        body = pickle.dumps(made, protocol=5)
        return pa.table({"cell": table["cell"][:1], "part": table["part"][:1], "block": pa.array([body], pa.binary())})

    return rows.groupBy("cell", "part").applyInArrow(run, "cell int, part int, block binary")


def _found(queries: dict, lists: Lists) -> pa.RecordBatch:
    row, col = np.nonzero(np.arange(lists.score.shape[1])[None, :] < lists.count[:, None])
    keys = vec.pack(queries["points"]).take(pa.array(queries["tree"]["order"][row]))
    return pa.RecordBatch.from_arrays([keys, pa.array(lists.score[row, col]), pa.array(lists.id[row, col])], ["key", "score", "id"])


def _meet(k: int) -> Callable:
    """Of rows (cell, part, block, queries) a block comes before the queries that were sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                name = (batch["cell"][i].as_py(), batch["part"][i].as_py())
                if batch["block"][i].is_valid:
                    block, last = pickle.loads(batch["block"][i].as_py()), name
                    continue
                if name != last:
                    continue  # a part without points
                queries = pickle.loads(batch["queries"][i].as_py())
                n = len(queries["points"])
                lists = Lists(n, k)
                search(queries, block, lists, queries.get("beat", np.full(n, _LOWEST)))
                if "beat" in queries:
                    yield _found(queries, lists)
                else:
                    queries |= {"beat": lists.worst(), "met": name}
                    best = _found(queries, lists)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([pickle.dumps(queries, protocol=5)], pa.binary()), *(pa.array([c.to_pylist()], pa.list_(c.type)) for c in best.columns)],
                        ["queries", "keys", "scores", "ids"],
                    )

    return run


def top_k(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, every: int = EVERY, scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of each row whose id ``every`` divides."""
    spark, dims = df.sparkSession, vec.width(df, vector_col)
    keyed = own_keys(df.select(F.col(id_col), F.col(vector_col)), id_col, vector_col)
    rows = df if keyed is None else keyed
    own = id_col if keyed is None else KEY
    points = cut_lineage(_points(rows, own, vector_col, dims, scale))
    asks = rows.where(F.col(id_col).cast("bigint") % every == 0)
    asking = cut_lineage(_points(asks, own, vector_col, dims, scale))
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if asking.isEmpty() or not dims:
        return spark.createDataFrame([], schema)

    classes = cut_lineage(_classes(points, k + 1))
    discard(points)
    n = classes.count()
    pivots = _pivots(classes, n, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _nearest(vec.unpack(batch["key"], dims), pivots)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], ["cell", *batch.schema.names])

    def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = vec.unpack(batch["key"], dims).astype(float)
                gap = np.sqrt(((points - pivots[batch["cell"].to_numpy()]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch["cell"], pa.array(gap)], ["cell", "gap"])

    located = cut_lineage(classes.mapInArrow(place, "cell int, key binary, ids array<bigint>"))
    discard(classes)
    located_asks = cut_lineage(asking.select("key").distinct().mapInArrow(place, "cell int, key binary"))
    summary = located.select("cell", "key").mapInArrow(by_cell, "cell int, gap double").groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("r"))
    cells = {r["cell"]: (r["n"], r["r"]) for r in summary.collect()}
    sizes = {c: n for c, (n, _) in cells.items()}
    ask_sizes = {r["cell"]: r["n"] for r in located_asks.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = cut_lineage(_blocks(_dealt(located, sizes, BLOCK), dims))
    discard(located)
    queries = _blocks(_dealt(located_asks, ask_sizes, QUERY_BLOCK), dims).withColumnRenamed("block", "queries").select("queries")

    names = np.array(sorted(cells))
    middle, reach = pivots[names], np.array([cells[c][1] for c in names.tolist()]) * (1 + 1e-9) + 1e-6
    parts = np.array([max(1, -(-cells[c][0] // BLOCK)) for c in names.tolist()])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole = batch["queries"][i].as_py()
                q = pickle.loads(whole)
                centre, radius = q["points"][q["tree"]["centre"][0]].astype(float), q["tree"]["radius"][0]
                dot = middle @ centre
                if "beat" in q:
                    far, length = np.sqrt((middle * middle).sum(axis=1)), np.sqrt((centre * centre).sum())
                    top = dot + radius * far + reach * length + radius * reach
                    at = np.flatnonzero(top + 1e-9 * (far + reach) * (length + radius) + 1e-3 >= float(q["beat"].min()))
                    to = [(int(names[c]), p) for c in at.tolist() for p in range(parts[c]) if (int(names[c]), p) != q["met"]]
                else:
                    to = [(int(names[dot.argmax()]), 0)]
                for name in to:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name[0]], pa.int32()), pa.array([name[1]], pa.int32()), pa.array([whole], pa.binary())], ["cell", "part", "queries"]
                    )

    def pairs(asked: DataFrame) -> DataFrame:
        copies = asked.mapInArrow(sent, "cell int, part int, queries binary")
        rows = blocks.unionByName(copies, allowMissingColumns=True)
        return rows.repartition(min(2 * int(parts.sum()), 4096), "cell", "part").sortWithinPartitions("cell", "part", F.col("block").isNull())

    opened = cut_lineage(pairs(queries).mapInArrow(_meet(k + 1), "queries binary, keys array<binary>, scores array<bigint>, ids array<bigint>"))
    first = opened.select(F.inline(F.arrays_zip("keys", "scores", "ids"))).toDF("key", "score", "id")
    rest = pairs(opened.select("queries")).mapInArrow(_meet(k + 1), "key binary, score bigint, id bigint")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    merged = first.unionByName(rest).withColumn("r", rank).where(F.col("r") <= k + 1)
    lists = merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("best"))
    dealt = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = asking.withColumnRenamed("id", "query").withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(SALTS)).cast("int"))
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query")), 1, k)
    out = asked.join(dealt, ["key", "salt"]).select("query", F.posexplode(others).alias("at", "b"))
    out = out.select(F.col("query").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
    if keyed is None:
        return out.withColumn("vec_id", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")))
    ids = cut_lineage(keyed.select(KEY, F.col(id_col).cast("bigint").alias("own")))
    for c in ("query_id", "vec_id"):
        out = out.join(ids.withColumnRenamed(KEY, c), c).drop(c).withColumnRenamed("own", c)
    return out.select("query_id", "rank", "vec_id", "score")
