"""Joins that attach evidence to contracts without changing the number of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasieve.functions import clean as cl
from contrasieve.sources.tables import keep_first
from contrasieve.session import cut_lineage, discard

#: Meetings of two members that a task of :func:`co_occurrence` adds up at a time.
TASK_PAIRS = 8_000_000


def attach_signals(base: DataFrame, key: str, signals: Sequence[tuple[DataFrame | None, Mapping[str, Column]]]) -> DataFrame:
    """Left-join signal tables one after another.

    Each table is first reduced to one row per key by its aggregates; a missing table gives
    null columns, so later rules need not know which stages ran.
    """
    for table, columns in signals:
        if table is None:
            base = base.withColumns({name: F.lit(None) for name in columns})
            continue
        reduced = table.groupBy(key).agg(*[c.alias(n) for n, c in columns.items()])
        base = base.join(reduced, key, "left")
    return base


def join_first(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left join against the first right row per key."""
    return left.join(keep_first(right, keys, order), list(keys), "left")


def flag_in(df: DataFrame, members: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Boolean column: does the key occur in ``members``."""
    distinct = members.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(distinct, list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def not_in(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(members.select(*keys).distinct(), list(keys), "left_anti")


def match_codes(df: DataFrame, key: str, codes: str, reference: DataFrame, code: str = "code", limit: int = 3) -> DataFrame:
    """Which codes of an array column are in the reference list.

    ``reference`` has (code, description). Result per key: number of matches, a flag, and the
    first ``limit`` matches as text.
    """
    wanted = df.select(key, F.explode_outer(codes).alias(code)).withColumn(code, cl.digits(F.col(code), 7)).distinct()
    hits = wanted.join(reference, code).groupBy(key).agg(
        F.count("*").alias("n_codes"),
        F.array_sort(F.collect_set(F.concat_ws(" ", F.col(code), F.col("description")))).alias("_all"),
    )
    hits = hits.withColumn("detail", F.array_join(F.slice("_all", 1, limit), " | ")).drop("_all")
    out = df.select(key).join(hits, key, "left")
    return out.select(
        key,
        F.coalesce("n_codes", F.lit(0)).alias("n_codes"),
        F.col("n_codes").isNotNull().alias("has_code"),
        F.coalesce("detail", F.lit("")).alias("detail"),
    )


def code_evidence(df: DataFrame, key: str, principal: str, others: str, reference: DataFrame) -> DataFrame:
    """Evidence score per supplier from registry codes.

    A strong principal code counts 3 and a possible one 2; every other code counts 1 or 0.5.
    ``reference`` has (code, strong).
    """
    main = df.select(key, F.col(principal).alias("code"), F.lit(True).alias("is_main"))
    rest = df.select(key, F.explode(others).alias("code"), F.lit(False).alias("is_main"))
    both = main.unionByName(rest).withColumn("code", cl.digits(F.col("code"), 7))
    strong = F.col("strong")
    weight = F.when(F.col("is_main"), F.when(strong, 3.0).otherwise(2.0)).otherwise(F.when(strong, 1.0).otherwise(0.5))
    scored = both.join(reference, "code").groupBy(key).agg(F.sum(weight).alias("code_score"))
    return df.select(key).join(scored, key, "left").select(key, F.coalesce("code_score", F.lit(0.0)).alias("code_score"))


def prefer_new(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join; the new value wins where it is not null."""
    renamed = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = old.join(renamed, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}).drop(
        *[f"_new_{c}" for c in columns]
    )


def propagate_by_key(
    df: DataFrame,
    judged: DataFrame,
    key: str,
    value: str,
    order: Sequence[Column],
    origin: str = "origin",
    row_id: str | None = None,
) -> DataFrame:
    """One judgement per text or purchase serves every row with the same key.

    Rows judged themselves show ``analisado``, the others that received a value ``propagado``.
    """
    unique = keep_first(judged.select(key, value, *([row_id] if row_id else [])), [key], order)
    if row_id:
        unique = unique.withColumnRenamed(row_id, "_judged_id")
    out = df.join(unique, key, "left")
    if row_id:
        mark = F.when(F.col("_judged_id") == F.col(row_id), "analisado").when(F.col(value).isNotNull(), "propagado")
        out = out.withColumn(origin, mark).drop("_judged_id")
    return out


def resolve_purchase(df: DataFrame, key: str, own: str, details: DataFrame) -> DataFrame:
    """Purchase of a contract: its own column, its key when that is a purchase key (type 1), else a detail table.

    ``details`` has (key, detail_purchase).
    """
    kind = cl.control_key_parts(F.col(key))["kind"]
    looked_up = df.join(keep_first(details, [key], [F.col("detail_purchase")]), key, "left")
    purchase = F.coalesce(F.col(own), F.when(kind == 1, F.col(key)), F.col("detail_purchase"))
    return looked_up.withColumn("resolved", purchase).drop("detail_purchase")


def co_occurrence(edges: DataFrame, member: str, group: str, min_shared: int = 2, block: int = 4096) -> DataFrame:
    """Pairs of members that share at least ``min_shared`` groups, with the number they share.

    A group of more than ``block`` members is cut into blocks that meet two by two, so no row holds more than two blocks.
    Groups are dealt by their first members, so pairs that meet in many of them are mostly added up inside one task. A
    task counts ``TASK_PAIRS`` meetings at a time; sums travel packed, by hashes of both members, and each pair is
    added up and compared with the minimum in one place.
    """
    e = cut_lineage(edges.select(member, group).distinct().dropna())
    common = cut_lineage(e.groupBy(group).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_n")).filter("_n > 1"))
    own = F.coalesce(F.pmod(F.xxhash64(member), F.col("_n")), F.lit(0)).cast("int")
    listed = e.join(common, group, "left").groupBy(group, "_n", own.alias("_own")).agg(F.array_sort(F.collect_list(member)).alias("xs"))
    dealt = cut_lineage(listed)
    discard(e)
    single = dealt.select(group, "xs", F.lit(None).cast(dealt.schema["xs"].dataType).alias("ys"))
    cut = dealt.filter("_n > 1")
    two = cut.select(group, F.col("_own").alias("_i"), "xs").join(cut.select(group, F.col("_own").alias("_j"), F.col("xs").alias("ys")), group)
    met = single.unionByName(two.filter(F.col("_i") < F.col("_j")).select(group, "xs", "ys"))
    n_pairs = F.size("xs").cast("long") * F.when(F.col("ys").isNull(), (F.size("xs") - 1) / 2).otherwise(F.size("ys"))
    n_tasks = int((met.agg(F.sum(n_pairs)).first()[0] or 0) // TASK_PAIRS) + edges.sparkSession.sparkContext.defaultParallelism
    # Groups that begin with the same members come to one task, which adds up their pairs before anything is shuffled.
    near = met.repartitionByRange(n_tasks, F.slice("xs", 1, 3), F.xxhash64(group), F.get("ys", F.lit(0)))
    kind, side, most = dict(e.dtypes)[member], math.ceil(math.sqrt(2 * n_tasks)), TASK_PAIRS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            xs, ys = (batch[c].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("xs", "ys"))
            meetings = np.where(ys > 0, xs * ys, xs * (xs - 1) // 2)
            start = 0
            for stop in range(1, batch.num_rows + 1):
                n += int(meetings[stop - 1])
                if n >= most:
                    yield from _pair_sums([*held, batch.slice(start, stop - start)], side, most)
                    held, n, start = [], 0, stop
            held.append(batch.slice(start))
        yield from _pair_sums(held, side, most)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            bucket = batch["bucket"].to_numpy()
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if i < j and bucket[i] != last:
                    yield from _added(held, min_shared)
                    last, held = bucket[i], []
                held.append(batch.slice(i, j - i))
        yield from _added(held, min_shared)

    sums = near.select("xs", "ys").mapInArrow(count, f"bucket int, first array<{kind}>, second array<{kind}>, width int, sums binary")
    return sums.repartition(side * side, "bucket").sortWithinPartitions("bucket").mapInArrow(add, f"a {kind}, b {kind}, weight bigint")


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n[i]`` places from ``start[i]`` on, for each i."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def _sorted_values(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the place of each value among them."""
    plain = values.to_numpy(zero_copy_only=False)
    if plain.dtype != object:
        return np.unique(plain, return_inverse=True)
    place, found = pd.factorize(plain, sort=True)
    return found, place


def _pair_sums(rows: list[pa.RecordBatch], side: int, most: int) -> Iterator[pa.RecordBatch]:
    """Meetings inside ``xs`` where ``ys`` is null, else of ``xs`` with ``ys``, added up by pair: one row per bucket of pairs."""
    if not sum(r.num_rows for r in rows):
        return
    xs, ys = (pa.concat_arrays([r[c] for r in rows]) for c in ("xs", "ys"))
    n_x, n_y = (c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (xs, ys))
    flat = pa.concat_arrays([xs.flatten(), ys.flatten()])
    if not len(flat):
        return
    values, place = _sorted_values(flat)
    at_x, alone = np.cumsum(n_x) - n_x, np.repeat(n_y == 0, n_x)
    at_y = n_x.sum() + np.cumsum(n_y) - n_y
    here = np.arange(n_x.sum())
    left = np.where(alone, np.repeat(at_x + n_x, n_x) - here - 1, np.repeat(n_y, n_x))
    begin = np.where(alone, here + 1, np.repeat(at_y, n_x))
    of = (pd.util.hash_array(values, categorize=False) % np.uint64(side)).astype(np.int64)
    cuts = np.unique(np.searchsorted(np.cumsum(left), np.arange(0, left.sum() + most, most), "right"))
    for start, stop in zip(cuts, cuts[1:]):  # one row may hold more meetings than are added up at a time
        x = np.repeat(place[start:stop], left[start:stop])
        y = place[_spread(begin[start:stop], left[start:stop])]
        pair, n = np.unique(np.minimum(x, y).astype(np.int64) * len(values) + np.maximum(x, y), return_counts=True)
        a, b = pair // len(values), pair % len(values)
        bucket = of[a] * side + of[b]
        order = np.argsort(bucket, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            first, i = np.unique(a[some], return_inverse=True)
            second, j = np.unique(b[some], return_inverse=True)
            step = np.diff(i * len(second) + j, prepend=0)
            width = np.min_scalar_type(max(int(step.max()), int(n[some].max()))).itemsize
            body = pa.compress(np.stack([step, n[some]]).astype(f"u{width}").tobytes(), "zstd", asbytes=True)
            cells = [
                pa.array([int(bucket[some[0]])], pa.int32()), *(pa.array([values[k].tolist()], pa.list_(flat.type)) for k in (first, second)),
                pa.array([width], pa.int32()), pa.array([len(some).to_bytes(8, "little") + body], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cells, ["bucket", "first", "second", "width", "sums"])


def _added(rows: list[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(a, b, weight) of the pairs of a bucket that met ``least`` times."""
    if not rows:
        return
    first, second = (pa.concat_arrays([r[c] for r in rows]) for c in ("first", "second"))
    (a_values, a_place), (b_values, b_place) = _sorted_values(first.flatten()), _sorted_values(second.flatten())
    pairs, counts, at_a, at_b = [], [], 0, 0
    for row in (r.slice(i, 1) for r in rows for i in range(r.num_rows)):
        n_a, n_b, width, body = len(row["first"].flatten()), len(row["second"].flatten()), row["width"][0].as_py(), row["sums"][0].as_py()
        n = int.from_bytes(body[:8], "little")
        step, count = np.frombuffer(pa.decompress(body[8:], 2 * n * width, "zstd"), f"u{width}").reshape(2, n)
        code = np.cumsum(step.astype(np.int64))
        pairs.append(a_place[at_a + code // n_b] * np.int64(len(b_values)) + b_place[at_b + code % n_b])
        counts.append(count.astype(np.int64))
        at_a, at_b = at_a + n_a, at_b + n_b
    pair, count = np.concatenate(pairs), np.concatenate(counts)
    order = np.argsort(pair, kind="stable")
    pair, count = pair[order], count[order]
    begin = np.concatenate([[0], np.flatnonzero(np.diff(pair)) + 1])
    pair, count = pair[begin], np.add.reduceat(count, begin)
    pair, count = pair[count >= least], count[count >= least]
    for i in range(0, len(pair), 1 << 16):
        some = pair[i : i + (1 << 16)]
        cells = [pa.array(v[k], first.type.value_type) for v, k in ((a_values, some // len(b_values)), (b_values, some % len(b_values)))]
        yield pa.RecordBatch.from_arrays([*cells, pa.array(count[i : i + (1 << 16)])], ["a", "b", "weight"])
