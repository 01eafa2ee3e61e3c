"""Shards of near-equal bytes that keep linked documents together: balanced label propagation.

Documents are linked through hubs (by default: one hub per text, so equal texts are linked). Linked documents start on
shards by hash. In each round every hub adds up its bytes per shard, and members that are not in the shard with
most of them ask to move there. Asks are added up in hash slices, and the slices whose sum stays within the room of
the target go. A group that fits a shard is put whole where the rounds left most of it; if that fills a shard over its
share, groups change places, alone or one for another, until no such shard can give in a way that makes shards more
even. Members of groups bigger than a shard start in one row, cut by what room is left, and go through rounds of
their own, until none may move. Unlinked documents fill what is left, in slices and then one by one, so sizes are even.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrasieve.session import cut_lineage

#: Slices in which moves are admitted and places are counted; a slice is never one task's only work.
SLICES = 1024
#: Rounds over groups that fit a shard end when no more than this share of the bytes that ask may go.
LEAST_MOVED = 0.01


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size (UTF-8 bytes plus 1), text_crc32, hub (fingerprint of the text) and a slice by id."""
    body = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    size = F.octet_length(body).cast("bigint") + 1
    # null has no bytes; it is told from the empty text
    hub = F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.md5(body))
    return docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(body).alias("crc"), hub.alias("hub"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(SLICES)).cast("int").alias("slice"))


def exchange(mine: np.ndarray, theirs: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Places of the unit to give and of the one to take for it (-1: none), among ordered sizes.

    Their difference is the one nearest to half the gap; None if each would leave the gap as wide or wider.
    """
    other = np.append(0, theirs)
    least = None
    after = np.searchsorted(other, mine - gap / 2)
    for at in (np.maximum(after - 1, 0), np.minimum(after, len(other) - 1)):
        off = np.abs(mine - other[at] - gap / 2)
        k = int(np.argmin(off)) if len(off) else 0
        if len(off) and off[k] < gap / 2 and (least is None or off[k] < least[0]):
            least = off[k], k, int(at[k]) - 1
    return least and least[1:]


def level_units(size: np.ndarray, shard: np.ndarray, shards: int, capacity: float) -> np.ndarray:
    """Shards of whole units after exchanges, until no shard over capacity has one that makes loads more even.

    Each exchange lowers the sum of the squared loads, so this ends.
    """
    shard = shard.copy()
    load = [int(size[shard == s].sum()) for s in range(shards)]

    def improve() -> bool:
        order = sorted(range(shards), key=lambda s: (load[s], s))
        held = {}
        for s in reversed(order):
            if load[s] <= capacity:
                return False
            for t in order:
                if load[t] >= load[s]:
                    break
                for x in (s, t):
                    if x not in held:
                        own = np.flatnonzero(shard == x)
                        held[x] = own[np.argsort(size[own], kind="stable")]
                found = exchange(size[held[s]], size[held[t]], load[s] - load[t])
                if found:
                    give, take = found
                    moved = int(size[held[s][give]]) - (int(size[held[t][take]]) if take >= 0 else 0)
                    shard[held[s][give]] = t
                    if take >= 0:
                        shard[held[t][take]] = s
                    load[s] -= moved
                    load[t] += moved
                    return True
        return False

    while improve():
        pass
    return shard


def place_groups(hubs: DataFrame, shards: int, total: int) -> tuple[DataFrame, list[int]]:
    """Shard of each group (hub, bytes, home) that fits one, whole: (hub, shard), and the bytes so placed on each.

    All start at home and stay there unless a shard is over its share. Groups of more than a quarter of a shard are fewer
    than four times the shards and are exchanged one by one, the others in hash slices, a table of shards times ``SLICES``.
    """
    spark = hubs.sparkSession
    capacity = total / shards
    is_large = F.col("bytes") * (4 * shards) > total
    large = sorted((r["bytes"], r["hub"], r["home"]) for r in hubs.where(is_large).collect())[::-1]
    small = hubs.where(~is_large).select("hub", "bytes", "home", F.pmod(F.xxhash64("hub"), F.lit(SLICES)).cast("int").alias("part"))
    sums = small.groupBy("home", "part").agg(F.sum("bytes").alias("bytes")).orderBy("home", "part").collect()
    start = [x[2] for x in large]
    size = np.array([x[0] for x in large] + [r["bytes"] for r in sums], np.int64)
    found = level_units(size, np.array(start + [r["home"] for r in sums], np.int64), shards, capacity)
    names = spark.createDataFrame([(h, s) for (_, h, _), s in zip(large, found.tolist())], "hub string, shard int")
    slices = spark.createDataFrame([(r["home"], r["part"], s) for r, s in zip(sums, found[len(large) :].tolist())], "home int, part int, shard int")
    placed = small.join(F.broadcast(slices), ["home", "part"]).select("hub", "shard").unionByName(names)
    return placed, [int(size[found == s].sum()) for s in range(shards)]


def in_a_row(spread: DataFrame, taken: list[int], capacity: float) -> DataFrame:
    """Shards of members of groups bigger than a shard (fewer than shards): group by group, the shard with most room first."""
    order = sorted(range(len(taken)), key=lambda s: (taken[s], s))
    sums = cut_lineage(spread.groupBy("hub", "slice").agg(F.sum("size").alias("bytes")))
    before = sums.withColumn("before", F.sum("bytes").over(Window.partitionBy().orderBy("hub", "slice")) - F.col("bytes")).select("hub", "slice", "before")
    inside = Window.partitionBy("hub", "slice").orderBy("id", "row").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    cuts = np.cumsum([max(0.0, capacity - taken[s]) for s in order]).tolist()
    shard = F.lit(order[-1])
    for s, cut in reversed(list(zip(order[:-1], cuts))):
        shard = F.when(F.col("at") < cut, F.lit(s)).otherwise(shard)
    return spread.join(F.broadcast(before), ["hub", "slice"]).withColumn("at", at).withColumn("shard", shard.cast("int")).drop("before", "at")


def _admitted(asks: DataFrame, room: DataFrame) -> DataFrame:
    """Which slices of which (from, to) asks go: running sums per target within its room, the least first."""
    order = Window.partitionBy("to").orderBy("bytes", "slice", "shard").rowsBetween(Window.unboundedPreceding, 0)
    return asks.withColumn("sum", F.sum("bytes").over(order)).join(F.broadcast(room), "to").where("sum <= room").select("shard", "to", "slice", "bytes")


def propagate(linked: DataFrame, taken: list[int], capacity: float, least: float = 0.0, few: bool = False) -> DataFrame:
    """Shard of each linked document (id, row, size, crc, hub, slice, shard): rounds until nobody may move.

    ``taken`` has the bytes already placed on each shard. A move adds to the shard that has most of its group, so rounds end;
    they end too when no more than the share ``least`` of the bytes that ask may go. The labels of ``few`` groups are sent to the tasks.
    """
    spark = linked.sparkSession
    rooms = spark.createDataFrame([(s, capacity - x) for s, x in enumerate(taken)], "to int, free double")
    state = cut_lineage(linked)
    while True:
        by_hub = cut_lineage(state.groupBy("hub", "shard").agg(F.sum("size").alias("bytes")))
        best = by_hub.groupBy("hub").agg(F.max_by("shard", F.struct(F.col("bytes"), -F.col("shard"))).alias("to"))
        load = by_hub.groupBy(F.col("shard").alias("to")).agg(F.sum("bytes").alias("load"))
        room = rooms.join(load, "to", "left").select("to", (F.col("free") - F.coalesce("load", F.lit(0))).alias("room"))
        wants = cut_lineage(state.join(F.broadcast(best) if few else best, "hub").select("id", "row", "size", "crc", "hub", "slice", "shard", "to"))
        moving = cut_lineage(wants.where("shard <> to").groupBy("shard", "to", "slice").agg(F.sum("size").alias("bytes")))
        go = cut_lineage(_admitted(moving, room).withColumn("go", F.lit(True)))
        asked, gone = (x.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] for x in (moving, go))
        if gone <= least * asked:
            return state
        state = cut_lineage(wants.join(F.broadcast(go.drop("bytes")), ["shard", "to", "slice"], "left").select("id", "row", "size", "crc", "hub", "slice", F.when(F.col("go"), F.col("to")).otherwise(F.col("shard")).alias("shard")))


def fill(single: DataFrame, linked: DataFrame, shards: int) -> DataFrame:
    """Shards of unlinked documents (id, row, size, crc, slice): each shard is filled up to the same level.

    The documents stand in one order, by slice and id. Running sums tell where each begins; cuts between the rooms
    of the shards tell where it goes. Only a slice is ever sorted, and sums over slices are a table of fixed size.
    """
    spark = single.sparkSession
    load = linked.groupBy("shard").agg(F.sum("size").alias("load"))
    sums = cut_lineage(single.groupBy("slice").agg(F.sum("size").alias("bytes")))
    loads = {r["shard"]: r["load"] for r in load.collect()}  # one row per shard
    free = sums.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    level = water_level([loads.get(s, 0) for s in range(shards)], free)
    cuts, at = [], 0.0
    for s in range(shards):
        at += max(0.0, level - loads.get(s, 0))
        cuts.append(at)
    before = sums.withColumn("before", F.sum("bytes").over(Window.partitionBy().orderBy("slice")) - F.col("bytes")).select("slice", "before")
    inside = Window.partitionBy("slice").orderBy("id", "row").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    places = single.join(F.broadcast(before), "slice").withColumn("at", begin)
    shard = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        shard = F.when(F.col("at") < cuts[s], F.lit(s)).otherwise(shard)
    return places.withColumn("shard", shard.cast("int")).drop("before", "at")


def water_level(loads: list[int], free: int) -> float:
    """The level to which ``free`` fills vessels that hold ``loads`` already."""
    have = sorted(loads)
    total = 0
    for k, x in enumerate(have, 1):
        total += x
        level = (total + free) / k
        if k == len(have) or level <= have[k]:
            return level
    return 0.0


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot and grown_shard (null under this law).

    The law is ``bytes``: shards of near-equal size. Links join equal texts. A group of no more bytes than a
    shard's share is never cut, so shards are as uneven as such groups make them; a bigger one takes what room
    the others leave. Null text has no bytes and links to
    other nulls only. Null ids sort first; rows that repeat an id are documents of their own. No rows give no rows.
    Other columns are ignored. Slots count from 0 without gaps in each shard.
    """
    # a number inside each (id, slice) tells repeated rows apart; rows that are the same in all columns may change places
    rows = measured(docs, id_col, text_col).withColumn("row", F.row_number().over(Window.partitionBy("slice", "id").orderBy("hub")))
    rows = cut_lineage(rows)
    sizes = cut_lineage(rows.groupBy("hub").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    capacity = total / shards
    hubs = sizes.where("n > 1").select("hub", "bytes")
    single = rows.join(hubs.select("hub"), "hub", "left_anti").drop("hub")
    fits = F.col("bytes") * shards <= total
    columns = ["id", "row", "size", "crc", "hub", "slice", "shard"]
    start = rows.join(hubs.where(fits).select("hub"), "hub").withColumn("shard", F.pmod(F.xxhash64("id", "row"), F.lit(shards)).cast("int"))
    settled = propagate(start.select(columns), [0] * shards, capacity, LEAST_MOVED)
    parts = settled.groupBy("hub", "shard").agg(F.sum("size").alias("bytes"))
    homes = parts.groupBy("hub").agg(F.sum("bytes").alias("bytes"), F.max_by("shard", F.struct(F.col("bytes"), -F.col("shard"))).alias("home"))
    groups, taken = place_groups(cut_lineage(homes), shards, total)
    placed = rows.join(cut_lineage(groups), "hub").select(columns)
    if big := [r["hub"] for r in hubs.where(~fits).select("hub").collect()]:  # fewer than shards
        spread = cut_lineage(rows.where(F.col("hub").isin(big)))
        placed = placed.unionByName(propagate(in_a_row(spread, taken, capacity).select(columns), taken, capacity, few=True))
    placed = cut_lineage(placed)
    filled = cut_lineage(fill(cut_lineage(single), placed, shards).select("id", "row", "size", "slice", "crc", "shard"))
    out = cut_lineage(filled.unionByName(placed.select("id", "row", "size", "slice", "crc", "shard")))
    per = out.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    offset = per.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).select("shard", "slice", "before")
    inside = Window.partitionBy("shard", "slice").orderBy("id", "row")
    slot = F.col("before") + F.row_number().over(inside) - 1
    numbered = out.join(F.broadcast(offset), ["shard", "slice"])
    return numbered.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int"), slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
