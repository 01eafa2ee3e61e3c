"""Graph operators on edge tables: degrees, ranks, components, communities, betweenness.

Every iteration is a join and an aggregation; rounds are cut at tables in the shared folder.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasieve.operators.sampling import sample_rows
from contrasieve.session import cut_lineage, discard


def bipartite_edges(pairs: DataFrame, agency: str, supplier: str, weight: str) -> DataFrame:
    """(src, dst, weight) with typed vertex names ``A:`` and ``S:``."""
    return pairs.select(
        F.concat(F.lit("A:"), F.col(agency)).alias("src"),
        F.concat(F.lit("S:"), F.col(supplier)).alias("dst"),
        F.col(weight).cast("double").alias("weight"),
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """Every undirected edge in both directions; loops once."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """(vertex, degree, strength)."""
    both = both_ways(edges)
    return both.groupBy(F.col("src").alias("vertex")).agg(
        F.count("*").alias("degree"), F.sum("weight").alias("strength")
    )


def page_rank(edges: DataFrame, alpha: float = 0.85, rounds: int = 1000, tolerance: float = 1e-6, cut_every: int = 5) -> DataFrame:
    """(vertex, rank) of the undirected weighted graph, once ranks settle; an error if they do not."""
    both = both_ways(edges)
    total = both.groupBy("src").agg(F.sum("weight").alias("_s"))
    links = cut_lineage(both.join(total, "src").select("src", "dst", (F.col("weight") / F.col("_s")).alias("share")))
    vertices = total.select(F.col("src").alias("vertex"))
    n = vertices.count()
    ranks = last = cut_lineage(vertices.withColumn("rank", F.lit(1.0 / max(n, 1))))
    if not n:
        return ranks
    for i in range(rounds):
        flow = links.join(ranks, links["src"] == ranks["vertex"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("_in"))
        ranks = flow.select(F.col("dst").alias("vertex"), ((1 - alpha) / n + alpha * F.col("_in")).alias("rank"))
        if (i + 1) % cut_every == 0:
            fresh = cut_lineage(ranks)
            if i >= cut_every:
                moved = fresh.join(last.withColumnRenamed("rank", "_r"), "vertex").agg(F.sum(F.abs(F.col("rank") - F.col("_r")))).first()[0]
                if moved < tolerance * n:
                    discard(links, last)
                    return fresh
            discard(last)
            last = ranks = fresh
    raise RuntimeError(f"ranks have not settled after {rounds} rounds")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(vertex, component): the smallest vertex reachable from each one.

    Alternates two star rewritings: every vertex points its larger neighbours, then its
    smaller ones, at its smallest neighbour. Edges never multiply, and the number of rounds
    grows with the logarithm of the largest component.
    """
    e = cut_lineage(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    vertices = e.select(F.col("u").alias("vertex")).unionByName(e.select("v").withColumnRenamed("v", "vertex")).distinct()
    e = e.filter("u <> v")
    state = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(moved.unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    root = e.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("root"))
    return vertices.join(root, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("component"))


def label_propagation(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(vertex, community): heaviest label among the neighbours, until no vertex wants another one.

    Ties keep the label a vertex has, else go to the smaller one. Another half of the vertices (by
    hash) may move in each round, so neighbours do not swap labels for ever.
    """
    both = cut_lineage(both_ways(edges))
    state = cut_lineage(both.select(F.col("src").alias("vertex")).distinct().withColumn("community", F.col("vertex")))
    fresh = None
    for i in range(max_rounds):
        votes = both.join(state, both["dst"] == state["vertex"]).groupBy("src", "community").agg(F.sum("weight").alias("w"))
        own = state.select(F.col("vertex").alias("src"), F.col("community").alias("own"))
        order = F.struct((-F.round("w", 9)).alias("w"), (F.col("community") != F.col("own")).alias("other"), "community")
        best = votes.join(own, "src").groupBy("src", "own").agg(F.min(order)["community"].alias("to"))
        last, fresh = fresh, cut_lineage(best.select(F.col("src").alias("vertex"), "own", "to"))
        discard(last)
        if fresh.filter("own <> to").isEmpty():
            return fresh.select("vertex", F.col("own").alias("community"))
        active = F.pmod(F.xxhash64("vertex", F.lit(i)), F.lit(2)) == 0
        state = fresh.select("vertex", F.when(active, F.col("to")).otherwise(F.col("own")).alias("community"))
    raise RuntimeError(f"labels have not settled after {max_rounds} rounds")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row with the modularity of a partition."""
    c = communities.select("vertex", "community")
    both = both_ways(edges)
    tagged = both.join(c.withColumnsRenamed({"vertex": "src", "community": "a"}), "src").join(
        c.withColumnsRenamed({"vertex": "dst", "community": "b"}), "dst"
    )
    per = tagged.groupBy(F.col("a").alias("community")).agg(
        F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("_in"), F.sum("weight").alias("_tot")
    )
    m = per.agg(F.sum("_tot")).scalar()
    return per.agg(F.sum(F.col("_in") / m - (F.col("_tot") / m) * (F.col("_tot") / m)).alias("modularity"))


def _moves(graph: DataFrame, state: DataFrame, m2: float, least: float) -> DataFrame:
    """(vertex, k, community, inside, to, gain): where each vertex would raise modularity most, and by how much.

    ``inside`` is the weight that ties it to its own community, loops included; ``to`` is its own
    community unless a move gains more than ``least``.
    """
    totals = state.groupBy("community").agg(F.sum("k").alias("tot"))
    near = graph.join(state.select(F.col("vertex").alias("dst"), "community"), "dst")
    loop = F.col("src") == F.col("dst")
    pull = near.groupBy("src", "community").agg(
        F.sum(F.when(loop, 0.0).otherwise(F.col("weight"))).alias("w"), F.sum(F.when(loop, F.col("weight")).otherwise(0.0)).alias("l")
    )
    own = state.select(F.col("vertex").alias("src"), F.col("community").alias("own"), "k")
    stay = state.select(F.col("vertex").alias("src"), "community", F.lit(0.0).alias("w"), F.lit(0.0).alias("l"))
    options = pull.unionByName(stay).groupBy("src", "community").agg(F.sum("w").alias("w"), F.sum("l").alias("l"))
    scored = options.join(own, "src").join(totals, "community")
    here = F.col("community") == F.col("own")
    pulled = F.col("w") - F.col("k") * (F.col("tot") - F.when(here, F.col("k")).otherwise(0.0)) / m2
    best = scored.withColumn("pulled", 2 * pulled / m2).groupBy("src", "own", "k").agg(
        F.max(F.when(here, F.col("pulled"))).alias("now"),
        F.max(F.when(here, F.col("w") + F.col("l"))).alias("inside"),
        F.min(F.struct((-F.round("pulled", 12)).alias("p"), (~here).alias("other"), F.col("community").alias("c"))).alias("b"),
    )
    gain = -F.col("b.p") - F.col("now")
    to = F.when(gain > least, F.col("b.c")).otherwise(F.col("own"))
    return best.select(F.col("src").alias("vertex"), "k", F.col("own").alias("community"), "inside", to.alias("to"), gain.alias("gain"))


def _apart(movers: DataFrame, *salt: int) -> DataFrame:
    """Movers of which no two touch the same community: each has the highest hash at both of its ends."""
    ranked = movers.withColumn("p", F.struct(F.xxhash64("vertex", *[F.lit(s) for s in salt]).alias("h"), "vertex"))
    ends = ranked.select("p", F.explode(F.array("community", "to")).alias("c")).groupBy("c").agg(F.max("p").alias("top"))
    first = ranked.join(ends.withColumnsRenamed({"c": "community", "top": "top_a"}), "community").join(
        ends.withColumnsRenamed({"c": "to", "top": "top_b"}), "to"
    )
    return first.filter("p = top_a AND p = top_b").select("vertex", F.lit(True).alias("moves"))


def modularity_communities(
    edges: DataFrame, max_rounds: int = 2000, least: float = 1e-7, trace: list[tuple[int, float]] | None = None
) -> DataFrame:
    """(vertex, community): moves that raise modularity, then contraction, until nothing moves.

    In a round a hashed share of the vertices that gain more than ``least`` move together. If that does
    not raise modularity, the round is undone and the share made smaller; the smallest step are moves that touch
    no community twice, whose gains add up, so it cannot fail. Modularity rises in every round that is
    kept, hence rounds end. When no vertex gains, communities become the vertices of a smaller graph.
    ``trace`` collects (level, modularity) of the rounds kept.
    """
    graph = cut_lineage(both_ways(edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    mapping = cut_lineage(graph.select(F.col("src").alias("vertex")).distinct().withColumn("community", F.col("vertex")))
    m2 = graph.agg(F.sum("weight")).first()[0]
    for level in itertools.count():
        strength = graph.groupBy(F.col("src").alias("vertex")).agg(F.sum("weight").alias("k"))
        state = cut_lineage(strength.withColumn("community", F.col("vertex")))
        kept, best, share, moved = None, -2.0, 0.5, False
        for i in range(max_rounds):
            found = cut_lineage(_moves(graph, state, m2, least))
            per = found.groupBy("community").agg(F.sum("inside").alias("i"), F.sum("k").alias("t"), F.count_if(F.col("to") != F.col("community")).alias("n"))
            value, movers = per.agg(F.sum(F.col("i") / m2 - (F.col("t") / m2) * (F.col("t") / m2)), F.sum("n")).first()
            if kept is None or value > best:
                if kept is not None:
                    moved, share = True, min(0.5, 2 * share)
                    discard(kept)
                kept, best, left = found, value, movers
                if trace is not None:
                    trace.append((level, value))
                if not left:
                    break
            else:
                discard(found)
                share = share / 4 if share > 1 / 64 else 0.0
            wish = kept.filter("to <> community")
            if share:
                chosen = wish.filter(F.pmod(F.xxhash64("vertex", F.lit(level), F.lit(i)), F.lit(1 << 20)) < int(share * (1 << 20)))
                chosen = chosen.select("vertex", F.lit(True).alias("moves"))
            else:
                chosen, share = _apart(wish, level, i), 1 / 128
            target = F.when(F.col("moves"), F.col("to")).otherwise(F.col("community"))
            old, state = state, cut_lineage(kept.join(chosen, "vertex", "left").select("vertex", "k", target.alias("community")))
            discard(old)
        else:
            raise RuntimeError(f"communities have not settled after {max_rounds} rounds")
        if not moved:
            discard(graph, state, kept)
            return mapping
        up = kept.select("vertex", "community")
        step = up.select(F.col("vertex").alias("community"), F.col("community").alias("_up"))
        old, mapping = mapping, cut_lineage(mapping.join(step, "community").select("vertex", F.col("_up").alias("community")))
        smaller = cut_lineage(
            graph.join(up.withColumnsRenamed({"vertex": "src", "community": "a"}), "src")
            .join(up.withColumnsRenamed({"vertex": "dst", "community": "b"}), "dst")
            .groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))
        )
        discard(old, graph, state, kept)
        graph = smaller


def betweenness(edges: DataFrame, sources: int = 200, seed: int = 42) -> DataFrame:
    """(vertex, betweenness) from shortest paths of sampled sources, scaled to all vertices.

    All sources are searched together: one level of every search is one join. Counts go
    forward level by level, until no vertex is left to reach; dependencies go back the same way.
    """
    both = cut_lineage(both_ways(edges).select("src", "dst").distinct())
    vertices = both.select(F.col("src").alias("vertex")).distinct()
    n = vertices.count()
    starts = sample_rows(vertices, "vertex", sources, seed)
    level = cut_lineage(starts.select(F.col("vertex").alias("source"), "vertex", F.lit(1.0).alias("sigma"), F.lit(0).alias("depth")))
    seen, levels = level, [level]
    for depth in itertools.count(1):
        reached = level.join(both, level["vertex"] == both["src"]).groupBy("source", F.col("dst").alias("vertex")).agg(F.sum("sigma").alias("sigma"))
        fresh = reached.join(seen.select("source", "vertex"), ["source", "vertex"], "left_anti")
        level = cut_lineage(fresh.withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        levels.append(level)
        seen = cut_lineage(seen.unionByName(level))
    delta = cut_lineage(levels[-1].withColumn("delta", F.lit(0.0)))
    parts = [delta]
    for up in reversed(levels[:-1]):
        share = delta.select("source", F.col("vertex").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("_d"))
        gained = up.join(both, up["vertex"] == both["src"]).select("source", "vertex", "dst").join(share, ["source", "dst"])
        gained = gained.groupBy("source", "vertex").agg(F.sum("_d").alias("_d"))
        delta = cut_lineage(
            up.join(gained, ["source", "vertex"], "left").withColumn("delta", F.col("sigma") * F.coalesce("_d", F.lit(0.0))).drop("_d")
        )
        parts.append(delta)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    used = min(sources, n)
    score = every.filter("source <> vertex").groupBy("vertex").agg((F.sum("delta") * n / used / 2).alias("betweenness"))
    return vertices.join(score, "vertex", "left").fillna(0.0, ["betweenness"])


def community_summary(vertices: DataFrame, community: str, side: str, hint: str, flag: str) -> DataFrame:
    """Vertices per community: agencies, suppliers, name hints and red flags."""
    return vertices.groupBy(community).agg(
        F.count("*").alias("n_vertices"),
        F.count_if(F.col(side) == "agency").alias("n_agencies"),
        F.count_if(F.col(side) == "supplier").alias("n_suppliers"),
        F.count_if(hint).alias("n_hints"),
        F.count_if(flag).alias("n_flags"),
    )


def spread_labels(edges: DataFrame, labels: DataFrame, tolerance: float = 1e-6, max_rounds: int = 1000, check_every: int = 5) -> DataFrame:
    """Semi-supervised propagation to its fixed point: (vertex, label, share).

    ``labels`` (vertex, label) are clamped; the others take the weighted mean of their neighbours'
    label shares. Rounds end with the first multiple of ``check_every`` whose shares differ by less than
    ``tolerance`` from those of the round before; then every vertex that a label can reach has rows.
    An error is raised if that takes more than ``max_rounds``.
    """
    both = cut_lineage(both_ways(edges).groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    fixed = labels.select("vertex", "label", F.lit(1.0).alias("share"))
    free = both.select(F.col("src").alias("vertex")).distinct().join(labels.select("vertex"), "vertex", "left_anti")
    inner = cut_lineage(both.join(free, both["src"] == free["vertex"]).select("src", "dst", "weight"))
    state, old = fixed, None
    for i in range(1, max_rounds + 1):
        mass = inner.join(state, inner["dst"] == state["vertex"]).groupBy(F.col("src").alias("vertex"), "label").agg(F.sum(F.col("weight") * F.col("share")).alias("m"))
        total = mass.groupBy("vertex").agg(F.sum("m").alias("t")).filter("t > 0")
        moved = mass.join(total, "vertex").select("vertex", "label", (F.col("m") / F.col("t")).alias("share"))
        if i % check_every == check_every - 1:
            moved = before = cut_lineage(moved)
        elif i % check_every == 0:
            moved = cut_lineage(moved)
            gap = moved.join(before.withColumnRenamed("share", "_s"), ["vertex", "label"], "full").agg(
                F.max(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("_s", F.lit(0.0))))
            ).first()[0]
            discard(before, old)
            if (gap or 0.0) < tolerance:
                discard(both, inner)
                return fixed.unionByName(moved)
            old = moved
        state = fixed.unionByName(moved)
    raise RuntimeError(f"shares have not settled after {max_rounds} rounds")


def spread_report(spread: DataFrame, truth: DataFrame, min_share: float = 0.8) -> DataFrame:
    """One row: hidden rows reached, accuracy on them, disagreements held with a large share.

    ``spread`` comes from :func:`spread_labels`; ``truth`` has (vertex, label) of the hidden rows.
    """
    best = spread.groupBy("vertex").agg(F.min(F.struct((-F.round("share", 9)).alias("s"), "label")).alias("b"))
    judged = best.join(truth.select("vertex", F.col("label").alias("_true")), "vertex")
    hit = F.col("b.label") == F.col("_true")
    return judged.agg(
        F.count("*").alias("n_reached"),
        F.avg(hit.cast("int")).alias("accuracy"),
        F.count_if(~hit & (-F.col("b.s") > min_share)).alias("n_suspects"),
    )


def regularise_from_seeds(edges: DataFrame, seeds: DataFrame, rounds: int = 30, cut_every: int = 5) -> DataFrame:
    """(vertex, score): seeds stay 1, every other vertex becomes the mean of its neighbours.

    All vertices are updated from the previous round, so the result does not depend on the
    order of rows.
    """
    both = cut_lineage(both_ways(edges).select("src", "dst").distinct())
    base = both.select(F.col("src").alias("vertex")).distinct().join(
        seeds.select("vertex").distinct().withColumn("seed", F.lit(True)), "vertex", "left"
    )
    base = cut_lineage(base.select("vertex", F.coalesce("seed", F.lit(False)).alias("seed")))
    state = base.select("vertex", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score"))
    for i in range(rounds):
        means = both.join(state, both["dst"] == state["vertex"]).groupBy(F.col("src").alias("vertex")).agg(F.avg("score").alias("m"))
        state = base.join(means, "vertex").select("vertex", F.when(F.col("seed"), 1.0).otherwise(F.col("m")).alias("score"))
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            state = cut_lineage(state)
    return state
