"""Shortest paths and flood-aware routes on edge tables (edge_id, src, dst, len, blocked)."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.ordering import running
from freshet.session import stored

#: Rounds whose results are put together, so that no round reads many tables.
COMPACT_ROUNDS = 8
#: Edges of a block of nodes, and sources that a task follows at once.
BLOCK_EDGES = 1_000_000
SOURCES_TOGETHER = 64
#: Above this share of edges that lead into another block, rounds follow edges and not blocks.
MOST_CROSSING = 0.5
#: Rows reached in a round up to which they are sent to the edges, not the edges to them.
FEW_REACHED = 200_000
#: The last edge of a path without edges.
NO_EDGE = -(1 << 63)

_REACHED = "source long, node long, dist double, via long, hop long, block long, grp long, own boolean"


def risk_cost(length: Column, high_m: Column, very_high_m: Column) -> Column:
    return length + 5 * high_m + 12 * very_high_m


def simplest(edges: DataFrame, weight: str) -> DataFrame:
    """One edge for each (src, dst): the least weight, ties by edge_id."""
    best = edges.groupBy("src", "dst").agg(F.min(F.struct(F.col(weight).alias("w"), F.col("edge_id").alias("e"))).alias("_b"))
    return best.select("src", "dst", F.col("_b.w").alias("w"), F.col("_b.e").alias("edge_id"))


def _blocked(roads: DataFrame, block_edges: int) -> tuple[DataFrame, list[float]]:
    """``roads`` with ``block``, ranges of node ids with about ``block_edges`` edges each, and the ranges' starts but the first."""
    blocks = max(1, -(-roads.count() // block_edges))
    starts = sorted(set(roads.approxQuantile("src", [i / blocks for i in range(1, blocks)], 1 / (10 * blocks)))) if blocks > 1 else []

    @F.pandas_udf("long")
    def block(nodes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, nodes.to_numpy(), side="right"))

    return stored(roads.withColumn("block", block("src") if starts else F.lit(0).cast("long"))), starts


def distances_from(roads: DataFrame, sources: DataFrame, bound: float | None = None, block_edges: int = BLOCK_EDGES, together: int = SOURCES_TOGETHER, max_rounds: int = 10_000) -> DataFrame:
    """(source, node, dist, via, hop): least weight from every ``source`` up to ``bound``, the last edge of such a path and its number of edges.

    Nodes are cut into blocks by ranges of ids, sources into groups of ``together``. A round
    takes each block and group that something new has reached, with the best so far there,
    settles it by least (weight, edges, last edge), and sends what leaves it to other blocks:
    rounds follow the blocks on a path, not its edges, and only what is reached is shuffled
    beside the blocks it reaches. Memory of a task: a block's edges and ``together`` sources.
    Where over ``MOST_CROSSING`` of the edges leave their block, blocks would be sent to every
    group for a step each: then rows meet edges by joins (``_by_steps``).
    """
    edges, starts = _blocked(roads.select("src", "dst", "w", "edge_id"), block_edges)
    most = float("inf") if bound is None else bound
    if starts:
        into = F.pandas_udf(lambda nodes: pd.Series(np.searchsorted(starts, nodes.to_numpy(), side="right")), "long")("dst")
        crossing = edges.agg(F.avg((into != F.col("block")).cast("double"))).first()[0]
        if crossing > MOST_CROSSING:
            return _by_steps(edges.drop("block"), sources, most, max_rounds)

    def settle(edges: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _REACHED.split(", ")]
        if held.empty:
            return pd.DataFrame([], columns=names)
        block, group = int(held["block"].iloc[0]), int(held["grp"].iloc[0])
        out: dict[int, list[tuple[int, float, int]]] = {}
        for s, d, w, e in zip(edges["src"].tolist(), edges["dst"].tolist(), edges["w"].tolist(), edges["edge_id"].tolist(), strict=True):
            out.setdefault(s, []).append((d, w, e))
        home = dict(zip((ends := edges["dst"].unique()).tolist(), np.searchsorted(starts, ends, side="right").tolist(), strict=True)) if len(edges) else {}
        rows = []
        for source, mine in held.groupby("source"):
            known: dict[int, tuple] = {}
            new = []
            for n, d, h, v, fresh in zip(mine["node"].tolist(), mine["dist"].tolist(), mine["hop"].tolist(), mine["via"].tolist(), mine["fresh"].tolist(), strict=True):
                if fresh:
                    new.append((d, h, v, n))
                else:
                    known[n] = min(known.get(n, (d, h, v)), (d, h, v))
            heapq.heapify(new)
            sent: dict[int, tuple] = {}
            better: dict[int, tuple] = {}
            while new:
                d, h, v, n = heapq.heappop(new)
                if n in known and known[n] <= (d, h, v):
                    continue
                known[n] = better[n] = (d, h, v)
                for to, w, e in out.get(n, ()):
                    step = (d + w, h + 1, e)
                    if step[0] > most:
                        continue
                    if home[to] != block:
                        sent[to] = min(sent.get(to, step), step)
                    elif to not in known or step < known[to]:
                        heapq.heappush(new, (*step, to))
            rows += [(source, n, d, v, h, block, group, True) for n, (d, h, v) in better.items()]
            rows += [(source, n, d, v, h, home[n], group, False) for n, (d, h, v) in sent.items()]
        return pd.DataFrame(rows, columns=names)

    numbered = running(sources.select(F.col("source").cast("long").alias("source")).distinct(), [F.col("source")], {"_n": F.lit(1)})
    at = F.pandas_udf(lambda nodes: pd.Series(np.searchsorted(starts, nodes.to_numpy(), side="right")), "long")("source")
    fresh = numbered.select(
        "source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(NO_EDGE).alias("via"), F.lit(0).cast("long").alias("hop"), at.alias("block"), F.floor((F.col("_n") - 1) / together).alias("grp")
    )
    fresh = stored(fresh)
    parts: list[DataFrame] = []
    keys = ["block", "grp"]
    for _ in range(max_rounds):
        active = fresh.select(*keys).distinct()
        if active.limit(1).count() == 0:
            best = reduce(DataFrame.unionByName, parts, fresh).groupBy("source", "node").agg(F.min(F.struct("dist", "hop", "via")).alias("b"))
            return best.select("source", "node", "b.dist", F.nullif("b.via", F.lit(NO_EDGE)).alias("via"), "b.hop")
        pairs = active.select(F.col("block").alias("_block"), F.col("grp").alias("_grp")).hint("shuffle_hash")
        held = fresh.withColumn("fresh", F.lit(True))
        if parts:
            before = reduce(DataFrame.unionByName, parts).join(pairs, (F.col("block") == F.col("_block")) & (F.col("grp") == F.col("_grp")), "left_semi")
            held = held.unionByName(before.withColumn("fresh", F.lit(False)))
        sent = edges.join(pairs, F.col("block") == F.col("_block")).select("src", "dst", "w", "edge_id", F.col("block").alias("e_block"), F.col("_grp").alias("e_grp"))
        reached = stored(sent.groupBy("e_block", "e_grp").cogroup(held.groupBy(*keys)).applyInPandas(settle, _REACHED))
        parts.append(reached.where("own").drop("own"))
        left = reached.where("not own").groupBy("source", "node", *keys).agg(F.min(F.struct("dist", "hop", "via")).alias("b"))
        fresh = stored(left.select("source", "node", "b.dist", "b.via", "b.hop", *keys))
        if len(parts) == COMPACT_ROUNDS:
            best = reduce(DataFrame.unionByName, parts).groupBy("source", "node", *keys).agg(F.min(F.struct("dist", "hop", "via")).alias("b"))
            parts = [stored(best.select("source", "node", "b.dist", "b.via", "b.hop", *keys))]
    raise RuntimeError(f"paths did not settle in {max_rounds} rounds")


def _by_steps(edges: DataFrame, sources: DataFrame, most: float, max_rounds: int) -> DataFrame:
    """As ``distances_from``, a step of all paths in a round.

    A round joins the rows that got better in the last one to the edges of their nodes and keeps
    what is better than all before: it reads the edges, but shuffles them only where over
    ``FEW_REACHED`` rows (counted) are new. Each row and edge is sent a constant number of times a
    round, whatever the number of sources.
    """
    keys = ["source", "node"]
    least = lambda df: df.groupBy(*keys).agg(F.min(F.struct("dist", "hop", "via")).alias("_b")).select(*keys, "_b.dist", "_b.hop", "_b.via")
    front = stored(sources.select(F.col("source").cast("long").alias("source")).distinct().select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("hop"), F.lit(NO_EDGE).alias("via")))
    ways = edges.where(F.col("w") <= most) if most < float("inf") else edges
    parts = [front]
    for _ in range(max_rounds):
        reached = front.count()
        if not reached:
            best = least(reduce(DataFrame.unionByName, parts))
            return best.select(*keys, "dist", F.nullif("via", F.lit(NO_EDGE)).alias("via"), "hop")
        at = F.broadcast(front) if reached <= FEW_REACHED else front.hint("shuffle_merge")
        steps = ways.join(at.withColumnRenamed("node", "_at").drop("via"), F.col("src") == F.col("_at"))
        steps = steps.select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), (F.col("hop") + 1).alias("hop"), F.col("edge_id").alias("via")).where(F.col("dist") <= most)
        # both sides in one aggregate: the least new step, and the least of all before
        told = steps.withColumn("_new", F.lit(True)).unionByName(reduce(DataFrame.unionByName, parts).withColumn("_new", F.lit(False)))
        row = F.struct("dist", "hop", "via")
        told = told.groupBy(*keys).agg(F.min(F.when(F.col("_new"), row)).alias("_b"), F.min(F.when(~F.col("_new"), row)).alias("_a"))
        better = told.where(F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col("_b") < F.col("_a"))))
        front = stored(better.select(*keys, "_b.dist", "_b.hop", "_b.via"))
        parts.append(front)
        if len(parts) > COMPACT_ROUNDS:
            parts = [stored(least(reduce(DataFrame.unionByName, parts)))]
    raise RuntimeError(f"paths did not settle in {max_rounds} rounds")


def distances(roads: DataFrame, source: int, **kw) -> DataFrame:
    """(node, dist, via, hop) from one source."""
    return distances_from(roads, roads.sparkSession.range(1).select(F.lit(source).cast("long").alias("source")), **kw).drop("source")


def routes(edges: DataFrame, sources: DataFrame, weight: str = "len", avoid_blocked: bool = False, bound: float | None = None, **kw) -> DataFrame:
    """(source, node, dist, path): least total weight from every source, and the edge ids of such a path.

    Distances come first, with the last edge of each path; paths are then put together by
    doubling, from the last edges back to the source, in as many rounds as the longest
    path's length has binary digits. Weights must not be negative.
    """
    usable = edges.where(~F.col("blocked")) if avoid_blocked else edges
    roads = stored(simplest(usable, weight))
    found = stored(distances_from(roads, sources, bound, **kw))
    came = roads.select(F.col("edge_id").alias("_via"), F.col("src").alias("up"))
    nothing = F.array().cast("array<long>")
    # path: the edges between ``up`` and the node
    now = stored(found.join(came.hint("shuffle_hash"), F.col("via") == F.col("_via"), "left").select("source", "node", "dist", "up", F.when(F.col("via").isNotNull(), F.array("via")).otherwise(nothing).alias("path")))
    while now.where("up is not null").limit(1).count():
        above = now.select(F.col("source").alias("_source"), F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("path").alias("_path")).hint("shuffle_hash")
        far = now.join(above, (F.col("source") == F.col("_source")) & (F.col("up") == F.col("_node")), "left")
        now = stored(far.select("source", "node", "dist", F.col("_up").alias("up"), F.concat(F.coalesce("_path", nothing), "path").alias("path")))
    return now.select("source", "node", "dist", "path")


def sssp(edges: DataFrame, source: int, weight: str = "len", avoid_blocked: bool = False, **kw) -> DataFrame:
    """(node, dist, path) from one source; see ``routes``."""
    return routes(edges, edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("source")), weight, avoid_blocked, **kw).drop("source")


def route_metrics(paths: DataFrame, edges: DataFrame, measures: dict[str, Column] | None = None) -> DataFrame:
    """(node, edges, length, blocked_edges, measures): sums along each path."""
    measures = measures or {}
    steps = paths.select("node", F.explode_outer("path").alias("_e"))
    met = steps.join(edges.hint("merge"), F.col("_e") == F.col("edge_id"), "left")
    return met.groupBy("node").agg(
        F.count("_e").alias("edges"), F.coalesce(F.sum("len"), F.lit(0.0)).alias("length"), F.coalesce(F.sum(F.when(F.col("blocked"), 1).otherwise(0)), F.lit(0)).alias("blocked_edges"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in measures.items()],
    )


def route_geometry(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, steps): the edges of each path in order, as array<struct<i, edge_id, src, dst>>."""
    steps = paths.select("node", F.posexplode("path").alias("i", "_e"))
    met = steps.join(edges.hint("merge"), F.col("_e") == F.col("edge_id"))
    return met.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("i", "edge_id", "src", "dst"))).alias("steps"))


def choose_destination(paths: DataFrame, candidates: DataFrame, inside_risk: DataFrame, radius: float, nearest: int = 25) -> DataFrame:
    """The reachable candidate (id, node, dist_m) outside risk, among the nearest, of least cost."""
    near = candidates.where(F.col("dist_m") <= radius).join(inside_risk.select("id").hint("merge"), "id", "left_anti").orderBy("dist_m", "id").limit(nearest)
    cost = paths.select("node", F.col("dist").alias("cost"))
    return near.join(cost.hint("merge"), "node").orderBy("cost", "id").limit(1)


def choose_destinations(routes: DataFrame, candidates: DataFrame, inside_risk: DataFrame, radius: float, nearest: int = 25) -> DataFrame:
    """(source, id, cost): of each source's ``nearest`` candidates (source, id, node, dist_m) within ``radius`` and outside risk, the reachable one of least cost."""
    near = candidates.where(F.col("dist_m") <= radius).join(inside_risk.select("id").hint("shuffle_hash"), "id", "left_anti")
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("dist_m", "id"))).where(F.col("_n") <= nearest)
    cost = routes.select("source", "node", F.col("dist").alias("cost"))
    best = ranked.select("source", "node", "id").join(cost.hint("shuffle_hash"), ["source", "node"]).groupBy("source").agg(F.min(F.struct("cost", "id")).alias("_b"))
    return best.select("source", F.col("_b.id").alias("id"), F.col("_b.cost").alias("cost"))


def nearest_safe(routes: DataFrame, least_m: float = 25.0) -> DataFrame:
    """For each origin, the nearest route end at least ``least_m`` away: (origin, id, length)."""
    best = routes.where(F.col("length") >= least_m).groupBy("origin").agg(F.min(F.struct("length", "id")).alias("_b"))
    return best.select("origin", F.col("_b.id").alias("id"), F.col("_b.length").alias("length"))


def route_doc(base: DataFrame, avoiding: DataFrame, metres_per_min: float = 250.0) -> DataFrame:
    """(node, doc): the decision as JSON from the metrics of both runs."""
    a = base.select("node", F.col("length").alias("base_m"), F.col("blocked_edges").alias("base_blocked"))
    b = avoiding.select("node", F.col("length").alias("safe_m"), F.col("blocked_edges").alias("safe_blocked"))
    minutes = lambda m: F.greatest(F.lit(1), F.ceil(m / metres_per_min)).cast("long")
    doc = F.struct(
        ((F.col("base_blocked") > 0) & (F.col("safe_blocked") == 0)).alias("avoided"), "base_blocked", "safe_blocked", minutes(F.col("base_m")).alias("base_minutes"), minutes(F.col("safe_m")).alias("safe_minutes"),
        F.when(F.col("safe_m").isNull(), "NO_ROUTE").otherwise("FOUND").alias("status"),
    )
    return a.join(b, "node", "left").select("node", F.to_json(doc).alias("doc"))


def ranked_destinations(paths: DataFrame, n: int) -> DataFrame:
    w = Window.orderBy("dist", "node")
    return paths.orderBy("dist", "node").limit(n).withColumn("rank", F.row_number().over(w))
