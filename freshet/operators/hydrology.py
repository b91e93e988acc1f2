"""Depression filling and flow accumulation in tiles, with small graphs of tile borders.

**Filling.** Water at a place stands at w = max(z, least neighbour's w + eps). Along a path
of k steps the level x at its start becomes max(x + k * eps, m), with m the path's own
height; such functions put together are of the same form. So

1. every tile floods from its rim (cells with a neighbour in another tile) and from its
   outlets (cells with a missing neighbour): each cell belongs to the source that reaches it
   lowest, and where two sources' cells meet, a path leads from one source to the other, of
   which the lowest is kept. These few edges, and the steps over tile borders, are the
   **spill graph**;
2. groups of ``FAN`` x ``FAN`` tiles are thinned out the same way to the nodes on the group's
   rim, level by level, until one group is left. It is solved, and levels are solved
   downwards, each group from the values on its rim;
3. every tile is solved from the values of its rim.

The tables are passed twice and no group grows with the grid. With eps = 0 that is exact. With
eps > 0 a higher path of fewer steps may be better than the lowest; the levels found are those
of real paths, hence not too low, and rounds of exchange lower them: only groups of tiles with
a cell on a tile's rim that a neighbour can lower are solved again, until there is none.

**Flow.** Each tile adds up its cells along the directions and tells what leaves it to which
cell of another tile (its outlets), and where each cell of its rim sends what it gets. These
outlets form a small forest, accumulated by doubling; then each tile adds the inflow up.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.grid import D8, _doubled
from freshet.session import stored

#: Cells on the side of a tile, and tiles on the side of a group of the next level.
TILE = 128
FAN = 8
#: Cells on the side of the groups of tiles that exchange levels where there is a step height.
EXCHANGE = 256
#: Groups (a row each) up to which the list of those to solve again is broadcast.
BROADCAST_GROUPS = 100_000
#: The outside, from which paths start at no level.
OUTSIDE = -(1 << 63)
#: Levels that differ by less are equal (sums of steps may round differently).
TOLERANCE = 1e-9

_EDGES = "src long, dst long, k int, m double"
_STEPS = [(a, b) for a, b in D8]

#: (neighbour, k, m there, k and m of the way back)
Neighbours = Callable[[int], Iterable[tuple[int, int, float, int, float]]]


def _id(row: Column, col: Column) -> Column:
    return row.cast("long") * F.lit(1 << 32) + col.cast("long")


def _row(cell: Column) -> Column:
    return F.shiftright(cell + F.lit(1 << 31), 32)


def _col(cell: Column) -> Column:
    return cell - _row(cell) * F.lit(1 << 32)


def spill(rim: dict[int, float], outlets: dict[int, float], around: Neighbours, eps: float) -> dict[tuple[int, int], tuple[float, int]]:
    """(from, to) -> (m, k): the lowest paths between rim nodes, and from outside to them (``outlets``: their levels).

    ``rim`` tells how low a path through each rim node can be, so that no cell is given to a
    high node from which it goes down. Flooding in order of height gives every node the source that reaches it lowest (forward
    function), and the way back to it (reverse function).
    """
    heap = [(z, 0, n, n, 0, float("-inf")) for n, z in rim.items()] + [(z, 0, n, OUTSIDE, 0, float("-inf")) for n, z in outlets.items()]
    heapq.heapify(heap)
    settled: dict[int, tuple[int, int, float, int, float]] = {}
    best: dict[tuple[int, int], tuple[float, int]] = {}

    def keep(a: int, b: int, m: float, k: int) -> None:
        if b != OUTSIDE and ((a, b) not in best or (m, k) < best[a, b]):
            best[a, b] = (m, k)

    for n, z in outlets.items():
        if n in rim:
            keep(OUTSIDE, n, z, 0)
    while heap:
        m, k, n, label, back_k, back_m = heapq.heappop(heap)
        if n in settled:
            continue
        settled[n] = (label, k, m, back_k, back_m)
        if label != OUTSIDE and n in outlets:
            keep(OUTSIDE, label, max(outlets[n] + back_k * eps, back_m), back_k)
        for v, step_k, step_m, home_k, home_m in around(n):
            other = settled.get(v)
            if other is None:
                heapq.heappush(heap, (max(m + step_k * eps, step_m), k + step_k, v, label, home_k + back_k, max(home_m + back_k * eps, back_m)))
            elif other[0] != label:
                o_label, o_k, o_m, o_back_k, o_back_m = other
                keep(label, o_label, max(max(m + step_k * eps, step_m) + o_back_k * eps, o_back_m), k + step_k + o_back_k)
                keep(o_label, label, max(max(o_m + home_k * eps, home_m) + back_k * eps, back_m), o_k + home_k + back_k)
    return best


def solve(known: dict[int, float], around: Neighbours, eps: float) -> dict[int, float]:
    """The least level of every node that paths from the ``known`` levels reach, these included."""
    out: dict[int, float] = {}
    heap = [(w, n) for n, w in known.items()]
    heapq.heapify(heap)
    while heap:
        w, n = heapq.heappop(heap)
        if n in out:
            continue
        out[n] = w
        for v, k, m, _, _ in around(n):
            if v not in out:
                heapq.heappush(heap, (max(w + k * eps, m), v))
    return out


class _Tile:
    """The cells of one tile (and, around them, those it borders on)."""

    def __init__(self, cells: pd.DataFrame, size: int):
        key = (int(cells["tile_row"].iloc[0]), int(cells["tile_col"].iloc[0]))
        ids = (cells["row"].to_numpy("int64") << 32) + cells["col"].to_numpy("int64")
        self.z = dict(zip(ids.tolist(), cells["z"].tolist(), strict=True))
        own = ((cells["row"] - cells["row0"]) // size == key[0]) & ((cells["col"] - cells["col0"]) // size == key[1])
        self.own = set(ids[own.to_numpy()].tolist())
        self.moves = [(a << 32) + b for a, b in _STEPS]
        self.rim = sorted(n for n in self.own if any(n + d in self.z and n + d not in self.own for d in self.moves))
        self.outlets = {n: self.z[n] for n in self.own if any(n + d not in self.z for d in self.moves)}

    def around(self, n: int) -> Iterable[tuple[int, int, float, int, float]]:
        here = self.z[n]
        return [(n + d, 1, self.z[n + d], 1, here) for d in self.moves if n + d in self.own]

    def crossing(self) -> list[tuple[int, int]]:
        return [(n, n + d) for n in self.rim for d in self.moves if n + d in self.z and n + d not in self.own]


def _group_graph(edges: pd.DataFrame) -> tuple[Neighbours, dict[int, float], dict[int, float]]:
    """Neighbours inside a group, levels from outside, and the nodes with edges to other groups with the least m of their edges inside."""
    inside = edges[edges["inner"] & (edges["src"] != OUTSIDE)]
    there = {(s, d): (k, m) for s, d, k, m in zip(inside["src"].tolist(), inside["dst"].tolist(), inside["k"].tolist(), inside["m"].tolist(), strict=True)}
    lists: dict[int, list] = {}
    for (s, d), (k, m) in there.items():
        home = there.get((d, s))
        lists.setdefault(s, []).append((d, k, m, *(home or (0, float("inf")))))
    out = edges[edges["src"] == OUTSIDE]
    least = inside.groupby("dst")["m"].min().to_dict()
    rim = {n: least.get(n, float("-inf")) for n in sorted(set(edges.loc[~edges["inner"], "src"].tolist()))}
    return lambda n: lists.get(n, ()), dict(zip(out["dst"].tolist(), out["m"].tolist(), strict=True)), rim


def _grouped(edges: DataFrame, row0: int, col0: int, side: int) -> DataFrame:
    """``edges`` with the group of their source (from outside: of their end), and if they stay inside."""
    at = lambda c: (F.floor((_row(c) - row0) / side), F.floor((_col(c) - col0) / side))
    (sr, sc), (dr, dc) = at(F.col("src")), at(F.col("dst"))
    out = F.col("src") == OUTSIDE
    return edges.select(*edges.columns, F.when(out, dr).otherwise(sr).alias("g_row"), F.when(out, dc).otherwise(sc).alias("g_col"), (out | ((sr == dr) & (sc == dc))).alias("inner"))


def _rim_levels(tiles: DataFrame, extent: tuple[int, int, int], size: int, eps: float) -> DataFrame:
    """(node, w): levels of all rim cells, by the spill graph and its levels."""
    row0, col0, side = extent

    def borders(cells: pd.DataFrame) -> pd.DataFrame:
        tile = _Tile(cells, size)
        if not tile.own:
            return pd.DataFrame([], columns=["src", "dst", "k", "m"])
        found = spill({n: tile.z[n] for n in tile.rim}, tile.outlets, tile.around, eps)
        rows = [(a, b, k, m) for (a, b), (m, k) in found.items()] + [(a, b, 1, tile.z[b]) for a, b in tile.crossing()]
        return pd.DataFrame(rows, columns=["src", "dst", "k", "m"])

    def thinned(edges: pd.DataFrame) -> pd.DataFrame:
        around, outlets, rim = _group_graph(edges)
        found = spill(rim, outlets, around, eps)
        rows = pd.DataFrame([(a, b, k, m) for (a, b), (m, k) in found.items()], columns=["src", "dst", "k", "m"])
        return pd.concat([rows, edges.loc[~edges["inner"], ["src", "dst", "k", "m"]]])

    def solved(edges: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if edges.empty:
            return known[["node", "w"]]
        around, outlets, _ = _group_graph(edges)
        levels = solve(outlets | dict(zip(known["node"].tolist(), known["w"].tolist(), strict=True)), around, eps)
        return pd.DataFrame({"node": np.array(list(levels), dtype="int64"), "w": np.array(list(levels.values()), dtype="float64")})

    edges = stored(tiles.groupBy("tile_row", "tile_col").applyInPandas(borders, _EDGES))
    levels = [(edges, size * FAN)]
    while levels[-1][1] < side:
        edges, wide = levels[-1]
        levels.append((stored(_grouped(edges, row0, col0, wide).groupBy("g_row", "g_col").applyInPandas(thinned, _EDGES)), wide * FAN))
    known = edges.sparkSession.createDataFrame([], "node long, w double")
    for edges, wide in reversed(levels):
        at = known.select("node", "w", F.floor((_row(F.col("node")) - row0) / wide).alias("k_row"), F.floor((_col(F.col("node")) - col0) / wide).alias("k_col"))
        groups = _grouped(edges, row0, col0, wide).groupBy("g_row", "g_col")
        known = stored(groups.cogroup(at.groupBy("k_row", "k_col")).applyInPandas(solved, "node long, w double"))
    return known


def fill(cells: DataFrame, value: str, eps: float = 0.0, size: int = TILE, max_rounds: int = 1000) -> DataFrame:
    """``cells`` with ``filled``: depressions raised so that every cell drains, by ``eps`` a step, in tiles of ``size``.

    Cells without a value are no ground: they stay NULL, and cells beside them are outlets,
    as those at the border. A cell of a hole-free grid that no path joins to an outlet does
    not exist. ``cells`` has one row for each (row, col).
    """
    ground = stored(cells.where(F.col(value).isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("z")))
    box = ground.agg(F.min("row"), F.min("col"), F.greatest(F.max("row") - F.min("row"), F.max("col") - F.min("col"))).first()
    if box[0] is None:
        return cells.withColumn("filled", F.lit(None).cast("double"))
    row0, col0, side = box[0], box[1], box[2] + 1
    near = lambda c, low: F.explode(F.sequence(F.floor((F.col(c) - low - 1) / size), F.floor((F.col(c) - low + 1) / size)))
    origin = ground.withColumns({"row0": F.lit(row0), "col0": F.lit(col0)})
    tiles = origin.withColumn("tile_row", near("row", row0)).withColumn("tile_col", near("col", col0))
    known = _rim_levels(tiles, (row0, col0, side), size, eps)

    # each rim level goes to its own tile and to the tiles around, as what may flow in there
    spread = known.select(_row(F.col("node")).alias("row"), _col(F.col("node")).alias("col"), "w")
    spread = spread.withColumn("k_row", near("row", row0)).withColumn("k_col", near("col", col0))
    schema = "tile_row long, tile_col long, row long, col long, z double, w double, rim boolean, lowered boolean"

    def inner(cells: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        if cells.empty:
            return pd.DataFrame([], columns=names)
        tile = _Tile(cells, size)
        given = dict(zip(((levels["row"].to_numpy("int64") << 32) + levels["col"].to_numpy("int64")).tolist(), levels["w"].tolist(), strict=True))
        start = dict(tile.outlets)
        for n, w in given.items():
            if n in tile.own:
                start[n] = min(w, start.get(n, w))
        for a, b in tile.crossing():
            if b in given:
                w = max(given[b] + eps, tile.z[a])
                start[a] = min(w, start.get(a, w))
        found = solve(start, tile.around, eps)
        at = np.array(list(found), dtype="int64")
        row = (at + (1 << 31)) >> 32
        rim = set(tile.rim)
        key = cells[["tile_row", "tile_col"]].iloc[0]
        return pd.DataFrame(
            {
                "tile_row": key["tile_row"], "tile_col": key["tile_col"], "row": row, "col": at - (row << 32), "z": [tile.z[n] for n in found], "w": list(found.values()),
                "rim": [n in rim for n in found], "lowered": [n in given and found[n] < given[n] - TOLERANCE for n in found],
            }
        )[names]

    base = stored(tiles.groupBy("tile_row", "tile_col").cogroup(spread.groupBy("k_row", "k_col")).applyInPandas(inner, schema))
    settled = _exchanged(base, (row0, col0), size, eps, max_rounds) if eps else base.select("row", "col", "w")
    out = settled.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("w").alias("filled"))
    return cells.join(out.hint("shuffle_hash"), (F.col("row") == F.col("_row")) & (F.col("col") == F.col("_col")), "left").drop("_row", "_col")


def _exchanged(base: DataFrame, corner: tuple[int, int], size: int, eps: float, max_rounds: int) -> DataFrame:
    """(row, col, w): levels lowered across tile borders until nothing changes.

    Tiles are put together to groups of about ``EXCHANGE`` cells a side, as rounds follow the
    groups on a path. A round sends the cells that sank at the groups' borders in the last one
    (first: all of the tiles' rims that sank below the spill graph's level) to the cells beside
    them, and solves only the groups where one of them helps. Each round writes the whole
    state, so that none reads the tables of all rounds before.
    """
    wide = size * max(1, EXCHANGE // size)
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _STEPS])
    ids, group = ["row", "col"], ["g_row", "g_col"]
    at_edge = lambda n: fold(Column.__or__, [F.pmod(F.col(c) - low, F.lit(n)).isin(0, n - 1) for c, low in zip(ids, corner, strict=True)])
    schema = "g_row long, g_col long, row long, col long, z double, w double, sunk boolean"

    def lowered(cells: pd.DataFrame, better: pd.DataFrame) -> pd.DataFrame:
        ids = ((cells["row"].to_numpy("int64") << 32) + cells["col"].to_numpy("int64")).tolist()
        z, w = (dict(zip(ids, cells[c].tolist(), strict=True)) for c in ("z", "w"))
        moves = [(a << 32) + b for a, b in _STEPS]
        heap = list(zip(better["w"].tolist(), ((better["row"].to_numpy("int64") << 32) + better["col"].to_numpy("int64")).tolist(), strict=True))
        heapq.heapify(heap)
        sunk: set[int] = set()
        while heap:
            level, n = heapq.heappop(heap)
            if level >= w[n] - TOLERANCE:
                continue
            w[n] = level
            sunk.add(n)
            for d in moves:
                there = w.get(n + d)
                if there is not None:
                    to = max(level + eps, z[n + d])
                    if to < there - TOLERANCE:
                        heapq.heappush(heap, (to, n + d))
        return cells.assign(w=[w[n] for n in ids], sunk=[n in sunk for n in ids])

    of = [F.floor((F.col(c) - low) / wide).alias(g) for c, low, g in zip(ids, corner, group, strict=True)]
    now = base.select(*of, *ids, "z", "w", (F.col("rim") & F.col("lowered")).alias("sunk"))
    for _ in range(max_rounds):
        front = now.where("sunk").select(*ids, "w")
        sent = front.withColumn("_o", F.explode(steps)).groupBy((F.col("row") + F.col("_o.a")).alias("row"), (F.col("col") + F.col("_o.b")).alias("col")).agg((F.min("w") + eps).alias("_in"))
        better = now.where(at_edge(size)).join(sent.hint("shuffle_hash"), ids).withColumn("_in", F.greatest("z", "_in")).where(F.col("_in") < F.col("w") - TOLERANCE)
        better = stored(better.select(F.col("g_row").alias("b_row"), F.col("g_col").alias("b_col"), *ids, F.col("_in").alias("w")))
        dirty = better.select("b_row", "b_col").distinct()
        groups = dirty.count()
        if not groups:
            return now.select(*ids, "w")
        dirty = F.broadcast(dirty) if groups <= BROADCAST_GROUPS else dirty.hint("shuffle_hash")
        same = (F.col("g_row") == F.col("b_row")) & (F.col("g_col") == F.col("b_col"))
        held = now.join(dirty, same, "left_semi")
        changed = held.groupBy(*group).cogroup(better.groupBy("b_row", "b_col")).applyInPandas(lowered, schema)
        rest = now.join(dirty, same, "left_anti").withColumn("sunk", F.lit(False))
        now = stored(changed.withColumn("sunk", F.col("sunk") & at_edge(wide)).unionByName(rest))
    raise RuntimeError(f"filling did not settle in {max_rounds} rounds")


def _accumulated(cells: pd.DataFrame, inflow: dict[int, float]) -> tuple[dict[int, int], dict[int, int | None], dict[int, int]]:
    """Of one tile's cells (id, down): the cell's sums with ``inflow``, each cell's exit out of the tile, and what leaves to each."""
    ids, down = cells["id"].tolist(), [None if d == OUTSIDE else d for d in cells["down"].tolist()]
    own = dict(zip(ids, down, strict=True))
    waiting = dict.fromkeys(ids, 0)
    for d in down:
        if d in waiting:
            waiting[d] += 1
    acc = {n: 1 + inflow.get(n, 0) for n in ids}
    order = [n for n in ids if not waiting[n]]
    for n in order:  # grows
        d = own[n]
        if d in waiting:
            acc[d] += acc[n]
            waiting[d] -= 1
            if not waiting[d]:
                order.append(d)
    if len(order) < len(ids):
        raise ValueError("directions run in a circle")
    leave: dict[int, int | None] = {}
    out: dict[int, int] = {}
    for n in reversed(order):
        d = own[n]
        leave[n] = leave[d] if d in own else d
        if d is not None and d not in own:
            out[d] = out.get(d, 0) + acc[n]
    return acc, leave, out


def flow_acc(directed: DataFrame, size: int = TILE, max_rounds: int = 40) -> DataFrame:
    """(row, col, acc): cells that drain through each cell, itself included; ``directed`` has ``d8``.

    In tiles of ``size``. A direction out of the grid is no target; a circle is an error.
    """
    step = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in D8]), F.col("d8") + 1)
    here = directed.select(_id(F.col("row"), F.col("col")).alias("id"), F.when(F.col("d8").isNotNull(), _id(F.col("row") + step(0), F.col("col") + step(1))).alias("_down"))
    known = here.select(F.col("id").alias("down"))
    tile = lambda c: (F.floor(_row(c) / size), F.floor(_col(c) / size))
    here = here.join(known.hint("shuffle_hash"), F.col("_down") == F.col("down"), "left").drop("_down")
    (r, c), (dr, dc) = tile(F.col("id")), tile(F.col("down"))
    # a missing target stands as OUTSIDE, so that ids stay whole numbers in pandas
    cells = stored(here.select("id", F.coalesce("down", F.lit(OUTSIDE)).alias("down"), r.alias("tile_row"), c.alias("tile_col")))
    # cells that another tile flows into
    entries = cells.where(F.col("down") != OUTSIDE).where((dr != F.col("tile_row")) | (dc != F.col("tile_col"))).select(F.col("down").alias("entry")).distinct()
    at = entries.select("entry", tile(F.col("entry"))[0].alias("e_row"), tile(F.col("entry"))[1].alias("e_col"))

    def leaving(cells: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if cells.empty:
            return pd.DataFrame([], columns=["cell", "down", "acc"])
        _, leave, out = _accumulated(cells, {})
        rows = [(e, leave[e], 0) for e in entries["entry"].tolist()] + [(d, None, n) for d, n in out.items()]
        return pd.DataFrame({"cell": pd.array([x[0] for x in rows], dtype="Int64"), "down": pd.array([x[1] for x in rows], dtype="Int64"), "acc": pd.array([x[2] for x in rows], dtype="Int64")})

    outlets = stored(cells.groupBy("tile_row", "tile_col").cogroup(at.groupBy("e_row", "e_col")).applyInPandas(leaving, "cell long, down long, acc long"))
    forest = stored(outlets.groupBy("cell").agg(F.max("down").alias("down"), F.sum("acc").alias("acc")))
    inflow = _doubled(forest, max_rounds).select("cell", "acc", tile(F.col("cell"))[0].alias("e_row"), tile(F.col("cell"))[1].alias("e_col"))

    def whole(cells: pd.DataFrame, inflow: pd.DataFrame) -> pd.DataFrame:
        if cells.empty:
            return pd.DataFrame([], columns=["id", "acc"])
        acc, _, _ = _accumulated(cells, dict(zip(inflow["cell"].tolist(), inflow["acc"].tolist(), strict=True)))
        return pd.DataFrame({"id": list(acc), "acc": list(acc.values())})

    done = cells.groupBy("tile_row", "tile_col").cogroup(inflow.groupBy("e_row", "e_col")).applyInPandas(whole, "id long, acc long")
    return done.select(_row(F.col("id")).cast("int").alias("row"), _col(F.col("id")).cast("int").alias("col"), "acc")
