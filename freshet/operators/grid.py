"""Neighbourhood filters, hydrology and resampling on cell tables (row, col, layers).

Filters are separable windows over rows, then columns. Iterative jobs (filling, flow
accumulation) go in rounds: they join only cells that have further to go
or that change, and write each round to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import geo
from freshet.session import stored

#: Rounds whose results are put together, so that no round reads many tables.
COMPACT_ROUNDS = 8

D8 = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def _line(keys: Sequence[str], across: str, along: str, r: int):
    return Window.partitionBy(*keys, across).orderBy(along).rangeBetween(-r, r)


def _dense(cells: DataFrame, keys: Sequence[str], r: int) -> DataFrame:
    """``cells`` with a row for each hole in a row's span, ``r`` wider on both sides (_real is NULL there).

    A second pass along columns needs the first pass's result at holes too.
    """
    ids = [*keys, "row", "col"]
    spans = cells.groupBy(*keys, "row").agg((F.min("col") - r).alias("_a"), (F.max("col") + r).alias("_b"))
    places = spans.select(*keys, "row", F.explode(F.sequence("_a", "_b")).alias("col"))
    return places.join(cells.withColumn("_real", F.lit(True)).hint("shuffle_hash"), ids, "left")


def window_min(cells: DataFrame, value: str, r: int, keys: Sequence[str] = ()) -> DataFrame:
    """``cells`` with the least value of the square of radius ``r`` around each cell."""
    by_row = _dense(cells, keys, r).withColumn("_m", F.min(value).over(_line(keys, "row", "col", r)))
    return by_row.withColumn("window_min", F.min("_m").over(_line(keys, "col", "row", r))).where("_real").drop("_m", "_real")


def rel_height(cells: DataFrame, value: str, r: int, keys: Sequence[str] = ()) -> DataFrame:
    return window_min(cells, value, r, keys).withColumn("rel_height", F.col(value) - F.col("window_min")).drop("window_min")


def window_mean(cells: DataFrame, value: str, r: int, keys: Sequence[str] = ()) -> DataFrame:
    """``cells`` with the mean of the square around each cell; the window shrinks at edges."""
    by_row = _dense(cells, keys, r).withColumn("_s", F.sum(value).over(_line(keys, "row", "col", r))).withColumn("_n", F.count(value).over(_line(keys, "row", "col", r)))
    col = _line(keys, "col", "row", r)
    return by_row.withColumn("window_mean", F.sum("_s").over(col) / F.sum("_n").over(col)).where("_real").drop("_s", "_n", "_real")


def tpi(cells: DataFrame, value: str, r: int) -> DataFrame:
    """Height above the mean of the neighbourhood; missing heights (sea) count as 0."""
    filled = cells.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
    return window_mean(filled, value, r).withColumn("tpi", F.col(value) - F.col("window_mean")).drop("window_mean")


def _at(c: str, across: str, along: str, k: int) -> Column:
    """Value of the cell ``k`` further along, if it is there (grids may have holes)."""
    w = Window.partitionBy(across).orderBy(along)
    shifted, place = (F.lead(c).over(w), F.lead(along).over(w)) if k > 0 else (F.lag(c).over(w), F.lag(along).over(w))
    return F.when(place == F.col(along) + k, shifted)


def gradients(cells: DataFrame, value: str, cell_m: float) -> DataFrame:
    """``cells`` with _gx and _gy: central differences, one-sided at edges, 0 where alone."""
    out = cells.withColumns({"_e": _at(value, "row", "col", 1), "_w": _at(value, "row", "col", -1), "_s": _at(value, "col", "row", 1), "_n": _at(value, "col", "row", -1)})
    z = F.col(value)
    diff = lambda a, b: (F.coalesce(a, z) - F.coalesce(b, z)) / (F.when(a.isNotNull() & b.isNotNull(), 2.0).otherwise(1.0) * cell_m)
    return out.withColumns({"_gx": diff(F.col("_e"), F.col("_w")), "_gy": diff(F.col("_s"), F.col("_n"))}).drop("_e", "_w", "_s", "_n")


def slope(cells: DataFrame, value: str, cell_m: float) -> DataFrame:
    g = gradients(cells.withColumn(value, F.coalesce(F.col(value), F.lit(0.0))), value, cell_m)
    return g.withColumn("slope", F.degrees(F.atan(F.hypot("_gx", "_gy")))).drop("_gx", "_gy")


def curvature(cells: DataFrame, value: str, cell_m: float) -> DataFrame:
    """Five-point Laplacian; 0 where a neighbour is missing."""
    around = [_at(value, "row", "col", 1), _at(value, "row", "col", -1), _at(value, "col", "row", 1), _at(value, "col", "row", -1)]
    names = ["_e", "_w", "_s", "_n"]
    out = cells.withColumns(dict(zip(names, around, strict=True)))
    lap = (sum((F.col(n) for n in names[1:]), F.col("_e")) - 4 * F.col(value)) / cell_m**2
    return out.withColumn("curvature", F.coalesce(lap, F.lit(0.0))).drop(*names)


def local_min(df: DataFrame, x: str, y: str, value: str, bin_size: float) -> DataFrame:
    """``df`` with the least value of the 3 x 3 coarse bins around each row, and the height above it."""
    binned = df.withColumns({"_bx": F.floor(F.col(x) / bin_size), "_by": F.floor(F.col(y) / bin_size)})
    least = binned.groupBy("_bx", "_by").agg(F.min(value).alias("_m"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    around = least.withColumn("_o", F.explode(steps)).groupBy((F.col("_bx") + F.col("_o.a")).alias("_bx"), (F.col("_by") + F.col("_o.b")).alias("_by")).agg(F.min("_m").alias("local_min"))
    return binned.join(around.hint("shuffle_hash"), ["_bx", "_by"], "left").withColumn("rel_local", F.col(value) - F.col("local_min")).drop("_bx", "_by")


def d8(cells: DataFrame, value: str, cell_m: float = 1.0) -> DataFrame:
    """``cells`` with the direction (0 to 7, clockwise from north) of the steepest drop; NULL if none.

    The first maximum wins.
    """
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(D8)])
    out = cells.select("row", "col", F.col(value).alias("_z")).withColumn("_o", F.explode(steps))
    lower = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_z2"))
    met = out.join(lower.hint("shuffle_hash"), (F.col("row") + F.col("_o.a") == F.col("_r")) & (F.col("col") + F.col("_o.b") == F.col("_c")))
    length = F.when((F.col("_o.a") != 0) & (F.col("_o.b") != 0), math.sqrt(2)).otherwise(1.0) * cell_m
    drop = (F.col("_z") - F.col("_z2")) / length
    best = met.withColumn("_d", drop).where("_d > 0").groupBy("row", "col").agg(F.max_by("_o.k", F.struct("_d", -F.col("_o.k"))).alias("d8"), F.max("_d").alias("drop"))
    return cells.join(best.hint("shuffle_hash"), ["row", "col"], "left")


def dist_to_seed(cells: DataFrame, seed: Column, cap: int, cell_m: float) -> DataFrame:
    """``cells`` with metres to the nearest seed cell, exact up to ``cap`` cells, else NULL.

    Column pass: rows to the nearest seed in the same column, by running last/first seeds.
    Row pass: the least hypotenuse over the columns within ``cap``.
    """
    w = Window.partitionBy("col").orderBy("row")
    mark = F.when(F.col("_real") & seed, F.col("row"))
    up = F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(mark, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    col_pass = _dense(cells, (), cap).withColumn("_v", F.least(F.col("row") - up, down - F.col("row")))
    around = Window.partitionBy("row").orderBy("col").rangeBetween(-cap, cap)
    near = F.collect_list(F.when(F.col("_v") <= cap, F.struct(F.col("col").alias("c"), F.col("_v").alias("v")))).over(around)
    squared = F.array_min(F.transform(near, lambda s: F.pow(s["c"] - F.col("col"), F.lit(2)) + F.pow(s["v"], F.lit(2))))
    return col_pass.withColumn("_d", F.sqrt(squared)).withColumn("dist_m", F.when(F.col("_d") <= cap, F.col("_d") * cell_m)).where("_real").drop("_v", "_d", "_real")


def resample(cells: DataFrame, factor: int, cols: Sequence[str]) -> DataFrame:
    """Each cell as ``factor`` x ``factor`` finer cells with the same values (integer division back)."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = cells.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return out.select((F.col("row") * factor + F.col("_i")).alias("row"), (F.col("col") * factor + F.col("_j")).alias("col"), *cols)


def reproject(cells: DataFrame, source: geo.Grid, target: geo.Grid, tm: geo.Tm, cols: Sequence[str]) -> DataFrame:
    """Nearest-neighbour resampling to a Mercator grid: every target cell finds its source cell."""
    keys = cells.sparkSession.range(target.rows * target.cols).select(F.floor(F.col("id") / target.cols).alias("row"), (F.col("id") % target.cols).alias("col"))
    ll = keys.withColumn("_m", geo.centre_of(F.col("row"), F.col("col"), target)).withColumn("_ll", geo.from_3857(F.col("_m.x"), F.col("_m.y")))
    at = ll.withColumn("_t", geo.to_tm(F.col("_ll.lon"), F.col("_ll.lat"), tm)).withColumn("_c", geo.cell_of(F.col("_t.x"), F.col("_t.y"), source)).where("_c is not null")
    src = cells.select(F.col("row").alias("_r"), F.col("col").alias("_k"), *cols)
    return at.select("row", "col", F.col("_c.row").alias("_sr"), F.col("_c.col").alias("_sc")).join(src.hint("shuffle_hash"), (F.col("_sr") == F.col("_r")) & (F.col("_sc") == F.col("_k"))).select("row", "col", *cols)


def _around(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every cell's values sent to its eight neighbours (_o.k: the step taken)."""
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(D8)])
    sent = df.withColumn("_o", F.explode(steps))
    return sent.withColumns({"row": F.col("row") + F.col("_o.a"), "col": F.col("col") + F.col("_o.b")})


def fill(cells: DataFrame, value: str, eps: float = 0.0, keys: Sequence[str] = (), max_rounds: int = 10_000) -> DataFrame:
    """``cells`` with ``filled``: depressions raised so that every cell drains, by ``eps`` a step.

    From the border (cells with a missing neighbour) inwards, w = max(z, least neighbour's
    w + eps), until nothing changes. A round sends on only the cells that sank in the last
    one, and writes only those that sink in it; a cell's level is its least one written. It
    reads all cells, and rounds grow with the grid's side: this form is for many small grids
    by ``keys``; ``hydrology.fill`` fills one large grid in tiles.
    """
    ids = [*keys, "row", "col"]
    ground = stored(cells.where(F.col(value).isNotNull()).select(*ids, F.col(value).cast("double").alias("_z")))
    count = _around(ground.select(*ids), keys).groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"))
    front = stored(ground.join(count.hint("shuffle_hash"), ids, "left").where(F.coalesce("_n", F.lit(0)) < 8).select(*ids, F.col("_z").alias("_w")))
    base, later = front, []
    for _ in range(max_rounds):
        known = reduce(DataFrame.unionByName, later, base)
        least = _around(front, keys).groupBy(*ids).agg((F.min("_w") + eps).alias("_l"))
        reach = least.join(ground.hint("shuffle_hash"), ids).select(*ids, F.greatest("_z", "_l").alias("_w"))
        held = known.join(least.select(*ids).hint("shuffle_hash"), ids, "left_semi").groupBy(*ids).agg(F.min("_w").alias("_old"))
        sunk = reach.join(held.hint("shuffle_hash"), ids, "left").where(F.col("_old").isNull() | (F.col("_w") < F.col("_old")))
        front = stored(sunk.select(*ids, "_w"))
        if front.limit(1).count() == 0:
            return cells.join(known.groupBy(*ids).agg(F.min("_w").alias("filled")).hint("shuffle_hash"), ids, "left")
        later.append(front)
        if len(later) == COMPACT_ROUNDS:
            base, later = stored(reduce(DataFrame.unionByName, later, base).groupBy(*ids).agg(F.min("_w").alias("_w"))), []
    raise RuntimeError(f"filling did not settle in {max_rounds} rounds")


def flow_acc(directed: DataFrame, keys: Sequence[str] = (), max_rounds: int = 40) -> DataFrame:
    """(keys, row, col, acc): cells that drain through each cell, itself included.

    ``directed`` has ``d8``. By doubling: before round i, acc counts the cells at most
    2^i - 1 steps above and each cell knows the one 2^i steps below, to which it adds its
    acc. A cell whose target is beyond the end has counted in; after as many rounds as the
    longest path's length has binary digits no targets are left. More than ``max_rounds``
    is an error (a cycle). ``hydrology.flow_acc`` doubles over tiles' outlets only.
    """
    ids = [*keys, "row", "col"]
    step = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in D8]), F.col("d8") + 1)
    cell = F.struct(*ids)
    here = stored(directed.select(cell.alias("cell"), "d8", *ids))
    below = F.when(F.col("d8").isNotNull(), F.struct(*keys, (F.col("row") + step(0)).cast("int").alias("row"), (F.col("col") + step(1)).cast("int").alias("col")))
    now = here.select(F.struct(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).alias("cell"), below.alias("down"), F.lit(1).cast("long").alias("acc"))
    known = now.select(F.col("cell").alias("_c"))
    # a direction out of the grid is no target
    now = stored(now.join(known.hint("shuffle_hash"), F.col("down") == F.col("_c"), "left").select("cell", F.col("_c").alias("down"), "acc"))
    return _doubled(now, max_rounds).select("cell.*", "acc")


def _doubled(now: DataFrame, max_rounds: int) -> DataFrame:
    """(cell, down, acc) with the acc of all cells above each cell added to its own."""
    for _ in range(max_rounds):
        if now.where("down is not null").limit(1).count() == 0:
            return now
        given = now.where("down is not null").groupBy(F.col("down").alias("_to")).agg(F.sum("acc").alias("_more"))
        above = now.select(F.col("cell").alias("_cell"), F.col("down").alias("_down"))
        added = now.join(given.hint("shuffle_hash"), F.col("cell") == F.col("_to"), "left").withColumn("acc", F.col("acc") + F.coalesce("_more", F.lit(0)))
        now = stored(added.join(above.hint("shuffle_hash"), F.col("down") == F.col("_cell"), "left").select("cell", F.col("_down").alias("down"), "acc"))
    raise RuntimeError(f"flow did not settle in {max_rounds} rounds")


def tiled(cells: DataFrame, size: int, halo: int, job: Callable[[DataFrame, Sequence[str]], DataFrame]) -> DataFrame:
    """``job`` run on all tiles at once, each with a halo; only the tiles' cores are kept.

    ``job(cells, keys)`` gets the cells keyed by (tile_row, tile_col).
    """
    side = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - halo) / size), F.lit(0)), F.floor((F.col(c) + halo) / size))
    spread = cells.withColumn("tile_row", F.explode(side("row"))).withColumn("tile_col", F.explode(side("col")))
    done = job(spread, ["tile_row", "tile_col"])
    core = (F.floor(F.col("row") / size) == F.col("tile_row")) & (F.floor(F.col("col") / size) == F.col("tile_col"))
    return done.where(core).drop("tile_row", "tile_col")


def pump_index(cells: DataFrame, pumps: DataFrame, reach: float) -> DataFrame:
    """``cells`` (id, x, y) with capacity of the nearest pump that has one / max(km, 0.5)."""
    from freshet.operators.spatial import nearest

    able = pumps.where("capacity > 0")
    near = nearest(cells, able, reach)
    joined = near.join(able.select(F.col("id").alias("_p"), "capacity").hint("merge"), F.col("q_id") == F.col("_p"), "left").drop("_p")
    return joined.withColumn("pump_index", F.coalesce(F.col("capacity") / F.greatest(F.col("dist"), F.lit(0.5)), F.lit(0.0)))
