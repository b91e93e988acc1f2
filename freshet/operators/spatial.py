"""Spatial joins as bucketed equi-joins.

Both sides are keyed by square buckets; one side is exploded over the buckets its reach
touches, the equi-join on the bucket finds candidates, and the exact test follows. No
nested loop, no broadcast of a side whose size is unknown.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import geo
from freshet.session import stored

#: Blocks of squares inside a zone have up to 2^MOST_LEVELS squares a row.
MOST_LEVELS = 40
#: Points of a square that is not split, and how often a square may be split.
LEAF_POINTS = 32
MOST_SPLITS = 24
#: Places of a square that is not split among segments, and how often the squares of zones are halved.
SQUARE_PLACES = 8
ASSIGN_SPLITS, SPAN_SPLITS, WITHIN_SPLITS = 3, 5, 1
#: Edges whose squares are one task's work.
TASK_EDGES = 10_000


def bucketed(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """``df`` with the bucket (_bx, _by) of a point."""
    return df.withColumns({"_bx": F.floor(F.col(x) / size), "_by": F.floor(F.col(y) / size)})


def spread(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """``df`` with a row for each bucket that the box (x0, y0, x1, y1) touches."""
    side = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return df.withColumn("_bx", F.explode(side(x0, x1))).withColumn("_by", F.explode(side(y0, y1)))


def neighbours(df: DataFrame, x: str, y: str, reach: float, size: float) -> DataFrame:
    return spread(df, F.col(x) - reach, F.col(y) - reach, F.col(x) + reach, F.col(y) + reach, size)


def pairs_within(p: DataFrame, q: DataFrame, reach: float, keys: Sequence[str] = (), px: str = "x", py: str = "y") -> DataFrame:
    """Pairs of ``p`` (id, x, y, keys) and ``q`` (id, x, y, keys) at most ``reach`` apart, with dist.

    ``q``'s columns come back with the prefix q_. ``keys`` must be equal on both sides.
    """
    other = q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns])
    other = neighbours(other, f"q_{px}", f"q_{py}", reach, reach)
    left = bucketed(p, px, py, reach)
    on = (left["_bx"] == other["_bx"]) & (left["_by"] == other["_by"])
    for k in keys:
        on = on & (left[k] == other[f"q_{k}"])
    met = left.join(other.hint("shuffle_hash"), on).drop("_bx", "_by")
    return met.withColumn("dist", F.hypot(F.col(f"q_{px}") - F.col(px), F.col(f"q_{py}") - F.col(py))).where(F.col("dist") <= reach)


def _leaves(q: DataFrame, keys: Sequence[str], side: float) -> tuple[list[DataFrame], DataFrame]:
    """Occupied squares (keys, _cx, _cy, _n) of each level, and ``q`` with the square it is kept in.

    Level k has squares of side / 2^k. A square of over ``LEAF_POINTS`` points is split in four,
    as long as that helps; a point is kept in its first square that is not split.
    """
    levels, kept, rest = [], [], q
    while True:
        k = len(levels)
        at = rest.withColumns({"_cx": F.floor(F.col("x") / (side / 2**k)), "_cy": F.floor(F.col("y") / (side / 2**k))})
        counts = stored(at.groupBy(*keys, "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n")))
        levels.append(counts)
        full = counts.where(F.col("_n") > LEAF_POINTS)
        if k == MOST_SPLITS or full.limit(1).count() == 0:
            kept.append(at.withColumn("_level", F.lit(k)))
            return levels, reduce(DataFrame.unionByName, kept)
        on = [*keys, "_cx", "_cy"]
        split = at.join(full.select(*on).hint("shuffle_hash"), on, "left_semi")
        kept.append(at.join(full.select(*on).hint("shuffle_hash"), on, "left_anti").withColumn("_level", F.lit(k)))
        rest = stored(split.drop("_cx", "_cy"))


def _candidates(p: DataFrame, levels: list[DataFrame], keys: Sequence[str], side: float, reach: float, k: int) -> DataFrame:
    """(id, x, y, keys, _level, _cx, _cy): the unsplit squares that can hold one of the ``k`` nearest of each ``p``.

    Down the levels: a square is left out if it is beyond the reach, or beyond the whole of
    other squares that hold ``k`` points.
    """
    on = [*keys, "_cx", "_cy"]
    around = neighbours(p, "x", "y", reach, side).withColumnsRenamed({"_bx": "_cx", "_by": "_cy"})
    met = around.join(levels[0].hint("merge"), on).withColumn("_level", F.lit(0))
    for depth, counts in enumerate(levels):
        width = F.lit(side) / F.pow(F.lit(2.0), F.col("_level"))
        gap = lambda v, c, w=width: F.greatest(F.col(c) * w - F.col(v), F.col(v) - (F.col(c) + 1) * w, F.lit(0.0))
        far = lambda v, c, w=width: F.greatest(F.abs(F.col(c) * w - F.col(v)), F.abs((F.col(c) + 1) * w - F.col(v)))
        if depth:
            split = met.where((F.col("_n") > LEAF_POINTS) & (F.col("_level") == depth - 1))
            steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
            parts = split.withColumn("_o", F.explode(steps)).withColumns({"_cx": F.col("_cx") * 2 + F.col("_o.a"), "_cy": F.col("_cy") * 2 + F.col("_o.b"), "_level": F.lit(depth)})
            parts = parts.drop("_o", "_n").join(counts.hint("merge"), on)
            met = met.where((F.col("_n") <= LEAF_POINTS) | (F.col("_level") < depth - 1)).unionByName(parts)
        told = met.withColumns({"_least": F.hypot(gap("x", "_cx"), gap("y", "_cy")), "_most": F.hypot(far("x", "_cx"), far("y", "_cy"))})
        mine = Window.partitionBy("id", *keys)
        upto = mine.orderBy("_most").rangeBetween(Window.unboundedPreceding, 0)
        told = told.withColumn("_held", F.sum("_n").over(upto)).withColumn("_bound", F.min(F.when(F.col("_held") >= k, F.col("_most"))).over(mine))
        near = F.col("_least") <= F.least(F.coalesce(F.col("_bound"), F.lit(float(reach))), F.lit(float(reach))) * (1 + 1e-9)
        met = stored(told.where(near).drop("_least", "_most", "_held", "_bound"))
    return met.drop("_n")


def nearest_pairs(p: DataFrame, q: DataFrame, reach: float, k: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs (id, keys, q_id, dist) at most ``reach`` apart, among them the ``k`` nearest ``q`` of each ``p``.

    Ids of ``p`` are different for equal keys. Where squares of the reach are full of points,
    they are split by counts (``_leaves``), and each ``p`` goes down to the few that can hold its
    nearest: what it meets does not grow with the number of points in a square. Of points at
    one place only the ``k`` smallest ids are met.
    """
    place = Window.partitionBy(*keys, "x", "y").orderBy("id")
    few = stored(q.select("id", "x", "y", *keys).withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= k).drop("_k"))
    levels, kept = _leaves(few, keys, reach)
    squares = _candidates(p.select("id", "x", "y", *keys), levels, keys, reach, reach, k)
    points = kept.select(F.col("id").alias("q_id"), F.col("x").alias("_qx"), F.col("y").alias("_qy"), *keys, "_level", "_cx", "_cy")
    met = squares.join(points.hint("merge"), [*keys, "_level", "_cx", "_cy"])
    return met.withColumn("dist", F.hypot(F.col("_qx") - F.col("x"), F.col("_qy") - F.col("y"))).where(F.col("dist") <= reach).select("id", *keys, "q_id", "dist")


def nearest(p: DataFrame, q: DataFrame, max_dist: float, ident: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """The nearest ``q`` of each ``p`` within ``max_dist`` (q_id, dist), else NULLs. Ties by q's id."""
    named = lambda df: df.select(F.col(ident).alias("id"), "x", "y", *keys)
    best = nearest_pairs(named(p).distinct(), named(q), max_dist, 1, keys).groupBy("id", *keys).agg(F.min(F.struct("dist", "q_id")).alias("_best"))
    best = best.select(F.col("id").alias("_id"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_best.q_id").alias(f"q_{ident}"), F.col("_best.dist").alias("dist"))
    on = F.col(ident) == F.col("_id")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return p.join(best.hint("shuffle_hash"), on, "left").drop("_id", *[f"_k_{k}" for k in keys])


def nearest_any(p: DataFrame, q: DataFrame, reach: float, grow: float = 4.0, fine: int = 8) -> DataFrame:
    """The nearest ``q`` of each ``p`` at any distance: (id, q_id, dist). Ties by q's id.

    Reach by reach on the rows still unmatched, until none is left or the reach holds both
    tables; a hit is final, as it lies within the searched reach. In a round a row first
    meets the occupied squares (``fine`` to a reach) around it. A square all of which is
    farther than the whole of another can't hold the nearest, so only the points of the
    few squares left are met.
    """
    out, rest = None, stored(p.select("id", "x", "y"))
    box = rest.select("x", "y").unionByName(q.select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    widest = (box[0] or 0.0) + (box[1] or 0.0) + reach
    while True:
        side = reach / fine
        points = q.select(F.col("id").alias("q_id"), F.col("x").alias("_qx"), F.col("y").alias("_qy"), F.floor(F.col("x") / side).alias("_sx"), F.floor(F.col("y") / side).alias("_sy"))
        squares = points.select("_sx", "_sy").distinct().select("_sx", "_sy", ((F.col("_sx") + 0.5) * side).alias("x"), ((F.col("_sy") + 0.5) * side).alias("y"))
        around = neighbours(squares, "x", "y", reach + side, reach).withColumnsRenamed({"x": "_mx", "y": "_my"})
        met = bucketed(rest, "x", "y", reach).join(around.hint("shuffle_hash"), ["_bx", "_by"])
        gap = lambda v, m: F.greatest(F.abs(F.col(v) - F.col(m)) - side / 2, F.lit(0.0))
        far = lambda v, m: F.abs(F.col(v) - F.col(m)) + side / 2
        met = met.select("id", "x", "y", "_sx", "_sy", F.hypot(gap("x", "_mx"), gap("y", "_my")).alias("_least"), F.hypot(far("x", "_mx"), far("y", "_my")).alias("_most"))
        bound = met.withColumn("_bound", F.min("_most").over(Window.partitionBy("id"))).where(F.col("_least") <= F.least(F.col("_bound") * (1 + 1e-9), F.lit(float(reach))))
        pairs = bound.join(points.hint("shuffle_hash"), ["_sx", "_sy"]).withColumn("dist", F.hypot(F.col("_qx") - F.col("x"), F.col("_qy") - F.col("y"))).where(F.col("dist") <= reach)
        hit = stored(pairs.groupBy("id").agg(F.min(F.struct("dist", "q_id")).alias("_b")).select("id", "_b.q_id", "_b.dist"))
        out = hit if out is None else out.unionByName(hit)
        rest = stored(rest.join(hit.hint("shuffle_hash"), "id", "left_anti"))
        if reach >= widest or rest.limit(1).count() == 0:
            return out
        reach *= grow


def within_topk(p: DataFrame, q: DataFrame, reach: float, k: int) -> DataFrame:
    """The ``k`` nearest ``q`` of each ``p`` within ``reach``: (id, q_id, dist, rank)."""
    pairs = nearest_pairs(p.select("id", "x", "y"), q, reach, k)
    order = Window.partitionBy("id").orderBy("dist", "q_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "q_id", "dist", "rank")


def _crossing(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Does a ray from (x, y) to the right cross the edge (x1, y1)-(x2, y2)? Half-open in y."""
    spans = (y1 > y) != (y2 > y)
    at = (x2 - x1) * (y - y1) / F.when(y2 != y1, y2 - y1) + x1
    return F.when(spans & (x < at), 1).otherwise(0)


def _dyadic(low: Column, high: Column, most: int = MOST_LEVELS) -> Column:
    """[low, high], under 2^most long, as array<struct<level, block>>: at most two blocks of 2^level squares for each level."""
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    piece = lambda k, c, when: F.when(when, F.array(F.struct(k.cast("int").alias("level"), c.cast("bigint").alias("block")))).otherwise(none)

    def step(acc: Column, k: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        first = (lo <= hi) & (lo.bitwiseAND(F.lit(1)) == 1)
        after = F.when(first, lo + 1).otherwise(lo)
        last = (after <= hi) & (hi.bitwiseAND(F.lit(1)) == 0)
        until = F.when(last, hi - 1).otherwise(hi)
        left = after <= until  # else an empty range, which stays empty
        return F.struct(F.when(left, F.shiftright(after, 1)).otherwise(1).alias("lo"), F.when(left, F.shiftright(until, 1)).otherwise(0).alias("hi"), F.concat(acc["out"], piece(k, lo, first), piece(k, hi, last)).alias("out"))

    start = F.struct(low.cast("bigint").alias("lo"), high.cast("bigint").alias("hi"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(most)), start, step)["out"]


def covering(edges: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Squares of zones: (zone, ord, _bx, _by, _beyond, _edges) of a border, and (zone, ord, _by, level, block) of the inside.

    A border square has the edges that touch it and how many edges a ray to the right from the
    middle of its right side crosses. Runs of squares between two border squares of a row hold
    no edge, so one of their points tells for all; a run inside comes as blocks of 2^level squares.
    """
    bands = edges.withColumn("_by", F.explode(F.sequence(F.floor(F.least("y1", "y2") / size - 1e-9), F.floor(F.greatest("y1", "y2") / size + 1e-9))))
    low, high, middle = F.col("_by") * size, (F.col("_by") + 1) * size, (F.col("_by") + 0.5) * size
    # where the edge is inside its row of squares; a level edge over its whole length
    at = lambda y, level: F.coalesce(F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)), level)
    upper, lower = F.least(high, F.greatest("y1", "y2")), F.greatest(low, F.least("y1", "y2"))
    a, b = at(lower, F.col("x1")), at(upper, F.col("x2"))
    ends = {"_from": F.floor(F.least(a, b) / size - 1e-9), "_to": F.floor(F.greatest(a, b) / size + 1e-9)}
    spans = (F.col("y1") > middle) != (F.col("y2") > middle)
    cut = bands.withColumns(ends | {"_at": F.when(spans, at(middle, F.col("x1")))}).select("zone", "ord", "_by", "_from", "_to", "_at", "x1", "y1", "x2", "y2")
    cut = stored(cut)
    rows = cut.groupBy("zone", "ord", "_by").agg(F.collect_list("_at").alias("_ats")).withColumnsRenamed({"zone": "_zone", "ord": "_ord", "_by": "_row"})
    squares = cut.withColumn("_bx", F.explode(F.sequence("_from", "_to"))).groupBy("zone", "ord", "_by", "_bx").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    same = (F.col("zone") == F.col("_zone")) & F.col("ord").eqNullSafe(F.col("_ord")) & (F.col("_by") == F.col("_row"))
    squares = squares.withColumn("_next", F.lead("_bx").over(Window.partitionBy("zone", "ord", "_by").orderBy("_bx"))).join(rows.hint("shuffle_hash"), same)
    right = lambda bx: F.size(F.filter("_ats", lambda x: x > (bx + 1) * size))
    squares = squares.withColumns({"_beyond": right(F.col("_bx")), "_gap": (F.col("_next") > F.col("_bx") + 1) & (right(F.col("_bx") + 0.5) % 2 == 1)})
    squares = stored(squares.select("zone", "ord", "_by", "_bx", "_next", "_edges", "_beyond", "_gap"))
    runs = squares.where("_gap").select("zone", "ord", "_by", F.explode(_dyadic(F.col("_bx") + 1, F.col("_next") - 1)).alias("_p"))
    return squares.select("zone", "ord", "_bx", "_by", "_beyond", "_edges"), stored(runs.select("zone", "ord", "_by", "_p.level", "_p.block"))


def _fine(p: DataFrame, size: float, most: int) -> float:
    """``size``, halved up to ``most`` times while its squares hold over ``SQUARE_PLACES`` points on average."""
    squares = lambda k: F.approx_count_distinct(F.struct(F.floor(F.col("x") / (size / 2**k)), F.floor(F.col("y") / (size / 2**k))))
    row = p.agg(F.count(F.lit(1)), *[squares(k) for k in range(most + 1)]).first()
    return size / 2 ** next((k for k in range(most) if row[0] <= SQUARE_PLACES * row[k + 1]), most)


def _at_levels(here: DataFrame, inner: DataFrame) -> DataFrame:
    """Squares ``here`` (_bx, _by) with each block of ``inner`` (_by, level, block, ...) that holds them."""
    levels = sorted(r["level"] for r in inner.select("level").distinct().collect())  # at most MOST_LEVELS + 1
    at = here.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    blocks = inner.withColumnsRenamed({"_by": "_row", "level": "_level"})
    shifted = F.expr("shiftright(_bx, level)")
    return at.join(blocks.hint("shuffle_hash"), (F.col("_by") == F.col("_row")) & (F.col("level") == F.col("_level")) & (shifted == F.col("block")))


def _held_at_border(points: DataFrame, border: DataFrame, size: float) -> DataFrame:
    """Points with each zone that holds them, of those whose border passes through their square."""
    side, middle = (F.col("_bx") + 1) * size, (F.col("_by") + 0.5) * size
    up = lambda e: F.when((e["x1"] > side) != (e["x2"] > side), e["y1"] + (e["y2"] - e["y1"]) * (side - e["x1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0)))
    passed = lambda e: F.when((up(e) > F.col("y")) != (up(e) > middle), 1).otherwise(0)
    beside = lambda e: _crossing(F.col("x"), F.col("y"), e["x1"], e["y1"], e["x2"], e["y2"]) - _crossing(side, F.col("y"), e["x1"], e["y1"], e["x2"], e["y2"])
    crossed = F.aggregate("_edges", F.lit(0), lambda n, e: n + passed(e) + beside(e))
    return points.join(border.hint("shuffle_hash"), ["_bx", "_by"]).where(F.pmod(F.col("_beyond") + crossed, F.lit(2)) == 1)


def points_in_polygons(p: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """(id, zone, ord) for each point strictly inside a zone of the edge table (holes by parity).

    Zones are covered by squares (``covering``). A square of points inside a zone is found by
    one lookup for each level of blocks, whatever a zone's width, and answers at once. A point
    in a border square counts the square's own edges: to the right side of the square on its
    own height, then up or down that side to the middle, from where the count is known.
    """
    border, inner = covering(edges, size)
    points = bucketed(p.select("id", "x", "y"), "x", "y", size)
    here = stored(points.select("_bx", "_by").distinct())
    whole = _at_levels(here, inner)
    inside = points.join(whole.select("_bx", "_by", "zone", "ord").hint("shuffle_hash"), ["_bx", "_by"]).select("id", "zone", "ord")
    return inside.unionByName(_held_at_border(points, border, size).select("id", "zone", "ord"))


def last_inside(p: DataFrame, edges: DataFrame, size: float, first_found: bool = False) -> DataFrame:
    """(id, zone, ord): zones that hold a point, among them the last in order (``first_found``: any) of each held point.

    Of the zones that hold a whole square only the last one counts, and of the zones whose
    border passes through it those after that one (``first_found``: none), so that points meet
    few zones however many lie over each other. ``size`` is halved where squares are full.
    """
    size = _fine(p, size, ASSIGN_SPLITS)
    border, inner = covering(edges, size)
    points = bucketed(p.select("id", "x", "y"), "x", "y", size)
    here = stored(points.select("_bx", "_by").distinct())
    last = inner.groupBy("_by", "level", "block").agg(F.max(F.struct("ord", "zone")).alias("_last"))
    tops = stored(_at_levels(here, last).groupBy("_bx", "_by").agg(F.max("_last").alias("_last")))
    inside = points.join(tops.hint("shuffle_hash"), ["_bx", "_by"]).select("id", "_last.zone", "_last.ord")
    least = tops.withColumnsRenamed({"_bx": "_tx", "_by": "_ty"})
    later = border.join(least.hint("shuffle_hash"), (F.col("_bx") == F.col("_tx")) & (F.col("_by") == F.col("_ty")), "left")
    later = later.where(F.col("_last").isNull() if first_found else F.col("_last").isNull() | (F.col("ord") >= F.col("_last.ord"))).drop("_tx", "_ty", "_last")
    return inside.unionByName(_held_at_border(points, later, size).select("id", "zone", "ord"))


def inside_any(p: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """(id) of the points strictly inside a zone, each once."""
    return last_inside(p, edges.withColumn("ord", F.coalesce("ord", F.lit(-1))), size, first_found=True).select("id").distinct()


def inside_spans(p: DataFrame, edges: DataFrame, values: DataFrame, size: float) -> DataFrame:
    """(id, n, least, most): number and range of the ``values`` (zone, value) of the zones that hold each point, of those held.

    As ``points_in_polygons``, but zones that hold a whole square are summed up by square.
    """
    size = _fine(p, size, SPAN_SPLITS)
    border, inner = covering(edges, size)
    of_zone = values.groupBy(F.col("zone").alias("_of")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    total = [F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")]
    told = lambda df: df.join(of_zone.hint("shuffle_hash"), F.col("zone") == F.col("_of")).drop("_of")
    points = bucketed(p.select("id", "x", "y"), "x", "y", size)
    here = stored(points.select("_bx", "_by").distinct())
    blocks = told(inner).groupBy("_by", "level", "block").agg(*total)
    whole = _at_levels(here, blocks).groupBy("_bx", "_by").agg(*total)
    inside = points.join(whole.hint("shuffle_hash"), ["_bx", "_by"]).select("id", "n", "least", "most")
    near = _held_at_border(points, told(border), size).select("id", "n", "least", "most")
    return inside.unionByName(near).groupBy("id").agg(*total)


def assign_zone(p: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """``p`` with the zone that holds each point; the last in order wins, else NULL."""
    inside = last_inside(p, edges.where(F.col("ord").isNotNull()), size).groupBy("id").agg(F.max_by("zone", F.struct("ord", "zone")).alias("zone"))
    return p.join(inside.withColumnRenamed("id", "_id").hint("shuffle_hash"), F.col("id") == F.col("_id"), "left").drop("_id")


def nearest_segments(p: DataFrame, segments: DataFrame, reach: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs (id, x, y, columns of ``segments``) among which are the nearest segments (keys, x1, y1, x2, y2, ...) of each point within ``reach``.

    Squares of points and the segments around them, from squares of the reach downwards: with h
    half a square's diagonal, a segment over 2 h farther from the middle than another of the same
    keys, or over reach + h, is nearest to no point of the square. Squares with over
    ``SQUARE_PLACES`` places and over ``LEAF_POINTS`` segments are split in four.
    """
    places = stored(p.select("x", "y").distinct())
    at = lambda k: {"_bx": F.floor(F.col("x") / (reach / 2**k)), "_by": F.floor(F.col("y") / (reach / 2**k))}
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    box = [f(a, b) for f, a, b in ((F.least, "x1", "x2"), (F.least, "y1", "y2"), (F.greatest, "x1", "x2"), (F.greatest, "y1", "y2"))]
    met, out = spread(segments, box[0] - reach, box[1] - reach, box[2] + reach, box[3] + reach, reach), []
    for k in range(MOST_SPLITS + 1):
        side = reach / 2**k
        half = side * 0.5**0.5
        squares = places.withColumns(at(k)).groupBy("_bx", "_by").agg(F.count(F.lit(1)).alias("_n"))
        cx, cy = (F.col("_bx") + 0.5) * side, (F.col("_by") + 0.5) * side
        far = geo.segment_distance(cx, cy, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))["distance"]
        mine = Window.partitionBy(*keys, "_bx", "_by")
        told = met.join(squares.hint("shuffle_hash"), ["_bx", "_by"]).withColumn("_far", far).where(F.col("_far") <= (reach + half) * (1 + 1e-9))
        told = told.withColumns({"_least": F.min("_far").over(mine), "_met": F.count(F.lit(1)).over(mine)})
        near = told.where(F.col("_far") <= (F.col("_least") + 2 * half) * (1 + 1e-9) + 1e-12 * (F.abs(cx) + F.abs(cy)))
        split = (F.col("_n") > SQUARE_PLACES) & (F.col("_met") > LEAF_POINTS) & F.lit(k < MOST_SPLITS)
        near = stored(near.withColumn("_split", split).drop("_n", "_far", "_least", "_met"))
        done, rest = near.where("not _split").drop("_split"), near.where("_split").drop("_split")
        out.append(p.select("id", "x", "y").withColumns(at(k)).join(done.hint("shuffle_hash"), ["_bx", "_by"]).drop("_bx", "_by"))
        if rest.limit(1).count() == 0:
            break
        met = rest.withColumn("_o", F.explode(steps)).withColumns({"_bx": F.col("_bx") * 2 + F.col("_o.a"), "_by": F.col("_by") * 2 + F.col("_o.b")}).drop("_o")
    return reduce(DataFrame.unionByName, out)


def border_distance(p: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """(id, dist) to the nearest border of any zone, within ``reach``."""
    lines = edges.select("x1", "y1", "x2", "y2").distinct()
    gap = geo.segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))["distance"]
    return nearest_segments(p, lines, reach).groupBy("id").agg(F.min(gap).alias("dist")).where(F.col("dist") <= reach)


def edge_distances(p: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """(id, zone, dist) to the border of each zone within ``reach`` of a point."""
    near = spread(
        edges, F.least("x1", "x2") - reach, F.least("y1", "y2") - reach, F.greatest("x1", "x2") + reach, F.greatest("y1", "y2") + reach, reach
    )
    met = bucketed(p.select("id", "x", "y"), "x", "y", reach).join(near.hint("shuffle_hash"), ["_bx", "_by"])
    gap = geo.segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))["distance"]
    return met.groupBy("id", "zone").agg(F.min(gap).alias("dist")).where(F.col("dist") <= reach)


def _reached(edges: DataFrame, reach: float, side: float, levels: int, tasks: int) -> DataFrame:
    """(zone, _by, level, block, _edges): squares that hold a place inside a zone or at most ``reach`` from its border.

    A zone has each square once. Squares all of whose places count come as blocks of 2^level squares
    of a row, without edges; the others lie outside the zone and have the edges that can be near enough.
    ``side`` is at most half the reach, so a square that a border passes through counts as a whole.
    """
    half = side * 0.5**0.5
    pad, sure = (reach + half) * (1 + 1e-9), reach * (1 - 1e-9) - half
    row = lambda v: F.floor(v / side)
    bands = edges.select("zone", "ord", "x1", "y1", "x2", "y2", F.explode(F.sequence(row(F.least("y1", "y2") - pad), row(F.greatest("y1", "y2") + pad))).alias("_by"))
    bands = bands.repartition(tasks, "zone", "_by")
    low, high, middle = F.col("_by") * side - pad, (F.col("_by") + 1) * side + pad, (F.col("_by") + 0.5) * side
    # where the edge is within its row's reach; a level edge over its whole length
    at = lambda y, level: F.coalesce(F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)), level)
    a, b = at(F.greatest(low, F.least("y1", "y2")), F.col("x1")), at(F.least(high, F.greatest("y1", "y2")), F.col("x2"))
    spans = (F.col("y1") > middle) != (F.col("y2") > middle)
    met = bands.withColumns({"_bx": F.explode(F.sequence(row(F.least(a, b) - pad), row(F.greatest(a, b) + pad))), "_at": F.when(spans, at(middle, F.col("x1")))})
    met = met.withColumn("_far", geo.segment_distance((F.col("_bx") + 0.5) * side, middle, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))["distance"]).where(F.col("_far") <= pad)
    squares = met.groupBy("zone", "_by", "_bx").agg(
        F.min("_far").alias("_far"),
        F.collect_list(F.when(F.col("_far") > sure, F.struct("x1", "y1", "x2", "y2"))).alias("_edges"),
        # a crossing of the row's middle stands in the square that holds it
        F.collect_list(F.when(row(F.col("_at")) == F.col("_bx"), F.struct("ord", "_at"))).alias("_cut"),
    )
    mine = Window.partitionBy("zone", "_by")
    line = mine.orderBy("_bx")
    odd = lambda x: F.exists(F.array_distinct(F.transform("_cuts", lambda c: c["ord"])), lambda o: F.size(F.filter("_cuts", lambda c: c["ord"].eqNullSafe(o) & (c["_at"] > x))) % 2 == 1)
    told = squares.withColumns({"_cuts": F.flatten(F.collect_list("_cut").over(mine)), "_next": F.lead("_bx").over(line), "_last": F.lag("_bx").over(line)})
    told = told.withColumn("_whole", F.when(F.col("_far") <= sure, F.lit(True)).otherwise(odd((F.col("_bx") + 0.5) * side)))
    # between two squares of a row that are not neighbours no border is near, so one place tells for all
    told = told.withColumn("_gap", F.when(F.col("_next") > F.col("_bx") + 1, odd((F.col("_bx") + 1.5) * side)).otherwise(F.lit(False)))
    begins = F.col("_whole") & ~F.coalesce((F.col("_last") == F.col("_bx") - 1) & F.lag("_whole").over(line), F.lit(False))
    ends = F.col("_whole") & ~F.coalesce((F.col("_next") == F.col("_bx") + 1) & F.lead("_whole").over(line), F.lit(False))
    told = told.withColumns({"_begins": begins, "_ends": ends})
    told = told.withColumn("_first", F.last(F.when(F.col("_begins"), F.col("_bx")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    kind = "array<struct<level:int,block:bigint,edges:array<struct<x1:double,y1:double,x2:double,y2:double>>>>"
    run = lambda when, lo, hi: F.when(when, F.transform(_dyadic(lo, hi, levels), lambda p: F.struct(p["level"], p["block"], F.lit(None).alias("edges"))).cast(kind)).otherwise(F.array().cast(kind))
    part = F.when(F.col("_whole"), F.array().cast(kind)).otherwise(F.array(F.struct(F.lit(0).alias("level"), F.col("_bx").alias("block"), F.col("_edges").alias("edges"))).cast(kind))
    pieces = F.concat(run(F.col("_ends"), F.col("_first"), F.col("_bx")), run(F.col("_gap"), F.col("_bx") + 1, F.col("_next") - 1), part)
    return told.select("zone", "_by", F.explode(pieces).alias("_p")).select("zone", "_by", "_p.level", "_p.block", F.col("_p.edges").alias("_edges"))


def within_of_polygon(p: DataFrame, edges: DataFrame, reach: float, size: float) -> DataFrame:
    """(id, zone) of points inside a zone or at most ``reach`` from its border, each pair once.

    There are as many pairs as zones lie over points, so no pair is shuffled: zones send their
    squares (``_reached``), points stand in a block of each level, and a pair is made where they
    meet. Only the pairs of ids that have several points are made distinct.
    """
    side = _fine(p, min(size, reach / 2), WITHIN_SPLITS)
    x, y = [F.least(f"{c}1", f"{c}2") for c in "xy"], [F.greatest(f"{c}1", f"{c}2") for c in "xy"]
    n, *box = edges.agg(F.count(F.lit(1)), F.min(x[0]), F.max(y[0]), F.min(x[1]), F.max(y[1])).first()
    if not n or box[0] is None:
        return p.select("id").crossJoin(edges.select("zone").limit(0))
    levels = max(1, math.ceil(math.log2((box[1] - box[0] + 4 * reach) / side + 4)))
    spark = p.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, n // TASK_EDGES)
    known = p.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("not isnan(x) and not isnan(y)")
    twice = stored(p.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id"))
    known = known.join(twice.withColumn("_twice", F.lit(True)).hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")), "left").drop("_id").fillna(False, ["_twice"])
    at = known.withColumns({"_row": F.floor(F.col("y") / side), "_level": F.explode(F.sequence(F.lit(0), F.lit(levels)))})
    at = at.withColumn("_block", F.expr(f"shiftright(floor(x / {side!r}D), _level)")).repartition(tasks, "_row", "_level", "_block")
    near = lambda e: geo.segment_distance(F.col("x"), F.col("y"), e["x1"], e["y1"], e["x2"], e["y2"])["distance"] <= reach
    edge = lambda i: F.get("_edges", F.lit(i))
    # most squares have one or two edges; a lambda over more is slower
    hit = F.col("_edges").isNull() | near(edge(0)) | (F.size("_edges") > 1) & near(edge(1)) | (F.size("_edges") > 2) & F.exists("_edges", near)
    cover = _reached(edges, reach, side, levels, tasks).repartition(tasks, "_by", "level", "block")
    met = cover.join(at.hint("shuffle_hash"), (F.col("_by") == F.col("_row")) & (F.col("level") == F.col("_level")) & (F.col("block") == F.col("_block")))
    pairs = met.where(hit)
    if twice.limit(1).count() == 0:
        return pairs.select("id", "zone")
    return pairs.where("not _twice").select("id", "zone").unionByName(pairs.where("_twice").select("id", "zone").distinct())


def dist_to_polygon(p: DataFrame, edges: DataFrame, reach: float, size: float) -> DataFrame:
    """``p`` with the distance to the nearest zone: 0 inside, NULL beyond ``reach``."""
    inside = inside_any(p, edges, size).select("id", F.lit(0.0).alias("dist"))
    near = border_distance(p, edges, reach).unionByName(inside).groupBy(F.col("id").alias("_id")).agg(F.min("dist").alias("dist"))
    return p.join(near.hint("shuffle_hash"), F.col("id") == F.col("_id"), "left").drop("_id")


def nearest_line(p: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """(id, kind, line, dist, foot_x, foot_y): nearest segment of each class within ``reach``.

    ``segments``: (kind, line, x1, y1, x2, y2).
    """
    # of equal segments the first line by name
    lines = segments.groupBy("kind", "x1", "y1", "x2", "y2").agg(F.min("line").alias("line"))
    met = nearest_segments(p, lines, reach, ["kind"])
    foot = geo.segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    best = met.withColumn("_f", foot).where(F.col("_f.distance") <= reach).groupBy("id", "kind").agg(F.min(F.struct(F.col("_f.distance").alias("d"), F.col("line"), F.col("_f.x").alias("fx"), F.col("_f.y").alias("fy"))).alias("_b"))
    return best.select("id", "kind", F.col("_b.line").alias("line"), F.col("_b.d").alias("dist"), F.col("_b.fx").alias("foot_x"), F.col("_b.fy").alias("foot_y"))


def offsets(radius: int) -> Column:
    """Array of struct(dr, dc) of a disk of ``radius`` cells; its size is fixed by the radius."""
    line = F.sequence(F.lit(-radius), F.lit(radius))
    square = F.flatten(F.transform(line, lambda r: F.transform(line, lambda c: F.struct(r.alias("dr"), c.alias("dc")))))
    return F.filter(square, lambda o: o["dr"] * o["dr"] + o["dc"] * o["dc"] <= radius * radius)


def disk(cases: DataFrame, radius: int, keys: Sequence[str] = ()) -> DataFrame:
    """All cells within ``radius`` cells of any case (row, col), each once."""
    out = cases.select(*keys, "row", "col").distinct().withColumn("_o", F.explode(offsets(radius)))
    return out.select(*keys, (F.col("row") + F.col("_o.dr")).alias("row"), (F.col("col") + F.col("_o.dc")).alias("col")).distinct()


def case_distance(cells: DataFrame, cases: DataFrame, radius: int, keys: Sequence[str] = ()) -> DataFrame:
    """``cells`` with the distance in cells to the nearest case within ``radius``, else NULL."""
    out = cases.select(*keys, "row", "col").distinct().withColumn("_o", F.explode(offsets(radius)))
    reach = out.select(*keys, (F.col("row") + F.col("_o.dr")).alias("row"), (F.col("col") + F.col("_o.dc")).alias("col"), F.hypot(F.col("_o.dr").cast("double"), F.col("_o.dc").cast("double")).alias("_d"))
    near = reach.groupBy(*keys, "row", "col").agg(F.min("_d").alias("case_dist"))
    return cells.join(near.hint("shuffle_hash"), [*keys, "row", "col"], "left")


def rasterize(edges: DataFrame, g: geo.Grid) -> DataFrame:
    """(zone, ord, row, col): cells whose centre lies in a zone's outer ring (ring 0).

    A zone that holds no centre keeps the cell of its box's middle. Rows of cells meet the
    edges that cross them; a cell's centre is inside if an odd number of crossings lies to
    its right.
    """
    outer = edges.where("ring = 0")
    row_of = lambda y: F.floor((F.lit(g.origin_top) - y) / g.cell)
    col_of = lambda x: F.floor((x - g.origin_x) / g.cell)
    lines = outer.withColumn("row", F.explode(F.sequence(row_of(F.greatest("y1", "y2")), row_of(F.least("y1", "y2")))))
    cy = g.origin_top - (F.col("row") + 0.5) * g.cell
    cut = lines.where((F.col("y1") > cy) != (F.col("y2") > cy)).withColumn("_at", (F.col("x2") - F.col("x1")) * (cy - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    # crossings of a row, sorted, pair up as the spans inside the ring
    spans = cut.groupBy("zone", "ord", "row").agg(F.array_sort(F.collect_list("_at")).alias("_xs"))
    pairs = spans.withColumn("_i", F.explode(F.sequence(F.lit(0), (F.size("_xs") / 2).cast("int") - 1)))
    first_centre = lambda x: F.ceil((x - g.origin_x) / g.cell - 0.5)  # noqa: E731  first column whose centre is at x or beyond
    inside = pairs.withColumn("_c0", first_centre(F.get("_xs", F.col("_i") * 2))).withColumn("_c1", first_centre(F.get("_xs", F.col("_i") * 2 + 1)) - 1)
    cells = inside.where("_c0 <= _c1").select("zone", "ord", "row", F.explode(F.sequence("_c0", "_c1")).alias("col"))
    box = outer.groupBy("zone", "ord").agg(F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("xm"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("ym"))
    middle = box.join(cells.select("zone").distinct().hint("shuffle_hash"), "zone", "left_anti").select("zone", "ord", row_of((F.col("y0") + F.col("ym")) / 2).alias("row"), col_of((F.col("x0") + F.col("xm")) / 2).alias("col"))
    within = F.col("row").between(0, g.rows - 1) & F.col("col").between(0, g.cols - 1)
    return cells.unionByName(middle).where(within)


def rasterize_timed(edges: DataFrame, times: DataFrame, g: geo.Grid) -> DataFrame:
    """(event, hour, row, col, zones, dropped): zones over each cell by event and hour.

    ``times`` has (zone, event, hour). Zones without an event or hour, or without a row there,
    are dropped; their number comes along with every row.
    """
    known = times.where("event is not null and hour is not null").select(F.col("zone").alias("_zone"), "event", "hour").distinct()
    cells = rasterize(edges, g).join(known.hint("shuffle_hash"), F.col("zone") == F.col("_zone"))
    without = edges.select("zone").distinct().join(known.select("_zone").distinct().hint("shuffle_hash"), F.col("zone") == F.col("_zone"), "left_anti")
    dropped = without.agg(F.count(F.lit(1)).alias("dropped"))
    counted = cells.groupBy("event", "hour", "row", "col").agg(F.count(F.lit(1)).alias("zones"))
    return counted.crossJoin(F.broadcast(dropped))  # one row


def zone_cells(edges: DataFrame, g: geo.Grid, last_wins: bool = False) -> DataFrame:
    """(row, col, zone): one zone for each cell; the first in order wins, or the last."""
    pick = F.max_by if last_wins else F.min_by
    return rasterize(edges, g).groupBy("row", "col").agg(pick("zone", "ord").alias("zone"))


def line_cells(vertices: DataFrame, g: geo.Grid) -> DataFrame:
    """Distinct cells (line, row, col) that a line's vertices (line, x, y) touch."""
    return vertices.withColumn("_c", geo.cell_of(F.col("x"), F.col("y"), g)).where("_c is not null").select("line", "_c.row", "_c.col").distinct()


def surveyed_zones(labels: DataFrame, centroids: DataFrame, reach: float, least: int) -> DataFrame:
    """(zone, labels): zones to whose centroid at least ``least`` labels are nearest."""
    near = nearest(labels, centroids, reach).where("q_id is not null")
    return near.groupBy(F.col("q_id").alias("zone")).agg(F.count(F.lit(1)).alias("labels")).where(F.col("labels") >= least)
