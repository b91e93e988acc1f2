"""Queries of the neighbourhood filters and hydrology."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import geo
from freshet.operators import grid, hydrology
from freshet.plans import fixtures as fx
from freshet.plans.q_clean import tm_steps
from freshet.plans.registration import Registry
from freshet.session import stored

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_NEAR = lambda r: f"cells a join cells b on b.row between a.row - {r} and a.row + {r} and b.col between a.col - {r} and a.col + {r}"


@query("W12_rel_height", fx.sql("cells") + f" select a.row, a.col, round(a.z - min(b.z), 6) as rel_height from {_NEAR(3)} group by a.row, a.col, a.z")
def w12(spark, sf):
    return grid.rel_height(fx.cells(spark, sf), "z", 3).select("row", "col", F.round("rel_height", 6).alias("rel_height"))


@query("W13_tpi", fx.sql("cells") + f" select a.row, a.col, round(a.z - sum(b.z) / count(*), 8) as tpi from {_NEAR(2)} group by a.row, a.col, a.z")
def w13(spark, sf):
    return grid.tpi(fx.cells(spark, sf), "z", 2).select("row", "col", F.round("tpi", 8).alias("tpi"))


@query("W13_density", fx.sql("cells") + f" select a.row, a.col, round(avg((b.land % 3 = 0)::int), 6) as density from {_NEAR(4)} group by a.row, a.col")
def w13b(spark, sf):
    df = fx.cells(spark, sf).withColumn("hit", F.when(F.col("land") % 3 == 0, 1.0).otherwise(0.0))
    return grid.window_mean(df, "hit", 4).select("row", "col", F.round("window_mean", 6).alias("density"))


_FOUR = """n as (select a.row, a.col, a.z, e.z as e, w.z as w, s.z as s, n.z as n from cells a left join cells e on e.row = a.row and e.col = a.col + 1 left join cells w on w.row = a.row and w.col = a.col - 1
      left join cells s on s.col = a.col and s.row = a.row + 1 left join cells n on n.col = a.col and n.row = a.row - 1)"""


@query(
    "W14_slope",
    fx.sql("cells") + ", " + _FOUR + """ select row, col, round(degrees(atan(sqrt(pow((coalesce(e, z) - coalesce(w, z)) / (case when e is not null and w is not null then 2 else 1 end * 30), 2) + pow((coalesce(s, z) - coalesce(n, z)) / (case when s is not null and n is not null then 2 else 1 end * 30), 2)))), 6) as slope from n""",
)
def w14(spark, sf):
    return grid.slope(fx.cells(spark, sf), "z", 30.0).select("row", "col", F.round("slope", 6).alias("slope"))


@query("W15_curvature", fx.sql("cells") + ", " + _FOUR + " select row, col, coalesce(round((e + w + s + n - 4 * z) / 900, 8), 0) as curvature from n")
def w15(spark, sf):
    return grid.curvature(fx.cells(spark, sf), "z", 30.0).select("row", "col", F.round("curvature", 8).alias("curvature"))


@query(
    "W16_local_min",
    fx.sql("xy") + ", b as (select floor(x / 2) as bx, floor(y / 2) as by, min(label) as m from xy group by 1, 2) select id, min(m)::int as local_min, (label - min(m))::int as rel_local from xy join b on b.bx between floor(x / 2) - 1 and floor(x / 2) + 1 and b.by between floor(y / 2) - 1 and floor(y / 2) + 1 group by id, label",
)
def w16(spark, sf):
    return grid.local_min(fx.xy(spark, sf), "x", "y", "label", 2.0).select("id", F.col("local_min").cast("int").alias("local_min"), F.col("rel_local").cast("int").alias("rel_local"))


_STEPS = "steps(k, dr, dc) as (values (0, -1, 0), (1, -1, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, -1), (6, 0, -1), (7, -1, -1))"
_D8 = f"{_STEPS}, d as (select a.row, a.col, k, (a.z - b.z) / case when dr <> 0 and dc <> 0 then sqrt(2) else 1 end as drop_m from cells a, steps join cells b on b.row = a.row + dr and b.col = a.col + dc), best as (select row, col, arg_max(k, (drop_m, -k))::int as d8 from d where drop_m > 0 group by 1, 2)"


@query("W17_d8", fx.sql("cells") + ", " + _D8 + " select c.row, c.col, d8 from cells c left join best using (row, col)")
def w17(spark, sf):
    return grid.d8(fx.cells(spark, sf), "z").select("row", "col", "d8")


@query("R05_dist_to_seed", fx.sql("cells") + " select a.row, a.col, min(case when sqrt(pow(a.row - b.row, 2) + pow(a.col - b.col, 2)) <= 10 then round(30 * sqrt(pow(a.row - b.row, 2) + pow(a.col - b.col, 2)), 6) end) as dist_m from cells a left join cells b on b.land % 97 = 0 group by 1, 2")
def r05(spark, sf):
    return grid.dist_to_seed(fx.cells(spark, sf), F.col("land") % 97 == 0, 10, 30.0).select("row", "col", F.round("dist_m", 6).alias("dist_m"))


@query(
    "R06_pump_index",
    fx.sql("xy") + """, p as (select id, x, y, (id % 9) * 10.0::double as capacity from xy where id % 6 = 0), n as (select xy.id, arg_min(p.capacity, (sqrt(pow(p.x - xy.x, 2) + pow(p.y - xy.y, 2)), p.id)) as c, min(sqrt(pow(p.x - xy.x, 2) + pow(p.y - xy.y, 2))) as d from xy join p on p.capacity > 0 and xy.id % 6 <> 0 where pow(p.x - xy.x, 2) + pow(p.y - xy.y, 2) <= 4 group by 1)
      select xy.id, coalesce(round(c / greatest(d, 0.5), 6), 0) as pump_index from xy left join n using (id) where xy.id % 6 <> 0""",
)
def r06(spark, sf):
    p = fx.xy(spark, sf)
    pumps = p.where("id % 6 = 0").select("id", "x", "y", ((F.col("id") % 9) * 10).cast("double").alias("capacity"))
    return grid.pump_index(p.where("id % 6 <> 0"), pumps, 2.0).select("id", F.round("pump_index", 6).alias("pump_index"))


@query("R07_resample", fx.sql("cells") + " select row * 3 + i as row, col * 3 + j as col, z from cells, (select unnest(range(3))::int as i), (select unnest(range(3))::int as j)")
def r07(spark, sf):
    return grid.resample(fx.cells(spark, sf), 3, ["z"])


_REPROJECTED = (
    fx.sql("cells")
    + f""", side as (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint as n from lineitem),
      target as (
        select r as row, c as col, 14165000.0::double - 1250 * n + (c + 0.5) * 1250 as mx, 4360000.0::double + 1250 * n - (r + 0.5) * 1250 as my
        from side, (select unnest(range(4 * n)) as r from side), (select unnest(range(4 * n)) as c from side)),
      points as (
        select row * 1000000 + col as id, mx * (180 / {geo.MERCATOR_HALF!r}) as lon, degrees(2 * atan(exp(my * (pi() / {geo.MERCATOR_HALF!r}))) - pi() / 2) as lat from target)"""
    + tm_steps()
    + """, met as (select id // 1000000 as row, id % 1000000 as col, floor((1820000 - y) / 1000)::bigint as r, floor((x - 980000) / 1000)::bigint as c from placed)
      select met.row, met.col, z from met join cells on cells.row = r and cells.col = c"""
)


@query("R07_reproject", _REPROJECTED)
def r07b(spark, sf):
    side = fx.side(spark, sf)
    source = geo.Grid(1000.0, 980_000.0, 1_820_000.0, side, side)
    # a target of the same plane, over all the source: its corner and its span in Mercator metres
    target = geo.Grid(1250.0, 14_165_000.0 - 1250.0 * side, 4_360_000.0 + 1250.0 * side, 4 * side, 4 * side)
    return grid.reproject(fx.cells(spark, sf), source, target, geo.TM_5179, ["z"])


#: Cells on the side of a tile of the registered queries: their grids have some 40 to 140 a side.
TILE = 32
_FILLED = (
    fx.sql("cells").replace("with ", "with recursive ", 1)
    + ", "
    + _STEPS
    + """, border as (
        select row, col, z from cells c
        where (select count(*) from cells n where n.row between c.row - 1 and c.row + 1 and n.col between c.col - 1 and c.col + 1) < 9),
      f(row, col, w) using key (row, col) as (
        select row, col, z from border
        union
        select c.row, c.col, min(greatest(c.z, f.w + 0.001)) from f join steps on true join cells c on c.row = f.row + dr and c.col = f.col + dc
          left join recurring.f as old on old.row = c.row and old.col = c.col
        where old.w is null or greatest(c.z, f.w + 0.001) < old.w - 1e-9 group by 1, 2)"""
)


@query("R08_fill", _FILLED + " select c.row, c.col, round(w, 6) as filled, round(w - z, 6) as sink from cells c left join f using (row, col)")
def r08(spark, sf):
    out = hydrology.fill(fx.cells(spark, sf).select("row", "col", "z"), "z", 0.001, TILE)
    return out.select("row", "col", F.round("filled", 6).alias("filled"), F.round(F.col("filled") - F.col("z"), 6).alias("sink"))


@query(
    "R09_flow_acc",
    fx.sql("cells").replace("with ", "with recursive ", 1) + ", " + _D8 + """, f as (select b.row, b.col, b.row + dr as r2, b.col + dc as c2 from best b join steps on k = d8),
      p as (select row, col, row as r, col as c from cells union all select p.row, p.col, f.r2, f.c2 from p join f on f.row = p.r and f.col = p.c)
      select r as row, c as col, count(*) as acc from p group by 1, 2""",
)
def r09(spark, sf):
    return grid.flow_acc(grid.d8(fx.cells(spark, sf).select("row", "col", "z"), "z"))


@query(
    "R10_filled_flow",
    _FILLED
    + """, w as (select c.row, c.col, round(w, 6) as z from cells c join f using (row, col)),
      d as (
        select a.row, a.col, a.row + dr as r2, a.col + dc as c2, k, (a.z - b.z) / case when dr <> 0 and dc <> 0 then sqrt(2) else 1 end as drop_m
        from w a, steps join w b on b.row = a.row + dr and b.col = a.col + dc),
      best as (select row, col, arg_max(k, (drop_m, -k))::int as d8, arg_max(r2, (drop_m, -k)) as r2, arg_max(c2, (drop_m, -k)) as c2 from d where drop_m > 0 group by 1, 2),
      p as (select row, col, row as r, col as c from w union all select p.row, p.col, b.r2, b.c2 from p join best b on b.row = p.r and b.col = p.c),
      acc as (select r as row, c as col, count(*) as acc from p group by 1, 2)
      select w.row, w.col, w.z as filled, d8, acc from w left join best using (row, col) join acc using (row, col)""",
)
def r10b(spark, sf):
    filled = hydrology.fill(fx.cells(spark, sf).select("row", "col", "z"), "z", 0.001, TILE)
    directed = stored(grid.d8(filled.select("row", "col", F.round("filled", 6).alias("filled")), "filled"))
    acc = hydrology.flow_acc(directed, TILE).withColumnsRenamed({"row": "_row", "col": "_col"})
    return directed.join(acc.hint("shuffle_hash"), (F.col("row") == F.col("_row")) & (F.col("col") == F.col("_col"))).select("row", "col", "filled", "d8", "acc")


@query("R10_tiled_rel_height", fx.sql("cells") + f" select a.row, a.col, round(a.z - min(b.z), 6) as rel_height from {_NEAR(3)} group by a.row, a.col, a.z")
def r10(spark, sf):
    out = grid.tiled(fx.cells(spark, sf).select("row", "col", "z"), 16, 3, lambda df, keys: grid.rel_height(df, "z", 3, keys))
    return out.select("row", "col", F.round("rel_height", 6).alias("rel_height"))
