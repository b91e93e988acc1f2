"""Queries of the bucketed spatial joins and the rasterisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import geo
from freshet.operators import spatial as sp
from freshet.plans import fixtures as fx
from freshet.plans.registration import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

GRID = geo.Grid(0.5, -10.0, 14.0, 48, 48)
_INSIDE = """inside as (select id, zone, ord from xy, zone_edges where (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / case when y2 <> y1 then y2 - y1 end + x1 group by 1, 2, 3 having count(*) % 2 = 1)"""
_SEG = """seg as (select id, zone, min(sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))) as d from (
      select *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) as t from xy, zone_edges) group by 1, 2)"""


def _kinds(spark, sf):
    p = fx.xy(spark, sf)
    return p.where("kind = 'control'"), p.where("kind = 'flood'")


@query("J07_points_in_polygons", fx.sql("xy", "zone_edges") + ", " + _INSIDE + " select id, zone, ord from inside")
def j07(spark, sf):
    return sp.points_in_polygons(fx.xy(spark, sf), fx.zone_edges(spark, sf), 2.0)


@query("J08_assign_zone", fx.sql("xy", "zone_edges") + ", " + _INSIDE + " select xy.id, arg_max(zone, ord) as zone from xy left join inside using (id) group by 1")
def j08(spark, sf):
    return sp.assign_zone(fx.xy(spark, sf), fx.zone_edges(spark, sf), 2.0).select("id", "zone")


@query("J09_within_of_polygon", fx.sql("xy", "zone_edges") + ", " + _INSIDE + ", " + _SEG + " select id, zone from inside union select id, zone from seg where d <= 1")
def j09(spark, sf):
    return sp.within_of_polygon(fx.xy(spark, sf), fx.zone_edges(spark, sf), 1.0, 2.0)


@query(
    "J10_dist_to_polygon",
    fx.sql("xy", "zone_edges") + ", " + _INSIDE + ", " + _SEG + ", n as (select id, min(d) as d from (select id, d from seg where d <= 3 union all select id, 0 from inside) group by 1) select xy.id, round(n.d, 6) as dist from xy left join n using (id)",
)
def j10(spark, sf):
    return sp.dist_to_polygon(fx.xy(spark, sf), fx.zone_edges(spark, sf), 3.0, 2.0).select("id", F.round("dist", 6).alias("dist"))


_PAIRS = "pairs as (select p.id, q.id as q_id, sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) as dist from xy p join xy q on p.kind = 'control' and q.kind = 'flood')"


@query(
    "J11_nearest",
    fx.sql("xy") + ", " + _PAIRS + ", b as (select id, arg_min(q_id, (dist, q_id)) as q_id, min(dist) as dist from pairs where dist <= 1 group by 1) select xy.id, b.q_id, round(b.dist, 6) as dist from xy left join b using (id) where kind = 'control'",
)
def j11(spark, sf):
    p, q = _kinds(spark, sf)
    return sp.nearest(p, q, 1.0).select("id", "q_id", F.round("dist", 6).alias("dist"))


@query("J11_nearest_any", fx.sql("xy") + ", " + _PAIRS + " select id, arg_min(q_id, (dist, q_id)) as q_id, round(min(dist), 6) as dist from pairs group by 1")
def j11b(spark, sf):
    p, q = _kinds(spark, sf)
    return sp.nearest_any(p, q, 0.5).select("id", "q_id", F.round("dist", 6).alias("dist"))


@query(
    "J12_nearest_available",
    fx.sql("xy") + """, b as (select p.id, p.label, arg_min(q.id, (sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)), q.id)) as q_id, min(sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2))) as dist from xy p join xy q on p.id % 10 <> 0 and q.id % 10 = 0 and p.label = q.label where pow(q.x - p.x, 2) + pow(q.y - p.y, 2) <= 25 group by 1, 2)
      select xy.id, xy.label, b.q_id, round(b.dist, 6) as dist from xy left join b using (id) where xy.id % 10 <> 0""",
)
def j12(spark, sf):
    p = fx.xy(spark, sf)  # the label stands for the event at which a station reports
    return sp.nearest(p.where("id % 10 <> 0"), p.where("id % 10 = 0"), 5.0, keys=["label"]).select("id", "label", "q_id", F.round("dist", 6).alias("dist"))


@query(
    "J13_surveyed_zones",
    fx.sql("xy") + ", b as (select p.id, arg_min(q.id, (sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)), q.id)) as zone from xy p join xy q on q.id % 25 = 0 and p.kind = 'flood' where pow(q.x - p.x, 2) + pow(q.y - p.y, 2) <= 9 group by 1) select zone, count(*) as labels from b group by 1 having count(*) >= 3",
)
def j13(spark, sf):
    p = fx.xy(spark, sf)
    return sp.surveyed_zones(p.where("kind = 'flood'"), p.where("id % 25 = 0"), 3.0, 3)


@query(
    "J14_nearest_line",
    fx.sql("xy", "zone_edges") + """, s as (select id, case when ord = 2 then 'major' else 'minor' end as kind, zone || ring || '-' || i as line, x1 + t * (x2 - x1) as fx, y1 + t * (y2 - y1) as fy, x, y from (
        select *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) as t from xy, zone_edges)),
      d as (select *, sqrt(pow(x - fx, 2) + pow(y - fy, 2)) as d from s)
      select id, kind, round(min(d), 6) as dist from d where d <= 4 group by 1, 2""",
)
def j14(spark, sf):
    e = fx.zone_edges(spark, sf)
    lines = e.select(F.when(F.col("ord") == 2, "major").otherwise("minor").alias("kind"), F.concat("zone", F.col("ring").cast("string"), F.lit("-"), F.col("i").cast("string")).alias("line"), "x1", "y1", "x2", "y2")
    return sp.nearest_line(fx.xy(spark, sf), lines, 4.0).select("id", "kind", F.round("dist", 6).alias("dist"))


@query(
    "J15_within_topk",
    fx.sql("xy") + ", " + _PAIRS + " select id, q_id, round(dist, 6) as dist, rank::int as rank from (select *, row_number() over (partition by id order by dist, q_id) as rank from pairs where dist <= 2) where rank <= 3",
)
def j15(spark, sf):
    p, q = _kinds(spark, sf)
    return sp.within_topk(p, q, 2.0, 3).withColumn("dist", F.round("dist", 6))


_CASES = "cases as (select distinct (l_orderkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as row, (l_partkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as col from lineitem where l_quantity = 50 and l_discount = 0.1), offs as (select r::int as dr, c::int as dc from (select unnest(range(-3, 4)) as r), (select unnest(range(-3, 4)) as c) where r * r + c * c <= 9)"


def _cases(spark, sf):
    from freshet.session import table

    li = table(spark, sf, "lineitem").where("l_quantity = 50 and l_discount = 0.1")
    return li.select((F.col("l_orderkey") % fx.side(spark, sf)).cast("int").alias("row"), (F.col("l_partkey") % fx.side(spark, sf)).cast("int").alias("col"))


@query("J16_disk", f"with {_CASES} select distinct row + dr as row, col + dc as col from cases, offs")
def j16(spark, sf):
    return sp.disk(_cases(spark, sf), 3)


@query(
    "J17_case_distance",
    fx.sql("cells") + f", {_CASES}, n as (select row + dr as row, col + dc as col, min(sqrt(dr * dr + dc * dc)) as d from cases, offs group by 1, 2) select row, col, round(d, 6) as case_dist from cells left join n using (row, col)",
)
def j17(spark, sf):
    return sp.case_distance(fx.cells(spark, sf).select("row", "col"), _cases(spark, sf), 3).withColumn("case_dist", F.round("case_dist", 6))


@query(
    "J31_snap_to_node",
    fx.sql("xy") + ", b as (select p.id, arg_min(q.id, (sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)), q.id)) as node from xy p join xy q on q.id % 7 = 0 and p.id % 7 <> 0 where pow(q.x - p.x, 2) + pow(q.y - p.y, 2) <= 9 group by 1) select id, node from b",
)
def j31(spark, sf):
    p = fx.xy(spark, sf)
    return sp.nearest(p.where("id % 7 <> 0"), p.where("id % 7 = 0"), 3.0).where("q_id is not null").select("id", F.col("q_id").alias("node"))


_RASTER = """g as (select r as row, c as col, -10 + (c + 0.5) * 0.5 as x, 14 - (r + 0.5) * 0.5 as y from (select unnest(range(48)) as r), (select unnest(range(48)) as c)),
      e as (select * from zone_edges where ring = 0),
      k as (select zone, ord, row, col from g, e where (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / case when y2 <> y1 then y2 - y1 end + x1 group by all having count(*) % 2 = 1)"""


@query("R01_rasterize", fx.sql("zone_edges") + ", " + _RASTER + " select zone, ord, row, col from k")
def r01(spark, sf):
    return sp.rasterize(fx.zone_edges(spark, sf), GRID)


@query(
    "R02_rasterize_timed",
    fx.sql("zone_edges")
    + ", "
    + _RASTER
    + """ select case when ord % 2 = 0 then 'e0' else 'e1' end as event, ((10 + ord) % 24)::int as hour, row, col, count(*) as zones,
        (select count(distinct zone) from zone_edges where ord = 3 or ord % 10 = 7) as dropped
      from k where ord <> 3 and ord % 10 <> 7 group by all""",
)
def r02(spark, sf):
    edges = fx.zone_edges(spark, sf)
    # zone c has no row of times, zones of an order that ends in 7 have no hour
    times = edges.where("ord <> 3").select("zone", F.when(F.col("ord") % 2 == 0, "e0").otherwise("e1").alias("event"), F.when(F.col("ord") % 10 != 7, (10 + F.col("ord")) % 24).alias("hour"))
    return sp.rasterize_timed(edges, times, GRID)


@query("R03_zone_cells", fx.sql("zone_edges") + ", " + _RASTER + " select row, col, arg_min(zone, ord) as first_zone, arg_max(zone, ord) as last_zone from k group by 1, 2")
def r03(spark, sf):
    e = fx.zone_edges(spark, sf)
    first = sp.zone_cells(e, GRID).withColumnRenamed("zone", "first_zone")
    return first.join(sp.zone_cells(e, GRID, last_wins=True).withColumnRenamed("zone", "last_zone").hint("merge"), ["row", "col"])


@query("R04_line_cells", fx.sql("xy") + ", c as (select id % 50 as line, floor((14 - y) / 0.5)::bigint as row, floor((x + 10) / 0.5)::bigint as col from xy) select distinct line, row, col from c where row between 0 and 47 and col between 0 and 47")
def r04(spark, sf):
    return sp.line_cells(fx.xy(spark, sf).select((F.col("id") % 50).alias("line"), "x", "y"), GRID)
