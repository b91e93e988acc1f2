"""Queries of the composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.plans import fixtures as fx
from freshet.plans import jobs
from freshet.plans.q_rel import annulus_sql
from freshet.plans.q_series import _accumulate_sql, _shape_sql
from freshet.plans.q_spatial import _INSIDE, _SEG
from freshet.plans.registration import Registry
from freshet.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_CASES = "select month(l_shipdate)::int as event, (l_orderkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as row, (l_partkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as col from lineitem where l_quantity = 50 and l_discount = 0.1"


def _census_inputs(spark, sf):
    li = table(spark, sf, "lineitem")
    place = [F.month("l_shipdate").alias("event"), (F.col("l_orderkey") % fx.side(spark, sf)).cast("int").alias("row"), (F.col("l_partkey") % fx.side(spark, sf)).cast("int").alias("col")]
    cases = li.where("l_quantity = 50 and l_discount = 0.1").select(*place)
    flooded = li.where("l_quantity >= 49 and l_returnflag = 'R'").select(*place).where("event <> 2")
    rain = li.groupBy(*place).agg((F.max("l_extendedprice") / 2000).alias("rain_6h"))
    layers = fx.cells(spark, sf).select("row", "col", "z", "built")
    return cases, flooded, layers, rain


_CENSUS = fx.sql("cells") + f""", cases as ({_CASES}), fl as (select distinct month(l_shipdate)::int as event, (l_orderkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as row, (l_partkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as col from lineitem where l_quantity >= 49 and l_returnflag = 'R' and month(l_shipdate) <> 2),
      rain as (select month(l_shipdate)::int as event, (l_orderkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as row, (l_partkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as col, max(l_extendedprice) / 2000 as rain_6h from lineitem group by 1, 2, 3),
      ring as (select distinct c.event, k.row, k.col from cases c join cells k on pow(k.row - c.row, 2) + pow(k.col - c.col, 2) <= 16),
      own as (select distinct event, row, col from cases), far as (select row, col from cells k where not exists (select 1 from cases c where pow(k.row - c.row, 2) + pow(k.col - c.col, 2) <= 4)),
      marked as (select r.*, case when r.event in (select event from fl) then (fl.row is not null)::int else (own.row is not null)::int end as flooded, far.row is not null as far from ring r left join fl using (event, row, col) left join own using (event, row, col) left join far using (row, col)),
      census as (select event, row, col, flooded, z, built, rain_6h from marked join cells using (row, col) left join rain using (event, row, col) where (flooded = 1 or far or rain_6h < 20) and z > 0)"""


@query("C01_ring_census", _CENSUS + " select event, row, col, flooded, z, built, round(rain_6h, 6) as rain_6h from census")
def c01(spark, sf):
    return rounded(jobs.ring_census(*_census_inputs(spark, sf), 4, 2, dry_mm=20.0)).select("event", "row", "col", "flooded", "z", "built", "rain_6h")


@query(
    "C02_ring_census_timed",
    _CENSUS + """, t as (select month(l_shipdate)::int as event, (l_orderkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as row, (l_partkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as col, min(l_suppkey % 24)::int as f from lineitem where l_quantity >= 49 and l_returnflag = 'R' group by 1, 2, 3),
      e as (select c.event, h, row, col, (coalesce(f <= h, false))::int as flooded from census c cross join (select unnest([6, 18]) as h) left join t using (event, row, col)), n as (select event, h, count(*) as rows, sum(flooded)::bigint as positives from e group by 1, 2)
      select event || '_' || lpad(h::varchar, 2, '0') as event, rows, positives from n where rows >= 20 and positives >= 1""",
)
def c02(spark, sf):
    census = jobs.ring_census(*_census_inputs(spark, sf), 4, 2, dry_mm=20.0)
    li = table(spark, sf, "lineitem").where("l_quantity >= 49 and l_returnflag = 'R'")
    timed = li.select(F.month("l_shipdate").alias("event"), (F.col("l_orderkey") % fx.side(spark, sf)).cast("int").alias("row"), (F.col("l_partkey") % fx.side(spark, sf)).cast("int").alias("col"), (F.col("l_suppkey") % 24).alias("hour"))
    hours = census.select("event").distinct().withColumn("hour", F.explode(F.array(F.lit(6), F.lit(18))))
    out = jobs.ring_census_timed(census, timed, hours, 20, 1)
    return out.groupBy("event").agg(F.count(F.lit(1)).alias("rows"), F.sum("flooded").alias("positives"))


@query(
    "C03_event_table",
    fx.sql("frames", "anchors") + """, a as (select event, epoch(strptime(event, '%Y%m%d'))::bigint // 60 + hour * 60 as anchor from anchors),
      j as (select f.*, anchor, min(case when stamp > anchor then stamp end) over w as nxt, max(stamp) over w as last from frames f left join a using (event) window w as (partition by event, pt)),
      k as (select *, coalesce(stamp <= coalesce(nxt, last), true) as keep from j), n as (select *, sum(keep::int) over (partition by event, pt) as lft from k),
      cut as (select event, pt, stamp, span_min, rate from n where keep or lft < 2), rain as (with """ + _accumulate_sql("cut", "desc")[2:] + "), shape as (with " + _shape_sql("cut")[2:] + """),
      own as (select distinct event, pt, case when pt % 4 = 0 then '2024010' || (1 + pt % 9) end as own_event from frames)
      select rain.*, shape.* exclude (event, pt) from own join rain using (event, pt) join shape using (event, pt) where own_event is null or own_event = own.event""",
)
def c03(spark, sf):
    frames = fx.frames(spark, sf)
    at = fx.anchors(spark, sf).select("event", (F.floor(F.unix_timestamp(F.to_timestamp("event", "yyyyMMdd")) / 60) + F.col("hour") * 60).alias("anchor"))
    own = F.when(F.col("pt") % 4 == 0, F.concat(F.lit("2024010"), (1 + F.col("pt") % 9).cast("string")))
    places = frames.select("event", "pt").distinct().withColumn("own_event", own)
    return rounded(jobs.event_table(frames, at, places))


def _zones(spark, sf):
    return fx.zone_edges(spark, sf)


def _station_rain(spark, sf):
    p = fx.xy(spark, sf).where("id % 10 = 0")
    zones = F.explode(F.array(*map(F.lit, "abc"))).alias("event")
    return p.select(F.col("id").alias("station"), "x", "y", F.col("label"), zones).select("station", "x", "y", "event", F.when((F.col("label") + F.ascii("event")) % 3 != 0, F.col("label") * 10.0).alias("rain_24h"))


@query(
    "C04_building_event_table",
    fx.sql("xy", "zone_edges") + ", " + _INSIDE + ", " + _SEG + """, l as (select id, zone as event, max(f)::int as flood, min(d) as d from (select id, zone, 1 as f, 0.0::double as d from inside union all select id, zone, 0, d from seg where d <= 1.5) group by 1, 2),
      st as (select id as station, x, y, event, label * 10.0::double as rain_24h from xy, (select unnest(['a', 'b', 'c']) as event) where id % 10 = 0 and (label + ascii(event)) % 3 <> 0),
      n as (select l.id, l.event, l.flood, l.d, arg_min(st.station, (sqrt(pow(st.x - p.x, 2) + pow(st.y - p.y, 2)), st.station)) as q_id from l join xy p using (id) join st on st.event = l.event and sqrt(pow(st.x - p.x, 2) + pow(st.y - p.y, 2)) <= 5 group by 1, 2, 3, 4)
      select n.id, n.event, flood, round(d, 6) as flood_dist, q_id, rain_24h from n join st on st.station = q_id and st.event = n.event""",
)
def c04(spark, sf):
    return rounded(jobs.building_event_table(fx.xy(spark, sf), _zones(spark, sf), _station_rain(spark, sf), 1.5, 2.0, 5.0))


@query(
    "C05_matched_controls",
    fx.sql("xy", "cells") + ", cases as (select * from xy where id % 5 = 0), " + annulus_sql(3, "f.kind = 'flood' and f.id % 3 = 0") + """,
      placed as (select row_number() over () as n, * from (select case_id, x, y, 0::int as label from controls union all select id, x, y, 1 from cases)),
      wet as (select b.*, (select arg_min(q.label * 7.0::double, (sqrt(pow(q.x + 0.1 - b.x, 2) + pow(q.y - b.y, 2)), q.id)) from xy q where sqrt(pow(q.x + 0.1 - b.x, 2) + pow(q.y - b.y, 2)) <= 1) as rain_6h from placed b)
      select case_id, w.label, round(x, 6) as x, round(y, 6) as y, rain_6h, z from wet w join cells on row = floor((10 - y) / 0.5) and col = floor((x + 10) / 0.5) where rain_6h is not null and z > 0""",
)
def c05(spark, sf):
    p = fx.xy(spark, sf)
    rain = p.select((F.col("id") + 10**6).alias("id"), (F.col("x") + 0.1).alias("x"), "y", (F.col("label") * 7.0).alias("rain_6h"))
    return rounded(jobs.matched_controls(p.where("id % 5 = 0"), p.where("kind = 'flood' and id % 3 = 0"), rain, fx.cells(spark, sf).select("row", "col", "z"), fx.grid(spark, sf), 3, 0.3, 2.0, 1.0)).drop("id")


@query(
    "C06_building_sample",
    fx.sql("xy", "zone_edges") + ", " + _INSIDE + ", " + _SEG + """, near as (select id from inside union select id from seg where d <= 1), dry as (select id, row_number() over (order by id) - 1 as r from xy where id not in (select id from near))
      select distinct id, 1::int as flooded, 1.0::double as sample_weight from inside union all select id, 0, 6.0 from dry where r % 6 = 0""",
)
def c06(spark, sf):
    return jobs.building_sample(fx.xy(spark, sf), _zones(spark, sf), 1.0, 2.0, 6)


@query(
    "C07_basement_overlap",
    fx.sql("xy", "zone_edges") + ", " + _INSIDE + """, y as (select id, count(*) as floods, min(case zone when 'a' then 2005 when 'b' then 2012 else 2020 end)::int as first_year, max(case zone when 'a' then 2005 when 'b' then 2012 else 2020 end)::int as last_year from inside group by 1)
      select xy.id, label % 4 as province, floods, first_year, last_year, case when 2000 + label * 3 > last_year then 'NO' when 2000 + label * 3 > first_year then 'PARTIAL' else 'YES' end as status from xy join y using (id)""",
)
def c07(spark, sf):
    b = fx.xy(spark, sf).withColumns({"province": F.col("label") % 4, "approved": 2000 + F.col("label") * 3})
    years = _zones(spark, sf).select("zone").distinct().withColumn("year", F.when(F.col("zone") == "a", 2005).when(F.col("zone") == "b", 2012).otherwise(2020))
    return jobs.basement_overlap(b, _zones(spark, sf), years, 2.0)


@query(
    "C08_parking_risk",
    fx.sql("xy", "zone_edges") + ", " + _INSIDE + ", " + _SEG + """, n as (select p.id, arg_min(q.label, (sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)), q.id)) * 3.0::double as rel from xy p join xy q on p.id % 4 = 0 and q.id % 4 <> 0 and sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) <= 0.6 group by 1),
      f as (select id, min(d) as d from (select id, d from seg where d <= 2 union all select id, 0 from inside) group by 1),
      b as (select xy.id, rel, case when rel is null then 'UNKNOWN' when rel <= 2 then 'VERY_HIGH' when rel <= 5 then 'HIGH' when rel <= 10 then 'MODERATE' when rel <= 20 then 'LOW' else 'VERY_LOW' end as band, d * 1000 as flood_m from xy left join n using (id) left join f using (id) where xy.id % 4 = 0)
      select id, rel, band, round(flood_m, 6) as flood_m, case when band <> 'UNKNOWN' and flood_m <= 500 then case band when 'VERY_LOW' then 'LOW' when 'LOW' then 'MODERATE' when 'MODERATE' then 'HIGH' else 'VERY_HIGH' end else band end as risk from b""",
)
def c08(spark, sf):
    p = fx.xy(spark, sf)
    out = jobs.parking_risk(p.where("id % 4 = 0"), p.where("id % 4 <> 0").withColumn("rel", F.col("label") * 3.0), _zones(spark, sf), 0.6, 2.0, 2.0, 1000.0)
    return rounded(out.select("id", "rel", "band", "flood_m", "risk"))


@query(
    "C09_register_features",
    fx.sql("register") + """, r as (select parcel, max(price) as max_price, max(area) as max_area, count(*) as rows from register group by 1)
      select c_custkey as parcel, (c_nationkey + 1)::double as x, 0.5::double as y, 2.0::double as footprint, coalesce(rows, 0) as rows, case when r.parcel is null then 'GIS_ONLY' else 'REGISTER' end as register, max_price, round(max_area / 2, 6) as floor_ratio from customer left join r on r.parcel = c_custkey""",
)
def c09(spark, sf):
    p = lambda dx, dy: F.struct((F.col("c_nationkey") + dx).cast("double").alias("x"), F.lit(float(dy)).alias("y"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("parcel"), F.array(F.array(p(0, 0), p(2, 0), p(2, 1), p(0, 1))).alias("rings"))
    out = jobs.building_register_features(b, fx.register(spark, sf))
    return rounded(out.select("parcel", "x", "y", "footprint", "rows", "register", "max_price", "floor_ratio"))


@query(
    "C10_enrich",
    """with t as (select o_orderkey as id, o_orderpriority as region from orders), x as (select o_orderkey as id, o_totalprice as v from orders where o_orderkey % 4 <> 0), j as (select id, region, v, count(v) over (partition by region) as n, row_number() over (partition by region order by v nulls last, id) - 1 as p from t left join x using (id))
       select id, region, v, case when v is not null and n >= 10 then round(p / greatest(n - 1, 1), 6) end as v_rank from j""",
)
def c10(spark, sf):
    o = table(spark, sf, "orders")
    base = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("region"))
    extra = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return rounded(jobs.enrich(base, extra, ["id"], ["v"], "region"))


_ASSESS = fx.sql("xy", "cells") + """, c as (select id, x, y, floor((10 - y) / 0.5)::bigint as r, floor((x + 10) / 0.5)::bigint as k from xy where id % 3 = 0),
      g as (select c.id, c.x, c.y, case when score >= 0.95 then 'VERY_HIGH' when score >= 0.9 then 'HIGH' when score is not null then 'VERY_LOW' else 'UNKNOWN' end as risk from c left join cells on r = row and k = col),
      n as (select g.id, arg_min(s.label, (sqrt(pow(s.x - g.x, 2) + pow(s.y - g.y, 2)), s.id)) as l from g join xy s on s.id % 3 = 1 and s.label < 8 and sqrt(pow(s.x - g.x, 2) + pow(s.y - g.y, 2)) <= 0.8 group by 1),
      w as (select g.id, risk, l is not null as ok, case when coalesce(l * 9, 0) >= 72 or (coalesce(l * 9, 0) >= 50 and coalesce(l * 14, 0) >= 90) then 'EXTREME' when coalesce(l * 14, 0) >= 90 or coalesce(l * 20, 0) >= 180 then 'WARNING' when coalesce(l * 14, 0) >= 60 or coalesce(l * 20, 0) >= 110 then 'ADVISORY' else 'NONE' end as level from g left join n using (id)),
      a as (select *, case level when 'NONE' then 0 when 'ADVISORY' then 1 when 'WARNING' then 2 else 3 end - case risk when 'VERY_HIGH' then 1 when 'HIGH' then 1 when 'VERY_LOW' then 3 else 2 end as gap from w)"""


@query("C11_assess", _ASSESS + " select id, risk, level, case when risk = 'UNKNOWN' or not ok then 'UNKNOWN' when level = 'NONE' then 'CALM' when gap >= 2 then 'EVACUATE' when gap = 1 then 'PREPARE' else 'WATCH' end as alert from a")
def c11(spark, sf):
    p, n = fx.xy(spark, sf), F.col("label")
    stations = p.where("id % 3 = 1 and label < 8").select("id", "x", "y", (n * 9.0).alias("mm1h"), (n * 14.0).alias("mm3h"), (n * 20.0).alias("mm12h"))
    out = jobs.assess(p.where("id % 3 = 0"), fx.cells(spark, sf), fx.grid(spark, sf), stations, p.where("id % 3 = 2"), [("VERY_HIGH", 0.95), ("HIGH", 0.9)], 0.8, 1.5)
    return out.select("id", "risk", "level", "alert")


def _lines(spark, sf):
    e = fx.zone_edges(spark, sf)
    return e.select(F.when(F.col("ord") == 2, "major").otherwise("minor").alias("kind"), F.concat("zone", F.col("ring").cast("string"), F.lit("-"), F.col("i").cast("string")).alias("line"), "x1", "y1", "x2", "y2")


def _river(points: str, reach: int) -> str:
    """Heights of ``points`` (id, x, y, z) above the ground at the nearest line of each class."""
    return f"""foot as (select *, x1 + t * (x2 - x1) as fx, y1 + t * (y2 - y1) as fy from (
        select p.id, p.x, p.y, p.z, case when ord = 2 then 'major' else 'minor' end as kind, zone || ring || '-' || i as line, x1, y1, x2, y2,
          greatest(0, least(1, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) as t from {points} p, zone_edges)),
      near as (select id, kind, any_value(z) as z, arg_min((fx, fy), (sqrt(pow(x - fx, 2) + pow(y - fy, 2)), line)) as f from foot where sqrt(pow(x - fx, 2) + pow(y - fy, 2)) <= {reach} group by 1, 2),
      above as (select id, max(near.z - c.z) filter (kind = 'major') as above_major, max(near.z - c.z) filter (kind = 'minor') as above_minor from near
        left join cells c on c.row = floor((10 - f[2]) / 0.5) and c.col = floor((f[1] + 10) / 0.5) group by 1)"""


def _rel(radii) -> str:
    """Heights of cells over the lowest ground of windows."""
    return "rels as (select a.row, a.col, " + ", ".join(f"a.z - min(b.z) filter (abs(b.row - a.row) <= {r} and abs(b.col - a.col) <= {r}) as rel_{r}" for r in radii) + f" from cells a join cells b on b.row between a.row - {max(radii)} and a.row + {max(radii)} and b.col between a.col - {max(radii)} and a.col + {max(radii)} group by a.row, a.col, a.z)"


def _surface_sql(where: str) -> str:
    rels = ", ".join(f"round(rel_{r}, 6) as rel_{r}" for r in (1, 2, 4, 8))
    return (
        fx.sql("cells", "zone_edges")
        + ", "
        + _rel((1, 2, 4, 8))
        + """, pts as (
        select row::bigint * (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem) + col as id, row, col, z, -10 + (col + 0.5) * 0.5 as x, 10 - (row + 0.5) * 0.5 as y
        from cells), xy as (select * from pts), """
        + ", ".join((_INSIDE, _SEG, _river("pts", 3)))
        + f""",
      fl as (select id, min(d) as d from (select id, d from seg where d <= 3 union all select id, 0 from inside) group by 1)
      select p.id, p.row, p.col, p.z, p.x, p.y, {rels}, round(fl.d, 6) as flood_dist, round(above_major, 6) as above_major, round(above_minor, 6) as above_minor,
        round(1 / (1 + greatest(rel_2, 0)), 6) as score
      from pts p join rels using (row, col) left join fl using (id) left join above using (id) where {where}"""
    )


def _surface(spark, sf, buffer=None):
    score = 1 / (1 + F.greatest(F.col("rel_2"), F.lit(0.0)))
    cells, lines, edges = fx.cells(spark, sf).select("row", "col", "z"), _lines(spark, sf), fx.zone_edges(spark, sf)
    return rounded(jobs.risk_surface(cells, lines, edges, fx.grid(spark, sf), [1, 2, 4, 8], 3.0, 2.0, score, buffer=buffer))


@query("R11_risk_surface", _surface_sql("true"))
def r11(spark, sf):
    return _surface(spark, sf)


@query("R11_gated_surface", _surface_sql("fl.d <= 1.5"))
def r11b(spark, sf):
    return _surface(spark, sf, 1.5)


@query(
    "R12_building_features",
    fx.sql("xy", "cells", "zone_edges") + ", " + _rel((1, 3)) + """, b as (select id, x, y, c.z, rel_1, rel_3 from xy left join cells c on c.row = floor((10 - y) / 0.5) and c.col = floor((x + 10) / 0.5) left join rels using (row, col)), """ + _river("b", 4) + """
      select id, round(x, 6) as x, round(y, 6) as y, z, round(rel_1, 6) as rel_1, round(rel_3, 6) as rel_3, round(above_major, 6) as above_major, round(above_minor, 6) as above_minor from b left join above using (id)""",
)
def r12(spark, sf):
    return rounded(jobs.building_features(fx.xy(spark, sf), fx.cells(spark, sf).select("row", "col", "z"), _lines(spark, sf), fx.grid(spark, sf), [1, 3], 4.0))
