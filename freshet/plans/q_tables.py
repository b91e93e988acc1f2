"""Queries of the scans, sinks, descriptions and routes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from freshet.functions import geo
from freshet.operators import graph
from freshet.plans import fixtures as fx
from freshet.plans.registration import Registry
from freshet.session import checkpointed, shared_dir, stored, table
from freshet.sources import tables as src

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("S01_read_table", "select c_custkey, c_name, c_acctbal, case when c_nationkey % 5 <> 0 then c_mktsegment end as c_mktsegment from customer")
def s01(spark, sf):
    place = _place(spark, "s01")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")
    c.write.options(header=True, compression="gzip").csv(place)
    return src.read_table(spark, place, c.schema, columns=["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])


@query("S02_read_features", fx.sql("zone_edges") + " select zone, count(*) as edges, round(sum(x1 * y2 - x2 * y1) / 2, 6) as area from zone_edges where zone like 'q%' group by 1")
def s02(spark, sf):
    """Hexagons written as GeoJSON features, one a line, read back as rings and edges."""
    place = _place(spark, "s02")
    corner = F.struct("i", F.array("x1", "y1").alias("p"))
    ring = fx.zone_edges(spark, sf).where("zone like 'q%'").groupBy("zone", "ord").agg(F.array_sort(F.collect_list(corner)).alias("c"))
    points = F.transform("c", lambda c: c["p"])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(points, F.slice(points, 1, 1))).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("zone").alias("id"), "ord").alias("properties"), geometry.alias("geometry"))
    ring.select(F.concat(F.to_json(feature), F.lit(",")).alias("value")).write.text(place)
    edges = src.ring_edges(src.read_features(spark, place, "id string, ord int", by_line=True), "id", "ord")
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    return edges.groupBy("zone").agg(F.count(F.lit(1)).alias("edges"), F.round(area, 6).alias("area"))


@query("S03_read_buildings", "select c_custkey as id, c_name as name, case when c_custkey % 3 <> 0 then 'survey' end as source_dataset, case when c_custkey % 3 <> 0 then c_mktsegment end as source_record from customer")
def s03(spark, sf):
    place = _place(spark, "s03")
    first = F.struct(F.lit("survey").alias("dataset"), F.col("c_mktsegment").alias("record_id"))
    c = table(spark, sf, "customer")
    c.select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("primary"), F.col("c_mktsegment").alias("common")).alias("names"), F.when(F.col("c_custkey") % 3 != 0, F.array(first, first)).otherwise(F.array().cast("array<struct<dataset:string,record_id:string>>")).alias("sources")).write.parquet(place)
    return src.read_buildings(spark, place, columns=["id"])


@query("S04_read_jsonl", "select s_suppkey, s_name, case when s_suppkey % 4 <> 0 then s_nationkey end as s_nationkey, case when s_suppkey % 4 = 0 then s_acctbal end as s_acctbal from supplier")
def s04(spark, sf):
    """API rows with differing fields, found over all rows."""
    place = _place(spark, "s04")
    s = table(spark, sf, "supplier")
    s.where("s_suppkey % 4 <> 0").select("s_suppkey", "s_name", "s_nationkey").write.json(place)
    s.where("s_suppkey % 4 = 0").select("s_suppkey", "s_name", "s_acctbal").write.mode("append").json(place)
    return src.read_jsonl(spark, place).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("S05_read_glob", "select n_nationkey, n_name, n_regionkey::varchar as region from nation")
def s05(spark, sf):
    """A folder of files for each region, told by its name."""
    place = _place(spark, "s05")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", F.concat(F.lit("part_"), F.col("n_regionkey").cast("string")).alias("region"))
    n.write.partitionBy("region").options(header=True).csv(place)
    return src.read_glob(spark, f"{place}/region=part_*/*.csv", "n_nationkey long, n_name string", r"region=part_(\d+)", "region")


@query("S08_write_by_event", "select year(o_orderdate)::int as event, count(*) as rows, round(sum(case when year(o_orderdate) = 1996 then 0 else o_totalprice end), 2) as total from orders group by 1")
def s08(spark, sf):
    """Orders by year; 1996 is written again with other values, then skipped when it is there."""
    place = _place(spark, "s08")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("event"))
    src.write_by_event(o, place)
    src.write_by_event(o.where("event = 1996").withColumn("o_totalprice", F.lit(0.0)), place)
    src.write_by_event(o.where("event in (1996, 1997)"), place, skip_done=True)
    return spark.read.parquet(place).groupBy("event").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("S10_publish", "select 'table' as form, count(*) as rows, sum(o_orderkey)::bigint as keys from orders union all select 'csv', count(*), sum(o_orderkey)::bigint from orders union all select 'sample', 50, (select sum(o_orderkey)::bigint from (select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 50))")
def s10(spark, sf):
    place = _place(spark, "s10")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("falling"))
    src.publish(o, place, ["falling", "o_orderkey"], 50)
    read = {"table": spark.read.parquet(f"{place}/table"), "csv": spark.read.option("header", True).csv(f"{place}/csv"), "sample": spark.read.option("header", True).csv(f"{place}/sample")}
    sums = [df.agg(F.lit(form).alias("form"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("o_orderkey").cast("long")).alias("keys")) for form, df in read.items()]
    return sums[0].unionByName(sums[1]).unionByName(sums[2])


@query("S06_read_layers", fx.sql("cells") + " select row, col, z, land from cells")
def s06(spark, sf):
    return src.read_layers(fx.cells(spark, sf), ["z", "land"])


@query("S07_read_frames", fx.sql("frames") + " select event, pt, stamp, coalesce(case when stamp % 3 <> 0 then span_min end, 5)::int as span_min from frames where stamp % 11 <> 0")
def s07(spark, sf):
    f = fx.frames(spark, sf).withColumns({"rate": F.when(F.col("stamp") % 11 != 0, F.col("rate")), "span_min": F.when(F.col("stamp") % 3 != 0, F.col("span_min"))})
    return src.read_frames(f, 5).select("event", "pt", "stamp", "span_min")


_GATE = """, r as (select distinct event, stamp from frames), h as (select distinct event, stamp from frames where stamp % 13 <> 0), c as (select r.event, count(*) as asked, count(h.stamp) as got from r left join h using (event, stamp) group by 1)"""


@query("S09_gate_complete", fx.sql("frames") + _GATE + " select event, pt, stamp from frames where stamp % 13 <> 0 and event in (select event from c where got >= 0.9 * asked)")
def s09(spark, sf):
    f = fx.frames(spark, sf)
    return src.gate_complete(f.where("stamp % 13 <> 0"), f)[0].select("event", "pt", "stamp")


@query("S09_missing_stamps", fx.sql("frames") + " select distinct event, stamp from frames where stamp % 13 = 0")
def s09b(spark, sf):
    f = fx.frames(spark, sf)
    return src.gate_complete(f.where("stamp % 13 <> 0"), f)[1]


@query("S11_manifest", fx.sql("census") + " select count(*) as rows, sum(flooded::int)::bigint as positives, round(avg(flooded::int), 9) as rate, count(distinct event) as events, count(case when id % 9 <> 0 then rel end) as known_rel, count(rain) as known_rain from census")
def s11(spark, sf):
    df = fx.census(spark, sf).withColumn("rel", F.when(F.col("id") % 9 != 0, F.col("rel")))
    return src.manifest(df, F.col("flooded"), "event", ["rel", "rain"]).withColumn("rate", F.round("rate", 9))


@query(
    "S11_manifest_by_event",
    fx.sql("census")
    + """ select event, count(*) as rows, sum(flooded::int)::bigint as positives, round(avg(flooded::int), 9) as rate,
        count(case when id % 9 <> 0 then rel end) as known_rel, round(avg(case when id % 9 <> 0 then rel end), 6) as mean_rel from census group by 1""",
)
def s11b(spark, sf):
    df = fx.census(spark, sf).withColumn("rel", F.when(F.col("id") % 9 != 0, F.col("rel")))
    out = src.manifest_by_event(df, F.col("flooded"), "event", ["rel"])
    return out.withColumns({"rate": F.round("rate", 9), "mean_rel": F.round("mean_rel", 6)})


@query("S12_fingerprint", "select count(*) as rows, sum(('0x' || substr(md5(concat_ws('|', o_custkey, o_orderkey, coalesce(case when o_custkey % 7 <> 0 then o_orderstatus end, '\\N'))), 1, 15))::bigint)::varchar as content from orders")
def s12(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return src.fingerprint(o)


@query("S13_profiles", "select 'customer' as name, (select count(*) from customer) as rows, 5::int as columns union all select 'nation', (select count(*) from nation), 3 union all select 'orders', (select count(*) from orders), 6")
def s13(spark, sf):
    return src.profile_tables({n: table(spark, sf, n) for n in ("orders", "customer", "nation")}).select("name", "rows", "columns")


@query(
    "S13_catalog",
    """select 'cells' as name, 'OK' as status, (select count(*) from lineitem) as rows, 'EPSG:5179' as crs
      union all select 'gone', 'MISSING', null, 'EPSG:4326' union all select 'points', 'OK', (select count(*) from embeddings), 'EPSG:4326' union all select 'people', 'OK', (select count(*) from customer), null""",
)
def s13b(spark, sf):
    at = lambda n: f"{sf}/{n}.parquet"
    found = src.catalog(spark, {"cells": (at("lineitem"), "EPSG:5179"), "points": (at("embeddings"), "EPSG:4326"), "people": (at("customer"), None), "gone": (at("no_such_table"), "EPSG:4326")})
    return found.where("status = 'MISSING' or bytes > 0").select("name", "status", "rows", "crs")


_PACK = """, t as (select row, col, case when land % 97 = 0 then null else least(score, 1) end as score, case when land % 7 = 0 then null else z end as z, acc * 40.0 as dist_m from cells),
      p as (select row, col, case when score is null then 0 else greatest(1, least(255, round_even(score * 254, 0) + 1)) end::int as score_u8, case when z is null then -32768 else round_even(round_even(z, 1) * 10, 0) end::int as z_dm, case when dist_m <= 1500 then round_even(dist_m / 20, 0) else 65535 end::int as dist_20m from t)"""


def _to_pack(spark, sf):
    c = fx.cells(spark, sf)
    return c.select("row", "col", F.when(F.col("land") % 97 != 0, F.least("score", F.lit(1.0))).alias("score"), F.when(F.col("land") % 7 != 0, F.col("z")).alias("z"), (F.col("acc") * 40.0).alias("dist_m"))


@query("S14_pack_grid", fx.sql("cells") + _PACK + " select * from p")
def s14(spark, sf):
    return src.pack_grid(_to_pack(spark, sf), 1500)


@query("S15_unpack_grid", fx.sql("cells") + _PACK + " select row, col, round(case when score_u8 <> 0 then (score_u8 - 1) / 254 end, 9) as score, round(case when z_dm <> -32768 then z_dm / 10 end, 6) as z, case when dist_20m <> 65535 then dist_20m * 20.0::double end as dist_m from p")
def s15(spark, sf):
    return src.unpack_grid(src.pack_grid(_to_pack(spark, sf), 1500)).withColumns({"score": F.round("score", 9), "z": F.round("z", 6)})


_H = repr(geo.MERCATOR_HALF)


@query(
    "S16_tiles",
    fx.sql("points") + f""", m as (select lon * ({_H} / 180) as x, ln(tan(pi() / 4 + radians(lat) / 2)) * ({_H} / pi()) as y, id % 4 as v from points), p as (select floor((x + {_H}) / (2 * {_H} / (256 * 64)))::bigint as px, floor(({_H} - y) / (2 * {_H} / (256 * 64)))::bigint as py, v from m),
      q as (select px, py, max(v) as v from p group by 1, 2) select px // 256 as tx, py // 256 as ty, count(*) as pixels, sum(v)::bigint as total from q where v > 0 group by 1, 2""",
)
def s16(spark, sf):
    m = fx.points(spark, sf).withColumn("m", geo.to_3857(F.col("lon"), F.col("lat"))).withColumn("t", geo.tile_of(F.col("m.x"), F.col("m.y"), 6))
    pixels = m.groupBy(F.lit(0).alias("level"), F.lit(6).alias("z"), "t.tx", "t.ty", "t.px", "t.py").agg(F.max(F.col("id") % 4).alias("v"))
    out = src.tiles(pixels, "v")
    band = lambda c: F.aggregate("band", F.lit(0).cast("long"), c)
    return out.select("tx", "ty", band(lambda a, v: a + F.when(v > 0, 1).otherwise(0)).alias("pixels"), band(lambda a, v: a + v).alias("total"))


@query("P39_conform", "select count(*) filter (ok) as good, count(*) filter (not ok) as bad from (select o_orderkey is not null and o_orderstatus in ('F', 'O') and o_totalprice between 1000 and 300000 as ok from orders)")
def p39(spark, sf):
    o = table(spark, sf, "orders")
    good, bad = src.conform(o, o.schema, "o_orderkey", {"o_orderstatus": ["F", "O"]}, {"o_totalprice": (1000.0, 300000.0)})
    return good.agg(F.count(F.lit(1)).alias("good")).crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("bad"))))


@query("P40_expect", "select 'countries' as rule, (select count(distinct n_regionkey)::varchar from nation) as value, '5' as expected, (select count(distinct n_regionkey) from nation) = 5 as ok union all select 'rows', (select count(*)::varchar from nation), '26', (select count(*) from nation) = 26")
def p40(spark, sf):
    return src.expect(table(spark, sf, "nation"), {"countries": (F.count_distinct("n_regionkey"), 5), "rows": (F.count(F.lit(1)), 26)})


@query("P41_no_leak", fx.sql("census") + " select id, rel from census where event <> 3")
def p41(spark, sf):
    df = fx.census(spark, sf).withColumn("event", F.when(F.col("event") != 3, F.col("event")))
    return src.no_leak(df, ["flooded", "rain"], "event").select("id", "rel")


def _sssp_sql(where: str) -> str:
    return fx.sql("edges").replace("with ", "with recursive ", 1) + f""", e as (select src, dst, min(len) as len from edges where {where} group by 1, 2),
      d(node, dist) using key (node) as (select 0::bigint, 0.0::double union (select e.dst, min(d.dist + e.len) from d join e on d.node = e.src left join recurring.d as r on r.node = e.dst where r.dist is null or d.dist + e.len < r.dist group by e.dst))"""


@query("R13_sssp", _sssp_sql("true") + " select node, dist from d")
def r13(spark, sf):
    return graph.distances(graph.simplest(fx.edges(spark, sf), "len"), 0).select("node", "dist")


@query("R13_sssp_avoiding", _sssp_sql("not blocked") + " select node, dist from d")
def r13b(spark, sf):
    return graph.distances(graph.simplest(fx.edges(spark, sf).where("not blocked"), "len"), 0).select("node", "dist")


#: A road in every seventh order's place runs through high risk for half its length, in every eleventh through very high.
_RISKY = "len + 5 * (case when edge_id % 7 = 0 then len / 2 else 0 end) + 12 * (case when edge_id % 11 = 0 then len / 2 else 0 end)"


def _risky(edges):
    part = lambda k: F.when(F.col("edge_id") % k == 0, F.col("len") / 2).otherwise(0.0)
    return edges.withColumn("cost", graph.risk_cost(F.col("len"), part(7), part(11)))


def _many_sql(weight: str, where: str, bound: float) -> str:
    """d (source, node, dist): from every hundredth node, up to a bound."""
    return (
        fx.sql("edges").replace("with ", "with recursive ", 1)
        + f""", e as (select src, dst, min({weight}) as w from edges where {where} group by 1, 2),
      d(source, node, dist) using key (source, node) as (
        select distinct src, src, 0.0::double from e where src % 100 = 0
        union
        select d.source, e.dst, min(d.dist + e.w) from d join e on d.node = e.src
          left join recurring.d as r on r.source = d.source and r.node = e.dst
        where d.dist + e.w <= {bound} and (r.dist is null or d.dist + e.w < r.dist) group by d.source, e.dst)"""
    )


def _many(edges, weight: str, bound: float):
    roads = graph.simplest(edges, weight)
    return graph.distances_from(roads, roads.where("src % 100 = 0").select(F.col("src").alias("source")).distinct(), bound)


@query("R13_risk_cost", _many_sql(_RISKY, "not blocked", 4000) + " select source, node, round(dist, 6) as cost from d")
def r13c(spark, sf):
    found = _many(_risky(fx.edges(spark, sf)).where("not blocked"), "cost", 4000.0)
    return found.select("source", "node", F.round("dist", 6).alias("cost"))


@query("R13_many_sources", _many_sql("len", "true", 4000) + " select source, node, dist from d")
def r13d(spark, sf):
    return _many(fx.edges(spark, sf), "len", 4000.0).select("source", "node", "dist")


def _route_sql(where: str, d: str, t: str) -> str:
    """Distances ``d`` and, along each path, ``t`` (node, edges, blocked): fewest edges first, then the least edge id."""
    return f"""{d}e as (select src, dst, arg_min(edge_id, (len, edge_id)) as edge_id, min(len) as len, arg_min(blocked::int, (len, edge_id)) as blocked from edges where {where} group by 1, 2),
      {d}(node, dist) using key (node) as (select 0::bigint, 0.0::double union (select e.dst, min(d.dist + e.len) from {d} d join {d}e e on d.node = e.src left join recurring.{d} as r on r.node = e.dst where r.dist is null or d.dist + e.len < r.dist group by e.dst)),
      {d}t as (select e.* from {d}e e join {d} a on a.node = e.src join {d} b on b.node = e.dst where a.dist + e.len = b.dist),
      {t}(node, edges, blocked) using key (node) as (select 0::bigint, 0::bigint, 0::bigint union (select e.dst, min(p.edges) + 1, arg_min(p.blocked + e.blocked, e.edge_id) from {t} p join {d}t e on e.src = p.node left join recurring.{t} as r on r.node = e.dst where r.node is null group by e.dst))"""


_ROUTES = fx.sql("edges").replace("with ", "with recursive ", 1)


@query("R14_route_metrics", _ROUTES + ", " + _route_sql("true", "d", "t") + " select node, dist as length, edges, blocked::bigint as blocked_edges, round(dist * 2, 6) as cost from d join t using (node)")
def r14(spark, sf):
    e = fx.edges(spark, sf)
    out = graph.route_metrics(graph.sssp(e, 0), e, {"cost": F.col("len") * 2})
    return out.select("node", "length", "edges", F.col("blocked_edges").cast("long").alias("blocked_edges"), F.round("cost", 6).alias("cost"))


@query("R15_choose_destination", _sssp_sql("not blocked") + ", c as (select node as id, node, (node * 37 % 5000)::double as dist_m from d where node % 3 = 1), n as (select * from c where dist_m <= 4000 and id % 5 <> 0 order by dist_m, id limit 25) select id, d.dist as cost from n join d using (node) order by cost, id limit 1")
def r15(spark, sf):
    paths = checkpointed(graph.sssp(fx.edges(spark, sf), 0, avoid_blocked=True))
    c = paths.where("node % 3 = 1").select(F.col("node").alias("id"), "node", (F.col("node") * 37 % 5000).cast("double").alias("dist_m"))
    return graph.choose_destination(paths, c, c.where("id % 5 = 0"), 4000.0).select("id", "cost")


@query(
    "R15_choose_destinations",
    _many_sql(_RISKY, "not blocked", 4000)
    + """, c as (select source, node as id, node, ((node * 37 + source * 11) % 5000)::double as dist_m from d where node % 3 = 1),
      n as (select *, row_number() over (partition by source order by dist_m, id) as n from c where dist_m <= 4000 and id % 5 <> 0)
      select source, arg_min(id, (d.dist, id)) as id, round(min(d.dist), 6) as cost from n join d using (source, node) where n <= 25 group by source""",
)
def r15b(spark, sf):
    paths = stored(_many(_risky(fx.edges(spark, sf)).where("not blocked"), "cost", 4000.0))
    c = paths.where("node % 3 = 1").select("source", F.col("node").alias("id"), "node", ((F.col("node") * 37 + F.col("source") * 11) % 5000).cast("double").alias("dist_m"))
    inside = c.where("id % 5 = 0").select("id").distinct()
    return graph.choose_destinations(paths, c, inside, 4000.0).select("source", "id", F.round("cost", 6).alias("cost"))


@query("R16_nearest_safe", _many_sql("len", "not blocked", 4000) + " select source as origin, arg_min(node, (dist, node)) as id, min(dist) as length from d where dist >= 25 and node % 5 <> 0 group by 1")
def r16(spark, sf):
    found = _many(fx.edges(spark, sf).where("not blocked"), "len", 4000.0)
    return graph.nearest_safe(found.where("node % 5 <> 0").select(F.col("source").alias("origin"), F.col("node").alias("id"), F.col("dist").alias("length")))


@query(
    "R17_route_doc",
    _ROUTES + ", " + _route_sql("true", "d", "t") + ", " + _route_sql("not blocked", "d2", "t2") + """,
      m as (select d.node, d.dist as bm, t.blocked as bb, d2.dist as sm, t2.blocked as sb, t.blocked > 0 and t2.blocked = 0 as avoided from d join t using (node) left join d2 on d2.node = d.node left join t2 on t2.node = d.node)
      select node, '{' || concat_ws(',', case when avoided is not null then '"avoided":' || avoided end, '"base_blocked":' || bb, case when sb is not null then '"safe_blocked":' || sb end,
        '"base_minutes":' || greatest(1, ceil(bm / 250))::bigint, '"safe_minutes":' || coalesce(greatest(1, ceil(sm / 250)), 1)::bigint, '"status":"' || case when sm is null then 'NO_ROUTE' else 'FOUND' end || '"') || '}' as doc from m""",
)
def r17(spark, sf):
    e = fx.edges(spark, sf)
    base, safe = graph.sssp(e, 0), graph.sssp(e, 0, avoid_blocked=True)
    return graph.route_doc(graph.route_metrics(base, e), graph.route_metrics(safe, e))
