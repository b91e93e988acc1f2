"""Queries of the keyed joins, samplers and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import relational as rel
from freshet.plans import fixtures as fx
from freshet.plans.registration import Registry
from freshet.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("J01_attach_labels", "with l as (select user_id, arg_max(event_type, (ts, event_id)) as label from events where value > 20 group by 1) select event_id, label from events join l using (user_id)")
def j01(spark, sf):
    e = table(spark, sf, "events")
    labels = e.where("value > 20").select("user_id", F.col("event_type").alias("label"), "ts", F.col("event_id").alias("eid"))
    return rel.attach_labels(e.select("event_id", "user_id"), labels, ["user_id"], F.struct("ts", "eid")).select("event_id", "label")


@query("J02_attach_register", "with p as (select o_custkey, count(*) as n, max(o_totalprice) as top from orders where o_orderstatus = 'P' group by 1) select c_custkey as parcel, coalesce(n, 0) as n, coalesce(top, 0) as top, case when n is null then 'GIS_ONLY' else 'REGISTER' end as status from customer left join p on c_custkey = o_custkey")
def j02(spark, sf):
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("parcel"))
    p = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("parcel")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")).withColumn("status", F.lit("REGISTER"))
    return rel.attach_register(b, p, "parcel", {"n": 0, "top": 0.0, "status": "GIS_ONLY"})


@query("J03_keep_wanted", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_size > 45)")
def j03(spark, sf):
    wanted = table(spark, sf, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return rel.keep_wanted(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), wanted, ["l_partkey"])


@query("J04_drop_by_place", fx.sql("points") + ", p as (select id, round(lon, 1) as lon, round(lat, 1) as lat, id % 3 as event from points) select id from p where id % 11 <> 0 and not exists (select 1 from p b where b.id % 11 = 0 and b.event = p.event and round(b.lon, 5) = round(p.lon, 5) and round(b.lat, 5) = round(p.lat, 5))")
def j04(spark, sf):
    p = fx.points(spark, sf).select("id", F.round("lon", 1).alias("lon"), F.round("lat", 1).alias("lat"), (F.col("id") % 3).alias("event"))
    return rel.drop_by_place(p.where("id % 11 <> 0"), p.where("id % 11 = 0")).select("id")


@query("J05_flag_hits", "select o_orderkey as id, (o_custkey in (select c_custkey from customer where c_acctbal < 0))::int as hit from orders")
def j05(spark, sf):
    hits = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return rel.flag_hits(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), hits, ["o_custkey"]).select("id", "hit")


@query(
    "J06_attach_layers",
    fx.sql("xy", "cells") + ", c as (select id, floor((10 - y) / 0.5)::bigint as r, floor((x + 10) / 0.5)::bigint as k from xy) select id, z, case when land >= 800 then null else land end as land from c left join cells on r = row and k = col",
)
def j06(spark, sf):
    out = rel.attach_layers(fx.xy(spark, sf).select("id", "x", "y"), fx.cells(spark, sf), fx.grid(spark, sf), {"z": None, "land": F.col("land") >= 800})
    return out.select("id", "z", "land")


@query("J06_coverage", fx.sql("xy", "cells") + ", c as (select id, floor((10 - y) / 0.5)::bigint as r, floor((x + 10) / 0.5)::bigint as k from xy) select round(count(z) * 100.0 / count(*), 6) as z, round(count(case when land < 800 then land end) * 100.0 / count(*), 6) as land from c left join cells on r = row and k = col")
def j06b(spark, sf):
    out = rel.attach_layers(fx.xy(spark, sf).select("id", "x", "y"), fx.cells(spark, sf), fx.grid(spark, sf), {"z": None, "land": F.col("land") >= 800})
    return rel.coverage(out, ["z", "land"]).select(F.round("z", 6).alias("z"), F.round("land", 6).alias("land"))


@query("J18_label_cells", fx.sql("cells") + ", f as (select distinct (l_orderkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as row, (l_partkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as col from lineitem where l_quantity = 50 and l_discount = 0.1) select cells.row, cells.col, (f.row is not null)::int as flooded from cells left join f using (row, col)")
def j18(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity = 50 and l_discount = 0.1")
    f = li.select((F.col("l_orderkey") % fx.side(spark, sf)).cast("int").alias("row"), (F.col("l_partkey") % fx.side(spark, sf)).cast("int").alias("col"))
    return rel.label_cells(fx.cells(spark, sf).select("row", "col"), f, ["row", "col"])


@query(
    "J19_active_on",
    """with s as (select user_id % 20 as station, case when event_id % 5 = 0 then null else ts::date end as d0, case when event_id % 7 = 0 then null else ts::date + 5 end as d1, event_id as site from events where event_id % 40 = 0),
       d as (select distinct user_id % 20 as station, ts::date as day from events where event_id % 3 = 0)
       select d.station, strftime(d.day, '%Y%m%d') as day, arg_max(site, (d0 is not null, coalesce(d0, date '1900-01-01'), site)) as site from d join s on s.station = d.station and (d0 is null or d0 <= day) and (d1 is null or d1 >= day) group by 1, 2""",
)
def j19(spark, sf):
    e = table(spark, sf, "events").withColumn("station", F.col("user_id") % 20).withColumn("d", F.to_date("ts"))
    s = e.where("event_id % 40 = 0").select("station", F.when(F.col("event_id") % 5 != 0, F.col("d")).alias("start"), F.when(F.col("event_id") % 7 != 0, F.date_add("d", 5)).alias("end"), F.col("event_id").alias("site"))
    days = e.where("event_id % 3 = 0").select("station", F.col("d").alias("day")).distinct()
    return rel.active_on(s, days).withColumn("day", F.date_format("day", "yyyyMMdd"))


@query(
    "J20_cut_at_anchor",
    fx.sql("frames", "anchors") + """, a as (select event, epoch(strptime(event, '%Y%m%d'))::bigint // 60 + hour * 60 as anchor from anchors where hour % 5 <> 0), j as (select f.*, anchor, min(case when stamp > anchor then stamp end) over w as nxt, max(stamp) over w as last from frames f left join a using (event) window w as (partition by event, pt)),
      k as (select *, coalesce(stamp <= coalesce(nxt, last), true) as keep from j), n as (select *, sum(keep::int) over (partition by event, pt) as lft from k)
      select event, pt, stamp from n where keep or lft < 2""",
)
def j20(spark, sf):
    at = fx.anchors(spark, sf).where("hour % 5 <> 0").select("event", (F.floor(F.unix_timestamp(F.to_timestamp("event", "yyyyMMdd")) / 60) + F.col("hour") * 60).alias("anchor"))
    return rel.cut_at_anchor(fx.frames(spark, sf), at).select("event", "pt", "stamp")


@query("J21_level_and_rise", fx.sql("obs") + " select a.station, a.hour, round(a.mm, 6) as level, round(a.mm - b.mm, 6) as rise from obs a left join obs b on b.station = a.station and b.hour = a.hour - 6")
def j21(spark, sf):
    o = fx.obs(spark, sf)
    out = rel.level_and_rise(o.withColumnRenamed("mm", "level"), o.select("station", "hour"))
    return out.select("station", "hour", F.round("level", 6).alias("level"), F.round("rise", 6).alias("rise"))


@query("J22_bin_join", fx.sql("census") + " select case when rel < 0 then null when rel < 2 then 0 when rel < 5 then 1 when rel < 10 then 2 when rel < 20 then 3 when rel < 60 then 4 end::int as bin, count(*) as n from census group by 1")
def j22(spark, sf):
    from freshet.operators.aggregates import bin_of

    return fx.census(spark, sf).select(bin_of(F.col("rel"), (0, 2, 5, 10, 20, 60)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("J23_resolve_unique", "with r as (select o_totalprice::bigint // 3000 as k, count(distinct o_custkey) as n, min(o_custkey) as v from orders where o_orderkey % 9 = 0 group by 1), w as (select distinct o_totalprice::bigint // 3000 as k from orders) select k, case when n = 1 then v end as v, coalesce(n, 0)::int as candidates from w left join r using (k)")
def j23(spark, sf):
    o = table(spark, sf, "orders").select(F.floor(F.round("o_totalprice") / 3000).alias("k"), F.col("o_custkey").alias("v"), "o_orderkey")
    return rel.resolve_unique(o, o.where("o_orderkey % 9 = 0"), "k", "v")


@query("J24_geocode", fx.sql("xy") + " select label, arg_min(x, id) as x, arg_min(y, id) as y from xy where label % 2 = 0 group by 1")
def j24(spark, sf):
    p = fx.xy(spark, sf)
    return rel.geocode(p.where("label % 2 = 0").select("label"), p, "label", "id")


@query(
    "J25_cascade_join",
    """with n as (select distinct p_type as name from part), t as (select name, unnest([name, split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2), split_part(name, ' ', -1), array_to_string(string_split(name, ' ')[2:], ' ')]) as t, unnest([0, 1, 2, 3]) as i from n),
       r as (select unnest(['ECONOMY BRUSHED', 'BURNISHED TIN', 'STEEL', 'PROMO PLATED COPPER']) as key, unnest([10, 20, 30, 40]) as value)
       select n.name, min_by(value, i)::int as value, min(case when r.key is not null then i end)::int as step from n left join t on t.name = n.name left join r on r.key = t.t group by 1""".replace("min_by(value, i)", "arg_min(value, case when r.key is not null then i end)"),
)
def j25(spark, sf):
    ref = spark.createDataFrame([("ECONOMY BRUSHED", 10), ("BURNISHED TIN", 20), ("STEEL", 30), ("PROMO PLATED COPPER", 40)], "key string, value int")
    return rel.cascade_join(table(spark, sf, "part").select(F.col("p_type").alias("name")).distinct(), ref)


@query(
    "J26_article_bags",
    """with a as (select distinct (date '2024-01-01' + (conv_id % 20)::int) as day, text from conversations), r as (select * from (values ('the', 'x', 1), ('les', 'des', 2), ('les', 'von', 3), ('und', 'x', 4)) as v(name, qualifier, region)),
       n as (select *, count(*) over (partition by name) as n from r), t as (select day, text, list_distinct(regexp_extract_all(text, '[a-zé]+')) as t from a),
       s as (select distinct day, region, text from t join n on list_contains(t, name) and (n = 1 or list_contains(t, qualifier))), b as (select day, region, text, day as d0 from s union all select day - 1, region, text, day from s)
       select region, strftime(day, '%Y%m%d') as day, count(distinct (d0, text)) as articles from b group by 1, 2""",
)
def j26(spark, sf):
    a = table(spark, sf, "conversations").select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 20).cast("int")).alias("day"), "text").distinct()
    regions = spark.createDataFrame([("the", "x", 1), ("les", "des", 2), ("les", "von", 3), ("und", "x", 4)], "name string, qualifier string, region int")
    return rel.article_bags(a, regions, "[a-zé]+").withColumn("day", F.date_format("day", "yyyyMMdd"))


@query(
    "J27_borrow_mode",
    "with c as (select o_custkey % 50 as g, o_orderpriority as v, count(*) as n from orders where o_orderkey % 3 <> 0 group by 1, 2), m as (select g, arg_min(v, (-n, v)) as v from c group by 1) select o_orderkey as id, case when o_orderkey % 3 = 0 then m.v else o_orderpriority end as v from orders left join m on g = o_custkey % 50",
)
def j27(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("g"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("v"))
    return rel.borrow_mode(o, o, ["g"], "v").select("id", "v")


@query(
    "J28_swap_partner",
    fx.sql("frames") + """, t as (select event, pt, max(rate) as rate from frames group by 1, 2), e as (select event, row_number() over (order by event) - 1 as i, count(*) over () as n from (select distinct event from t)),
      m as (select a.event as f, b.event as t from e a join e b on b.i = (a.i + 3) % a.n) select x.event, x.pt, round(y.rate, 6) as swapped from t x join m on m.f = x.event left join t y on y.event = m.t and y.pt = x.pt""",
)
def j28(spark, sf):
    t = fx.frames(spark, sf).groupBy("event", "pt").agg(F.max("rate").alias("rate"))
    return rel.swap_partner(t, "event", "pt", "rate", 3).select("event", "pt", F.round("swapped", 6).alias("swapped"))


@query("J29_cross_levels", fx.sql("cells") + " select row, col, level from cells, (values (10.0::double), (40.0), (80.0)) as v(level) where land % 3 = 0")
def j29(spark, sf):
    from freshet.functions.risk import scenario

    return scenario(fx.cells(spark, sf).where("land % 3 = 0").select("row", "col"), [10, 40, 80]).select("row", "col", "level")


@query(
    "J30_edge_exposure",
    fx.sql("xy") + """, e as (select id as edge_id, x as x1, y as y1, x + 2 as x2, y + (id % 3) - 1 as y2 from xy where id % 5 = 0), l as (select *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) as len from e), n as (select *, greatest(ceil(len / 0.25), 1)::bigint as n from l),
      p as (select edge_id, i, x1 + (i + 0.5::double) / n * (x2 - x1) as x, y1 + (i + 0.5::double) / n * (y2 - y1) as y, len / n as piece from n, lateral (select unnest(range(n)) as i)),
      w as (select p.edge_id, i, piece, max(case when q.id % 8 = 1 then 2 else 1 end) as w from p join xy q on q.id % 4 = 1 and sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) <= 0.5 group by 1, 2, 3), s as (select edge_id, sum(case when w = 1 then piece else 0 end) as h, sum(case when w = 2 then piece else 0 end) as v from w group by 1)
      select e.edge_id, round(coalesce(h, 0), 6) as high_m, round(coalesce(v, 0), 6) as very_high_m from e left join s using (edge_id)""",
)
def j30(spark, sf):
    p = fx.xy(spark, sf)
    e = p.where("id % 5 = 0").select(F.col("id").alias("edge_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 2).alias("x2"), (F.col("y") + F.col("id") % 3 - 1).alias("y2"))
    risk = p.where("id % 4 = 1").select("id", "x", "y", F.when(F.col("id") % 8 == 1, "VERY_HIGH").otherwise("HIGH").alias("level"))
    out = rel.edge_exposure(e, risk, 0.5, 0.25)
    return out.select("edge_id", F.round("high_m", 6).alias("high_m"), F.round("very_high_m", 6).alias("very_high_m"))


@query("T01_sorted_publish", "select o_orderkey, o_custkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey")
def t01(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_custkey", F.desc("o_totalprice"), "o_orderkey")


@query("T02_top_fraction", "select o_orderkey from (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as r, count(*) over () as n from orders) where r <= greatest(round_even(n * 0.05, 0), 1)")
def t02(spark, sf):
    return rel.top_fraction(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 0.05).select("o_orderkey")


@query("T03_nearest_list", fx.sql("xy") + " select 'p' || id as name, round(sqrt(pow(x - 1, 2) + pow(y - 2, 2)), 6) as dist from xy order by sqrt(pow(x - 1, 2) + pow(y - 2, 2)), name limit 20")
def t03(spark, sf):
    p = fx.xy(spark, sf).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), "x", "y")
    return rel.nearest_list(p, 1.0, 2.0, 20).select("name", F.round("dist", 6).alias("dist"))


@query("T04_systematic", "select o_orderkey, case when o_orderstatus = 'P' then 1.0 else 7.0 end::double as weight from (select *, row_number() over (partition by o_orderstatus = 'P' order by o_orderkey) - 1 as r from orders) where o_orderstatus = 'P' or r % 7 = 0")
def t04(spark, sf):
    return rel.systematic(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "P", [F.col("o_orderkey")], 7).select("o_orderkey", "weight")


DRAW_SQL = lambda cols, seed=0: f"(('0x' || substr(md5(concat_ws('|', {cols}, '{seed}')), 1, 13))::bigint / 4503599627370496.0::double)"


@query("T05_to_pos_rate", f"with c as (select count(*) filter (o_orderstatus = 'P') as p, count(*) filter (o_orderstatus <> 'P') as n from orders) select o_orderkey, o_orderstatus from orders, c where o_orderstatus = 'P' or {DRAW_SQL('o_orderkey')} < least(1, p * (1 - 0.6::double) / 0.6::double / n)")
def t05(spark, sf):
    return rel.to_pos_rate(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "P", ["o_orderkey"], 0.6)


@query("T06_sample_per_group", f"select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by {DRAW_SQL('o_orderkey')}, o_orderkey) as r from orders) where r <= 40")
def t06(spark, sf):
    return rel.sample_per_group(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"], 40)


def annulus_sql(k: int, floods: str) -> str:
    """Controls of the table ``cases``: drawn, and those far from ``floods``."""
    return f"""d as (select id as case_id, x, y, k, {DRAW_SQL('id, k')} * 6.283185307179586::double as a, sqrt({DRAW_SQL('id, k', 1)} * (4 - 0.09::double) + 0.09::double) as r from cases, (select unnest(range({k})) as k)),
      drawn as (select case_id, k, x + r * cos(a) as x, y + r * sin(a) as y from d), controls as (select * from drawn where not exists (select 1 from xy f where {floods} and sqrt(pow(f.x - drawn.x, 2) + pow(f.y - drawn.y, 2)) <= 0.3))"""


@query("T07_annulus_controls", fx.sql("xy") + f", cases as (select * from xy where kind = 'control'), {annulus_sql(5, "f.kind = 'flood'")} select case_id, round(x, 6) as x, round(y, 6) as y from controls")
def t07(spark, sf):
    p = fx.xy(spark, sf)
    out = rel.annulus_controls(p.where("kind = 'control'"), p.where("kind = 'flood'"), 5, 0.3, 2.0)
    return out.select("case_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "T08_grid_sample",
    fx.sql("cells") + f""", pos as (select row, col from cells where land % 97 = 0), pool as (select row, col, z from cells c where not exists (select 1 from pos p where abs(p.row - c.row) + abs(p.col - c.col) <= 2)),
      n as (select least(1, 3.0::double * (select count(*) from pos) / count(*)) as share from pool)
      select row, col, z, 1.0::double as weight, 1::int as y from cells where land % 97 = 0 union all select row, col, z, 1 / share, 0 from pool, n where {DRAW_SQL('row, col')} < share""",
)
def t08(spark, sf):
    c = fx.cells(spark, sf)
    return rel.grid_sample(c.select("row", "col", "z"), c.where("land % 97 = 0").select("row", "col"), 2, 3)


@query("T09_fraction", f"select o_orderkey from orders where {DRAW_SQL('o_orderkey')} < 0.1")
def t09(spark, sf):
    return rel.fraction(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.1)


@query(
    "T10_balanced_folds",
    """with recursive g as (select row_number() over (order by p desc, user_id) as i, p from (select user_id, count(*) filter (value > 100) as p from events group by 1)),
      r(i, loads, counts) as (select 0::bigint, [0, 0, 0, 0, 0]::bigint[], [0, 0, 0, 0, 0]::bigint[]
        union all select g.i, list_transform(loads, lambda x, j: x + case when j = list_position(loads, list_min(loads)) then g.p else 0 end), list_transform(counts, lambda x, j: x + (j = list_position(loads, list_min(loads)))::bigint) from r join g on g.i = r.i + 1)
      select k::int - 1 as fold, loads[k]::bigint as positives, counts[k]::bigint as groups from (select * from r order by i desc limit 1), (select unnest(range(1, 6)) as k) where counts[k] > 0""",
)
def t10(spark, sf):
    folds = rel.balanced_folds(table(spark, sf, "events"), "user_id", F.col("value") > 100, 5)
    return folds.groupBy("fold").agg(F.sum("positives").alias("positives"), F.count(F.lit(1)).alias("groups"))


@query(
    "U01_merge_labels",
    "select id, year, depth, source, precision from (select o_orderkey as id, year(o_orderdate)::int as year, null::double as depth, 'survey' as source, 'polygon' as precision from orders union all select l_orderkey * 10 + l_linenumber, null, l_quantity, 'report', 'parcel' from lineitem union all select c_custkey, null, null, 'line', 'point' from customer)",
)
def u01(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    b = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("depth"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return rel.merge_labels([("survey", "polygon", a), ("report", "parcel", b), ("line", "point", c)]).select("id", "year", "depth", "source", "precision")


@query(
    "U02_merge_cells",
    "with a as (select distinct event_type as event, user_id as cell, case when event_id % 2 = 0 then hour(ts)::int end as hour from events where value > 100), b as (select event_type as event, user_id as cell, hour(ts)::int as hour from events where value > 150), u as (select *, 0 as o from a union all select *, 1 from b) select event, cell, arg_min(hour, (o, hour)) filter (hour is not null) as hour from u group by 1, 2",
)
def u02(spark, sf):
    e = table(spark, sf, "events")
    a = e.where("value > 100").select(F.col("event_type").alias("event"), F.col("user_id").alias("cell"), F.when(F.col("event_id") % 2 == 0, F.hour("ts")).alias("hour")).distinct()
    b = e.where("value > 150").select(F.col("event_type").alias("event"), F.col("user_id").alias("cell"), F.hour("ts").alias("hour"))
    return rel.merge_cells(a, b, ["event", "cell"])


@query("U03_positives", fx.sql("cells") + " select (l_orderkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as row, (l_partkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as col from lineitem where l_quantity = 50 and l_discount = 0.1 union select row, col from cells where land % 50 = 0")
def u03(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity = 50 and l_discount = 0.1").select((F.col("l_orderkey") % fx.side(spark, sf)).cast("int").alias("row"), (F.col("l_partkey") % fx.side(spark, sf)).cast("int").alias("col"))
    return rel.positives(li, fx.cells(spark, sf).withColumn("d", F.col("land") % 50), "d")


@query("U04_except_labels", "select o_orderkey as id from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def u04(spark, sf):
    lab = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(lab, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("id"))


@query("U05_code_coverage", "with e as (select distinct c_custkey as k from customer where c_custkey % 3 <> 0), f as (select distinct o_custkey as k from orders) select sum((e.k is not null and f.k is not null)::int)::bigint as both, sum((f.k is null)::int)::bigint as only_expected, sum((e.k is null)::int)::bigint as only_found from e full join f on e.k = f.k")
def u05(spark, sf):
    return rel.code_coverage(table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("U06_concat_events", "select event_type as event, count(*) as rows from events where event_type in ('click', 'view', 'purchase') group by 1")
def u06(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "event")
    parts = [("a", "x", e.where(F.col("event") == t)) for t in ("click", "view", "purchase")]
    return rel.merge_labels(parts).groupBy("event").agg(F.count(F.lit(1)).alias("rows"))
