"""Queries of the cleaning, geometry and risk expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import cleaning, geo, risk
from freshet.plans import fixtures as fx
from freshet.plans.registration import Registry
from freshet.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query(
    "P01_norm_dates",
    """select o_orderkey as id, case when regexp_full_match(trim(t), '\\d{1,8}') then lpad(trim(t), 8, '0') else trim(t) end as ymd,
         case when regexp_full_match(h, '\\d{1,4}') then lpad(h, 4, '0') else h end as hhmm
       from (select o_orderkey, ' ' || (case when o_orderkey % 7 = 0 then 'x' else '' end) || (o_orderkey * 37 % 99999999)::varchar || ' ' as t, (o_orderkey % 1450)::varchar as h from orders)""",
)
def p01(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.lit(" "), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(""), (F.col("o_orderkey") * 37 % 99999999).cast("string"), F.lit(" "))
    return o.select(F.col("o_orderkey").alias("id"), cleaning.norm_ymd(text).alias("ymd"), cleaning.norm_hhmm((F.col("o_orderkey") % 1450).cast("string")).alias("hhmm"))


@query(
    "P02_numbers",
    """select id, try_cast(replace(trim(t), ',', '') as double) as value, coalesce(try_cast(replace(trim(t), ',', '') as double), 0) as value0
       from (select o_orderkey as id, case when o_orderkey % 5 = 0 then ' ' when o_orderkey % 5 = 1 then 'n/a' when o_orderkey % 5 = 2 then '1,' || lpad((o_orderkey % 1000)::varchar, 3, '0')
         else ' ' || (o_orderkey % 1000)::varchar end as t from orders)""",
)
def p02(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, " ").when(k % 5 == 1, "n/a").when(k % 5 == 2, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise(F.concat(F.lit(" "), (k % 1000).cast("string")))
    return table(spark, sf, "orders").select(k.alias("id"), cleaning.number(text).alias("value"), cleaning.number(text, 0.0).alias("value0"))


@query(
    "P03_sentinels",
    """select event_id as id, case when round(value) - 95 <= -90 then null else round(value) - 95 end as archived, case when round(value) - 95 < 0 then null else round(value) - 95 end as live,
         case when event_id % 1005 = 0 or event_id % 1005 >= 999 then null else event_id % 1005 end as soil from events""",
)
def p03(spark, sf):
    mm, soil = F.round("value") - 95, F.col("event_id") % 1005
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), cleaning.gauge_mm(mm).alias("archived"), cleaning.gauge_mm(mm, live=True).alias("live"), cleaning.soil_class(soil).alias("soil")
    )


@query(
    "P04_years",
    """with t as (select o_orderkey as id, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y.%m.%d') else '0012' end as d from orders),
       y as (select id, d, case when length(regexp_replace(d, '\\D', '', 'g')) >= 4 then left(regexp_replace(d, '\\D', '', 'g'), 4)::int end as y from t)
       select id, case when y between 1800 and 2100 then y end as year, coalesce(case when y between 1900 and 2100 then y end, case when 1890 + id % 30 between 1900 and 2100 then (1890 + id % 30)::int end) as flood_year from y""",
)
def p04(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(d, "yyyy.MM.dd")).otherwise("0012")
    return table(spark, sf, "orders").select(k.alias("id"), cleaning.year_of(text).alias("year"), cleaning.flood_year(text, 1890 + k % 30).alias("flood_year"))


@query(
    "P05_event_ids",
    """with t as (select event_id as id, case when event_id % 4 = 0 then 'no date' else 'on ' || case when event_id % 4 = 1 then strftime(ts, '%Y-%m-%d') when event_id % 4 = 2 then strftime(ts, '%Y/%m/%d') else strftime(ts, '%Y.%m.%d') end || ' 10:00' end as s from events)
       select id, case when regexp_extract(s, '(20\\d\\d)[-/.](\\d\\d)[-/.](\\d\\d)', 1) <> '' then regexp_extract(s, '(20\\d\\d)[-/.](\\d\\d)[-/.](\\d\\d)', 1) || regexp_extract(s, '(20\\d\\d)[-/.](\\d\\d)[-/.](\\d\\d)', 2) || regexp_extract(s, '(20\\d\\d)[-/.](\\d\\d)[-/.](\\d\\d)', 3) end as event from t""",
)
def p05(spark, sf):
    k, ts = F.col("event_id"), F.col("ts")
    day = F.when(k % 4 == 1, F.date_format(ts, "yyyy-MM-dd")).when(k % 4 == 2, F.date_format(ts, "yyyy/MM/dd")).otherwise(F.date_format(ts, "yyyy.MM.dd"))
    text = F.when(k % 4 == 0, "no date").otherwise(F.concat(F.lit("on "), day, F.lit(" 10:00")))
    return table(spark, sf, "events").select(k.alias("id"), cleaning.event_id(text).alias("event"))


@query(
    "P06_dms",
    """select o_orderkey as id, case when o_orderkey % 9 = 0 then null else round((120 + o_orderkey % 12) + (o_orderkey % 60) / 60.0::double + (o_custkey % 60) / 3600.0::double, 9) end as degrees from orders""",
)
def p06(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 9 == 0, "126-57").otherwise(F.concat_ws("-", (120 + k % 12).cast("string"), (k % 60).cast("string"), (F.col("o_custkey") % 60).cast("string")))
    return table(spark, sf, "orders").select(k.alias("id"), F.round(cleaning.dms(text), 9).alias("degrees"))


def _cause():
    k = F.col("o_orderkey")
    return F.when(k % 5 == 0, "배수 불량").when(k % 5 == 1, "제방 유실").when(k % 5 == 2, "하천 범람과 저지대").when(k % 5 == 3, F.lit(None)).otherwise("미상")


_CAUSE_SQL = "case o_orderkey % 5 when 0 then '배수 불량' when 1 then '제방 유실' when 2 then '하천 범람과 저지대' when 3 then null else '미상' end"


@query(
    "P07_mechanism",
    f"""select id, case when inland and river then 'both' when inland then 'inland' when river then 'river' else '' end as mechanism from (
       select o_orderkey as id, regexp_matches(coalesce({_CAUSE_SQL}, ''), '{"|".join(cleaning.INLAND_WORDS)}') as inland, regexp_matches(coalesce({_CAUSE_SQL}, ''), '{"|".join(cleaning.RIVER_WORDS)}') as river from orders)""",
)
def p07(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), cleaning.mechanism(_cause()).alias("mechanism"))


@query(
    "P08_depths",
    "select l_orderkey as k, l_linenumber as n, case when l_extendedprice - 900 > 0 and l_extendedprice - 900 <= 1500 then round_even(l_extendedprice - 900, 0)::int end as depth from lineitem",
)
def p08(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), cleaning.depth_cm(F.col("l_extendedprice") - 900).alias("depth"))


@query(
    "P09_in_box",
    fx.sql("points") + " select id, lon between 126.9 and 127.2 and lat between 35.8 and 36.3 as inside from points",
)
def p09(spark, sf):
    return fx.points(spark, sf).select("id", cleaning.in_box(F.col("lon"), F.col("lat"), 126.9, 35.8, 127.2, 36.3).alias("inside"))


@query("P10_land_only", fx.sql("cells") + " select row, col from (select row, col, case when land % 10 = 0 then null else built end as need, z - 25 as z from cells) where z > 0 and need is not null")
def p10(spark, sf):
    df = fx.cells(spark, sf).select("row", "col", F.when(F.col("land") % 10 != 0, F.col("built")).alias("need"), (F.col("z") - 25).alias("z"))
    return cleaning.land_only(df, "z", ["need"]).select("row", "col")


@query("P11_drop_river", f"select o_orderkey as id from orders where not regexp_matches(coalesce({_CAUSE_SQL}, ''), '{'|'.join(cleaning.RIVER_WORDS)}')")
def p11(spark, sf):
    return cleaning.drop_river(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), _cause().alias("cause")), "cause").select("id")


@query(
    "P12_former_codes",
    """select code, flood_code, count(*) as n from (
         select (11 + c_custkey % 43)::varchar as code, unnest(case (11 + c_custkey % 43)::varchar when '12' then ['29', '46'] when '51' then ['42'] when '52' then ['45'] else [(11 + c_custkey % 43)::varchar] end) as flood_code from customer) group by 1, 2""",
)
def p12(spark, sf):
    df = table(spark, sf, "customer").select((11 + F.col("c_custkey") % 43).cast("string").alias("code"))
    return cleaning.former_codes(df, "code").groupBy("code", "flood_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P13_parcel_keys",
    """select id, k as pnu, left(k, 5) as sigungu, substr(k, 6, 5) as dong, case substr(k, 11, 1) when '1' then '0' when '2' then '1' end as land, substr(k, 12, 4) as bun, substr(k, 16, 4) as ji from (
       select o_orderkey as id, lpad((o_custkey % 99999)::varchar, 5, '0') || lpad((o_orderkey % 77777)::varchar, 5, '0') || (case when o_orderkey % 2 = 0 then '1' else '2' end) || lpad((o_orderkey % 1000)::varchar, 4, '0') || lpad((o_custkey % 50)::varchar, 4, '0') as k from orders)""",
)
def p13(spark, sf):
    s = lambda c: c.cast("string")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    key = cleaning.pnu(s(c % 99999), s(k % 77777), s(k % 2), s(k % 1000), s(c % 50))
    df = table(spark, sf, "orders").select(k.alias("id"), key.alias("pnu"))
    return df.select("id", "pnu", cleaning.pnu_parts(F.col("pnu")).alias("p")).select("id", "pnu", "p.*")


@query("P14_entity_ids", "select s_suppkey as id, left(sha256(trim(s_name) || '|' || s_nationkey::varchar), 20) as entity from supplier")
def p14(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), cleaning.entity_id(F.col("s_name"), F.col("s_nationkey").cast("string")).alias("entity"))


@query(
    "P15_parking_seed",
    """with t as (select c_custkey as id, n_name || ' street ' || c_custkey as address, case when c_custkey % 3 = 0 then null else r_name || ' agency' end as agency from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
       s as (select *, coalesce(nullif(regexp_extract(address, '(CHINA|INDIA|JAPAN)', 1), ''), nullif(regexp_extract(coalesce(agency, ''), '(CHINA|INDIA|JAPAN)', 1), '')) as region from t where contains(address, 'A') or contains(coalesce(agency, ''), 'A'))
       select id, region, left(sha256(trim(id::varchar) || '|' || trim(address)), 20) as seed_id, case when region is null then 'REGION_UNKNOWN' when contains(address, region) then 'ADDRESS' else 'AGENCY' end as quality from s""",
)
def p15(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    df = c.select(
        F.col("c_custkey").alias("id"), F.concat("n_name", F.lit(" street "), F.col("c_custkey").cast("string")).alias("address"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat("r_name", F.lit(" agency"))).alias("agency"),
    ).withColumn("name", F.col("id").cast("string"))
    return cleaning.parking_seed(df, ["CHINA", "INDIA", "JAPAN"], "A").select("id", "region", "seed_id", "quality")


@query(
    "P16_translated",
    "select o_orderkey as id, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else o_orderstatus end as status from orders",
)
def p16(spark, sf):
    words = spark.createDataFrame([("F", "finished"), ("O", "open")], "key string, value string")
    return cleaning.translated(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), "status", words)


@query(
    "P17_rain_rate",
    "select event_id as id, case when v <= -250 then 0 else round(pow(pow(10, greatest(-30, least(80, v)) / 10) / 200, 1 / 1.6::double), 6) end as mm_h from (select event_id, case when event_id % 11 = 0 then -300.0 else value - 40 end as v from events)",
)
def p17(spark, sf):
    dbz = F.when(F.col("event_id") % 11 == 0, -300.0).otherwise(F.col("value") - 40)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.round(risk.rain_rate(dbz), 6).alias("mm_h"))


@query(
    "P18_wetness",
    fx.sql("cells") + """ select row, col, round(ln(greatest(acc, 1) * 30 / tan(radians(greatest(built * 100 - 4, 0.05)))), 6) as twi, round(ln(1 + acc * 900 * tan(radians(greatest(built * 100 - 4, 0.05)))), 6) as spi from cells""",
)
def p18(spark, sf):
    slope = F.col("built") * 100 - 4
    return fx.cells(spark, sf).select(
        "row", "col", F.round(risk.twi(risk.catchment_m(F.col("acc"), 30.0), slope), 6).alias("twi"), F.round(risk.spi(risk.catchment_m(F.col("acc"), 30.0, squared=True), slope), 6).alias("spi")
    )


@query("P19_calibrated", fx.sql("cells") + " select row, col, round((s / greatest(1 - s, 1e-9) / 15) / (1 + s / greatest(1 - s, 1e-9) / 15), 8) as p from (select row, col, least(score, 1) as s from cells)")
def p19(spark, sf):
    return fx.cells(spark, sf).select("row", "col", F.round(risk.calibrate(F.least("score", F.lit(1.0)), 15.0), 8).alias("p"))


@query("P20_scenarios", fx.sql("cells") + " select row, col, level, least(level, 40) as rain_6h, round(least(level, 40) * 0.2, 6) as rain_1h from cells, (values (10.0::double), (30.0), (80.0)) as v(level)")
def p20(spark, sf):
    return risk.scenario(fx.cells(spark, sf).select("row", "col"), [10, 30, 80]).withColumn("rain_1h", F.round("rain_1h", 6))


@query(
    "P21_distances",
    fx.sql("points") + """ select id, round(sqrt(pow((lon - 127) * 88000, 2) + pow((lat - 36) * 111000, 2)), 3) as flat,
       round(2 * 6371000 * asin(least(sqrt(pow(sin(radians(lat - 36) / 2), 2) + cos(radians(36)) * cos(radians(lat)) * pow(sin(radians(lon - 127) / 2), 2)), 1)), 3) as sphere from points""",
)
def p21(spark, sf):
    lon, lat, lon0, lat0 = F.col("lon"), F.col("lat"), F.lit(127.0), F.lit(36.0)
    return fx.points(spark, sf).select("id", F.round(geo.flat_m(lon0, lat0, lon, lat), 3).alias("flat"), F.round(geo.haversine_m(lon0, lat0, lon, lat), 3).alias("sphere"))


def _tm_sql() -> str:
    tm, a, e, r = geo.TM_5179, geo._ALPHA, geo._E, geo._RADIUS
    term = lambda f, g: " + ".join(f"{c!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, c in enumerate(a, 1))
    return fx.sql("points") + f""", s as (select id, radians(lon - {tm.lon0}) as lam, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) as t from points),
      u as (select id, atan2(t, cos(lam)) as xi, asinh(sin(lam) / sqrt(t * t + pow(cos(lam), 2))) as eta from s)
      select id, round({tm.k0 * r!r} * (eta + {term('cos', 'sinh')}) + {tm.east!r}, 3) as x, round({tm.k0 * r!r} * (xi + {term('sin', 'cosh')}) + {tm.north - geo.meridian_offset(tm)!r}, 3) as y from u"""


def tm_steps() -> str:
    """Further tables of a WITH clause: placed (id, x, y), the projection of its ``points`` (id, lon, lat)."""
    head, tail = _tm_sql()[len(fx.sql("points")) :].rsplit("select id, ", 1)
    metres = tail.replace("round(", "(").replace(", 3) as", ") as")
    return f"{head.rstrip()}, placed as (select id, {metres})"


@query("P22_tm_forward", _tm_sql())
def p22(spark, sf):
    df = fx.points(spark, sf).withColumn("p", geo.to_tm(F.col("lon"), F.col("lat")))
    return df.select("id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("P22_tm_round_trip", fx.sql("points") + " select count(*) as points, 0::bigint as off from points")
def p22b(spark, sf):
    df = fx.points(spark, sf).withColumn("p", geo.to_tm(F.col("lon"), F.col("lat"), geo.TM_5186)).withColumn("q", geo.from_tm(F.col("p.x"), F.col("p.y"), geo.TM_5186))
    far = F.greatest(F.abs(F.col("q.lon") - F.col("lon")), F.abs(F.col("q.lat") - F.col("lat"))) > 1e-7  # about a centimetre
    return df.agg(F.count(F.lit(1)).alias("points"), F.sum(F.when(far, 1).otherwise(0)).alias("off"))


_H = repr(geo.MERCATOR_HALF)


@query(
    "P23_tiles",
    fx.sql("points") + f""", m as (select id, lon * ({_H} / 180) as x, ln(tan(pi() / 4 + radians(lat) / 2)) * ({_H} / pi()) as y from points),
      p as (select id, floor((x + {_H}) / (2 * {_H} / (256 * 1024)))::bigint as px, floor(({_H} - y) / (2 * {_H} / (256 * 1024)))::bigint as py from m)
      select id, px // 256 as tx, py // 256 as ty, (px % 256)::int as px, (py % 256)::int as py from p""",
)
def p23(spark, sf):
    df = fx.points(spark, sf).withColumn("m", geo.to_3857(F.col("lon"), F.col("lat"))).withColumn("t", geo.tile_of(F.col("m.x"), F.col("m.y"), 10))
    return df.select("id", "t.tx", "t.ty", "t.px", "t.py")


LOCAL = geo.Grid(0.5, -10.0, 10.0, 40, 40)


@query(
    "P24_cells",
    fx.sql("xy") + """, c as (select id, floor((10 - y) / 0.5)::bigint as row, floor((x + 10) / 0.5)::bigint as col from xy)
      select id, row, col, -10 + (col + 0.5) * 0.5::double as cx, 10 - (row + 0.5) * 0.5::double as cy from (select id, case when row between 0 and 39 and col between 0 and 39 then row end as row, case when row between 0 and 39 and col between 0 and 39 then col end as col from c)""",
)
def p24(spark, sf):
    df = fx.xy(spark, sf).withColumn("c", geo.cell_of(F.col("x"), F.col("y"), LOCAL)).withColumn("m", geo.centre_of(F.col("c.row"), F.col("c.col"), LOCAL))
    return df.select("id", "c.row", "c.col", F.col("m.x").alias("cx"), F.col("m.y").alias("cy"))


@query(
    "P25_gid",
    """select o_orderkey as id, ((o_orderkey % 14) * 100 + o_custkey % 100)::int as x_km, ((o_custkey % 14) * 100 + o_orderkey % 100)::int as y_km from orders""",
)
def p25(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    letter = lambda v: F.substr(F.lit(cleaning.GID_LETTERS), (v % 14 + 1).cast("int"), F.lit(1))
    two = lambda v: F.lpad((v % 100).cast("string"), 2, "0")
    gid = F.concat(letter(k), letter(c), two(c), two(k))
    return table(spark, sf, "orders").select(k.alias("id"), cleaning.gid_to_km(gid).alias("g")).select("id", "g.x_km", "g.y_km")


@query("P26_clock24", "select event_id as id, epoch(date_trunc('day', ts))::bigint + (1 + event_id % 24) * 3600 as at from events")
def p26(spark, sf):
    key = F.concat(F.date_format("ts", "yyyyMMdd"), F.lpad((1 + F.col("event_id") % 24).cast("string"), 2, "0"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.unix_timestamp(cleaning.clock24(key)).alias("at"))


@query(
    "P27_ring_measures",
    fx.sql("xy") + " select id, round(x + 1, 6) as cx, round(y + 0.5, 6) as cy, 2.0::double as area, round(x + 1.5, 6) as bx, round(y + 0.5, 6) as by, 3.0::double as box from xy",
)
def p27(spark, sf):
    # a 2 x 1 rectangle and a small triangle beside it, at each point
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    rings = F.array(F.array(p(2.5, 0), p(3, 0), p(3, 0.5)), F.array(p(0, 0), p(2, 0), p(2, 1), p(0, 1)))
    df = fx.xy(spark, sf).select("id", geo.ring_centroid(rings).alias("c"), geo.bbox_centre(rings).alias("b"))
    r = lambda c: F.round(c, 6)
    return df.select("id", r("c.x").alias("cx"), r("c.y").alias("cy"), r("c.area").alias("area"), r("b.x").alias("bx"), r("b.y").alias("by"), r("b.area").alias("box"))


@query("P28_first_source", "select p_partkey as id, case when p_partkey % 4 = 0 then null else p_brand end as dataset from part")
def p28(spark, sf):
    made = F.array(F.struct(F.col("p_brand").alias("dataset")), F.struct(F.lit("other").alias("dataset")))
    none = F.filter(made, lambda s: F.lit(False))
    sources = F.when(F.col("p_partkey") % 4 == 0, none).otherwise(made)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), cleaning.first_source(sources)["dataset"].alias("dataset"))


_BAND_SQL = "case when rel is null then 'UNKNOWN' when rel <= 2 then 'VERY_HIGH' when rel <= 5 then 'HIGH' when rel <= 10 then 'MODERATE' when rel <= 20 then 'LOW' else 'VERY_LOW' end"


@query(
    "P29_terrain_bands",
    fx.sql("census") + f""" select band, count(*) as n, min(case band when 'VERY_HIGH' then 0.355 when 'HIGH' then 0.148 when 'MODERATE' then 0.052 when 'LOW' then 0.004 when 'VERY_LOW' then 0 end)::double as rate
      from (select {_BAND_SQL} as band from (select case when id % 13 = 0 then null else rel end as rel from census)) group by 1""",
)
def p29(spark, sf):
    rel = F.when(F.col("id") % 13 != 0, F.col("rel"))
    return fx.census(spark, sf).select(risk.terrain_band(rel).alias("t")).groupBy(F.col("t.band").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("t.rate").alias("rate"))


@query(
    "P30_static_risk",
    fx.sql("census") + f""", b as (select id, {_BAND_SQL} as band, rain * 20 as flood_m from (select id, rain, case when id % 13 = 0 then null else rel end as rel from census))
      select id, case when band = 'UNKNOWN' then 'UNKNOWN' when flood_m <= 500 then case band when 'VERY_LOW' then 'LOW' when 'LOW' then 'MODERATE' when 'MODERATE' then 'HIGH' else 'VERY_HIGH' end else band end as risk,
        case band when 'VERY_HIGH' then 'ADVISORY' when 'HIGH' then 'ADVISORY' when 'LOW' then 'EXTREME' when 'VERY_LOW' then 'EXTREME' else 'WARNING' end as trigger_level from b""",
)
def p30(spark, sf):
    rel = F.when(F.col("id") % 13 != 0, F.col("rel"))
    df = fx.census(spark, sf).withColumn("band", risk.terrain_band(rel)["band"])
    return df.select("id", risk.static_risk(F.col("band"), F.col("rain") * 20).alias("risk"), risk.rain_trigger(F.col("band")).alias("trigger_level"))


_LEVEL_SQL = "case when r1 >= 72 or (r1 >= 50 and r3 >= 90) then 'EXTREME' when r3 >= 90 or r12 >= 180 then 'WARNING' when r3 >= 60 or r12 >= 110 then 'ADVISORY' else 'NONE' end"
_RAINS_SQL = "select id, rel, rain, case when id % 17 = 0 then 0 else rain * 0.7 end as r1, rain * 0.9 as r3, rain * 1.6 as r12 from census"


def _rains(spark, sf):
    c = F.col("rain")
    return fx.census(spark, sf).select("id", "rel", "event", F.when(F.col("id") % 17 != 0, c * 0.7).alias("r1"), (c * 0.9).alias("r3"), (c * 1.6).alias("r12"))


@query("P31_warning_levels", fx.sql("census") + f", r as ({_RAINS_SQL}) select id, {_LEVEL_SQL} as level from r")
def p31(spark, sf):
    return _rains(spark, sf).select("id", risk.warning_level(F.col("r1"), F.col("r3"), F.col("r12")).alias("level"))


_ALERT_SQL = f""", r as ({_RAINS_SQL}), l as (select id, {_LEVEL_SQL} as level, case when id % 13 = 0 then 'UNKNOWN' when rel <= 5 then 'HIGH' else 'LOW' end as risk, id % 19 <> 0 as ok from r),
      g as (select *, case level when 'NONE' then 0 when 'ADVISORY' then 1 when 'WARNING' then 2 else 3 end - case risk when 'HIGH' then 1 when 'LOW' then 3 else 2 end as gap from l)
      select id, case when risk = 'UNKNOWN' or not ok then 'UNKNOWN' when level = 'NONE' then 'CALM' when gap >= 2 then 'EVACUATE' when gap = 1 then 'PREPARE' else 'WATCH' end as alert from g"""


@query("P32_alerts", fx.sql("census") + _ALERT_SQL)
def p32(spark, sf):
    df = _rains(spark, sf).withColumn("level", risk.warning_level(F.col("r1"), F.col("r3"), F.col("r12")))
    band = F.when(F.col("id") % 13 == 0, "UNKNOWN").when(F.col("rel") <= 5, "HIGH").otherwise("LOW")
    return df.select("id", risk.alert(band, F.col("id") % 19 != 0, F.col("level"), risk.rain_trigger(band)).alias("alert"))


@query(
    "P33_reasons",
    fx.sql("census") + f""", r as ({_RAINS_SQL}), l as (select id, {_LEVEL_SQL} as level, rel, rain from r)
      select id, concat_ws(';', case when id % 3 <> 0 then printf('%.1f m above the lowest ground nearby', rel) end, case when id % 4 <> 0 then printf('past flood %d m away', floor(rain)::bigint) end,
        case when id % 19 <> 0 and level <> 'NONE' then 'rain level ' || level end, case when id % 19 = 0 then 'rain unavailable' end) as reasons from l""",
)
def p33(spark, sf):
    df = _rains(spark, sf).withColumn("level", risk.warning_level(F.col("r1"), F.col("r3"), F.col("r12"))).withColumn("rain", F.col("r3") / 0.9)
    none = F.lit(None).cast("double")
    whole = F.floor(F.round(F.col("rain"), 6))
    said = risk.reasons(F.when(F.col("id") % 3 != 0, F.col("rel")), none, F.when(F.col("id") % 4 != 0, whole), F.col("id") % 19 != 0, F.col("level"))
    return df.select("id", F.array_join(said, ";").alias("reasons"))


@query(
    "P34_risk_view",
    fx.sql("census") + """ select id, case when rel <= 5 then 'warning' when id % 13 = 0 then 'warning' else 'safe' end as badge, case when id % 13 = 0 then 'Unknown' when rel <= 5 then 'High' else 'Low' end as word,
      case when id % 19 = 0 then 'unavailable' else (case when id % 2 = 0 then printf('6 h: %.1f mm', rel) when id % 3 = 0 then printf('3 h: %.1f mm', rel) else 'unavailable' end) || (case when road * 100 >= 3 then printf(' (gauge %.1f km away)', road * 100) else '' end) end as rain from census""",
)
def p34(spark, sf):
    i, rel = F.col("id"), F.col("rel")
    band = F.when(i % 13 == 0, "UNKNOWN").when(rel <= 5, "HIGH").otherwise("LOW")
    view = risk.risk_view(band, i % 19 != 0, F.when(i % 2 == 0, rel), F.when(i % 3 == 0, rel), F.lit(None).cast("double"), F.col("road") * 100)
    return fx.census(spark, sf).select("id", view.alias("v")).select("id", "v.*")


@query("P35_band_of", fx.sql("cells") + " select row, col, case when score >= 0.9 then 'VERY_HIGH' when score >= 0.8 then 'HIGH' when score >= 0.5 then 'MODERATE' else 'LOW' end as band from cells")
def p35(spark, sf):
    return fx.cells(spark, sf).select("row", "col", risk.band_of(F.col("score"), [("HIGH", 0.8), ("VERY_HIGH", 0.9), ("MODERATE", 0.5)], "LOW").alias("band"))


@query(
    "P36_existed",
    """select status, count(*) as n from (select case when a is null then 'UNKNOWN' when a > 1996 then 'NO' when a > 1994 then 'PARTIAL' else 'YES' end as status
       from (select case when o_orderkey % 10 = 0 then null else year(o_orderdate) end as a from orders)) group by 1""",
)
def p36(spark, sf):
    approved = F.when(F.col("o_orderkey") % 10 != 0, F.year("o_orderdate"))
    return table(spark, sf, "orders").select(cleaning.existed_at_flood(approved, F.lit(1994), F.lit(1996)).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P37_parking_status",
    """with c as (select distinct l_orderkey as k from lineitem where l_returnflag = 'A' and l_quantity > 45),
       o as (select o_orderkey as id, (o_orderkey % 3)::int as u, (o_custkey % 4)::int as p, o_orderstatus = 'F' as f from orders)
       select id, case when id in (select k from c) then 'CONFIRMED_BASEMENT_PARKING_USE' when u > 0 and p > 0 and f then 'PROBABLE_NOT_CONFIRMED_IN_FLOOR_ROWS' when u > 0 and p > 0 then 'PROBABLE_FLOOR_DETAIL_NOT_COLLECTED'
         when u > 0 then 'UNDERGROUND_FLOOR_ONLY' else 'GIS_BASEMENT_CANDIDATE_NOT_CONFIRMED_BY_TITLE' end as status from o""",
)
def p37(spark, sf):
    floors = table(spark, sf, "lineitem").where("l_returnflag = 'A' and l_quantity > 45").select(F.col("l_orderkey").alias("k")).distinct().withColumn("hit", F.lit(True))
    o = table(spark, sf, "orders").join(floors, F.col("o_orderkey") == F.col("k"), "left")
    status = cleaning.parking_status(F.col("hit"), F.col("o_orderkey") % 3, F.col("o_custkey") % 4, F.col("o_orderstatus") == "F")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"))


@query("P38_parking_flag", "select p_partkey as id, (case when p_partkey % 6 = 0 then null when p_brand in ('Brand#11', 'Brand#12') then 1 else 0 end)::int as flag from part")
def p38(spark, sf):
    kind = F.when(F.col("p_partkey") % 6 != 0, F.col("p_brand"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), cleaning.parking_flag(kind, ["Brand#11", "Brand#12"]).alias("flag"))


@query("P42_term_search", "select doc_id from documents where contains(lower(coalesce(text, '') || ' ' || source), 'the') and contains(lower(coalesce(text, '') || ' ' || source), 'src1')")
def p42(spark, sf):
    return table(spark, sf, "documents").where(cleaning.has_terms("The SRC1", F.col("text"), F.col("source"))).select("doc_id")
