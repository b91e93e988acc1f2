"""Queries of the grouped summaries and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import geo
from freshet.operators import aggregates as ag
from freshet.plans import fixtures as fx
from freshet.plans.registration import Registry
from freshet.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

R6 = lambda c: F.round(c, 6).alias(c)
RAIN_EDGES = (0, 10, 20, 30, 40, 50, 60, 80, 150)
REL_EDGES = (0, 2, 5, 10, 20, 60)
BUILT_EDGES = (0, 0.03, 0.06, 1.0)
CROSSING_LEVELS = (0.32, 0.33, 0.34, 0.35)


def rounded(df, *names):
    return df.select(*[R6(c) if c in names else F.col(c) for c in df.columns])


def sql_rounded(c: str, places: int):
    """A mean of doubles rounded as SQL does it, by its multiple: a half in decimals need not be one there."""
    return (F.round(F.col(c) * 10.0**places) / 10.0**places).alias(c)


def _bin_sql(column: str, edges) -> str:
    return f"case when {column} is null or {column} < {edges[0]} then null " + " ".join(f"when {column} < {e} then {i}" for i, e in enumerate(edges[1:])) + " end"


@query("G01_summary", fx.sql("census") + " select event, count(*) as rows, count(r) as known, min(r) as least, round(quantile_cont(r, 0.5), 6) as median, max(r) as most, sum(flooded::int)::bigint as flagged from (select *, case when id % 9 = 0 then null else rain end as r from census) group by 1")
def g01(spark, sf):
    df = fx.census(spark, sf).withColumn("r", F.when(F.col("id") % 9 != 0, F.col("rain")))
    return rounded(ag.summary_by(df, ["event"], "r", F.col("flooded")), "median")


@query(
    "G02_dedupe_last",
    """with t as (select case when event_id % 50 = 0 then null else user_id end as u, event_type as k, ts, event_id from events where event_id % 50 <> 0 or true),
       a as (select *, case when u is null and k is null then event_id end as own from t)
       select u, k, event_id from (select *, row_number() over (partition by u, k, own order by ts desc, event_id desc) as n from a) where n = 1""",
)
def g02(spark, sf):
    df = table(spark, sf, "events").select(F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("u"), F.col("event_type").alias("k"), "ts", "event_id")
    return ag.dedupe_last(df, ["u", "k"], [F.col("ts"), F.col("event_id")]).select("u", "k", "event_id")


@query(
    "G03_quality",
    """with t as (select o_orderstatus as province, year(o_orderdate)::int as yr, strftime(o_orderdate, '%Y%m%d') as day, case o_orderkey % 4 when 0 then null when 1 then '0000' else '1200' end as hhmm, case when o_custkey % 100 = 0 then null else o_custkey end as ident from orders)
       select province, yr, grouping(province, yr)::bigint as grouping, count(*) as records, count(distinct day) as days, sum((hhmm is null)::int)::bigint as time_missing, sum(coalesce((hhmm = '0000')::int, 0))::bigint as time_zero, sum((ident is null or ident <= 0)::int)::bigint as bad_ids
       from t group by grouping sets ((province), (yr))""",
)
def g03(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("province"), F.year("o_orderdate").alias("yr"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, "0000").otherwise("1200").alias("hhmm"), F.when(F.col("o_custkey") % 100 != 0, F.col("o_custkey")).alias("ident"),
    )
    return ag.qa(df, [["province"], ["yr"]], "day", "hhmm", "ident")


@query("G04_null_counts", "select sum((event_id is null)::int)::bigint as event_id, sum((value < 5)::int)::bigint as value, sum((event_id % 3 = 0)::int)::bigint as props from events")
def g04(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.when(F.col("value") >= 5, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("props"))
    return ag.null_counts(df)


@query(
    "G05_parcels",
    fx.sql("register") + """, k as (select *, left(status, 1)::int as rank from register)
      select parcel, max(price) as max_price, max(area) as max_area, min(rank)::int as best_rank, min(approved) as first_approved, count(*) as rows from k group by parcel""",
)
def g05(spark, sf):
    out = ag.rollup_parcel(fx.register(spark, sf), "parcel", ["price", "area"], "area", "use", F.substring("status", 1, 1).cast("int"), "ord", "approved")
    return out.select("parcel", "max_price", "max_area", "best_rank", "first_approved", "rows")


@query(
    "G06_event_rollup",
    """with t as (select event_id as ident, case when event_id % 97 = 0 then null else strftime(ts, '%Y%m%d') end as day, lpad(hour(ts)::varchar, 2, '0') || '00' as hhmm, event_type as code, 'n' || (user_id % 7)::varchar as name, year(ts)::int as yr from events)
       select day, hhmm, case when day is null then ident end as undated_id, count(*) as polygons, array_to_string(list_sort(list_distinct(list(code))), ';') as codes, array_to_string(list_sort(list_distinct(list(name))), ' | ') as names, min(yr)::int as first_year from t group by 1, 2, 3""",
)
def g06(spark, sf):
    df = table(spark, sf, "events").select(
        F.col("event_id").alias("ident"), F.when(F.col("event_id") % 97 != 0, F.date_format("ts", "yyyyMMdd")).alias("day"), F.date_format("ts", "HH00").alias("hhmm"),
        F.col("event_type").alias("code"), F.concat(F.lit("n"), (F.col("user_id") % 7).cast("string")).alias("name"), F.year("ts").alias("yr"),
    )
    return ag.rollup_events(df, "day", "hhmm", "ident", "code", "name", "yr")


@query("G07_value_counts", "select l_suppkey, count(*) as rows from lineitem group by 1 order by rows desc, l_suppkey limit 10")
def g07(spark, sf):
    return ag.value_counts(table(spark, sf, "lineitem"), "l_suppkey", 10)


@query("G08_ratio_of_sums", "select l_suppkey, round(sum(l_tax) / sum(l_discount), 6) as ratio from lineitem group by 1 having sum(l_discount) > 0")
def g08(spark, sf):
    return rounded(ag.ratio_of_sums(table(spark, sf, "lineitem"), ["l_suppkey"], "l_tax", "l_discount"), "ratio")


def _centroid_sql() -> str:
    tm, e, r = geo.TM_5179, geo._E, geo._RADIUS
    k, north = tm.k0 * r, tm.north - geo.meridian_offset(tm)
    add = lambda cs, f, g: " + ".join(f"{c!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, c in enumerate(cs, 1))
    phi = " + ".join(f"{c!r} * sin({2 * j} * chi)" for j, c in enumerate(geo._DELTA, 1))
    return fx.sql("points") + f""", s as (select id, radians(lon - {tm.lon0}) as lam, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) as t from points where id % 7 <> 3),
      u as (select id, atan2(t, cos(lam)) as xi, asinh(sin(lam) / sqrt(t * t + pow(cos(lam), 2))) as eta from s),
      m as (select (id % 7)::varchar as code, avg(xi + {add(geo._ALPHA, 'sin', 'cosh')}) as xi, avg(eta + {add(geo._ALPHA, 'cos', 'sinh')}) as eta, count(*) as rows from u group by 1),
      i as (select code, rows, xi - ({add(geo._BETA, 'sin', 'cosh')}) as xi, eta - ({add(geo._BETA, 'cos', 'sinh')}) as eta from m),
      c as (select *, asin(sin(xi) / cosh(eta)) as chi from i)
      select code, round(degrees(atan2(sinh(eta), cos(xi))) + {tm.lon0}, 6) as lon, round(degrees(chi + {phi}), 6) as lat, rows from c"""


@query("G09_centroids", _centroid_sql())
def g09(spark, sf):
    code = F.when(F.col("id") % 7 == 3, "x3").otherwise((F.col("id") % 7).cast("string"))
    out = ag.centroids(fx.points(spark, sf).withColumn("code", code), "code", "lon", "lat")
    return out.select("code", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "rows")


@query(
    "G10_drop_dry_events",
    fx.sql("census") + ", dry as (select event from census where flooded group by 1 having avg((rain < 38)::int) >= 0.5) select event, count(*) as rows from census where event not in (select event from dry) group by 1",
)
def g10(spark, sf):
    return ag.drop_dry_events(fx.census(spark, sf), "event", F.col("flooded"), "rain", 0.5, 38.0).groupBy("event").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "G11_rate_table",
    fx.sql("census") + f" select {_bin_sql('rel', REL_EDGES)}::int as rel_bin, {_bin_sql('rain', RAIN_EDGES)}::int as rain_bin, count(*) as cells, round(avg(flooded::int), 6) as rate from census group by 1, 2 having count(*) >= 300 and rel_bin is not null and rain_bin is not null",
)
def g11(spark, sf):
    out = ag.rate_table(fx.census(spark, sf), F.col("flooded"), {"rel_bin": ("rel", REL_EDGES), "rain_bin": ("rain", RAIN_EDGES)}, 300)
    return rounded(out, "rate")


@query(
    "G12_rate_table_use",
    fx.sql("census") + f""", s as (select *, greatest(coalesce(built, 0), coalesce(road, 0)) as sealed from census)
      select {_bin_sql('sealed', BUILT_EDGES)}::int as use_bin, {_bin_sql('rel', REL_EDGES)}::int as rel_bin, {_bin_sql('rain', RAIN_EDGES)}::int as rain_bin, count(*) as cells, round(avg(flooded::int), 6) as rate from s group by 1, 2, 3 having count(*) >= 100 and rain_bin is not null and rel_bin is not null and use_bin is not null""",
)
def g12(spark, sf):
    df = fx.census(spark, sf).withColumn("sealed", F.greatest(F.coalesce("built", F.lit(0.0)), F.coalesce("road", F.lit(0.0))))
    bins = {"use_bin": ("sealed", BUILT_EDGES), "rel_bin": ("rel", REL_EDGES), "rain_bin": ("rain", RAIN_EDGES)}
    return rounded(ag.rate_table(df, F.col("flooded"), bins, 100), "rate")


def _crossing_sql() -> str:
    reach = ", ".join(f"min(case when rate >= {lv} then rain_bin end)::int as reach_{round(lv * 100)}" for lv in CROSSING_LEVELS)
    return fx.sql("census") + f""", dry as (select event from census where flooded group by 1 having avg((rain < 1)::int) >= 0.5),
      r as (select {_bin_sql('rel', REL_EDGES)} as rel_bin, {_bin_sql('rain', RAIN_EDGES)} as rain_bin, avg(flooded::int) as rate from census where event not in (select event from dry) group by 1, 2 having count(*) >= 30)
      select rel_bin::int as rel_bin, {reach} from r where rel_bin is not null and rain_bin is not null group by 1"""


@query("G13_first_crossing", _crossing_sql())
def g13(spark, sf):
    """How much rain before ground at this height floods: the first rain bin to reach each rate."""
    kept = ag.drop_dry_events(fx.census(spark, sf), "event", F.col("flooded"), "rain")
    rates = ag.rate_table(kept, F.col("flooded"), {"rel_bin": ("rel", REL_EDGES), "rain_bin": ("rain", RAIN_EDGES)}, 30)
    return ag.first_crossing(rates, "rel_bin", "rain_bin", CROSSING_LEVELS)


@query(
    "G14_deciles",
    """with t as (select l_orderkey, l_linenumber, l_extendedprice as s, l_partkey, (l_returnflag = 'R') as y, 1 + l_linenumber % 3 as w, row_number() over (order by l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 as p, count(*) over () as n from lineitem)
       select least(p // (n // 10), 9)::bigint as decile, count(*) as rows, min(s) as low, max(s) as high, round(sum(case when y then w else 0 end) / sum(w), 6) as rate from t group by 1""",
)
def g14(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("w", (1 + F.col("l_linenumber") % 3).cast("double")).withColumn("id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    return rounded(ag.decile_rates(df, "l_extendedprice", "id", F.col("l_returnflag") == "R", "w"), "rate")


@query(
    "G15_cell_sums",
    "select (l_orderkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as row, (l_partkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as col, count(*) as pieces, sum(l_quantity) as area, round(greatest(0, least(1, sum(l_quantity) / 900)), 6) as share from lineitem where l_quantity <= 45 group by 1, 2",
)
def g15(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_orderkey") % fx.side(spark, sf)).cast("int").alias("row"), (F.col("l_partkey") % fx.side(spark, sf)).cast("int").alias("col"), F.col("l_quantity").alias("area"))
    return rounded(ag.cell_sum(df, "row", "col", "area", 900.0, 45.0), "share")


@query("G16_block_fraction", fx.sql("cells") + " select (row // 10)::bigint as block_row, (col // 10)::bigint as block_col, round(avg((land between 90 and 199 or land between 700 and 799)::int), 6) as fraction from cells group by 1, 2")
def g16(spark, sf):
    return rounded(ag.block_fraction(fx.cells(spark, sf), 10, F.col("land").between(90, 199) | F.col("land").between(700, 799)), "fraction")


@query("G17_pyramid", fx.sql("cells") + ", a as (select row // 2 as row, col // 2 as col, max(score) as score, 1 as level from cells group by 1, 2), b as (select row // 2 as row, col // 2 as col, max(score) as score, 2 as level from a group by 1, 2) select row::bigint as row, col::bigint as col, score, level from a union all select row::bigint, col::bigint, score, level from b")
def g17(spark, sf):
    return ag.pyramid(fx.cells(spark, sf), "score", 2)


@query("G17_block_max", fx.sql("cells") + " select (row // 8)::bigint as row, (col // 8)::bigint as col, max(score) as score from cells group by 1, 2")
def g17b(spark, sf):
    return ag.block_max(fx.cells(spark, sf), 8, "score")


@query("G18_max_depth", "select (l_orderkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as row, (l_partkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as col, max(l_quantity) as depth from lineitem where l_returnflag = 'R' group by 1, 2")
def g18(spark, sf):
    df = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") % fx.side(spark, sf)).cast("int").alias("row"), (F.col("l_partkey") % fx.side(spark, sf)).cast("int").alias("col"), F.col("l_quantity").alias("depth"))
    return ag.max_depth(df, "depth")


@query(
    "G19_zonal",
    fx.sql("census") + """ select zone, event, max(built) as score_max, round(quantile_cont(built, 0.99), 6) as score_p99, round(avg(built), 6) as score_mean, round(avg((built >= 0.05)::int), 6) as over_5, round(avg((built >= 0.1)::int), 6) as over_10,
      max(rain) as rain_max, round(avg(rain), 4) as rain_mean, round(avg(road), 6) as built_mean, count(*) as n from census group by 1, 2""",
)
def g19(spark, sf):
    out = ag.zonal(fx.census(spark, sf), ["zone", "event"], "built", "rain", "road")
    places = {"score_p99": 6, "score_mean": 6, "over_5": 6, "over_10": 6, "rain_mean": 4, "built_mean": 6}
    return out.select(*[sql_rounded(c, places[c]) if c in places else F.col(c) for c in out.columns])


BANDS = {"VERY_HIGH": 0.95, "HIGH": 0.85, "MODERATE": 0.60, "LOW": 0.30}


@query(
    "G20_band_cutoffs",
    fx.sql("cells") + " select level, percentile, trigger_level as rain_trigger, round(case level when 'VERY_HIGH' then quantile_cont(score, 0.95) when 'HIGH' then quantile_cont(score, 0.85) when 'MODERATE' then quantile_cont(score, 0.6) else quantile_cont(score, 0.3) end, 6) as min_score from cells, (values ('VERY_HIGH', 0.95::double, 'ADVISORY'), ('HIGH', 0.85, 'ADVISORY'), ('MODERATE', 0.6, 'WARNING'), ('LOW', 0.3, 'EXTREME')) as b(level, percentile, trigger_level) group by 1, 2, 3",
)
def g20(spark, sf):
    triggers = {"VERY_HIGH": "ADVISORY", "HIGH": "ADVISORY", "MODERATE": "WARNING", "LOW": "EXTREME"}
    return rounded(ag.band_cutoffs(fx.cells(spark, sf), "score", BANDS, triggers), "min_score")


def _paint_sql() -> str:
    cuts = ", ".join(
        f"case level when 10 then quantile_cont(score, {1 - ag.paint_share(10) / d!r}) when 40 then quantile_cont(score, {1 - ag.paint_share(40) / d!r}) else quantile_cont(score, {1 - ag.paint_share(150) / d!r}) end as q{d}" for d in (1, 2, 4, 10)
    )
    return fx.sql("cells") + f""", t as (select row, col, level, score * (1 + level / 1000) as score from cells, (values (10.0::double), (40.0), (150.0)) as v(level)), q as (select level, {cuts} from t group by level)
      select level, ((score >= q1)::int + (score >= q2)::int + (score >= q4)::int + (score >= q10)::int)::int as paint, count(*) as cells from t join q using (level) group by 1, 2"""


@query("G21_paint", _paint_sql())
def g21(spark, sf):
    levels = [10.0, 40.0, 150.0]
    df = fx.cells(spark, sf).select("row", "col", "score", F.explode(F.array(*map(F.lit, levels))).alias("level")).withColumn("score", F.col("score") * (1 + F.col("level") / 1000))
    return ag.paint(df, "score", "level", levels).groupBy("level", "paint").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "G22_expected_counts",
    """with r as (select l_suppkey % 20 as use, count(*) as samples, avg((l_returnflag = 'R')::int) as rate from lineitem where l_linenumber = 1 group by 1 having count(*) >= 50), c as (select l_suppkey % 20 as use, count(*) as buildings from lineitem group by 1)
       select use, buildings, samples, round(rate, 6) as rate, round(buildings * rate, 4) as expected from c left join r using (use)""",
)
def g22(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("use", F.col("l_suppkey") % 20)
    out = ag.expected_counts(df.where("l_linenumber = 1"), df, "use", F.col("l_returnflag") == "R")
    return rounded(out, "rate").withColumn("expected", F.round("expected", 4))


@query("G23_national_rollup", "select o_orderstatus as province, grouping(o_orderstatus)::int as is_total, count(*) as rows, sum((o_orderpriority = '1-URGENT')::int)::bigint as flagged, round(avg(o_totalprice), 4) as mean from orders group by rollup(o_orderstatus)")
def g23(spark, sf):
    out = ag.national_rollup(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "province"), "province", F.col("o_orderpriority") == "1-URGENT", "o_totalprice")
    return out.withColumn("mean", F.round("mean", 4))


@query("G23_use_by_depth", "select l_returnflag as use, l_linestatus as depth, grouping(l_returnflag, l_linestatus)::bigint as grouping, count(*) as rows from lineitem group by cube(l_returnflag, l_linestatus)")
def g23b(spark, sf):
    return ag.use_by_depth(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("use"), F.col("l_linestatus").alias("depth")), "use", "depth")


@query("G24_timeline", "select o_custkey % 10 as k, sum((o_orderstatus = 'F')::int)::bigint as yes, sum((o_orderstatus = 'P')::int)::bigint as partial, sum((o_orderstatus = 'O')::int)::bigint as no, 0::bigint as unknown from orders group by 1")
def g24(spark, sf):
    s = F.col("o_orderstatus")
    df = table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("k"), F.when(s == "F", "YES").when(s == "P", "PARTIAL").when(s == "O", "NO").otherwise("UNKNOWN").alias("status"))
    return ag.timeline(df, "k", "status")


@query("G25_compare_columns", "select count(*) as rows, round(corr(l_quantity, l_extendedprice), 6) as r, round(quantile_cont(l_quantity, 0.5), 6) as median_a, round(quantile_cont(l_extendedprice, 0.5), 6) as median_b, max(abs(l_quantity - l_extendedprice)) as gap_max, round(avg(abs(l_quantity - l_extendedprice)), 4) as gap_mean from lineitem")
def g25(spark, sf):
    out = ag.compare_cols(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(out, "r", "median_a", "median_b").withColumn("gap_mean", F.round("gap_mean", 4))


@query(
    "G26_compare_layers",
    fx.sql("cells") + ", b as (select row, col, case when land % 4 = 0 then z + 1 else z end as z from cells) select count(*) as cells, round(avg((a.z = b.z)::int * 100), 6) as equal_pct, quantile_cont(a.z, 0.5) as a_q50, quantile_cont(b.z, 0.5) as b_q50, round(quantile_cont(a.z, 0.95), 6) as a_q95, round(quantile_cont(b.z, 0.95), 6) as b_q95, round(max(abs(a.z - b.z)), 6) as gap_max from cells a join b using (row, col)",
)
def g26(spark, sf):
    a = fx.cells(spark, sf)
    b = a.withColumn("z", F.when(F.col("land") % 4 == 0, F.col("z") + 1).otherwise(F.col("z")))
    return rounded(ag.compare_layers(a, b, ["row", "col"], "z"), "equal_pct", "a_q95", "b_q95", "gap_max")


@query("G27_median_fill", "with t as (select event_id, case when event_id % 6 = 0 then null else value end as v from events) select event_id, coalesce(v, (select quantile_cont(v, 0.5) from t)) as v from t")
def g27(spark, sf):
    return ag.median_fill(table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("v")), "v")


@query("G28_dup_weight", "select event_id, round(1.0 / count(*) over (partition by user_id, ts::date), 9) as weight from events")
def g28(spark, sf):
    df = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return ag.dup_weight(df, ["user_id", "day"]).select("event_id", F.round("weight", 9).alias("weight"))


@query(
    "G29_inventory",
    "select 'a:int' as schema, 2::bigint as tables, ((select count(*) from orders) + (select count(*) from customer))::bigint as rows, '4326,5179' as crs union all select 'b:int', 1, (select count(*) from part), '5179'",
)
def g29(spark, sf):
    n = lambda name, schema, crs: table(spark, sf, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), F.lit(schema).alias("schema"), "rows", F.lit(crs).alias("crs"))
    profiles = n("orders", "a:int", "5179").unionByName(n("customer", "a:int", "4326")).unionByName(n("part", "b:int", "5179"))
    return ag.inventory(profiles).withColumn("crs", F.array_join("crs", ","))
