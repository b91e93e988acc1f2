"""Queries of storm groups, rain windows and frame accumulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import series
from freshet.plans import fixtures as fx
from freshet.plans.registration import Registry
from freshet.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "W01_storm_groups",
    fx.sql("event_days") + """, n as (select *, case when day - lag(day) over (partition by event_id order by day) <= 1 then 0 else 1 end as fresh from event_days), c as (select *, sum(fresh) over (partition by event_id order by day) as chain from n)
      select event_id, strftime(day, '%Y%m%d') as day, strftime(min(day) over (partition by event_id, chain), '%Y%m%d') as storm from c""",
)
def w01(spark, sf):
    return series.storm_groups(fx.event_days(spark, sf), ["event_id"], "day").select("event_id", F.date_format("day", "yyyyMMdd").alias("day"), "storm")


_W02_SQL = ", ".join(f"case when count(*) filter (o.hour > e.hour - {h}) = {h} then round(sum(o.mm) filter (o.hour > e.hour - {h}), 6) end as rain_{h}h, count(*) filter (o.hour > e.hour - {h}) as hours_{h}h" for h in series.HOURS)


@query(
    "W02_hour_windows",
    fx.sql("obs", "anchors") + f""", e as (select a.event, s.station, epoch(strptime(a.event, '%Y%m%d'))::bigint // 3600 + a.hour as hour from anchors a, (select distinct station from obs) s)
      select e.event, e.station, e.hour, {_W02_SQL} from e join obs o on o.station = e.station and o.hour between e.hour - 23 and e.hour group by 1, 2, 3""",
)
def w02(spark, sf):
    obs = fx.obs(spark, sf)
    at = fx.anchors(spark, sf).select("event", (F.floor(F.unix_timestamp(F.to_timestamp("event", "yyyyMMdd")) / 3600) + F.col("hour")).alias("hour"))
    ev = at.crossJoin(F.broadcast(obs.select("station").distinct()))  # every station at every event; one for 1,000 events
    return rounded(series.hour_windows(ev, obs, ["event"]))


@query(
    "W02_every_hour",
    fx.sql("obs") + """ select station, hour, count(mm) over w as hours_3h, case when count(mm) over w = 3 then round(sum(mm) over w, 6) end as rain_3h from obs window w as (partition by station order by hour range between 2 preceding and current row)""",
)
def w02b(spark, sf):
    return rounded(series.hour_windows_all(fx.obs(spark, sf), [3])).drop("mm")


_KEYS = ["event", "pt"]


def _accumulate_sql(source: str, order: str) -> str:
    sums = ", ".join(f"round(sum(case when run <= {h * 60} or n = 1 then rate * span_min end) / sum(case when (run <= {h * 60} or n = 1) and rate is not null then span_min end) * {h}, 6) as rain_{h}h" for h in series.HOURS)
    return f""", r as (select *, sum(span_min) over (partition by event, pt order by stamp {order} rows unbounded preceding) as run, row_number() over (partition by event, pt order by stamp {order}) as n from {source})
      select event, pt, {sums} from r group by 1, 2"""


def _holed(spark, sf):
    return fx.frames(spark, sf).withColumn("rate", F.when(F.col("stamp") % 7 != 0, F.col("rate")))


_HOLED_SQL = ", f as (select event, pt, stamp, span_min, case when stamp % 7 = 0 then null else rate end as rate from frames)"


@query("W03_accumulate", fx.sql("frames") + _HOLED_SQL + _accumulate_sql("f", "desc"))
def w03(spark, sf):
    return rounded(series.accumulate(_holed(spark, sf), _KEYS))


@query("W03_accumulate_forward", fx.sql("frames") + _HOLED_SQL + _accumulate_sql("f", "asc"))
def w03b(spark, sf):
    return rounded(series.accumulate(_holed(spark, sf), _KEYS, forward=True))


@query(
    "W04_accumulate_after",
    fx.sql("frames", "anchors") + """, a as (select f.*, count(*) over (partition by f.event, pt) as frames_after from frames f join anchors using (event) where stamp > epoch(strptime(event, '%Y%m%d'))::bigint // 60 + hour * 60), f2 as (select event, pt, stamp, span_min, rate from a where frames_after >= 2)""" + _accumulate_sql("f2", "asc"),
)
def w04(spark, sf):
    at = fx.anchors(spark, sf).select("event", (F.floor(F.unix_timestamp(F.to_timestamp("event", "yyyyMMdd")) / 60) + F.col("hour") * 60).alias("anchor"))
    return rounded(series.accumulate_after(fx.frames(spark, sf).join(at, "event"), _KEYS, "anchor"))


def _shape_sql(source: str) -> str:
    return f""", r as (select *, sum(span_min) over (partition by event, pt order by stamp rows unbounded preceding) as done, rate * span_min / 60 as mm from {source}),
      h as (select *, sum(mm) over (partition by event, pt order by done range between current row and 60 following) as hour_mm, max(done) over (partition by event, pt) - done as back from r)
      select event, pt, round(max(rate), 6) as peak_rate, round(max(hour_mm), 6) as peak_hour, round(coalesce(sum(mm) filter (back >= 1440 and back < 2880), 0), 6) as rain_24_48h, round(coalesce(sum(span_min / 60) filter (rate > 1), 0), 6) as wet_hours from h group by 1, 2"""


@query("W05_storm_shape", fx.sql("frames") + _shape_sql("frames"))
def w05(spark, sf):
    return rounded(series.storm_shape(fx.frames(spark, sf), _KEYS))


@query(
    "W06_rain_shape",
    fx.sql("frames") + """, l as (select *, rate * span_min / 60 as mm from (select *, max(stamp) over (partition by event, pt) - stamp as ago from frames) where ago < 360),
      h as (select *, sum(mm) over (partition by event, pt order by stamp range between 59 preceding and current row) as hour_mm from l)
      select event, pt, round(max(rate), 6) as peak_rate, round(max(hour_mm), 6) as peak_hour, sum(case when rate > 0.1 then span_min else 0 end)::bigint as wet_minutes, arg_min(stamp, (-rate, stamp)) - min(stamp) as minutes_to_peak,
        round(sum(mm), 6) as total, case when sum(mm) > 1 then round(max(hour_mm) / sum(mm), 6) end as burst from h group by 1, 2""",
)
def w06(spark, sf):
    return rounded(series.rain_shape(fx.frames(spark, sf), _KEYS))


@query(
    "W07_best_anchor",
    fx.sql("frames") + """, r as (select *, sum(rate * span_min / 60) over (partition by event, pt order by stamp range between 359 preceding and current row) as rain from frames),
      g as (select event, stamp, quantile_cont(rain, 0.5) filter (pt < 5) - quantile_cont(rain, 0.5) filter (pt >= 5) as gap from r group by 1, 2)
      select event, arg_max(stamp, (round(gap, 9), -stamp)) as cut, round(max(gap), 6) as gap from g where gap is not null group by 1""",
)
def w07(spark, sf):
    return rounded(series.best_anchor(fx.frames(spark, sf), F.col("pt") < 5))


@query(
    "W08_region_rank",
    """with t as (select o_orderkey as id, o_orderpriority as region, case when o_orderkey % 8 = 0 then null else o_totalprice end as v from orders), n as (select *, count(v) over (partition by region) as n, row_number() over (partition by region order by v nulls last, id) - 1 as p from t)
       select id, case when v is not null and n >= 10 then round(p / greatest(n - 1, 1), 9) end as region_rank from n""",
)
def w08(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("region"), F.when(F.col("o_orderkey") % 8 != 0, F.col("o_totalprice")).alias("v"))
    return rounded(series.region_rank(df, "region", "v", ["id"]), 9).select("id", "region_rank")


@query(
    "W09_region_quantile",
    """with t as (select o_orderkey as id, o_orderpriority as region, case when o_orderkey % 8 = 0 then null else o_totalprice end as v from orders), q as (select region, quantile_cont(v, list_transform(range(101), lambda i: i / 100.0::double)) as qs from t group by 1 having count(v) >= 20)
       select id, case when v is not null and qs is not null then least(len(list_filter(qs, lambda e: e < v)) / 100, 1) end as quantile from t left join q using (region)""",
)
def w09(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("region"), F.when(F.col("o_orderkey") % 8 != 0, F.col("o_totalprice")).alias("v"))
    return series.region_quantile(df, "region", "v").select("id", "quantile")


@query("W10_rank_average", "select event_id, round((rank() over (order by round(value)) + (count(*) over (partition by round(value)) - 1) / 2) / count(*) over (), 9) as r from events")
def w10(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.round("value").alias("v"))
    return series.rank_average(df, "v", "r").select("event_id", F.round("r", 9).alias("r"))


@query(
    "W11_label_upto",
    "with t as (select event_type as event, user_id as cell, hour(ts)::int as hour from events where value > 150), f as (select event, cell, min(hour) as f from t group by 1, 2) select event, cell, h::int as hour, (f <= h)::int as label from f, (select unnest([3, 9, 15, 21]) as h)",
)
def w11(spark, sf):
    flooded = table(spark, sf, "events").where("value > 150").select(F.col("event_type").alias("event"), F.col("user_id").alias("cell"), F.hour("ts").alias("hour"))
    hours = flooded.select("event").distinct().withColumn("hour", F.explode(F.array(*map(F.lit, (3, 9, 15, 21)))))
    return series.label_upto(flooded, hours)


@query("W18_latest", "select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value from events group by 1")
def w18(spark, sf):
    return series.latest(table(spark, sf, "events"), ["user_id"], F.struct("ts", "event_id"), ["event_type", "value"])
