"""Queries of the models, and of the gauge feed's jobs run over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from freshet.operators import metrics, models
from freshet.operators import relational as rel
from freshet.operators.series import rank_average
from freshet.plans import fixtures as fx
from freshet.plans.q_rel import DRAW_SQL
from freshet.plans.registration import Registry
from freshet.session import checkpointed, shared_dir, stored, table
from freshet.streaming import rain

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
FEATURES = ("rel", "rain", "built", "road")


def _rows(spark, sf):
    df = fx.census(spark, sf).withColumn("y", F.col("flooded").cast("int")).withColumn("storm", (F.col("zone") % 6).cast("int"))
    return df.select("id", "storm", "event", "y", F.when(F.col("id") % 9 != 0, F.col("rel")).alias("rel"), "rain", "built", "road")


def _fit(features=FEATURES, trees=3):
    return lambda df: models.fit_gbt(df, features, trees=trees, depth=3)


def _folds(spark, sf, k=3):
    return checkpointed(rel.balanced_folds(_rows(spark, sf), "storm", F.col("y") == 1, k))


@query("M01_fit_gbt")
def m01(spark, sf):
    df = _rows(spark, sf)
    return _fit()(df)(df).select("id", "y", F.round("score", 6).alias("score"))


@query("M02_score_grid")
def m02(spark, sf):
    score = models.fit_gbt(_rows(spark, sf), ("rel", "rain"), trees=3, depth=3)
    cells = fx.cells(spark, sf).select("row", "col", F.col("z").alias("rel"))
    return models.score_grid(score, cells, [10, 30, 40, 80]).select("row", "col", "level", F.round("p", 6).alias("p"))


@query("M08_leave_one_out")
def m08(spark, sf):
    return models.logo_precision(_rows(spark, sf), "storm", FEATURES, trees=3, depth=3)


@query("M09_group_cv")
def m09(spark, sf):
    return models.evaluate(models.group_cv(_rows(spark, sf), _folds(spark, sf), "storm", _fit()), "fold")


@query(
    "M10_splits",
    f"""select 'temporal' as kind, case when year(o_orderdate) + 22 <= 2018 then 'train' else 'test' end as part, count(*) as rows from orders group by 2 union all
      select 'random', case when {DRAW_SQL('o_orderkey')} < 0.7 then 'train' else 'test' end, count(*) from orders group by 2 union all
      select 'block', floor({DRAW_SQL('o_custkey // 10, o_orderkey // 10')} * 5)::bigint::varchar, count(*) from orders group by 2""",
)
def m10(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.year("o_orderdate") + 22).alias("year"), F.col("o_custkey").alias("row"), F.col("o_orderkey").alias("col"))
    parts = [models.splits(df, k).groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("kind"), "part", "rows") for k in ("temporal", "random", "block")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("M11_compare_tables")
def m11(spark, sf):
    df = _rows(spark, sf)
    return models.compare_tables(df, df.where("rain > 20"), df, "storm", _folds(spark, sf, 2), _fit())


@query("M12_ablation")
def m12(spark, sf):
    return models.ablate(_rows(spark, sf), {"terrain": ("rel",), "all": FEATURES}, _folds(spark, sf, 2), "storm", _fit)


@query("M18_search")
def m18(spark, sf):
    folds = _folds(spark, sf, 4)
    return models.search(_rows(spark, sf), [{"trees": 2}, {"trees": 4}], folds.where("fold < 2"), folds.where("fold >= 2"), "storm", lambda p: _fit(trees=p["trees"]), 1)


@query("M19_curves")
def m19(spark, sf):
    df = _rows(spark, sf)
    return models.curves(df.where("storm < 4"), df.where("storm = 4"), df.where("storm = 5"), FEATURES, trees=5, depth=3)


@query("M19_storm_curve")
def m19b(spark, sf):
    df = _rows(spark, sf)
    return models.storm_curve(df.where("storm < 4"), df.where("storm = 5"), "storm", _fit(), [1, 2, 4])


@query("M20_principal")
def m20(spark, sf):
    out, _ = models.principal(_rows(spark, sf), FEATURES, 3)
    return out.agg(*[F.round(F.var_samp(f"pc_{i}"), 4).alias(f"var_{i}") for i in range(3)])


@query("M21_ensemble")
def m21(spark, sf):
    sc = fx.scores(spark, sf)
    ranked = rank_average(rank_average(sc, "s", "r1"), "s2", "r2")
    _, scored = models.ensemble(ranked, ["r1", "r2"], "y", F.col("id") % 2 == 0)
    return metrics.avg_precision(scored, "y", "score")


@query("M22_importance")
def m22(spark, sf):
    df = _rows(spark, sf)
    fits = [_fit()(df.where(F.col("storm") % 2 == k)) for k in (0, 1)]
    return metrics.importance_share(models.importances(fits))


@query("M23_falsify")
def m23(spark, sf):
    """The score with each storm's own rain, with a partner's rain, and on wet rows only."""
    df = _rows(spark, sf).withColumn("place", F.col("id") % 500)
    swapped = rel.swap_partner(df, "storm", "place", "rain", 2).withColumn("rain", F.col("swapped")).drop("swapped")
    arms = {"own": df, "swapped": swapped, "wet": df.where("rain > 10")}
    folds = _folds(spark, sf, 2)
    parts = [models.evaluate(models.group_cv(t, folds, "storm", _fit()), "fold").withColumn("arm", F.lit(a)) for a, t in arms.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _gauges(spark, sf):
    e = table(spark, sf, "events")
    hourly = e.groupBy((F.col("user_id") % fx.stations(spark, sf)).alias("station_id"), F.date_trunc("hour", "ts").alias("obs_ts")).agg((F.sum("value") / 10).alias("mm"))
    return hourly.unionByName(hourly.where("station_id = 3"))  # one station sends everything twice


@query("X06_ingest", fx.sql("frames") + " select event, count(*) as frames, round(sum(rate), 6) as rate from frames group by 1")
def x06(spark, sf):
    """Frames that arrive in several files, a third of them twice, in batches of two files."""
    place = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    f = fx.frames(spark, sf).select("event", "pt", "stamp", "span_min", "rate")
    f.repartition(3, "pt").write.parquet(f"{place}/in")
    f.where("stamp % 3 = 0").coalesce(1).write.mode("append").parquet(f"{place}/in")
    rain.ingest(spark, f"{place}/in", f.schema, f"{place}/out", f"{place}/checkpoint", once=["event", "pt", "stamp", "span_min"], files_per_batch=2).awaitTermination()
    got = spark.read.schema(f.select("pt", "stamp", "span_min", "rate", "event").schema).parquet(f"{place}/out")
    return got.groupBy("event").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("rate"), 6).alias("rate"))


_SEEN = ", ".join(f"round(sum(mm) filter (h > until_hour - {h}), 6) as seen_{h}h, count(*) filter (h > until_hour - {h}) as hours_{h}h" for h in rain.HOURS)
_ROLLING = fx.sql("obs") + f""", w as (select station as station_id, hour as h, mm, hour + i as until_hour from obs, (select unnest(range(12)) as i)), r as (select station_id, until_hour, {_SEEN} from w group by 1, 2)"""


def _hours(df):
    return df.withColumn("until_hour", F.floor(F.unix_timestamp("at") / 3600) - 1).drop("at")


@query("X01_rolling_rain", _ROLLING + " select station_id, until_hour, " + ", ".join(f"seen_{h}h, hours_{h}h, case when hours_{h}h = {h} then seen_{h}h end as rain_{h}h" for h in rain.HOURS) + " from r")
def x01(spark, sf):
    out = _hours(rain.rolling_rain(_gauges(spark, sf)))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("X02_dedupe", fx.sql("obs") + " select station as station_id, count(*) as readings from obs group by 1")
def x02(spark, sf):
    return rain.dedupe(_gauges(spark, sf)).groupBy("station_id").agg(F.count(F.lit(1)).alias("readings"))


_LEVEL = "case when seen_1h >= 72 or (seen_1h >= 50 and seen_3h >= 90) then 'EXTREME' when seen_3h >= 90 or seen_12h >= 180 then 'WARNING' when seen_3h >= 60 or seen_12h >= 110 then 'ADVISORY' else 'NONE' end"


@query("X03_late_policy", _ROLLING + f", z as (select *, {_LEVEL.replace('seen_1h', 'coalesce(seen_1h, 0)').replace('seen_3h', 'coalesce(seen_3h, 0)')} as level from r) select station_id, until_hour, level, hours_12h < 12 as partial from z")
def x03(spark, sf):
    return _hours(rain.late_policy(rain.rolling_rain(_gauges(spark, sf)))).select("station_id", "until_hour", "level", "partial")


def _places(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("place_id"), "label")
    ranked = v.withColumn("rank", F.explode(F.array(F.lit(0), F.lit(1))))
    band = F.when(F.col("label") == 0, "UNKNOWN").when(F.col("label") < 5, "HIGH").otherwise("LOW")
    station = F.when(F.col("rank") == 0, F.col("place_id") % 14).otherwise(F.col("place_id") % 3)
    return ranked.select("place_id", band.alias("risk"), F.when(F.col("place_id") % 11 != 0, station).alias("station_id"), "rank")


@query(
    "X04_alerts",
    _ROLLING + f""", z as (select *, {_LEVEL.replace('seen_1h', 'coalesce(seen_1h, 0)').replace('seen_3h', 'coalesce(seen_3h, 0)')} as level, row_number() over (partition by station_id order by until_hour desc) as n from r), l as (select * from z where n = 1),
      p as (select vec_id as place_id, case when label = 0 then 'UNKNOWN' when label < 5 then 'HIGH' else 'LOW' end as risk, case when vec_id % 11 <> 0 then case when k = 0 then vec_id % 14 else vec_id % 3 end end as st, k from embeddings, (select unnest([0, 1]) as k)),
      t as (select p.*, l.station_id is not null as ok, l.level from p left join l on l.station_id = p.st), b as (select place_id, risk, arg_min(case when ok then st end, (not ok, k)) filter (ok) as station_id, arg_min(level, (not ok, k)) filter (ok) as level, bool_or(ok) as ok from t group by 1, 2),
      g as (select *, case level when 'NONE' then 0 when 'ADVISORY' then 1 when 'WARNING' then 2 else 3 end - case risk when 'HIGH' then 1 when 'LOW' then 3 else 2 end as gap from b)
      select place_id, station_id, level, case when risk = 'UNKNOWN' or not ok then 'UNKNOWN' when level = 'NONE' then 'CALM' when gap >= 2 then 'EVACUATE' when gap = 1 then 'PREPARE' else 'WATCH' end as alert from g""",
)
def x04(spark, sf):
    return rain.alerts(_places(spark, sf), rain.late_policy(rain.latest_rain(rain.rolling_rain(_gauges(spark, sf)))))


_NEWEST = ", ".join(f"sum(mm) filter (hour > newest - {h}) as seen_{h}h, count(mm) filter (hour > newest - {h}) as hours_{h}h" for h in rain.HOURS)


@query(
    "X04_live_alerts",
    fx.sql("obs")
    + f""", o as (select station as station_id, hour, mm, max(hour) over (partition by station) as newest, max(hour) over () as last from obs),
      r as (select station_id, newest + 3 < last - 2 as silent, {_NEWEST} from o where hour > newest - 12 group by station_id, newest, last),
      l as (select station_id, {_LEVEL.replace("seen_1h", "coalesce(seen_1h, 0)").replace("seen_3h", "coalesce(seen_3h, 0)").replace("seen_12h", "coalesce(seen_12h, 0)")} as level from r where not silent),
      p as (
        select vec_id as place_id, case when label = 0 then 'UNKNOWN' when label < 5 then 'HIGH' else 'LOW' end as risk,
          case when vec_id % 11 <> 0 then case when k = 0 then vec_id % 14 else vec_id % 3 end end as st, k
        from embeddings, (select unnest([0, 1]) as k)),
      t as (select p.*, l.station_id is not null as ok, l.level from p left join l on l.station_id = p.st),
      b as (
        select place_id, risk, arg_min(case when ok then st end, (not ok, k)) filter (ok) as station_id, arg_min(level, (not ok, k)) filter (ok) as level, bool_or(ok) as ok
        from t group by 1, 2),
      g as (
        select *, case level when 'NONE' then 0 when 'ADVISORY' then 1 when 'WARNING' then 2 else 3 end - case risk when 'HIGH' then 1 when 'LOW' then 3 else 2 end as gap from b)
      select place_id, station_id, level,
        case when risk = 'UNKNOWN' or not ok then 'UNKNOWN' when level = 'NONE' then 'CALM' when gap >= 2 then 'EVACUATE' when gap = 1 then 'PREPARE' else 'WATCH' end as alert from g""",
)
def x04b(spark, sf):
    """The feed in four files, one after the other, and each place's last change."""
    place = f"{shared_dir(spark)}/alerts-{uuid.uuid4().hex}"
    feed = stored(_gauges(spark, sf).select("station_id", "obs_ts", "mm", F.unix_timestamp("obs_ts").alias("t")))
    first, last = feed.agg(F.min("t"), F.max("t")).first()
    feed = feed.withColumn("part", F.floor(4 * (F.col("t") - first) / (last - first + 1))).drop("t")
    for k in range(4):  # files arrive in order of time
        feed.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{place}/in")
    stream = spark.readStream.schema("station_id long, obs_ts timestamp, mm double").option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    places = stored(_places(spark, sf))
    rain.alert_stream(stream, places, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    changes = spark.read.schema("place_id long, station_id long, level string, alert string, batch long").parquet(f"{place}/out/alerts")
    last = changes.groupBy(F.col("place_id").alias("_p")).agg(F.max_by(F.struct("station_id", "level", "alert"), "batch").alias("_s"))
    every = places.select("place_id").distinct().join(last.hint("shuffle_hash"), F.col("place_id") == F.col("_p"), "left")
    return every.select("place_id", "_s.station_id", "_s.level", F.coalesce("_s.alert", F.lit("UNKNOWN")).alias("alert"))


@query("X05_availability", _ROLLING + ", l as (select distinct station_id from r), p as (select vec_id as place_id, case when vec_id % 11 <> 0 then vec_id % 14 end as st from embeddings) select place_id, case when st is null then 'NO_STATION' when station_id is null then 'NO_DATA' else 'OK' end as state from p left join l on station_id = st")
def x05(spark, sf):
    latest = rain.late_policy(rain.latest_rain(rain.rolling_rain(_gauges(spark, sf))))
    return rain.availability(_places(spark, sf).where("rank = 0"), latest).select("place_id", "state")


@query(
    "W01_storm_sessions",
    fx.sql("event_days") + """, n as (select *, case when day - lag(day) over (partition by event_id order by day) <= 1 then 0 else 1 end as fresh from event_days), c as (select *, sum(fresh) over (partition by event_id order by day) as chain from n)
      select event_id, strftime(min(day), '%Y%m%d') as first_day, count(*) as days from c group by event_id, chain""",
)
def w01s(spark, sf):
    days = fx.event_days(spark, sf).withColumn("day", F.col("day").cast("timestamp"))
    return rain.storm_sessions(days, "event_id").withColumn("first_day", F.date_format("first_day", "yyyyMMdd"))
