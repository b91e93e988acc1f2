"""Storm groups, rain windows and radar-frame accumulations with SQL windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.ordering import quantiles, running
from freshet.session import stored

HOURS = (1, 3, 6, 12, 24)


def storm_groups(df: DataFrame, keys: Sequence[str], day: str, gap_days: int = 1) -> DataFrame:
    """Dates at most ``gap_days`` apart chain together; storm = first date; undated rows get a hash of their own."""
    by_day = Window.partitionBy(*keys).orderBy(day)
    dated = df.where(F.col(day).isNotNull())
    starts = dated.withColumn("_new", F.when(F.datediff(day, F.lag(day).over(by_day)) <= gap_days, 0).otherwise(1))
    chained = starts.withColumn("_chain", F.sum("_new").over(by_day))
    first = F.min(day).over(Window.partitionBy(*keys, "_chain"))
    named = chained.withColumn("storm", F.date_format(first, "yyyyMMdd")).drop("_new", "_chain")
    undated = df.where(F.col(day).isNull()).withColumn("storm", F.concat(F.lit("undated-"), F.hex(F.xxhash64(*[F.col(c) for c in df.columns]))))
    return named.unionByName(undated)


def hour_windows(ev: DataFrame, obs: DataFrame, key: Sequence[str], hours: Sequence[int] = HOURS) -> DataFrame:
    """Rain of the last h hours up to each event's ``hour``, for each (event, station) with any reading.

    ``ev`` has ``key`` columns, ``station`` and ``hour``; ``obs`` has station, hour, mm. A
    total is NULL unless all its hours are there; the available hours are kept.
    """
    longest = max(hours)
    asked = ev.withColumn("_off", F.explode(F.sequence(F.lit(0), F.lit(longest - 1)))).withColumn("_at", F.col("hour") - F.col("_off"))
    seen = obs.select(F.col("station").alias("_st"), F.col("hour").alias("_h"), F.col("mm").alias("_mm")).where("_mm is not null")
    met = asked.join(seen.hint("merge"), (F.col("station") == F.col("_st")) & (F.col("_at") == F.col("_h")))
    got = met.groupBy(*key, "station", "hour").agg(
        *[F.count(F.when(F.col("_off") < h, 1)).alias(f"hours_{h}h") for h in hours], *[F.sum(F.when(F.col("_off") < h, F.col("_mm"))).alias(f"_sum_{h}") for h in hours]
    )
    rain = [F.when(F.col(f"hours_{h}h") == h, F.col(f"_sum_{h}")).alias(f"rain_{h}h") for h in hours]
    return got.select(*key, "station", "hour", *rain, *[f"hours_{h}h" for h in hours])


def hour_windows_all(obs: DataFrame, hours: Sequence[int]) -> DataFrame:
    """The same for every station and hour of ``obs``, by range windows and without a join."""
    out = obs
    for h in hours:
        back = Window.partitionBy("station").orderBy("hour").rangeBetween(-(h - 1), 0)
        n = F.count("mm").over(back)
        out = out.withColumn(f"hours_{h}h", n).withColumn(f"rain_{h}h", F.when(n == h, F.sum("mm").over(back)))
    return out


def accumulate(frames: DataFrame, keys: Sequence[str], hours: Sequence[int] = HOURS, forward: bool = False) -> DataFrame:
    """Span-weighted rain of each window counted from the last frame (or the first, ``forward``).

    Frames whose running span fits in the window, else the single end frame:
    sum(rate x span) / sum(span) over known rates, times the hours.
    """
    order = F.col("stamp").asc() if forward else F.col("stamp").desc()
    run = Window.partitionBy(*keys).orderBy(order)
    df = frames.withColumn("_run", F.sum("span_min").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(run))
    out = []
    for h in hours:
        fits = (F.col("_run") <= h * 60) | (F.col("_n") == 1)
        known = F.when(fits & F.col("rate").isNotNull(), F.col("span_min"))
        out.append((F.sum(F.when(fits, F.col("rate") * F.col("span_min"))) / F.sum(known) * h).alias(f"rain_{h}h"))
    return df.groupBy(*keys).agg(*out)


def accumulate_after(frames: DataFrame, keys: Sequence[str], anchor: str, hours: Sequence[int] = HOURS) -> DataFrame:
    """Rain after the event's hour (a leak test), for keys with two frames or more there."""
    after = frames.where(F.col("stamp") > F.col(anchor))
    enough = after.withColumn("_frames", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_frames >= 2").drop("_frames")
    return accumulate(enough, keys, hours, forward=True)


def storm_shape(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Peak rate, heaviest hour, rain 24 to 48 h before the end, and hours with over 1 mm/h."""
    run = Window.partitionBy(*keys).orderBy("stamp").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    df = frames.withColumn("_end", F.sum("span_min").over(run)).withColumn("_mm", F.col("rate") * F.col("span_min") / 60)
    ahead = Window.partitionBy(*keys).orderBy("_end").rangeBetween(0, 60)
    df = df.withColumn("_hour", F.sum("_mm").over(ahead)).withColumn("_back", F.max("_end").over(whole) - F.col("_end"))
    return df.groupBy(*keys).agg(
        F.max("rate").alias("peak_rate"),
        F.max("_hour").alias("peak_hour"),
        F.coalesce(F.sum(F.when((F.col("_back") >= 24 * 60) & (F.col("_back") < 48 * 60), F.col("_mm"))), F.lit(0.0)).alias("rain_24_48h"),
        F.coalesce(F.sum(F.when(F.col("rate") > 1, F.col("span_min") / 60)), F.lit(0.0)).alias("wet_hours"),
    )


def rain_shape(frames: DataFrame, keys: Sequence[str], window_min: int = 360, step_min: int = 60, wet: float = 0.1) -> DataFrame:
    """Shape over the last ``window_min`` minutes: peak, heaviest moving hour, wet minutes, minutes to the peak, burst."""
    last = F.max("stamp").over(Window.partitionBy(*keys))
    df = frames.withColumn("_ago", last - F.col("stamp")).where(F.col("_ago") < window_min)
    moving = Window.partitionBy(*keys).orderBy("stamp").rangeBetween(-(step_min - 1), 0)
    df = df.withColumn("_mm", F.coalesce("rate", F.lit(0.0)) * F.col("span_min") / 60).withColumn("_hour", F.sum("_mm").over(moving))
    out = df.groupBy(*keys).agg(
        F.max("rate").alias("peak_rate"),
        F.max("_hour").alias("peak_hour"),
        F.sum(F.when(F.col("rate") > wet, F.col("span_min")).otherwise(0)).alias("wet_minutes"),
        (F.min_by("stamp", F.struct(-F.coalesce("rate", F.lit(0.0)), F.col("stamp"))) - F.min("stamp")).alias("minutes_to_peak"),
        F.sum("_mm").alias("total"),
    )
    return out.withColumn("burst", F.when(F.col("total") > 1, F.col("peak_hour") / F.col("total")))


def best_anchor(frames: DataFrame, flooded: Column, hours: int = 6) -> DataFrame:
    """For each event the cut whose median rain parts flooded from other points most (event, cut, gap).

    Each cut is a frame stamp; the rain before it comes from one range window per point.
    """
    before = Window.partitionBy("event", "pt").orderBy("stamp").rangeBetween(-(hours * 60 - 1), 0)
    rain = frames.withColumn("_rain", F.sum(F.col("rate") * F.col("span_min") / 60).over(before)).withColumn("_f", flooded)
    med = lambda f: F.percentile(F.when(f, F.col("_rain")), F.lit(0.5))
    cuts = rain.groupBy("event", "stamp").agg((med(F.col("_f")) - med(~F.col("_f"))).alias("gap")).where("gap is not null")
    return cuts.groupBy("event").agg(F.max_by("stamp", F.struct(F.round("gap", 9), -F.col("stamp"))).alias("cut"), F.max("gap").alias("gap"))


def region_rank(df: DataFrame, region: str, value: str, ident: Sequence[str], least: int = 10) -> DataFrame:
    """Place of a value in its region, 0 to 1; NULL stays NULL, and so do regions with few values.

    Ties go by ``ident``. Null values sort last, so they don't shift the others. Places are
    those in the order of all rows, by range partitions, less the region's first one.
    """
    placed = stored(running(df, [F.col(region), F.col(value).asc_nulls_last(), *map(F.col, ident)], {"_place": F.lit(1)}))
    sizes = placed.groupBy(F.col(region).alias("_region")).agg(F.count(value).alias("_known"), F.min("_place").alias("_first"))
    # a row for each region; a region of many rows is split by the skew join
    joined = placed.join(sizes.hint("merge"), F.col(region).eqNullSafe(F.col("_region")))
    rank = (F.col("_place") - F.col("_first")) / F.greatest(F.col("_known") - 1, F.lit(1))
    ranked = joined.withColumn("region_rank", F.when(F.col(value).isNotNull() & (F.col("_known") >= least), rank))
    return ranked.drop("_place", "_region", "_known", "_first")


def region_quantile(df: DataFrame, region: str, value: str, edges: int = 101, least: int = 20) -> DataFrame:
    """Share of its region's quantile edges that a value reaches; NULL stays NULL."""
    shares = [i / (edges - 1) for i in range(edges)]
    cut = quantiles(df, value, shares, group=region).where(F.col("n") >= least).select(F.col(region).alias("_region"), F.col("q").alias("_q"))
    joined = df.join(cut.hint("merge"), F.col(region) == F.col("_region"), "left")
    at = F.size(F.filter("_q", lambda e: e < F.col(value))) / (edges - 1)
    return joined.withColumn("quantile", F.when(F.col(value).isNotNull() & F.col("_q").isNotNull(), F.least(at, F.lit(1.0)))).drop("_q", "_region")


def rank_average(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank of ties over the number of rows, by running counts of distinct values."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    upto = running(counts, [F.col(value)], {"_upto": F.col("_c")})
    rows = F.broadcast(upto.agg(F.sum("_c").alias("_rows")))  # one row
    ranked = upto.crossJoin(rows).select(F.col(value).alias("_v"), ((F.col("_upto") - (F.col("_c") - 1) / 2) / F.col("_rows")).alias(name))
    return df.join(ranked.hint("shuffle_merge"), F.col(value) == F.col("_v")).drop("_v")


def label_upto(cells: DataFrame, hours: DataFrame) -> DataFrame:
    """(event, cell, hour, label): at hour T a cell is positive if it flooded at any hour up to T."""
    first = cells.groupBy("event", "cell").agg(F.min("hour").alias("_first"))
    return first.join(hours, "event").select("event", "cell", "hour", F.when(F.col("_first") <= F.col("hour"), 1).otherwise(0).alias("label"))


def latest(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """The latest values of each key."""
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns])
