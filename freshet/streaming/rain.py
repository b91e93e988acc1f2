"""The live gauge feed as Structured Streaming jobs.

Gauge readings are (station_id, obs_ts, mm). The same functions work on batch tables,
which is how the tests compare a stream's output with the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from freshet.functions import risk

HOURS = (1, 3, 6, 12)
DELAY = "2 hours"


def dedupe(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """One reading for each station and hour, within the watermark."""
    if stream.isStreaming:
        return stream.withWatermark("obs_ts", delay).dropDuplicatesWithinWatermark(["station_id", "obs_ts"])
    return stream.dropDuplicates(["station_id", "obs_ts"])


def rolling_rain(stream: DataFrame, hours: Sequence[int] = HOURS, delay: str = DELAY) -> DataFrame:
    """(station_id, at, rain_h, hours_h): totals of the last h hours up to each full hour.

    Sliding windows of the longest reach. A total with a missing hour is NULL; the sum of
    what is there and the hours available come along (``partial`` tells a warning made from
    incomplete totals). Readings later than the watermark are dropped by the state store.
    """
    longest = max(hours)
    clean = dedupe(stream, delay)
    windowed = clean.select("station_id", "obs_ts", "mm", F.window("obs_ts", f"{longest} hours", "1 hour").alias("w"))
    out = []
    for h in hours:
        inside = F.col("obs_ts") >= F.col("w.end") - F.make_interval(hours=F.lit(h))
        out += [F.sum(F.when(inside, F.col("mm"))).alias(f"seen_{h}h"), F.count(F.when(inside & F.col("mm").isNotNull(), 1)).alias(f"hours_{h}h")]
    totals = windowed.groupBy("station_id", "w").agg(*out)
    return totals.select(
        "station_id", F.col("w.end").alias("at"),
        *[F.when(F.col(f"hours_{h}h") == h, F.col(f"seen_{h}h")).alias(f"rain_{h}h") for h in hours],
        *[F.col(f"{n}_{h}h") for n in ("seen", "hours") for h in hours],
    )


def late_policy(rain: DataFrame) -> DataFrame:
    """``rain`` with the level from the available hours, and whether it is partial or unavailable.

    A missing hour is never rain 0: with hours missing the level is a lower bound
    (``partial``); with none at all the state is NO_DATA. Sums are rounded to 6 digits before
    they meet the thresholds, as the sum of 60 mm may come out below 60 in another order.
    """
    level = risk.warning_level(*[F.round(f"seen_{h}h", 6) for h in (1, 3, 12)])
    partial = F.col("rain_12h").isNull()
    none = F.coalesce(F.col("hours_12h"), F.lit(0)) == 0
    return rain.withColumns({"level": F.when(none, None).otherwise(level), "partial": partial, "state": F.when(none, "NO_DATA").otherwise("OK")})


def availability(places: DataFrame, rain: DataFrame) -> DataFrame:
    """``places`` (place_id, station_id, ...) with their station's rain; no station or no data is never dry."""
    joined = places.join(rain.hint("merge"), "station_id", "left")
    state = F.when(F.col("station_id").isNull(), "NO_STATION").when(F.col("state").isNull() | (F.col("state") == "NO_DATA"), "NO_DATA").otherwise("OK")
    return joined.withColumn("state", state).withColumn("available", F.col("state") == "OK")


def alerts(places: DataFrame, rain: DataFrame) -> DataFrame:
    """(place_id, station_id, level, alert): the first reporting station of each place's list, then the rules.

    ``places`` has a row for each (place_id, risk, station_id, rank), nearest first; ``rain``
    a row for each station.
    """
    told = availability(places, rain)
    best = told.groupBy("place_id", "risk").agg(F.min_by(F.struct("station_id", "level", "available"), F.struct(~F.col("available"), F.col("rank"))).alias("_b"))
    alert = risk.alert(F.col("risk"), F.col("_b.available"), F.coalesce(F.col("_b.level"), F.lit("NONE")), risk.rain_trigger(F.col("risk")))
    return best.select("place_id", F.when(F.col("_b.available"), F.col("_b.station_id")).alias("station_id"), F.col("_b.level").alias("level"), alert.alias("alert"))


def latest_rain(rain: DataFrame) -> DataFrame:
    """The latest totals of each station."""
    last = Window.partitionBy("station_id").orderBy(F.desc("at"))
    return rain.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


_FEED = (
    "station_id long, at timestamp, " + ", ".join(f"rain_{h}h double" for h in HOURS) + ", " + ", ".join(f"{n}_{h}h {t}" for n, t in (("seen", "double"), ("hours", "int")) for h in HOURS)
)


def station_feed(stream: DataFrame, silent_hours: int = 3, hours: Sequence[int] = HOURS, delay: str = DELAY) -> DataFrame:
    """Totals of each station as of its newest reading, told again when readings come, and without any when none come.

    Keyed state holds the last ``max(hours)`` hours of a station, one reading for each hour (the
    first). A timer in event time goes off ``silent_hours`` after the newest reading: the
    station is told with no hours available, without a reading of its own. Readings later than
    the watermark are left out.
    """
    longest, hour_s = max(hours), 3600

    def told(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (station,) = key
        if state.hasTimedOut:
            state.remove()
            at = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
            row = {"station_id": station, "at": at} | {f"{n}_{h}h": None for n in ("rain", "seen") for h in hours} | {f"hours_{h}h": 0 for h in hours}
            yield pd.DataFrame([row])[[c.split()[0] for c in _FEED.split(", ")]]
            return
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for part in parts:
            for ts, mm in zip(part["obs_ts"], part["mm"], strict=True):
                held.setdefault(int(ts.timestamp()) // hour_s, None if pd.isna(mm) else float(mm))
        newest = max(held)
        held = {h: mm for h, mm in held.items() if h > newest - longest}
        state.update((list(held), list(held.values())))
        state.setTimeoutTimestamp((newest + silent_hours) * hour_s * 1000)
        row = {"station_id": station, "at": pd.Timestamp((newest + 1) * hour_s, unit="s")}
        for h in hours:
            mine = [mm for k, mm in held.items() if k > newest - h and mm is not None]
            row |= {f"seen_{h}h": sum(mine) if mine else None, f"hours_{h}h": len(mine)}
            row[f"rain_{h}h"] = row[f"seen_{h}h"] if len(mine) == h else None
        yield pd.DataFrame([row])[[c.split()[0] for c in _FEED.split(", ")]]

    marked = stream.withWatermark("obs_ts", delay).select("station_id", "obs_ts", "mm")
    return marked.groupBy("station_id").applyInPandasWithState(told, _FEED, "hour array<long>, mm array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


_SNAPSHOT = _FEED + ", level string, partial boolean, state string"


def alert_stream(stream: DataFrame, places: DataFrame, path: str, checkpoint: str, silent_hours: int = 3):
    """A running query that writes each change of a place's alert once, under ``path``/alerts by batch.

    A batch's stations go into ``path``/stations/<batch>, what is known of every station (a row
    each); the places that have one of them in their list are judged before and after it, and
    those whose alert, level or station differs are written (place_id, station_id, level, alert).
    Before any reading a place has no station and alert UNKNOWN. A batch that is run again
    starts from the one before and overwrites its own output.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        was, now = f"{path}/stations/{batch_id - 1}", f"{path}/stations/{batch_id}"
        fresh = late_policy(batch)
        before = spark.read.schema(_SNAPSHOT).parquet(was) if _exists(spark, was) else spark.createDataFrame([], _SNAPSHOT)
        latest = fresh.withColumn("_new", F.lit(1)).unionByName(before.withColumn("_new", F.lit(0)))
        names = [F.col(c.split()[0]) for c in _SNAPSHOT.split(", ")]
        known = latest.groupBy("station_id").agg(F.max_by(F.struct(*names), F.struct("_new", "at")).alias("_s")).select("_s.*")
        known.write.mode("overwrite").parquet(now)
        known = spark.read.schema(_SNAPSHOT).parquet(now)
        told = known.where(F.col("at").isNotNull()).join(before.select(F.col("station_id").alias("_s"), F.struct("at", "level", "state").alias("_was")).hint("merge"), F.col("station_id") == F.col("_s"), "left")
        changed = told.where(~F.struct("at", "level", "state").eqNullSafe(F.col("_was"))).select(F.col("station_id").alias("_c"))
        touched = places.join(changed.hint("shuffle_hash"), F.col("station_id") == F.col("_c"), "left_semi").select(F.col("place_id").alias("_p")).distinct()
        mine = places.join(touched.hint("shuffle_hash"), F.col("place_id") == F.col("_p"), "left_semi")
        old = alerts(mine, before).select(F.col("place_id").alias("_p"), F.struct("station_id", "level", "alert").alias("_old"))
        new = alerts(mine, known).join(old.hint("shuffle_hash"), F.col("place_id") == F.col("_p"))
        out = new.where(~F.struct("station_id", "level", "alert").eqNullSafe(F.col("_old"))).drop("_p", "_old").withColumn("batch", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/alerts")

    feed = station_feed(stream, silent_hours)
    return feed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(publish).start()


def _slot(key: str) -> Column:
    """A folder name for a value of ``key``."""
    return F.md5(F.coalesce(F.concat(F.lit("v"), F.col(key).cast("string")), F.lit("null")))


def known_frames(spark: SparkSession, keys: str, slots: Sequence[str], schema: str) -> DataFrame:
    """The frame keys that have been written for the events of ``slots``: their folders alone are listed and read."""
    folders = [f for s in slots if _exists(spark, f := f"{keys}/slot={s}")]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", keys).parquet(*folders)


def ingest(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, key: str = "event", once: Sequence[str] | None = None, files_per_batch: int | None = None):
    """Frames from a folder into a table by event, each frame once, resumable.

    A frame is what its ``once`` columns say (all, by default). The keys of the frames written
    stand in ``path``-keys, by event: a batch reads those of its own events (a batch holds few)
    and leaves out what another batch has written, so a frame that arrives in two files lands
    once, and what a batch reads does not grow with the archive. A batch that is run again
    overwrites its own partitions of both tables.
    """
    reader = spark.readStream.schema(schema)
    frames = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source)
    names = list(once or frames.columns)
    keys = f"{path}-keys"
    told = ", ".join(f"`_{c}` {t}" for c, t in frames.select(*names).dtypes) + ", slot string, batch long"

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(names).withColumn("slot", _slot(key))
        slots = [r["slot"] for r in new.select("slot").distinct().collect()]  # the events of one batch
        there = known_frames(batch.sparkSession, keys, slots, told).where(F.col("batch") != batch_id)
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
        new = new.join(there.drop("slot", "batch").hint("shuffle_hash"), same, "left_anti").withColumn("batch", F.lit(batch_id).cast("long"))
        put = lambda df, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
        put(new.drop("slot"), key, "batch").parquet(path)
        put(new.select(*[F.col(c).alias(f"_{c}") for c in names], "slot", "batch"), "slot", "batch").parquet(keys)

    return frames.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def dropped_late(query) -> int:
    """Rows that a running or ended query left out as too late, over the progress it keeps."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def storm_sessions(stream: DataFrame, key: str, gap: str = "36 hours", delay: str = DELAY) -> DataFrame:
    """Storms on a stream: days at most one apart chain together in a session window."""
    marked = stream.withWatermark("day", delay) if stream.isStreaming else stream
    return marked.groupBy(key, F.session_window("day", gap).alias("s")).agg(F.count(F.lit(1)).alias("days")).select(key, F.col("s.start").alias("first_day"), "days")
