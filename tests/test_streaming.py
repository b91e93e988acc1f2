"""The live job: timers, one output for each change, ingestion that reads its own events only."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from freshet.streaming import rain

START = datetime(2024, 7, 1)
READING = "station_id long, obs_ts timestamp, mm double"


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def hour(h: int) -> datetime:
    return START + timedelta(hours=h)


def changes(spark, path):
    got = spark.read.schema("place_id long, station_id long, level string, alert string, batch long").parquet(f"{path}/alerts").orderBy("batch", "place_id").collect()
    return [(r["place_id"], r["station_id"], r["level"], r["alert"]) for r in got]


def test_a_silent_station_turns_no_data_and_each_change_is_told_once(spark, tmp_path):
    source, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    places = spark.createDataFrame([(1, "HIGH", 7, 0), (2, "LOW", 8, 0), (3, "HIGH", 7, 0), (3, "HIGH", 8, 1), (4, "UNKNOWN", 7, 0), (5, "HIGH", None, 0)], "place_id long, risk string, station_id long, rank int")

    def run():
        stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(source)
        q = rain.alert_stream(stream, places, out, cp)
        q.awaitTermination(180)
        assert q.exception() is None

    put(spark, source, [(7, hour(0), 1.0), (8, hour(0), 0.0), (7, hour(0), 99.0)], READING)
    run()
    assert changes(spark, out) == [(1, 7, "NONE", "CALM"), (2, 8, "NONE", "CALM"), (3, 7, "NONE", "CALM"), (4, 7, "NONE", "UNKNOWN")]
    put(spark, source, [(7, hour(1), 80.0), (8, hour(1), 0.0)], READING)
    run()
    told = changes(spark, out)[4:]
    assert told == [(1, 7, "EXTREME", "EVACUATE"), (3, 7, "EXTREME", "EVACUATE"), (4, 7, "EXTREME", "UNKNOWN")]
    # only station 8 goes on: 7 falls silent, without a reading of its own
    put(spark, source, [(8, hour(h), 0.0) for h in range(2, 9)], READING)
    run()
    told = changes(spark, out)[7:]
    assert told == [(1, None, None, "UNKNOWN"), (3, 8, "NONE", "CALM"), (4, None, None, "UNKNOWN")]
    run()  # nothing new: nothing told
    assert len(changes(spark, out)) == 10
    put(spark, source, [(7, hour(9), 0.0), (8, hour(9), 0.0)], READING)
    run()
    assert sorted(p for p, *_ in changes(spark, out)[10:]) == [1, 3, 4]


def test_feed_totals_equal_a_loop(spark, tmp_path):
    readings = {(s, h): float((s * 7 + h * 3) % 11) for s in (1, 2) for h in range(20) if (s + h) % 6}
    for lo in (0, 7, 14):
        put(spark, f"{tmp_path}/in", [(s, hour(h), mm) for (s, h), mm in readings.items() if lo <= h < lo + 7], READING)
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = rain.station_feed(stream).writeStream.outputMode("append").format("memory").queryName("feed").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    rows = spark.table("feed").collect()
    assert len(rows) == 6
    for r in rows:
        newest = int((r["at"] - START).total_seconds() // 3600) - 1
        for n in rain.HOURS:
            mine = [mm for (s, h), mm in readings.items() if s == r["station_id"] and newest - n < h <= newest]
            assert (r[f"hours_{n}h"], r[f"seen_{n}h"]) == (len(mine), sum(mine) if mine else None)
            assert r[f"rain_{n}h"] == (sum(mine) if len(mine) == n else None)


def test_ingestion_reads_its_own_events_and_lands_a_replay_once(spark, tmp_path):
    source, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    frame = "event string, stamp long, rate double"
    for k in range(10):  # each batch has its own event, and one frame that comes again
        put(spark, source, [(f"day{k:02d}", s, float(s)) for s in range(5)] + [(f"day{k:02d}", 3, 3.0)], frame)
    run = lambda: rain.ingest(spark, source, frame, out, cp, once=["event", "stamp"], files_per_batch=1).awaitTermination(180)
    run()
    assert spark.read.parquet(out).groupBy("event").count().where("count <> 5").count() == 0
    slot = lambda e: spark.range(1).select(F.md5(F.lit(f"v{e}"))).first()[0]
    told = "`_event` string, `_stamp` long, slot string, batch long"
    files = [len(rain.known_frames(spark, f"{out}-keys", [slot(f"day{k:02d}")], told).inputFiles()) for k in (1, 9)]
    assert files[0] == files[1]  # what the 10th batch's events have is as much as the 2nd's
    assert rain.known_frames(spark, f"{out}-keys", [slot("day77")], told).count() == 0
    put(spark, source, [("day03", s, 9.0) for s in (3, 4, 5)], frame)
    run()
    got = sorted((r["stamp"], r["rate"]) for r in spark.read.parquet(out).where("event = 'day03'").collect())
    assert got == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, 9.0)]
    # killed before its commit: the last batch runs again and overwrites what it wrote
    commits = sorted((f for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    commits[-1].unlink()
    (tmp_path / "cp" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert sorted((r["stamp"], r["rate"]) for r in spark.read.parquet(out).where("event = 'day03'").collect()) == got
    assert spark.read.parquet(out).count() == 51
