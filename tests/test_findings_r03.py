"""Small cases of what the third round's review found."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import graph, models, ordering, relational, spatial
from freshet.plans import fixtures as fx
from freshet.plans import jobs, registry
from freshet.streaming import rain


def test_every_station_has_its_hours(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["station"] for r in registry.queries()["W02_hour_windows"](spark, sf).select("station").distinct().collect()}
    assert got == {r["station"] for r in fx.obs(spark, sf).select("station").distinct().collect()} and len(got) > 10


def test_averages_of_cells_are_exact_before_they_are_rounded(spark, tmp_path):
    # the mean is 0.00875; as a sum of doubles it comes out below
    rows = [(8 * k, 8 * k, 1.0, d, 100.0, 1) for k, d in enumerate((0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.01, 0.06))]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_discount double, l_extendedprice double, l_suppkey long")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r["built"] for r in fx.cells(spark, str(tmp_path)).collect()] == [0.0088]


def test_sums_just_below_a_threshold_reach_it(spark):
    seen = 20.1 + 19.8 + 20.1  # 60 mm, less an error
    seen = min(seen, 60 - 1e-12)
    df = spark.createDataFrame([(1.0, seen, seen, None, 3)], "seen_1h double, seen_3h double, seen_12h double, rain_12h double, hours_12h long")
    assert rain.late_policy(df).first()["level"] == "ADVISORY"


def hexagons(rnd, n: int) -> list[tuple]:
    """Zones that lie over each other: (zone, ord, ring, i, x1, y1, x2, y2)."""
    rows = []
    for k in range(n):
        x, y, r = rnd.gauss(0, 2), rnd.gauss(0, 2), rnd.uniform(0.5, 1.5)
        pts = [(x + r * a, y + r * b) for a, b in fx.CORNERS]
        rows += [(f"z{k}", rnd.randrange(n), 0, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1], strict=True))]
    # every edge of a zone has the zone's order
    order = {z: o for z, o, *_ in rows}
    return [(z, order[z], *rest) for z, _, *rest in rows]


def crowd(spark):
    rnd = random.Random(5)
    zones = hexagons(rnd, 300)
    pts = [(i, rnd.gauss(0, 3), rnd.gauss(0, 3)) for i in range(1200)]
    pts += [(5000 + i, 0.25, 0.25) for i in range(40)]  # at one place
    edges = spark.createDataFrame(zones, "zone string, ord int, ring int, i int, x1 double, y1 double, x2 double, y2 double")
    return zones, pts, edges.coalesce(2).cache(), spark.createDataFrame(pts, "id long, x double, y double").coalesce(2).cache()


def gap(x, y, x1, y1, x2, y2):
    t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
    return ((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) ** 0.5


def holding(zones, x, y) -> dict[str, int]:
    odd: dict = {}
    for z, o, _, _, x1, y1, x2, y2 in zones:
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd[z, o] = odd.get((z, o), 0) + 1
    return {z: o for (z, o), n in odd.items() if n % 2}


def test_points_meet_few_segments_and_keep_their_nearest(spark):
    zones, pts, edges, p = crowd(spark)
    lines = edges.select("x1", "y1", "x2", "y2")
    met = spatial.nearest_segments(p, lines, 2.0)
    assert met.count() < 150 * len(pts)  # of 1,800 segments
    got = {r["id"]: r["dist"] for r in spatial.border_distance(p, edges, 2.0).collect()}
    want = {i: min(gap(x, y, *z[4:]) for z in zones) for i, x, y in pts}
    assert got == pytest.approx({i: d for i, d in want.items() if d <= 2.0}, abs=1e-9)


def test_points_meet_few_zones_and_keep_their_last(spark):
    zones, pts, edges, p = crowd(spark)
    held = {i: holding(zones, x, y) for i, x, y in pts}
    met = spatial.last_inside(p, edges, 2.0)
    assert met.count() < sum(map(len, held.values())) / 2
    got = {r["id"]: r["zone"] for r in spatial.assign_zone(p, edges, 2.0).collect()}
    assert got == {i: max(((o, z) for z, o in h.items()), default=(0, None))[1] for i, h in held.items()}
    assert {r["id"] for r in spatial.inside_any(p, edges.withColumn("ord", F.lit(None).cast("int")), 2.0).collect()} == {i for i, h in held.items() if h}


def test_zones_are_summed_up_by_square(spark):
    zones, pts, edges, p = crowd(spark)
    years = edges.select("zone", F.col("ord").alias("value")).distinct()
    got = {r["id"]: (r["n"], r["least"], r["most"]) for r in spatial.inside_spans(p, edges, years, 2.0).collect()}
    held = {i: holding(zones, x, y).values() for i, x, y in pts}
    assert got == {i: (len(h), min(h), max(h)) for i, h in held.items() if h}


def test_events_without_a_station_meet_no_buildings(spark, monkeypatch):
    _, _, edges, p = crowd(spark)
    seen = []
    monkeypatch.setattr(spatial, "edge_distances", lambda b, e, reach, plain=spatial.edge_distances: seen.append(e) or plain(b, e, reach))
    rain_of = spark.createDataFrame([(1, "z7", 0.0, 0.0, 9.0), (1, "z8", 0.0, 0.0, None)], "station long, event string, x double, y double, rain_24h double")
    got = jobs.building_event_table(p, edges, rain_of, 1.0, 2.0, 50.0)
    assert {r["zone"] for r in seen[0].select("zone").distinct().collect()} == {"z7"} and {r["event"] for r in got.select("event").distinct().collect()} == {"z7"}


def test_roads_that_leave_their_blocks_are_followed_by_steps(spark, monkeypatch):
    rnd, calls = random.Random(9), []
    monkeypatch.setattr(graph, "_by_steps", lambda *a, plain=graph._by_steps: calls.append(1) or plain(*a))
    far = [(i, i % 40, rnd.randrange(40), float(rnd.randrange(1, 20))) for i in range(160)]
    near = [(i, i % 40, min(39, i % 40 + 1), 1.0) for i in range(40)]
    sources = spark.createDataFrame([(0,), (7,)], "source long")
    for rows, steps in ((far, 1), (near, 0)):
        roads = spark.createDataFrame(rows, "edge_id long, src long, dst long, w double")
        many, one = (sorted(map(tuple, graph.distances_from(roads, sources, block_edges=n).collect())) for n in (20, 1000))
        assert many == one and len(calls) == steps
        calls.clear()


def test_rows_of_few_groups_stay_in_their_partitions(spark):
    df = spark.range(4000, numPartitions=4).select("id", (F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    folds = spark.createDataFrame([(0, 0), (1, 1)], "g long, fold int")
    marked = models._folded(df, folds, "g")
    assert marked.rdd.getNumPartitions() >= 4 and {(r["g"], r["fold"], r["n"]) for r in marked.groupBy("g", "fold").agg(F.count("*").alias("n")).collect()} == {(0, 0, 2000), (1, 1, 2000)}
    plan = ordering.quantiles(df, "v", [0.5], group="g")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "ShuffledHashJoin" not in plan


def test_light_and_heavy_groups_meet_their_row(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2990, 0).otherwise(F.when(F.col("id") < 2999, F.col("id"))).alias("g"))
    groups = df.groupBy("g").agg(F.count("*").alias("n"))
    got = ordering.with_groups(df, groups.union(spark.createDataFrame([(77, 1)], "g long, n long")), "g", "n").groupBy("g").agg(F.count("*").alias("c"), F.max("n").alias("n")).collect()
    assert len(got) == 11 and all(r["c"] == r["n"] for r in got)


def test_bags_shuffle_words_without_the_texts_other_words(spark):
    articles = spark.createDataFrame([("2024-01-02", "the les des"), ("2024-01-02", "les un"), ("2024-01-03", "und les von")], "day string, text string").withColumn("day", F.to_date("day"))
    regions = spark.createDataFrame([("the", "x", 1), ("les", "des", 2), ("les", "von", 3)], "name string, qualifier string, region int")
    out = relational.article_bags(articles, regions, "[a-z]+")
    assert sorted((r["region"], r["day"].day, r["articles"]) for r in out.collect()) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1), (3, 2, 1), (3, 3, 1)]
    assert "array_contains" not in out._jdf.queryExecution().executedPlan().toString()  # no text's words beside each word
