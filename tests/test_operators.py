"""Golden cases worked by hand, loops as references, and the registered queries against their SQL."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from freshet.functions import cleaning, geo, risk
from freshet.operators import aggregates, graph, grid, models, ordering, relational, series, spatial
from freshet.plans import registry
from freshet.sources import tables

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_warning_levels_and_alerts(spark):
    rows = [(22.0, 62.0, 88.0), (34.0, 92.0, 140.0), (74.0, 118.0, 165.0), (0.0, 0.0, 0.0), (50.0, 90.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = [r[0] for r in df.select(risk.warning_level(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["ADVISORY", "WARNING", "EXTREME", "NONE", "EXTREME"]
    levels = spark.createDataFrame([(x,) for x in ("NONE", "ADVISORY", "WARNING", "EXTREME")], "l string")
    alerts = [r[0] for r in levels.select(risk.alert(F.lit("HIGH"), F.lit(True), F.col("l"), F.lit("ADVISORY"))).collect()]
    assert alerts == ["CALM", "WATCH", "PREPARE", "EVACUATE"]
    assert one(levels, risk.alert(F.lit("HIGH"), F.lit(False), F.col("l"), F.lit("ADVISORY"))) == "UNKNOWN"


def test_storm_chain_and_partial_hours(spark):
    days = spark.createDataFrame([("k", f"2024-01-0{d}") for d in (1, 2, 4, 5, 9)], "k string, day string").withColumn("day", F.to_date("day"))
    got = {}
    for r in series.storm_groups(days, ["k"], "day").collect():
        got.setdefault(r.storm, set()).add(r.day.day)
    assert sorted(map(sorted, got.values())) == [[1, 2], [4, 5], [9]]
    obs = spark.createDataFrame([(1, 100 - o, 1.0) for o in range(24) if o != 10], "station long, hour long, mm double")
    r = series.hour_windows(spark.createDataFrame([("e", 1, 100)], "event string, station long, hour long"), obs, ["event"]).first()
    assert (r.rain_1h, r.rain_3h, r.rain_6h, r.rain_12h, r.rain_24h) == (1.0, 3.0, 6.0, None, None)
    assert [r[f"hours_{h}h"] for h in series.HOURS] == [1, 3, 6, 11, 23]


def test_span_weights(spark):
    frames = spark.createDataFrame([("e", 1, s, n, r) for s, n, r in ((60, 60, 1.0), (120, 60, 2.0), (130, 10, 6.0), (140, 10, None))], "event string, pt int, stamp long, span_min int, rate double")
    assert series.accumulate(frames, ["event", "pt"], [1]).first()["rain_1h"] == 6.0


def test_points_in_polygon_with_hole(spark):
    ring = lambda r, pts: [("z", 1, r, i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(pts, pts[1:] + pts[:1], strict=True))]
    edges = spark.createDataFrame(ring(0, [(0, 0), (9, 0), (9, 9), (0, 9)]) + ring(1, [(3, 3), (6, 3), (6, 6), (3, 6)]), "zone string, ord int, ring int, i int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 4.5, 4.5), (2, 1.0, 8.0), (3, 20.0, 4.0)], "id long, x double, y double")
    assert [r.id for r in spatial.points_in_polygons(p, edges, 2.0).collect()] == [2]
    tiny = spark.createDataFrame(ring(0, [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2)]), edges.schema)
    assert [(r.row, r.col) for r in spatial.rasterize(tiny, geo.Grid(1.0, 0.0, 10.0, 10, 10)).collect()] == [(9, 0)]


def test_pit_fills_and_drains(spark):
    rows = [(r, c, 7.0 if (r, c) == (2, 2) else 10.0) for r in range(5) for c in range(5)]
    df = spark.createDataFrame(rows, "row int, col int, z double")
    got = {(r.row, r.col): round(r.filled, 6) for r in grid.fill(df, "z", 0.001).collect()}
    assert got[0, 0] == 10.0 and got[1, 1] == 10.001 and got[2, 2] == 10.002
    plain = {(r.row, r.col): r.filled for r in grid.fill(df, "z").collect()}
    assert plain[2, 2] == 10.0
    slope = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(4) for c in range(4)], "row int, col int, z double")
    acc = {(r.row, r.col): r.acc for r in grid.flow_acc(grid.d8(slope, "z")).collect()}
    assert sum(v for k, v in acc.items() if k == (0, 0)) >= 4 and max(acc.values()) <= 16


def test_small_graph(spark):
    e = spark.createDataFrame([(1, 0, 1, 1.0, True), (2, 0, 2, 2.0, False), (3, 2, 1, 2.0, False), (4, 0, 1, 5.0, True)], "edge_id long, src long, dst long, len double, blocked boolean")
    free = {r.node: (r.dist, r.path) for r in graph.sssp(e, 0).collect()}
    assert free[1] == (1.0, [1])
    avoid = graph.sssp(e, 0, avoid_blocked=True)
    assert {r.node: (r.dist, r.path) for r in avoid.collect()}[1] == (4.0, [2, 3])
    m = {r.node: (r.length, r.blocked_edges) for r in graph.route_metrics(graph.sssp(e, 0), e).collect()}
    assert m[1] == (1.0, 1)
    doc = {r.node: r.doc for r in graph.route_doc(graph.route_metrics(graph.sssp(e, 0), e), graph.route_metrics(avoid, e)).collect()}
    assert '"avoided":true' in doc[1] and '"safe_minutes":1' in doc[1]


def test_balanced_folds(spark):
    rows = [(g, i < p) for g, p in zip("abcde", (9, 7, 6, 5, 1), strict=True) for i in range(10)]
    got = relational.balanced_folds(spark.createDataFrame(rows, "g string, y boolean"), "g", F.col("y"), 2).collect()
    loads = {}
    for r in got:
        loads.setdefault(r.fold, []).append(r.positives)
    assert sorted(map(sorted, loads.values())) == [[1, 6, 7], [5, 9]]


def test_filled_folds_equal_a_loop():
    rnd = random.Random(4)
    for _ in range(300):
        loads, size, items = [rnd.randrange(30) for _ in range(rnd.randrange(1, 6))], rnd.randrange(6), rnd.randrange(40)
        want, now = [0] * len(loads), list(loads)
        for _ in range(items):
            j = now.index(min(now))
            want[j], now[j] = want[j] + 1, now[j] + size
        assert relational._filled(loads, size, items) == want, (loads, size, items)


def test_folds_are_greedy(spark):
    rnd = random.Random(6)
    groups = {g: min(rnd.randrange(12), 20) for g in range(80)}
    df = spark.createDataFrame([(g, i < p) for g, p in groups.items() for i in range(12)], "g long, y boolean")
    got = {r.g: r.fold for r in relational.balanced_folds(df, "g", F.col("y"), 4).collect()}
    loads, want = [0] * 4, {}
    for g, p in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        want[g] = loads.index(min(loads))
        loads[want[g]] += p
    assert got == want


def test_running_sums_and_quantiles(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), rnd.choice([None, *range(40)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(7)
    got = {r.id: r.s for r in ordering.running(df, [F.col("id")], {"s": F.coalesce("v", F.lit(0))}).collect()}
    total = 0
    for i, _, v in rows:
        total += v or 0
        assert got[i] == total
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    for r in ordering.quantiles(df, "v", shares, "g").collect():
        own = sorted(v for _, g, v in rows if g == r.g and v is not None)
        at = lambda s, own=own: own[math.floor(s * (len(own) - 1))] + (s * (len(own) - 1) % 1) * (own[math.ceil(s * (len(own) - 1))] - own[math.floor(s * (len(own) - 1))])
        assert r.n == len(own) and all(abs(x - at(s)) < 1e-9 for x, s in zip(r.q, shares, strict=True))
    none = ordering.quantiles(df.where("false"), "v", [0.5]).first()
    assert none.n == 0 and none.q == [None]


def test_paths_equal_a_loop(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.randrange(40), rnd.randrange(40), float(rnd.randrange(1, 20)), rnd.random() < 0.2) for i in range(160)]
    df = spark.createDataFrame(rows, "edge_id long, src long, dst long, len double, blocked boolean")
    for avoid in (False, True):
        dist = {0: 0.0}
        for _ in range(40):
            for _, a, b, w, blocked in rows:
                if a in dist and not (avoid and blocked):
                    dist[b] = min(dist.get(b, math.inf), dist[a] + w)
        got = {r.node: r for r in graph.sssp(df, 0, avoid_blocked=avoid).collect()}
        assert {n: r.dist for n, r in got.items()} == dist
        for n, r in got.items():
            at, length = 0, 0.0
            for e in r.path:
                assert rows[e][1] == at
                at, length = rows[e][2], length + rows[e][3]
            assert (at, length) == (n, r.dist)


def test_flow_and_filling_equal_a_loop(spark):
    rnd = random.Random(1)
    z = {(r, c): float(rnd.randrange(30)) for r in range(12) for c in range(9) if rnd.random() < 0.95}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double")
    around = lambda p: [(p[0] + a, p[1] + b) for a, b in grid.D8 if (p[0] + a, p[1] + b) in z]
    w = {p: v if len(around(p)) < 8 else math.inf for p, v in z.items()}
    for _ in range(200):
        w = {p: min(w[p], max(v, min((w[q] + 0.5 for q in around(p)), default=math.inf))) for p, v in z.items()}
    assert {(r.row, r.col): r.filled for r in grid.fill(df, "z", 0.5).collect()} == w
    directed = grid.d8(df, "z")
    down = {(r.row, r.col): r.d8 for r in directed.collect()}
    acc = dict.fromkeys(z, 0)
    for p in z:
        while p in z:
            acc[p] += 1
            if down[p] is None:
                break
            p = (p[0] + grid.D8[down[p]][0], p[1] + grid.D8[down[p]][1])
    assert {(r.row, r.col): r.acc for r in grid.flow_acc(directed).collect()} == acc


def test_points_in_random_polygons(spark):
    rnd = random.Random(12)
    edges = []
    for z in range(12):
        cx, cy, n = rnd.uniform(-6, 6), rnd.uniform(-6, 6), rnd.randrange(3, 40)
        ring = [(cx + rnd.uniform(0.5, 5) * math.cos(2 * math.pi * i / n), cy + rnd.uniform(0.5, 5) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        edges += [(f"z{z}", z, 0, i, *p, *q) for i, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True))]
    e = spark.createDataFrame(edges, "zone string, ord int, ring int, i int, x1 double, y1 double, x2 double, y2 double")
    pts = [(i, rnd.uniform(-12, 12), rnd.uniform(-12, 12)) for i in range(400)]
    p = spark.createDataFrame(pts, "id long, x double, y double")
    want = set()
    for i, x, y in pts:
        for z in {r[0] for r in edges}:
            if sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for zone, _, _, _, x1, y1, x2, y2 in edges if zone == z) % 2:
                want.add((i, z))
    for size in (0.7, 3.0):
        assert {(r.id, r.zone) for r in spatial.points_in_polygons(p, e, size).collect()} == want
    q = [(i, rnd.choice([0.0, 300.0]) + rnd.gauss(0, 3), rnd.gauss(0, 3)) for i in range(60)]
    near = {r.id: r.q_id for r in spatial.nearest_any(p, spark.createDataFrame(q, p.schema), 0.5).collect()}
    assert near == {i: min(q, key=lambda c: (math.hypot(c[1] - x, c[2] - y), c[0]))[0] for i, x, y in pts}


def test_a_frame_in_two_files_lands_once(spark, tmp_path):
    from freshet.streaming import rain

    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "event string, stamp long, rate double")
    for _ in range(3):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = rain.ingest(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/out", f"{tmp_path}/cp", once=["event", "stamp"], files_per_batch=1)
    q.awaitTermination(120)
    assert sorted((r.event, r.stamp) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_region_rank(spark):
    df = spark.createDataFrame([(1, "r", 5.0), (2, "r", 1.0), (3, "r", None), (4, "r", 3.0)], "id long, region string, v double")
    got = {r.id: r.region_rank for r in series.region_rank(df, "region", "v", ["id"], least=3).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None, 4: 0.5}


def test_projection_matches_a_known_point_and_round_trips(spark):
    rnd = random.Random(3)
    pts = [(127.5, 38.0)] + [(rnd.uniform(124, 132), rnd.uniform(33, 39)) for _ in range(500)]
    df = spark.createDataFrame(pts, "lon double, lat double").withColumn("p", geo.to_tm(F.col("lon"), F.col("lat")))
    first = df.first()["p"]
    assert abs(first.x - 1_000_000) < 1e-3 and abs(first.y - 2_000_000) < 1e-3
    back = df.withColumn("q", geo.from_tm(F.col("p.x"), F.col("p.y")))
    worst = back.agg(F.max(F.greatest(F.abs(F.col("q.lon") - F.col("lon")), F.abs(F.col("q.lat") - F.col("lat"))))).first()[0]
    assert worst < 1e-8
    # one degree of latitude along the meridian, by the series for GRS80
    north = one(spark.range(1), geo.to_tm(F.lit(127.5), F.lit(39.0))["y"]) - 2_000_000
    assert abs(north - 0.9996 * 111_004.4) < 30


def test_cleaning(spark):
    t = lambda c: one(spark.range(1), c)
    assert t(cleaning.norm_ymd(F.lit(" 612 "))) == "00000612" and t(cleaning.norm_hhmm(F.lit("x1"))) == "x1"
    assert t(cleaning.number(F.lit("1,234.5"))) == 1234.5 and t(cleaning.number(F.lit(" "), 0.0)) == 0.0
    assert t(cleaning.pnu(F.lit("11110"), F.lit("10100"), F.lit("0"), F.lit("1"), F.lit("2"))) == "1111010100100010002"
    assert abs(t(cleaning.dms(F.lit("126-57-24"))) - 126.956667) < 1e-6 and t(cleaning.dms(F.lit("126"))) is None


def test_global_rank_has_no_gaps(spark):
    df = spark.range(997).select((F.col("id") * 7919 % 997).alias("v"), "id")
    placed, n = aggregates.global_rank(df.repartition(9), [F.col("v"), F.col("id")], "at")
    assert n == 997 and [r.v for r in placed.orderBy("at").collect()] == sorted(r.v for r in df.collect())
    assert sorted(r.at for r in placed.select("at").collect()) == list(range(997))


def test_annulus_controls_keep_their_distance(spark):
    cases = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(30)], "id long, x double, y double")
    got = relational.annulus_controls(cases, cases, 6, 0.2, 1.0).collect()
    at = {r.id: (r.x, r.y) for r in cases.collect()}
    assert got and all(0.2 <= math.dist((r.x, r.y), at[r.case_id]) <= 1.0 for r in got)
    assert all(math.dist((r.x, r.y), p) > 0.2 for r in got for p in at.values())


def test_files_round_trip(spark, tmp_path):
    path = str(tmp_path)
    with open(f"{path}/a_47.csv", "w", encoding="utf-8-sig") as f:
        f.write("id,name,v\n1,x,2.5\n2,,\n")
    df = tables.read_table(spark, f"{path}/a_47.csv", "id long, name string, v double")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "x", 2.5), (2, None, None)]
    assert tables.read_glob(spark, f"{path}/a_*.csv", "id long, name string, v double", r"a_(\d+)\.csv", "province").select("province").distinct().first()[0] == "47"
    with open(f"{path}/f.geojson", "w") as f:
        f.write('{"type":"FeatureCollection","features":[{"properties":{"id":"p"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]]]}},{"properties":{"id":"bad"},"geometry":{"type":"Polygon","coordinates":"x"}}]}')
    features = tables.read_features(spark, f"{path}/f.geojson", "id string")
    assert {r.id: r.geometry_ok for r in features.collect()} == {"p": True, "bad": False}
    assert tables.ring_edges(features, "id", "id").count() == 4
    ev = spark.createDataFrame([("a", 1), ("b", 2)], "event string, v int")
    tables.write_by_event(ev, f"{path}/ev")
    tables.write_by_event(spark.createDataFrame([("b", 9)], "event string, v int"), f"{path}/ev")
    assert {(r.event, r.v) for r in spark.read.parquet(f"{path}/ev").collect()} == {("a", 1), ("b", 9)}
    tables.write_by_event(spark.createDataFrame([("b", 5), ("c", 3)], "event string, v int"), f"{path}/ev", skip_done=True)
    assert {(r.event, r.v) for r in spark.read.parquet(f"{path}/ev").collect()} == {("a", 1), ("b", 9), ("c", 3)}
    tables.publish(ev, f"{path}/pub", ["v"], 1)
    assert spark.read.parquet(f"{path}/pub/table").count() == 2 and spark.read.option("header", True).csv(f"{path}/pub/sample").count() == 1
    assert tables.fingerprint(ev).first() == tables.fingerprint(ev.repartition(3)).first()


def test_stream_equals_batch(spark, tmp_path, sf):
    from freshet.streaming import rain

    rows = [(s, 1_700_000_000 // 3600 * 3600 + 3600 * h, float(h % 5)) for s in (1, 2) for h in range(30) if not (s == 2 and h == 12)]
    df = spark.createDataFrame(rows + rows[:3], "station_id long, t long, mm double").select("station_id", F.timestamp_seconds("t").alias("obs_ts"), "mm")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = rain.rolling_rain(stream).writeStream.outputMode("append").format("memory").queryName("rolling").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("rolling").collect()}
    assert rain.dropped_late(q) == 0
    want = {tuple(r) for r in rain.rolling_rain(df).collect()}
    assert got and got <= want and len(got) > 30
    q = rain.ingest(spark, f"{tmp_path}/in", "station_id long, obs_ts timestamp, mm double", f"{tmp_path}/out", f"{tmp_path}/cp2", "station_id")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)


def test_gbt_orders_a_clear_signal(spark):
    df = spark.range(400).select("id", (F.floor(F.col("id") / 10) % 4).alias("g"), (F.col("id") % 10).cast("double").alias("a"), F.when(F.col("id") % 7 == 0, None).otherwise(1.0).alias("b"), F.when(F.col("id") % 10 >= 7, 1).otherwise(0).alias("y"))
    scored = models.logo(df.where("g < 2"), "g", lambda d: models.fit_gbt(d, ["a", "b"], trees=2, depth=2))
    low, high = scored.agg(F.max(F.when(F.col("y") == 0, F.col("score"))), F.min(F.when(F.col("y") == 1, F.col("score")))).first()
    assert low < high and models.redundant(df, ["a", "id", "y"]) == []


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return float(v) if hasattr(v, "as_tuple") else v


GROUPS = ("P0", "P1", "P2", "P3", "P4", "G0", "G1", "G2", "W0", "W1", "J0", "J1", "J2", "J3", "S0", "S1", "T", "U", "M", "C", "R0", "R1", "X")


def test_groups_cover_all_queries_with_sql():
    assert not [n for n in registry.oracle_sql() if not n.startswith(GROUPS)]


@pytest.mark.parametrize("group", GROUPS)
def test_queries_equal_their_sql(spark, sf, group):
    queries, oracles = registry.queries(), registry.oracle_sql()
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{os.path.join(sf, name)}.parquet'")
    for name in sorted(n for n in oracles if n.startswith(group)):
        df = queries[name](spark, sf)
        cols = sorted(df.columns)
        got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
        answer = con.execute(oracles[name])
        names = [d[0] for d in answer.description]
        assert sorted(names) == cols, name
        want = sorted((tuple(normal(row[names.index(c)]) for c in cols) for row in answer.fetchall()), key=repr)
        assert got == want, name
