"""Small cases of what the fourth round's review found."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from freshet.operators import aggregates, models, spatial
from freshet.plans import q_agg


def test_medians_of_groups_of_missing_keys_and_values(spark):
    rows = [("a", 1.0, True), ("a", 4.0, False), ("a", None, False), (None, 7.0, True), ("b", None, False)]
    df = spark.createDataFrame(rows, "k string, v double, hit boolean")
    got = {r["k"]: r[1:] for r in aggregates.summary_by(df, ["k"], "v", F.col("hit")).collect()}
    assert got == {"a": (3, 2, 1.0, 2.5, 4.0, 1), None: (1, 1, 7.0, 7.0, 7.0, 1), "b": (1, 0, None, None, None, 0)}


def test_zones_by_two_keys_have_their_quantile(spark):
    df = spark.createDataFrame([(z, e, float(i * (z + e)), 1.0, 0.5) for z in (1, 2) for e in (1, 2) for i in range(101)], "z int, e int, s double, r double, b double")
    got = {(r["z"], r["e"]): (r["score_p99"], r["n"]) for r in aggregates.zonal(df, ["z", "e"], "s", "r", "b").collect()}
    assert got == {(z, e): (99.0 * (z + e), 101) for z in (1, 2) for e in (1, 2)}


@pytest.mark.parametrize(("value", "places", "want"), [(0.055, 2, 0.06), (1.005, 2, 1.0), (0.285, 2, 0.28), (None, 2, None)])
def test_means_are_rounded_by_their_multiple(spark, value, places, want):
    import duckdb

    got = spark.createDataFrame([(value,)], "v double").select(q_agg.sql_rounded("v", places)).first()[0]
    assert got == want == duckdb.execute(f"select round({'null' if value is None else repr(value)}::double, {places})").fetchone()[0]


def ringed(zone, order, ring, pts):
    return [(zone, order, ring, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1], strict=True))]


def holds(edges, x, y) -> bool:
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for *_, x1, y1, x2, y2 in edges) % 2 == 1


def away(x, y, x1, y1, x2, y2) -> float:
    t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
    return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))


def test_pairs_of_points_and_zones_are_not_shuffled(spark):
    rnd = random.Random(8)
    rows = ringed("wide", 1, 0, [(-20, -15), (25, -18), (22, 14), (-18, 16)]) + ringed("wide", 1, 1, [(-9, -9), (9, -9), (9, 9), (-9, 9)])
    rows += ringed("two", 2, 0, [(0, 0), (6, 0), (6, 6), (0, 6)]) + ringed("two", 3, 0, [(0, 0), (6, 0), (6, 6), (0, 6)])
    for k in range(25):
        x, y, n = rnd.uniform(-15, 15), rnd.uniform(-15, 15), rnd.randrange(3, 12)
        rows += ringed(f"z{k}", None if k == 3 else 10 + k, 0, [(x + rnd.uniform(0.2, 6) * math.cos(2 * math.pi * i / n), y + rnd.uniform(0.2, 6) * math.sin(2 * math.pi * i / n)) for i in range(n)])
    edges = spark.createDataFrame(rows, "zone string, ord int, ring int, i int, x1 double, y1 double, x2 double, y2 double").coalesce(2)
    pts = [(i, rnd.uniform(-28, 28), rnd.uniform(-28, 28)) for i in range(900)] + [(2000 + i, 3.0, 3.0) for i in range(30)] + [(3000, 1.0, None), (3001, float("nan"), 1.0)]
    near = lambda x, y, zone: any(away(x, y, *r[4:]) <= 0.8 for r in rows if r[0] == zone) or any(holds([r for r in rows if r[:2] == (zone, o)], x, y) for o in {r[1] for r in rows if r[0] == zone})
    zones = {r[0] for r in rows}
    want = sorted((i, z) for i, x, y in pts if i < 3000 for z in zones if near(x, y, z))
    for given in (pts, [*pts, pts[0], (pts[1][0], pts[2][1], pts[2][2])]):  # ids that come twice as well
        out = spatial.within_of_polygon(spark.createDataFrame(given, "id long, x double, y double").coalesce(2), edges, 0.8, 2.0)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        if given is pts:
            assert sorted((r["id"], r["zone"]) for r in out.collect()) == want
            assert plan.index("Join Inner") < plan.index("Aggregate")  # nothing above the join but its columns
        else:
            more = {(pts[1][0], z) for z in zones if near(*pts[2][1:], z)}
            assert sorted((r["id"], r["zone"]) for r in out.collect()) == sorted({*want, *more})


def test_bounds_and_medians_leave_their_group_out(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([0, 1, 2, None]), rnd.choice([None, float("nan"), *(round(rnd.gauss(g, 1), 2) for g in range(3))]), float(rnd.randrange(9)), None) for _ in range(900)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double").repartition(5)
    for g, got in zip((0, 2), models._bounds_without(df, "g", [0, 2], ["a", "b", "c"]), strict=True):
        for c, i in (("a", 1), ("b", 2)):
            own = sorted(r[i] for r in rows if r[0] is not None and r[0] != g and r[i] is not None and not math.isnan(r[i]))
            many = sorted({own[k * len(own) // 32] for k in range(1, 32)})
            assert got[c][0] == (many if c == "a" else sorted(set(own))) and got[c][1] == pytest.approx(statistics.median(own))
        assert got["c"] == ([], 0.0)


def test_counted_cells_give_the_precision_of_rows(spark, monkeypatch):
    rnd = random.Random(6)
    rows = []
    for i in range(3000):
        a, b, g = rnd.randrange(12), rnd.choice([None, 0.0, 1.0, 2.0]), rnd.choice([0, 1, 2, None])
        rows.append((g, float(a), b, int(rnd.random() < 0.1 + 0.05 * a + (0.2 if b == 1 else 0))))
    df = spark.createDataFrame([*rows, *[(7, 1.0, 1.0, 0)] * 5], "g int, a double, b double, y int").coalesce(3)  # group 7 has one class only
    want = models.evaluate(models.logo(df, "g", lambda d: models.fit_gbt(d, ["a", "b"], trees=2, depth=3)), "g")
    seen, plain = [], models._boosted
    monkeypatch.setattr(models, "_boosted", lambda t, *rest: seen.append(t.count()) or plain(t, *rest))
    got = models.logo_precision(df, "g", ["a", "b"], trees=2, depth=3)
    assert {r["g"]: round(r["avg_precision"], 9) for r in got.collect()} == {r["g"]: round(r["avg_precision"], 9) for r in want.where("g is not null").collect()}
    assert len(seen) == 3 and max(seen) <= 12 * 4 * 2
