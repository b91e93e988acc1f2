"""Points in zones through coverings, against plain parity."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import spatial

SCHEMA = "zone string, ord int, ring int, i int, x1 double, y1 double, x2 double, y2 double"


def ring(zone: str, r: int, pts: list) -> list[tuple]:
    return [(zone, 1, r, i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(pts, pts[1:] + pts[:1], strict=True))]


def star(rnd, x: float, y: float, reach: float, corners: int) -> list:
    return [(x + reach * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * k / corners), y + reach * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * k / corners)) for k in range(corners)]


def parity(rows: list[tuple], x: float, y: float) -> set[str]:
    odd: dict[str, int] = {}
    for z, _, _, _, x1, y1, x2, y2 in rows:
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd[z] = odd.get(z, 0) + 1
    return {z for z, n in odd.items() if n % 2}


@pytest.mark.parametrize("size", [0.7, 3.0, 50.0])
def test_points_in_stars_with_holes(spark, size):
    rnd = random.Random(size)
    rows = []
    for k in range(25):
        x, y = rnd.uniform(-40, 40), rnd.uniform(-40, 40)
        rows += ring(f"z{k}", 0, star(rnd, x, y, rnd.choice([1, 8, 30]), rnd.choice([3, 5, 40])))
        if k % 3 == 0:
            rows += ring(f"z{k}", 1, star(rnd, x, y, 0.8, 6))
    pts = [(i, rnd.uniform(-60, 60), rnd.uniform(-60, 60)) for i in range(1500)]
    got = spatial.points_in_polygons(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(rows, SCHEMA), size).collect()
    assert len(got) == len({(r["id"], r["zone"]) for r in got})
    assert {(r["id"], r["zone"]) for r in got} == {(i, z) for i, x, y in pts for z in parity(rows, x, y)}


def test_sides_on_the_lines_of_squares(spark):
    rows = ring("a", 0, [(0, 0), (8, 0), (8, 8), (0, 8)]) + ring("a", 1, [(2, 2), (6, 2), (6, 6), (2, 6)]) + ring("b", 0, [(4, -2), (10, -2), (10, 4), (7, 4), (7, 1), (4, 1)]) + ring("c", 0, [(-6, -6), (0, 0), (-6, 6)])
    pts = [(i, x, y) for i, (x, y) in enumerate((a / 4 + 0.01, b / 4 + 0.013) for a in range(-28, 45) for b in range(-28, 37))]
    got = spatial.points_in_polygons(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(rows, SCHEMA), 2.0).collect()
    assert {(r["id"], r["zone"]) for r in got} == {(i, z) for i, x, y in pts for z in parity(rows, x, y)}


def test_wide_zones_take_few_blocks(spark):
    rows = ring("wide", 0, [(0, 0.5), (1e6, 0.5), (1e6, 3.5), (0, 3.5)])
    border, inner = spatial.covering(spark.createDataFrame(rows, SCHEMA), 100.0)
    assert inner.count() == 0 and border.where("_bx between 1 and 9998").count() == 9998  # level sides are border
    rows = ring("tall", 0, [(0, 0), (1e6, 0), (1e6, 1e4), (0, 1e4)])
    border, inner = spatial.covering(spark.createDataFrame(rows, SCHEMA), 100.0)
    assert inner.count() < 100 * 2 * 15
    tested = inner.groupBy("_by").agg(F.sum(F.expr("shiftleft(1L, level)")).alias("n")).where("_by between 1 and 98")
    assert {r["n"] for r in tested.collect()} == {9998}
    p = spark.createDataFrame([(1, 5e5, 5e3), (2, 150.0, 150.0), (3, -1.0, 5e3)], "id long, x double, y double")
    assert sorted(r["id"] for r in spatial.points_in_polygons(p, spark.createDataFrame(rows, SCHEMA), 100.0).collect()) == [1, 2]


def test_no_zones_and_no_points(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    none = spark.createDataFrame([], SCHEMA)
    assert spatial.points_in_polygons(p, none, 1.0).count() == 0
    assert spatial.points_in_polygons(p.where("false"), spark.createDataFrame(ring("a", 0, [(0, 0), (1, 0), (0, 1)]), SCHEMA), 1.0).count() == 0
