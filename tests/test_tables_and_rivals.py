"""Tiles with repeated pixels, the catalog, timed rasters."""

from __future__ import annotations

from freshet.functions import geo
from freshet.operators import spatial
from freshet.sources import tables


def test_a_repeated_pixel_keeps_its_largest_value(spark):
    rows = [(0, 6, 1, 2, 3, 4, 7), (0, 6, 1, 2, 3, 4, 9), (0, 6, 1, 2, 5, 4, 1), (0, 6, 1, 2, 255, 255, 2)]
    (tile,) = tables.tiles(spark.createDataFrame(rows, "level int, z int, tx int, ty int, px int, py int, v int"), "v").collect()
    assert len(tile["band"]) == 65536 and {i: v for i, v in enumerate(tile["band"]) if v} == {4 * 256 + 3: 9, 4 * 256 + 5: 1, 65535: 2}


def test_catalog(spark, tmp_path):
    spark.range(7).write.parquet(f"{tmp_path}/a")
    spark.range(0).write.parquet(f"{tmp_path}/b")
    got = {r["name"]: r for r in tables.catalog(spark, {"a": (f"{tmp_path}/a", "EPSG:5179"), "b": (f"{tmp_path}/b", None), "c": (f"{tmp_path}/c", None)}).collect()}
    assert {n: (r["status"], r["rows"], r["columns"], r["crs"]) for n, r in got.items()} == {"a": ("OK", 7, 1, "EPSG:5179"), "b": ("EMPTY", 0, 1, None), "c": ("MISSING", None, None, None)}
    assert got["a"]["bytes"] > 100 and got["a"]["files"] >= 1 and got["a"]["schema"] == "id:bigint"


def test_timed_raster_counts_what_it_drops(spark):
    square = lambda z, x: [(z, 1, 0, i, *map(float, e)) for i, e in enumerate([(x, 0, x + 2, 0), (x + 2, 0, x + 2, 2), (x + 2, 2, x, 2), (x, 2, x, 0)])]
    edges = spark.createDataFrame(square("a", 0) + square("b", 0) + square("c", 4) + square("d", 6), "zone string, ord int, ring int, i int, x1 double, y1 double, x2 double, y2 double")
    times = spark.createDataFrame([("a", "e", 5), ("b", "e", 5), ("c", None, 5), ("a", "f", 6)], "zone string, event string, hour int")
    got = spatial.rasterize_timed(edges, times, geo.Grid(1.0, 0.0, 10.0, 10, 10)).collect()
    assert {(r["event"], r["hour"], r["zones"], r["dropped"]) for r in got} == {("e", 5, 2, 2), ("f", 6, 1, 2)} and len(got) == 8
