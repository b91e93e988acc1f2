"""Filling and flow in tiles against priority flooding and walks."""

from __future__ import annotations

import heapq
import random

import pytest

from freshet.operators import grid, hydrology


def flooded(z: dict, eps: float) -> dict:
    """Levels by one flood from the outlets."""
    around = lambda p: [(p[0] + a, p[1] + b) for a, b in grid.D8]
    heap = [(h, p) for p, h in z.items() if any(q not in z for q in around(p))]
    heapq.heapify(heap)
    out: dict = {}
    while heap:
        w, p = heapq.heappop(heap)
        if p not in out:
            out[p] = w
            for q in around(p):
                if q in z and q not in out:
                    heapq.heappush(heap, (max(w + eps, z[q]), q))
    return out


def walked(down: dict) -> dict:
    acc = dict.fromkeys(down, 0)
    for p in down:
        while p in down:
            acc[p] += 1
            if down[p] is None:
                break
            a, b = grid.D8[down[p]]
            p = (p[0] + a, p[1] + b)
    return acc


def terrain(kind: str, seed: int) -> dict:
    r = random.Random(seed)
    if kind == "rough":
        return {(i - 7, j - 3): float(r.randrange(30)) for i in range(45) for j in range(38)}
    if kind == "holes":
        return {(i, j): r.random() * 20 for i in range(40) for j in range(50) if r.random() < 0.98}
    if kind == "bowl":  # one outlet far away, walls between tiles
        return {(i, j): (0.0 if (i, j) == (0, 20) else 90.0 if i in (0, 39) or j in (0, 39) else 50.0 if (i % 8 == 0 and j % 8 != 3) else float(r.randrange(20))) for i in range(40) for j in range(40)}
    return {(i, j): 5.0 for i in range(35) for j in range(20)}


@pytest.mark.parametrize(("kind", "eps", "size", "fan"), [("rough", 0.0, 16, 8), ("rough", 0.5, 16, 2), ("holes", 0.25, 8, 2), ("bowl", 0.001, 5, 2), ("bowl", 0.0, 4, 2), ("flat", 0.001, 16, 8)])
def test_filling_in_tiles_equals_a_flood(spark, monkeypatch, kind, eps, size, fan):
    monkeypatch.setattr(hydrology, "FAN", fan)
    z = terrain(kind, size)
    df = spark.createDataFrame([(r, c, v, "x") for (r, c), v in z.items()] + [(1000, 1000, None, "sea")], "row int, col int, z double, w string")
    got = hydrology.fill(df, "z", eps, size).collect()
    assert {(r["row"], r["col"]): r["filled"] for r in got if r["z"] is not None} == pytest.approx(flooded(z, eps), abs=1e-7)
    assert [(r["filled"], r["w"]) for r in got if r["z"] is None] == [(None, "sea")]


def test_exchange_lowers_what_fewer_steps_make_better(spark):
    # the lowest way out is long: with a large eps a higher and shorter one is better
    z = {(i, j): 9.0 for i in range(30) for j in range(30)}
    for k in range(1, 29):
        z[5, k] = z[24, k] = 1.0
    for k in range(5, 25):
        z[k, 28] = 1.0
    z[5, 0] = 0.0
    df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double")
    for eps in (0.01, 0.3, 2.0):
        got = {(r["row"], r["col"]): r["filled"] for r in hydrology.fill(df, "z", eps, 7).collect()}
        assert got == pytest.approx(flooded(z, eps), abs=1e-7)


def test_filling_equals_the_form_by_rounds(spark):
    z = terrain("holes", 5)
    df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items() if r < 14 and c < 14], "row int, col int, z double")
    tiles = {(r["row"], r["col"]): r["filled"] for r in hydrology.fill(df, "z", 0.01, 4).collect()}
    assert tiles == pytest.approx({(r["row"], r["col"]): r["filled"] for r in grid.fill(df, "z", 0.01).collect()}, abs=1e-7)


def test_no_ground(spark):
    empty = spark.createDataFrame([], "row int, col int, z double")
    assert hydrology.fill(empty, "z").columns == ["row", "col", "z", "filled"]
    assert hydrology.fill(empty, "z").count() == 0
    sea = spark.createDataFrame([(0, 0, None)], "row int, col int, z double")
    assert hydrology.fill(sea, "z").first()["filled"] is None
    one = spark.createDataFrame([(3, 4, 2.5)], "row int, col int, z double")
    assert hydrology.fill(one, "z", 0.1).first()["filled"] == 2.5


@pytest.mark.parametrize("size", [5, 16, 128])
def test_flow_in_tiles_equals_walks(spark, size):
    z = flooded(terrain("holes", size), 0.01)
    df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double")
    directed = grid.d8(df, "z").cache()
    down = {(r["row"], r["col"]): r["d8"] for r in directed.collect()}
    got = {(r["row"], r["col"]): r["acc"] for r in hydrology.flow_acc(directed, size).collect()}
    assert got == walked(down)
    assert sum(n for p, n in got.items() if down[p] is None) == len(z)


def test_a_circle_is_an_error(spark):
    df = spark.createDataFrame([(0, 0, 2), (0, 1, 6)], "row int, col int, d8 int")
    with pytest.raises(Exception, match="circle"):
        hydrology.flow_acc(df, 16).collect()
