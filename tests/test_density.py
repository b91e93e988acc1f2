"""Nearest points where one square holds a large part of all points."""

from __future__ import annotations

import numpy as np
import pytest

from freshet.operators import spatial

SCHEMA = "id long, x double, y double"


def crowd(seed: int, n: int) -> list[tuple]:
    """Half of the points in one small square, some at one place, the others spread out."""
    r = np.random.default_rng(seed)
    near = r.uniform(5.0, 5.3, (n // 2, 2))
    near[: n // 20] = (5.1, 5.2)
    far = r.uniform(-30, 30, (n - n // 2, 2))
    return [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([near, far]))]


def brute(p: list[tuple], q: list[tuple], reach: float, k: int) -> dict:
    at, ids = np.array([c[1:] for c in q]), np.array([c[0] for c in q])
    out = {}
    for i, x, y in p:
        d = np.hypot(at[:, 0] - x, at[:, 1] - y)
        order = np.lexsort((ids, d))[:k]
        out[i] = [int(ids[j]) for j in order if d[j] <= reach]
    return out


@pytest.mark.parametrize(("k", "reach"), [(1, 2.0), (4, 1.0)])
def test_nearest_in_a_crowd(spark, k, reach):
    p, q = crowd(1, 1600), crowd(2, 2400)
    pd, qd = spark.createDataFrame(p, SCHEMA).repartition(4), spark.createDataFrame(q, SCHEMA).repartition(4)
    want = brute(p, q, reach, k)
    got: dict = {i: [] for i, _, _ in p}
    for r in spatial.within_topk(pd, qd, reach, k).orderBy("id", "rank").collect():
        got[r["id"]].append(r["q_id"])
    assert got == want
    if k == 1:
        assert {r["id"]: r["q_id"] for r in spatial.nearest(pd, qd, reach).collect()} == {i: (v or [None])[0] for i, v in want.items()}


def test_what_a_point_meets_does_not_grow_with_the_crowd(spark):
    met = []
    for n in (1000, 4000):
        p, q = spark.createDataFrame(crowd(3, 400), SCHEMA), spark.createDataFrame(crowd(4, n), SCHEMA)
        met.append(spatial.nearest_pairs(p, q, 2.0).count())
    assert met[1] < 1.5 * met[0] and met[1] < 400 * 6 * spatial.LEAF_POINTS


def test_keys_must_agree(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, "a"), (1, 0.0, 0.0, "b"), (2, 9.0, 9.0, "a")], SCHEMA + ", event string")
    q = spark.createDataFrame([(7, 0.5, 0.0, "a"), (8, 0.1, 0.0, "b"), (9, 0.0, 0.4, "b")], SCHEMA + ", event string")
    got = {(r["id"], r["event"]): r["q_id"] for r in spatial.nearest(p, q, 1.0, keys=["event"]).collect()}
    assert got == {(1, "a"): 7, (1, "b"): 8, (2, "a"): None}
    assert spatial.nearest(p.where("false"), q, 1.0, keys=["event"]).count() == 0
    assert spatial.nearest(p, q.where("false"), 1.0, keys=["event"]).where("q_id is null").count() == 3
