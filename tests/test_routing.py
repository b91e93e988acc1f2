"""Shortest paths from many sources, in blocks, against plain Dijkstra."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import graph


def roads(seed: int, nodes: int = 60, edges: int = 220, local: bool = False) -> list[tuple]:
    r = random.Random(seed)
    to = (lambda a: min(nodes - 1, max(0, a + r.randrange(-4, 5)))) if local else (lambda a: r.randrange(nodes))
    return [(i, a := r.randrange(nodes), to(a), float(r.randrange(0 if seed == 3 else 1, 20)), r.random() < 0.2) for i in range(edges)]


def dijkstra(rows: list[tuple], source: int, bound: float = float("inf")) -> dict:
    """node -> (dist, edges, last edge), by least of these three."""
    best: dict = {}
    for e, a, b, w, _ in rows:
        if (a, b) not in best or (w, e) < best[a, b]:
            best[a, b] = (w, e)
    out: dict = {}
    heap = [(0.0, 0, -1, source)]
    while heap:
        d, h, v, n = heapq.heappop(heap)
        if n in out:
            continue
        out[n] = (d, h, v)
        for (a, b), (w, e) in best.items():
            if a == n and d + w <= bound:
                heapq.heappush(heap, (d + w, h + 1, e, b))
    return out


@pytest.mark.parametrize(("seed", "local", "block_edges", "bound"), [(1, True, 40, None), (2, False, 60, 25.0), (3, True, 25, None), (4, False, 1_000_000, 30.0)])
def test_many_sources_in_blocks_equal_dijkstra(spark, seed, local, block_edges, bound):
    rows = roads(seed, local=local)
    df = spark.createDataFrame(rows, "edge_id long, src long, dst long, len double, blocked boolean")
    wanted = [0, 7, 7, 31, 59, 1000]  # a repeated source, and one that has no roads
    sources = spark.createDataFrame([(s,) for s in wanted], "source long")
    got = graph.distances_from(graph.simplest(df, "len"), sources, bound, block_edges=block_edges, together=2).collect()
    want = {(s, n): v for s in set(wanted) for n, v in dijkstra(rows, s, bound or float("inf")).items()}
    assert {(r["source"], r["node"]): (r["dist"], r["hop"], -1 if r["via"] is None else r["via"]) for r in got} == want
    assert len(got) == len(want)


def test_routes_of_many_sources_lead_from_source_to_node(spark):
    rows = roads(5)
    df = spark.createDataFrame(rows, "edge_id long, src long, dst long, len double, blocked boolean")
    sources = spark.createDataFrame([(3,), (40,)], "source long")
    found = graph.routes(df, sources, avoid_blocked=True, block_edges=50).collect()
    open_rows = [r for r in rows if not r[4]]
    assert {(r["source"], r["node"]): r["dist"] for r in found} == {(s, n): v[0] for s in (3, 40) for n, v in dijkstra(open_rows, s).items()}
    for r in found:
        at, length = r["source"], 0.0
        for e in r["path"]:
            assert rows[e][1] == at and not rows[e][4]
            at, length = rows[e][2], length + rows[e][3]
        assert (at, length) == (r["node"], r["dist"])


def test_no_roads_and_no_sources(spark):
    none = spark.createDataFrame([], "edge_id long, src long, dst long, len double, blocked boolean")
    one = spark.createDataFrame([(4,)], "source long")
    assert [tuple(r) for r in graph.routes(none, one).collect()] == [(4, 4, 0.0, [])]
    assert graph.routes(none, one.where("false")).count() == 0


def test_destinations_of_each_source(spark):
    routes = spark.createDataFrame([(1, 10, 5.0), (1, 11, 3.0), (1, 12, 1.0), (2, 10, 9.0)], "source long, node long, dist double")
    candidates = routes.select("source", F.col("node").alias("id"), "node", (F.col("node") * 100.0).alias("dist_m"))
    inside = spark.createDataFrame([(12,)], "id long")
    got = graph.choose_destinations(routes, candidates, inside, 1150.0)
    assert sorted(map(tuple, got.collect())) == [(1, 11, 3.0), (2, 10, 9.0)]
    assert sorted(map(tuple, graph.choose_destinations(routes, candidates, inside, 1150.0, nearest=1).collect())) == [(1, 10, 5.0), (2, 10, 9.0)]
