"""Distances, projections, grid cells and ring measures as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRES_PER_LON, METRES_PER_LAT = 88_000.0, 111_000.0
MERCATOR_HALF = 20037508.342789244


def flat_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, per_lon: float = METRES_PER_LON) -> Column:
    """Flat-earth metres between two points in degrees."""
    return F.hypot((lon2 - lon1) * per_lon, (lat2 - lat1) * METRES_PER_LAT)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


@dataclass(frozen=True)
class Tm:
    """A transverse-Mercator grid on the GRS80 ellipsoid."""

    lon0: float
    lat0: float
    k0: float
    east: float
    north: float


# The unified national grid and the central belt.
TM_5179 = Tm(127.5, 38.0, 0.9996, 1_000_000.0, 2_000_000.0)
TM_5186 = Tm(127.0, 38.0, 1.0, 200_000.0, 600_000.0)
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101


def _kruger() -> tuple[float, float, list[float], list[float], list[float]]:
    """Krueger's series in the third flattening: e, rectifying radius, alpha, beta, delta."""
    n = GRS80_F / (2 - GRS80_F)
    radius = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4]
    beta = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4]
    delta = [2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4, 7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4, 56 / 15 * n**3 - 136 / 35 * n**4]
    return math.sqrt(GRS80_F * (2 - GRS80_F)), radius, alpha, beta, delta


_E, _RADIUS, _ALPHA, _BETA, _DELTA = _kruger()


def meridian_offset(tm: Tm) -> float:
    """Northing of the grid's origin latitude on its meridian, scaled."""
    phi = math.radians(tm.lat0)
    t = math.sinh(math.atanh(math.sin(phi)) - _E * math.atanh(_E * math.sin(phi)))
    xi = math.atan(t)
    return tm.k0 * _RADIUS * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(_ALPHA)))


def to_tm(lon: Column, lat: Column, tm: Tm = TM_5179) -> Column:
    """struct(x, y) in metres of longitude and latitude in degrees."""
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    lam = F.radians(lon - tm.lon0)
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.pow(F.cos(lam), 2)))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = tm.k0 * _RADIUS
    return F.struct((scale * x + tm.east).alias("x"), (scale * y + (tm.north - meridian_offset(tm))).alias("y"))


def from_tm(x: Column, y: Column, tm: Tm = TM_5179) -> Column:
    """struct(lon, lat) in degrees of grid metres."""
    scale = tm.k0 * _RADIUS
    xi, eta = (y - (tm.north - meridian_offset(tm))) / scale, (x - tm.east) / scale
    xi0, eta0 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct((F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))) + tm.lon0).alias("lon"), F.degrees(phi).alias("lat"))


def to_3857(lon: Column, lat: Column) -> Column:
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * (MERCATOR_HALF / math.pi)
    return F.struct((lon * (MERCATOR_HALF / 180)).alias("x"), y.alias("y"))


def from_3857(x: Column, y: Column) -> Column:
    lat = F.degrees(2 * F.atan(F.exp(y * (math.pi / MERCATOR_HALF))) - math.pi / 2)
    return F.struct((x * (180 / MERCATOR_HALF)).alias("lon"), lat.alias("lat"))


def tile_of(x: Column, y: Column, zoom: int) -> Column:
    """struct(tx, ty, px, py): map tile and pixel of Mercator metres; 256 pixels a tile."""
    res = 2 * MERCATOR_HALF / (256 * 2**zoom)
    px, py = F.floor((x + MERCATOR_HALF) / res), F.floor((MERCATOR_HALF - y) / res)
    return F.struct(
        F.floor(px / 256).alias("tx"), F.floor(py / 256).alias("ty"), F.pmod(px, F.lit(256)).cast("int").alias("px"), F.pmod(py, F.lit(256)).cast("int").alias("py")
    )


@dataclass(frozen=True)
class Grid:
    """A raster's place: upper left corner, cell size, rows and columns."""

    cell: float
    origin_x: float
    origin_top: float
    rows: int
    cols: int


def cell_of(x: Column, y: Column, g: Grid) -> Column:
    """struct(row, col) of a point; NULL outside the grid."""
    row, col = F.floor((F.lit(g.origin_top) - y) / g.cell), F.floor((x - g.origin_x) / g.cell)
    inside = row.between(0, g.rows - 1) & col.between(0, g.cols - 1)
    return F.when(inside, F.struct(row.alias("row"), col.alias("col")))


def centre_of(row: Column, col: Column, g: Grid) -> Column:
    return F.struct((g.origin_x + (col + 0.5) * g.cell).alias("x"), (g.origin_top - (row + 0.5) * g.cell).alias("y"))


def _edges(ring: Column) -> Column:
    """Pairs (p, q) of neighbouring vertices of a ring, closed."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of a ring of struct(x, y)."""
    cross = F.transform(_edges(ring), lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2


def largest_ring(rings: Column) -> Column:
    sized = F.transform(rings, lambda r, i: F.struct(F.abs(ring_area(r)).alias("area"), (-i).alias("i"), r.alias("ring")))
    return F.array_max(sized)["ring"]


def ring_centroid(rings: Column) -> Column:
    """struct(x, y, area) of the largest ring, by the shoelace formula."""
    ring = largest_ring(rings)
    cross = lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    total = lambda f: F.aggregate(F.transform(_edges(ring), f), F.lit(0.0), lambda a, v: a + v)
    area = total(cross) / 2
    return F.struct(
        (total(lambda e: (e["p"]["x"] + e["q"]["x"]) * cross(e)) / (6 * area)).alias("x"),
        (total(lambda e: (e["p"]["y"] + e["q"]["y"]) * cross(e)) / (6 * area)).alias("y"),
        F.abs(area).alias("area"),
    )


def bbox_centre(rings: Column) -> Column:
    """struct(x, y, area): middle and area of the bounding box of all rings."""
    points = F.flatten(rings)
    side = lambda f, name: f(F.transform(points, lambda p: p[name]))
    x0, x1, y0, y1 = side(F.array_min, "x"), side(F.array_max, "x"), side(F.array_min, "y"), side(F.array_max, "y")
    return F.struct(((x0 + x1) / 2).alias("x"), ((y0 + y1) / 2).alias("y"), ((x1 - x0) * (y1 - y0)).alias("area"))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct(distance, x, y): distance of a point to a segment, and the nearest point on it."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length2))).otherwise(0.0)
    fx, fy = x1 + t * dx, y1 + t * dy
    return F.struct(F.hypot(px - fx, py - fy).alias("distance"), fx.alias("x"), fy.alias("y"))
