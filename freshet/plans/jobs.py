"""Composite jobs: training tables, the risk surface, and point assessments.

Each job is one lazy plan over all events, places or cells; events are a key, not a loop.
Plane coordinates (x, y) are in the unit of the radii given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import cleaning, geo, risk
from freshet.operators import aggregates, grid, relational, series, spatial
from freshet.session import stored


def ring_census(
    cases: DataFrame, flooded: DataFrame, layers: DataFrame, rain: DataFrame, radius: int, inner: int, elevation: str = "z", dry_mm: float = 10.0, land: float = 0.0
) -> DataFrame:
    """(event, row, col, flooded, layers, rain): all land cells near an event's cases.

    ``cases`` and ``flooded`` are (event, row, col), ``rain`` (event, row, col, rain_6h, ...).
    A cell is flooded if it is in the event's set, or is a case itself where the event has no
    set. Kept are flooded cells, cells beyond ``inner`` cells of every event's cases, and
    cells with less rain than ``dry_mm``.
    """
    ring = spatial.disk(cases, radius, ["event"])
    own = spatial.case_distance(ring, cases, 1, ["event"]).withColumnRenamed("case_dist", "own_dist")
    anyone = spatial.case_distance(own, cases, inner).withColumnRenamed("case_dist", "any_dist")
    has_set = flooded.select("event").distinct().withColumn("_set", F.lit(True))
    marked = relational.flag_hits(anyone, flooded, ["event", "row", "col"]).join(has_set.hint("merge"), "event", "left")
    label = F.when(F.col("_set"), F.col("hit")).otherwise(F.when(F.col("own_dist") < 1, 1).otherwise(0))
    joined = marked.withColumn("flooded", label).join(layers.hint("merge"), ["row", "col"]).join(rain.hint("merge"), ["event", "row", "col"], "left")
    keep = (F.col("flooded") == 1) | F.col("any_dist").isNull() | (F.col("rain_6h") < dry_mm)
    return joined.where(keep & (F.col(elevation) > land)).drop("own_dist", "any_dist", "hit", "_set")


def ring_census_timed(census: DataFrame, timed: DataFrame, hours: DataFrame, least_rows: int = 1000, least_pos: int = 20) -> DataFrame:
    """The census at several hours of each event: a cell is positive once it has flooded.

    ``timed`` is (event, row, col, hour), ``hours`` (event, hour). Event ids become day_HH;
    hours with too few rows or positives are left out.
    """
    first = timed.groupBy("event", "row", "col").agg(F.min("hour").alias("_first"))
    every = census.join(hours, "event").join(first.hint("merge"), ["event", "row", "col"], "left")
    label = F.when(F.coalesce(F.col("_first") <= F.col("hour"), F.lit(False)), 1).otherwise(0)
    out = every.withColumn("flooded", label).withColumn("event", F.concat_ws("_", F.col("event").cast("string"), F.lpad(F.col("hour").cast("string"), 2, "0"))).drop("_first", "hour")
    good = out.groupBy("event").agg(F.count(F.lit(1)).alias("_n"), F.sum("flooded").alias("_p")).where((F.col("_n") >= least_rows) & (F.col("_p") >= least_pos)).select("event")
    return out.join(good, "event", "left_semi")


def event_table(frames: DataFrame, anchors: DataFrame, places: DataFrame, hours: Sequence[int] = series.HOURS) -> DataFrame:
    """(event, pt, rain windows, storm shape, place columns) up to each event's flood hour.

    ``places`` (event, pt, own_event, ...): positives recorded for another event are left out.
    """
    cut = relational.cut_at_anchor(frames, anchors)
    rain = series.accumulate(cut, ["event", "pt"], hours)
    shape = series.storm_shape(cut, ["event", "pt"])
    right = places.where(F.col("own_event").isNull() | (F.col("own_event") == F.col("event"))).drop("own_event")
    return right.join(rain, ["event", "pt"]).join(shape, ["event", "pt"])


def building_event_table(buildings: DataFrame, edges: DataFrame, rain: DataFrame, reach: float, size: float, station_reach: float) -> DataFrame:
    """(id, event, flood, flood_dist, q_id, rain): a building and each event that touches it.

    ``edges`` is the polygons' edge table with ``event`` as zone. Inside is 1, within
    ``reach`` of the event's polygons a weak 0, anything else unknown and left out. Rain
    comes from the nearest station with a complete total for that event, else the row goes;
    so polygons of events without such a station are left out before buildings meet them.
    """
    stations = stored(rain.where(F.col("rain_24h").isNotNull()).select(F.col("station").alias("id"), "event", "x", "y", "rain_24h"))
    edges = stored(edges.join(stations.select(F.col("event").alias("_event")).distinct().hint("shuffle_hash"), F.col("zone") == F.col("_event"), "left_semi"))
    inside = spatial.points_in_polygons(buildings, edges, size).select("id", F.col("zone").alias("event"), F.lit(1).alias("flood"), F.lit(0.0).alias("flood_dist"))
    near = spatial.edge_distances(buildings, edges, reach).select("id", F.col("zone").alias("event"), F.lit(0).alias("flood"), F.col("dist").alias("flood_dist"))
    label = inside.unionByName(near).groupBy("id", "event").agg(F.max("flood").alias("flood"), F.min("flood_dist").alias("flood_dist"))
    placed = label.join(buildings.select("id", "x", "y").hint("merge"), "id")
    met = spatial.nearest(placed, stations, station_reach, keys=["event"]).where("q_id is not null")
    return met.join(stations.select(F.col("id").alias("q_id"), "event", "rain_24h").hint("merge"), ["q_id", "event"]).select("id", "event", "flood", "flood_dist", "q_id", "rain_24h")


def matched_controls(cases: DataFrame, floods: DataFrame, rain: DataFrame, layers: DataFrame, g: geo.Grid, k: int, inner: float, outer: float, rain_reach: float, elevation: str = "z") -> DataFrame:
    """Cases (y 1) and their annulus controls (y 0) with rain of the nearest sample and layers, on land."""
    names = [c for c in layers.columns if c not in ("row", "col")]
    controls = relational.annulus_controls(cases, floods, k, inner, outer).withColumn("y1", F.lit(0))
    both = controls.unionByName(cases.select("id", F.col("id").alias("case_id"), "x", "y", F.lit(1).alias("y1")))
    wet = spatial.nearest(both, rain.select("id", "x", "y"), rain_reach).where("q_id is not null").join(rain.select(F.col("id").alias("q_id"), "rain_6h").hint("merge"), "q_id")
    out = relational.attach_layers(wet, layers, g, dict.fromkeys(names))
    return out.where(F.col(elevation) > 0).select("id", "case_id", F.col("y1").alias("label"), "x", "y", "rain_6h", *names)


def building_sample(buildings: DataFrame, edges: DataFrame, reach: float, size: float, n: int) -> DataFrame:
    """(id, flooded, sample_weight): all flooded buildings, every n-th of the dry ones far from floods."""
    inside = stored(spatial.inside_any(buildings, edges, size))
    near = inside.unionByName(spatial.border_distance(buildings, edges, reach).select("id")).distinct()
    wet = buildings.join(inside.hint("merge"), "id", "left_semi").withColumn("flooded", F.lit(1))
    dry = buildings.join(near.hint("merge"), "id", "left_anti").withColumn("flooded", F.lit(0))
    out = relational.systematic(wet.unionByName(dry), F.col("flooded") == 1, [F.col("id")], n)
    return out.select("id", "flooded", F.col("weight").alias("sample_weight"))


def basement_overlap(buildings: DataFrame, edges: DataFrame, years: DataFrame, size: float) -> DataFrame:
    """(id, province, floods, first_year, last_year, status) of buildings inside flood polygons.

    ``years`` is (zone, year); ``buildings`` has province and approved (a year).
    """
    span = spatial.inside_spans(buildings, edges, years.withColumnRenamed("year", "value"), size)
    span = span.withColumnsRenamed({"n": "floods", "least": "first_year", "most": "last_year"})
    joined = buildings.join(span.hint("merge"), "id")
    return joined.select("id", "province", "floods", "first_year", "last_year", cleaning.existed_at_flood(F.col("approved"), F.col("first_year"), F.col("last_year")).alias("status"))


def parking_risk(parking: DataFrame, donors: DataFrame, edges: DataFrame, donor_reach: float, reach: float, size: float, metres: float = 1.0) -> DataFrame:
    """(id, rel, band, flood_rate, flood_m, risk, rain_trigger) of parking places.

    The relative height comes from the nearest donor within ``donor_reach``, else UNKNOWN.
    """
    near = spatial.nearest(parking, donors.select("id", "x", "y"), donor_reach).drop("dist")
    rel = near.join(donors.select(F.col("id").alias("q_id"), "rel").hint("merge"), "q_id", "left")
    dist = spatial.dist_to_polygon(rel, edges, reach, size).withColumn("flood_m", F.col("dist") * metres)
    banded = dist.withColumn("_t", risk.terrain_band(F.col("rel")))
    return banded.select("id", "rel", F.col("_t.band").alias("band"), F.col("_t.rate").alias("flood_rate"), "flood_m", risk.static_risk(F.col("_t.band"), F.col("flood_m")).alias("risk"), risk.rain_trigger(F.col("_t.band")).alias("rain_trigger"))


def building_register_features(buildings: DataFrame, register: DataFrame, key: str = "parcel") -> DataFrame:
    """Buildings (key, rings) with area and centre from their rings and the parcel's roll-up."""
    rolled = aggregates.rollup_parcel(register, key, ["price", "area"], "area", "use", F.substring("status", 1, 1).cast("int"), "ord", "approved")
    measured = buildings.withColumn("_c", geo.ring_centroid(F.col("rings"))).withColumns({"x": F.col("_c.x"), "y": F.col("_c.y"), "footprint": F.col("_c.area")}).drop("_c", "rings")
    joined = relational.attach_register(measured, rolled.withColumn("register", F.lit("REGISTER")), key, {"register": "GIS_ONLY", "rows": 0})
    return joined.withColumn("floor_ratio", F.col("max_area") / F.nullif("footprint", F.lit(0.0)))


def enrich(df: DataFrame, extra: DataFrame, keys: Sequence[str], rank: Sequence[str] = (), region: str | None = None) -> DataFrame:
    """A finished table with further columns by key, and region ranks of some of them."""
    out = df.join(extra, list(keys), "left")
    for c in rank:
        out = series.region_rank(out, region, c, list(keys)).withColumnRenamed("region_rank", f"{c}_rank")
    return out


def risk_surface(cells: DataFrame, lines: DataFrame, edges: DataFrame, g: geo.Grid, radii: Sequence[int], reach: float, size: float, score: Callable[[DataFrame], DataFrame] | Column, elevation: str = "z", buffer: float | None = None) -> DataFrame:
    """Per land cell: heights above several windows' lowest ground, above the nearest river of each
    class, distance to past floods, and a score.

    ``score`` is a column or a fitted scorer. With a ``buffer`` only cells at most that far from a
    past flood are kept, before rivers are met and scores are made; without one all are filled.
    Heights and distances are written once each, so that what follows reads plain tables.
    """
    out = cells.where(F.col(elevation).isNotNull())
    for r in radii:
        out = grid.rel_height(out, elevation, r).withColumnRenamed("rel_height", f"rel_{r}")
    out = out.withColumn("_m", geo.centre_of(F.col("row"), F.col("col"), g)).withColumns({"x": F.col("_m.x"), "y": F.col("_m.y"), "id": F.col("row").cast("long") * g.cols + F.col("col")}).drop("_m")
    out = stored(spatial.dist_to_polygon(stored(out), edges, reach, size).withColumnRenamed("dist", "flood_dist"))
    if buffer is not None:
        out = out.where(F.col("flood_dist") <= buffer)
    river = river_heights(out, cells, lines, g, reach, elevation)
    out = out.join(river.hint("shuffle_hash"), "id", "left")
    return out.withColumn("score", score) if isinstance(score, Column) else score(out)


def river_heights(points: DataFrame, cells: DataFrame, lines: DataFrame, g: geo.Grid, reach: float, elevation: str = "z") -> DataFrame:
    """(id, above_<class>): height of each point above the ground at the nearest line's foot."""
    foot = spatial.nearest_line(points, lines, reach).join(points.select("id", F.col(elevation).alias("_z")).hint("merge"), "id")
    ground = relational.attach_layers(foot.withColumnRenamed("foot_x", "x").withColumnRenamed("foot_y", "y"), cells.select("row", "col", elevation), g, {elevation: None})
    return ground.withColumn("_above", F.col("_z") - F.col(elevation)).groupBy("id").pivot("kind", ["major", "minor"]).agg(F.max("_above")).withColumnRenamed("major", "above_major").withColumnRenamed("minor", "above_minor")


def building_features(buildings: DataFrame, cells: DataFrame, lines: DataFrame, g: geo.Grid, radii: Sequence[int], reach: float) -> DataFrame:
    """Buildings (id, x, y) with the heights of their cell over several windows and above rivers."""
    layers = cells
    for r in radii:
        layers = grid.rel_height(layers, "z", r).withColumnRenamed("rel_height", f"rel_{r}")
    placed = relational.attach_layers(buildings.select("id", "x", "y"), layers, g, {"z": None} | {f"rel_{r}": None for r in radii})
    return placed.join(river_heights(placed, cells, lines, g, reach).hint("merge"), "id", "left")


def assess(points: DataFrame, cells: DataFrame, g: geo.Grid, stations: DataFrame, parking: DataFrame, cutoffs: Sequence[tuple[str, float]], station_reach: float, park_reach: float, k: int = 3) -> DataFrame:
    """(id, risk, level, alert, reasons, parking): terrain, rain, alert and parking for a table of places.

    ``stations`` is (id, x, y, mm1h, mm3h, mm12h) of the stations that report.
    """
    ground = relational.attach_layers(points.select("id", "x", "y"), cells.select("row", "col", "score", "z"), g, {"score": None, "z": None})
    met = spatial.nearest(ground, stations.select("id", "x", "y"), station_reach).drop("dist")
    wet = met.join(stations.select(F.col("id").alias("q_id"), "mm1h", "mm3h", "mm12h").hint("merge"), "q_id", "left")
    band = F.coalesce(risk.band_of(F.col("score"), cutoffs, "VERY_LOW"), F.lit("UNKNOWN"))
    wet = wet.withColumns({"risk": band, "available": F.col("q_id").isNotNull(), "level": risk.warning_level(F.col("mm1h"), F.col("mm3h"), F.col("mm12h"))})
    near = spatial.within_topk(points, parking, park_reach, k).groupBy(F.col("id").alias("_p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "q_id"))), lambda s: s["q_id"]).alias("parking"))
    none = F.lit(None).cast("double")
    return wet.join(near.hint("merge"), F.col("id") == F.col("_p"), "left").select(
        "id", "risk", "level", risk.alert(F.col("risk"), F.col("available"), F.col("level"), risk.rain_trigger(F.col("risk"))).alias("alert"),
        risk.reasons(F.col("z"), none, none, F.col("available"), F.col("level")).alias("reasons"), F.coalesce("parking", F.array().cast("array<bigint>")).alias("parking"),
    )
