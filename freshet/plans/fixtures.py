"""Reference-shaped inputs derived from the star-schema tables, in Spark and in SQL.

Each function has a SQL twin of the same name in ``SQL``; ``sql(names)`` gives the WITH
clause that the queries' SQL starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import geo
from freshet.session import table


def _epoch_hour(ts: str):
    return F.floor(F.unix_timestamp(ts) / 3600)


def stations(spark: SparkSession, sf: str) -> int:
    return max(10, table(spark, sf, "events").count() // 1000)


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rain (station, hour, mm), a station for about 1,000 events; hours are missing where nothing fell in."""
    e = table(spark, sf, "events")
    return e.groupBy((F.col("user_id") % stations(spark, sf)).alias("station"), _epoch_hour("ts").alias("hour")).agg((F.sum("value") / 10).alias("mm"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Radar frames (event, pt, stamp in minutes, span_min, rate): hourly, 10-minute from 18 h on."""
    e = table(spark, sf, "events").withColumn("minute", F.floor(F.unix_timestamp("ts") / 60))
    late = F.hour("ts") >= 18
    stamped = e.select(
        F.date_format("ts", "yyyyMMdd").alias("event"),
        (F.col("user_id") % stations(spark, sf)).alias("pt"),
        F.when(late, F.floor(F.col("minute") / 10) * 10).otherwise(F.floor(F.col("minute") / 60) * 60).alias("stamp"),
        F.when(late, 10).otherwise(60).alias("span_min"),
        "value",
    )
    return stamped.groupBy("event", "pt", "stamp", "span_min").agg((F.avg("value") / 10).alias("rate"))


def event_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days with a large event of each type (event_id, day)."""
    e = table(spark, sf, "events").where("value > 200")
    return e.select(F.col("event_type").alias("event_id"), F.to_date("ts").alias("day")).distinct()


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Flood hour of each day: the hour of its largest event (event, hour)."""
    e = table(spark, sf, "events")
    return e.groupBy(F.date_format("ts", "yyyyMMdd").alias("event")).agg(F.max_by(F.hour("ts"), F.struct("value", "event_id")).alias("hour"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Points (id, lon, lat, kind) in a box of about four degrees."""
    v = table(spark, sf, "embeddings")
    return v.select(
        F.col("vec_id").alias("id"),
        (127 + 2 * F.col("embedding")[0].cast("double")).alias("lon"),
        (36 + 2 * F.col("embedding")[1].cast("double")).alias("lat"),
        F.when(F.col("label") < 3, "flood").otherwise("control").alias("kind"),
    )


def side(spark: SparkSession, sf: str) -> int:
    """Rows and columns of the grid: a cell for about 30 rows of lineitem."""
    return max(8, int((table(spark, sf, "lineitem").count() / 30) ** 0.5))


def grid(spark: SparkSession, sf: str) -> geo.Grid:
    """The place of ``cells`` in the plane of ``xy``."""
    return geo.Grid(0.5, -10.0, 10.0, side(spark, sf), side(spark, sf))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """A grid that grows with lineitem, with layers z, land, built, acc and score."""
    li = table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_orderkey") % side(spark, sf)).cast("int").alias("row"), (F.col("l_partkey") % side(spark, sf)).cast("int").alias("col")).agg(
        F.round(F.avg("l_quantity"), 3).alias("z"),
        F.count(F.lit(1)).alias("acc"),
        # in decimals: sums of doubles in another order end beside the halves that the rounding meets
        F.round(F.avg(F.col("l_discount").cast("decimal(12,6)")), 4).cast("double").alias("built"),
        F.round(F.max("l_extendedprice") / 110000, 4).alias("score"),
        F.max(F.col("l_suppkey") % 900).cast("int").alias("land"),
    )


def census(spark: SparkSession, sf: str) -> DataFrame:
    """Place x storm rows (id, event, flooded, rel, rain, built)."""
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.month("l_shipdate").alias("event"),
        (F.col("l_returnflag") == "R").alias("flooded"),
        F.col("l_quantity").alias("rel"),
        (F.col("l_extendedprice") / 1000).alias("rain"),
        F.col("l_discount").alias("built"),
        F.col("l_tax").alias("road"),
        F.col("l_suppkey").alias("zone"),
    )


def register(spark: SparkSession, sf: str) -> DataFrame:
    """Building register rows (parcel, ord, price, area, status, use, approved)."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").alias("parcel"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("area"),
        F.col("o_orderpriority").alias("status"),
        F.col("l_returnflag").alias("use"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("approved"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Directed road edges (edge_id, src, dst, len, blocked), about ten a node, with parallels."""
    o = table(spark, sf, "orders")
    nodes = max(10, o.count() // 10)
    return o.select(
        F.col("o_orderkey").alias("edge_id"),
        ((F.col("o_custkey") * 31 + F.col("o_orderkey") * 17) % nodes).alias("src"),
        (F.col("o_orderkey") % nodes).alias("dst"),
        F.round(F.col("o_totalprice") / 100).alias("len"),
        (F.col("o_orderstatus") == "P").alias("blocked"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows (id, y, s, s2, w, grp); ties occur."""
    d, lb = table(spark, sf, "documents"), table(spark, sf, "labels")
    j = lb.join(d.select("doc_id", "n_chars", "source"), "doc_id")
    return j.select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("s"), (F.col("n_chars") % 97).cast("double").alias("s2"),
        (1 + F.col("toxic")).cast("double").alias("w"), F.col("source").alias("grp"),
    )


ZONES = (
    ("a", 1, ((0, 0), (6, 0), (6, 6), (0, 6)), ((2, 2), (4, 2), (4, 4), (2, 4))),
    ("b", 2, ((5, 5), (12, 5), (12, 12), (9, 12), (9, 8), (5, 8)), None),
    ("c", 3, ((-8, -6), (-1, -6), (-4, 2)), None),
)


#: Corners of the hexagons around points, in radii.
CORNERS = ((1, 0), (0.5, 0.8), (-0.5, 0.8), (-1, 0), (-0.5, -0.8), (0.5, -0.8))


def zone_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edge table (zone, ord, ring, i, x1, y1, x2, y2): three fixed polygons, one with a hole, and a
    hexagon of a radius by its label around every fifth point."""
    rows = []
    for zone, ordinal, *rings in ZONES:
        for r, ring in enumerate(x for x in rings if x):
            for i, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True)):
                rows.append((zone, ordinal, r, i, *map(float, (*p, *q))))
    fixed = spark.createDataFrame(rows, "zone string, ord int, ring int, i int, x1 double, y1 double, x2 double, y2 double")
    radius = 0.8 + F.col("label") * 0.1
    sides = list(zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True))
    corner = lambda c, k: F.col("xy"[k]) + radius * float(c[k])
    edges = F.array(*[F.struct(F.lit(i).alias("i"), corner(a, 0).alias("x1"), corner(a, 1).alias("y1"), corner(b, 0).alias("x2"), corner(b, 1).alias("y2")) for i, (a, b) in enumerate(sides)])
    around = xy(spark, sf).where("id % 5 = 0").select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("zone"), (F.col("id") + 10).cast("int").alias("ord"), F.lit(0).alias("ring"), F.explode(edges).alias("e"))
    return fixed.unionByName(around.select("zone", "ord", "ring", "e.*"))


def xy(spark: SparkSession, sf: str) -> DataFrame:
    """Plane points (id, x, y, kind) in kilometres of a local origin."""
    v = table(spark, sf, "embeddings")
    return v.select(
        F.col("vec_id").alias("id"), (40 * F.col("embedding")[0].cast("double")).alias("x"), (40 * F.col("embedding")[1].cast("double")).alias("y"),
        F.when(F.col("label") < 3, "flood").otherwise("control").alias("kind"), F.col("label").alias("label"),
    )


def _zone_sql() -> str:
    rows = []
    for zone, ordinal, *rings in ZONES:
        for r, ring in enumerate(x for x in rings if x):
            for i, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True)):
                rows.append(f"('{zone}', {ordinal}, {r}, {i}, {p[0]}::double, {p[1]}::double, {q[0]}::double, {q[1]}::double)")
    sides = zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True)
    corners = ", ".join(f"({i}, {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for i, (a, b) in enumerate(sides))
    return f"""zone_edges(zone, ord, ring, i, x1, y1, x2, y2) as (values {', '.join(rows)} union all
        select 'q' || vec_id, (vec_id + 10)::int, 0, k, x + r * a, y + r * b, x + r * c, y + r * d from (select vec_id, 40 * embedding[1]::double as x, 40 * embedding[2]::double as y, 0.8::double + label * 0.1::double as r
          from embeddings where vec_id % 5 = 0), (values {corners}) as t(k, a, b, c, d))"""


SQL = {
    "obs": "obs as (select user_id % (select greatest(10, count(*) // 1000) from events) as station, (epoch_us(ts) // 1000000) // 3600 as hour, sum(value) / 10 as mm from events group by 1, 2)",
    "frames": """frames as (select strftime(ts, '%Y%m%d') as event, user_id % (select greatest(10, count(*) // 1000) from events) as pt,
        case when hour(ts) >= 18 then (epoch_us(ts) // 1000000) // 600 * 10 else (epoch_us(ts) // 1000000) // 3600 * 60 end as stamp,
        case when hour(ts) >= 18 then 10 else 60 end as span_min, avg(value) / 10 as rate from events group by 1, 2, 3, 4)""",
    "event_days": "event_days as (select distinct event_type as event_id, ts::date as day from events where value > 200)",
    "anchors": "anchors as (select strftime(ts, '%Y%m%d') as event, hour(arg_max(ts, (value, event_id)))::int as hour from events group by 1)",
    "points": """points as (select vec_id as id, 127 + 2 * embedding[1]::double as lon, 36 + 2 * embedding[2]::double as lat,
        case when label < 3 then 'flood' else 'control' end as kind from embeddings)""",
    "cells": """cells as (select (l_orderkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as row, (l_partkey % (select greatest(8, floor(sqrt(count(*) / 30.0)))::bigint from lineitem))::int as col, round(avg(l_quantity), 3) as z, count(*) as acc,
        round(avg(l_discount), 4) as built, round(max(l_extendedprice) / 110000, 4) as score, max(l_suppkey % 900)::int as land from lineitem group by 1, 2)""",
    "census": """census as (select l_orderkey * 10 + l_linenumber as id, month(l_shipdate)::int as event, l_returnflag = 'R' as flooded, l_quantity as rel,
        l_extendedprice / 1000 as rain, l_discount as built, l_tax as road, l_suppkey as zone from lineitem)""",
    "register": """register as (select o_custkey as parcel, l_orderkey * 10 + l_linenumber as ord, l_extendedprice as price, l_quantity as area,
        o_orderpriority as status, l_returnflag as use, strftime(o_orderdate, '%Y%m%d') as approved from lineitem join orders on l_orderkey = o_orderkey)""",
    "edges": "edges as (select o_orderkey as edge_id, (o_custkey * 31 + o_orderkey * 17) % (select greatest(10, count(*) // 10) from orders) as src, o_orderkey % (select greatest(10, count(*) // 10) from orders) as dst, round(o_totalprice / 100) as len, o_orderstatus = 'P' as blocked from orders)",
    "scores": """scores as (select doc_id as id, quality as y, n_chars::double as s, (n_chars % 97)::double as s2, (1 + toxic)::double as w, source as grp
        from labels join documents using (doc_id))""",
    "zone_edges": _zone_sql(),
    "xy": """xy as (select vec_id as id, 40 * embedding[1]::double as x, 40 * embedding[2]::double as y,
        case when label < 3 then 'flood' else 'control' end as kind, label from embeddings)""",
}


def sql(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names)
