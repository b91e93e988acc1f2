"""Keyed, interval and as-of joins, samplers and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import geo
from freshet.operators.aggregates import global_rank
from freshet.session import stored


def attach_labels(features: DataFrame, labels: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Features with the last label of their key; features without one are dropped."""
    carried = [c for c in labels.columns if c not in keys]
    last = labels.groupBy(*keys).agg(F.max_by(F.struct(*carried), order).alias("_l"))
    return features.join(last, list(keys)).select(*features.columns, "_l.*")


def attach_register(buildings: DataFrame, parcels: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join with typed defaults for buildings without a register row."""
    joined = buildings.join(parcels, key, "left")
    return joined.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in joined.columns])


def keep_wanted(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def drop_by_place(df: DataFrame, bad: DataFrame, keys: Sequence[str] = ("event",), digits: int = 5) -> DataFrame:
    """Rows of ``df`` without those at a place (rounded lon, lat) and key of ``bad``."""
    place = lambda d: d.withColumns({"_lon": F.round("lon", digits), "_lat": F.round("lat", digits)})
    return place(df).join(place(bad).select(*keys, "_lon", "_lat").distinct(), [*keys, "_lon", "_lat"], "left_anti").select(*df.columns)


def flag_hits(panel: DataFrame, hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    marked = hits.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return panel.join(marked, list(keys), "left").withColumn("hit", F.coalesce("_hit", F.lit(0))).drop("_hit")


def attach_layers(points: DataFrame, cells: DataFrame, g: geo.Grid, layers: dict[str, Column | None]) -> DataFrame:
    """Points (x, y) with the layers of their cell; a layer's condition marks its no-data values."""
    missing = [n for n in layers if n not in cells.columns]
    if missing:
        raise ValueError(f"no such layer: {missing}")
    values = [F.when(~bad, F.col(n)).alias(n) if bad is not None else F.col(n) for n, bad in layers.items()]
    placed = points.withColumn("_c", geo.cell_of(F.col("x"), F.col("y"), g)).withColumns({"_row": F.col("_c.row"), "_col": F.col("_c.col")}).drop("_c")
    side = cells.select(F.col("row").alias("_r"), F.col("col").alias("_k"), *values)
    return placed.join(side, (F.col("_row") == F.col("_r")) & (F.col("_col") == F.col("_k")), "left").drop("_row", "_col", "_r", "_k")


def coverage(df: DataFrame, layers: Sequence[str]) -> DataFrame:
    """One row: the percentage of rows that know each layer."""
    return df.agg(*[(F.count(n) * 100.0 / F.count(F.lit(1))).alias(n) for n in layers])


def label_cells(cells: DataFrame, flooded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``cells`` with flooded 1 or 0 by membership in the event's cell set."""
    return flag_hits(cells, flooded, keys).withColumnRenamed("hit", "flooded")


def active_on(stations: DataFrame, days: DataFrame, key: str = "station") -> DataFrame:
    """(station, day, columns of the latest row valid that day); open start or end is unbounded.

    Both sides meet on the station, so the interval test runs inside an equi-join.
    """
    carried = [c for c in stations.columns if c not in (key, "start", "end")]
    met = days.join(stations, key).where((F.col("start").isNull() | (F.col("start") <= F.col("day"))) & (F.col("end").isNull() | (F.col("end") >= F.col("day"))))
    order = F.struct(F.col("start").isNotNull(), F.col("start"), *carried)
    return met.groupBy(key, "day").agg(F.max_by(F.struct(*carried), order).alias("_s")).select(key, "day", "_s.*")


def cut_at_anchor(frames: DataFrame, anchors: DataFrame, keys: Sequence[str] = ("event", "pt")) -> DataFrame:
    """Frames up to the first stamp after the event's flood hour (``anchor``, minutes).

    Where fewer than two frames remain, or there is no anchor, all are kept.
    """
    joined = frames.join(anchors.select("event", "anchor"), "event", "left")
    w = Window.partitionBy(*keys)
    first_after = F.min(F.when(F.col("stamp") > F.col("anchor"), F.col("stamp"))).over(w)
    joined = joined.withColumn("_keep", F.coalesce(F.col("stamp") <= F.coalesce(first_after, F.max("stamp").over(w)), F.lit(True)))
    left = F.sum(F.when(F.col("_keep"), 1).otherwise(0)).over(w)
    return joined.withColumn("_left", left).where(F.col("_keep") | (F.col("_left") < 2)).select(*frames.columns)


def level_and_rise(series: DataFrame, asked: DataFrame, back_hours: int = 6) -> DataFrame:
    """``asked`` (station, hour) with the level at that hour and the change over the hours before."""
    at = lambda name, shift: series.select("station", (F.col("hour") + shift).alias("hour"), F.col("level").alias(name))
    joined = asked.join(at("level", 0), ["station", "hour"], "left").join(at("_before", back_hours), ["station", "hour"], "left")
    return joined.withColumn("rise", F.col("level") - F.col("_before")).drop("_before")


def resolve_unique(keys: DataFrame, reference: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, candidates): the value of keys with one candidate; ambiguous ones keep the count only."""
    known = reference.groupBy(key).agg(F.collect_set(value).alias("_v"))
    joined = keys.select(key).distinct().join(known, key, "left").withColumn("candidates", F.greatest(F.size("_v"), F.lit(0)))
    return joined.select(key, F.when(F.col("candidates") == 1, F.get("_v", F.lit(0))).alias(value), "candidates")


def geocode(wanted: DataFrame, places: DataFrame, key: str, order: str) -> DataFrame:
    """(key, x, y) of the first occurrence of each wanted key."""
    first = places.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min_by(F.struct("x", "y"), order).alias("_p"))
    return first.select(key, "_p.x", "_p.y")


def cascade_join(names: DataFrame, reference: DataFrame, name: str = "name") -> DataFrame:
    """(name, value, step): full name, first two words, last word, all but the first; the first hit wins.

    ``reference`` is (key, value).
    """
    words = F.split(F.trim(name), r"\s+")
    tries = [F.trim(name), F.array_join(F.slice(words, 1, 2), " "), F.element_at(words, -1), F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")]
    cand = names.select(name).distinct().withColumn("_t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), t.alias("t")) for i, t in enumerate(tries)])))
    hit = cand.join(reference.hint("shuffle_merge"), F.col("_t.t") == F.col("key")).groupBy(name).agg(F.min(F.struct(F.col("_t.i").alias("step"), F.col("value"))).alias("_b"))
    return names.select(name).distinct().join(hit.hint("shuffle_hash"), name, "left").select(name, F.col("_b.value").alias("value"), F.col("_b.step").alias("step"))


def article_bags(articles: DataFrame, regions: DataFrame, pattern: str) -> DataFrame:
    """(region, day, articles): articles that name a region, counted on their day and the day before.

    ``articles`` (day, text); ``regions`` (name, qualifier, region). A name that one region
    has is enough; a shared name needs the region's qualifier in the same text.
    """
    of_name = Window.partitionBy("name")
    named = regions.withColumn("_n", F.count(F.lit(1)).over(of_name))
    # a row for each different word of a text, without the text's other words
    words = articles.select("day", F.xxhash64("day", "text").alias("_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("_word"))
    met = words.join(named.hint("shuffle_hash"), F.col("_word") == F.col("name")).select("day", "region", "qualifier", "_n", "_id")
    qualifiers = named.where("_n > 1").select(F.col("qualifier").alias("_q")).distinct()
    said = words.join(qualifiers.hint("shuffle_hash"), F.col("_word") == F.col("_q")).select(F.col("_id").alias("_of"), "_q").distinct()
    shared = met.where("_n > 1").join(said.hint("shuffle_merge"), (F.col("_id") == F.col("_of")) & (F.col("qualifier") == F.col("_q")))
    sure = met.where("_n = 1").select("day", "region", "_id").unionByName(shared.select("day", "region", "_id")).distinct()
    both = sure.unionByName(sure.withColumn("day", F.date_sub("day", 1)))
    return both.groupBy("region", "day").agg(F.count_distinct("_id").alias("articles"))


def borrow_mode(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``a`` with missing ``value`` taken from the mode of ``b`` in the same group (ties: the least)."""
    mode = b.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = mode.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("_mode"))
    return a.join(best, list(keys), "left").withColumn(value, F.coalesce(F.col(value), F.col("_mode"))).drop("_mode")


#: Places of events (a row each) up to which their values are broadcast.
BROADCAST_PLACES = 200_000


def swap_partner(df: DataFrame, event: str, place: str, value: str, k: int = 3) -> DataFrame:
    """``df`` with the value that the event ``k`` further on (in order, cyclic) has at the same place."""
    events = df.select(event).distinct()
    w = Window.orderBy(event)  # one row an event
    numbered = events.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    pairs = numbered.select(F.col(event).alias("_from"), F.pmod(F.col("_i") + k, F.col("_n")).alias("_j"))
    mapping = pairs.join(numbered.select(F.col(event).alias("_to"), F.col("_i")), F.col("_j") == F.col("_i")).select("_from", "_to")
    donor = df.groupBy(F.col(event).alias("_donor"), F.col(place).alias("_place")).agg(F.max(value).alias("swapped"))
    given = stored(donor.join(mapping.hint("shuffle_hash"), F.col("_donor") == F.col("_to")).select("_from", "_place", "swapped"))
    # few events hold many rows: a small table of places goes to the rows, which are never shuffled by event
    given = F.broadcast(given) if given.count() <= BROADCAST_PLACES else given.hint("shuffle_hash")
    return df.where(F.col(event).isNotNull()).join(given, (F.col(event) == F.col("_from")) & (F.col(place) == F.col("_place")), "left").drop("_from", "_place")


def exposure_pieces(edges: DataFrame, step: float) -> DataFrame:
    """Edges (edge_id, x1, y1, x2, y2) cut into equal pieces of at most ``step``: middles and lengths."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.ceil(length / step), F.lit(1))
    out = edges.withColumn("_len", length).withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    t = (F.col("_i") + 0.5) / F.col("_n")
    return out.select("edge_id", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"), (F.col("_len") / F.col("_n")).alias("length"))


def edge_exposure(edges: DataFrame, risk: DataFrame, buffer: float, step: float) -> DataFrame:
    """(edge_id, high_m, very_high_m): length of each edge near HIGH and VERY_HIGH points.

    A piece near a VERY_HIGH point counts there only.
    """
    from freshet.operators.spatial import pairs_within

    pieces = exposure_pieces(edges, step).withColumn("id", F.xxhash64("edge_id", "x", "y"))
    near = pairs_within(pieces, risk.select("id", "x", "y", "level"), buffer)
    worst = near.groupBy("edge_id", "id", "length").agg(F.max(F.when(F.col("q_level") == "VERY_HIGH", 2).otherwise(1)).alias("_w"))
    lengths = worst.groupBy("edge_id").agg(F.sum(F.when(F.col("_w") == 1, F.col("length")).otherwise(0.0)).alias("high_m"), F.sum(F.when(F.col("_w") == 2, F.col("length")).otherwise(0.0)).alias("very_high_m"))
    return edges.select("edge_id").join(lengths.hint("shuffle_hash"), "edge_id", "left").na.fill(0.0, ["high_m", "very_high_m"])


# --- samples -------------------------------------------------------------------------


def draw(*cols: str, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of columns: the same row draws the same number anywhere."""
    hashed = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long") / float(1 << 52)


def top_fraction(df: DataFrame, score: str, ident: Sequence[str], f: float, floor: bool = False) -> DataFrame:
    """The top k = max(round(n f), 1) rows by score (half to even, or floor); ties by ident.

    A threshold from sorted partitions: rows are placed in a global order by range.
    """
    placed, n = global_rank(df, [F.col(score).desc_nulls_last(), *[F.col(i) for i in ident]], "_place")
    k = max(int(n * f) if floor else round(n * f), 1)
    return placed.where(F.col("_place") < k).drop("_place")


def nearest_list(df: DataFrame, x: float | None, y: float | None, n: int = 20) -> DataFrame:
    """The first ``n`` rows by distance, or by name where no place is given."""
    dist = F.hypot(F.col("x") - x, F.col("y") - y) if x is not None and y is not None else F.lit(None).cast("double")
    return df.withColumn("dist", dist).orderBy(F.col("dist").asc_nulls_last(), "name").limit(n)


def systematic(df: DataFrame, positive: Column, order: Sequence[Column], n: int) -> DataFrame:
    """All positives (weight 1) and every n-th negative in order (weight n)."""
    placed, _ = global_rank(df.where(~positive), list(order), "_place")
    kept = placed.where(F.col("_place") % n == 0).drop("_place").withColumn("weight", F.lit(float(n)))
    return df.where(positive).withColumn("weight", F.lit(1.0)).unionByName(kept)


def to_pos_rate(df: DataFrame, positive: Column, ident: Sequence[str], rate: float, seed: int = 0) -> DataFrame:
    """Positives, and as many hashed negatives as give the target positive rate (at most all)."""
    counts = df.agg(F.sum(F.when(positive, 1).otherwise(0)), F.count(F.lit(1))).first()
    pos, neg = counts[0] or 0, counts[1] - (counts[0] or 0)
    share = min(1.0, pos * (1 - rate) / rate / neg) if neg else 0.0
    return df.where(positive | (draw(*ident, seed=seed) < share))


def sample_per_group(df: DataFrame, group: str, ident: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each group (all, if fewer), by hash order."""
    w = Window.partitionBy(group).orderBy(draw(*ident, seed=seed), *ident)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def annulus_controls(cases: DataFrame, floods: DataFrame, k: int, inner: float, outer: float, seed: int = 0) -> DataFrame:
    """``k`` points for each case, uniform by area between two radii, none within ``inner`` of a flood."""
    from freshet.operators.spatial import nearest

    drawn = cases.select(F.col("id").alias("case_id"), "x", "y").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    angle, u = draw("case_id", "_k", seed=seed) * 6.283185307179586, draw("case_id", "_k", seed=seed + 1)
    r = F.sqrt(u * (outer**2 - inner**2) + inner**2)
    placed = drawn.select("case_id", "_k", (F.col("x") + r * F.cos(angle)).alias("x"), (F.col("y") + r * F.sin(angle)).alias("y")).withColumn("id", F.xxhash64("case_id", "_k"))
    return nearest(placed, floods, inner).where("q_id is null").select("id", "case_id", "x", "y")


def grid_sample(cells: DataFrame, positives: DataFrame, dilation: int, times: int, seed: int = 0) -> DataFrame:
    """Positives, and hashed cells outside their n-step dilation: ``times`` as many, weighted pool / picked."""
    steps = [(a, b) for a in range(-dilation, dilation + 1) for b in range(-dilation, dilation + 1) if abs(a) + abs(b) <= dilation]
    grown = positives.select("row", "col").withColumn("_o", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])))
    near = grown.select((F.col("row") + F.col("_o.a")).alias("row"), (F.col("col") + F.col("_o.b")).alias("col")).distinct()
    pool = cells.join(near.hint("shuffle_hash"), ["row", "col"], "left_anti")
    n_pool, n_pos = pool.count(), positives.count()
    share = min(1.0, times * n_pos / n_pool) if n_pool else 0.0
    picked = pool.where(draw("row", "col", seed=seed) < share).withColumn("weight", F.lit(1 / share if share else 0.0)).withColumn("y", F.lit(0))
    own = cells.join(positives.select("row", "col").distinct(), ["row", "col"], "left_semi")
    return own.withColumn("weight", F.lit(1.0)).withColumn("y", F.lit(1)).unionByName(picked)


def fraction(df: DataFrame, ident: Sequence[str], f: float, seed: int = 0) -> DataFrame:
    return df.where(draw(*ident, seed=seed) < f)


def _filled(loads: Sequence[int], size: int, items: int) -> list[int]:
    """How many of ``items`` equal items each bin gets if each goes to the least loaded (the first of equals)."""
    if size == 0:
        least = loads.index(min(loads))
        return [items if j == least else 0 for j in range(len(loads))]
    upto = lambda level: [max(0, (level - x) // size + 1) for x in loads]  # noqa: E731  items placed on loads up to a level
    lo, hi = min(loads) - 1, max(loads) + size * items
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if sum(upto(mid)) <= items else (lo, mid)
    given = upto(lo)
    left = items - sum(given)
    for j, x in enumerate(loads):  # the next items sit on loads of the next level exactly
        if left and x <= hi and (hi - x) % size == 0:
            given[j], left = given[j] + 1, left - 1
    return given


def balanced_folds(df: DataFrame, group: str, positive: Column, k: int) -> DataFrame:
    """(group, positives, fold): groups by falling positives, each into the least loaded fold. Ties by group, then fold.

    The driver sees one row for each different number of positives (at most the root of
    twice their sum), and counts how many such groups each fold gets. A fold's t-th group of
    p positives comes after as many groups as the folds have with less load then, which gives
    its place among the groups of p; groups get their places by range partitions.
    """
    totals = stored(df.groupBy(group).agg(F.sum(F.when(positive, 1).otherwise(0)).cast("long").alias("positives")))
    sizes = totals.groupBy("positives").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("positives")).collect()
    loads, plan, before = [0] * k, [], 0
    for p, n in sizes:
        given = _filled(loads, p, n)
        plan += [(p, j, before, loads[j], given[j], list(loads)) for j in range(k) if given[j]]
        loads = [x + p * g for x, g in zip(loads, given, strict=True)]
        before += n
    spark, chunk = df.sparkSession, 100_000
    steps = spark.createDataFrame(plan, "p long, fold int, before long, load long, given long, loads array<long>")
    parts = steps.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("given") - 1) / chunk)))).repartition("p", "fold", "c")
    turns = parts.withColumn("t", F.explode(F.sequence(F.col("c") * chunk, F.least((F.col("c") + 1) * chunk, F.col("given")) - 1)))
    level = F.col("load") + F.col("t") * F.col("p")
    later = lambda j: F.when(j >= F.col("fold"), 1).otherwise(0)
    ahead = F.transform("loads", lambda x, j: F.greatest(F.lit(0).cast("long"), F.floor((level - x - later(j)) / F.col("p")) + 1))
    rank = F.when(F.col("p") == 0, F.col("t")).otherwise(F.aggregate(ahead, F.lit(0).cast("long"), lambda s, x: s + x))
    places = turns.select((F.col("before") + rank).alias("_at"), "fold")
    placed, _ = global_rank(totals, [F.desc("positives"), F.col(group)], "_place")
    return placed.join(places.hint("shuffle_hash"), F.col("_place") == F.col("_at")).select(group, "positives", "fold")


# --- sets ----------------------------------------------------------------------------


def merge_labels(sources: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """Label sources (name, precision, rows) as one table; what a source lacks is NULL."""
    out = None
    for name, precision, df in sources:
        part = df.withColumns({"source": F.lit(name), "precision": F.lit(precision)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merge_cells(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of two cell sets; where one lacks the hour, the other fills it."""
    both = a.select(*keys, "hour", F.lit(0).alias("_o")).unionByName(b.select(*keys, "hour", F.lit(1).alias("_o")))
    return both.groupBy(*keys).agg(F.min_by("hour", F.when(F.col("hour").isNotNull(), F.struct("_o", "hour"))).alias("hour"))


def positives(points: DataFrame, cells: DataFrame, dist: str) -> DataFrame:
    return points.select("row", "col").union(cells.where(F.col(dist) == 0).select("row", "col")).distinct()


def code_coverage(expected: DataFrame, found: DataFrame, code: str) -> DataFrame:
    """One row: codes in both, only expected, only found."""
    e, f = expected.select(code).distinct(), found.select(code).distinct()
    side = e.select(F.col(code).alias("_e")).join(f.select(F.col(code).alias("_f")), F.col("_e").eqNullSafe(F.col("_f")), "full")
    both = F.col("_e").isNotNull() & F.col("_f").isNotNull()
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return side.agg(n(both).alias("both"), n(F.col("_f").isNull()).alias("only_expected"), n(F.col("_e").isNull()).alias("only_found"))
