"""Grouped summaries, rates, tables and reports. All partial-aggregated, none collects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import geo
from freshet.operators.ordering import quantiles, running
from freshet.session import stored


def with_quantile(grouped: DataFrame, df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """``grouped``, a row for each of the ``keys`` of ``df``, with the exact quantile of a value of its rows.

    By range partitions of (keys, value): a group of any size is in no single task.
    """
    known = df.select(F.struct(*keys).alias("_g"), F.col(value))
    cut = quantiles(known, value, [share], group="_g").select("_g", F.get("q", F.lit(0)).alias(name))
    return grouped.withColumn("_k", F.struct(*keys)).join(cut.hint("shuffle_hash"), F.col("_k").eqNullSafe(F.col("_g")), "left").drop("_k", "_g")


def summary_by(df: DataFrame, keys: Sequence[str], value: str, flag: Column) -> DataFrame:
    """Rows, non-null values, min, median, max and flagged rows of each group."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(value).alias("known"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.sum(F.when(flag, 1).otherwise(0)).alias("flagged"),
    )
    return with_quantile(out, df, keys, value, 0.5, "median").select(*keys, "rows", "known", "least", "median", "most", "flagged")


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by ``order``; rows whose keys are all missing are keyed by their contents."""
    missing = F.lit(True)
    for k in keys:
        missing = missing & F.col(k).isNull()
    own = F.when(missing, F.xxhash64(*[F.col(c) for c in df.columns]))
    last = Window.partitionBy(*keys, "_own").orderBy(*[o.desc() for o in order])
    return df.withColumn("_own", own).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_own", "_n")


def qa(df: DataFrame, sets: Sequence[Sequence[str]], day: str, time: str, ident: str) -> DataFrame:
    """Quality counters for several groupings in one pass (grouping sets), with the grouping's id."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.grouping_id().cast("long").alias("grouping"),
        F.count(F.lit(1)).alias("records"),
        F.count_distinct(day).alias("days"),
        F.sum(F.when(F.col(time).isNull(), 1).otherwise(0)).alias("time_missing"),
        F.sum(F.when(F.col(time) == "0000", 1).otherwise(0)).alias("time_zero"),
        F.sum(F.when(F.col(ident).isNull() | (F.col(ident) <= 0), 1).otherwise(0)).alias("bad_ids"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """One row: the missing values of every column."""
    return df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in df.columns])


def rollup_parcel(df: DataFrame, key: str, measures: Sequence[str], area: str, text: str, rank: Column, order: str, approved: str) -> DataFrame:
    """One row for a parcel: largest measures, text of the largest area, best status row, earliest approval."""
    return df.groupBy(key).agg(
        *[F.max(m).alias(f"max_{m}") for m in measures],
        F.max_by(text, F.struct(F.col(area), -F.col(order))).alias("main_text"),
        F.min_by(F.struct(rank.alias("rank"), F.col(order).alias("evidence")), F.struct(rank, F.col(order))).alias("best"),
        F.min(approved).alias("first_approved"),
        F.count(F.lit(1)).alias("rows"),
    ).select(key, *[f"max_{m}" for m in measures], "main_text", F.col("best.rank").alias("best_rank"), F.col("best.evidence").alias("best_evidence"), "first_approved", "rows")


def rollup_events(df: DataFrame, day: str, time: str, ident: str, codes: str, names: str, year: str) -> DataFrame:
    """One row for each (date, time); records without a date stay apart, by their id."""
    own = F.when(F.col(day).isNull(), F.col(ident))
    return df.groupBy(day, time, own.alias("undated_id")).agg(
        F.count(F.lit(1)).alias("polygons"),
        F.array_join(F.array_sort(F.collect_set(codes)), ";").alias("codes"),
        F.array_join(F.array_sort(F.collect_set(names)), " | ").alias("names"),
        F.min(year).alias("first_year"),
    )


def value_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column).limit(n)


def ratio_of_sums(df: DataFrame, keys: Sequence[str], top: str, bottom: str) -> DataFrame:
    out = df.groupBy(*keys).agg(F.sum(top).alias("top"), F.sum(bottom).alias("bottom"))
    return out.where("bottom > 0").select(*keys, (F.col("top") / F.col("bottom")).alias("ratio"))


def centroids(df: DataFrame, code: str, lon: str, lat: str, tm: geo.Tm = geo.TM_5179) -> DataFrame:
    """Mean place of each all-digit code, taken in grid metres."""
    xy = df.where(F.rlike(code, F.lit(r"^\d+$"))).withColumn("_xy", geo.to_tm(F.col(lon), F.col(lat), tm))
    mean = xy.groupBy(code).agg(F.avg("_xy.x").alias("x"), F.avg("_xy.y").alias("y"), F.count(F.lit(1)).alias("rows"))
    return mean.withColumn("_ll", geo.from_tm(F.col("x"), F.col("y"), tm)).select(code, F.col("_ll.lon").alias("lon"), F.col("_ll.lat").alias("lat"), "rows")


def dry_events(df: DataFrame, event: str, flooded: Column, rain: str, share: float = 0.5, dry_mm: float = 1.0) -> DataFrame:
    """Events of whose flooded rows at least ``share`` have less rain than ``dry_mm``."""
    dry = F.avg(F.when(flooded, F.when(F.col(rain) < dry_mm, 1.0).otherwise(0.0)))
    return df.groupBy(event).agg(dry.alias("dry_share")).where(F.col("dry_share") >= share).select(event)


def drop_dry_events(df: DataFrame, event: str, flooded: Column, rain: str, share: float = 0.5, dry_mm: float = 1.0) -> DataFrame:
    return df.join(dry_events(df, event, flooded, rain, share, dry_mm), event, "left_anti")


def bin_of(c: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open bin [edges[i], edges[i+1]) of a value, else NULL; no join."""
    out = F.when(c.isNull() | (c < edges[0]), None)
    for i in range(len(edges) - 1):
        out = out.when(c < edges[i + 1], i)
    return out


def rate_table(df: DataFrame, flooded: Column, bins: dict[str, tuple[str, Sequence[float]]], least_cells: int) -> DataFrame:
    """Flood rate for each combination of bins (name -> column, edges), where there are enough cells."""
    binned = df.select(*[bin_of(F.col(c), e).alias(name) for name, (c, e) in bins.items()], F.when(flooded, 1.0).otherwise(0.0).alias("_y"))
    for name in bins:
        binned = binned.where(F.col(name).isNotNull())
    rates = binned.groupBy(*bins).agg(F.count(F.lit(1)).alias("cells"), F.avg("_y").alias("rate"))
    return rates.where(F.col("cells") >= least_cells)


def first_crossing(rates: DataFrame, group: str, rain_bin: str, levels: Sequence[float]) -> DataFrame:
    """First rain bin of each group whose rate reaches each level; NULL if none does."""
    return rates.groupBy(group).agg(*[F.min(F.when(F.col("rate") >= lv, F.col(rain_bin))).alias(f"reach_{round(lv * 100)}") for lv in levels])


def decile_rates(df: DataFrame, score: str, ident: str, flooded: Column, weight: str, parts: int = 10) -> DataFrame:
    """Weighted flood rate of equal-count parts of a column's own distribution; the rest joins the last.

    Places in the order come from range partitions, so the order takes no single task.
    """
    placed, rows = global_rank(df.where(F.col(score).isNotNull()), [F.col(score), F.col(ident)], "_place")
    size = max(1, rows // parts)
    part = F.least(F.floor(F.col("_place") / size), F.lit(parts - 1))
    hit = F.when(flooded, F.col(weight)).otherwise(0.0)
    return placed.groupBy(part.alias("decile")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(score).alias("low"), F.max(score).alias("high"), (F.sum(hit) / F.sum(weight)).alias("rate")
    )


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> tuple[DataFrame, int]:
    """``df`` with each row's place (from 0) in a total order, and the number of rows."""
    placed = stored(running(df, order, {name: F.lit(1).cast("long")}))
    return placed.withColumn(name, F.col(name) - 1), placed.count()


def cell_sum(df: DataFrame, row: str, col: str, area: str, cell_area: float, largest: float) -> DataFrame:
    """Count and area of the pieces of each cell; oversize pieces are left out, the share is 0 to 1."""
    kept = df.where(F.col(area) <= largest)
    out = kept.groupBy(row, col).agg(F.count(F.lit(1)).alias("pieces"), F.sum(area).alias("area"))
    return out.withColumn("share", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("area") / cell_area)))


def block_fraction(cells: DataFrame, k: int, inside: Column) -> DataFrame:
    """Share of each k x k block's cells for which ``inside`` holds."""
    block = lambda c: F.floor(F.col(c) / k).alias(f"block_{c}")
    return cells.groupBy(block("row"), block("col")).agg(F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("fraction"))


def block_max(cells: DataFrame, k: int, value: str) -> DataFrame:
    block = lambda c: F.floor(F.col(c) / k)
    return cells.groupBy(block("row").alias("row"), block("col").alias("col")).agg(F.max(value).alias(value))


def pyramid(cells: DataFrame, value: str, levels: int) -> DataFrame:
    """2 x 2 maxima, level after level; each level is made from the one before."""
    out, now = None, cells.select("row", "col", value)
    for level in range(1, levels + 1):
        now = block_max(now, 2, value)
        labelled = now.withColumn("level", F.lit(level))
        out = labelled if out is None else out.unionByName(labelled)
    return out


def max_depth(cells: DataFrame, depth: str) -> DataFrame:
    return cells.groupBy("row", "col").agg(F.max(depth).alias(depth))


def zonal(df: DataFrame, keys: Sequence[str], score: str, rain: str, built: str, cuts: Sequence[float] = (0.05, 0.10)) -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.max(score).alias("score_max"),
        F.avg(score).alias("score_mean"),
        *[F.avg(F.when(F.col(score) >= c, 1.0).otherwise(0.0)).alias(f"over_{round(c * 100)}") for c in cuts],
        F.max(rain).alias("rain_max"),
        F.avg(rain).alias("rain_mean"),
        F.avg(built).alias("built_mean"),
        F.count(F.lit(1)).alias("n"),
    )
    return with_quantile(out, df, keys, score, 0.99, "score_p99")


def band_cutoffs(df: DataFrame, score: str, percentiles: dict[str, float], triggers: dict[str, str]) -> DataFrame:
    """A row for each band: its least score and the rain that triggers it. NULL scores don't count."""
    names = list(percentiles)
    cuts = quantiles(df, score, [percentiles[n] for n in names]).select(F.col("q").alias("_cuts"))
    rows = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(percentiles[n]).alias("percentile"), F.lit(triggers[n]).alias("rain_trigger"), F.lit(i).alias("i")) for i, n in enumerate(names)])
    return cuts.withColumn("_r", F.explode(rows)).select("_r.level", "_r.percentile", "_r.rain_trigger", F.element_at("_cuts", F.col("_r.i") + 1).alias("min_score"))


def paint_share(level: float) -> float:
    """Share of the map that a rain level paints."""
    return min(0.02 + level / 150.0 * 0.28, 0.30)


def paint(df: DataFrame, score: str, level: str, levels: Sequence[float]) -> DataFrame:
    """Class 0 to 4 of each row by its level's own quantiles."""
    parts = (1, 2, 4, 10)
    shares = [1 - paint_share(lv) / d for lv in levels for d in parts]
    found = quantiles(df.where(F.col(level).isin(*levels)), score, shares, level)
    own = F.coalesce(*[F.when(F.col(level) == lv, F.slice("q", 1 + i * len(parts), len(parts))) for i, lv in enumerate(levels)])
    cuts = F.broadcast(found.select(F.col(level).alias("_level"), own.alias("_cuts")))  # a row a level
    over = lambda i: F.when(F.col(score) >= F.element_at("_cuts", i), 1).otherwise(0)
    return df.join(cuts, F.col(level) == F.col("_level")).withColumn("paint", over(1) + over(2) + over(3) + over(4)).drop("_cuts", "_level")


def expected_counts(samples: DataFrame, population: DataFrame, use: str, hit: Column, least: int = 50) -> DataFrame:
    """Confirmed rate of each use with enough samples, times the number of buildings of that use."""
    rates = samples.groupBy(use).agg(F.count(F.lit(1)).alias("samples"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("rate")).where(F.col("samples") >= least)
    counts = population.groupBy(use).agg(F.count(F.lit(1)).alias("buildings"))
    return counts.join(rates, use, "left").select(use, "buildings", "samples", "rate", (F.col("buildings") * F.col("rate")).alias("expected"))


def national_rollup(df: DataFrame, province: str, flag: Column, measure: str) -> DataFrame:
    """Province rows and the national total (province NULL, is_total 1)."""
    return df.rollup(province).agg(
        F.grouping(province).cast("int").alias("is_total"), F.count(F.lit(1)).alias("rows"), F.sum(F.when(flag, 1).otherwise(0)).alias("flagged"), F.avg(measure).alias("mean")
    )


def use_by_depth(df: DataFrame, use: str, depth: str) -> DataFrame:
    """Counts by use and depth with both margins."""
    return df.cube(use, depth).agg(F.grouping_id().cast("long").alias("grouping"), F.count(F.lit(1)).alias("rows"))


def timeline(df: DataFrame, key: str, status: str) -> DataFrame:
    counted = lambda v: F.sum(F.when(F.col(status) == v, 1).otherwise(0)).alias(v.lower())
    return df.groupBy(key).agg(counted("YES"), counted("PARTIAL"), counted("NO"), counted("UNKNOWN"))


def compare_cols(df: DataFrame, a: str, b: str) -> DataFrame:
    """How two columns agree, over rows where both are known."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    gap = F.abs(F.col(a) - F.col(b))
    median = lambda c: F.broadcast(quantiles(known, c, [0.5]).select(F.get("q", F.lit(0)).alias(f"_{c}")))  # noqa: E731  one row
    sums = known.agg(F.count(F.lit(1)).alias("rows"), F.corr(a, b).alias("r"), F.max(gap).alias("gap_max"), F.avg(gap).alias("gap_mean"))
    return sums.crossJoin(median(a)).crossJoin(median(b)).select("rows", "r", F.col(f"_{a}").alias("median_a"), F.col(f"_{b}").alias("median_b"), "gap_max", "gap_mean")


def compare_layers(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Share of equal cells, quantiles of both versions of a layer and the largest gap."""
    both = stored(a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys)))
    out = both.agg(
        F.count(F.lit(1)).alias("cells"),
        F.avg(F.when(F.col("_a") == F.col("_b"), 100.0).otherwise(0.0)).alias("equal_pct"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("gap_max"),
    )
    for side in ("a", "b"):
        out = out.crossJoin(F.broadcast(quantiles(both, f"_{side}", shares).select(F.col("q").alias(f"_q{side}"))))  # one row
    named = [F.get(f"_q{side}", F.lit(i)).alias(f"{side}_q{round(q * 100)}") for i, q in enumerate(shares) for side in ("a", "b")]
    return out.select("cells", "equal_pct", *named, "gap_max")


def median_fill(df: DataFrame, column: str, fit_on: Column | None = None) -> DataFrame:
    """Missing values of a column get its median (over the rows ``fit_on`` holds for, if given)."""
    fitted = df.where(fit_on) if fit_on is not None else df
    median = F.broadcast(quantiles(fitted, column, [0.5]).select(F.get("q", F.lit(0)).alias("_median")))  # one row
    return df.crossJoin(median).withColumn(column, F.coalesce(F.col(column), F.col("_median"))).drop("_median")


def dup_weight(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def inventory(profiles: DataFrame) -> DataFrame:
    """Schema variants over profiled tables (name, schema, rows, crs): how many tables and rows each has."""
    return profiles.groupBy("schema").agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"), F.array_sort(F.collect_set("crs")).alias("crs"))
