"""Places, running sums and quantiles in a total order, by range partitions.

No task gets more than a range partition: rows (or distinct values) are range-partitioned
and written to the shared folder, partition totals (one row each) are summed up, and windows
run inside partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.session import stored

#: Shares up to which quantiles are read off in one aggregate.
FEW_SHARES = 12
#: Groups of over 1 / HEAVY of all rows, which are fewer than HEAVY, are broadcast to them.
HEAVY = 1000


def with_groups(df: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``df`` with the columns of ``groups``, one row for each ``key`` and about ``size`` rows of ``df`` with it; other rows go.

    Groups that hold much of ``df`` are broadcast, whatever the sizes, and the rows of the others
    are shuffled: no task gets a whole heavy group.
    """
    groups = stored(groups.withColumnRenamed(key, "_group"))
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy, same = F.col(size) * HEAVY > total, F.col(key).eqNullSafe(F.col("_group"))
    hot = df.join(F.broadcast(groups.where(heavy)), same).drop("_group")
    light = groups.where(~heavy)
    if light.limit(1).count() == 0:
        return hot
    rest = df.join(F.broadcast(groups.where(heavy).select("_group")), same, "left_anti")
    return hot.unionByName(rest.join(light.hint("shuffle_hash"), same).drop("_group"))


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums up to and with each row in a total order."""
    known = df.withColumns({f"_of_{n}": c for n, c in sums.items()})
    ranged = stored(known.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(F.col("_part").alias("_of_part")).agg(*[F.sum(f"_of_{n}").alias(f"_all_{n}") for n in sums])
    earlier = Window.orderBy("_of_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = totals.select("_of_part", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), F.col("_part") == F.col("_of_part"))
    out = out.withColumns({n: F.coalesce(F.sum(f"_of_{n}").over(inside), F.lit(0)) + F.col(f"_before_{n}") for n in sums})
    return out.drop("_part", "_of_part", *[f"_{k}_{n}" for n in sums for k in ("of", "before")])


def quantiles(df: DataFrame, column: str, shares: Sequence[float], group: str | None = None) -> DataFrame:
    """(group,) n and q, the exact interpolated quantiles of a column's known values; a group without values has no row.

    Distinct values are counted first; of their running counts only the rows at the wanted
    places are kept. Without values and group there is one row with n = 0.
    """
    groups = [group] if group else []
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = running(counts, [*map(F.col, groups), F.col("_v")], {"_upto": F.col("_c")})
    sizes = counts.groupBy(*groups).agg(F.sum("_c").alias("n"))
    starts = upto.groupBy(*groups).agg(F.min(F.col("_upto") - F.col("_c")).alias("_start"), F.count(F.lit(1)).alias("_values"))
    if group:
        known = sizes.withColumnRenamed(group, "_sized").join(starts.hint("shuffle_hash"), F.col(group).eqNullSafe(F.col("_sized"))).drop("_sized")
        placed = with_groups(upto, known, group, "_values")
    else:
        placed = upto.crossJoin(F.broadcast(sizes.crossJoin(F.broadcast(starts))))  # one row each
    last = F.col("_upto") - F.col("_start") - 1  # the value's last place in its group, from 0
    first = last - F.col("_c") + 1
    place = lambda s: (F.col("n") - 1) * F.lit(float(s))
    at = lambda p: F.max(F.when((first <= p) & (p <= last), F.col("_v")))
    if len(shares) > FEW_SHARES:
        return _many_quantiles(placed.withColumns({"_first": first, "_last": last}), shares, groups)
    # a value holds a wanted place or none: at most two rows for each share matter
    row = placed.groupBy(*groups).agg(F.max("n").alias("n"), *[a for i, s in enumerate(shares) for a in (at(F.floor(place(s))).alias(f"_l{i}"), at(F.ceil(place(s))).alias(f"_h{i}"))])
    part = [place(s) - F.floor(place(s)) for s in shares]
    # equal neighbours give their own value, without rounding
    value = [F.when(part[i] == 0, F.col(f"_l{i}")).otherwise(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * part[i]) for i in range(len(shares))]
    return row.select(*groups, F.coalesce("n", F.lit(0)).alias("n"), F.array(*value).alias("q"))


def _many_quantiles(placed: DataFrame, shares: Sequence[float], groups: Sequence[str]) -> DataFrame:
    """As ``quantiles``: the few values that hold a wanted place meet the shares they hold, one row for each."""
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)])
    at = lambda e: (F.col("n") - 1) * e["s"]
    holds = lambda k: (F.col("_first") <= k) & (k <= F.col("_last"))
    mine = placed.select(*groups, "n", "_v", "_first", "_last", F.explode(F.filter(wanted, lambda e: holds(F.floor(at(e))) | holds(F.ceil(at(e))))).alias("_e"))
    place = at(F.col("_e"))
    ends = mine.groupBy(*groups, F.col("_e.i").alias("_i"), F.col("_e.s").alias("_s")).agg(
        F.max("n").alias("n"), F.max(F.when(holds(F.floor(place)), F.col("_v"))).alias("_l"), F.max(F.when(holds(F.ceil(place)), F.col("_v"))).alias("_h")
    )
    part = (F.col("n") - 1) * F.col("_s") - F.floor((F.col("n") - 1) * F.col("_s"))
    value = F.when(part == 0, F.col("_l")).otherwise(F.col("_l") + (F.col("_h") - F.col("_l")) * part)
    row = ends.groupBy(*groups).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), value.alias("v")))).alias("_q"))
    return row.select(*groups, F.coalesce("n", F.lit(0)).alias("n"), F.transform("_q", lambda e: e["v"]).alias("q"))
