"""Ranking metrics over scored rows, by sorted distinct scores. Ties share a score.

Sums over distinct scores come first (partial aggregation), so that the ordered windows
run over distinct scores and not over rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.ordering import quantiles, running
from freshet.operators.relational import draw


def rule_score(df: DataFrame, column: str, name: str = "score") -> DataFrame:
    """A single column as a risk score: negated; missing values score as the median."""
    median = F.broadcast(quantiles(df, column, [0.5]).select(F.get("q", F.lit(0)).alias("_m")))  # one row
    return df.crossJoin(median).withColumn(name, -F.coalesce(F.col(column), F.col("_m"))).drop("_m")


def _by_score(df: DataFrame, y: str, s: str, w: str | None, keys: Sequence[str]) -> DataFrame:
    weight = F.col(w) if w else F.lit(1.0)
    return df.where(F.col(s).isNotNull()).groupBy(*keys, F.col(s).alias("_s")).agg(F.sum(F.when(F.col(y) == 1, weight).otherwise(0.0)).alias("_p"), F.sum(weight).alias("_w"))


def avg_precision(df: DataFrame, y: str, s: str, w: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted average precision: recall steps times precision, scores falling.

    Without keys the running sums go over range partitions of the scores; with keys, over
    the distinct scores of a key.
    """
    scores = _by_score(df, y, s, w, keys)
    if keys:
        run, whole = Window.partitionBy(*keys).orderBy(F.desc("_s")), Window.partitionBy(*keys)
        steps = scores.withColumns({"_up": F.sum("_p").over(run), "_uw": F.sum("_w").over(run), "_all": F.sum("_p").over(whole)})
        return steps.groupBy(*keys).agg(F.sum(F.col("_p") / F.nullif("_all", F.lit(0.0)) * F.col("_up") / F.col("_uw")).alias("avg_precision"))
    steps = running(scores, [F.desc("_s")], {"_up": F.col("_p"), "_uw": F.col("_w")})
    return steps.agg((F.sum(F.col("_p") * F.col("_up") / F.col("_uw")) / F.nullif(F.sum("_p"), F.lit(0.0))).alias("avg_precision"))


def roc_auc(df: DataFrame, y: str, s: str, w: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted ROC area: pairs of a positive above a negative, ties half. Keys as in ``avg_precision``."""
    steps = _by_score(df, y, s, w, keys).withColumn("_n", F.col("_w") - F.col("_p"))
    if keys:
        upto = steps.withColumn("_un", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_s")))
    else:
        upto = running(steps, [F.col("_s")], {"_un": F.col("_n")})
    won = upto.withColumn("_won", F.col("_p") * (F.col("_un") - F.col("_n") / 2))
    return won.groupBy(*keys).agg((F.sum("_won") / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0.0))).alias("auc"))


def prf(df: DataFrame, y: str, s: str, threshold: float) -> DataFrame:
    """Precision, recall, F1 and base rate of ``s >= threshold``."""
    said, real = F.col(s) >= threshold, F.col(y) == 1
    n = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    t = df.agg(n(said & real).alias("tp"), n(said).alias("said"), n(real).alias("real"), F.count(F.lit(1)).alias("rows"))
    p, r = F.col("tp") / F.nullif("said", F.lit(0.0)), F.col("tp") / F.nullif("real", F.lit(0.0))
    return t.select(p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"), (F.col("real") / F.col("rows")).alias("base_rate"))


def capture(df: DataFrame, y: str, s: str, ident: Sequence[str], fractions: Sequence[float] = (0.01, 0.05, 0.10, 0.20)) -> DataFrame:
    """(fraction, captured): share of positives in the top part by score; ties by ident."""
    from freshet.operators.aggregates import global_rank

    placed, n = global_rank(df, [F.col(s).desc_nulls_last(), *[F.col(i) for i in ident]], "_place")
    real = F.when(F.col(y) == 1, 1.0).otherwise(0.0)
    shares = placed.agg(*[(F.sum(F.when(F.col("_place") < max(round(n * f), 1), real)) / F.sum(real)).alias(str(f)) for f in fractions])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), F.col(f"`{f}`").alias("captured")) for f in fractions])).alias("r")).select("r.*")


def paired(df: DataFrame, fold: str, arm: str, value: str, a: str, b: str) -> DataFrame:
    """Mean difference b - a over folds with its standard error, wins, and a verdict at two errors."""
    both = df.groupBy(fold).agg(F.max(F.when(F.col(arm) == a, F.col(value))).alias("_a"), F.max(F.when(F.col(arm) == b, F.col(value))).alias("_b")).where("_a is not null and _b is not null")
    gap = F.col("_b") - F.col("_a")
    out = both.agg(F.count(F.lit(1)).alias("folds"), F.avg(gap).alias("mean"), (F.stddev_samp(gap) / F.sqrt(F.count(F.lit(1)))).alias("se"), F.sum(F.when(gap > 0, 1).otherwise(0)).alias("wins"))
    return out.withColumn("verdict", F.when(F.abs("mean") <= 2 * F.col("se"), "no difference").when(F.col("mean") > 0, "better").otherwise("worse"))


def poisson_steps(mean: float = 1.0) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... events, until a double holds no more."""
    term, steps = math.exp(-mean), []
    while not steps or (1.0 - steps[-1] > 1e-15 and term > 1e-17):
        steps.append((steps[-1] if steps else 0.0) + term)
        term *= mean / len(steps)
    return steps


def bootstrap_diff(df: DataFrame, y: str, a: str, b: str, ident: Sequence[str], replicates: int = 200, seed: int = 0) -> DataFrame:
    """Difference of two scores' average precision over Poisson bootstrap replicates.

    Each row draws its number of copies in each replicate from a hash, once for both scores. The
    rows are spread over all tasks first: they are few bytes, and many once they are drawn.
    The percentiles are over one row for each replicate.
    """
    rows = df.select(F.col(y).alias("_y"), F.struct(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).alias("_both"), *ident)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    reps = rows.repartition(tasks).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    # a generator keeps the draw as a column: else it is drawn again for each step that it is compared with
    drawn = reps.select("_r", "_y", "_both", F.explode(F.array(draw("_r", *ident, seed=seed))).alias("_u")).where(F.col("_u") >= poisson_steps()[0])
    copies = reduce(Column.__add__, [(F.col("_u") >= c).cast("double") for c in poisson_steps()])
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), F.col(f"_both.{n}").alias("s")) for n in ("_a", "_b")]))
    scored = drawn.select("_r", "_y", copies.alias("_copies"), arms.alias("_e")).select("_r", "_y", "_copies", "_e.*")
    each = avg_precision(scored, "_y", "s", "_copies", ["_r", "arm"])
    pick = lambda n: F.max(F.when(F.col("arm") == n, F.col("avg_precision")))
    held = lambda n: F.max(F.col("arm") == n)
    gap = each.groupBy("_r").agg((pick("_b") - pick("_a")).alias("_g"), (held("_a") & held("_b")).alias("_held")).where("_held")
    return gap.agg(F.avg("_g").alias("mean"), F.percentile("_g", F.lit(0.025)).alias("low"), F.percentile("_g", F.lit(0.975)).alias("high"), F.avg(F.when(F.col("_g") > 0, 1.0).otherwise(0.0)).alias("wins"))


def win_rate(df: DataFrame, group: str, case: Column, score: str) -> DataFrame:
    """Mean share of its group's controls that each case outscores (ties half), with standard error.

    Counts of distinct scores in each group replace the pairs.
    """
    counts = df.groupBy(group, F.col(score).alias("_s")).agg(F.sum(F.when(case, 1.0).otherwise(0.0)).alias("_c"), F.sum(F.when(case, 0.0).otherwise(1.0)).alias("_k"))
    below = Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    share = (F.coalesce(F.sum("_k").over(below), F.lit(0.0)) + F.col("_k") / 2) / F.nullif(F.sum("_k").over(whole), F.lit(0.0))
    won = counts.withColumn("_share", share).where("_c > 0 and _share is not null")
    n, mean = F.sum("_c"), F.sum(F.col("_c") * F.col("_share")) / F.sum("_c")
    var = (F.sum(F.col("_c") * F.col("_share") * F.col("_share")) - n * mean * mean) / (n - 1)
    return won.agg(n.cast("long").alias("cases"), mean.alias("win_rate"), F.sqrt(F.greatest(var, F.lit(0.0)) / n).alias("se"))


def rivals(df: DataFrame, group: str, case: Column, scores: Sequence[str]) -> DataFrame:
    """(score, cases, win_rate, se, auc): each score by its win rate within groups, and its area over all rows together."""
    y = df.withColumn("_y", F.when(case, 1).otherwise(0))
    out = None
    for s in scores:
        one = F.broadcast(win_rate(df, group, case, s)).crossJoin(F.broadcast(roc_auc(y, "_y", s)))  # one row each
        one = one.select(F.lit(s).alias("score"), "cases", "win_rate", "se", "auc")
        out = one if out is None else out.unionByName(one)
    return out


def hit_eval(df: DataFrame, y: str, s: str, ident: Sequence[str], subsets: dict[str, Column], f: float = 0.05) -> DataFrame:
    """(subset, rows, base, auc, precision, lift): a score against hits, for each subset."""
    from freshet.operators.relational import top_fraction

    out = None
    for name, keep in subsets.items():
        part = df.where(keep)
        base = part.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.when(F.col(y) == 1, 1.0).otherwise(0.0)).alias("base"))
        top = top_fraction(part, s, ident, f, floor=True).agg(F.avg(F.when(F.col(y) == 1, 1.0).otherwise(0.0)).alias("precision"))
        row = F.broadcast(base).crossJoin(F.broadcast(roc_auc(part, y, s))).crossJoin(F.broadcast(top))  # one row each
        row = row.select(F.lit(name).alias("subset"), "rows", "base", "auc", "precision", (F.col("precision") / F.nullif("base", F.lit(0.0))).alias("lift"))
        out = row if out is None else out.unionByName(row)
    return out


def design_table(df: DataFrame, group: str, design: str, value: str, positives: str, base: str, designs: Sequence[str]) -> DataFrame:
    """A column for each design: per-group scores, then simple and positives-weighted mean and lift."""
    wide = df.groupBy(group).pivot(design, list(designs)).agg(F.max(value))
    means = df.groupBy(design).agg(F.avg(value).alias("mean"), (F.sum(F.col(value) * F.col(positives)) / F.sum(positives)).alias("weighted"), (F.avg(value) / F.avg(base)).alias("lift"))
    rows = F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in ("mean", "weighted", "lift")])
    below = means.withColumn("_r", F.explode(rows)).groupBy(F.col("_r.k").alias("k")).pivot(design, list(designs)).agg(F.max("_r.v"))
    return wide.select(F.col(group).cast("string").alias("row"), *designs).unionByName(below.select(F.concat(F.lit("~"), "k").alias("row"), *designs))


def importance_share(models: DataFrame, feature: str = "feature", value: str = "importance") -> DataFrame:
    """Share in percent of each feature, over the folds' models."""
    total = models.groupBy(feature).agg(F.sum(value).alias("_v"))
    return total.withColumn("share", F.col("_v") * 100 / F.sum("_v").over(Window.partitionBy(F.lit(1)))).select(feature, "share")
