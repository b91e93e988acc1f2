"""Boosted-tree risk models on MLlib, and honest evaluation by held-out groups.

MLlib trees take no missing values: features are filled with training medians and get a
missing flag. Groups (storms, provinces) are listed once; each held-out fit is a Spark job.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.risk import calibrate
from freshet.operators import metrics
from freshet.operators.ordering import quantiles, running, with_groups
from freshet.session import stored

#: Bins of a feature that a tree looks at, MLlib's own number.
BINS = 32

Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


class Filled:
    """Medians of the training rows; fills missing values and flags them."""

    def __init__(self, df: DataFrame, features: Sequence[str]):
        # one pass and one order for all features
        stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("v")) for c in features]))
        found = {r["f"]: r["q"][0] for r in quantiles(df.select(stacked.alias("_s")).select("_s.f", "_s.v"), "v", [0.5], group="f").collect()}  # a row for each feature
        self.medians = {c: found.get(c, 0.0) for c in features}
        self.columns = [*(f"_f_{c}" for c in features), *(f"_m_{c}" for c in features)]

    def __call__(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, m in self.medians.items():
            missing = F.col(c).isNull() | F.isnan(c)
            new[f"_f_{c}"] = F.when(missing, F.lit(float(m))).otherwise(F.col(c).cast("double"))
            new[f"_m_{c}"] = F.when(missing, 1.0).otherwise(0.0)
        return df.withColumns(new)


def fit_gbt(df: DataFrame, features: Sequence[str], label: str = "y", weight: str | None = None, trees: int = 10, depth: int = 4, seed: int = 7) -> Callable[[DataFrame], DataFrame]:
    """A scorer: adds ``score``, the probability of label 1, from trees fitted with balanced classes.

    Positives weigh negatives / positives times their sample weight.
    """
    fill = Filled(df, features)
    pos, n = df.agg(F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)), F.count(F.lit(1))).first()
    own = F.col(weight) if weight else F.lit(1.0)
    ratio = (n - pos) / pos if pos else 1.0
    rows = fill(df).withColumn("_w", F.when(F.col(label) == 1, own * ratio).otherwise(own)).withColumn("_y", F.col(label).cast("double"))
    model = _boosted(rows, fill.columns, trees, depth, seed)

    def score(other: DataFrame) -> DataFrame:
        out = model.transform(fill(other))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction", *fill.columns)

    score.model, score.features, score.ratio, score.fill = model, list(features), ratio, fill
    return score


def _boosted(rows: DataFrame, columns: Sequence[str], trees: int, depth: int, seed: int) -> PipelineModel:
    """Trees fitted on the ``columns`` of rows with a label ``_y`` and a weight ``_w``."""
    stages = [VectorAssembler(inputCols=columns, outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=trees, maxDepth=depth, maxBins=BINS, seed=seed, subsamplingRate=1.0)]
    return Pipeline(stages=stages).fit(rows)


def staged(score: Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame:
    """``df`` with ``stages``: the scores after 1, 2, ... trees of one fitted scorer, as running sums over its trees."""
    assembler, boosted = score.model.stages
    out, margin, stages = assembler.transform(score.fill(df)), F.lit(0.0), []
    for i, (tree, weight) in enumerate(zip(boosted.trees, boosted.treeWeights, strict=True)):
        out = tree.setFeaturesCol("_x").setPredictionCol(f"_t{i}").transform(out)
        margin = margin + F.col(f"_t{i}") * float(weight)
        stages.append(1 / (1 + F.exp(-2 * margin)))
    return out.withColumn("stages", F.array(*stages)).select(*df.columns, "stages")


def _by_trees(score: Callable[[DataFrame], DataFrame], df: DataFrame, label: str) -> DataFrame:
    rows = staged(score, df).select(F.col(label).alias("y"), F.posexplode("stages").alias("_i", "score"))
    return metrics.avg_precision(rows.select("y", "score", (F.col("_i") + 1).alias("trees")), "y", "score", keys=["trees"])


def score_grid(score: Callable[[DataFrame], DataFrame], cells: DataFrame, levels: Sequence[float], cap: float = 40.0) -> DataFrame:
    """Cells x rain levels scored: each distinct effective level once, then joined to the levels."""
    effective = sorted({min(lv, cap) for lv in levels})
    grid = cells.withColumn("rain", F.explode(F.array(*[F.lit(float(e)) for e in effective])))
    scored = score(grid).withColumn("p", calibrate(F.col("score"), score.ratio))
    of = F.filter(F.array(*[F.lit(float(lv)) for lv in levels]), lambda lv: F.least(lv, F.lit(cap)) == F.col("rain"))
    return scored.withColumn("level", F.explode(of))


def groups_of(df: DataFrame, group: str, label: str, least: int) -> list:
    """Groups with at least ``least`` rows of each class; rows without a group are in none."""
    n = lambda v: F.sum(F.when(F.col(label) == v, 1).otherwise(0))
    both = df.where(F.col(group).isNotNull()).groupBy(group).agg(n(1).alias("p"), n(0).alias("n")).where((F.col("p") >= least) & (F.col("n") >= least))
    return [r[0] for r in both.orderBy(group).collect()]  # a row a storm or province


def logo(df: DataFrame, group: str, fit: Fit, label: str = "y", least: int = 1) -> DataFrame:
    """Every scorable group's rows, scored by a model that never saw the group."""
    parts = [fit(df.where(F.col(group) != g))(df.where(F.col(group) == g)) for g in groups_of(df, group, label, least)]
    return reduce(DataFrame.unionByName, parts)


def _known(c: str) -> Column:
    """A feature as a double, NULL where it is missing."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _bounds_without(df: DataFrame, group: str, ids: Sequence, features: Sequence[str]) -> list[dict[str, tuple[list[float], float]]]:
    """For each group, the bounds and the median of each feature over the rows of all other groups.

    Bounds are the values where a bin begins: every value where there are at most ``BINS``, else
    those at equal shares of the rows. One count of the values and one order serve all groups.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), _known(c).alias("v")) for i, c in enumerate(features)]))
    rows = df.where(F.col(group).isNotNull()).select(group, stacked.alias("_s")).select(group, "_s.f", "_s.v").where("v is not null")
    values = rows.groupBy("f", "v").agg(*[F.sum(F.when(F.col(group) != g, 1).otherwise(0)).alias(f"_n{k}") for k, g in enumerate(ids)])
    upto = stored(running(values, [F.col("f"), F.col("v")], {f"_u{k}": F.col(f"_n{k}") for k in range(len(ids))}))
    told = [a for k in range(len(ids)) for a in (F.min(F.col(f"_u{k}") - F.col(f"_n{k}")).alias(f"_start{k}"), F.max(f"_u{k}").alias(f"_end{k}"), F.sum(F.when(F.col(f"_n{k}") > 0, 1).otherwise(0)).alias(f"_values{k}"))]
    placed = upto.join(F.broadcast(upto.groupBy(F.col("f").alias("_f")).agg(*told)), F.col("f") == F.col("_f"))  # a row for each feature
    flags = {}
    for k in range(len(ids)):
        n, first, last = F.col(f"_end{k}") - F.col(f"_start{k}"), F.col(f"_u{k}") - F.col(f"_n{k}") - F.col(f"_start{k}"), F.col(f"_u{k}") - F.col(f"_start{k}")
        here = F.col(f"_n{k}") > 0
        # the first part that begins at this value's first place or after it
        part = F.greatest(F.floor((first * BINS + n - 1) / n), F.lit(1))
        flags[f"_bound{k}"] = here & ((F.col(f"_values{k}") <= BINS) | (part < BINS) & (F.floor(part * n / BINS) < last))
        holds = lambda at, here=here, first=first, last=last: here & (first <= at) & (at < last)
        flags[f"_low{k}"], flags[f"_high{k}"] = holds(F.floor((n - 1) / 2)), holds(F.floor(n / 2))
    wanted = reduce(Column.__or__, map(F.col, flags))
    found = placed.withColumns(flags).where(wanted).select("f", "v", *flags).collect()  # BINS + 2 rows at most for each group and feature
    out = []
    for k in range(len(ids)):
        mine = {}
        for i, c in enumerate(features):
            low, high = ([r["v"] for r in found if r["f"] == i and r[f"_{n}{k}"]] for n in ("low", "high"))
            mine[c] = sorted(r["v"] for r in found if r["f"] == i and r[f"_bound{k}"]), (low[0] + (high[0] - low[0]) * 0.5 if low else 0.0)
        out.append(mine)
    return out


def logo_precision(df: DataFrame, group: str, features: Sequence[str], label: str = "y", least: int = 1, trees: int = 10, depth: int = 4, seed: int = 7) -> DataFrame:
    """(group, avg_precision) of every scorable group, by a model that never saw the group.

    As ``evaluate`` of ``logo`` with ``fit_gbt``, in a few passes over the rows whatever the number
    of groups: rows are counted by group, label and cell, where a cell lies between two bounds
    of any model's bins. Each model's bins and medians come from its own training rows, and
    are whole cells; so it is fitted and scored on counted cells, which few features keep few.
    """
    ids = groups_of(df, group, label, least)
    bins = _bounds_without(df, group, ids, features)
    cuts = {c: sorted({b for mine in bins for b in mine[c][0]}) for c in features}
    rows = df.where(F.col(group).isNotNull()).select(group, F.col(label).cast("double").alias("_y"), *[F.coalesce(_known(c), F.lit(math.nan)).alias(f"_v_{c}") for c in features])
    split = [c for c in features if cuts[c]]  # the others have no value
    if split:
        ends = [[-math.inf, *cuts[c], math.inf] for c in split]
        rows = Bucketizer(splitsArray=ends, inputCols=[f"_v_{c}" for c in split], outputCols=[f"_c_{c}" for c in split], handleInvalid="keep").transform(rows)
    cell = lambda c: (F.col(f"_c_{c}") if c in split else F.lit(1)).cast("int").alias(f"_c_{c}")  # noqa: E731  missing values come last
    cells = stored(rows.select(group, "_y", *[cell(c) for c in features]).groupBy(group, "_y", *[f"_c_{c}" for c in features]).agg(F.count(F.lit(1)).alias("_rows")))
    columns = [*(f"_f_{c}" for c in features), *(f"_m_{c}" for c in features)]
    parts = []
    for g, mine in zip(ids, bins, strict=True):
        new = {}
        for c in features:
            bounds, median = mine[c]
            places = [*(bisect_right(bounds, low) for low in (-math.inf, *cuts[c])), bisect_right(bounds, median)]
            new[f"_f_{c}"] = F.element_at(F.array(*[F.lit(float(b)) for b in places]), F.col(f"_c_{c}") + 1)
            new[f"_m_{c}"] = F.when(F.col(f"_c_{c}") == len(cuts[c]) + 1, 1.0).otherwise(0.0)
        counted = lambda part, new=new: part.withColumns(new).groupBy(group, *columns, "_y").agg(F.sum("_rows").cast("double").alias("_rows"))
        train = stored(counted(cells.where(F.col(group) != g).withColumn(group, F.lit(None))))
        pos, n = train.agg(F.sum(F.when(F.col("_y") == 1, F.col("_rows")).otherwise(0.0)), F.sum("_rows")).first()
        weighed = train.withColumn("_w", F.col("_rows") * F.when(F.col("_y") == 1, (n - pos) / pos if pos else 1.0).otherwise(1.0))
        held = _boosted(weighed, columns, trees, depth, seed).transform(counted(cells.where(F.col(group) == g)))
        parts.append(held.select(group, F.col("_y").alias(label), vector_to_array("probability")[1].alias("score"), "_rows"))
    return metrics.avg_precision(reduce(DataFrame.unionByName, parts), label, "score", "_rows", keys=[group])


def _folded(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """``df`` with the fold of each row's group, written once; rows without one go. Few groups hold many rows, so rows stay where they are."""
    sizes = df.groupBy(F.col(group).alias("_of")).agg(F.count(F.lit(1)).alias("_rows"))
    known = folds.select(group, "fold").join(sizes.hint("shuffle_hash"), F.col(group) == F.col("_of")).drop("_of")
    return stored(with_groups(df, known, group, "_rows").drop("_rows"))


def group_cv(df: DataFrame, folds: DataFrame, group: str, fit: Fit) -> DataFrame:
    """Out-of-fold scores; ``folds`` (group, fold) keeps each group in one fold."""
    marked = _folded(df, folds, group)
    ids = [r[0] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    return reduce(DataFrame.unionByName, [fit(marked.where(F.col("fold") != k))(marked.where(F.col("fold") == k)) for k in ids])


def splits(df: DataFrame, kind: str, year: str = "year", ident: Sequence[str] = ("id",), block: Sequence[str] = ("row", "col"), size: int = 10, folds: int = 5) -> DataFrame:
    """``df`` with ``part``: temporal (train to 2018, test from 2019), random 70/30, or spatial block folds."""
    from freshet.operators.relational import draw

    if kind == "temporal":
        part: Column = F.when(F.col(year) <= 2018, "train").otherwise("test")
    elif kind == "random":
        part = F.when(draw(*ident) < 0.7, "train").otherwise("test")
    elif kind == "block":
        blocks = {f"_b_{c}": F.floor(F.col(c) / size) for c in block}
        part = F.floor(draw(*blocks) * folds).cast("string")
        return df.withColumns(blocks).withColumn("part", part).drop(*blocks)
    else:
        raise ValueError(f"unknown split {kind}")
    return df.withColumn("part", part)


def evaluate(scored: DataFrame, fold: str, label: str = "y") -> DataFrame:
    """(fold, avg_precision) of out-of-fold scores."""
    return metrics.avg_precision(scored, label, "score", keys=[fold])


def compare_tables(a: DataFrame, b: DataFrame, test: DataFrame, group: str, folds: DataFrame, fit: Fit) -> DataFrame:
    """Two training tables under one fold map and the same test rows: (fold, arm, avg_precision)."""
    out = []
    ids = [r[0] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    asked = _folded(test, folds, group)
    for arm, df in (("a", a), ("b", b)):
        marked = _folded(df, folds, group)
        out += [fit(marked.where(F.col("fold") != k))(asked.where(F.col("fold") == k)).withColumn("arm", F.lit(arm)) for k in ids]
    return metrics.avg_precision(reduce(DataFrame.unionByName, out), "y", "score", keys=["fold", "arm"])


def ablate(df: DataFrame, sets: dict[str, Sequence[str]], folds: DataFrame, group: str, make: Callable[[Sequence[str]], Fit]) -> DataFrame:
    """(fold, arm, avg_precision) for each named set of features."""
    parts = [evaluate(group_cv(df, folds, group, make(features)), "fold").withColumn("arm", F.lit(name)) for name, features in sets.items()]
    return reduce(DataFrame.unionByName, parts)


def search(df: DataFrame, space: Sequence[dict], screen: DataFrame, confirm: DataFrame, group: str, make: Callable[[dict], Fit], keep: int = 2) -> DataFrame:
    """Settings screened on some folds; the best are confirmed on the others: (setting, stage, avg_precision)."""
    mean = lambda p, folds: evaluate(group_cv(df, folds, group, make(p)), "fold").agg(F.avg("avg_precision")).first()[0]
    screened = sorted(((mean(p, screen), i) for i, p in enumerate(space)), reverse=True)
    confirmed = [(str(space[i]), "confirm", mean(space[i], confirm)) for _, i in screened[:keep]]
    return df.sparkSession.createDataFrame([(str(space[i]), "screen", s) for s, i in screened] + confirmed, "setting string, stage string, avg_precision double")


def curves(df: DataFrame, stop: DataFrame, test: DataFrame, features: Sequence[str], trees: int = 20, depth: int = 4, label: str = "y") -> DataFrame:
    """(trees, stop_precision, avg_precision, chosen) for every number of trees of **one** fit on ``df``.

    The number to stop at is chosen on the rows of another region (``stop``): the best there,
    ties to fewer trees. ``avg_precision`` is that of a third region, which has no part in it.
    """
    score = fit_gbt(df, features, label, trees=trees, depth=depth)
    told = stored(_by_trees(score, stop, label).select(F.col("trees").alias("_trees"), F.col("avg_precision").alias("stop_precision")))
    best = told.agg(F.max_by("_trees", F.struct("stop_precision", -F.col("_trees"))).alias("_best"))
    tested = _by_trees(score, test, label).join(F.broadcast(told), F.col("trees") == F.col("_trees")).crossJoin(F.broadcast(best))  # a row for each tree, and one
    return tested.select("trees", "stop_precision", "avg_precision", (F.col("trees") == F.col("_best")).alias("chosen"))


def storm_curve(df: DataFrame, test: DataFrame, group: str, fit: Fit, counts: Sequence[int], label: str = "y") -> DataFrame:
    """(storms, rows, avg_precision) on ``test`` of fits on ever more storms, in an order by a hash of their ids: each adds to the one before."""
    order = [r[0] for r in df.select(group).distinct().orderBy(F.md5(F.col(group).cast("string")), group).collect()]  # a row a storm
    out = None
    for n in sorted({min(c, len(order)) for c in counts}):
        some = df.where(F.col(group).isin(order[:n]))
        one = F.broadcast(metrics.avg_precision(fit(some)(test), label, "score")).crossJoin(F.broadcast(some.agg(F.count(F.lit(1)).alias("rows"))))  # one row each
        one = one.select(F.lit(n).alias("storms"), "rows", "avg_precision")
        out = one if out is None else out.unionByName(one)
    return out


def importances(scores: Sequence[Callable]) -> DataFrame:
    """(fold, feature, importance) of fitted scorers; a feature's missing flag counts to it."""
    rows = []
    for fold, score in enumerate(scores):
        values = score.model.stages[-1].featureImportances.toArray().tolist()
        n = len(score.features)
        rows += [(fold, f, values[i] + values[n + i]) for i, f in enumerate(score.features)]
    return _frame(rows)


def _frame(rows: list) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().createDataFrame(rows, "fold int, feature string, importance double")


def principal(df: DataFrame, features: Sequence[str], k: int = 12) -> tuple[DataFrame, PipelineModel]:
    """``df`` with pc_0 ... pc_{k-1} of the scaled features."""
    fill = Filled(df, features)
    k = min(k, len(features))
    names = [f"_f_{c}" for c in features]
    stages = [VectorAssembler(inputCols=names, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), PCA(k=k, inputCol="_s", outputCol="_p")]
    model = Pipeline(stages=stages).fit(fill(df))
    out = model.transform(fill(df)).withColumn("_a", vector_to_array("_p"))
    return out.select(*df.columns, *[F.col("_a")[i].alias(f"pc_{i}") for i in range(k)]), model


def top_features(importance: DataFrame, n: int, fold: int = 0) -> list[str]:
    """The most important features of the first fold only, so that test folds don't choose."""
    return [r[0] for r in importance.where(F.col("fold") == fold).orderBy(F.desc("importance"), "feature").limit(n).collect()]


def redundant(df: DataFrame, features: Sequence[str], limit: float = 0.95) -> list[str]:
    """Features that correlate over ``limit`` with an earlier one: one pass over all pairs."""
    pairs = [(a, b) for i, b in enumerate(features) for a in features[:i]]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    drop: list[str] = []
    for (a, b), r in zip(pairs, row, strict=True):
        if r is not None and abs(r) > limit and a not in drop and b not in drop:
            drop.append(b)
    return drop


def ensemble(df: DataFrame, columns: Sequence[str], label: str, tune: Column, rounds: int = 4) -> tuple[list[str], DataFrame]:
    """Greedy forward selection (with replacement) of rank columns on the tuning rows.

    Returns the chosen columns and the other rows with ``score``, their average.
    """
    held = df.where(tune).persist()
    chosen: list[str] = []
    for _ in range(rounds):
        trial = {c: sum((F.col(x) for x in [*chosen, c]), F.lit(0.0)) / (len(chosen) + 1) for c in columns}
        value = {c: metrics.avg_precision(held.withColumn("_s", e), label, "_s").first()[0] for c, e in trial.items()}
        best = max(columns, key=lambda c: value[c])
        if chosen and value[best] <= last:
            break
        chosen.append(best)
        last = value[best]
    held.unpersist()
    return chosen, df.where(~tune).withColumn("score", sum((F.col(x) for x in chosen), F.lit(0.0)) / len(chosen))
