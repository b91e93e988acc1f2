"""Curves from one fit: stages of its trees, and where to stop."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from freshet.operators import metrics, models


def rows(spark, n: int = 600):
    df = spark.range(n).select("id", (F.col("id") % 5).alias("storm"), (F.col("id") * 7 % 13).cast("double").alias("a"), F.when(F.col("id") % 11 != 0, (F.col("id") * 5 % 17).cast("double")).alias("b"))
    return df.withColumn("y", (F.col("a") * 2 + F.coalesce("b", F.lit(3.0)) + F.col("id") * 31 % 9 > 22).cast("int"))


def test_the_last_stage_is_the_score_and_each_stage_a_sum(spark):
    df = rows(spark)
    score = models.fit_gbt(df.where("storm < 3"), ["a", "b"], trees=4, depth=3)
    both = models.staged(score, df).join(score(df).select(F.col("id").alias("_id"), "score"), F.col("id") == F.col("_id"))
    got = both.select("stages", "score").collect()
    assert all(len(r["stages"]) == 4 and r["stages"][-1] == pytest.approx(r["score"], abs=1e-9) for r in got)
    assert models.staged(score, df).columns == [*df.columns, "stages"]


def test_one_curve_and_its_stop(spark):
    df = rows(spark)
    got = models.curves(df.where("storm < 3"), df.where("storm = 3"), df.where("storm = 4"), ["a", "b"], trees=4, depth=3).orderBy("trees").collect()
    assert [r["trees"] for r in got] == [1, 2, 3, 4]
    best = max(got, key=lambda r: (r["stop_precision"], -r["trees"]))
    assert [r["trees"] for r in got if r["chosen"]] == [best["trees"]]
    score = models.fit_gbt(df.where("storm < 3"), ["a", "b"], trees=4, depth=3)
    whole = metrics.avg_precision(score(df.where("storm = 4")), "y", "score").first()["avg_precision"]
    assert got[-1]["avg_precision"] == pytest.approx(whole, abs=1e-9)


def test_more_storms_add_to_fewer(spark):
    df = rows(spark)
    fit = lambda d: models.fit_gbt(d, ["a", "b"], trees=2, depth=2)
    got = models.storm_curve(df.where("storm < 4"), df.where("storm = 4"), "storm", fit, [1, 3, 9]).orderBy("storms").collect()
    assert [(r["storms"], r["rows"]) for r in got] == [(1, 120), (3, 360), (4, 480)]
    assert all(0 < r["avg_precision"] <= 1 for r in got)
