"""Small cases of what was left of the third round's review."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from freshet.operators import hydrology, metrics, relational
from tests.test_hydrology import flooded, terrain


def test_exchange_reads_one_state_and_not_those_of_all_rounds(spark, monkeypatch):
    monkeypatch.setattr(hydrology, "EXCHANGE", 10, raising=False)
    leaves = []
    plain = hydrology.stored
    monkeypatch.setattr(hydrology, "stored", lambda df: leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size()) or plain(df))
    rnd = random.Random(3)
    z = {p: h + rnd.randrange(3) for p, h in terrain("bowl", 4).items()}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double").coalesce(1)
    got = {(r["row"], r["col"]): r["filled"] for r in hydrology.fill(df, "z", 0.5, 5).collect()}
    assert got == pytest.approx(flooded(z, 0.5), abs=1e-7)
    assert len(leaves) > 14 and max(leaves) <= 5


def test_copies_are_drawn_once_for_both_scores(spark):
    df = spark.createDataFrame([(i, i % 3 == 0, float(i % 11), float(i % 7) if i % 5 else None) for i in range(60)], "id long, y boolean, a double, b double").withColumn("y", F.col("y").cast("int"))
    out = metrics.bootstrap_diff(df, "y", "a", "b", ["id"], 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and "lambdafunction" not in plan
    # each replicate as a table of its own
    gaps = []
    for r in range(4):
        u = df.withColumn("_r", F.lit(r)).withColumn("u", relational.draw("_r", "id"))
        c = u.withColumn("c", F.lit(sum((F.col("u") >= s).cast("double") for s in metrics.poisson_steps())))
        one = [metrics.avg_precision(c.where("c > 0"), "y", s, "c").first()[0] for s in ("a", "b")]
        gaps.append(one[1] - one[0])
    row = out.first()
    assert row["mean"] == pytest.approx(sum(gaps) / 4) and row["wins"] == sum(g > 0 for g in gaps) / 4


def test_rows_are_not_shuffled_by_event_to_meet_their_partner(spark):
    df = spark.createDataFrame([(i % 3, i // 3 % 4, float(i)) for i in range(24)] + [(1, None, 6.0)], "e long, p long, v double")
    out = relational.swap_partner(df, "e", "p", "v", 1)
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 2 and "strategy=broadcast" in plan.toString()
    most = {(e, p): max(i for i in range(24) if (i % 3, i // 3 % 4) == (e, p)) for e in range(3) for p in range(4)}
    got = sorted((r["v"], r["swapped"]) for r in out.where("p is not null").collect())
    assert got == [(float(i), float(most[(i + 1) % 3, i // 3 % 4])) for i in range(24)]
    assert [r["swapped"] for r in out.where("p is null").collect()] == [None]
