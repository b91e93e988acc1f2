"""Queries of the ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import metrics as m
from freshet.plans import fixtures as fx
from freshet.plans.q_rel import DRAW_SQL
from freshet.plans.registration import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("M03_rule_score", fx.sql("census") + ", t as (select id, case when id % 9 = 0 then null else rel end as r from census) select id, -coalesce(r, (select quantile_cont(r, 0.5) from t)) as score from t")
def m03(spark, sf):
    return m.rule_score(fx.census(spark, sf).select("id", F.when(F.col("id") % 9 != 0, F.col("rel")).alias("r")), "r").select("id", "score")


_AP = """g as (select grp, s, sum(case when y = 1 then w else 0 end) as p, sum(w) as w from scores group by 1, 2), r as (select grp, p / sum(p) over (partition by grp) as recall, sum(p) over (partition by grp order by s desc) / sum(w) over (partition by grp order by s desc) as prec from g)"""


@query("M04_avg_precision", fx.sql("scores").replace("source as grp", "(doc_id % 3)::int as grp") + ", " + _AP + " select grp, round(sum(recall * prec), 6) as avg_precision from r group by 1")
def m04(spark, sf):
    return rounded(m.avg_precision(fx.scores(spark, sf).withColumn("grp", (F.col("id") % 3).cast("int")), "y", "s", "w", ["grp"]))


@query("M05_roc_auc", fx.sql("scores") + " select round(sum(a.w * b.w * case when a.s > b.s then 1 when a.s = b.s then 0.5::double else 0 end) / sum(a.w * b.w), 6) as auc from scores a join scores b on a.y = 1 and b.y = 0")
def m05(spark, sf):
    return rounded(m.roc_auc(fx.scores(spark, sf), "y", "s", "w"))


@query(
    "M06_prf",
    fx.sql("scores") + ", t as (select sum((s >= 1500 and y = 1)::int)::double as tp, sum((s >= 1500)::int)::double as said, sum((y = 1)::int)::double as real, count(*) as n from scores) select round(tp / said, 6) as precision, round(tp / real, 6) as recall, round(2 * (tp / said) * (tp / real) / (tp / said + tp / real), 6) as f1, round(real / n, 6) as base_rate from t",
)
def m06(spark, sf):
    return rounded(m.prf(fx.scores(spark, sf), "y", "s", 1500))


@query("M07_capture", fx.sql("scores") + ", t as (select y, row_number() over (order by s desc, id) as r, count(*) over () as n from scores) select f as fraction, round(sum(case when r <= greatest(round_even(n * f, 0), 1) and y = 1 then 1 else 0 end) / sum((y = 1)::int)::double, 6) as captured from t, (values (0.01::double), (0.05), (0.1), (0.2)) as v(f) group by 1")
def m07(spark, sf):
    return rounded(m.capture(fx.scores(spark, sf), "y", "s", ["id"]))


_ARMS = "folds as (select (id % 6)::int as fold, 'a' as arm, avg(y * s) as v from scores group by 1 union all select (id % 6)::int, 'b', avg(y * s) + avg(s2) - 40 from scores group by 1)"


@query(
    "M13_paired",
    fx.sql("scores") + ", " + _ARMS + ", d as (select max(v) filter (arm = 'b') - max(v) filter (arm = 'a') as d from folds group by fold) select count(*) as folds, round(avg(d), 6) as mean, round(stddev_samp(d) / sqrt(count(*)), 6) as se, sum((d > 0)::int)::bigint as wins, case when abs(avg(d)) <= 2 * stddev_samp(d) / sqrt(count(*)) then 'no difference' when avg(d) > 0 then 'better' else 'worse' end as verdict from d",
)
def m13(spark, sf):
    sc = fx.scores(spark, sf).withColumn("fold", (F.col("id") % 6).cast("int"))
    base = sc.groupBy("fold").agg(F.avg(F.col("y") * F.col("s")).alias("a"), (F.avg(F.col("y") * F.col("s")) + F.avg("s2") - 40).alias("b"))
    arms = base.select("fold", F.lit("a").alias("arm"), F.col("a").alias("v")).unionByName(base.select("fold", F.lit("b").alias("arm"), F.col("b").alias("v")))
    return rounded(m.paired(arms, "fold", "arm", "v", "a", "b"))


_REPLICATE_AP = lambda s: f"(select r, sum(p / nullif(tp, 0) * up / uw) as ap from (select r, p, sum(p) over (partition by r order by s desc) as up, sum(w) over (partition by r order by s desc) as uw, sum(p) over (partition by r) as tp from (select r, {s} as s, sum(c * y) as p, sum(c) as w from d where c > 0 group by 1, 2)) group by 1)"


@query(
    "M14_bootstrap",
    fx.sql("scores") + f""", d as (select *, len(list_filter([{', '.join(f'{c!r}::double' for c in m.poisson_steps())}], lambda x: u >= x)) as c from (select *, {DRAW_SQL('r, id')} as u from scores, (select unnest(range(200)) as r))),
      g as (select b.ap - a.ap as g from {_REPLICATE_AP('s')} a join {_REPLICATE_AP('s2')} b using (r))
      select round(avg(g), 6) as mean, round(quantile_cont(g, 0.025), 6) as low, round(quantile_cont(g, 0.975), 6) as high, avg(coalesce(g > 0, false)::int) as wins from g""",
)
def m14(spark, sf):
    out = m.bootstrap_diff(fx.scores(spark, sf), "y", "s", "s2", ["id"], 200)
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "wins")


@query(
    "M15_win_rate",
    fx.sql("scores") + ", p as (select a.id, avg(case when b.s < a.s then 1 when b.s = a.s then 0.5::double else 0 end) as share from scores a join scores b on a.grp = b.grp and a.y = 1 and b.y = 0 group by 1) select count(*) as cases, round(avg(share), 6) as win_rate, round(stddev_samp(share) / sqrt(count(*)), 6) as se from p",
)
def m15(spark, sf):
    return rounded(m.win_rate(fx.scores(spark, sf), "grp", F.col("y") == 1, "s"))


_RIVALS = ("s", "s2", "id")


@query(
    "M15_rivals",
    fx.sql("scores")
    + """, t as (select id, grp, y, unnest(['s', 's2', 'id']) as score, unnest([s, s2, id::double]) as v from scores),
      p as (
        select a.score, a.id, avg(case when b.v < a.v then 1 when b.v = a.v then 0.5::double else 0 end) as share
        from t a join t b on a.score = b.score and a.grp = b.grp and a.y = 1 and b.y = 0 group by 1, 2),
      w as (select score, count(*) as cases, round(avg(share), 6) as win_rate, round(stddev_samp(share) / sqrt(count(*)), 6) as se from p group by 1),
      u as (
        select a.score, round(avg(case when b.v < a.v then 1 when b.v = a.v then 0.5::double else 0 end), 6) as auc
        from t a join t b on a.score = b.score and a.y = 1 and b.y = 0 group by 1)
      select score, cases, win_rate, se, auc from w join u using (score)""",
)
def m15b(spark, sf):
    return rounded(m.rivals(fx.scores(spark, sf).withColumn("id", F.col("id").cast("double")), "grp", F.col("y") == 1, _RIVALS))


@query(
    "M16_hit_eval",
    fx.sql("scores") + """, t as (select 'all' as subset, * from scores union all select 'heavy', * from scores where w > 1 union all select 'odd', * from scores where id % 2 = 1), r as (select *, row_number() over (partition by subset order by s desc, id) as r, count(*) over (partition by subset) as n from t),
      a as (select a.subset, avg(case when a.s > b.s then 1 when a.s = b.s then 0.5::double else 0 end) as auc from t a join t b on a.subset = b.subset and a.y = 1 and b.y = 0 group by 1)
      select r.subset, count(*) as rows, round(avg((y = 1)::int), 6) as base, round(max(auc), 6) as auc, round(avg((y = 1)::int) filter (r <= greatest(floor(n * 0.05), 1)), 6) as precision, round(avg((y = 1)::int) filter (r <= greatest(floor(n * 0.05), 1)) / avg((y = 1)::int), 6) as lift from r join a on a.subset = r.subset group by 1""",
)
def m16(spark, sf):
    subsets = {"all": F.lit(True), "heavy": F.col("w") > 1, "odd": F.col("id") % 2 == 1}
    return rounded(m.hit_eval(fx.scores(spark, sf), "y", "s", ["id"], subsets))


@query(
    "M17_design_table",
    fx.sql("scores") + """, g as (select (id % 4)::varchar as grp, avg(s) filter (y = 1) as a, avg(s2) as b, sum(y)::double as pos, avg(y) * 1000 as base from scores group by 1)
      select grp as row, round(a, 6) as a, round(b, 6) as b from g union all select '~mean', round(avg(a), 6), round(avg(b), 6) from g union all select '~weighted', round(sum(a * pos) / sum(pos), 6), round(sum(b * pos) / sum(pos), 6) from g union all select '~lift', round(avg(a) / avg(base), 6), round(avg(b) / avg(base), 6) from g""",
)
def m17(spark, sf):
    g = fx.scores(spark, sf).groupBy((F.col("id") % 4).alias("grp")).agg(F.avg(F.when(F.col("y") == 1, F.col("s"))).alias("a"), F.avg("s2").alias("b"), F.sum("y").cast("double").alias("pos"), (F.avg("y") * 1000).alias("base"))
    long = g.select("grp", "pos", "base", F.explode(F.array(F.struct(F.lit("a").alias("design"), F.col("a").alias("v")), F.struct(F.lit("b").alias("design"), F.col("b").alias("v")))).alias("r")).select("grp", "pos", "base", "r.*")
    return rounded(m.design_table(long, "grp", "design", "v", "pos", "base", ["a", "b"]))
