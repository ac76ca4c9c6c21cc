"""Metric-series queries."""

from pyspark.sql import functions as F

from gridrun.operators import history as H
from gridrun.queries.registry import CTES, query
from gridrun.operators.onerow import with_row

CTES.update({
    "results": """select run, max(metric) as f1, arg_max(metric, epoch) as fg_miou, arg_min(metric, epoch) as road_iou,
  arg_min(metric, abs(epoch-2)) as built_iou, count(*) as runtime from history group by 1""",
    "stab": "select run, round(1.0e0/(1.0e0+stddev_pop(metric)),6) as stability from (select *, row_number() over (partition by run order by epoch desc) r from history) where r<=3 group by 1",
})


def _h(s):
    return H.number_epochs(s.history_rows)


def _results(h):
    return h.groupBy("run").agg(F.max("metric").alias("f1"), F.max_by("metric", "epoch").alias("fg_miou"), F.min_by("metric", "epoch").alias("road_iou"),
                                F.min_by("metric", F.abs(F.col("epoch") - 2)).alias("built_iou"), F.count("*").alias("runtime"))


@query("w03_checkpoint_ranking", """select run, f1, fg_miou, stability, row_number() over (order by f1 desc, fg_miou desc, stability desc, road_iou desc, built_iou desc, runtime, run) as rank
  from results join stab using (run)""")
def w03(s):
    h = _h(s)
    r = _results(h).join(H.stability(h).withColumn("stability", F.round("stability", 6)), "run")
    return H.rank_results(r, ["-f1", "-fg_miou", "-stability", "-road_iou", "-built_iou", "runtime", "run"]).select("run", "f1", "fg_miou", "stability", "rank")


@query("w04_stability", "select * from stab")
def w04(s):
    return H.stability(_h(s)).withColumn("stability", F.round("stability", 6))


@query("w05_first_positive_epoch", "select run, min(epoch) filter (metric>0) as first_positive_epoch, max(metric) as peak_metric from history group by 1")
def w05(s):
    return H.first_and_peak(_h(s))


@query("w06_new_best", "select run, epoch, metric, b as best_before, (b is null or metric>b) as is_best from (select *, max(metric) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) b from history)")
def w06(s):
    return H.new_best(_h(s)).select("run", "epoch", "metric", "best_before", "is_best")


@query("w07_zero_streak", """with g as (select *, epoch - row_number() over (partition by run, metric<=1e-9 order by epoch) as grp from history),
  k as (select run, epoch, case when metric<=1e-9 then row_number() over (partition by run, metric<=1e-9, grp order by epoch) else 0 end as streak from g)
  select run, max(streak) as longest_streak, min(epoch) filter (streak>=3) as stop_epoch from k group by 1""")
def w07(s):
    return H.early_stop(_h(s), 3)


@query("w08_eta", """select run, epoch, round(m+1e-9,6) as mean_time, round(m*(n-epoch)+1e-7,4) as eta from (select run, epoch, avg(metric) over (partition by run order by epoch) as m, count(*) over (partition by run) as n from history)""")
def w08(s):
    h = _h(s)
    e = H.eta(h, h.groupBy("run").agg(F.count("*").alias("total")))
    return e.select("run", "epoch", F.round(F.col("mean_time") + 1e-9, 6).alias("mean_time"), F.round(F.col("eta") + 1e-7, 4).alias("eta"))


@query("w09_moving_average", """, """.join(["""with n as (select run, max(epoch) as n from history group by 1)""",
       """e as (select h.run, h.epoch, h.metric, h.metric as s from history h where epoch=1
  union all select h.run, h.epoch, h.metric, 0.99e0*e.s+0.01e0*h.metric from e join history h on h.run=e.run and h.epoch=e.epoch+1)"""])
       + " select run, round(arg_max(s, epoch),6) as ema from e group by 1")
def w09(s):
    return H.ema(_h(s)).withColumn("ema", F.round("ema", 6))


@query("w14_training_summary", "select run, arg_max(epoch, (metric, -epoch)) as best_epoch, max(metric) as best_metric, arg_max(metric, epoch) as final_metric, max(epoch) as total_epochs from history group by 1")
def w14(s):
    return H.training_summary(_h(s))


@query("t10_architecture_ranking", "select run, f1, row_number() over (order by f1 desc, road_iou desc, fg_miou desc, run) as rank from results")
def t10(s):
    return H.rank_results(_results(_h(s)), ["-f1", "-road_iou", "-fg_miou", "run"]).select("run", "f1", "rank")


@query("t11_best_parent", "select run as best_run, f1 from results order by f1 desc, run limit 1")
def t11(s):
    return _results(_h(s)).orderBy(F.desc("f1"), "run").limit(1).select(F.col("run").alias("best_run"), "f1")


@query("q12_campaign_comparison", """with k as (select *, row_number() over (order by f1 desc, fg_miou desc, stability desc, road_iou desc, built_iou desc, runtime, run) as rank from results join stab using (run))
  select k.run, k.rank, round(k.f1-b.f1,6) as f1_gain, round(k.road_iou-b.road_iou,6) as road_impact, round(k.fg_miou-b.fg_miou,6) as miou_impact from k, k b where b.run=0""")
def q12(s):
    """Ranking plus the gain of every run over the baseline run 0."""
    h = _h(s)
    r = _results(h).join(H.stability(h).withColumn("stability", F.round("stability", 6)), "run")
    k = H.rank_results(r, ["-f1", "-fg_miou", "-stability", "-road_iou", "-built_iou", "runtime", "run"])
    base = r.filter("run = 0").select(F.col("f1").alias("bf"), F.col("road_iou").alias("br"), F.col("fg_miou").alias("bm"))   # one row
    return k.transform(with_row, base).select("run", "rank", F.round(F.col("f1") - F.col("bf"), 6).alias("f1_gain"),
                                            F.round(F.col("road_iou") - F.col("br"), 6).alias("road_impact"),
                                            F.round(F.col("fg_miou") - F.col("bm"), 6).alias("miou_impact"))
