"""Accuracy, confusion and comparison queries."""

from pyspark.sql import functions as F

from gridrun.operators import metrics as M
from gridrun.operators.burn import box_layer
from gridrun.operators.onerow import with_row
from gridrun.operators.runs import decode, run_len, subtract_boxes
from gridrun.queries.registry import query
from gridrun.session import durable


def _cm(s):
    return M.confusion_of(s.paired, s.catalog)


def _counts(s):
    """One row per class, computed once for measures that look at it twice."""
    return durable(M.class_counts(_cm(s), s.classes))


PR = """cast(tp as double)/(gt_pixels+pred_pixels-tp+{e}) as iou, cast(tp as double)/(pred_pixels+{e}) as precision,
  cast(tp as double)/(gt_pixels+{e}) as recall"""


def pr_sql(src="counts", e="1e-10"):
    return f"(select *, 2*precision*recall/(precision+recall+{e}) as f1 from (select *, {PR.format(e=e)} from {src}))"


@query("j05_pred_truth_pixels", """select raster_id, gt, pred, cast(count(*) as bigint) as n,
  cast(sum(row*256+col) as bigint) as pos_sum from both_px group by 1,2,3""", wide=True)
def j05(s):
    seg = s.paired
    return seg.groupBy("raster_id", "gt", "pred").agg(
        F.sum(run_len()).alias("n"),
        F.sum(F.col("row").cast("long") * s.side * run_len()
              + (F.col("c0") + F.col("c1")).cast("long") * run_len() / 2).cast("long").alias("pos_sum"))


@query("j09_false_pixels", """select 'fp' as kind, raster_id, row, col, pred as class_id from both_px where pred>0 and pred<>gt
  union all select 'fn', raster_id, row, col, gt from both_px where gt>0 and pred<>gt""")
def j09(s):
    seg = s.paired.filter("gt <> pred")
    fp = seg.filter("pred > 0").select(F.lit("fp").alias("kind"), "raster_id", "row", "c0", "c1", F.col("pred").alias("class_id"))
    fn = seg.filter("gt > 0").select(F.lit("fn").alias("kind"), "raster_id", "row", "c0", "c1", F.col("gt").alias("class_id"))
    return decode(fp.unionByName(fn))


@query("p16_error_map", """with e as (select raster_id, row, col, case
  when gt>0 and pred=gt then 'tp'
  when gt=0 then 'fp' when pred=0 then 'fn' when pred>gt then 'fp' else 'fn' end as category from both_px)
  select raster_id, category, count(*) as n from e group by 1,2""", wide=True)
def p16(s):
    """Classes are painted 1..4 in turn, truth misses after false hits, so the higher class of the two wins."""
    cat = (F.when(F.col("gt") == F.col("pred"), "tp").when(F.col("pred") > F.col("gt"), "fp").otherwise("fn"))
    return (s.paired.withColumn("category", cat)
            .groupBy("raster_id", "category").agg(F.sum(run_len()).alias("n")))


@query("a03_class_counters", "select class_id, name, tp, gt_pixels, pred_pixels from counts", wide=True)
def a03(s):
    return _counts(s).select("class_id", "name", "tp", "gt_pixels", "pred_pixels")


@query("a04_counts_metrics", f"""with m as {pr_sql()}
  select name, round(iou,6) as iou, round(precision,6) as precision, round(recall,6) as recall, round(f1,6) as f1, gt_pixels,
  round((select avg(iou) from m where class_id>0 and gt_pixels>0),6) as fg_miou from m where class_id>0 and gt_pixels>0""", wide=True)
def a04(s):
    m = M.pr_metrics(_counts(s)).filter("class_id > 0 and gt_pixels > 0")
    mean = m.agg(M.fg_mean().alias("fg_miou"))
    return m.select("name", *[F.round(c, 6).alias(c) for c in ("iou", "precision", "recall", "f1")], "gt_pixels",
                    F.round(mean.scalar(), 6).alias("fg_miou"))


@query("a05_smooth_iou", """with m as (select *, (tp+1e-6)/(gt_pixels+pred_pixels-tp+1e-6) as v from counts where class_id>0)
  select class_id, round(v,6) as iou, round((select coalesce(avg(v),0) from m where gt_pixels+pred_pixels-tp>0),6) as mean_iou from m""", wide=True)
def a05(s):
    m = _counts(s).filter("class_id > 0").withColumn("union", F.expr("gt_pixels + pred_pixels - tp")).withColumn(
        "v", (F.col("tp") + F.lit(1e-6)) / (F.col("union") + F.lit(1e-6)))
    mean = m.agg(M.fg_mean("v", F.col("union") > 0).alias("m"))
    return m.select("class_id", F.round("v", 6).alias("iou"), F.round(mean.scalar(), 6).alias("mean_iou"))


@query("a06_validation_metrics", """with m as (select *, (tp+1e-6)/(gt_pixels+pred_pixels-tp+1e-6) as i,
  (2.0e0*tp+1e-6)/(gt_pixels+pred_pixels+1e-6) as d, case when pred_pixels>0 then cast(tp as double)/pred_pixels else 0.0e0 end as p,
  case when gt_pixels>0 then cast(tp as double)/gt_pixels else 0.0e0 end as r from counts)
  select class_id, round(i,6) as iou, round(d,6) as dice, round(p,6) as precision, round(r,6) as recall,
  round(case when p+r>0 then 2*p*r/(p+r) else 0.0e0 end,6) as f1,
  round((select coalesce(avg(i),0) from m where class_id>0 and gt_pixels>=1),6) as macro_iou,
  round((select coalesce(avg(d),0) from m where class_id>0 and gt_pixels>=1),6) as macro_dice,
  coalesce((select string_agg(name, ',' order by class_id) from m where class_id>0 and gt_pixels<1),'') as excluded from m""", wide=True)
def a06(s):
    m = (_counts(s).withColumn("i", F.expr("(tp+1e-6D)/(gt_pixels+pred_pixels-tp+1e-6D)"))
         .withColumn("d", F.expr("(2D*tp+1e-6D)/(gt_pixels+pred_pixels+1e-6D)"))
         .withColumn("p", F.expr("case when pred_pixels>0 then cast(tp as double)/pred_pixels else 0D end"))
         .withColumn("r", F.expr("case when gt_pixels>0 then cast(tp as double)/gt_pixels else 0D end")))
    # Five rows at most, so the macro values are plain scalar subqueries.
    macro = m.agg(
        M.fg_mean("i").alias("mi"), M.fg_mean("d").alias("md"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            (F.col("class_id") > 0) & (F.col("gt_pixels") < 1), F.struct("class_id", "name")))), lambda x: x["name"]), ",").alias("ex"))
    return m.transform(with_row, macro).select(
        "class_id", F.round("i", 6).alias("iou"), F.round("d", 6).alias("dice"), F.round("p", 6).alias("precision"),
        F.round("r", 6).alias("recall"),
        F.round(F.expr("case when p+r>0 then 2*p*r/(p+r) else 0D end"), 6).alias("f1"),
        F.round("mi", 6).alias("macro_iou"), F.round("md", 6).alias("macro_dice"), F.col("ex").alias("excluded"))


@query("a07_confusion_matrix", "select gt, pred, cast(sum(n) as bigint) as n from conf_counts group by 1,2", wide=True)
def a07(s):
    return _cm(s).groupBy("gt", "pred").agg(F.sum("n").alias("n"))


@query("a07_confusion_pivot", """select gt, """ + ", ".join(
    f"cast(coalesce(sum(n) filter (pred={k}),0) as bigint) as pred_{k}" for k in range(5)) + " from conf_counts group by 1", wide=True)
def a07b(s):
    p = _cm(s).groupBy("gt").pivot("pred", [0, 1, 2, 3, 4]).agg(F.sum("n"))
    return p.select("gt", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"pred_{k}") for k in range(5)])


@query("a08_normalised_confusion", """with c as (select gt, pred, sum(n) as n from conf_counts group by 1,2)
  select g.class_id as gt, p.class_id as pred, round(coalesce(c.n,0)*1.0e0/greatest(coalesce(sum(c.n) over (partition by g.class_id),0),1),6) as share
  from dim_class g cross join dim_class p left join c on c.gt=g.class_id and c.pred=p.class_id""", wide=True)
def a08(s):
    cell = _cm(s).groupBy("gt", "pred").agg(F.sum("n").alias("n"))
    full = s.classes.select(F.col("class_id").alias("gt"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pred"))
    total = cell.groupBy("gt").agg(F.sum("n").alias("t"))
    return full.join(cell, ["gt", "pred"], "left").join(total, "gt", "left").select(
        "gt", "pred", F.round(F.coalesce("n", F.lit(0)) / F.greatest(F.coalesce("t", F.lit(0)), F.lit(1)).cast("double"), 6).alias("share"))


TOPC = """select c.gt, c.pred, g.name as gt_name, p.name as pred_name, cast(c.n as bigint) as pixels, round(100.0e0*c.n/t.n,6) as pct_of_gt
  from (select gt, pred, sum(n) as n from conf_counts group by 1,2) c join (select gt, sum(n) as n from conf_counts group by 1) t on t.gt=c.gt
  join dim_class g on g.class_id=c.gt join dim_class p on p.class_id=c.pred where c.gt>0 and c.gt<>c.pred and c.n>0"""


@query("a09_offdiagonal_confusions", TOPC, wide=True)
def a09(s):
    return M.top_confusions(_cm(s), s.classes).withColumn("pct_of_gt", F.round("pct_of_gt", 6))


@query("t06_top_confusions", TOPC + " order by pixels desc, gt, pred limit 12", wide=True)
def t06(s):
    return M.top_confusions(_cm(s), s.classes, 12).withColumn("pct_of_gt", F.round("pct_of_gt", 6))


@query("w12_percent_of_group", """select gt, pred, round(100.0e0*n/sum(n) over (partition by gt),6) as pct
  from (select gt, pred, sum(n) as n from conf_counts group by 1,2)""", wide=True)
def w12(s):
    from pyspark.sql import Window
    cell = _cm(s).groupBy("gt", "pred").agg(F.sum("n").alias("n"))     # 25 rows
    return cell.select("gt", "pred", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("gt")), 6).alias("pct"))


@query("a10_fn_fp", "select class_id, gt_pixels-tp as false_negatives, pred_pixels-tp as false_positives, gt_pixels, pred_pixels from counts where class_id>0", wide=True)
def a10(s):
    return _counts(s).filter("class_id > 0").selectExpr(
        "class_id", "gt_pixels-tp as false_negatives", "pred_pixels-tp as false_positives", "gt_pixels", "pred_pixels")


@query("a11_accuracy_summary", """select round(sum(tp)*1.0e0/sum(gt_pixels),6) as pixel_accuracy,
  round(sum(tp) filter (class_id>0)*1.0e0/sum(gt_pixels) filter (class_id>0),6) as infrastructure_accuracy,
  round(avg(case when gt_pixels>0 then tp*1.0e0/gt_pixels else 0.0e0 end) filter (class_id>0),6) as mean_detection_rate,
  cast(sum(gt_pixels) as bigint) as total_pixels from counts""", wide=True)
def a11(s):
    fg = F.col("class_id") > 0
    return _counts(s).agg(
        F.round(F.sum("tp") / F.sum("gt_pixels"), 6).alias("pixel_accuracy"),
        F.round(F.sum(F.when(fg, F.col("tp"))) / F.sum(F.when(fg, F.col("gt_pixels"))), 6).alias("infrastructure_accuracy"),
        F.round(F.avg(F.when(fg, F.expr("case when gt_pixels>0 then tp/gt_pixels else 0D end"))), 6).alias("mean_detection_rate"),
        F.sum("gt_pixels").alias("total_pixels"))


@query("a12_matrix_metrics", f"""with m as {pr_sql(e='1e-9')} select class_id, round(iou,6) as iou, round(precision,6) as precision,
  round(recall,6) as recall, round(f1,6) as f1, round((select avg(iou) from m where class_id>0),6) as fg_miou from m where class_id>0""", wide=True)
def a12(s):
    m = M.pr_metrics(_counts(s), 1e-9).filter("class_id > 0")
    return m.select("class_id", *[F.round(c, 6).alias(c) for c in ("iou", "precision", "recall", "f1")],
                    F.round(m.agg(F.avg("iou").alias("m")).scalar(), 6).alias("fg_miou"))


@query("a55_failure_modes", """select *, as_background+as_road+as_built_up+as_water as missed,
  round((as_background+as_road+as_built_up+as_water)*1.0e0/greatest(as_background+as_road+as_built_up+as_water+as_bridge,1),6) as hard_case_ratio from (select
  """ + ", ".join(f"cast(coalesce(sum(n) filter (gt=2 and pred={k}),0) as bigint) as {n}" for k, n in enumerate(
    ["as_background", "as_road", "as_bridge", "as_built_up", "as_water"])) + " from conf_counts)", wide=True)
def a55(s):
    return M.failure_modes(_cm(s)).withColumn("hard_case_ratio", F.round("hard_case_ratio", 6))


@query("p32_class_health", f"""with m as {pr_sql()} select name, case when gt_pixels=0 then 'absent' when iou<0.1 then 'critical'
  when iou<0.3 then 'weak' when recall<0.3 then 'low_recall' when precision<0.3 then 'low_precision' else 'ok' end as health,
  case when gt_pixels=0 then 'n/a' when pred_pixels*1.0e0/gt_pixels>2.0 then 'over' when pred_pixels*1.0e0/gt_pixels<0.3 then 'under' else 'balanced' end as balance
  from m where class_id>0""", wide=True)
def p32(s):
    ratio = F.col("pred_pixels") / F.col("gt_pixels")
    return M.pr_metrics(_counts(s)).filter("class_id > 0").select(
        "name", M.health_label().alias("health"),
        F.when(F.col("gt_pixels") == 0, "n/a").when(ratio > 2.0, "over").when(ratio < 0.3, "under").otherwise("balanced").alias("balance"))


@query("a50_metrics_by_raster", """with c as (select r.raster_id, d.class_id,
  cast(sum(case when gt=class_id and pred=class_id then n else 0 end) as bigint) as tp,
  cast(sum(case when gt=class_id then n else 0 end) as bigint) as gt_pixels,
  cast(sum(case when pred=class_id then n else 0 end) as bigint) as pred_pixels
  from conf_counts r, dim_class d group by grouping sets ((r.raster_id, d.class_id), (d.class_id)))
  select coalesce(raster_id,-1) as raster_id, round(coalesce(avg(case when class_id>0 and gt_pixels>0 then tp*1.0e0/(gt_pixels+pred_pixels-tp+1e-10) end),0),6) as fg_miou,
  cast(sum(gt_pixels) filter (class_id>0) as bigint) as fg_pixels from c group by 1""", wide=True)
def a50(s):
    """Per raster and overall (-1) in one pass over the counts."""
    by = _cm(s).withColumn("raster_id", F.explode(F.array(F.col("raster_id"), F.lit(-1).cast("long"))))
    cm = by.groupBy("raster_id", "gt", "pred").agg(F.sum("n").alias("n"))
    m = M.pr_metrics(M.class_counts(cm, s.classes, ("raster_id",)))
    return m.groupBy("raster_id").agg(F.round(M.fg_mean(), 6).alias("fg_miou"),
                                      F.sum(F.when(F.col("class_id") > 0, F.col("gt_pixels"))).alias("fg_pixels"))


@query("j16_metric_reconciliation", f"""with m as {pr_sql()} , b as (select *, 2*precision*recall/(precision+recall+1e-9) as f1 from
  (select *, {PR.format(e='1e-9')} from counts)) select case when max(abs(m.iou-b.iou))<=1e-9 then 'PASS' else 'FAIL' end as verdict,
  round(max(abs(m.iou-b.iou)),9) as max_delta, count(*) as classes from m join b using (class_id)""", wide=True)
def j16(s):
    """Counter-based metrics against matrix-based ones."""
    c = _counts(s)
    a = M.pr_metrics(c).select("class_id", F.col("iou").alias("x"))
    b = M.pr_metrics(c, 1e-9).select("class_id", F.col("iou").alias("y"))
    d = F.max(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))))
    return a.join(b, "class_id", "full").agg(
        F.when(d <= 1e-9, "PASS").otherwise("FAIL").alias("verdict"), F.round(d, 9).alias("max_delta"), F.count("*").alias("classes"))


@query("u03_mask_difference", "select raster_id, cast(count(*) as bigint) as px from truth_px t where not exists (select 1 from pred_px p where p.raster_id=t.raster_id and p.row=t.row and p.col=t.col) group by 1", wide=True)
def u03(s):
    return subtract_boxes(box_layer(s.features, *s.frame), box_layer(s.pred_features, *s.frame)).groupBy("raster_id").agg(F.sum(run_len()).alias("px"))


@query("u07_mask_intersection", "select raster_id, cast(count(*) as bigint) as px from truth_px t join pred_px p using (raster_id,row,col) where t.class_id=4 and p.class_id=4 group by 1", wide=True)
def u07(s):
    from gridrun.operators.runs import class_layer, intersect
    return intersect(class_layer(s.truth, 4), class_layer(s.pred, 4)).groupBy("raster_id").agg(F.sum(run_len()).alias("px"))
