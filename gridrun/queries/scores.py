"""Queries over stored class scores: probabilities, calibration, losses, stitching."""

from pyspark.sql import functions as F

from gridrun.constants import DEFAULT_BIAS
from gridrun.functions import logits as L
from gridrun.operators import calibrate as CA
from gridrun.operators import losses as LO
from gridrun.operators import metrics as M
from gridrun.operators import stitch as ST
from gridrun.queries.registry import query
from gridrun.operators.onerow import with_row

ZCOLS = lambda z, n=6: ", ".join(f"round({z}[{k + 1}],{n}) as z{k}" for k in range(5))


def _flat(df, *keys, col="z"):
    return df.select(*keys, *[F.round(F.col(col)[k], 6).alias(f"z{k}") for k in range(5)])


@query("p03_softmax", f"select vec_id, k, {ZCOLS('p')} from lgp")
def p03(s):
    return _flat(s.logits.withColumn("p", L.softmax("z")), "vec_id", "k", col="p")


@query("p04_argmax", "select vec_id, k, cast(pred as int) as pred from lgp")
def p04(s):
    return s.logits.select("vec_id", "k", L.argmax("z").alias("pred"))


@query("p05_confidence", "select vec_id, k, round(list_max(p),6) as conf from lgp")
def p05(s):
    return s.logits.select("vec_id", "k", F.round(L.confidence("z"), 6).alias("conf"))


BZ = "[z[1]+0.0e0, z[2]+1.5e0, z[3]+4.0e0, z[4]+0.0e0, z[5]+0.0e0]"


@query("p06_add_bias", f"select vec_id, k, {ZCOLS('b')} from (select vec_id, k, {BZ} as b from lg)")
def p06(s):
    return _flat(s.logits.withColumn("z", L.add_bias("z", DEFAULT_BIAS)), "vec_id", "k")


@query("p07_ensemble", "select vec_id, k, " + ", ".join(f"round(0.65e0*z[{i+1}]+0.35e0*z2[{i+1}],6) as z{i}" for i in range(5)) + " from lg2")
def p07(s):
    return _flat(s.logits_pair.withColumn("z", L.ensemble("z", "z2")), "vec_id", "k")


@query("s19_two_model_join", "select vec_id, k, gt, round(z[1]-z2[1],6) as d0 from lg2")
def s19(s):
    return s.logits_pair.select("vec_id", "k", "gt", F.round(F.col("z")[0] - F.col("z2")[0], 6).alias("d0"))


@query("p11_entropy", "select vec_id, k, round(-list_sum(list_transform(p, lambda x: x*ln(x+1e-10))),6) as entropy from lgp")
def p11(s):
    return s.logits.select("vec_id", "k", F.round(L.entropy(L.softmax("z")), 6).alias("entropy"))


@query("p28_confidence_band", "select band, count(*) as n from (select case when list_max(p)<0.4e0 then 'low' when list_max(p)<0.7e0 then 'medium' else 'high' end as band from lgp) group by 1")
def p28(s):
    return s.logits.select(L.confidence_band(L.confidence("z")).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


#: Score pixels laid out as rasters of four rows, one for each of four vectors in a row.
PLACE = {"raster_id": "vec_id div 4", "row": "cast(vec_id % 4 as int)", "col": "cast(k as int)"}
GRID = (13, 4)


def _grid(s, z="z"):
    pixels = s.logits if z == "z" else s.logits_pair
    return pixels.selectExpr(*[f"{v} as {k}" for k, v in PLACE.items()], f"{z} as z")


FL = "select vec_id//4 as raster_id, cast(vec_id%4 as int) as row, cast(k as int) as col, {} as z from lg2"
AVGZ = ", ".join(f"round(avg(z[{k+1}]),6) as z{k}" for k in range(5))


@query("p08_flip_average", f"""select raster_id, row, col, {AVGZ} from ({FL.format('z')}
  union all select raster_id, row, 12-col, z from ({FL.format('z2')}) union all select raster_id, 3-row, col, z from ({FL.format('z2')})) group by 1,2,3""")
def p08(s):
    return _flat(ST.flip_average(_grid(s), _grid(s, "z2"), _grid(s, "z2"), *GRID), "raster_id", "row", "col")


EACH = lambda form: ", ".join(form.format(k=k) for k in range(1, 6))
TAP = lambda y, x, w: f"select r, c, cast({y} as int) as y, cast({x} as int) as x, {w} as w from place"


@query("p09_multiscale_average", f"""with lo as (select raster_id, row//2 as y, col//2 as x, {EACH('avg(z[{k}]) as a{k}')} from ({FL.format('z2')}) group by 1,2,3),
  place as (select r, c, floor(sy) as y0, floor(sx) as x0, sy-floor(sy) as fy, sx-floor(sx) as fx from (
    select r, c, greatest((r+0.5e0)*0.5e0-0.5e0,0) as sy, greatest((c+0.5e0)*(7.0e0/13)-0.5e0,0) as sx from range(4) a(r), range(13) b(c))),
  taps as ({TAP('y0', 'x0', '(1-fy)*(1-fx)')} union all {TAP('y0', 'least(x0+1,6)', '(1-fy)*fx')}
    union all {TAP('least(y0+1,1)', 'x0', 'fy*(1-fx)')} union all {TAP('least(y0+1,1)', 'least(x0+1,6)', 'fy*fx')}),
  wide as (select lo.raster_id, cast(r as int) as row, cast(c as int) as col, {EACH('sum(w*a{k}) as b{k}')} from taps join lo on lo.y=taps.y and lo.x=taps.x group by 1,2,3)
  select raster_id, row, col, """ + ", ".join(f"round(avg(b{k}),6) as z{k - 1}" for k in range(1, 6)) + f""" from (
    select raster_id, row, col, {EACH('z[{k}] as b{k}')} from ({FL.format('z')}) union all select * from wide) group by 1,2,3""")
def p09(s):
    """The second model scores at half the resolution: its pixels are means of up to four, those of the last column of two."""
    low = _grid(s, "z2").groupBy("raster_id", F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(
        F.array(*[F.avg(F.col("z")[i]) for i in range(5)]).alias("z"))
    up = ST.upsample(low, (2, 7), GRID[::-1])
    return _flat(ST.mean_scores(_grid(s).unionByName(up)), "raster_id", "row", "col")


@query("a27_overlap_tile_mean", f"""select raster_id, row, col, {AVGZ} from (select vec_id as raster_id, 0 as row, cast(k as int) as col, z from lg2
  union all select vec_id, 0, cast(k+4 as int), z2 from lg2) group by 1,2,3""")
def a27(s):
    p = s.logits_pair
    a = p.select(F.col("vec_id").alias("raster_id"), F.lit(0).alias("row"), F.col("k").alias("col"), "z")
    b = p.select(F.col("vec_id").alias("raster_id"), F.lit(0).alias("row"), (F.col("k") + 4).alias("col"), F.col("z2").alias("z"))
    return _flat(ST.mean_scores(a.unionByName(b)), "raster_id", "row", "col")


@query("w13_strip_stitch", """with s as (select vec_id as raster_id, 0 as strip, 0 as start, cast(k as int) as row, 0 as col, cast(pred as int) as class_id from lgp
   union all select vec_id, 1, 8, cast(k+8 as int), 0, cast((pred+1)%5 as int) from lgp union all select vec_id, 2, 16, cast(k+16 as int), 0, cast((pred+2)%5 as int) from lgp)
  select raster_id, row, col, arg_max(class_id, strip) as class_id from s where strip=0 or row>=start+2 group by 1,2,3""")
def w13(s):
    base = s.logits.select(F.col("vec_id").alias("raster_id"), "k", L.argmax("z").alias("c"))
    st = base.select("raster_id", "k", "c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("strip")).select(
        "raster_id", "strip", (F.col("strip") * 8).alias("start"), (F.col("k") + F.col("strip") * 8).alias("row"),
        F.lit(0).alias("col"), ((F.col("c") + F.col("strip")) % 5).alias("class_id"))
    return ST.strip_stitch(st, 4)


@query("s06_calibration_vector", """select d.class_id, coalesce(l.bias, d.b) as bias from
  (select * from (values (0,0.0e0),(1,1.5e0),(2,4.0e0),(3,0.0e0),(4,0.0e0)) t(class_id,b)) d
  left join (select label as class_id, round(avg(list_sum(embedding)/64.0e0),4) as bias from embeddings where label<3 group by 1) l using (class_id)""")
def s06(s):
    """Stored biases where present, the default vector elsewhere."""
    from gridrun.sources.inventory import calibration_vector
    stored = s.table("embeddings").filter("label < 3").groupBy(F.col("label").alias("class_id")).agg(
        F.round(F.avg(F.expr("aggregate(embedding, 0D, (a, x) -> a + x)") / 64.0), 4).alias("bias"))
    return calibration_vector(s.classes, stored)


@query("s07_scores_roundtrip", "select gt, count(*) as n, round(sum(z[3]),4) as z2 from lg group by 1")
def s07(s):
    """Scores are computed once, stored under a name made from their input, and found there by every later trial."""
    from gridrun.sources.cache import cached
    scores = lambda: cached(s.spark, "scores", {"embeddings": s.table("embeddings")}, {"classes": 5}, lambda: s.logits)
    scores()
    return scores().groupBy("gt").agg(F.count("*").alias("n"), F.round(F.sum(F.col("z")[2]), 4).alias("z2"))


CM = """(select gt, list_position(b, list_max(b))-1 as pred, count(*) as n from (select gt, {b} as b from lg) group by 1,2)"""
LCOUNT = """(select d.class_id, cast(coalesce(sum(n) filter (gt=class_id and pred=class_id),0) as bigint) as tp,
  cast(coalesce(sum(n) filter (gt=class_id),0) as bigint) as g, cast(coalesce(sum(n) filter (pred=class_id),0) as bigint) as p from dim_class d, {cm} group by 1)"""


@query("a13_flat_fg_miou", f"""select round(avg(tp/(g+p-tp+1e-10)) filter (class_id>0 and g>0),6) as fg_miou from {LCOUNT.format(cm=CM.format(b='z'))}""")
def a13(s):
    return CA.trial_miou(s.logits, 0, [0.0], [0.0] * 5).select(F.round("miou", 6).alias("fg_miou"))


@query("a13_chunked_fg_miou", """with c as (select vec_id//100 as chunk, gt, pred from lgp),
  k as (select chunk, class_id, count(*) filter (gt=class_id) g, count(*) filter (gt=class_id and pred=class_id) i,
    count(*) filter (gt=class_id or pred=class_id) u from c, dim_class where class_id>0 group by 1,2),
  t as (select class_id, sum(i) i, sum(u) u from k where g>0 group by 1)
  select round(coalesce(avg(i/(u+1e-10)),0),6) as fg_miou from t where u>0""")
def a13c(s):
    """Chunk-wise variant: a class without truth in a chunk skips that chunk."""
    d = s.logits.select(F.floor(F.col("vec_id") / 100).alias("chunk"), "gt", L.argmax("z").alias("pred"))
    cell = d.groupBy("chunk", "gt", "pred").agg(F.count("*").alias("n"))
    k = cell.withColumn("class_id", F.explode(F.sequence(F.lit(1), F.lit(4)))).groupBy("chunk", "class_id").agg(
        *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(a) for a, c in {
            "g": F.col("gt") == F.col("class_id"), "i": (F.col("gt") == F.col("class_id")) & (F.col("pred") == F.col("class_id")),
            "u": (F.col("gt") == F.col("class_id")) | (F.col("pred") == F.col("class_id"))}.items()])
    t = k.filter("g > 0").groupBy("class_id").agg(F.sum("i").alias("i"), F.sum("u").alias("u")).filter("u > 0")
    return t.agg(F.round(F.coalesce(F.avg(F.col("i") / (F.col("u") + F.lit(1e-10))), F.lit(0.0)), 6).alias("fg_miou"))


SW = ",".join(f"{0.5*i}e0" for i in range(13))


def _sweep_sql(cols):
    return f"""with x as (select gt, z[3] as z2, greatest(z[1],z[2]+1.5e0,z[4],z[5]) as om from lg), g as (select unnest([{SW}]) as bias),
  c as (select bias, count(*) filter (gt=2 and z2+bias>=om) as tp, count(*) filter (gt<>2 and z2+bias>=om) as fp, count(*) filter (gt=2 and z2+bias<om) as fn from x, g group by 1),
  m as (select *, tp/(tp+fp+1e-10) as precision, tp/(tp+fn+1e-10) as recall, tp/(tp+fp+fn+1e-10) as iou from c)
  select {cols} from m"""


@query("j18_bias_grid", _sweep_sql("bias, tp, fp, fn"))
def j18(s):
    return CA.bias_sweep(s.logits, 2, CA.GRIDS[2], DEFAULT_BIAS).select("bias", "tp", "fp", "fn")


@query("a51_bias_sweep", _sweep_sql("bias, tp, fp, fn, round(precision,6) as precision, round(recall,6) as recall, round(2*precision*recall/(precision+recall+1e-10),6) as f1, round(iou,6) as iou"))
def a51(s):
    return CA.bias_sweep(s.logits, 2, CA.GRIDS[2], DEFAULT_BIAS).select(
        "bias", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "iou")])


@query("a52_calibration_step", f"""with g as (select unnest([{",".join(f"{0.25*i}e0" for i in range(14))}]) as value),
  x as (select value, gt, [z[1], z[2]+value, z[3], z[4], z[5]] as b from lg, g),
  c as (select value, d.class_id, count(*) filter (gt=class_id) as g, count(*) filter (gt=class_id and p=class_id) as i, count(*) filter (gt=class_id or p=class_id) as u
    from (select value, gt, list_position(b, list_max(b))-1 as p from x), dim_class d where class_id>0 group by 1,2)
  select value, round(avg(i/(u+1e-10)) filter (g>0),6) as miou from c group by 1""")
def a52(s):
    return CA.trial_miou(s.logits, 1, CA.GRIDS[1], [0.0] * 5).withColumn("miou", F.round("miou", 6))


@query("a52_coordinate_descent")
def a52b(s):
    """The whole search; the result is one row."""
    bias, best = CA.coordinate_descent(s.logits)
    n = s.table("embeddings").agg(F.count("*").alias("n"))
    return n.select(*[F.lit(b).alias(f"bias_{i}") for i, b in enumerate(bias)], F.lit(best).alias("fg_miou"), "n")


@query("a14_class_confidence", """with q as (select pred, list_max(p) as c, -list_sum(list_transform(p, lambda x: x*ln(x+1e-10))) as e from lgp)
  select cast(pred as int) as pred, count(*) as n, round(avg(c),6) as mean_conf, round(100.0e0*avg(case when c<0.4e0 then 1.0e0 else 0.0e0 end),6) as low_pct,
  round(100.0e0*avg(case when c>=0.4e0 and c<0.7e0 then 1.0e0 else 0.0e0 end),6) as medium_pct, round(100.0e0*avg(case when c>=0.7e0 then 1.0e0 else 0.0e0 end),6) as high_pct,
  round((select avg(c) from q),6) as global_conf, round((select avg(e) from q),6) as mean_entropy from q group by 1""")
def a14(s):
    q = s.logits.select(L.argmax("z").alias("pred"), L.softmax("z").alias("p")).select(
        "pred", F.array_max("p").alias("c"), L.entropy("p").alias("e"))
    share = lambda cond: F.round(100.0 * F.count_if(cond) / F.count("*"), 6)
    c = F.col("c")
    part = q.groupBy("pred").agg(F.count("*").alias("n"), F.sum("c").alias("cs"), F.sum("e").alias("es"),
                                 share(c < 0.4).alias("low_pct"), share((c >= 0.4) & (c < 0.7)).alias("medium_pct"), share(c >= 0.7).alias("high_pct"))
    tot = part.agg((F.sum("cs") / F.sum("n")).alias("gc"), (F.sum("es") / F.sum("n")).alias("ge"))
    return part.transform(with_row, tot).select("pred", "n", F.round(F.col("cs") / F.col("n"), 6).alias("mean_conf"),
                                              "low_pct", "medium_pct", "high_pct", F.round("gc", 6).alias("global_conf"), F.round("ge", 6).alias("mean_entropy"))


@query("f04_confidence_gate", "select count(*) filter (pred=4) as water, count(*) filter (pred=4 and p[5]>0.35e0) as water_kept, count(*) filter (pred=2) as bridge, count(*) filter (pred=2 and p[3]>0.40e0) as bridge_kept from lgp")
def f04(s):
    q = s.logits.select(L.argmax("z").alias("pred"), L.softmax("z").alias("p"))
    return q.agg(F.count_if(F.expr("pred = 4")).alias("water"), F.count_if(F.expr("pred = 4 and p[4] > 0.35")).alias("water_kept"),
                 F.count_if(F.expr("pred = 2")).alias("bridge"), F.count_if(F.expr("pred = 2 and p[2] > 0.40")).alias("bridge_kept"))


SUMS = "select vec_id, count(*) n, " + ", ".join(
    f"sum(p[{k+1}]) p{k}, sum(case when gt={k} then 1.0e0 else 0.0e0 end) t{k}, sum(case when gt={k} then p[{k+1}] else 0.0e0 end) i{k}" for k in range(5)) + " from lgp group by 1"
_mean4 = lambda f: "(" + "+".join(f(k) for k in range(1, 5)) + ")/4"
SD = lambda k: f"avg(1-(2*(i{k}*0.95e0+p{k}*0.01e0)+1e-4)/(p{k}+t{k}*0.95e0+n*0.01e0+1e-4))"


@query("a53_loss_terms", f"""with ce as (select ln(list_sum(list_transform(z, lambda x: exp(x-list_max(z)))))+list_max(z)-z[gt+1] as ce from lg), s as ({SUMS})
  select round((select avg(ce) from ce),6) as ce, round((select avg(pow(1-exp(-ce),2)*ce) from ce),6) as focal,
  round({_mean4(lambda k: f"avg(1-(2*i{k}+1e-4)/(p{k}+t{k}+1e-4))")},6) as soft_dice,
  round(case when sum(t2)<100 then ({SD(1)}+{SD(3)}+{SD(4)})/3 else {_mean4(SD)} end,6) as smoothed_dice,
  round({_mean4(lambda k: f"avg(pow(greatest(1-(i{k}+1e-6)/(i{k}+0.7e0*(p{k}-i{k})+0.3e0*(t{k}-i{k})+1e-6),0),1.5e0))")},6) as focal_tversky from s""")
def a53(s):
    t = LO.loss_terms(s.logits, "vec_id")
    return t.select(*[F.round(c, 6).alias(c) for c in t.columns])


@query("t09_hard_pixels", """with c as (select vec_id, k, vec_id%4 as batch, ln(list_sum(list_transform(z, lambda x: exp(x-list_max(z)))))+list_max(z)-z[gt+1] as ce from lg),
  n as (select *, rank() over (partition by batch order by round(ce,9) desc) as r, count(*) over (partition by batch) as n from c)
  select batch, vec_id, k, round(ce,6) as ce from n where r<=greatest(1, cast(floor(0.30e0*n) as bigint))""")
def t09(s):
    px = s.logits.withColumn("batch", F.col("vec_id") % 4)
    return LO.hard_pixels(px, "batch", ["vec_id", "k"]).select("batch", "vec_id", "k", F.round("ce", 6).alias("ce"))


def _lcm(s, bias):
    p = CA.predict(s.logits, bias)
    return p.groupBy("gt", "pred").agg(F.count("*").alias("n"))


def _ev(b):
    return f"""select class_id, g as gt_pixels, tp/(g+p-tp+1e-10) as iou, tp/(p+1e-10) as precision, tp/(g+1e-10) as recall from {LCOUNT.format(cm=CM.format(b=b))} where class_id>0 and g>0"""


@query("q05_calibrated_evaluation", f"""with b as ({_ev('z')}), c as ({_ev(BZ)}) select b.class_id, b.gt_pixels, round(b.iou,6) as base_iou, round(c.iou,6) as calibrated_iou,
  round(c.iou-b.iou,6) as delta_iou, round(c.recall-b.recall,6) as delta_recall, round((select avg(iou) from c)-(select avg(iou) from b),6) as delta_fg_miou from b join c using (class_id)""")
def q05(s):
    """Scores without and with calibration, and the difference."""
    from gridrun.plans.evaluation import compare_runs
    ev = lambda b: M.pr_metrics(M.class_counts(_lcm(s, b), s.classes)).filter("class_id > 0 and gt_pixels > 0")
    d = compare_runs(ev([0.0] * 5), ev(DEFAULT_BIAS))
    return d.select("class_id", "gt_pixels", *[F.round(c, 6).alias(c) for c in ("base_iou", "calibrated_iou", "delta_iou", "delta_recall", "delta_fg_miou")])


@query("a43_calibration_uplift", f"""with b as ({_ev('z')}), c as ({_ev(BZ)}) select b.class_id, round(c.iou-b.iou,6) as uplift from b join c using (class_id)""")
def a43(s):
    from gridrun.plans.evaluation import compare_runs
    ev = lambda b: M.pr_metrics(M.class_counts(_lcm(s, b), s.classes)).filter("class_id > 0 and gt_pixels > 0")
    return compare_runs(ev([0.0] * 5), ev(DEFAULT_BIAS)).select("class_id", F.round("delta_iou", 6).alias("uplift"))


@query("q06_candidate_certification")
def q06(s):
    """Bias search, then metrics with the bias found, per class and as a summary."""
    bias, best = CA.coordinate_descent(s.logits)
    m = M.pr_metrics(M.class_counts(_lcm(s, bias), s.classes)).filter("class_id > 0 and gt_pixels > 0")
    return m.select("class_id", "name", "gt_pixels", "pred_pixels", "tp", "iou", "precision", "recall", "f1",
                    F.lit(best).alias("search_fg_miou"), F.lit(",".join(map(str, bias))).alias("optimal_bias"))


PATCH = "select vec_id, gt, pred, p[3] as pb from lgp"


@query("a39_probability_diagnostics", f"""with q as ({PATCH}), f as (select vec_id, count(*) filter (gt=2) as t, count(*) filter (pred=2) as raw,
   count(*) filter (pred=2 and pb>0.40e0) as post from q group by 1)
  select count(*) as patches, count(*) filter (raw=0) as never_predicted, count(*) filter (raw>0 and post=0) as removed_by_gate,
  round((select avg(pb) from q where gt=2),6) as prob_mean_on, round((select quantile_cont(pb,0.95) from q where gt=2),6) as prob_p95_on,
  round((select avg(pb) from q join f using (vec_id) where gt<>2 and f.t>0),6) as prob_mean_off from f""")
def a39(s):
    from gridrun.plans.evaluation import probability_diagnostics
    q = s.logits.select("vec_id", "gt", L.argmax("z").alias("pred"), L.softmax("z")[2].alias("pb"))
    return probability_diagnostics(q, "vec_id")
