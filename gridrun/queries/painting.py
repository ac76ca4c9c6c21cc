"""Class statistics, colouring, contrast and texture queries."""

from pyspark.sql import functions as F

from gridrun.constants import CLASSES, ROOFTOP_RGB
from gridrun.functions import rules as RU
from gridrun.functions.scoring import rnd
from gridrun.operators import metrics as M
from gridrun.operators import morphology as MO
from gridrun.operators import texture as TX
from gridrun.operators.runs import as_layer, class_layer, decode, merge_runs, overlay, run_len, subtract
from gridrun.plans import contrast as CO
from gridrun.plans import sparse as SPX
from gridrun.queries.accuracy import pr_sql
from gridrun.queries.raster import FRAME, ROOF, dilate_sql, rooftops
from gridrun.queries.registry import CTES, query, rd
from gridrun.session import durable

RGB = """cast((raster_id*7 + row*13 + col*29) % 256 as int) as red, cast((row*31 + col*17 + class_id*40) % 256 as int) as green, cast((raster_id*3 + row*5 + col*11) % 256 as int) as blue"""
CTES.update({
    "img": f"select raster_id, row, col, class_id, {RGB} from truth_px",
    "grid_img": f"select raster_id, row, col, class_id, {RGB} from (select g.*, coalesce(t.class_id,0) as class_id from grid_px g left join truth_px t using (raster_id,row,col))",
    "roof_px": f"select raster_id, row, unnest(range(c0,c1+1)) as col from comp_runs semi join (select * from comps where {ROOF}) using (raster_id, class_id, comp_id)",
    "core2": "select raster_id,row,col from truth_px where class_id=2",
    "ring2": f"""select d.raster_id,d.row,d.col from ({dilate_sql('core2', 21, 21)}) d anti join core2 using (raster_id,row,col)""",
    "nearby": """select r.raster_id,r.row,r.col from ring2 r semi join (select * from truth_px where class_id=1) t using (raster_id,row,col)""",
    "road_use": """select raster_id,row,col from nearby where raster_id in (select raster_id from nearby group by 1 having count(*)>=20)
   union all select raster_id,row,col from truth_px where class_id=1 and raster_id in (select raster_id from core2) and raster_id not in (select raster_id from nearby group by 1 having count(*)>=20)""",
    "zone_px": "select 'core' as zone, * from core2 union all select 'road', * from road_use",
    "gry": "select raster_id,row,col,0.299e0*red+0.587e0*green+0.114e0*blue as v from grid_img where raster_id in (select raster_id from core2)",
    "zk": """select z.raster_id, z.row, z.col, kx, ky, kl, cast(case z.row+dy when -1 then 1 when 256 then 254 else z.row+dy end as int) as nr, cast(case z.col+dx when -1 then 1 when 256 then 254 else z.col+dx end as int) as nc
   from (select distinct raster_id,row,col from zone_px) z, (values (-1,-1,-1,-1,0),(-1,0,0,-2,1),(-1,1,1,-1,0),(0,-1,-2,0,1),(0,0,0,0,-4),(0,1,2,0,1),(1,-1,-1,1,0),(1,0,0,2,1),(1,1,1,1,0)) k(dy,dx,kx,ky,kl)""",
    "tex": """select raster_id,row,col, sqrt(gx*gx+gy*gy) as grad, lap from (select z.raster_id, z.row, z.col, sum(v*kx) as gx, sum(v*ky) as gy, sum(v*kl) as lap from zk z
   join (select raster_id, row as nr, col as nc, v from gry) g using (raster_id, nr, nc) group by 1,2,3)""",
    "zstat": """select zone, z.raster_id, count(*) as px, avg(red) rm, avg(green) gm, avg(blue) bm, stddev_pop(red) rs, stddev_pop(green) gs, stddev_pop(blue) bs,
   avg(grad) as grad_mean, stddev_pop(grad) as grad_std, var_pop(lap) as lap_var from zone_px z join grid_img using (raster_id,row,col) join tex using (raster_id,row,col) group by 1,2""",
    "dist2": """select a.raster_id, a.px, l2, z, abs(a.grad_mean-b.grad_mean) gg, abs(a.lap_var-b.lap_var) lg, l2+0.15e0*least(1,abs(a.grad_mean-b.grad_mean)/40.0e0)+0.15e0*least(1,abs(a.lap_var-b.lap_var)/80.0e0) as score
   from (select * from zstat where zone='core') a join (select * from zstat where zone='road') b using (raster_id),
   lateral (select sqrt(pow(a.rm-b.rm,2)+pow(a.gm-b.gm,2)+pow(a.bm-b.bm,2))/255.0e0 as l2,
     sqrt(pow((a.rm-b.rm)/greatest((a.rs+b.rs)/2,1e-6),2)+pow((a.gm-b.gm)/greatest((a.gs+b.gs)/2,1e-6),2)+pow((a.bm-b.bm)/greatest((a.bs+b.bs)/2,1e-6),2)) as z)""",
})


def _class_px(s):
    """Pixels per raster and class, background from the frame."""
    d = s.truth.select("raster_id", F.explode(F.array(
        F.struct("class_id", run_len().alias("n")), F.struct(F.lit(0).alias("class_id"), (-run_len()).alias("n")))).alias("e")).select("raster_id", "e.*")
    frame = s.catalog.select("raster_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("class_id"), F.col("width").cast("long") * F.col("height")).toDF("raster_id", "class_id", "n")
    frame = frame.withColumn("n", F.when(F.col("class_id") == 0, F.col("n")).otherwise(0))
    return d.unionByName(frame).groupBy("raster_id", "class_id").agg(F.sum("n").alias("px"))


A01 = """select c.raster_id, d.class_id, d.name, case d.class_id when 0 then 65536-count(t.row) else count(t.row) end as px from catalog c cross join dim_class d left join truth_px t on t.raster_id=c.raster_id and (t.class_id=d.class_id or d.class_id=0) group by 1,2,3"""


@query("a01_class_pixels", f"select raster_id, class_id, name, px, {rd('100.0e0*px/65536',4)} as pct from ({A01})", wide=True)
def a01(s):
    return _class_px(s).join(F.broadcast(s.classes), "class_id").select("raster_id", "class_id", "name", "px", rnd(100.0 * F.col("px") / s.side**2, 4).alias("pct"))


@query("p02_physical_units", f"select raster_id, class_id, {rd('px*25.0e0',1)} as area_m2, {rd('px*25.0e0/10000',2)} as area_ha, {rd('100.0e0*px/65536',2)} as pct from ({A01})", wide=True)
def p02(s):
    px = F.col("px")
    return _class_px(s).select("raster_id", "class_id", rnd(px * 25.0, 1).alias("area_m2"), rnd(px * 25.0 / 10000.0, 2).alias("area_ha"), rnd(100.0 * px / s.side**2, 2).alias("pct"))


@query("a02_class_pixels_rooftops", f"select raster_id, class_id, px from ({A01}) union all select c.raster_id, 5, count(r.row) from catalog c left join roof_px r using (raster_id) group by 1")
def a02(s):
    roof = rooftops(s.components).groupBy("raster_id").agg(F.sum("area_px").alias("px"))
    roof = s.catalog.select("raster_id").join(roof, "raster_id", "left").select("raster_id", F.lit(5).alias("class_id"), F.coalesce("px", F.lit(0)).alias("px"))
    return _class_px(s).unionByName(roof)


@query("p10_rgb_normalise", f"select raster_id, class_id, round(avg((red/255.0e0-0.485e0)/0.229e0),6) as r, round(avg((green/255.0e0-0.456e0)/0.224e0),6) as g, round(avg((blue/255.0e0-0.406e0)/0.225e0),6) as b from grid_img group by 1,2")
def p10(s):
    r, g, b = RU.normalise_rgb("red", "green", "blue")
    return s.frame_image.groupBy("raster_id", "class_id").agg(F.round(F.avg(r), 6).alias("r"), F.round(F.avg(g), 6).alias("g"), F.round(F.avg(b), 6).alias("b"))


def _coloured(s):
    """Runs with their display colour: class colour, rooftop override."""
    roof = s.components.filter("class_id = 3").join(rooftops(s.components).select("raster_id", "comp_id"), ["raster_id", "comp_id"], "left_semi")
    o = overlay({"class_id": as_layer(s.truth, "class_id"), "roof": as_layer(roof)}).filter("class_id is not null")
    d = o.join(F.broadcast(s.classes.select("class_id", "red", "green", "blue")), "class_id")
    return d.select("raster_id", "row", "c0", "c1", "class_id", *[
        F.when(F.col("roof").isNotNull(), v).otherwise(F.col(b)).alias(f"m_{b}") for b, v in zip(("red", "green", "blue"), ROOFTOP_RGB)])


COL = "select t.raster_id, t.row, t.col, t.class_id, case when r.row is not null then 255 else d.red end m_red, case when r.row is not null then 140 else d.green end m_green, case when r.row is not null then 0 else d.blue end m_blue from truth_px t join dim_class d using (class_id) left join roof_px r using (raster_id,row,col)"


@query("p12_class_colours", f"select raster_id, m_red, m_green, m_blue, count(*) as px from ({COL}) group by 1,2,3,4")
def p12(s):
    return _coloured(s).groupBy("raster_id", "m_red", "m_green", "m_blue").agg(F.sum(run_len()).alias("px"))


OV = lambda b: f"round(avg(least(greatest((1-0.45e0)*({b}/255.0e0)+0.45e0*(m_{b}/255.0e0),0),1)),6) as {b}"


@query("p13_alpha_overlay", f"with c as ({COL}) select raster_id, c.class_id, {OV('red')}, {OV('green')}, {OV('blue')} from c join img i using (raster_id,row,col) group by 1,2")
def p13(s):
    d = decode(_coloured(s)).join(s.image.drop("class_id"), ["raster_id", "row", "col"])
    mix = lambda b: F.least(F.greatest(F.lit(1 - 0.45) * (F.col(b) / 255.0) + F.lit(0.45) * (F.col(f"m_{b}") / 255.0), F.lit(0.0)), F.lit(1.0))
    return d.groupBy("raster_id", "class_id").agg(*[F.round(F.avg(mix(b)), 6).alias(b) for b in ("red", "green", "blue")])


@query("p14_confidence_ramp", "select red, green, blue, count(*) as px from (select cast(floor(round((1-conf)*255,6)) as int) red, cast(floor(round(conf*200,6)) as int) green, cast(floor(round(conf*80,6)) as int) blue from conf_px) group by 1,2,3")
def p14(s):
    c = F.least(F.greatest(F.col("conf"), F.lit(0.0)), F.lit(1.0))
    fl = lambda x: F.floor(F.round(x, 6)).cast("int")
    return s.conf.select(fl((F.lit(1.0) - c) * 255).alias("red"), fl(c * 200).alias("green"), fl(c * 80).alias("blue"), run_len().alias("n")).groupBy(
        "red", "green", "blue").agg(F.sum("n").alias("px"))


STR = lambda b: f"case when z_{b}<=a_{b}+1e-6 then 0 else cast(floor(round(least(greatest(({b}-a_{b})/(z_{b}-a_{b}),0),1)*255.0e0,6)) as int) end as {b}"


@query("p15_percentile_stretch", f"""with q as (select raster_id, {", ".join(f"quantile_cont({b},0.02) a_{b}, quantile_cont({b},0.98) z_{b}" for b in ("red", "green", "blue"))} from grid_img group by 1)
  select raster_id, cast(sum(red) as bigint) as red, cast(sum(green) as bigint) as green, cast(sum(blue) as bigint) as blue from (select raster_id, {STR('red')}, {STR('green')}, {STR('blue')} from grid_img join q using (raster_id)) group by 1""")
def p15(s):
    d = TX.percentile_stretch(s.frame_runs, ["red", "green", "blue"], image=s.coloured)
    return d.groupBy("raster_id").agg(*[F.sum(b).alias(b) for b in ("red", "green", "blue")])


def _zones(s):
    """Pixels of the sparse class and of the road around it (all road where the ring is under 20 px)."""
    core = s.layer(2)
    ring = subtract(MO.dilate(core, MO.rect(21, 21), FRAME), core)
    o = overlay({"road": as_layer(s.layer(1)), "ring": as_layer(ring)}).filter("road is not null")
    n = o.groupBy("raster_id").agg(F.coalesce(F.sum(F.when(F.col("ring").isNotNull(), run_len())), F.lit(0)).alias("ring_px"))
    road = o.join(n, "raster_id").filter("ring is not null or ring_px < 20").join(core.select("raster_id").distinct(), "raster_id", "left_semi")
    cols = ["raster_id", "row", "c0", "c1"]
    return core.select(F.lit("core").alias("zone"), *cols).unionByName(road.select(F.lit("road").alias("zone"), *cols))


def _zone_stats(s):
    z = durable(_zones(s))
    halo = MO.dilate(z.drop("zone"), MO.rect(3, 3), FRAME)
    img = s.image_on(halo)
    tex = TX.texture(img, TX.gray(), 256, 256)
    px = decode(z).join(tex, ["raster_id", "row", "col"]).join(img, ["raster_id", "row", "col"])
    return px.groupBy("zone", "raster_id").agg(
        F.count("*").alias("px"), *[F.avg(b).alias(f"{b}_mean") for b in CO.BANDS], *[F.stddev_pop(b).alias(f"{b}_std") for b in CO.BANDS],
        F.avg("grad").alias("grad_mean"), F.stddev_pop("grad").alias("grad_std"), F.var_pop("lap").alias("lap_var"))


@query("a44_zone_colours", "select zone, raster_id, px, round(rm,6) as red_mean, round(gm,6) as green_mean, round(bm,6) as blue_mean, round(rs,6) as red_std, round(gs,6) as green_std, round(bs,6) as blue_std from zstat")
def a44(s):
    img = decode(_zones(s)).join(s.image, ["raster_id", "row", "col"])
    b = CO.band_stats(img, "zone")
    return b.select("zone", "raster_id", "px", *[F.round(c, 6).alias(c) for c in b.columns if c.endswith(("_mean", "_std"))])


@query("a45_texture", "select zone, raster_id, round(grad_mean,4) as grad_mean, round(grad_std,4) as grad_std, round(lap_var,3) as lap_var from zstat")
def a45(s):
    return _zone_stats(s).select("zone", "raster_id", F.round("grad_mean", 4).alias("grad_mean"), F.round("grad_std", 4).alias("grad_std"), F.round("lap_var", 3).alias("lap_var"))


def _distinct(s):
    z = durable(_zone_stats(s))
    return CO.distinctness(z.filter("zone = 'core'").drop("zone"), z.filter("zone = 'road'").drop("zone"))


@query("p31_distinctness", "select raster_id, px, round(l2,6) as rgb_l2, round(z,6) as z_dist, round(gg,4) as grad_gap, round(score,6) as distinct_score from dist2")
def p31(s):
    return _distinct(s).select("raster_id", "px", F.round("rgb_l2", 6).alias("rgb_l2"), F.round("z_dist", 6).alias("z_dist"), F.round("grad_gap", 4).alias("grad_gap"), F.round("distinct_score", 6).alias("distinct_score"))


GRADE = "case when px<50 or score<0.03 then 'C' when px<250 or z<0.8 then 'B' else 'A' end"


@query("p30_annotation_quality", f"select raster_id, {GRADE} as quality_class, case {GRADE} when 'C' then 'insufficient visible signal' when 'B' then 'weak contrast or small footprint' else 'clear footprint and measurable contrast' end as audit_note from dist2")
def p30(s):
    return CO.graded(_distinct(s)).select("raster_id", "quality_class", "audit_note")


@query("a35_similarity_shares", "select count(*) as n, round(avg(case when score<0.08 then 1.0e0 else 0 end),6) as weak, round(avg(case when score>=0.08 and score<0.16 then 1.0e0 else 0 end),6) as moderate, round(avg(case when score>=0.16 then 1.0e0 else 0 end),6) as strong from dist2")
def a35(s):
    return CO.similarity_summary(_distinct(s))


@query("a36_quality_counts", f"select k.q as quality_class, count(d.q) as n from (values ('A'),('B'),('C')) k(q) left join (select {GRADE} as q from dist2) d using (q) group by 1")
def a36(s):
    g = CO.graded(_distinct(s)).groupBy("quality_class").agg(F.count("*").alias("n"))
    dim = s.catalog.select(F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("quality_class")).distinct()
    return dim.join(g, "quality_class", "left").fillna(0, ["n"])


@query("a56_decision_rule", f"""select round(iou,6) as iou, round(recall,6) as recall, round(share,6) as sparse_pct_of_fg, case when iou=0 and recall*100<1 and share<0.2 then 'OPTION B' else 'OPTION A' end as decision
  from {pr_sql()} , (select 100.0e0*sum(px2)/greatest(1,sum(px1+px2+px3+px4)) as share from patches) where class_id=2""")
def a56(s):
    m = M.pr_metrics(M.class_counts(M.confusion_of(s.paired, s.catalog), s.classes)).filter("class_id = 2").select("iou", "recall")
    d = CO.decision(m, SPX.class_shares(s.patches).select("sparse_pct_of_fg"))
    return d.select(F.round("iou", 6).alias("iou"), F.round("recall", 6).alias("recall"), "sparse_pct_of_fg", "decision")


# Nearest background of a road pixel: in a column of its run, by that column's vertical distance, or next to an end of the run.
CTES["road_dist"] = """select a.raster_id, a.row, a.col, sqrt(least(min(b.g*b.g+(a.col-b.col)*(a.col-b.col)),
    case when r.c0>0 then 1.0e0*(a.col-r.c0+1)*(a.col-r.c0+1) else 1e18 end, case when r.c1<255 then 1.0e0*(r.c1-a.col+1)*(r.c1-a.col+1) else 1e18 end)) as distance
  from (select * from px_runs where class_id=1) r join road_gap a on a.raster_id=r.raster_id and a.row=r.row and a.col between r.c0 and r.c1
  join road_gap b on b.raster_id=r.raster_id and b.row=r.row and b.col between r.c0 and r.c1 group by a.raster_id, a.row, a.col, r.c0, r.c1"""
CTES["road_gap"] = """select raster_id, row, col, least(case when min(row) over w=0 then 1e9 else row-min(row) over w+1.0e0 end,
    case when max(row) over w=255 then 1e9 else max(row) over w-row+1.0e0 end) as g
  from (select *, row-row_number() over (partition by raster_id,col order by row) as k from truth_px where class_id=1) window w as (partition by raster_id,col,k)"""


@query("r16_distance_inside", "select raster_id, count(*) as px, round(max(distance),6) as max_distance, round(avg(distance),6) as mean_distance from road_dist group by 1", wide=True)
def r16(s):
    """Exact distance to background inside the road layer, as per-raster totals."""
    return TX.distance_inside(s.layer(1), *s.frame).groupBy("raster_id").agg(
        F.count("*").alias("px"), F.round(F.max("distance"), 6).alias("max_distance"), F.round(F.avg("distance"), 6).alias("mean_distance"))


@query("a46_width_estimate", "select raster_id, round(2.0e0*quantile_cont(distance,0.5),6) as width_px from road_dist group by 1", wide=True)
def a46(s):
    return TX.width_estimate(s.layer(1), *s.frame).withColumn("width_px", F.round("width_px", 6))


@query("r15_skeleton_length")
def r15(s):
    """Skeleton pixels and length of the road layer."""
    return TX.thin(s.layer(1), FRAME).groupBy("raster_id").agg(F.sum(run_len()).alias("skel_px"), (F.sum(run_len()) * 5.0).alias("length_m"))


@query("r15_area_length", "select raster_id, count(*)*5.0e0/3.0e0 as length_m from truth_px where class_id=1 group by 1", wide=True)
def r15b(s):
    """Area-based road length, the fallback when no skeleton is made."""
    return s.layer(1).groupBy("raster_id").agg((F.sum(run_len()) * 5.0 / 3.0).alias("length_m"))
