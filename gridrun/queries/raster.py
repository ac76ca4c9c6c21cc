"""Run algebra, morphology, components and proximity queries."""

from pyspark.sql import functions as F

from gridrun.constants import BUILTUP, ROAD, WATER
from gridrun.operators import components as C
from gridrun.operators import morphology as MO
from gridrun.operators import proximity as P
from gridrun.operators.burn import box_layer, recoded_boxes
from gridrun.operators.runs import intersect, merge_runs, run_len
from gridrun.operators.strips import box_layer_of, lay_over
from gridrun.queries.registry import query
from gridrun.sources import sinks as SI

FRAME = (256, 256)
PXSUM = "raster_id, cast(count(*) as bigint) as px, cast(sum(row*256+col) as bigint) as pos_sum"


def px_summary(runs, side=256):
    """Pixel count and position sum per raster: equal only if the masks are."""
    n = run_len()
    return runs.groupBy("raster_id").agg(
        F.sum(n).alias("px"),
        F.sum(F.col("row").cast("long") * side * n + ((F.col("c0") + F.col("c1")).cast("long") * n / 2).cast("long")).alias("pos_sum"))


@query("r01_run_encode", "select raster_id, class_id, row, c0, c1 from px_runs")
def r01(s):
    return s.truth.select("raster_id", "class_id", "row", "c0", "c1")


@query("r01_run_roundtrip", "select raster_id, class_id, count(*) as runs, cast(sum(c1-c0+1) as bigint) as px from px_runs group by 1,2", wide=True)
def r01b(s):
    return recoded_boxes(s.features, *s.frame).groupBy("raster_id", "class_id").agg(F.count("*").alias("runs"), F.sum(run_len()).alias("px"))


def disc_sql(cls, r, src="px_runs"):
    return f"""select distinct p.raster_id, p.row+y.dy as row, p.c as col from
  (select raster_id, row, c0, c1 from {src} where class_id={cls}) s, (select unnest(range(-{r},{r+1})) as dy) y,
  lateral (select s.raster_id, s.row, unnest(range(greatest(0, s.c0-cast(round(sqrt({r*r}-y.dy*y.dy)) as int)),
    least(255, s.c1+cast(round(sqrt({r*r}-y.dy*y.dy)) as int))+1)) as c) p where p.row+y.dy between 0 and 255"""


@query("r02_dilate_disc", f"select {PXSUM} from near_road group by 1")
def r02(s):
    return px_summary(MO.dilate(s.layer(ROAD), MO.disc(MO.radius_px(50.0, 5.0)), s.frame), s.side)


@query("r02_dilate_rect", f"""select {PXSUM} from (select distinct t.raster_id, t.row+y.d as row, t.col+x.d as col
  from (select * from truth_px where class_id=2) t, (select unnest(range(-7,8)) d) y, (select unnest(range(-2,3)) d) x
  where t.row+y.d between 0 and 255 and t.col+x.d between 0 and 255) group by 1""")
def r02r(s):
    return px_summary(MO.dilate(s.layer(2), MO.rect(5, 15), s.frame), s.side)


@query("r02_dilate_tall", f"""select {PXSUM} from (select distinct r.raster_id, r.row, unnest(range(r.a, r.z+1)) as col from
  (select raster_id, greatest(c0-50,0) a, least(c1+50,255) z, unnest(range(greatest(row-50,0), least(row+50,255)+1)) as row from px_runs where class_id=2) r) group by 1""")
def r02t(s):
    return px_summary(MO.dilate(s.layer(2), MO.rect(101, 101), s.frame), s.side)


@query("r02b_near_large_radius", f"""select {PXSUM} from truth_px t join near_road n using (raster_id,row,col) where t.class_id=3 group by 1""")
def r02b(s):
    return px_summary(P.near_pixels(s.layer(BUILTUP), s.layer(ROAD), 10, tile=128), s.side)


def erode_sql(src, w, h):
    """Pixels of ``src`` with no in-frame background pixel under the kernel."""
    return f"""select t.raster_id, t.row, t.col from {src} t,
  (select unnest(range(-{h//2},{h//2+1})) dy) y, (select unnest(range(-{w//2},{w//2+1})) dx) x
  left join {src} n on n.raster_id=t.raster_id and n.row=t.row+y.dy and n.col=t.col+x.dx
  group by t.raster_id, t.row, t.col
  having count(*) filter (n.row is null and t.row+y.dy between 0 and 255 and t.col+x.dx between 0 and 255)=0"""


def dilate_sql(src, w, h):
    return f"""select distinct raster_id, row+y.dy as row, col+x.dx as col from {src}, (select unnest(range(-{h//2},{h//2+1})) dy) y,
  (select unnest(range(-{w//2},{w//2+1})) dx) x where row+y.dy between 0 and 255 and col+x.dx between 0 and 255"""


# Disc of radius 1 as drawn here is the plus sign; radius 1 gives half-widths 0,1,0.
PLUS = "(select unnest([0,1,-1,0,0]) as dy, unnest([0,0,0,1,-1]) as dx) k"


@query("r03_erode", f"""with b as (select raster_id,row,col from truth_px where class_id=4) select {PXSUM} from ({erode_sql('b', 5, 3)}) group by 1""")
def r03(s):
    return px_summary(MO.erode(s.layer(WATER), MO.rect(5, 3), s.frame), s.side)


@query("r04_close", f"""with b as (select raster_id,row,col from truth_px where class_id=1), d as ({dilate_sql('b', 5, 5)})
  select {PXSUM} from ({erode_sql('d', 5, 5)}) group by 1""")
def r04(s):
    return px_summary(MO.close(s.layer(ROAD), MO.rect(5, 5), s.frame), s.side)


@query("r05_open", f"""with b as (select raster_id,row,col from truth_px where class_id=4),
  e as (select t.raster_id, t.row, t.col from b t, {PLUS} left join b n on n.raster_id=t.raster_id and n.row=t.row+k.dy and n.col=t.col+k.dx
    group by 1,2,3 having count(*) filter (n.row is null and t.row+k.dy between 0 and 255 and t.col+k.dx between 0 and 255)=0)
  select {PXSUM} from (select distinct raster_id, row+k.dy as row, col+k.dx as col from e, {PLUS}
    where row+k.dy between 0 and 255 and col+k.dx between 0 and 255) group by 1""")
def r05(s):
    return px_summary(MO.open_(s.layer(WATER), MO.disc(1), s.frame), s.side)


@query("u02_union_of_closings", f"""with b as (select raster_id,row,col from truth_px where class_id=1),
  d1 as ({dilate_sql('b', 3, 3)}), d2 as ({dilate_sql('b', 25, 3)}), d3 as ({dilate_sql('b', 3, 25)}),
  e1 as ({erode_sql('d1', 3, 3)}), e2 as ({erode_sql('d2', 25, 3)}), e3 as ({erode_sql('d3', 3, 25)})
  select {PXSUM} from (select * from e1 union select * from e2 union select * from e3) group by 1""")
def u02(s):
    road = s.layer(ROAD)
    parts = [MO.close(road, MO.rect(w, h), s.frame) for w, h in ((3, 3), (25, 3), (3, 25))]
    return px_summary(merge_runs(parts[0].unionByName(parts[1]).unionByName(parts[2])), s.side)


@query("r06_components", "select raster_id, class_id, comp_id, area_px from comps", wide=True)
def r06(s):
    return s.components.groupBy("raster_id", "class_id", "comp_id").agg(F.sum(run_len()).alias("area_px"))


@query("a17_component_stats", "select raster_id, class_id, comp_id, area_px, x0, y0, bw, bh, round(cx,6) as cx, round(cy,6) as cy from comps", wide=True)
def a17(s):
    return s.component_stats.select(
        "raster_id", "class_id", "comp_id", "area_px", "x0", "y0", "bw", "bh", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("p39_shape_descriptors", """select raster_id, class_id, comp_id, round(greatest(bw,bh)*1.0e0/greatest(least(bw,bh),1),6) as aspect,
  round(area_px*1.0e0/greatest(bw*bh,1),6) as fill from comps""", wide=True)
def p39(s):
    return s.component_stats.select(
        "raster_id", "class_id", "comp_id", F.round(C.aspect(), 6).alias("aspect"), F.round(C.fill(), 6).alias("fill"))


@query("f03_min_area_components", "select raster_id, class_id, count(*) as n, cast(sum(area_px) as bigint) as px from comps where area_px>=200 group by 1,2", wide=True)
def f03(s):
    return s.component_stats.filter("area_px >= 200").groupBy("raster_id", "class_id").agg(
        F.count("*").alias("n"), F.sum("area_px").alias("px"))


@query("r07_drop_small", """select r.raster_id, r.class_id, cast(count(*) as bigint) as runs, cast(sum(r.c1-r.c0+1) as bigint) as px from comp_runs r
  join comps c using (raster_id, class_id, comp_id) where c.area_px>=200 group by 1,2""", wide=True)
def r07(s):
    return C.large_of_boxes(box_layer(s.features, *s.frame), s.frame, 200).groupBy("raster_id", "class_id").agg(
        F.count("*").alias("runs"), F.sum(run_len()).alias("px"))


ROOF = "class_id=3 and area_px between 100 and 8000 and greatest(bw,bh)*1.0e0/greatest(least(bw,bh),1)<=6.0 and area_px*1.0e0/greatest(bw*bh,1)>=0.40"


def rooftops(labelled):
    """Ids of built-up components shaped like a single roof."""
    from gridrun.constants import ROOFTOP_MAX_ASPECT, ROOFTOP_MAX_PX, ROOFTOP_MIN_FILL, ROOFTOP_MIN_PX
    return C.component_stats(labelled.filter(F.col("class_id") == BUILTUP)).filter(
        F.col("area_px").between(ROOFTOP_MIN_PX, ROOFTOP_MAX_PX)
        & (C.aspect() <= ROOFTOP_MAX_ASPECT) & (C.fill() >= ROOFTOP_MIN_FILL))


@query("f05_rooftops", f"select raster_id, comp_id, area_px, bw, bh from comps where {ROOF}", wide=True)
def f05(s):
    return rooftops(s.components).select("raster_id", "comp_id", "area_px", "bw", "bh")


@query("j07_overlap_px", """select c.raster_id, c.comp_id, cast(count(n.row) as bigint) as near_road from
  (select raster_id, comp_id, row, unnest(range(c0,c1+1)) as col from comp_runs where class_id=3) c
  left join near_road n using (raster_id,row,col) group by 1,2""")
def j07(s):
    near = MO.dilate(s.layer(ROAD), MO.disc(10), s.frame)
    return P.overlap_px(s.components.filter("class_id = 3"), {"near_road": near})


@query("j08_touches_both", """with p as (select raster_id, comp_id, row, unnest(range(c0,c1+1)) as col from comp_runs where class_id=3)
  select distinct raster_id, comp_id from p semi join near_road using (raster_id,row,col)
  intersect select distinct raster_id, comp_id from p semi join near_water using (raster_id,row,col)""")
def j08(s):
    road = MO.dilate(s.layer(ROAD), MO.disc(10), s.frame)
    water = MO.dilate(s.layer(WATER), MO.disc(6), s.frame)
    return P.overlap_px(s.components.filter("class_id = 3"), {"r": road, "w": water}).filter("r > 0 and w > 0").select("raster_id", "comp_id")


@query("j10_trim_to_buffer", f"select {PXSUM} from truth_px t semi join near_water n using (raster_id,row,col) where class_id=2 group by 1")
def j10(s):
    return px_summary(intersect(s.layer(2), MO.dilate(s.layer(WATER), MO.disc(6), s.frame)), s.side)


@query("j19_zonal_mean", """select raster_id, class_id, comp_id, round(avg(conf)+1e-10,6) as mean_conf from
  (select raster_id, class_id, comp_id, row, unnest(range(c0,c1+1)) as col from comp_runs where class_id=3) join conf_px using (raster_id,row,col) group by 1,2,3""")
def j19(s):
    lab = s.components.filter("class_id = 3")
    return P.zonal_mean(lab, s.conf.withColumnRenamed("conf", "value")).select(
        "raster_id", F.lit(3).alias("class_id"), "comp_id", F.round(F.col("mean_value") + 1e-10, 6).alias("mean_conf"))


@query("j06_mask_confidence", """select class_id, raster_id, count(*) as px, round(avg(conf)+1e-10,6) as mean_conf from truth_px join conf_px using (raster_id,row,col) group by 1,2""")
def j06(s):
    o = lay_over({"class_id": box_layer(s.features, *s.frame), "conf": box_layer_of(s.conf_blocks, "conf")}, ("class_id",), under="class_id")
    return o.groupBy("class_id", "raster_id").agg(F.sum(run_len()).alias("px"), F.round(F.sum(F.col("conf") * run_len()) / F.sum(run_len()) + 1e-10, 6).alias("mean_conf"))


@query("s03_windowed_read", """select raster_id, class_id, min(row) as first_row, max(row) as last_row, min(col) as first_col, max(col) as last_col, count(*) as px
  from truth_px where row>=700 and row<1100 and col>=300 and col<1900 group by 1,2""", wide=True)
def s03(s):
    """A window over strip borders of the stored mask."""
    path = SI.scratch_path(s.spark, "mask")
    SI.write_mask(s.truth, path, strip=128)
    return SI.read_window(s.spark, path, 700, 300, 400, 1600).groupBy("raster_id", "class_id").agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("c0").alias("first_col"), F.max("c1").alias("last_col"), F.sum(run_len()).alias("px"))


RING = """with road as (select raster_id,row,col from truth_px where class_id=1),
  core as (select raster_id,row,col from truth_px where class_id=2), d as ({}),
  ring as (select d.* from d anti join core using (raster_id,row,col)), rr as (select r.* from ring r semi join road using (raster_id,row,col))"""


@query("j20_ring_values", RING.format(dilate_sql('core', 25, 25)) + """, cnt as (select raster_id, count(*) n from rr group by 1),
  pick as (select raster_id,row,col from road where raster_id not in (select raster_id from cnt where n>=20)
    union all select raster_id,row,col from rr where raster_id in (select raster_id from cnt where n>=20))
  select raster_id, count(*) as px, round(avg(conf)+1e-10,6) as mean_value from pick join conf_px using (raster_id,row,col)
  where raster_id in (select raster_id from core) group by 1""")
def j20(s):
    """Values on the road ring around the sparse class; all road where the ring is under 20 px."""
    core = s.layer(2)
    o = lay_over({"road": box_layer_of(s.layer(ROAD)), "core": box_layer_of(core), "grown": box_layer_of(MO.dilate(core, MO.rect(25, 25), s.frame)),
                  "v": box_layer_of(s.conf_blocks, "conf")}).filter("road is not null and v is not null")
    n, on = run_len(), F.expr("grown is not null and core is null")
    g = o.groupBy("raster_id").agg(
        F.coalesce(F.sum(F.when(on, n)), F.lit(0)).alias("rn"), F.sum(F.when(on, n * F.col("v"))).alias("rv"),
        F.sum(n).alias("an"), F.sum(n * F.col("v")).alias("av"))
    use = F.col("rn") >= 20
    return g.join(core.select("raster_id").distinct(), "raster_id", "left_semi").select(
        "raster_id", F.when(use, F.col("rn")).otherwise(F.col("an")).alias("px"),
        F.round(F.when(use, F.col("rv") / F.col("rn")).otherwise(F.col("av") / F.col("an")) + 1e-10, 6).alias("mean_value"))


@query("f11_zone_builtup_gate", """select z.raster_id, z.comp_id, z.area_px, count(t.row) as builtup_px from zones z
  join u_px u using (raster_id, comp_id) left join (select * from truth_px where class_id=3) t on t.raster_id=u.raster_id and t.row=u.row and t.col=u.col
  group by 1,2,3 having count(t.row)<=0.5*z.area_px""")
def f11(s):
    z = s.uncertain
    area = z.groupBy("raster_id", "comp_id").agg(F.sum(run_len()).alias("area_px")).filter("area_px >= 500")
    return area.join(P.overlap_px(z, {"builtup_px": s.layer(BUILTUP)}), ["raster_id", "comp_id"]).filter("builtup_px <= 0.5*area_px")
