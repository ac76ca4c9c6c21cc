"""Mask cleaning queries."""

from pyspark.sql import functions as F

from gridrun.operators import postprocess as PP
from gridrun.operators.components import aspect, component_stats
from gridrun.operators.morphology import close, rect
from gridrun.operators.runs import class_layer, merge_runs, run_len, subtract
from gridrun.queries.raster import FRAME, dilate_sql, erode_sql, px_summary
from gridrun.queries.registry import CTES, query

CPX = "raster_id, class_id, cast(count(*) as bigint) as px, cast(sum(row*256+col) as bigint) as pos_sum"


def class_summary(mask):
    n = run_len()
    return mask.groupBy("raster_id", "class_id").agg(F.sum(n).alias("px"), F.sum(
        F.col("row").cast("long") * 256 * n + ((F.col("c0") + F.col("c1")).cast("long") * n / 2).cast("long")).alias("pos_sum"))


def comp_ctes(name, src):
    """Labelled pixels of a pixel relation ``src(raster_id,row,col)``: ``name_px(raster_id,row,col,comp_id)``."""
    return f"""{name}_r as materialized (select raster_id, row, min(col) as c0, max(col) as c1, row*256+min(col) as rid from (
    select *, col-row_number() over (partition by raster_id,row order by col) as g from {src}) group by raster_id, row, g),
  {name}_e as materialized (select a.raster_id, a.rid as a, b.rid as b from {name}_r a join {name}_r b on a.raster_id=b.raster_id and b.row=a.row+1 and b.c0<=a.c1+1 and b.c1>=a.c0-1),
  {name}_l as materialized (select raster_id,a,b from {name}_e union all select raster_id,b,a from {name}_e),
  {name}_h as (select raster_id, rid as l, rid as n from {name}_r r where not exists (select 1 from {name}_l k where k.raster_id=r.raster_id and k.a=r.rid and k.b<r.rid)
    union select x.raster_id, x.l, k.b from {name}_h x join {name}_l k on k.raster_id=x.raster_id and k.a=x.n),
  {name}_m as materialized (select raster_id, n as rid, min(l) as comp_id from {name}_h group by 1,2),
  {name}_px as (select raster_id, row, unnest(range(c0,c1+1)) as col, comp_id from {name}_r join {name}_m using (raster_id, rid))"""


CTES.update({
    "road0": "select raster_id,row,col from truth_px where class_id=1",
    "pred_road": "select raster_id,row,col from pred_px where class_id=1",
    "gapd1": dilate_sql("road0", 3, 3), "gapd2": dilate_sql("road0", 25, 3), "gapd3": dilate_sql("road0", 3, 25),
    "gape1": erode_sql("gapd1", 3, 3), "gape2": erode_sql("gapd2", 25, 3), "gape3": erode_sql("gapd3", 3, 25),
    "gapnew": """select raster_id,row,col from (select * from gape1 union select * from gape2 union select * from gape3) g
  where not exists (select 1 from truth_px t where t.raster_id=g.raster_id and t.row=g.row and t.col=g.col)
  and raster_id in (select raster_id from road0 group by 1 having count(*)>=10)""",
})

CTES["conf_hi"] = "select raster_id,row,col from conf_px where conf-0.2e0>0.35e0"
CTES["rw_near"] = """select distinct r.raster_id, r.row, unnest(range(r.a, r.z+1)) as col from
  (select raster_id, greatest(c0-50,0) a, least(c1+50,255) z, unnest(range(greatest(row-50,0), least(row+50,255)+1)) as row from px_runs where class_id in (1,4)) r"""


OVER = """select raster_id,row,col,{k} as class_id from new_px union all
  select raster_id,row,col,class_id from truth_px t where class_id<>{k} and not exists (select 1 from new_px n where n.raster_id=t.raster_id and n.row=t.row and n.col=t.col)"""


@query("r11_road_gap_fill", f"select {CPX} from (select * from truth_px union all select raster_id,row,col,1 from gapnew) group by 1,2")
def r11(s):
    return class_summary(PP.road_gap_fill(s.mask, FRAME))


@query("j12_safe_growth", "select raster_id, cast(count(*) as bigint) as px, cast(sum(row*256+col) as bigint) as pos_sum from gapnew group by 1")
def j12(s):
    """Only the pixels the gap fill adds."""
    return px_summary(subtract(class_layer(PP.road_gap_fill(s.mask, FRAME), 1), s.mask))


R08 = f"""with d as ({dilate_sql('road0', 5, 5)}), e as ({erode_sql('d', 5, 5)}), {comp_ctes('k', 'e')},
  new_px as (select raster_id,row,col from k_px where (raster_id,comp_id) in (select (raster_id,comp_id) from k_px group by raster_id,comp_id having count(*)>=200)),
  out_px as ({OVER.format(k=1)}) select {CPX} from out_px group by 1,2"""


@query("r08_refine_roads", R08)
def r08(s):
    return class_summary(PP.refine_roads(s.mask, FRAME))


def kdil(src, name):
    return f"select distinct raster_id, row+k.dy as row, col+k.dx as col from {src}, {name} k where row+k.dy between 0 and 255 and col+k.dx between 0 and 255"


def kero(src, name):
    return f"""select t.raster_id,t.row,t.col from {src} t, {name} k left join {src} n on n.raster_id=t.raster_id and n.row=t.row+k.dy and n.col=t.col+k.dx
    group by 1,2,3 having count(*) filter (n.row is null and t.row+k.dy between 0 and 255 and t.col+k.dx between 0 and 255)=0"""


@query("r09_refine_water", f"""with plus as (select unnest([0,1,-1,0,0]) as dy, unnest([0,0,0,1,-1]) as dx),
  disc5 as (select dy, dx from (select unnest(range(-5,6)) dy), (select unnest(range(-5,6)) dx) where abs(dx)<=round(sqrt(25-dy*dy))),
  w0 as (select raster_id,row,col from truth_px semi join conf_hi using (raster_id,row,col) where class_id=4),
  w1 as ({kero('w0', 'plus')}), w2 as ({kdil('w1', 'plus')}), w3 as ({kdil('w2', 'disc5')}), w4 as ({kero('w3', 'disc5')}), {comp_ctes('k', 'w4')},
  new_px as (select raster_id,row,col from k_px where (raster_id,comp_id) in (select (raster_id,comp_id) from k_px group by raster_id,comp_id having count(*)>=500)),
  out_px as ({OVER.format(k=4)}) select {CPX} from out_px group by 1,2""")
def r09(s):
    """The gate reads the blockwise confidence minus 0.2 as the class probability."""
    prob = s.conf.withColumn("prob", F.col("conf") - 0.2)
    return class_summary(PP.refine_water(s.mask, FRAME, prob))


@query("r10_refine_bridges", f"""with b0 as (select raster_id,row,col from truth_px where class_id=2), {comp_ctes('k', 'b0')},
  new_px as (select raster_id,row,col from k_px semi join rw_near using (raster_id,row,col)
    where (raster_id,comp_id) in (select (raster_id,comp_id) from k_px group by raster_id,comp_id having count(*) between 20 and 50000)),
  out_px as ({OVER.format(k=2)}) select {CPX} from out_px group by 1,2""")
def r10(s):
    return class_summary(PP.refine_bridges(s.mask, FRAME))


BOXHIT = """select distinct c.raster_id, c.comp_id from cr c join px_runs r on r.raster_id=c.raster_id and r.class_id={k}
   and r.row between c.row-{d} and c.row+{d} and r.c0<=c.c1+{d} and r.c1>=c.c0-{d}"""
SPAN = """select raster_id, comp_id from (select c.raster_id, c.comp_id, (any_value(c.x0)+any_value(c.x1))//2 as xm, (any_value(c.y0)+any_value(c.y1))//2 as ym,
   min(greatest(r.c0, c.c0-80)) xa, max(least(r.c1, c.c1+80)) xz, min(r.row) ya, max(r.row) yz
   from (select cr.*, k.x0, k.x1, k.y0, k.y1 from cr join comps k using (raster_id, class_id, comp_id)) c join px_runs r on r.raster_id=c.raster_id and r.class_id=1
   and r.row between c.row-80 and c.row+80 and r.c0<=c.c1+80 and r.c1>=c.c0-80 group by 1,2) where (xa<xm and xz>=xm) or (ya<ym and yz>=ym)"""
CR = """cr as (select r.* from comp_runs r join comps c using (raster_id, class_id, comp_id) where class_id=3 and area_px between 20 and 20000
   and greatest(bw,bh)*1.0e0/least(bw,bh)>=1.2)"""


@query("j13_spans_road", f"with {CR} {', sp as (' + SPAN + ')'} select * from sp")
def j13(s):
    lab = s.components.filter("class_id = 3")
    ok = component_stats(lab).filter(F.col("area_px").between(20, 20000) & (aspect() >= 1.2))
    return PP.spans_road(lab.join(ok, ["raster_id", "comp_id"], "left_semi"), s.layer(1), FRAME)


@query("r12_bridge_recovery", f"""with {CR}, hit as (({BOXHIT.format(k=1, d=50)}) intersect ({BOXHIT.format(k=4, d=140)})), sp as ({SPAN}),
  ch as (select * from hit union select * from sp), new_px as (select raster_id, row, unnest(range(c0,c1+1)) as col from cr semi join ch using (raster_id, comp_id)),
  out_px as ({OVER.format(k=2).replace("class_id<>2 and ", "")}) select {CPX} from out_px group by 1,2""")
def r12(s):
    return class_summary(PP.bridge_recovery(s.mask, FRAME))


@query("r13_postprocess_chain")
def r13(s):
    """All stages in order on the prediction."""
    return class_summary(PP.clean_mask(s.pred, FRAME, strict=True))


# The failing stage leaves no trace: what is left is r08 on the prediction.
@query("k03_stage_list", R08.replace("truth_px", "pred_px").replace("road0", "pred_road"))
def k03(s):
    """A user-chosen stage list with a failing stage that is passed over."""
    def broken(_):
        raise PP.StageError("stage rejects its input")
    stages = [("broken", broken), ("refine_roads", lambda m: PP.refine_roads(m, FRAME))]
    return class_summary(PP.run_stages(s.pred, stages, strict=False))
