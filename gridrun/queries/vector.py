"""Vector layer, coordinate and rasterisation queries."""

from pyspark.sql import functions as F

from gridrun.functions import geometry as G
from gridrun.operators import vector as VE
from gridrun.operators.burn import burn_rings
from gridrun.operators.runs import run_len
from gridrun.queries.registry import CTES, query

CTES.update({
    # World boxes of the features; rasters start at x = 500000 + 2000*id.
    "wbox": """select f.*, 500000.0e0+2000*raster_id+5.0e0*c0 as x0, 500000.0e0+2000*raster_id+5.0e0*(c0+w) as x1,
  3200000.0e0-5.0e0*(r0+h) as y0, 3200000.0e0-5.0e0*r0 as y1,
  case when raster_id%3=0 then 'north' when raster_id%3=1 then 'south' else 'delta' end as source from feat f""",
    # Boxes of a feature: itself, a hole that counts against it, a second part.
    "parts": """select raster_id, feature_id, class_id, c0, r0, w, h, 1 as turn from feat
  union all select raster_id, feature_id, class_id, c0+8, r0+6, 8, 6, -1 from feat where class_id=4 and feature_id%5=0
  union all select raster_id, feature_id, class_id, c0+30, r0+2, 4, 4, 1 from feat where class_id=3 and feature_id%7=0""",
    "clipbox": """select raster_id, feature_id, class_id, sum(turn*25.0e0*greatest(least(c0+w,256)-c0,0)*greatest(least(r0+h,256)-r0,0)) as area_m2 from parts group by 1,2,3""",
    "layr": """select b.*, b.feature_id*2+k.copy as fid, k.copy, case when b.feature_id%31=0 then 'empty' when b.feature_id%23=0 then 'self_crossing'
   when b.feature_id%29=0 then 'unclosed' when b.feature_id%41=0 then 'self_crossing' end as defect,
   (b.feature_id%5=0 and class_id=4)::int + 2*(b.feature_id%7=0 and class_id=3)::int + 4*(b.feature_id%41=0)::int as extra from wbox b, (select unnest([0,1]) as copy) k
   where not (source='delta' and class_id=2) and (k.copy=0 or b.feature_id%37=0)""",
    "windows": "select raster_id, r.v*2+c.v as window_id, r.v*128 as wr, c.v*128 as wc, 128 as wh, 128 as ww from catalog, (select unnest([0,1]) v) r, (select unnest([0,1]) v) c",
    "explayer": "select distinct source, d.class_id from catalog, dim_class d where d.class_id>0",
})


def windows(s, size=128, side=256):
    n = side // size
    return (s.catalog.select("raster_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("r"))
            .select("raster_id", "r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("c"))
            .selectExpr("raster_id", f"r*{n}+c as window_id", f"r*{size} as wr", f"c*{size} as wc", f"{size} as wh", f"{size} as ww"))


@query("p35_world_to_pixel", "select raster_id, feature_id, r0+h//2 as row, c0+w//2 as col from (select * from feat) where r0+h//2<256 and c0+w//2<256", wide=True)
def p35(s):
    """Pixel of each box centre, truncated, kept when inside the raster."""
    b = G.bbox(F.col("rings")[0])
    d = s.rings.withColumn("b", b).join(s.catalog.select("raster_id", "gt_a", "gt_c", "gt_e", "gt_f", "width", "height"), "raster_id")
    row, col = G.to_pixel((F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2,
                          F.col("gt_a"), F.col("gt_c"), F.col("gt_e"), F.col("gt_f"))
    return d.select("raster_id", "feature_id", row.alias("row"), col.alias("col"), "width", "height").filter(
        "row >= 0 and col >= 0 and row < height and col < width").drop("width", "height")


@query("p01_pixel_size", "select raster_id, abs(gt_a) as pixel_size_m from catalog")
def p01(s):
    return s.catalog.select("raster_id", F.abs("gt_a").alias("pixel_size_m"))


@query("p36_reproject_mercator", """select raster_id, feature_id, round(degrees(x0/6378137.0e0),9) as lon,
  round(degrees(2.0e0*atan(exp(y1/6378137.0e0))-pi()/2),9) as lat, round(x0,3) as back_x, round(y1,3) as back_y from wbox""", wide=True)
def p36(s):
    p = F.col("rings")[0][0]
    lon, lat = G.mercator_to_lonlat(p["x"], p["y"])
    d = s.rings.select("raster_id", "feature_id", lon.alias("lon"), lat.alias("lat"))
    bx, by = G.lonlat_to_mercator(F.col("lon"), F.col("lat"))
    return d.select("raster_id", "feature_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"),
                    F.round(bx, 3).alias("back_x"), F.round(by, 3).alias("back_y"))


@query("p36_reproject_utm", wide=True)
def p36u(s):
    """UTM 43N corners to longitude and latitude and back."""
    p = F.col("rings")[0][0]
    lon, lat = G.utm_to_lonlat(p["x"], p["y"], 32643)
    d = s.rings.select("raster_id", "feature_id", lon.alias("lon"), lat.alias("lat"))
    bx, by = G.lonlat_to_utm(F.col("lon"), F.col("lat"), 32643)
    return d.select("*", bx.alias("back_x"), by.alias("back_y"))


@query("r19_rasterise_polygons", "select raster_id, class_id, count(*) as px, cast(sum(row*256+col) as bigint) as pos_sum from truth_px group by 1,2", wide=True)
def r19(s):
    """World rings burned by pixel centre; must equal the pixel-space burn."""
    from gridrun.queries.raster import px_summary
    m = burn_rings(s.rings, s.catalog)
    n = run_len()
    return m.groupBy("raster_id", "class_id").agg(F.sum(n).alias("px"), F.sum(
        F.col("row").cast("long") * s.side * n + ((F.col("c0") + F.col("c1")).cast("long") * n / 2).cast("long")).alias("pos_sum"))


@query("r27_feature_centroids", """with p as (select raster_id, feature_id, class_id, sum(turn*w*h*(r0+h/2.0e0))/sum(turn*w*h) as y, sum(turn*w*h*(c0+w/2.0e0))/sum(turn*w*h) as x from parts group by 1,2,3)
  select raster_id, feature_id, class_id, cast(floor(round(y,6)) as int) as row, cast(floor(round(x,6)) as int) as col from p where round(y,6)<256 and round(x,6)<256""", wide=True)
def r27(s):
    from gridrun.operators.catalog import feature_centroids
    return feature_centroids(s.shapes, s.catalog).select("raster_id", "feature_id", "class_id", "row", "col")


@query("a42_centroid_counts", """select coalesce(raster_id,-1) as raster_id, class_id, count(*) as n from (select raster_id, class_id from feat
  where r0+h/2.0e0<256 and c0+w/2.0e0<256) group by grouping sets ((raster_id,class_id),(class_id))""", wide=True)
def a42(s):
    from gridrun.operators.catalog import feature_centroids
    per = feature_centroids(s.rings, s.catalog).groupBy("raster_id", "class_id").agg(F.count("*").alias("n"))
    return per.unionByName(per.groupBy("class_id").agg(F.sum("n").alias("n")).withColumn("raster_id", F.lit(-1).cast("long")))


@query("j01_overlapping_layers", """with l as (select source, class_id, min(x0) x0, max(x1) x1, min(y0) y0, max(y1) y1 from wbox group by 1,2)
  select c.raster_id, l.class_id from catalog c join l on l.source=c.source where l.x0<c.gt_c+5.0e0*256 and l.x1>c.gt_c and l.y0<c.gt_f and l.y1>c.gt_f-5.0e0*256""", wide=True)
def j01(s):
    b = G.bbox(F.col("rings")[0])
    src = F.expr("case when raster_id%3=0 then 'north' when raster_id%3=1 then 'south' else 'delta' end")
    l = s.rings.select(src.alias("source"), "class_id", b.alias("b")).groupBy("source", "class_id").agg(
        F.min("b.x0").alias("x0"), F.max("b.x1").alias("x1"), F.min("b.y0").alias("y0"), F.max("b.y1").alias("y1"))
    return VE.overlapping_layers(l, VE.frame_box(s.catalog)).select("raster_id", "class_id")


@query("j02_window_candidates", """select w.raster_id, w.window_id, f.feature_id from windows w join feat f on f.raster_id=w.raster_id
  where f.c0<w.wc+w.ww and f.c0+f.w>w.wc and f.r0<w.wr+w.wh and f.r0+f.h>w.wr""")
def j02(s):
    return VE.window_candidates(s.features, windows(s)).select("raster_id", "window_id", "feature_id")


@query("j03_within_distance", """select b.raster_id, b.feature_id from feat b where class_id=2 and exists (select 1 from feat r where r.raster_id=b.raster_id and r.class_id=1
  and pow(greatest(r.c0-(b.c0+b.w), b.c0-(r.c0+r.w), 0),2)+pow(greatest(r.r0-(b.r0+b.h), b.r0-(r.r0+r.h), 0),2)<=16*16)""", wide=True)
def j03(s):
    """Sparse-class boxes with a road box within 80 m (16 px)."""
    f = s.features
    return VE.has_box_within(f.filter("class_id = 2"), f.filter("class_id = 1"), 16).select("raster_id", "feature_id")


@query("j04_clip_to_frame", "select raster_id, class_id, count(*) as polygons, round(sum(area_m2),3) as area_m2 from clipbox group by 1,2", wide=True)
def j04(s):
    return VE.clip_to_frame(s.shapes, s.catalog).groupBy("raster_id", "class_id").agg(
        F.count("*").alias("polygons"), F.round(F.sum("area_m2"), 3).alias("area_m2"))


@query("a28_vector_truth", """with p as (select raster_id, class_id, count(*) n, sum(area_m2) a from clipbox group by 1,2)
  select class_id, round(sum(a),2) as area_m2, cast(sum(cast(floor(a/25.0e0) as bigint)) as bigint) as px_estimate, count(*) as rasters, cast(sum(n) as bigint) as polygons from p group by 1""", wide=True)
def a28(s):
    per = VE.clip_to_frame(s.shapes, s.catalog).groupBy("raster_id", "class_id", (F.abs(F.col("gt_a") * F.col("gt_e"))).alias("px_area")).agg(
        F.count("*").alias("n"), F.round(F.sum("area_m2"), 6).alias("a"))
    return per.groupBy("class_id").agg(F.round(F.sum("a"), 2).alias("area_m2"), F.sum(F.floor(F.col("a") / F.col("px_area"))).alias("px_estimate"),
                                       F.count("*").alias("rasters"), F.sum("n").alias("polygons"))


@query("a29_stakeholder_indicators", """with p as (select c.raster_id, 1638400.0e0 as village, coalesce(sum(area_m2) filter (class_id=1),0) road, coalesce(sum(area_m2) filter (class_id=3),0) built,
  coalesce(sum(area_m2) filter (class_id=4),0) water, count(*) filter (class_id=1) n1, count(*) filter (class_id=3) n3, count(*) filter (class_id=4) n4
  from catalog c left join clipbox b using (raster_id) group by 1)
  select raster_id, round(100.0e0*road/village,6) as road_coverage_pct, round(100.0e0*built/village,6) as builtup_coverage_pct, round(100.0e0*water/village,6) as water_coverage_pct,
  round(100.0e0*(road+built)/village,6) as infrastructure_density_pct, n1 as road_segments_count, n3 as builtup_polygons_count, n4 as water_bodies_count,
  round(n3/(village/10000.0e0),6) as building_density_per_ha, round(n4/(village/1000000.0e0),6) as water_body_density_per_km2, round(built/nullif(water,0),6) as built_to_water_ratio from p""", wide=True)
def a29(s):
    from gridrun.plans.vector_reports import stakeholder_indicators
    d = stakeholder_indicators(VE.clip_to_frame(s.shapes, s.catalog), s.catalog)
    return d.select("raster_id", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes if c != "raster_id"])


@query("f06_empty_geometry", "select source, class_id, count(*) as kept from layr where defect is distinct from 'empty' group by 1,2", wide=True)
def f06(s):
    return s.layers.filter(F.size("rings") > 0).groupBy("source", "class_id").agg(F.count("*").alias("kept"))


@query("f12_invalid_geometry", "select raster_id, fid as feature_id, defect from layr where defect is not null", wide=True)
def f12(s):
    return VE.validity(s.layers).filter("defect is not null").select("raster_id", "feature_id", "defect")


@query("a30_geometry_defects", """with g as (select source, class_id, case when defect='empty' then 'E' else concat_ws('|', raster_id, c0, r0, w, h, case when defect is null or feature_id%41=0 then extra end, coalesce(defect,'')) end as shape, defect from layr),
  c as (select source, class_id, count(*) filter (defect is not null and defect<>'empty') as invalid, count(*) filter (defect='empty') as empty, count(*)-count(distinct shape) as duplicate from g group by 1,2)
  select e.source, e.class_id, coalesce(invalid,-1) as invalid, coalesce(empty,-1) as empty, coalesce(duplicate,-1) as duplicate from explayer e left join c using (source, class_id)""", wide=True)
def a30(s):
    return VE.layer_defects(s.layers, s.expected_layers).select("source", "class_id", "invalid", "empty", "duplicate")


@query("u08_geometry_dedup", """select source, class_id, count(distinct concat_ws('|', raster_id, c0, r0, w, h, case when defect is null or feature_id%41=0 then extra end, coalesce(defect,''))) as shapes from layr where defect is distinct from 'empty' group by 1,2""", wide=True)
def u08(s):
    d = s.layers.filter(F.size("rings") > 0).withColumn("wkt", G.rings_wkt(F.col("rings"))).dropDuplicates(["source", "class_id", "wkt"])
    return d.groupBy("source", "class_id").agg(F.count("*").alias("shapes"))


@query("a31_repair", wide=True)
def a31(s):
    """Defects per layer before and after the repair."""
    from gridrun.plans.vector_reports import repair_summary
    return repair_summary(s.layers, s.expected_layers)


@query("s04_layer_scan", """select source, class_id, count(*) as features from layr where class_id in (1,2,3,4) group by 1,2""", wide=True)
def s04(s):
    """Features of mapped layers; a missing layer is silently absent."""
    return s.layers.join(F.broadcast(s.classes.filter("class_id > 0").select("class_id")), "class_id").groupBy(
        "source", "class_id").agg(F.count("*").alias("features"))


@query("r31_split_parts", """select raster_id, feature_id, p as part, round(25.0e0*w*(case p when 0 then h//2 else h-h//2 end),6) as area_m2 from feat, (select unnest([0,1]) p)
  where feature_id%5=0 and (case p when 0 then h//2 else h-h//2 end)>0""", wide=True)
def r31(s):
    """Features stored as two stacked parts, split, empties dropped."""
    from gridrun.operators.catalog import split_parts
    pt = lambda c, r: F.struct((F.lit(500000.0) + F.col("raster_id") * 2000 + 5.0 * c).alias("x"), (F.lit(3200000.0) - 5.0 * r).alias("y"))
    box = lambda r0, r1: F.array(*[pt(c, r) for c, r in ((F.col("c0"), r0), (F.col("c1"), r0), (F.col("c1"), r1), (F.col("c0"), r1), (F.col("c0"), r0))])
    mid = F.col("r0") + F.floor(F.col("h") / 2)
    multi = s.features.filter("feature_id % 5 = 0").withColumn("c1", F.col("c0") + F.col("w")).select(
        "raster_id", "feature_id", F.array(box(F.col("r0"), mid), box(mid, F.col("r0") + F.col("h"))).alias("rings"))
    return split_parts(multi).select("raster_id", "feature_id", "part", F.round("area_m2", 6).alias("area_m2"))


@query("f08_attribute_and_intersects", "select raster_id, feature_id, cast(feature_id%6 as int) as roof_type from feat where class_id=3 and feature_id%6 in (1,2,3,4)", wide=True)
def f08(s):
    """Built-up features with a known code that meet their raster."""
    b = G.rings_bbox(F.col("rings"))
    f = s.shapes.filter("class_id = 3").withColumn("roof_type", F.expr("cast(feature_id % 6 as int)")).filter(F.col("roof_type").isin(1, 2, 3, 4))
    d = f.withColumn("b", b).join(VE.frame_box(s.catalog).select("raster_id", "fx0", "fx1", "fy0", "fy1"), "raster_id")
    return d.filter("b.x0 <= fx1 and b.x1 >= fx0 and b.y0 <= fy1 and b.y1 >= fy0").select("raster_id", "feature_id", "roof_type")


@query("f09_crop_gate", """select raster_id, feature_id, round(least(c0+w+0.1e0*w,256.0e0)-greatest(c0-0.1e0*w,0.0e0),6) as crop_w, round(least(r0+h+0.1e0*h,256.0e0)-greatest(r0-0.1e0*h,0.0e0),6) as crop_h
  from feat where least(c0+w+0.1e0*w,256.0e0)-greatest(c0-0.1e0*w,0.0e0)>=16 and least(r0+h+0.1e0*h,256.0e0)-greatest(r0-0.1e0*h,0.0e0)>=16""", wide=True)
def f09(s):
    from gridrun.operators.catalog import crop_boxes
    return crop_boxes(s.rings, s.catalog, min_side=16).select(
        "raster_id", "feature_id", F.round("crop_w", 6).alias("crop_w"), F.round("crop_h", 6).alias("crop_h"))
