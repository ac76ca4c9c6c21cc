"""Inventory, manifest, sink and data-quality queries."""

from pyspark.sql import functions as F

from gridrun.functions import rules as RU
from gridrun.operators import quality as QU
from gridrun.operators.runs import run_len
from gridrun.queries.registry import CTES, query
from gridrun.sources import inventory as IN
from gridrun.sources import sinks as SI
from gridrun.constants import CLASSES
from gridrun.operators.onerow import with_row

CTES.update({
    "manifest": """select asset_id, path, case when asset_id%19=0 then '0'||substr(sha256,2) when asset_id%13=0 then upper(sha256) else sha256 end as sha256 from assets""",
    "preds": """select stem||'_pred_mask' as pred_stem, stem, epsg, gt_a, case when raster_id%9=0 then gt_c+5 else gt_c end as gt_c, gt_e, gt_f, width, case when raster_id%8=0 then 255 else height end as height from catalog where raster_id%6<>0
   union all select 'orphan_'||raster_id||'_pred_mask', 'orphan_'||raster_id, epsg, gt_a, gt_c, gt_e, gt_f, width, height from catalog where raster_id%10=0""",
    "issues": """select 'critical' as severity, 'integrity' as category, source, stem as asset, 'Unreadable raster' as message from catalog where not readable
   union all select 'critical','crs',source,stem,'Missing CRS' from catalog where readable and epsg is null
   union all select 'high','crs',source,stem,'Unexpected EPSG: '||epsg from catalog where readable and epsg not in (32643,32644,3857)
   union all select 'critical','annotation',source,source||'/class_'||class_id,'Missing layer' from explayer where (source,class_id) not in (select (source,class_id) from layr)
   union all select 'high','geometry',source,source||'/class_'||class_id,'Invalid geometries: '||count(*) from layr where defect is not null and defect<>'empty' group by source, class_id""",
    "shop": """select doc_id as asset_id, case when doc_id%13=0 then '' when doc_id%17=0 then '../x.png' when doc_id%19=0 then repeat('a',300)||'.png' when doc_id%7=0 then 'f'||doc_id||'.gif' else 'f'||doc_id||'.PNG' end as name,
   case when doc_id%11=0 then 'text/plain' else 'image/png' end as mime, case when doc_id%23=0 then 0 else n_chars*20000 end as bytes, n_chars as max_dim from documents""",
})


@query("s01_asset_scan")
def s01(s):
    """Files of the input folder, tagged by kind of table."""
    return IN.scan_files(s.spark, f"{s.sf_dir}/*.parquet", {"text": "documents", "vector": "lineitem", "raster": "supplier", "events": "events"})


@query("s02_raster_inventory", "select raster_id, stem, readable, case when readable then null else 'cannot open raster' end as error from catalog")
def s02(s):
    return s.catalog.select("raster_id", "stem", "readable", F.when(~F.col("readable"), "cannot open raster").alias("error"))


@query("s09_mask_sink", "select raster_id, class_id, count(*) as runs, cast(sum(c1-c0+1) as bigint) as px from px_runs group by 1,2", wide=True)
def s09(s):
    """Mask written by row strip and read back."""
    path = SI.scratch_path(s.spark, "mask")
    SI.write_mask(s.truth, path, strip=64)
    return SI.read_mask(s.spark, path).groupBy("raster_id", "class_id").agg(F.count("*").alias("runs"), F.sum(run_len()).alias("px"))


@query("s10_layer_sink", "select d.layer, count(c.comp_id) as n from (values ('roads',1),('building_footprints',3),('water_bodies',4),('bridges_large',2)) d(layer,k) left join comps c on c.class_id=d.k and c.area_px>=200 group by 1", wide=True)
def s10(s):
    from gridrun.operators.components import component_stats
    name = F.expr("case class_id when 1 then 'roads' when 2 then 'bridges_large' when 3 then 'building_footprints' else 'water_bodies' end")
    path = SI.scratch_path(s.spark, "layers")
    SI.write_layers(s.component_stats.filter("area_px >= 200").withColumn("layer", name), path)
    names = s.classes.filter("class_id > 0").select(name.alias("layer"))
    return SI.layer_counts(s.spark.read.parquet(path), names)


@query("s11_json_sink", "select raster_id, class_id, count(*) as px from truth_px group by 1,2", wide=True)
def s11(s):
    path = SI.scratch_path(s.spark, "report")
    d = s.truth.groupBy("raster_id", "class_id").agg(F.sum(run_len()).alias("px"))
    SI.write_json(d, path)
    return s.spark.read.schema("raster_id long, class_id int, px long").json(path)


@query("s12_csv_sink", "select raster_id, class_id, count(*) as px from truth_px group by 1,2", wide=True)
def s12(s):
    path = SI.scratch_path(s.spark, "table")
    SI.write_csv(s.truth.groupBy("raster_id", "class_id").agg(F.sum(run_len()).alias("px")), path)
    return s.spark.read.schema("raster_id long, class_id int, px long").option("header", True).csv(path)


@query("s13_manifest", "select concat('doc_',cast(doc_id as varchar),'.txt') as path, sha256(text) as sha256, cast(octet_length(encode(text)) as bigint) as bytes from documents")
def s13(s):
    return IN.manifest(s.table("documents").withColumn("path", F.expr("concat('doc_', cast(doc_id as string), '.txt')")), "text")


@query("s14_manifest_check", """select m.path, case when a.sha256 is null then 'missing' when lower(a.sha256)<>lower(m.sha256) then 'checksum mismatch' else 'ok' end as status
  from manifest m left join (select * from assets where asset_id%17<>0) a on a.path=m.path""")
def s14(s):
    m = s.assets.withColumn("sha256", F.expr("case when asset_id%19=0 then concat('0', substr(sha256,2)) when asset_id%13=0 then upper(sha256) else sha256 end"))
    return IN.verify_manifest(m, s.assets.filter("asset_id % 17 <> 0")).select("path", "status")


@query("s15_provenance", "select class_id, count(*) as px, 'gridrun' as tool, 'calibrated' as variant, 5.0e0 as pixel_size_m from truth_px group by 1", wide=True)
def s15(s):
    d = s.truth.groupBy("class_id").agg(F.sum(run_len()).alias("px"))
    d = d.withColumn("provenance", F.struct(F.lit("gridrun").alias("tool"), F.lit("calibrated").alias("variant"), F.lit(5.0).alias("pixel_size_m"), F.current_timestamp().alias("at")))
    return d.select("class_id", "px", "provenance.tool", "provenance.variant", "provenance.pixel_size_m")


@query("s16_required_keys", """select array_to_string(list_filter(['k','source','id'], lambda x: not list_contains(json_keys(props), x)), ',') as missing, count(*) as docs from events group by 1""")
def s16(s):
    d = IN.missing_keys(s.table("events"), "props", ["k", "source", "id"])
    return d.groupBy(F.array_join("missing", ",").alias("missing")).agg(F.count("*").alias("docs"))


PCT = ", ".join(f"round(100.0e0*count(*) filter (class_id={k})/16384,6) as pct{k}" for k in range(1, 5))


@query("s17_tile_manifest", f"select raster_id, cast(row//64 as int) as tile, {PCT}, true as matches from truth_px group by 1,2")
def s17(s):
    """Tile manifests with class shares, one JSON document per raster, written, read back and recomputed."""
    px = s.mask.withColumn("tile", F.floor(F.col("row") / 64).cast("int")).groupBy("raster_id", "tile").agg(
        *[F.coalesce(F.sum(F.when(F.col("class_id") == k, run_len())), F.lit(0)).alias(f"px{k}") for k in range(1, 5)])
    path = SI.scratch_path(s.spark, "manifest")
    tiles = F.collect_list(F.struct("tile", *[(100.0 * F.col(f"px{k}") / 16384).alias(f"pct{k}") for k in range(1, 5)]))     # as many as a raster has tiles
    SI.write_json(px.groupBy("raster_id").agg(tiles.alias("tiles")), path)
    back = s.spark.read.schema("raster_id long, tiles array<struct<tile:int,pct1:double,pct2:double,pct3:double,pct4:double>>").json(path)
    t = back.select("raster_id", F.explode("tiles").alias("m")).select("raster_id", "m.*").join(px, ["raster_id", "tile"])
    same = [F.abs(F.col(f"pct{k}") - 100.0 * F.col(f"px{k}") / 16384) < 1e-9 for k in range(1, 5)]
    return t.select("raster_id", "tile", *[F.round(f"pct{k}", 6).alias(f"pct{k}") for k in range(1, 5)], (same[0] & same[1] & same[2] & same[3]).alias("matches"))


@query("s05_config_load", """select 'split' as part, split as name, count(*) as n, cast(sum(length(stem)) as bigint) as chars from catalog group by 1,2
  union all select 'class', name, 1, cast(red+green+blue as bigint) from dim_class""")
def s05(s):
    """Configuration documents written as JSON, a thousand rasters in each, and loaded as class and split dimensions."""
    path = SI.scratch_path(s.spark, "config")
    stems = lambda split: F.collect_list(F.when(F.col("split") == split, F.col("stem")))
    splits = s.catalog.groupBy(F.floor(F.col("raster_id") / 1000).alias("part")).agg(stems("train").alias("train_tiffs"), stems("val").alias("val_tiffs"))
    classes = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(n).alias("name"), F.array(*map(F.lit, rgb)).alias("color_rgb")) for k, (n, *rgb) in CLASSES.items()])
    SI.write_json(splits.select(classes.alias("classes"), F.struct("train_tiffs", "val_tiffs").alias("splits")), path)
    cfg = IN.load_config(s.spark, path, lines=True)
    by_split = cfg["splits"].groupBy(F.lit("split").alias("part"), F.col("split").alias("name")).agg(F.count("*").alias("n"), F.sum(F.length("stem")).alias("chars"))
    return by_split.unionByName(cfg["classes"].select(F.lit("class").alias("part"), "name", F.lit(1).cast("long").alias("n"), F.expr("cast(red+green+blue as bigint)").alias("chars")))


@query("s18_quarantine", "select raster_id, 'moved' as action from catalog where not readable")
def s18(s):
    return SI.quarantine(s.catalog, SI.scratch_path(s.spark, "good"), SI.scratch_path(s.spark, "bad"), apply=True)


@query("f01_split_filter", "select raster_id, stem from catalog where split='val'")
def f01(s):
    return IN.split_filter(s.catalog, s.catalog.select("stem", "split"), "val").select("raster_id", "stem")


@query("f01_empty_split", "select raster_id, stem from catalog")
def f01b(s):
    """No raster is listed for this split, so nothing is filtered."""
    return IN.split_filter(s.catalog, s.catalog.select("stem", "split"), "holdout").select("raster_id", "stem")


@query("f02_drop_small_rasters", "select raster_id, case when raster_id%5=0 then 64 else 256 end as side from catalog where case when raster_id%5=0 then 64 else 256 end>=128")
def f02(s):
    return s.catalog.withColumn("side", F.expr("case when raster_id%5=0 then 64 else 256 end")).filter("side >= 128").select("raster_id", "side")


@query("f07_crs_rules", "select severity, asset, message from issues where category='crs'", wide=True)
def f07(s):
    return QU.crs_issues(s.catalog).select("severity", "asset", "message")


@query("f13_classes_present", "select raster_id, count(*) as n_classes from (select raster_id, class_id from truth_px group by 1,2 having 100.0e0*count(*)/65536>0.1) group by 1", wide=True)
def f13(s):
    return s.truth.groupBy("raster_id", "class_id").agg((100.0 * F.sum(run_len()) / s.side**2).alias("pct")).filter("pct > 0.1").groupBy(
        "raster_id").agg(F.count("*").alias("n_classes"))


@query("j14_missing_layers", "select source, class_id from explayer where (source,class_id) not in (select (source,class_id) from layr)", wide=True)
def j14(s):
    return QU.missing_layers(s.layers, s.expected_layers)


def _preds(s):
    c = s.catalog
    a = c.filter("raster_id % 6 <> 0").withColumn("pred_stem", F.concat("stem", F.lit("_pred_mask"))).withColumn(
        "gt_c", F.expr("case when raster_id%9=0 then gt_c+5 else gt_c end")).withColumn("height", F.expr("case when raster_id%8=0 then 255 else height end"))
    b = c.filter("raster_id % 10 = 0").withColumn("pred_stem", F.expr("concat('orphan_', cast(raster_id as string), '_pred_mask')"))
    cols = ["pred_stem", "epsg", "gt_a", "gt_c", "gt_e", "gt_f", "width", "height"]
    d = a.select(*cols).unionByName(b.select(*cols))
    return d.withColumn("stem", F.regexp_replace("pred_stem", "_pred_mask$", ""))


@query("j15_source_pairing", "select p.pred_stem, c.stem as source_stem, case when c.stem is null then 'FAIL' else 'FOUND' end as status from preds p left join catalog c using (stem)")
def j15(s):
    d = _preds(s).join(s.catalog.select("stem", F.col("stem").alias("source_stem")), "stem", "left")
    return d.select("pred_stem", "source_stem", F.when(F.col("source_stem").isNull(), "FAIL").otherwise("FOUND").alias("status"))


@query("p40_grid_match", """select p.pred_stem, c.stem is not null and p.epsg is not distinct from c.epsg as crs_match, coalesce(p.gt_c=c.gt_c,false) as transform_match, coalesce(p.height=c.height,false) as shape_match,
  case when p.gt_c=c.gt_c and p.height=c.height then 1.0e0 else 0.0e0 end as pixel_alignment_score, case when c.stem is not null and p.gt_c=c.gt_c then 1.0e0 else 0.0e0 end as geometry_alignment_score,
  case when p.gt_c=c.gt_c and p.height=c.height then 'PASS' else 'FAIL' end as status from preds p left join catalog c using (stem)""")
def p40(s):
    src = s.catalog.select("stem", *[F.col(c).alias(f"s_{c}") for c in ("epsg", "gt_a", "gt_c", "gt_e", "gt_f", "width", "height")])
    return QU.grid_match(_preds(s), src).select("pred_stem", "crs_match", "transform_match", "shape_match", "pixel_alignment_score", "geometry_alignment_score", "status")


@query("j17_class_lookup", "select t.raster_id, d.name, count(*) as px from truth_px t join dim_class d using (class_id) group by 1,2", wide=True)
def j17(s):
    d = s.truth.groupBy("raster_id", "class_id").agg(F.sum(run_len()).alias("px"))
    return d.join(F.broadcast(s.classes), "class_id").select("raster_id", "name", "px")


@query("j21_first_existing", """with c as (select doc_id as key, p.v as priority, concat('doc_',cast(doc_id+p.v as varchar),'.txt') as path from documents, (select unnest([0,1,2]) v) p)
  select k.key, b.path from (select distinct key from c) k left join (select key, arg_min(c.path, priority) as path from c join (select path from assets where asset_id%3=0) a on a.path=c.path group by 1) b using (key)""")
def j21(s):
    c = s.table("documents").select(F.col("doc_id").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("priority")).withColumn(
        "path", F.expr("concat('doc_', cast(key + priority as string), '.txt')"))
    return IN.first_existing(c, s.assets.filter("asset_id % 3 = 0"))


@query("p27_asset_admission", """select asset_id, case when name='' then 'missing name' when name like '../%' then 'unsafe name' when length(name)>255 then 'name too long' when name like '%.gif' then 'unsupported extension'
  when mime='text/plain' then 'unsupported type' when bytes=0 then 'empty file' when bytes>67108864 then 'file too large' when max_dim>8192 then 'dimension too large' else 'ok' end as verdict from shop""")
def p27(s):
    d = s.table("documents").selectExpr(
        "doc_id as asset_id", "case when doc_id%13=0 then '' when doc_id%17=0 then '../x.png' when doc_id%19=0 then concat(repeat('a',300),'.png') when doc_id%7=0 then concat('f',doc_id,'.gif') else concat('f',doc_id,'.PNG') end as name",
        "case when doc_id%11=0 then 'text/plain' else 'image/png' end as mime", "case when doc_id%23=0 then 0 else n_chars*20000 end as bytes", "n_chars as max_dim")
    return d.select("asset_id", RU.admission().alias("verdict"))


@query("p37_tile_estimate", """select raster_id, cast(36 as bigint) as tiles, round(9*7.0e0*3+8.0e0,6) as seconds from catalog""")
def p37(s):
    t = RU.count_tiles(F.col("height"), F.col("width"), 64, 32 - 8)
    return s.catalog.select("raster_id", t.alias("tiles"), F.round(RU.inference_seconds(t, F.col("height"), F.col("width"), gpu=False, flips=True), 6).alias("seconds"))


@query("p38_patch_stats", "select raster_id, round(count(*) filter (class_id=1)*5.0e0,1) as road_length_m, round(count(*) filter (class_id=4)*25.0e0,1) as water_area_m2, round(count(*) filter (class_id=3)*25.0e0,1) as builtup_area_m2 from truth_px group by 1")
def p38(s):
    px = lambda k: F.coalesce(F.sum(F.when(F.col("class_id") == k, run_len())), F.lit(0))
    return s.truth.groupBy("raster_id").agg(F.round(px(1) * 5.0, 1).alias("road_length_m"), F.round(px(4) * 25.0, 1).alias("water_area_m2"), F.round(px(3) * 25.0, 1).alias("builtup_area_m2"))


def _issues(s):
    return QU.preflight(s.catalog, s.layers, s.expected_layers)


@query("a49_preflight", "select * from issues", wide=True)
def a49(s):
    return _issues(s)


VERD = "select count(*) filter (severity in ('critical','high'))=0 as ok, count(*) filter (severity='critical') as critical, count(*) filter (severity='high') as high, count(*) as issues from issues"


@query("a48_verdict", VERD, wide=True)
def a48(s):
    return QU.verdict(_issues(s))


@query("t04_first_issues", "select * from issues order by severity, category, asset, message limit 10", wide=True)
def t04(s):
    return _issues(s).orderBy("severity", "category", "asset", "message").limit(10)


@query("q09_validation_report", f"select v.*, (select count(*) from catalog) as rasters, (select count(*) from explayer) as layers, cast(coalesce((select count(*) from issues where category='crs'),0) as bigint) as crs_issues from ({VERD}) v", wide=True)
def q09(s):
    v = QU.verdict(_issues(s))
    n = s.catalog.agg(F.count("*").alias("rasters"))
    l = s.expected_layers.agg(F.count("*").alias("layers"))
    c = QU.crs_issues(s.catalog).agg(F.count("*").alias("crs_issues"))
    return v.transform(with_row, n).transform(with_row, l).transform(with_row, c)      # one row each


@query("q10_remediation_run")
def q10(s):
    """Scan, repair and truth counts of a remediation, one row per layer."""
    from gridrun.operators.vector import clip_to_frame
    from gridrun.plans.vector_reports import repair_summary
    scan = s.catalog.agg(F.count_if(F.col("readable")).alias("readable"), F.count_if(~F.col("readable")).alias("quarantined"))
    truth = clip_to_frame(s.shapes, s.catalog).groupBy("class_id").agg(F.round(F.sum("area_m2"), 2).alias("clipped_area_m2"))
    return repair_summary(s.layers, s.expected_layers).transform(with_row, scan).join(truth, "class_id", "left")


@query("u05_multi_source_union", "select source, count(*) as rasters from catalog group by 1")
def u05(s):
    parts = [s.catalog.filter(F.col("source") == k).drop("source").withColumn("source", F.lit(k)) for k in ("north", "south", "delta")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("rasters"))


@query("u06_key_difference", "select 'missing' as kind, stem from catalog where stem not in (select stem from preds) union all select 'unexpected', stem from preds where stem not in (select stem from catalog)")
def u06(s):
    a, b = s.catalog.select("stem"), _preds(s).select("stem")
    return a.exceptAll(b).select(F.lit("missing").alias("kind"), "stem").unionByName(b.exceptAll(a).select(F.lit("unexpected").alias("kind"), "stem"))


@query("a40_attribute_coverage", """with f as (select case when feature_id%6 in (1,2,3,4) then cast(feature_id%6 as int) end as code from feat where class_id=3)
  select code, count(*) as n, round(count(*)*1.0e0/(select count(*) from f),6) as share, round((select count(code)*1.0e0/count(*) from f),6) as coverage from f group by 1""", wide=True)
def a40(s):
    f = s.features.filter("class_id = 3").select(F.expr("case when feature_id%6 in (1,2,3,4) then cast(feature_id%6 as int) end").alias("code"))
    g = f.groupBy("code").agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("code").isNotNull(), F.col("n"))).alias("k"))
    return g.transform(with_row, t).select("code", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), F.round(F.col("k") / F.col("t"), 6).alias("coverage"))
