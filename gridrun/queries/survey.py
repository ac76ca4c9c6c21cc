"""Village, spatial, explainability and visit-queue queries."""

from pyspark.sql import functions as F

from gridrun.functions import scoring as SC
from gridrun.operators.burn import box_layer
from gridrun.operators.ranking import keep_spaced, number_in_frame, top_k
from gridrun.operators.runs import run_len
from gridrun.plans import spatial as SP
from gridrun.plans import visits as V
from gridrun.queries.registry import CTES, query, rd
from gridrun.session import durable
from gridrun.sources.fixtures import GSD, SIDE

FRAME = (SIDE, SIDE)

CTES.update({
    "csum": """select c.raster_id, 65536 as total_px,
  cast(coalesce(sum(area_px) filter (class_id=1),0) as bigint) road_px, count(*) filter (class_id=1) road_components,
  count(*) filter (class_id=1 and area_px>=100) road_segments, coalesce(max(area_px) filter (class_id=1),0) largest_road,
  cast(coalesce(sum(area_px) filter (class_id=3),0) as bigint) builtup_px, count(*) filter (class_id=3) builtup_components,
  count(*) filter (class_id=3 and area_px>=200) clusters, count(*) filter (class_id=3 and area_px between 50 and 50000) n_buildings,
  cast(coalesce(sum(area_px) filter (class_id=3 and area_px between 50 and 50000),0) as bigint) building_px,
  count(*) filter (class_id=3 and area_px between 100 and 8000 and greatest(bw,bh)*1.0e0/least(bw,bh)<=6.0 and area_px*1.0e0/(bw*bh)>=0.40) rooftops,
  cast(coalesce(sum(area_px) filter (class_id=4),0) as bigint) water_px, count(*) filter (class_id=4) water_components,
  count(*) filter (class_id=4 and area_px>=200) water_bodies_200, count(*) filter (class_id=4 and area_px>=500) water_bodies_500,
  coalesce(max(area_px) filter (class_id=4 and area_px>=200),0) largest_water,
  cast(coalesce(sum(area_px) filter (class_id=2),0) as bigint) bridge_px, count(*) filter (class_id=2 and area_px>=30) bridges
  from catalog c left join comps using (raster_id) group by 1""",
    "nearsum": """select t.raster_id, count(*) as bu_px, count(r.row) as near_road_px, count(w.row) as near_water_px
  from truth_px t left join near_road r using (raster_id,row,col) left join near_water w using (raster_id,row,col) where t.class_id=3 group by 1""",
    "smeas": """select s.*, coalesce(n.bu_px,0) as bu_px, 100.0e0*largest_road/greatest(road_px,1) as largest_pct,
  clusters/greatest(coalesce(n.bu_px,0)/10000.0e0, 0.01e0) as frag,
  100.0e0*coalesce(near_road_px,0)/greatest(coalesce(bu_px,0),1) as road_pct,
  100.0e0*coalesce(near_water_px,0)/greatest(coalesce(bu_px,0),1) as water_pct, road_px*5.0e0/3.0e0 as length_m
  from csum s left join nearsum n using (raster_id)""",
    "bu_comp": """select p.raster_id, p.comp_id, count(*) as area_px, avg(p.col) as cx, avg(p.row) as cy, avg(conf) as mean_conf,
  count(r.row) as nr, count(w.row) as nw from
  (select raster_id, comp_id, row, unnest(range(c0,c1+1)) as col from comp_runs where class_id=3) p
  join conf_px using (raster_id,row,col) left join near_road r using (raster_id,row,col) left join near_water w using (raster_id,row,col) group by 1,2""",
    "frag_r": f"""select raster_id, {rd("count(*) filter (area_px>=200)/greatest(sum(area_px)/10000.0e0,0.01e0)", 2)} as frag from bu_comp group by 1""",
    "zone_c": """select u.raster_id, u.comp_id, count(*) as area_px, avg(u.col) as cx, avg(u.row) as cy, avg(conf) as mean_conf,
  count(t.row) as bu, count(w.row) as nw from u_px u join conf_px using (raster_id,row,col)
  left join (select raster_id,row,col from truth_px where class_id=3) t using (raster_id,row,col)
  left join near_water w using (raster_id,row,col) group by 1,2 having count(*)>=500 and count(t.row)<=0.5*count(*)""",
    "cand0": """select raster_id, 0 as kind, row_number() over (partition by raster_id order by comp_id) as idx, area_px, cx, cy, mean_conf,
    100.0e0*nr/area_px as road_pct, 100.0e0*nw/area_px as water_pct from bu_comp where area_px>=200
  union all select raster_id, 1, row_number() over (partition by raster_id order by comp_id), area_px, cx, cy, mean_conf, 0.0e0, 100.0e0*nw/area_px from zone_c""",
    "cand1": f"""select c.*, coalesce(f.frag,0.0e0) as frag, area_px*25.0e0 as area_m2,
  {rd("least(greatest((1.0e0-mean_conf)*100,0),100)", 2)} as confidence_risk,
  case when kind=0 then case when road_pct<=0 then 100.0e0 else {rd("least(greatest(100.0e0-road_pct,0),100)", 2)} end
    else {rd("least(greatest(least(greatest((1.0e0-mean_conf)*100,0),100)*0.6e0,0),100)", 2)} end as isolation_risk,
  {rd("least(greatest(sqrt(greatest(area_px*25.0e0,1))*4.0e0,0),100)", 2)} as cluster_size,
  {rd("least(greatest(water_pct,0),100)", 2)} as water_proximity,
  {rd("least(greatest(least(coalesce(f.frag,0.0e0)*10.0e0,100),0),100)", 2)} as fragmentation_context
  from cand0 c left join frag_r f using (raster_id)""",
    "cand": """select *, least(greatest(0.35e0*confidence_risk+0.30e0*isolation_risk+0.20e0*cluster_size+0.10e0*water_proximity
  +0.05e0*fragmentation_context,0),100) as score, case kind when 0 then 'settlement_cluster' else 'uncertain_zone' end as item_type,
  case kind when 0 then 'Settlement Cluster ' else 'Uncertain Zone ' end || idx as label,
  case when kind=1 then 'n/a' when road_pct<=0 then 'isolated' when road_pct<70 then 'partial' else 'connected' end as access from cand1""",
    "ranked": "select *, row_number() over (partition by raster_id order by score desc, kind, idx) as pos from cand",
    "walk": """select raster_id, cast(0 as bigint) as pos, cast([] as struct(pos bigint, cx double, cy double)[]) as kept
    from (select distinct raster_id from ranked)
  union all select w.raster_id, r.pos, case when len(w.kept)<10 and len(list_filter(w.kept, lambda k: (k.cx-r.cx)*(k.cx-r.cx)+(k.cy-r.cy)*(k.cy-r.cy)<36))=0
    then list_append(w.kept, {'pos': r.pos, 'cx': r.cx, 'cy': r.cy}) else w.kept end
  from walk w join ranked r on r.raster_id=w.raster_id and r.pos=w.pos+1""",
    "kept": """select raster_id, k.pos as pos from (select raster_id, unnest(arg_max(kept, pos)) as k from walk group by 1)""",
    "queue": f"""select raster_id, row_number() over (partition by raster_id order by pos) as rank, {rd('score',1)} as score,
  {rd('cx',1)} as centroid_x_px, {rd('cy',1)} as centroid_y_px, item_type, label,
  label || ': ' || coalesce(nullif(concat_ws(', ',
   case when isolation_risk>=70 then case when access<>'n/a' then 'poor road access' else 'low-confidence region' end
        when access='isolated' then 'isolated from road network' end,
   case when confidence_risk>=50 then 'low model confidence' end, case when cluster_size>=40 then 'large settlement footprint' end,
   case when water_proximity>=30 then 'near water body (setback review)' end,
   case when fragmentation_context>=40 then 'dispersed settlement context' end), ''),
   case kind when 1 then 'model uncertainty requires field confirmation' else 'routine verification recommended' end) as reason,
  {rd('area_m2',1)} as settlement_area_m2, case when kind=0 then greatest(1, cast(round_even(area_m2/80.0e0,0) as bigint)) else 0 end as n_structures,
  {rd('mean_conf',4)} as mean_confidence, access, confidence_risk, isolation_risk, cluster_size, water_proximity, fragmentation_context,
  {rd('score',2)} as weighted_total from ranked join kept using (raster_id, pos)""",
})


def _measures(s):
    return SP.spatial_measures(s.mask, s.components_of_mask, s.catalog, GSD, FRAME)


def _stats(s):
    return s.component_stats


@query("a18_road_components", f"select raster_id, road_components, largest_road, {rd('100.0e0*largest_road/greatest(road_px,1)')} as largest_pct from csum", wide=True)
def a18(s):
    return SP.raster_base(s.truth, s.component_stats, s.catalog).select(
        "raster_id", "road_components", "largest_road", F.round(SC.pct(F.col("largest_road"), F.col("road_px")), 6).alias("largest_pct"))


@query("a19_fragmentation", "select raster_id, clusters, round(clusters/greatest(builtup_px/10000.0e0,0.01e0),6) as fragmentation from csum", wide=True)
def a19(s):
    return SP.raster_base(s.truth, s.component_stats, s.catalog).select(
        "raster_id", "clusters", F.round(F.col("clusters") / F.greatest(F.col("builtup_px") / 10000.0, F.lit(0.01)), 6).alias("fragmentation"))


@query("a20_builtup_access", "select raster_id, round(100.0e0*near_road_px/greatest(bu_px,1),6) as road_access_pct, round(100.0e0*near_water_px/greatest(bu_px,1),6) as water_proximity_pct from nearsum")
def a20(s):
    return SP.builtup_nearness(s.truth, GSD, FRAME).select(
        "raster_id", F.round(SC.pct(F.col("near_road_px"), F.col("bu_px")), 6).alias("road_access_pct"),
        F.round(SC.pct(F.col("near_water_px"), F.col("bu_px")), 6).alias("water_proximity_pct"))


I6 = lambda c: f"cast(cast(round(cast(round({c},6) as decimal(24,6)),0) as bigint) as varchar)"
RECS = f"""array_to_string(list_filter([
  case when road_components>5 and largest_pct<60 then 'Road network is fragmented (' || road_components || ' segments; largest covers ' || {I6('largest_pct')} || '% of road pixels). Prioritize connectivity gaps for survey.' end,
  case when road_pct<70 and bu_px>0 then 'Only ' || {I6('road_pct')} || '% of built-up area is within ~50 m of mapped roads. Field verification recommended for remote settlements.' end,
  case when water_pct>15 and bu_px>0 then {I6('water_pct')} || '% of built-up area is within ~30 m of water bodies. Review setback compliance and flood exposure.' end,
  case when clusters>0 and frag>8 then 'Settlement appears dispersed (' || clusters || ' built-up clusters). Consider cluster-based property mapping workflow.' end],
  lambda x: x is not null), ' | ')"""
DEFREC = "Infrastructure layout appears coherent. Proceed with automated mapping; spot-check low-confidence zones flagged in explainability report."


@query("a21_spatial_intelligence", f"""select raster_id, 5.0e0 as pixel_size_m, {rd('length_m',1)} as road_total_length_m, road_components as road_connected_components,
  {rd('largest_pct',1)} as road_largest_component_pct, clusters as builtup_clusters, {rd('road_pct',1)} as builtup_road_access_pct,
  {rd('water_pct',1)} as builtup_water_proximity_pct, water_bodies_500 as water_bodies, {rd('water_px*25.0e0',1)} as water_total_area_m2,
  {rd('frag',2)} as settlement_fragmentation_index, coalesce(nullif({RECS},''),'{DEFREC}') as recommendations from smeas""")
def a21(s):
    return SP.spatial_report(_measures(s), GSD).withColumn("recommendations", F.array_join("recommendations", " | "))


@query("p23_recommendations", f"select raster_id, coalesce(nullif({RECS},''),'{DEFREC}') as advice from smeas")
def p23(s):
    return _measures(s).select("raster_id", F.array_join(SC.recommendations(), " | ").alias("advice"))


ACC = "least(greatest(100.0e0*(0.40e0*(a/100.0e0)+0.30e0*(l/100.0e0)+0.30e0*(1.0e0-least(f/10.0e0,1.0e0))),0),100)"


@query("p24_accessibility_score", f"""select raster_id, {rd(ACC,1)} as village_accessibility_score from
  (select raster_id, {rd('road_pct',1)} a, {rd('largest_pct',1)} l, {rd('frag',2)} f from smeas)""")
def p24(s):
    return SP.spatial_report(_measures(s), GSD).select("raster_id", SC.rnd(SC.accessibility_score(), 1).alias("village_accessibility_score"))


@query("a22_infrastructure_summary", f"""select raster_id, {rd('100.0e0*road_px/total_px',2)} as road_pct, {rd('100.0e0*water_px/total_px',2)} as water_pct,
  {rd('100.0e0*builtup_px/total_px',2)} as builtup_pct, bridge_px, clusters as n_buildings, water_bodies_500 as n_water_bodies from csum""", wide=True)
def a22(s):
    p = lambda c: SC.rnd(SC.pct(F.col(c), F.col("total_px")), 2)
    return SP.raster_base(s.truth, s.component_stats, s.catalog).select(
        "raster_id", p("road_px").alias("road_pct"), p("water_px").alias("water_pct"), p("builtup_px").alias("builtup_pct"),
        "bridge_px", F.col("clusters").alias("n_buildings"), F.col("water_bodies_500").alias("n_water_bodies"))


VIL = f"""raster_id, {rd('total_px*25.0e0',1)} as total_area_m2, {rd('total_px*25.0e0/10000',2)} as total_area_ha,
  road_px, {rd('road_px*25.0e0',1)} as road_area_m2, {rd('100.0e0*road_px/total_px',2)} as road_coverage_pct, {rd('road_px*5.0e0/3.0e0',1)} as road_length_m,
  0.0e0 as road_avg_width_m, road_components, road_segments, builtup_px, {rd('builtup_px*25.0e0',1)} as builtup_area_m2,
  {rd('100.0e0*builtup_px/total_px',2)} as builtup_coverage_pct, builtup_components, n_buildings,
  case when n_buildings>0 then {rd('building_px*1.0e0/n_buildings*25.0e0',1)} else 0.0e0 end as avg_building_area_m2,
  {rd('n_buildings/greatest(total_px*25.0e0/10000,0.01e0)',1)} as building_density_per_ha, rooftops as rooftop_count,
  water_px, {rd('water_px*25.0e0',1)} as water_area_m2, {rd('100.0e0*water_px/total_px',2)} as water_coverage_pct, water_components,
  water_bodies_200 as n_water_bodies, {rd('largest_water*25.0e0',1)} as largest_body_m2, bridge_px, {rd('bridge_px*25.0e0',1)} as bridge_area_m2,
  {rd('100.0e0*bridge_px/total_px',2)} as bridge_coverage_pct, bridges as n_bridges"""
COV = f"(select raster_id, {rd('100.0e0*avg(case when conf>0.7e0 then 1.0e0 else 0.0e0 end)',1)} as confidence_coverage_pct from conf_px group by 1)"


@query("q01_village_report", f"select v.*, k.confidence_coverage_pct from (select {VIL} from csum) v join {COV} k using (raster_id)")
def q01(s):
    return SP.village_report(s.truth, s.component_stats, s.catalog, GSD, s.conf)


def _village_part(key, cols):
    @query(key, f"select {', '.join(cols)} from (select {VIL} from csum)")
    def part(s):
        return SP.village_report(s.truth, s.component_stats, s.catalog, GSD).select(*cols)


_village_part("a23_village_roads", ["raster_id", "road_px", "road_area_m2", "road_coverage_pct", "road_length_m", "road_components", "road_segments"])
_village_part("a24_village_buildings", ["raster_id", "builtup_px", "n_buildings", "avg_building_area_m2", "building_density_per_ha", "rooftop_count"])
_village_part("a25_village_water", ["raster_id", "water_px", "water_components", "n_water_bodies", "largest_body_m2"])


@query("a16_confidence_coverage", f"select * from {COV}")
def a16(s):
    return SP.confidence_coverage(s.conf).select("raster_id", SC.rnd("coverage", 1).alias("confidence_coverage_pct"))


BR = "select raster_id, comp_id, cast(floor(round(cx,9)) as int) as x_px, cast(floor(round(cy,9)) as int) as y_px, area_px*25.0e0 as area_m2 from comps where class_id=2 and area_px>=30"


@query("a26_bridge_locations", BR, wide=True)
def a26(s):
    return SP.bridge_locations(_stats(s), GSD)


@query("t05_first_bridges", f"select raster_id, comp_id, x_px, y_px, area_m2, rank from (select *, cast(row_number() over (partition by raster_id order by comp_id) as int) as rank from ({BR})) where rank<=5", wide=True)
def t05(s):
    return top_k(SP.bridge_locations(_stats(s), GSD), ["raster_id"], ["comp_id"], 5)


@query("w02_cluster_sequence", "select raster_id, comp_id, row_number() over (partition by raster_id order by comp_id) as seq from comps where class_id=3 and area_px>=200", wide=True)
def w02(s):
    return number_in_frame(_stats(s).filter("class_id = 3 and area_px >= 200"), "seq").select("raster_id", "comp_id", "seq")


EXP = f"""select raster_id, {rd('100.0e0*avg(case when conf>=0.7e0 then 1.0e0 else 0.0e0 end)',2)} as high_confidence_pct,
  {rd('100.0e0-100.0e0*avg(case when conf>=0.7e0 then 1.0e0 else 0.0e0 end)',2)} as review_required_pct,
  count(*) filter (conf<0.7e0) as uncertain_px, """ + ", ".join(
    rd(f"coalesce(avg(conf) filter (coalesce(class_id,0)={k}),0)", 4) + f" as mean_conf_{k}" for k in range(5)) + """
  from conf_px left join truth_px using (raster_id,row,col) group by 1"""


@query("a15_confidence_summary", EXP)
def a15(s):
    return SP.explainability(box_layer(s.features, *s.frame), s.conf_blocks, s.catalog)


ZTOP = f"""select raster_id, zone_id, area_px, {rd('cx',1)} as centroid_x_px, {rd('cy',1)} as centroid_y_px, {rd('mean_conf',4)} as mean_confidence, rank from
  (select *, cast(row_number() over (partition by raster_id order by area_px desc, zone_id) as int) as rank from
  (select *, row_number() over (partition by raster_id order by comp_id) as zone_id from zones)) where rank<=10"""


def _zones(s):
    return number_in_frame(durable(SP.zone_table(s.uncertain, s.conf_blocks, {})), "zone_id")      # counted, then numbered


@query("t01_top_review_zones", ZTOP)
def t01(s):
    return top_k(_zones(s), ["raster_id"], ["-area_px", "zone_id"], 10).select(
        "raster_id", "zone_id", "area_px", SC.rnd("cx", 1).alias("centroid_x_px"), SC.rnd("cy", 1).alias("centroid_y_px"),
        SC.rnd("mean_conf", 4).alias("mean_confidence"), "rank")


@query("q02_explainability_report", f"""select e.*, coalesce(z.n,0) as review_zones, z.zone_areas from ({EXP}) e left join
  (select raster_id, count(*) as n, string_agg(cast(area_px as varchar), ',' order by rank) as zone_areas from ({ZTOP}) group by 1) z using (raster_id)""")
def q02(s):
    z = top_k(_zones(s), ["raster_id"], ["-area_px", "zone_id"], 10).groupBy("raster_id").agg(   # at most 10 rows each
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "area_px"))),
                                                          lambda x: x["area_px"].cast("string")), ",").alias("zone_areas"))
    return SP.explainability(box_layer(s.features, *s.frame), s.conf_blocks, s.catalog).join(z, "raster_id", "left").withColumn(
        "review_zones", F.coalesce("n", F.lit(0))).drop("n")


def _cands(s):
    return V.visit_candidates(s.mask, s.conf_blocks, s.uncertain, GSD, FRAME)


def _queue(s):
    return V.visit_queue(_cands(s), GSD)


@query("q03_field_verification_queue", "select * from queue")
def q03(s):
    return _queue(s)


SCORED = "raster_id, item_type, label, area_px, confidence_risk, isolation_risk, cluster_size, water_proximity, fragmentation_context"


@query("p18_priority_components", f"select {SCORED} from cand")
def p18(s):
    return _cands(s).select(*SCORED.split(", "))


@query("p19_weighted_total", "select raster_id, label, round(score,6) as score from cand")
def p19(s):
    return _cands(s).select("raster_id", "label", F.round("score", 6).alias("score"))


@query("p17_access_label", "select raster_id, label, access from cand")
def p17(s):
    return _cands(s).select("raster_id", "label", "access")


@query("p22_structure_estimate", "select raster_id, comp_id, greatest(1, cast(round_even(area_px*25.0e0/80.0e0,0) as bigint)) as structures from comps where class_id=3")
def p22(s):
    return _stats(s).filter("class_id = 3").select("raster_id", "comp_id", SC.structure_estimate(F.col("area_px") * 25.0).alias("structures"))


@query("u01_candidate_union", "select raster_id, item_type, count(*) as n, cast(sum(area_px) as bigint) as px from cand group by 1,2")
def u01(s):
    return _cands(s).groupBy("raster_id", "item_type").agg(F.count("*").alias("n"), F.sum("area_px").alias("px"))


@query("j11_greedy_suppression", "select raster_id, kind, idx from ranked join kept using (raster_id, pos)")
def j11(s):
    return keep_spaced(_cands(s), 6, 10, V.ORDER).select("raster_id", "kind", "idx")


@query("w01_queue_rank", "select raster_id, rank, label from queue")
def w01(s):
    return _queue(s).select("raster_id", "rank", "label")


@query("t02_top_queue_items", "select raster_id, rank, item_type, score from queue where rank<=10")
def t02(s):
    return _queue(s).filter("rank <= 10").select("raster_id", "rank", "item_type", "score")


@query("t03_top_markers", "select raster_id, rank, label from queue where rank<=5")
def t03(s):
    return _queue(s).filter("rank <= 5").select("raster_id", "rank", "label")


@query("p20_reason_text", "select raster_id, rank, reason from queue")
def p20(s):
    return _queue(s).select("raster_id", "rank", "reason")


LINES = f"""select c.raster_id, coalesce(q.rank,1) as rank, coalesce('Priority #' || q.rank || ': ' || case
  when item_type<>'settlement_cluster' then 'Confirm classification in ' || lower(label) || ' (model uncertain)'
  when access='isolated' then 'Verify isolated ' || lower(label) || ' (no road within 50 m)'
  when mean_confidence<0.70e0 then 'Inspect low-confidence ' || lower(label)
  else 'Field-verify ' || lower(label) || ' (' || cast(cast(round(settlement_area_m2) as bigint) as varchar) || ' m²)' end,
  '{SC.NO_PRIORITY}') as line from catalog c left join (select * from queue where rank<=3) q using (raster_id)"""


@query("p21_priority_lines", LINES)
def p21(s):
    return V.top_priorities(_queue(s), s.catalog)
