"""Query registry and the shared oracle SQL of the derived tables.

The oracle works on single pixels, independently of the run algebra, so that a
match says something.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridrun.sources.fixtures import Survey

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}      # bodies; see oracle()
WIDE_KEYS: set[str] = set()       # queries over the wide survey


def query(key: str, sql: str | None = None, wide: bool = False):
    """Register ``fn(survey) -> DataFrame`` under ``key``; ``sql`` is its oracle, ``wide`` the survey it runs over."""
    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Survey(spark, sf_dir, wide))

        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if wide:
            WIDE_KEYS.add(key)
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return wrap


def rd(x: str, n: int = 6) -> str:
    """Oracle rounding: half-up on the decimal text, as Spark's ``round``."""
    if n >= 6:
        return f"round({x}, {n})"
    return f"cast(round(cast(round({x}, 6) as decimal(24,6)), {n}) as double)"


CTES: dict[str, str] = {
    "dim_class": "select * from (values (0,'Background',0,0,0),(1,'Road',255,0,0),(2,'Bridge',0,0,255),"
                 "(3,'Built-Up Area',255,255,0),(4,'Water Body',0,200,255)) t(class_id,name,red,green,blue)",
    "catalog": """select s_suppkey as raster_id,
  case s_suppkey%7 when 0 then null when 1 then 4326 when 2 then 3857 when 3 then 32644 else 32643 end as epsg,
  cast(5.0 as double) as gt_a, cast(500000+s_suppkey*2000 as double) as gt_c,
  cast(-5.0 as double) as gt_e, cast(3200000.0 as double) as gt_f,
  256 as width, 256 as height, s_suppkey%11<>0 as readable,
  case when s_suppkey%4=0 then 'val' else 'train' end as split,
  concat('village_', cast(s_suppkey as varchar)) as stem,
  case when s_suppkey%3=0 then 'north' when s_suppkey%3=1 then 'south' else 'delta' end as source
  from supplier""",
    "feat": """select raster_id, cast(raster_id*100000+q as bigint) as feature_id,
  cast(1+(ok+ln)%4 as int) as class_id,
  cast((pk*37+ok*11)%240 as int) as c0,
  cast((ok*53+ln*29)%240 as int) as r0,
  cast(case (ok+ln)%4 when 0 then case when ok%8<4 then 60 else 3 end
       when 1 then 9 when 2 then 6+pk%14 else 24 end as int) as w,
  cast(case (ok+ln)%4 when 0 then case when ok%8<4 then 3 else 60 end
       when 1 then 4 when 2 then 6+ok%11 else 18 end as int) as h
  from (select l_suppkey as raster_id, year(l_shipdate)*4+quarter(l_shipdate)-1 as q, cast(sum(l_orderkey) as bigint) as ok,
    cast(sum(l_partkey) as bigint) as pk, cast(sum(l_linenumber) as bigint) as ln from lineitem group by 1, 2)""",
    "featp": "select raster_id, feature_id, class_id, cast(least(c0 + feature_id%2, 239) as int) as c0, r0, w, h "
             "from feat where feature_id%9<>0",
    "truth_px": """select raster_id, row, col, min(class_id) as class_id from (
  select raster_id, class_id, row, cast(unnest(range(c0, least(c0+w,256))) as int) as col from (
  select raster_id, class_id, c0, w, cast(unnest(range(r0, least(r0+h,256))) as int) as row from feat)) group by 1,2,3""",
    "pred_px": """select raster_id, row, col, min(class_id) as class_id from (
  select raster_id, class_id, row, cast(unnest(range(c0, least(c0+w,256))) as int) as col from (
  select raster_id, class_id, c0, w, cast(unnest(range(r0, least(r0+h,256))) as int) as row from featp)) group by 1,2,3""",
    # Truth and prediction side by side, foreground of either only.
    "both_px": """select coalesce(t.raster_id,p.raster_id) as raster_id, coalesce(t.row,p.row) as row,
  coalesce(t.col,p.col) as col, coalesce(t.class_id,0) as gt, coalesce(p.class_id,0) as pred
  from truth_px t full join pred_px p on t.raster_id=p.raster_id and t.row=p.row and t.col=p.col""",
    # Confusion counts per raster, background-background pixels included.
    "conf_counts": """select raster_id, gt, pred, count(*) as n from both_px group by 1,2,3
  union all select c.raster_id, 0, 0, 65536 - coalesce(b.n,0) from catalog c
  left join (select raster_id, count(*) n from both_px group by 1) b on b.raster_id=c.raster_id""",
    "counts": """select d.class_id, d.name,
  cast(sum(case when gt=class_id and pred=class_id then n else 0 end) as bigint) as tp,
  cast(sum(case when gt=class_id then n else 0 end) as bigint) as gt_pixels,
  cast(sum(case when pred=class_id then n else 0 end) as bigint) as pred_pixels
  from dim_class d, conf_counts group by 1,2""",
    "grid_px": """select c.raster_id, r.row, k.col from catalog c, (select cast(unnest(range(0,256)) as int) as row) r,
  (select cast(unnest(range(0,256)) as int) as col) k""",
    "conf_px": """select raster_id, row, col, 0.5e0 + 0.5e0*(((br*br*31 + bc*bc*17 + br*bc*13 + raster_id*7) % 101)/100.0e0) as conf
  from (select *, row//16 as br, col//16 as bc from grid_px)""",
    # Runs of every class of the truth mask.
    "px_runs": """select raster_id, class_id, row, min(col) as c0, max(col) as c1, cast(row*256+min(col) as bigint) as rid from (
  select *, col - row_number() over (partition by raster_id,class_id,row order by col) as g from truth_px)
  group by raster_id, class_id, row, g""",
    "run_edges": """select a.raster_id, a.class_id, a.rid as a, b.rid as b from px_runs a join px_runs b
  on a.raster_id=b.raster_id and a.class_id=b.class_id and b.row=a.row+1 and b.c0<=a.c1+1 and b.c1>=a.c0-1""",
    "run_links": "select raster_id, class_id, a, b from run_edges union all select raster_id, class_id, b, a from run_edges",
    "run_reach": """select raster_id, class_id, rid as l, rid as n from px_runs r where not exists (
    select 1 from run_links k where k.raster_id=r.raster_id and k.class_id=r.class_id and k.a=r.rid and k.b<r.rid)
  union select x.raster_id, x.class_id, x.l, k.b from run_reach x join run_links k
    on k.raster_id=x.raster_id and k.class_id=x.class_id and k.a=x.n""",
    "run_label": "select raster_id, class_id, n as rid, min(l) as comp_id from run_reach group by 1,2,3",
    "comp_runs": """select r.*, l.comp_id from px_runs r join run_label l
  on l.raster_id=r.raster_id and l.class_id=r.class_id and l.rid=r.rid""",
    "comps": """select raster_id, class_id, comp_id, cast(sum(c1-c0+1) as bigint) as area_px,
  min(c0) as x0, min(row) as y0, max(c1) as x1, max(row) as y1,
  max(c1)-min(c0)+1 as bw, max(row)-min(row)+1 as bh,
  sum(cast(c0+c1 as bigint)*(c1-c0+1))/2.0e0/sum(c1-c0+1) as cx, sum(row*(c1-c0+1))*1.0e0/sum(c1-c0+1) as cy
  from comp_runs group by 1,2,3""",
    # Disc offsets: half-width at row offset dy is round(sqrt(r^2-dy^2)).
    "near_road": """select distinct p.raster_id, p.row+y.dy as row, p.c as col from
  (select raster_id, row, c0, c1 from px_runs where class_id=1) s,
  (select unnest(range(-10,11)) as dy) y,
  lateral (select s.raster_id, s.row, unnest(range(greatest(0, s.c0-cast(round(sqrt(100-y.dy*y.dy)) as int)),
    least(255, s.c1+cast(round(sqrt(100-y.dy*y.dy)) as int))+1)) as c) p where p.row+y.dy between 0 and 255""",
    "near_water": """select distinct p.raster_id, p.row+y.dy as row, p.c as col from
  (select raster_id, row, c0, c1 from px_runs where class_id=4) s,
  (select unnest(range(-6,7)) as dy) y,
  lateral (select s.raster_id, s.row, unnest(range(greatest(0, s.c0-cast(round(sqrt(36-y.dy*y.dy)) as int)),
    least(255, s.c1+cast(round(sqrt(36-y.dy*y.dy)) as int))+1)) as c) p where p.row+y.dy between 0 and 255""",
    # Low-confidence zones over the whole raster.
    "u_runs": """select raster_id, row, min(col) as c0, max(col) as c1, cast(row*256+min(col) as bigint) as rid from (
  select *, col - row_number() over (partition by raster_id,row order by col) as g from conf_px where conf<0.7e0)
  group by raster_id, row, g""",
    "u_edges": """select a.raster_id, a.rid as a, b.rid as b from u_runs a join u_runs b
  on a.raster_id=b.raster_id and b.row=a.row+1 and b.c0<=a.c1+1 and b.c1>=a.c0-1""",
    "u_links": "select raster_id, a, b from u_edges union all select raster_id, b, a from u_edges",
    "u_reach": """select raster_id, rid as l, rid as n from u_runs r where not exists (
    select 1 from u_links k where k.raster_id=r.raster_id and k.a=r.rid and k.b<r.rid)
  union select x.raster_id, x.l, k.b from u_reach x join u_links k on k.raster_id=x.raster_id and k.a=x.n""",
    "u_label": "select raster_id, n as rid, min(l) as comp_id from u_reach group by 1,2",
    "u_px": """select raster_id, comp_id, row, unnest(range(c0, c1+1)) as col from u_runs join u_label using (raster_id, rid)""",
    "zones": """select raster_id, comp_id, count(*) as area_px, avg(col) as cx, avg(row) as cy, avg(conf) as mean_conf
  from u_px join conf_px using (raster_id, row, col) group by 1,2 having count(*)>=500""",
    "lg": "select vec_id, cast(t.k as int) as k, label%5 as gt, list_transform(list_concat(embedding, embedding[1:1])[5*t.k+1:5*t.k+5], lambda x: cast(x as double)) as z "
          "from embeddings, range(13) t(k)",
    "lg2": """select a.vec_id, a.k, a.gt, a.z, b.z as z2 from lg a join lg b
  on b.vec_id = (a.vec_id + 1) % (select count(*) from embeddings) and b.k=a.k""",
    "lgp": """select vec_id, k, gt, z, list_position(z, list_max(z))-1 as pred, e,
  list_transform(e, lambda x: x/(list_sum(e)+1e-9)) as p
  from (select *, list_transform(z, lambda x: exp(x - list_max(z))) as e from lg)""",
    "history": """select user_id%8 as run,
  cast(row_number() over(partition by user_id%8 order by ts,event_id) as bigint) as epoch,
  case when event_type='error' then cast(0.0 as double) else least(value/400.0e0, cast(1.0 as double)) end as metric
  from events""",
    "assets": """select doc_id as asset_id, source, concat('doc_',cast(doc_id as varchar),'.txt') as path,
  sha256(text) as sha256, n_chars as bytes from documents""",
}


# Recursive relations cannot be marked materialized.
RECURSIVE = {"run_reach", "u_reach", "walk"}


#: Features of the wide survey: one per row of lineitem.
WIDE_FEAT = """select l_suppkey as raster_id, cast((l_orderkey*8+l_linenumber)*100000+l_partkey as bigint) as feature_id, cast(1+(l_orderkey+l_linenumber)%4 as int) as class_id,
  cast((l_partkey*37+l_orderkey*11)%2032 as int) as c0, cast((l_orderkey*53+l_linenumber*29+l_partkey*7)%2032 as int) as r0,
  cast(case (l_orderkey+l_linenumber)%4 when 0 then case when l_orderkey%8<4 then 120 else 3 end
       when 1 then 9 when 2 then 6+l_partkey%14 else 24 end as int) as w,
  cast(case (l_orderkey+l_linenumber)%4 when 0 then case when l_orderkey%8<4 then 3 else 30 end
       when 1 then 4 when 2 then 6+l_orderkey%11 else 18 end as int) as h from lineitem"""
#: Raster side in pixels, its last column, its pixels, its square metres, the greatest column that a prediction moves to, and the last place of a patch of 64.
SIDES = {"256": "2048", "255": "2047", "65536": "4194304", "1638400": "104857600", "239": "2031", "192": "1984"}


def widened(sql: str) -> str:
    """Oracle text of small rasters for wide ones. No SQL of a wide query has these numbers in another sense."""
    return re.sub(r"(?<![\w.])(256|255|65536|1638400|239|192)(?![\w])", lambda m: SIDES[m[1]], sql)


def with_ctes(sql: str, wide: bool = False) -> str:
    """Prefix ``sql`` with the derived tables it names, dependencies first."""
    ctes = {k: WIDE_FEAT if k == "feat" else widened(v) for k, v in CTES.items()} if wide else CTES
    sql = widened(sql) if wide else sql
    order: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in ctes:
            if name != own and name not in order and re.search(rf"(?:from|join|,)\s+{name}\b", text):
                visit(ctes[name], name)
                order.append(name)

    visit(sql)
    if not order:
        return sql
    head = ",\n".join(f"{n} as {'' if n in RECURSIVE else 'materialized '}({ctes[n]})" for n in order)
    sql = sql.strip()
    if sql.lower().startswith("with "):
        return f"with recursive {head},\n" + re.sub(r"(?i)^with\s+(recursive\s+)?", "", sql)
    return f"with recursive {head}\n{sql}"


def oracle(key: str) -> str:
    """Complete oracle SQL of a query (all query modules must be loaded)."""
    return with_ctes(ORACLES[key], key in WIDE_KEYS)
