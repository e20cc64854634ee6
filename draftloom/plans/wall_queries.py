"""Queries over derived lines, walls and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftloom.functions import geometry as g
from draftloom.operators import walls as w
from draftloom.operators.ordered import components, first_wins, suppress
from draftloom.operators.spatial import box_join, nearest
from draftloom.plans.derived import derived, derived_sql
from draftloom.plans.registry import query

KEYS = ("drawing_id",)
SEG = derived_sql("segments")
OPEN = derived_sql("openings")


def lines(spark, sf_dir, layer="A-WALL"):
    return derived(spark, sf_dir, "segments").where(F.col("layer") == layer).select(
        "drawing_id", F.col("seg_id").alias("id"), F.col("seg_id").alias("ord"), "layer", "x1", "y1", "x2", "y2"
    )


def placed_walls(spark, sf_dir):
    """Distinct wall lines with a thickness; the lowest segment id names them."""
    seg = derived(spark, sf_dir, "segments").where("layer = 'A-WALL'")
    walls = seg.groupBy("drawing_id", "ori", "off_mm", "lo", "hi").agg(
        F.min("seg_id").alias("id"), F.min("thickness_mm").alias("thickness_mm")
    )
    h = F.col("ori") == "H"
    return walls.select(
        "*", F.col("id").alias("ord"), (F.col("hi") - F.col("lo")).alias("len"),
        F.when(h, F.col("lo")).otherwise(F.col("off_mm")).alias("x1"), F.when(h, F.col("off_mm")).otherwise(F.col("lo")).alias("y1"),
        F.when(h, F.col("hi")).otherwise(F.col("off_mm")).alias("x2"), F.when(h, F.col("off_mm")).otherwise(F.col("hi")).alias("y2"),
    )


WALLS = f"""(select drawing_id, ori, off_mm, lo, hi, min(seg_id) id, min(thickness_mm) thickness_mm, hi-lo len,
 case when ori='H' then lo else off_mm end x1, case when ori='H' then off_mm else lo end y1,
 case when ori='H' then hi else off_mm end x2, case when ori='H' then off_mm else hi end y2
 from {SEG} where layer='A-WALL' group by drawing_id, ori, off_mm, lo, hi)"""


def pairs_sql(layer):
    return f"""s as (select drawing_id,ori,off_mm,lo,hi,min(seg_id) id from {SEG} where layer='{layer}' group by drawing_id,ori,off_mm,lo,hi),
 p as (select a.drawing_id, a.ori, a.id a_id, b.id b_id, abs(a.off_mm-b.off_mm) width, least(a.hi,b.hi)-greatest(a.lo,b.lo) len,
 (a.off_mm+b.off_mm)/2 mid, greatest(a.lo,b.lo) lo, least(a.hi,b.hi) hi
 from s a join s b on a.drawing_id=b.drawing_id and a.ori=b.ori and a.id<b.id
 where abs(a.off_mm-b.off_mm) between 60 and 500 and least(a.hi,b.hi)-greatest(a.lo,b.lo)>=80)"""


def _pairs(df):
    return df.select(
        "drawing_id", "a_id", "b_id", F.round("raw_width").cast("bigint").alias("width"), F.round("len").cast("bigint").alias("len")
    )


@query("wall_pairs", "J1 G1 G2 G3 G4 G5", f"with {pairs_sql('A-WALL')} select drawing_id,a_id,b_id,width,len from p where len>=120")
def wall_pairs(spark, sf_dir):
    return _pairs(w.wall_candidates(lines(spark, sf_dir), KEYS).where("recognition_source <> 't_pier_wall_lines'"))


@query("short_walls", "J1", f"with {pairs_sql('A-WALL')} select drawing_id,a_id,b_id,width,len from p where len>=120 and len<500")
def short_walls(spark, sf_dir):
    return _pairs(w.wall_candidates(lines(spark, sf_dir), KEYS).where("recognition_source = 'short_paired_wall_lines'"))


@query("wall_center_lines", "G5", f"""with {pairs_sql('A-WALL')} select drawing_id,a_id,b_id,
 cast(case when ori='H' then lo else mid end as bigint) x1, cast(case when ori='H' then mid else lo end as bigint) y1,
 cast(case when ori='H' then hi else mid end as bigint) x2, cast(case when ori='H' then mid else hi end as bigint) y2 from p""")
def wall_center_lines(spark, sf_dir):
    found = w.pair_lines(w.unique_segments(lines(spark, sf_dir), KEYS), KEYS, crowd=lines(spark, sf_dir))
    ends = [F.round(c).cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return found.select("drawing_id", "a_id", "b_id", *ends)


@query("parapet_pairs", "J3", f"with {pairs_sql('A-DOOR')} select drawing_id,a_id,b_id,width,len from p where len>=120")
def parapet_pairs(spark, sf_dir):
    # The door layer stands in for a parapet layer.
    return _pairs(w.wall_candidates(lines(spark, sf_dir, "A-DOOR"), KEYS).where("recognition_source <> 't_pier_wall_lines'"))


@query("wall_counts", "J1 A1", f"""with {pairs_sql('A-WALL')} select drawing_id, count(*) walls, count(*) filter (where len<500) short_walls,
 sum(len) total_len, max(width) max_width from p where len>=120 group by drawing_id""")
def wall_counts(spark, sf_dir):
    return _pairs(w.wall_candidates(lines(spark, sf_dir), KEYS).where("recognition_source <> 't_pier_wall_lines'")).groupBy("drawing_id").agg(
        F.count(F.lit(1)).alias("walls"), F.count_if(F.col("len") < 500).alias("short_walls"),
        F.sum("len").alias("total_len"), F.max("width").alias("max_width"),
    )


@query("t_piers", "J2", f"""with {pairs_sql('A-WALL')}, std as (select unnest([100,120,150,180,200,240,250,300,350,400]) v),
 h as (select p.*, (select v from std order by abs(v-width), v limit 1) nw from p where len>=120)
 select drawing_id,a_id,b_id,width,len from p where len<120 and exists (select 1 from h where h.drawing_id=p.drawing_id and h.ori<>p.ori and
 least(pow(p.lo-h.mid,2), pow(p.hi-h.mid,2)) + pow(greatest(h.lo-p.mid,0,p.mid-h.hi),2) <= pow(greatest(90, p.width/2+h.nw/2+40),2))""")
def t_piers(spark, sf_dir):
    kept = w.keep_piers(w.wall_candidates(lines(spark, sf_dir), KEYS), KEYS)
    return _pairs(kept.where("recognition_source = 't_pier_wall_lines'"))


@query("distinct_walls", "W8 J35", f"""with {pairs_sql('A-WALL')}, k as (select *, row_number() over (partition by drawing_id,ori,mid,lo,hi,width order by a_id,b_id) rn from p where len>=120)
 select drawing_id,a_id,b_id,width,len from k where rn=1""")
def distinct_walls(spark, sf_dir):
    found = w.wall_candidates(lines(spark, sf_dir), KEYS).where("recognition_source <> 't_pier_wall_lines'")
    return _pairs(w.distinct_walls(found, KEYS))


@query("wall_widths", "G12", f"""with {pairs_sql('A-WALL')}, std as (select unnest([100,120,150,180,200,240,250,300,350,400]) v),
 c as (select width, thick, min(abs(v-t))::bigint delta, arg_min(v, (abs(v-t), v)) standard from (select width, width+d thick, width+d t from (select distinct width from p), (select unnest([0,5,9,33]) d)), std group by width, thick, t)
 select width, thick thickness, cast(standard as bigint) standard, delta, case when delta=0 then 'standard' when delta<=6 then 'auto_normalized' else 'nonstandard' end status from c""")
def wall_widths(spark, sf_dir):
    widths = _pairs(w.wall_candidates(lines(spark, sf_dir), KEYS)).select("width").distinct()
    each = widths.withColumn("thickness", F.explode(F.transform(F.array(*map(F.lit, (0, 5, 9, 33))), lambda d: F.col("width") + d)))
    std = g.nearest_standard("thickness")
    return each.select(
        "width", "thickness", std["value"].cast("bigint").alias("standard"), std["delta"].cast("bigint").alias("delta"), g.width_status(std).alias("status")
    )


@query("small_wall_blocks", "H7 G14", f"""with {pairs_sql('A-WALL')}, std as (select unnest([100,120,150,180,200,240,250,300,350,400]) v),
 q as (select *, row_number() over (partition by drawing_id,ori,mid,lo,hi,width order by a_id,b_id) rn from p where len>=120),
 d as (select drawing_id, ori, a_id, b_id, mid, lo, hi, len, (select v from std order by abs(v-width), v limit 1) nw,
  case when (select min(abs(v-width)) from std)<=6 then 0.95 else 0.75 end - case when len<500 then 0.12 else 0 end conf from q where rn=1),
 n as (select a.drawing_id, a.a_id, a.b_id, round(sum(1.0+least(b.len/5000.0,1.0)+(1500-greatest(a.lo-b.hi,b.lo-a.hi,0))/1500.0),6) score
  from d a join d b on a.drawing_id=b.drawing_id and a.ori=b.ori where greatest(a.len,a.nw)<=500 and greatest(b.len,b.nw)>500
  and abs(a.mid-b.mid)<=greatest(120,(a.nw+b.nw)/2+80) and greatest(a.lo-b.hi,b.lo-a.hi,0)<=1500 group by all),
 r as (select d.*, case when ori='H' then lo else mid-nw/2 end k1, case when ori='H' then mid-nw/2 else lo end k2,
  case when ori='H' then hi else mid+nw/2 end k3, case when ori='H' then mid+nw/2 else hi end k4, coalesce(score,0) score
  from d left join n using (drawing_id,a_id,b_id) where greatest(len,nw)<=500)
 select drawing_id, a_id, b_id, cast(len as bigint) len from (select *, row_number() over (partition by drawing_id,k1,k2,k3,k4 order by score desc, case when len>=nw then 0 else 1 end, conf desc, len desc, a_id, b_id) rk from r) where rk=1""")
def small_wall_blocks(spark, sf_dir):
    found = w.distinct_walls(w.wall_candidates(lines(spark, sf_dir), KEYS).where("recognition_source <> 't_pier_wall_lines'"), KEYS)
    named = found.withColumn("id", F.concat_ws("-", "a_id", "b_id")).withColumn("ord", F.struct("a_ord", "b_ord"))
    kept = w.distinct_blocks(named, KEYS)
    return kept.where(F.greatest("len", "normalized_width") <= 500).select("drawing_id", "a_id", "b_id", F.round("len").cast("bigint").alias("len"))


RUNS = f"""r0 as (select *, max(hi) over (partition by drawing_id,ori,off_mm order by lo,hi,seg_id rows between unbounded preceding and 1 preceding) pm from {SEG} where layer='A-WALL'),
 r1 as (select *, sum(case when pm is null or lo-pm>220 then 1 else 0 end) over (partition by drawing_id,ori,off_mm order by lo,hi,seg_id rows between unbounded preceding and current row) run from r0),
 runs as (select drawing_id,ori,off_mm,cast(run as bigint) run,min(lo) lo,max(hi) hi,count(*) n from r1 group by drawing_id,ori,off_mm,run)"""


@query("wall_runs", "W1 W2", f"with {RUNS} select * from runs")
def wall_runs(spark, sf_dir):
    seg = derived(spark, sf_dir, "segments").where("layer = 'A-WALL'")
    return w.wall_runs(seg, None, KEYS, ("ori", "off_mm"), touch=220, bucket=2500)


@query("wall_runs_bridged", "W2", f"""with {RUNS}, o as (select distinct drawing_id, ori, off_mm, (lo+hi)/2 t from {SEG} where layer='A-DOOR'),
 g as (select *, max(hi) over (partition by drawing_id,ori,off_mm order by run rows between unbounded preceding and 1 preceding) ph from runs),
 b as (select g.*, case when ph is not null and lo-ph<=6500 and exists (select 1 from o where o.drawing_id=g.drawing_id and o.ori=g.ori and o.off_mm=g.off_mm and o.t between g.ph and g.lo) then 0 else 1 end st from g),
 c as (select *, sum(st) over (partition by drawing_id,ori,off_mm order by run) nr from b)
 select drawing_id,ori,off_mm,cast(nr as bigint) run,min(lo) lo,max(hi) hi,cast(sum(n) as bigint) n from c group by drawing_id,ori,off_mm,nr""")
def wall_runs_bridged(spark, sf_dir):
    seg = derived(spark, sf_dir, "segments")
    doors = seg.where("layer = 'A-DOOR'").select("drawing_id", "ori", "off_mm", ((F.col("lo") + F.col("hi")) / 2).alias("t"))
    return w.wall_runs(seg.where("layer = 'A-WALL'"), doors, KEYS, ("ori", "off_mm"), touch=220, opening_gap=6500, bucket=2500)


def _runs(spark, sf_dir):
    seg = derived(spark, sf_dir, "segments").where("layer = 'A-WALL'")
    runs = w.wall_runs(seg, None, KEYS, ("ori", "off_mm"), touch=220, bucket=2500)
    h = F.col("ori") == "H"
    return runs.withColumn("x1", F.when(h, F.col("lo")).otherwise(F.col("off_mm"))).withColumn("y1", F.when(h, F.col("off_mm")).otherwise(F.col("lo"))).withColumn(
        "x2", F.when(h, F.col("hi")).otherwise(F.col("off_mm"))).withColumn("y2", F.when(h, F.col("off_mm")).otherwise(F.col("hi")))


@query("run_openings", "J26 J27", f"""with {RUNS}, o as (select *, case when ori='H' then x else y end t, case when ori='H' then y else x end s from runs join {OPEN} using (drawing_id))
 select drawing_id, opening_id, ori, off_mm, run, cast(greatest(0,least(hi-lo,t-lo)) as bigint) distance from o where abs(s-off_mm)<=900 and t between lo-500 and hi+500""")
def run_openings(spark, sf_dir):
    found = w.on_runs(derived(spark, sf_dir, "openings"), _runs(spark, sf_dir), KEYS, ("ori", "off_mm", "run"))
    return found.withColumn("distance", F.round("distance").cast("bigint"))


@query("opening_host_runs", "J25 G6", f"""with {RUNS}, o as (select *, case when ori='H' then x else y end t, case when ori='H' then y else x end s from runs join {OPEN} using (drawing_id)),
 d as (select *, greatest(lo-t,0,t-hi) gap, round(sqrt(pow(greatest(lo-t,0,t-hi),2)+pow(s-off_mm,2)) + 0.25*greatest(lo-t,0,t-hi), 6) score from o),
 k as (select *, row_number() over (partition by drawing_id, opening_id order by score, ori, off_mm, run) rn from d where score<=900)
 select drawing_id, opening_id, ori, off_mm, run, round(score,3) score from k where rn=1""")
def opening_host_runs(spark, sf_dir):
    runs = w._boxed(_runs(spark, sf_dir))
    line = ("r_x1", "r_y1", "r_x2", "r_y2")
    score = F.round(g.point_segment_distance("x", "y", *line) + g.outside_gap("x", "y", *line) * 0.25, 6)
    found = nearest(derived(spark, sf_dir, "openings"), runs, KEYS, ["opening_id"], ("x", "y"), w.BOX, score, (900.0,),
                    order=[F.col("r_ori"), F.col("r_off_mm"), F.col("r_run")])
    return found.select("drawing_id", "opening_id", F.col("r_ori").alias("ori"), F.col("r_off_mm").alias("off_mm"), F.col("r_run").alias("run"), F.round("_distance", 3).alias("score"))


_D = "round(sqrt(pow(greatest(least(x1,x2)-x,0,x-greatest(x1,x2)),2)+pow(greatest(least(y1,y2)-y,0,y-greatest(y1,y2)),2)),6)"


@query("nearest_wall", "J13", f"""with d as (select o.drawing_id, opening_id, w.id, {_D} d from {OPEN} o join {WALLS} w using (drawing_id)),
 k as (select *, row_number() over (partition by drawing_id, opening_id order by d, id) rn from d)
 select drawing_id, opening_id, id wall_id, cast(round(d*d) as bigint) dist2 from k where rn=1""")
def nearest_wall(spark, sf_dir):
    found = w.nearest_walls(derived(spark, sf_dir, "openings"), placed_walls(spark, sf_dir), KEYS, "opening_id", (500.0, 4000.0, float("inf")), crowd=lines(spark, sf_dir))
    return found.select("drawing_id", "opening_id", F.col("w_id").alias("wall_id"), F.round(F.pow("_distance", F.lit(2))).cast("bigint").alias("dist2"))


@query("host_walls", "J13", f"""with d as (select o.drawing_id, opening_id, w.id, w.len, {_D} d from {OPEN} o join {WALLS} w using (drawing_id)),
 k as (select drawing_id, opening_id, list_reduce(list({{'d':d,'id':id,'len':len}} order by id),
  lambda s, c: case when c.d < s.d-50 or (abs(c.d-s.d)<=50 and c.len>s.len) then c else s end) b from d group by drawing_id, opening_id)
 select drawing_id, opening_id, b.id host_wall_id, round(b.d,3) host_distance from k""")
def host_walls(spark, sf_dir):
    found = w.host_walls(derived(spark, sf_dir, "openings"), placed_walls(spark, sf_dir), KEYS, "opening_id", crowd=lines(spark, sf_dir))
    return found.where("host_wall_id is not null").select("drawing_id", "opening_id", "host_wall_id", F.round("host_distance", 3).alias("host_distance"))


@query("perpendicular_hosts", "J13 R2", f"""with o as (select drawing_id, opening_id, x, y, case when opening_id%3=0 then 'H' else 'V' end leaf from {OPEN}),
 d as (select o.drawing_id, opening_id, w.id, {_D} d from o join {WALLS} w on o.drawing_id=w.drawing_id and w.ori<>o.leaf),
 k as (select *, row_number() over (partition by drawing_id, opening_id order by d, id) rn from d)
 select drawing_id, opening_id, id wall_id, round(d,3) distance from k where rn=1""")
def perpendicular_hosts(spark, sf_dir):
    flat = F.col("opening_id") % 3 == 0
    leaves = derived(spark, sf_dir, "openings").withColumn("ux", F.when(flat, 1.0).otherwise(0.0)).withColumn("uy", F.when(flat, 0.0).otherwise(1.0))
    walls = g.with_measures(placed_walls(spark, sf_dir))
    found = w.nearest_walls(leaves, walls, KEYS, "opening_id", (500.0, 4000.0, float("inf")), perpendicular=True, crowd=lines(spark, sf_dir))
    return found.select("drawing_id", "opening_id", F.col("w_id").alias("wall_id"), F.round("_distance", 3).alias("distance"))


@query("wall_line_groups", "W1", None)
def wall_line_groups(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumn("id", F.concat_ws(":", "ori", "off_mm", "run"))
    return w.merge_border_runs(runs, KEYS).select("drawing_id", "id", "component")
