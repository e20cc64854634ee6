"""Queries of nearest labels, marks and elements, view matching and detail fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftloom.functions import text as t
from draftloom.operators import matching as m
from draftloom.plans.derived import derived, derived_sql
from draftloom.plans.registry import query
from draftloom.plans.wall_queries import WALLS, lines, placed_walls

KEYS = ("drawing_id",)
DOORS, MARKS, TEXTS, VIEWS, PARTS, OPEN, SEG = (derived_sql(r) for r in ("sheet_openings", "marks", "texts", "views", "parts", "openings", "segments"))
_NEAR = "round(sqrt(pow(o.x-m.x,2)+pow(o.y-m.y,2)),6)"


@query("nearest_mark", "J15", f"""with p as (select o.drawing_id, opening_id, mark_id, {_NEAR} d from {DOORS} o join {MARKS} m using (drawing_id, kind)),
 k as (select *, row_number() over (partition by drawing_id, opening_id order by d, mark_id) rn from p where d<2500) select drawing_id, opening_id, mark_id, cast(round(d*d) as bigint) dist2 from k where rn=1""")
def nearest_mark(spark, sf_dir):
    found = m.nearest_marks(derived(spark, sf_dir, "sheet_openings"), derived(spark, sf_dir, "marks"), KEYS)
    return found.select("drawing_id", "opening_id", F.col("m_mark_id").alias("mark_id"), F.round(F.pow("_distance", F.lit(2))).cast("bigint").alias("dist2"))


@query("k_nearest_raw", "J18 O3", f"""with p as (select o.drawing_id, opening_id, mark_id raw_id, {_NEAR} d from {DOORS} o join {MARKS} m using (drawing_id)),
 k as (select *, row_number() over (partition by drawing_id, opening_id order by d, raw_id) rn from p where d<=5000) select drawing_id, opening_id, raw_id, cast(rn as int) "rank" from k where rn<=12""")
def k_nearest_raw(spark, sf_dir):
    raw = derived(spark, sf_dir, "marks").select("drawing_id", F.col("mark_id").alias("raw_id"), "x", "y")
    found = m.nearby_geometry(derived(spark, sf_dir, "sheet_openings").select("drawing_id", "opening_id", "x", "y"), raw, KEYS, radius=5000.0)
    return found.select("drawing_id", "opening_id", F.col("g_raw_id").alias("raw_id"), F.col("_rank").alias("rank"))


@query("text_elements", "J17 U1", f"""with e as (select drawing_id, id element_id, 'wall' element_type, 2 o, x1, y1, x2, y2 from {WALLS} union all select drawing_id, opening_id, kind, case kind when 'door' then 4 else 5 end, x, y, x, y from {OPEN}),
 t as (select drawing_id, n*100000000+opening_id text_id, x+n*700 x, y+n*300 y from {OPEN}, (select unnest(range(1,8)) n)),
 p as (select t.drawing_id, text_id, element_id, element_type, o, round(sqrt(pow(greatest(least(x1,x2)-x,0,x-greatest(x1,x2)),2)+pow(greatest(least(y1,y2)-y,0,y-greatest(y1,y2)),2)),6) d from t join e using (drawing_id)),
 k as (select *, row_number() over (partition by drawing_id, text_id order by d, o, element_id) rn from p where d<=5000) select drawing_id, text_id, element_id, element_type, round(d,3) distance from k where rn=1""")
def text_elements(spark, sf_dir):
    o = derived(spark, sf_dir, "openings")
    walls = placed_walls(spark, sf_dir).select("drawing_id", F.col("id").alias("element_id"), F.lit("wall").alias("element_type"), F.col("id").alias("ord"), "x1", "y1", "x2", "y2")
    spots = o.select("drawing_id", F.col("opening_id").alias("element_id"), F.col("kind").alias("element_type"), F.col("opening_id").alias("ord"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    texts = o.withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint")))).select(
        "drawing_id", (F.col("n") * 100000000 + F.col("opening_id")).alias("text_id"), (F.col("x") + F.col("n") * 700).alias("x"), (F.col("y") + F.col("n") * 300).alias("y"))
    return m.associate_texts(texts, walls.unionByName(spots), KEYS).drop("method")


@query("axis_names", "J14", f"""with a as (select distinct drawing_id%200 drawing_id, x1, y1, x2, y2, ori from {WALLS}), p as (select a.*, text_id, trim(text) nm, round(sqrt(pow(greatest(least(x1,x2)-t.x/8,0,t.x/8-greatest(x1,x2)),2)+pow(greatest(least(y1,y2)-t.y/8,0,t.y/8-greatest(y1,y2)),2)),6) d
  from a join {TEXTS} t using (drawing_id) where length(trim(text)) between 1 and 8), k as (select *, row_number() over (partition by drawing_id,x1,y1,x2,y2 order by d, text_id) rn from p where d<600)
 select drawing_id, cast(x1 as bigint) x1, cast(y1 as bigint) y1, cast(x2 as bigint) x2, cast(y2 as bigint) y2, nm "name" from k where rn=1""")
def axis_names(spark, sf_dir):
    axes = placed_walls(spark, sf_dir).select((F.col("drawing_id") % 200).alias("drawing_id"), "x1", "y1", "x2", "y2").distinct()
    axes = axes.withColumn("id", F.struct("x1", "y1", "x2", "y2"))
    texts = derived(spark, sf_dir, "texts").withColumn("x", F.col("x") / 8).withColumn("y", F.col("y") / 8).select("drawing_id", "text_id", "text", "x", "y")
    return m.axis_names(axes, texts, KEYS).where("name is not null").select("drawing_id", "x1", "y1", "x2", "y2", "name")


_FACE = "coalesce(nullif(regexp_extract(trim(text),'((?:东|西|南|北|正|背|左|右).{0,4}立面)',1),''), nullif(regexp_replace(regexp_extract(' '||trim(text)||' ','(?i)(?:^|[\\s\\-_:：])((?:[A-Za-z0-9]+|[一-龥]{1,4})\\s*(?:面|立面|facade|elevation))(?:$|[\\s\\-_:：])',1),'\\s+','','g'),''))"
CONTEXTS = f"""l as (select drawing_id, text_id, x, y, {_FACE} face from {TEXTS}), f as (select * from l where face is not null),
 p as (select o.drawing_id, opening_id, face, {_NEAR} d, text_id from {DOORS} o join f m using (drawing_id)),
 k as (select *, row_number() over (partition by drawing_id, opening_id order by d, text_id) rn from p where d<8000),
 ti as (select drawing_id, 'Sheet '||drawing_id title from {DOORS} where drawing_id%3=0 group by drawing_id),
 ctx as (select o.drawing_id, opening_id, o.kind, coalesce(face, title, '未命名图纸范围') context_name, case when face is not null then 'nearest_face_label' when title is not null then 'drawing_title' else 'fallback' end context_source,
  case when face is not null then case when d<2500 then 0.88 else 0.72 end when title is not null then 0.66 else 0.35 end::double confidence
  from {DOORS} o left join (select * from k where rn=1) k using (drawing_id, opening_id) left join ti using (drawing_id))"""


def _contexts(spark, sf_dir):
    labels = derived(spark, sf_dir, "texts").select("drawing_id", "text_id", "x", "y", t.face_label("text").alias("face")).where("face is not null")
    doors = derived(spark, sf_dir, "sheet_openings")
    none = F.lit(None).cast("string")
    titles = doors.select("drawing_id").distinct().select("drawing_id", F.when(F.col("drawing_id") % 3 == 0, F.concat(F.lit("Sheet "), "drawing_id")).alias("title"), none.alias("title_face"), none.alias("frame_id"))
    return m.opening_contexts(doors, labels, titles, KEYS)


@query("opening_contexts", "J16 T11", f"with {CONTEXTS} select drawing_id, opening_id, context_name, context_source, confidence from ctx")
def opening_contexts(spark, sf_dir):
    return _contexts(spark, sf_dir).select("drawing_id", "opening_id", "context_name", "context_source", "confidence")


@query("context_summaries", "A3", f"with {CONTEXTS} select drawing_id, context_name, context_source, count(*) filter (where kind='door') doors, count(*) filter (where kind='window') windows, count(*) openings_total from ctx group by all")
def context_summaries(spark, sf_dir):
    return m.context_summaries(_contexts(spark, sf_dir), KEYS)


def _doors_and_marks(spark, sf_dir):
    o = derived(spark, sf_dir, "sheet_openings").where("kind = 'door'")
    doors = o.select("drawing_id", F.col("opening_id").alias("id"), F.col("opening_id").alias("ord"), "x", "y")
    k = derived(spark, sf_dir, "marks")
    marks = k.where("kind = 'window'").select("drawing_id", F.col("mark_id").alias("id"), F.col("mark_id").alias("ord"), "x", "y", F.concat_ws("-", "width_mm", "height_mm").alias("text"))
    return doors, marks


@query("mark_matching", "J23", None)
def mark_matching(spark, sf_dir):
    doors, marks = _doors_and_marks(spark, sf_dir)
    return m.match_marks(doors, marks, KEYS)


@query("mark_offsets", "J24", None)
def mark_offsets(spark, sf_dir):
    doors, marks = _doors_and_marks(spark, sf_dir)
    return m.mark_offsets(m.match_marks(doors, marks, KEYS), doors, marks, KEYS)


@query("free_mark_hosts", "J24 U3", None)
def free_mark_hosts(spark, sf_dir):
    doors, marks = _doors_and_marks(spark, sf_dir)
    pairs = m.match_marks(doors, marks, KEYS)
    gated = pairs.select("drawing_id").distinct()
    free = marks.join(pairs.select("drawing_id", F.col("mark").alias("id")), ["drawing_id", "id"], "left_anti").join(gated, "drawing_id", "left_semi")
    taken = marks.join(pairs.select("drawing_id", F.col("mark").alias("id"), F.col("door").alias("host")), ["drawing_id", "id"]).select("drawing_id", "text", "x", "y", "host")
    walls = placed_walls(spark, sf_dir).groupBy((F.col("drawing_id") % 200).alias("drawing_id"), "x1", "y1", "x2", "y2").agg(F.min("id").alias("id"))
    found = m.hosts_of_free_marks(free, taken, walls.withColumn("ord", F.col("id")), KEYS)
    return found.select("drawing_id", "id", "host", F.round("foot.x", 3).alias("x"), F.round("foot.y", 3).alias("y"))


@query("unused_marks", "U3", f"""select drawing_id, mark_id from {MARKS} m where not exists (select 1 from {DOORS} o where o.drawing_id=m.drawing_id and o.kind=m.kind and pow(o.x-m.x,2)+pow(o.y-m.y,2)<6250000)""")
def unused_marks(spark, sf_dir):
    return m.unused_marks(derived(spark, sf_dir, "marks"), derived(spark, sf_dir, "sheet_openings"))


def _views(spark, sf_dir, view):
    v = derived(spark, sf_dir, "views").where(F.col("view") == view)
    return v.select("project_id", "id", F.col("id").alias("ord"), "kind", "facade", "mark", F.col("width_mm").alias("width"), F.col("height_mm").alias("height"), "position")


def _step(a, b, near, gain, far, some, none="0.0"):
    """CASE of a difference: ``gain`` up to ``near``, ``some`` up to ``far``, else ``none``."""
    return f"case when abs({a}-{b})<={near} then {gain} when abs({a}-{b})<={far} then {some} else {none} end"


@query("cross_view_match", "J20", f"""with recursive v as (select *, upper(trim(coalesce(mark, ''))) mk from {VIEWS}), p as (select *, row_number() over (partition by project_id, kind order by id) rn from v where view='plan'), e as (select * from v where view='elevation'),
 s as (select p.project_id, p.kind, p.rn, e.id eid, case when p.facade=e.facade then 0 else 1 end tier, round(greatest(0.0::double, least(1.0::double, 0.22::double
  + case when p.mk<>'' and p.mk=e.mk then 0.42 when p.mk<>'' and e.mk<>'' and p.mk[1]=e.mk[1] then 0.08 else 0.0 end::double + ({_step('p.width_mm', 'e.width_mm', 80, 0.2, 200, 0.1)})::double
  + ({_step('p.height_mm', 'e.height_mm', 120, 0.08, 300, 0.04)})::double + coalesce(case when p.position is not null and e.position is not null then {_step('p.position', 'e.position', 300, 0.2, 900, 0.1, '-0.08')} end, 0.0)::double)), 6) score
  from p join e on p.project_id=e.project_id and p.kind=e.kind),
 l as (select project_id, kind, rn, list({{'eid': eid, 'score': score}} order by tier, score desc, eid) cand from s where (tier=0 and score>0) or score>=0.68 group by all), n as (select project_id, kind, max(rn) m from p group by all),
 walk as (select project_id, kind, 0::bigint step, []::bigint[] used, null::struct(eid bigint, score double) pick from n
  union all select project_id, kind, step, case when pick is null then used else list_append(used, pick.eid) end, pick from (select w.project_id, w.kind, w.step+1 step, w.used, list_filter(l.cand, lambda c: not list_contains(w.used, c.eid))[1] pick
   from walk w join n on n.project_id=w.project_id and n.kind=w.kind and w.step<n.m left join l on l.project_id=w.project_id and l.kind=w.kind and l.rn=w.step+1))
 select p.project_id, p.kind opening_kind, p.id plan_id, w.pick.eid elevation_id, p.facade, round(coalesce(w.pick.score, 0.0), 3) score, case when w.pick is null then 'unmatched' when w.pick.score>=0.68 then 'matched' else 'needs_review' end match_status
 from p join walk w on w.project_id=p.project_id and w.kind=p.kind and w.step=p.rn""")
def cross_view_match(spark, sf_dir):
    return m.match_views(_views(spark, sf_dir, "plan"), _views(spark, sf_dir, "elevation"))


@query("view_back_fill", "J22", f"""with p as (select * from {VIEWS} where view='plan'), e as (select * from {VIEWS} where view='elevation'),
 k as (select p.project_id, p.id, e.id eid, case when p.width_mm=e.width_mm then 'matched' else 'needs_review' end st from p join e on e.id=p.id+2 and e.project_id=p.project_id),
 u as (select p.*, case when st='matched' or p.kind='door' then eid end el, st from p left join k using (project_id, id))
 select u.project_id, u.id, coalesce(e.sill_mm, u.sill_mm) sill_mm, coalesce(e.height_mm, u.height_mm) height_mm, case when u.mark='' and coalesce(e.mark,'')<>'' then e.mark else u.mark end mark,
 case when e.category is not null then e.category else u.category end category, u.el elevation_id from u left join e on e.project_id=u.project_id and e.id=u.el""")
def view_back_fill(spark, sf_dir):
    v = derived(spark, sf_dir, "views")
    plans, elevations = v.where("view = 'plan'"), v.where("view = 'elevation'")
    e = elevations.select("project_id", (F.col("id") - 2).alias("plan_id"), F.col("id").alias("elevation_id"), F.col("width_mm").alias("ew"))
    status = F.when(F.col("width_mm") == F.col("ew"), "matched").otherwise("needs_review")
    matches = plans.select("project_id", F.col("id").alias("plan_id"), F.col("kind").alias("opening_kind"), "width_mm").join(e, ["project_id", "plan_id"]).select(
        "project_id", "plan_id", "elevation_id", "opening_kind", status.alias("match_status"), F.lit(0.7).alias("score"))
    filled = m.back_fill(plans, matches, elevations)
    return filled.select("project_id", "id", F.col("sill_mm").cast("bigint").alias("sill_mm"), "height_mm", "mark", "category", "elevation_id")


@query("plan_facades", "J21", f"""with b as (select drawing_id, min(least(x1,x2)) x0, min(least(y1,y2)) y0, max(greatest(x1,x2)) xx, max(greatest(y1,y2)) yy from {WALLS} group by drawing_id)
 select w.drawing_id, w.id opening_id, case when ori='H' then case when abs(y1-y0)<=abs(y1-yy) then 'south' else 'north' end else case when abs(x1-x0)<=abs(x1-xx) then 'west' else 'east' end end facade from {WALLS} w join b using (drawing_id)""")
def plan_facades(spark, sf_dir):
    walls = placed_walls(spark, sf_dir)
    openings = walls.select("drawing_id", F.col("id").alias("opening_id"), F.col("id").alias("host_wall_id"))
    return m.plan_facades(openings, walls, KEYS).drop("host_wall_id")


FUSED = f"""d as (select * from {PARTS} where view='detail'), p as (select * from {PARTS} where view='floor_plan'),
 mk as (select project_id, component_group, mark, min(id) pid from p where mark<>'' group by all having count(*)=1), ty as (select project_id, component_group, "type", min(id) pid from p where "type"<>'unresolved' group by all having count(*)=1),
 sz as (select d.id, d.project_id, d.component_group, min(p.id) pid from d join p using (project_id, component_group) where abs(d.width_mm-p.width_mm)<=10 and abs(d.height_mm-p.height_mm)<=10 group by d.id, d.project_id, d.component_group having count(*)=1),
 n as (select project_id, component_group, count(*) c, min(id) pid from p group by all),
 fused as (select d.project_id, d.component_group, d.id, coalesce(mk.pid, ty.pid, sz.pid, case when n.c=1 then n.pid end) plan_id,
  case when mk.pid is not null then 'exact_component_mark' when ty.pid is not null then 'unique_component_type' when sz.pid is not null then 'unique_matching_size' when n.c=1 then 'single_plan_candidate' when n.c>1 then 'ambiguous' else 'no_floor_plan_candidate' end match_basis,
  case when mk.pid is not null then 0.98 when ty.pid is not null then 0.88 when sz.pid is not null then 0.82 when n.c=1 then 0.7 else 0 end::double confidence
  from d left join mk on mk.project_id=d.project_id and mk.component_group=d.component_group and mk.mark=d.mark left join ty on ty.project_id=d.project_id and ty.component_group=d.component_group and ty."type"=d."type"
  left join sz on sz.id=d.id left join n on n.project_id=d.project_id and n.component_group=d.component_group)"""


def _parts(spark, sf_dir):
    parts = derived(spark, sf_dir, "parts")
    return parts.where("view = 'detail'").drop("view"), parts.where("view = 'floor_plan'").drop("view")


@query("detail_fusion", "J32", f"with {FUSED} select * from fused")
def detail_fusion(spark, sf_dir):
    return m.fuse_details(*_parts(spark, sf_dir))


@query("detail_values", "J32", f"""with {FUSED}, l as (select f.*, d.material, d.height_mm from fused f join d using (id)),
 mt as (select plan_id, arg_min(material, (-confidence, id)) v, arg_min(confidence, (-confidence, id)) c from l where material is not null and plan_id is not null group by plan_id),
 ht as (select plan_id, arg_min(height_mm, (-confidence, id)) v, arg_min(confidence, (-confidence, id)) c from l where height_mm is not null and plan_id is not null group by plan_id)
 select p.id, case when mt.v is not null and (mt.c>=0.88 or p.material is null) then mt.v else p.material end material, case when ht.v is not null and (ht.c>=0.88 or p.height_mm is null) then ht.v else p.height_mm end height_mm
 from p left join mt on mt.plan_id=p.id left join ht on ht.plan_id=p.id""")
def detail_values(spark, sf_dir):
    details, plans = _parts(spark, sf_dir)
    merged = m.merge_detail_values(plans, details, m.fuse_details(details, plans), ["material", "height_mm"])
    return merged.select("id", "material", "height_mm")


@query("window_sills", "J33 A5", f"""with w as (select * from {VIEWS} where kind='window'), e as (select *, cast(round_even(width_mm/10.0,0)*10 as bigint) rw, cast(round_even(height_mm/10.0,0)*10 as bigint) rh from w where view='elevation'),
 c as (select project_id, rw, rh, sill_mm, count(*) n from e group by all), s as (select project_id, rw, rh, arg_min(sill_mm, (-n, sill_mm)) v from c group by all),
 c2 as (select project_id, sill_mm, count(*) n from e group by all), u as (select project_id, arg_min(sill_mm, (-n, sill_mm)) v from c2 group by all)
 select p.project_id, p.id, coalesce(p.sill_mm, s.v, u.v, 900) sill_mm, case when p.sill_mm is not null then 'input_sill_height' when s.v is not null then 'matched_from_elevation_window_size' when u.v is not null then 'common_elevation_window_sill_height' else 'default_plan_window_sill_height' end sill_source
 from (select *, cast(round_even(width_mm/10.0,0)*10 as bigint) rw, cast(round_even(height_mm/10.0,0)*10 as bigint) rh from w where view='plan') p left join s using (project_id, rw, rh) left join u on u.project_id=p.project_id""")
def window_sills(spark, sf_dir):
    v = derived(spark, sf_dir, "views").where("kind = 'window'")
    filled = m.infer_sills(v.where("view = 'plan'"), v.where("view = 'elevation' and sill_mm is not null"))
    return filled.select("project_id", "id", F.col("sill_mm").cast("bigint").alias("sill_mm"), "sill_source")


@query("attached_marks", "R5", f"""with p as (select o.drawing_id, opening_id, m.width_mm mw, m.height_mm mh, mark_id, {_NEAR} d from {DOORS} o join {MARKS} m using (drawing_id, kind)), k as (select *, row_number() over (partition by drawing_id, opening_id order by d, mark_id) rn from p where d<2500)
 select o.opening_id, coalesce(mw,o.width_mm) width_mm, coalesce(mh,o.height_mm) height_mm, case when mw<>o.width_mm then o.width_mm end width_geometry_original, case when o.kind='door' then 0 end sill_mm from {DOORS} o left join k on k.drawing_id=o.drawing_id and k.opening_id=o.opening_id and rn=1""")
def attached_marks(spark, sf_dir):
    found = m.attach_marks(derived(spark, sf_dir, "sheet_openings"), derived(spark, sf_dir, "marks"), KEYS)
    return found.select("opening_id", "width_mm", "height_mm", "width_geometry_original", "sill_mm")


@query("attached_wall_heights", "R5", f"""with h as (select drawing_id, arg_min(height_mm, opening_id) h from {OPEN} group by drawing_id) select w.id, case when w.id%2=0 then 2500 else h.h end::bigint height_mm, case when w.id%2<>0 and h.h is not null then 'floor_height_candidate' end height_source from {WALLS} w left join h using (drawing_id)""")
def attached_wall_heights(spark, sf_dir):
    walls = placed_walls(spark, sf_dir).withColumn("height_mm", F.when(F.col("id") % 2 == 0, F.lit(2500).cast("bigint")))
    heights = derived(spark, sf_dir, "openings").select("drawing_id", F.col("opening_id").alias("ord"), "height_mm")
    return m.attach_wall_heights(walls, heights, KEYS).select("id", "height_mm", "height_source")


@query("merged_heights", "U2 W8", f"""with u as (select drawing_id, 'F'||(opening_id%4) floor, height_mm, 0.9 c, x, y from {DOORS} where kind='door' union all select drawing_id, 'F'||(opening_id%4), height_mm, 0.72, x, y from {DOORS} where kind='window'), r as (select *, row_number() over (partition by drawing_id, floor, height_mm order by c desc, y, x) rn from u) select drawing_id, floor, height_mm, x, y from r where rn=1""")
def merged_heights(spark, sf_dir):
    from draftloom.operators.levels import merge_heights

    o = derived(spark, sf_dir, "sheet_openings").withColumn("floor", F.concat(F.lit("F"), (F.col("opening_id") % 4).cast("string")))

    def part(kind, sure):
        return o.where(F.col("kind") == kind).select("drawing_id", "floor", "height_mm", F.lit(sure).alias("confidence"), "x", "y")

    return merge_heights(part("door", 0.9), part("window", 0.72), KEYS).drop("confidence")
