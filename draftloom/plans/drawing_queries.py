"""Queries of per-drawing facts and geometry functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftloom.functions import geometry as g
from draftloom.functions import text as t
from draftloom.operators import drawings as d
from draftloom.operators import levels as lv
from draftloom.operators.ordered import mode
from draftloom.plans.derived import derived, derived_sql, read
from draftloom.plans.registry import query
from draftloom.plans.text_queries import ELEV
from draftloom.plans.wall_queries import WALLS, placed_walls

KEYS = ("drawing_id",)
SEG, OPEN, MARKS, STOREYS, STAIRS, TEXTS = (derived_sql(r) for r in ("segments", "openings", "marks", "storeys", "stairs", "texts"))


def _ring(spark, sf_dir):
    """An L-shaped outline per opening."""
    o = derived(spark, sf_dir, "openings")
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "width_mm", "height_mm"))
    corners = [(x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), (x, y + h)]
    return o.withColumn("ring", F.array(*[g.point(a, b) for a, b in corners]))


@query("polygon_measures", "G7", f"""select opening_id, cast(width_mm*height_mm*0.75 as double) area, round((4*x+2.5*width_mm+2*x+0.5*width_mm)/6.0,3)::double cx, round((6*y+3*height_mm)/6.0,3)::double cy,
 cast(width_mm as double) box_width, cast(height_mm as double) box_height from {OPEN}""")
def polygon_measures(spark, sf_dir):
    c, b = g.polygon_centroid("ring"), g.bounding_box("ring")
    return _ring(spark, sf_dir).select(
        "opening_id", g.polygon_area("ring").alias("area"), F.round(c["x"], 3).alias("cx"), F.round(c["y"], 3).alias("cy"),
        (b["x1"] - b["x0"]).alias("box_width"), (b["y1"] - b["y0"]).alias("box_height"))


@query("points_in_polygons", "G8", f"""with p as (select opening_id, x, y, width_mm w, height_mm h, x+(opening_id%13)*100+31 px, y+(opening_id%17)*100+37 py from {OPEN})
 select opening_id, px>x and px<x+w and py>y and py<y+h and not (px>x+w/2.0 and py>y+h/2.0) inside from p""")
def points_in_polygons(spark, sf_dir):
    px, py = F.col("x") + F.col("opening_id") % 13 * 100 + 31, F.col("y") + F.col("opening_id") % 17 * 100 + 37
    return _ring(spark, sf_dir).select("opening_id", g.point_in_or_on_polygon(px.cast("double"), py.cast("double"), "ring", 0.0).alias("inside"))


@query("boundaries_inside", "G9", f"""select opening_id, opening_id%5<>0 and (opening_id%4*100+200<=width_mm/2.0 or true) and not (opening_id%5=0) inside from {OPEN}""")
def boundaries_inside(spark, sf_dir):
    # A square in the lower left quarter; every fifth one is moved outside.
    shift = F.when(F.col("opening_id") % 5 == 0, 100000.0).otherwise(0.0)
    x, y = F.col("x") + shift, F.col("y").cast("double")
    small = F.array(*[g.point(x + a, y + b) for a, b in ((0, 0), (300, 0), (300, 300), (0, 300), (0, 0))])
    return _ring(spark, sf_dir).select("opening_id", g.polygon_in_polygon(small, F.col("ring")).alias("inside"))


@query("box_relations", "G10", f"""with a as (select opening_id, drawing_id, x x0, y y0, x+width_mm x1, y+height_mm y1 from {OPEN}), p as (select a.opening_id, b.opening_id other_id, greatest(b.x0-a.x1,a.x0-b.x1,0) gx, greatest(b.y0-a.y1,a.y0-b.y1,0) gy,
 greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0) shared, least((a.x1-a.x0)*(a.y1-a.y0),(b.x1-b.x0)*(b.y1-b.y0)) smaller, b.x0>=a.x0-12 and b.y0>=a.y0-12 and b.x1<=a.x1+12 and b.y1<=a.y1+12 holds
 from a join a b on a.drawing_id=b.drawing_id and b.opening_id=a.opening_id+1) select opening_id, other_id, gx*gx+gy*gy gap2, cast(floor(shared*100.0/smaller+1e-9) as bigint) share_percent, holds from p""")
def box_relations(spark, sf_dir):
    o = derived(spark, sf_dir, "openings").select("drawing_id", "opening_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width_mm")).alias("x1"), (F.col("y") + F.col("height_mm")).alias("y1"))
    a = o.select("drawing_id", "opening_id", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    b = o.select("drawing_id", F.col("opening_id").alias("other_id"), (F.col("opening_id") - 1).alias("opening_id"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    return a.join(b, ["drawing_id", "opening_id"]).select(
        "opening_id", "other_id", F.round(F.pow(g.box_gap("a_", "b_"), F.lit(2))).cast("bigint").alias("gap2"), F.floor(g.box_overlap_share("a_", "b_") * 100 + 1e-9).cast("bigint").alias("share_percent"), g.box_contains("a_", "b_").alias("holds"))


@query("arc_measures", "G11", f"""with a as (select opening_id, (opening_id*37)%360 a0, (opening_id*37+61+opening_id%7*10)%360 a1 from {OPEN}), s as (select *, (a1-a0+360)%360 w from a), m as (select *, (a0+w/2.0)%360 md from s)
 select opening_id, cast(case when w<=180 then w else 360-w end as bigint) sweep, case when md<=45 or md>=315 then 'east' when md<135 and md>45 then 'north' when md>=135 and md<=225 then 'west' else 'south' end direction,
 round(700*cos(radians(a0)),3) sx, round(700*sin(radians(a1)),3) ey from m""")
def arc_measures(spark, sf_dir):
    a0 = F.col("opening_id") * 37 % 360
    a1 = (F.col("opening_id") * 37 + 61 + F.col("opening_id") % 7 * 10) % 360
    ends = g.arc_ends(F.lit(0.0), F.lit(0.0), F.lit(700.0), a0, a1)
    return derived(spark, sf_dir, "openings").select("opening_id", g.arc_sweep(a0, a1).cast("bigint").alias("sweep"), g.arc_direction(a0, a1).alias("direction"), F.round(ends["sx"], 3).alias("sx"), F.round(ends["ey"], 3).alias("ey"))


@query("polygon_edges", "G15", f"""select opening_id, case when opening_id%2=0 then 6 else 5 end edges, case when opening_id%2=0 then 2*(width_mm+height_mm) else 2*width_mm+height_mm end total from {OPEN}""")
def polygon_edges(spark, sf_dir):
    edges = _ring(spark, sf_dir).select("opening_id", F.explode(g.polygon_edges("ring", F.col("opening_id") % 2 == 0)).alias("e"))
    size = F.abs(F.col("e.b.x") - F.col("e.a.x")) + F.abs(F.col("e.b.y") - F.col("e.a.y"))
    return edges.groupBy("opening_id").agg(F.count(F.lit(1)).cast("int").alias("edges"), F.sum(size).cast("bigint").alias("total"))


ORIGIN = f"""og as (select drawing_id, min(case when ori='V' then x1 end) vx, min(case when ori='H' then y1 end) hy from {WALLS} group by drawing_id)"""


@query("origin", "A19", f"with {ORIGIN} select drawing_id, cast(case when vx is null or hy is null then 0 else vx end as bigint) ox, cast(case when vx is null or hy is null then 0 else hy end as bigint) oy, case when vx is null or hy is null then 'fallback_world_origin' else 'left_bottom_axis_intersection' end source from og")
def origin(spark, sf_dir):
    axes = placed_walls(spark, sf_dir).withColumn("name", F.lit(None).cast("string"))
    found = d.drawing_origin(axes, KEYS)
    return found.select("drawing_id", F.col("ox").cast("bigint").alias("ox"), F.col("oy").cast("bigint").alias("oy"), "source")


@query("local_coordinates", "G13", f"""with {ORIGIN} select w.drawing_id, w.id, cast(x1-case when vx is null or hy is null then 0 else vx end as bigint) local_x1, cast(y1-case when vx is null or hy is null then 0 else hy end as bigint) local_y1 from {WALLS} w join og using (drawing_id)""")
def local_coordinates(spark, sf_dir):
    walls = placed_walls(spark, sf_dir)
    found = d.local_points(walls, d.drawing_origin(walls.withColumn("name", F.lit(None).cast("string")), KEYS), KEYS, [("x1", "y1")])
    return found.select("drawing_id", "id", F.col("local_x1").cast("bigint").alias("local_x1"), F.col("local_y1").cast("bigint").alias("local_y1"))


@query("drawing_counts", "A1", f"select drawing_id, count(*) elements, count(*) filter (where kind='door') doors, count(*) filter (where kind='window') windows from {OPEN} group by drawing_id")
def drawing_counts(spark, sf_dir):
    return d.drawing_counts(derived(spark, sf_dir, "openings"), KEYS)


@query("raw_inventory", "A2", f"""with e as (select drawing_id%40 sheet, seg_id, min(case when layer='A-DOOR' then 'INSERT' when ori='H' then 'LINE' else 'LWPOLYLINE' end) t from {SEG} group by all), k as (select *, case t when 'INSERT' then 'BLOCK' when 'LWPOLYLINE' then 'POLYLINE' else t end k from e)
 select sheet, seg_id, k||'-'||lpad(cast(row_number() over (partition by sheet, k order by seg_id) as string),6,'0') raw_id from k""")
def raw_inventory(spark, sf_dir):
    seg = derived(spark, sf_dir, "segments")
    kind = F.when(F.col("layer") == "A-DOOR", "INSERT").when(F.col("ori") == "H", "LINE").otherwise("LWPOLYLINE")
    e = seg.groupBy((F.col("drawing_id") % 40).alias("sheet"), "seg_id").agg(F.min(kind).alias("etype")).withColumn("ord", F.col("seg_id"))
    return d.raw_inventory(e, ["sheet"], bucket=10**13).select("sheet", "seg_id", "raw_id")


@query("mode_height", "A4 A5", f"""with c as (select drawing_id, height_mm h, count(*) n, min(mark_id) f from {MARKS} group by all)
 select drawing_id, arg_min(h,(-n,h)) smallest, arg_min(h,(-n,-h)) largest, arg_min(h,(-n,f)) first_seen from c group by drawing_id""")
def mode_height(spark, sf_dir):
    marks = derived(spark, sf_dir, "marks")
    out = None
    for ties, name in (("smallest", "smallest"), ("largest", "largest"), ("first", "first_seen")):
        one = mode(marks, KEYS, "height_mm", ties, "mark_id").select("drawing_id", F.col("value").alias(name))
        out = one if out is None else out.join(one, "drawing_id")
    return out


@query("common_heights", "A4", f"""with c as (select drawing_id, cast(round_even(height_mm/500.0,0)*500 as bigint) h, count(*) n, min(mark_id) f from {MARKS} where height_mm between 1800 and 6000 group by all) select drawing_id, arg_min(h,(-n,f)) height_mm from c group by drawing_id""")
def common_heights(spark, sf_dir):
    found = lv.common_height(derived(spark, sf_dir, "marks"), KEYS, "height_mm", 500.0, 1800, 6000, "mark_id")
    return found.select("drawing_id", F.col("value").cast("bigint").alias("height_mm"))


@query("wall_scope", "A6", f"""with w as (select *, count(*) over (partition by drawing_id) n, median(thickness_mm) over (partition by drawing_id) med, min(x1) over (partition by drawing_id) bx0, min(y1) over (partition by drawing_id) by0, max(x2) over (partition by drawing_id) bx1, max(y2) over (partition by drawing_id) by1 from {WALLS}),
 e as (select *, greatest(250, med*1.35) tol, thickness_mm-med dl, case when ori='H' then case when abs(y1-by0)<=greatest(250,med*1.35) then 'south' when abs(y1-by1)<=greatest(250,med*1.35) then 'north' end else case when abs(x1-bx0)<=greatest(250,med*1.35) then 'west' when abs(x1-bx1)<=greatest(250,med*1.35) then 'east' end end edge from w)
 select drawing_id, id, case when n<4 then 'unknown' when edge is not null then 'exterior' else 'interior' end wall_scope, case when n<4 then 'unknown' else coalesce(edge,'inside') end wall_outer_edge,
 round(case when n<4 then 0.35 when edge is not null then 0.84+case when dl>=40 then 0.06 when dl<=-80 then -0.12 else 0 end else 0.78+case when dl<=-40 then 0.05 when dl>=120 then -0.08 else 0 end end,3)::double confidence from e""")
def wall_scope(spark, sf_dir):
    found = d.wall_scopes(placed_walls(spark, sf_dir), KEYS)
    return found.select("drawing_id", "id", "wall_scope", "wall_outer_edge", F.col("wall_scope_confidence").alias("confidence"))


@query("slab_boundary", "A20", f"""with w as (select drawing_id, min(x1) x0, min(y1) y0, max(x2) x1, max(y2) y1 from {WALLS} group by drawing_id), o as (select drawing_id, min(x)-1000 x0, min(y)-1000 y0, max(x+width_mm)+1000 x1, max(y+height_mm)+1000 y1 from {OPEN} group by drawing_id)
 select coalesce(w.drawing_id,o.drawing_id) drawing_id, cast(coalesce(w.x0,o.x0) as bigint) x0, cast(coalesce(w.y0,o.y0) as bigint) y0, cast(coalesce(w.x1,o.x1) as bigint) x1, cast(coalesce(w.y1,o.y1) as bigint) y1, case when w.drawing_id is not null then 'wall_bbox_default_slab' else 'floor_opening_bbox_default_slab' end source
 from w full join o on w.drawing_id=o.drawing_id""")
def slab_boundary(spark, sf_dir):
    walls = placed_walls(spark, sf_dir).select("drawing_id", F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x2").alias("x1"), F.col("y2").alias("y1"))
    o = derived(spark, sf_dir, "openings").select("drawing_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width_mm")).alias("x1"), (F.col("y") + F.col("height_mm")).alias("y1"))
    none = o.where(F.lit(False))
    found = d.default_slabs(walls, none, o, none, KEYS)
    return found.select("drawing_id", *[F.col(c).cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")], "source")


@query("void_hosts", "J28 J36", f"""with s as (select drawing_id, opening_id id, x, y, width_mm*3 w, height_mm*3 h from {OPEN} where kind='window'), v as (select drawing_id, opening_id id, x+50 x, y+50 y from {OPEN} where kind='door'),
 i as (select v.drawing_id, v.id, min(s.id) host from v join s on s.drawing_id=v.drawing_id and v.x>=s.x and v.x<s.x+s.w and v.y>=s.y and v.y<s.y+s.h group by all), f as (select drawing_id, min(id) host from s group by drawing_id)
 select v.drawing_id, v.id, coalesce(i.host, f.host) host_floor_id, i.host is not null inside from v left join i using (drawing_id, id) left join f on f.drawing_id=v.drawing_id""")
def void_hosts(spark, sf_dir):
    o = derived(spark, sf_dir, "openings")
    x, y, w, h = F.col("x").cast("double"), F.col("y").cast("double"), F.col("width_mm") * 3.0, F.col("height_mm") * 3.0
    slabs = o.where("kind = 'window'").select("drawing_id", F.col("opening_id").alias("id"), F.col("opening_id").alias("ord"), F.array(g.point(x, y), g.point(x + w, y), g.point(x + w, y + h), g.point(x, y + h)).alias("boundary"))
    voids = o.where("kind = 'door'").select("drawing_id", F.col("opening_id").alias("id"), (F.col("x") + 50).alias("x"), (F.col("y") + 50).alias("y"))
    return d.void_hosts(voids, slabs, KEYS).select("drawing_id", "id", "host_floor_id", "inside")


@query("exterior_centers", "A10", f"""with w as (select *, id%3<>0 ext from {WALLS}), c as (select drawing_id, sum((x1+x2)/2.0*len)/sum(len) cx, sum((y1+y2)/2.0*len)/sum(len) cy from w where ext group by drawing_id)
 select w.drawing_id, w.id, round(cx,3) cx, round(cy,3) cy, coalesce(ext and (abs((x1+x2)/2.0-cx)>0.001 or abs((y1+y2)/2.0-cy)>0.001) and (-(y2-y1)*((x1+x2)/2.0-cx)+(x2-x1)*((y1+y2)/2.0-cy)) < 0, false) flip from w left join c using (drawing_id)""")
def exterior_centers(spark, sf_dir):
    walls = placed_walls(spark, sf_dir).withColumn("is_exterior", F.col("id") % 3 != 0)
    return d.outward_flips(walls, KEYS).select("drawing_id", "id", F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"), "flip")


@query("parapet_height", "A7", f"""with {ELEV}, x as (select drawing_id, text_id, cast(nullif(regexp_extract(text,'女儿墙 高度: (0\\.\\d)m',1),'') as double)*1000 h from {TEXTS}), c as (select drawing_id, round(h,1) h, count(*) n from x where h is not null group by all), m as (select drawing_id, arg_min(h,(-n,-h)) h from c group by drawing_id),
 r as (select drawing_id, 3300 b from {TEXTS} group by drawing_id), t as (select e.drawing_id, max(elevation_mm)-3300 rise from elev e where elevation_mm>3301 group by e.drawing_id)
 select r.drawing_id, cast(coalesce(m.h, case when rise between 250 and 6000 then rise end, 900) as bigint) height_mm, case when m.h is not null then 'text_annotation' when rise between 250 and 6000 then 'elevation_mark_difference' else 'default_review_required' end source from r left join m using (drawing_id) left join t using (drawing_id)""")
def parapet_height(spark, sf_dir):
    texts = derived(spark, sf_dir, "texts")
    marks = texts.select("drawing_id", F.explode(t.elevation_marks("text")).alias("m")).select("drawing_id", "m.elevation_mm")
    roofs = texts.select("drawing_id").distinct().withColumn("elevation_mm", F.lit(3300.0))
    found = d.parapet_heights(texts.select("drawing_id", t.parapet_height("text").alias("height_mm")), marks, roofs, KEYS)
    return found.select("drawing_id", F.round("height_mm").cast("bigint").alias("height_mm"), "source")


@query("level_confidence", "A9", f"""with {ELEV} select drawing_id, elevation_mm, count(*) n, round(least(1.0, 0.7+least(0.2,0.05*(count(*)-1))),3)::double confidence from elev group by all""")
def level_confidence(spark, sf_dir):
    texts = derived(spark, sf_dir, "texts")
    marks = texts.select("drawing_id", F.explode(t.elevation_marks("text")).alias("m")).select("drawing_id", "m.elevation_mm", F.lit(0.7).alias("confidence"))
    return lv.level_confidence(marks, KEYS).withColumn("elevation_mm", F.col("elevation_mm").cast("bigint"))


@query("storey_levels", "F7", f"""with {ELEV}, l as (select distinct drawing_id, elevation_mm e from elev), g as (select *, e-lag(e) over (partition by drawing_id order by e) gap, row_number() over (partition by drawing_id order by e desc)=1 top, count(*) over (partition by drawing_id) n from l),
 m as (select *, median(case when not top and gap>=1800 then gap end) over (partition by drawing_id) med from g) select drawing_id, e elevation_mm from m where not coalesce(top and n>=4 and gap>0 and gap<=1500 and gap<med*0.5, false)""")
def storey_levels(spark, sf_dir):
    texts = derived(spark, sf_dir, "texts")
    levels = texts.select("drawing_id", F.explode(t.elevation_marks("text")).alias("m")).select("drawing_id", F.round("m.elevation_mm").cast("bigint").alias("elevation_mm")).distinct()
    return lv.storey_levels(levels, KEYS)


@query("floor_list", "W4 W5 R7", f"""select project_id, row_number() over w floor_number, level_id base_level_id, elevation_mm base_elevation_mm, lead(level_id) over w top_level_id, cast(lead(elevation_mm) over w - elevation_mm as bigint) floor_height_mm from {STOREYS} window w as (partition by project_id order by elevation_mm, level_id)""")
def floor_list(spark, sf_dir):
    found = lv.floors_from_levels(derived(spark, sf_dir, "storeys"), ["project_id"])
    return found.select("project_id", "floor_number", "base_level_id", "base_elevation_mm", "top_level_id", F.col("floor_height_mm").cast("bigint").alias("floor_height_mm"))


_PLANS = """(select cast(c_custkey%5 as bigint) project_id, c_custkey drawing_id, case c_custkey%4 when 0 then concat('plan L',c_custkey%6) when 1 then 'Roof plan' when 2 then concat(c_custkey%7,'F plan') else 'sheet' end drawing_name,
 case when c_custkey%3=0 then concat(c_custkey%8,'.0') end drawing_number, case when c_custkey%11=0 then concat('level-',lpad(cast(c_custkey%25 as string),3,'0')) else '' end level_id from customer)"""


@query("plan_floors", "J31", f"""with f as (select project_id, row_number() over (partition by project_id order by elevation_mm, level_id) n, level_id, "name" from {STOREYS}), x as (select *, lower(drawing_name) dn, try_cast(drawing_number as double) num, try_cast(nullif(regexp_extract(lower(drawing_name),'(?:^|[^a-z0-9])(\\d{{1,2}})\\s*f(?:[^a-z0-9]|$)',1),'') as int) dnf from {_PLANS}),
 p as (select x.*, f.n, f.level_id fl, case when lower(trim(x.level_id))=lower(f.level_id) then 0 when contains(dn, lower(f."name")) then 1 when num=floor(num) and num=f.n then 4 end r from x join f using (project_id)),
 b as (select project_id, drawing_id, min((r, n, fl)) m from p where r is not null group by all) select x.project_id, x.drawing_id, cast(b.m[2] as int) floor_number, b.m[3] base_level_id, case b.m[1] when 0 then 'level_id' when 1 then 'name' when 4 then 'number' else 'unassigned' end reason from x left join b using (project_id, drawing_id)""".replace("min((r, n, fl)) m", "min(struct_pack(r := r, n := n, fl := fl)) m").replace("b.m[2]", "b.m.n").replace("b.m[3]", "b.m.fl").replace("b.m[1]", "b.m.r"))
def plan_floors(spark, sf_dir):
    plans = read(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey%5 as bigint) project_id", "c_custkey drawing_id",
        "case c_custkey%4 when 0 then concat('plan L',c_custkey%6) when 1 then 'Roof plan' when 2 then concat(c_custkey%7,'F plan') else 'sheet' end drawing_name",
        "case when c_custkey%3=0 then concat(c_custkey%8,'.0') end drawing_number",
        "case when c_custkey%11=0 then concat('level-',lpad(cast(c_custkey%25 as string),3,'0')) else '' end level_id")
    floors = lv.floors_from_levels(derived(spark, sf_dir, "storeys"), ["project_id"])
    return lv.assign_plans(plans, floors, ["project_id"]).select("project_id", "drawing_id", "floor_number", "base_level_id", "reason")


@query("nearest_levels", "J34 J30", f"""with p as (select s.project_id, s.id, l.level_id, abs(z0-elevation_mm) g, elevation_mm e from {STAIRS} s join {STOREYS} l using (project_id) where abs(z0-elevation_mm)<=100), k as (select *, row_number() over (partition by project_id, id order by g, e, level_id) rn from p)
 select s.project_id, s.id, k.level_id, k.g level_gap from {STAIRS} s left join (select * from k where rn=1) k on k.project_id=s.project_id and k.id=s.id""")
def nearest_levels(spark, sf_dir):
    stairs = derived(spark, sf_dir, "stairs").select("project_id", "id", "z0")
    return lv.nearest_level(stairs, derived(spark, sf_dir, "storeys"), ["project_id"], "id", "z0").drop("z0")


@query("stair_segments", "W7", f"""with l as (select *, row_number() over (partition by project_id order by number, level_id) n, count(*) over (partition by project_id) c from {STOREYS}), k as (select project_id, max(c) c from l group by project_id),
 s as (select s.*, case when span>1 and c>=span+1 then span else 1 end parts from {STAIRS} s left join k using (project_id)), e as (select *, unnest(range(1,parts+1))::int segment from s),
 t as (select *, case when parts>1 then cast(round_even(risers*1.0/parts,0) as bigint) else risers end r2, case when parts>1 then cast(round_even(treads*1.0/parts,0) as bigint) else treads end t2 from e)
 select t.project_id, t.id, segment, case when parts>1 then a.level_id end start_level, case when parts>1 then b.level_id end end_level, round(total_rise_mm*1.0/parts,3)::double total_rise_mm, r2 risers, t2 treads, tread_mm*cast(round_even(t2*1.0/run_count,0) as bigint) run_length_mm
 from t left join l a on a.project_id=t.project_id and a.n=t.segment left join l b on b.project_id=t.project_id and b.n=t.segment+1""")
def stair_segments(spark, sf_dir):
    found = d.stair_segments(derived(spark, sf_dir, "stairs"), derived(spark, sf_dir, "storeys"))
    return found.drop("segment_id", "total_run_mm")


@query("window_offsets", "W6 R9", f"""with l as (select project_id, "name", elevation_mm b, lead(elevation_mm) over (partition by project_id order by elevation_mm) nx from {STOREYS}), w as (select cast(o_custkey%5 as bigint) project_id, o_orderkey id, concat('L',o_orderkey%6) "level", cast((o_orderkey%61)*250 as bigint) sill, cast((10+o_custkey%8)*100 as bigint) h, o_orderkey%2=0 fe from orders),
 j as (select w.*, b, nx-b st, (select max(m.b) from l m where m.project_id=w.project_id and m.b<=w.sill+1) fl from w left join l on l.project_id=w.project_id and l."name"=w."level"),
 r as (select *, case when b is not null and fe and st is not null and sill+h>st+1 then case when sill-fl+h<=st+1 then sill-fl else sill end when b>0 and sill>=b-1 then sill-b else sill end s2 from j)
 select project_id, id, cast(s2 as bigint) sill_mm, cast(b+s2+h as bigint) top_elevation_mm, case when b is not null then 'ready' else 'needs_review' end binding_status from r""")
def window_offsets(spark, sf_dir):
    w = read(spark, sf_dir, "orders").selectExpr("cast(o_custkey%5 as bigint) project_id", "o_orderkey id", "concat('L',o_orderkey%6) level", "cast((o_orderkey%61)*250 as bigint) sill_mm", "cast((10+o_custkey%8)*100 as bigint) height_mm", "o_orderkey%2=0 from_elevation")
    found = d.window_offsets(w, derived(spark, sf_dir, "storeys"))
    return found.select("project_id", "id", F.col("sill_mm").cast("bigint").alias("sill_mm"), F.col("top_elevation_mm").cast("bigint").alias("top_elevation_mm"), "binding_status")


@query("slab_offsets", "R23", f"""select opening_id, cast(case when abs(e)<=1000 then e when abs(e-b)<=1000 then e-b else e end as bigint) offset_mm from (select opening_id, x-1500 e, (opening_id%3)*3300 b from {OPEN})""")
def slab_offsets(spark, sf_dir):
    o = derived(spark, sf_dir, "openings")
    return o.select("opening_id", d.slab_offset(F.col("x") - 1500.0, F.col("opening_id") % 3 * 3300.0).cast("bigint").alias("offset_mm"))


_LAYERS = """(select l_orderkey%500 project_id, l_orderkey wall_id, cast(l_linenumber as bigint) layer_no, min((['concrete','paint finish','plaster','insulation board','brick','tile','interior lining'])[1+l_partkey%7]) material, max(cast(l_partkey%3*l_suppkey%40 as bigint)) thickness_mm from lineitem group by all)"""


def _layers(spark, sf_dir):
    words = F.array(*map(F.lit, ["concrete", "paint finish", "plaster", "insulation board", "brick", "tile", "interior lining"]))
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 500).alias("project_id"), F.col("l_orderkey").alias("wall_id"), F.col("l_linenumber").cast("bigint").alias("layer_no")).agg(
        F.min(F.element_at(words, (F.col("l_partkey") % 7 + 1).cast("int"))).alias("material"), F.max((F.col("l_partkey") % 3 * F.col("l_suppkey") % 40).cast("bigint")).alias("thickness_mm"))


@query("wall_layers", "A18", f"""with a as (select *, case when regexp_matches(material,'insulation') then 'insulation' when regexp_matches(material,'interior') then 'finish2' when regexp_matches(material,'finish|paint|plaster|tile') then 'finish1' else 'structure' end f,
 case when thickness_mm>0 then thickness_mm when regexp_matches(material,'paint') then 5 when regexp_matches(material,'plaster') then 15 when regexp_matches(material,'tile') then 10 when regexp_matches(material,'insulation') then 50 else 20 end t from {_LAYERS}),
 b as (select *, bool_or(f='structure') over w has, first_value(layer_no) over (partition by wall_id order by t desc, layer_no) thick from a window w as (partition by wall_id)), c as (select *, case when not has and layer_no=thick then 'structure' else f end fn from b),
 e as (select *, sum(case when fn='structure' then greatest(1,t) end) over w core, coalesce(sum(case when fn<>'structure' then greatest(1,t) end) over w,0) rest from c window w as (partition by wall_id))
 select wall_id, layer_no, fn "function", round(case when fn='structure' then greatest(1.0, greatest(1.0, 200-rest)*greatest(1,t)/core) else greatest(1,t) end,3)::double thickness_mm from e""")
def wall_layers(spark, sf_dir):
    layers = _layers(spark, sf_dir).withColumn("role", F.lit(""))
    walls = layers.select("project_id", F.col("wall_id").alias("id")).distinct().withColumn("thickness_mm", F.lit(200))
    return d.wall_layers(layers, walls, ["project_id"]).select("wall_id", "layer_no", "function", "thickness_mm")


@query("parapet_layers", "J45", f"""with l as (select * from {_LAYERS}), t as (select wall_id, sum(case when thickness_mm>0 then thickness_mm end) s from l group by wall_id)
 select wall_id+1000000 parapet_id, layer_no, material, round(case when thickness_mm>0 then thickness_mm*case when s>1e-9 then 150.0/s else 1 end else 0 end,3)::double thickness_mm from l join t using (wall_id)""")
def parapet_layers(spark, sf_dir):
    layers = _layers(spark, sf_dir)
    parapets = layers.select("project_id", (F.col("wall_id") + 1000000).alias("id"), F.col("wall_id").alias("source_wall_id")).distinct().withColumn("thickness_mm", F.lit(150.0))
    return d.inherited_layers(parapets, layers, ["project_id"]).select("parapet_id", "layer_no", "material", "thickness_mm")


@query("superseded_walls", "J37", f"""select drawing_id, id from (select *, case when id%2=0 then 0 else len*3//10 end cut, id%7*200 sh from {WALLS}) where sh<=greatest(500, thickness_mm+200) and (len-cut)*1.0/len>=0.8 or (sh<=greatest(500, thickness_mm+200) and least(len,len-cut)>0 and (len-cut)*1.0/least(len,len-cut)>=0.8)""")
def superseded_walls(spark, sf_dir):
    walls = placed_walls(spark, sf_dir).withColumn("level", F.lit("L1"))
    cut = F.when(F.col("id") % 2 == 0, 0).otherwise(F.floor(F.col("len") * 3 / 10))
    shift = F.col("id") % 7 * 200
    h = F.col("ori") == "H"
    parapets = walls.select("drawing_id", F.col("id").alias("source_wall_id"), F.when(h, F.col("x1") + cut).otherwise(F.col("x1") + shift).alias("x1"), F.when(h, F.col("y1") + shift).otherwise(F.col("y1") + cut).alias("y1"),
                            F.when(h, F.col("x2")).otherwise(F.col("x2") + shift).alias("x2"), F.when(h, F.col("y2") + shift).otherwise(F.col("y2")).alias("y2"), F.lit(200).alias("thickness_mm"), F.lit("L1").alias("level"))
    return d.superseded_walls(walls, parapets, KEYS)


@query("placed_openings", "J44", f"""with o as (select opening_id, drawing_id, opening_id%9*700-300 t, w.id, x1, y1, x2, y2, len from {OPEN} o join (select drawing_id, arg_min(struct_pack(id := id, x1 := x1, y1 := y1, x2 := x2, y2 := y2, len := len), id) s from {WALLS} group by drawing_id) q using (drawing_id), lateral (select s.id, s.x1, s.y1, s.x2, s.y2, s.len) w),
 m as (select *, least(200, len*0.05) mg from o) select opening_id, round(x1+(x2-x1)*greatest(mg/len, least(1-mg/len, t*1.0/len)),3)::double x, round(y1+(y2-y1)*greatest(mg/len, least(1-mg/len, t*1.0/len)),3)::double y from m""")
def placed_openings(spark, sf_dir):
    walls = placed_walls(spark, sf_dir)
    first = walls.groupBy("drawing_id").agg(F.min(F.struct("id", "ori", "x1", "y1")).alias("s"))
    t, h = F.col("opening_id") % 9 * 700 - 300, F.col("s.ori") == "H"
    o = derived(spark, sf_dir, "openings").join(first, "drawing_id").select(
        "drawing_id", "opening_id", F.col("s.id").alias("host_wall_id"), F.when(h, F.col("s.x1") + t).otherwise(F.col("s.x1") + 130).alias("x"), F.when(h, F.col("s.y1") + 130).otherwise(F.col("s.y1") + t).alias("y"))
    return d.placed_on_hosts(o, walls, KEYS).select("opening_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query("stair_target_floors", "J29", f"""with f as (select project_id, level_id floor_id, number from {STOREYS}), lo as (select project_id, min(number) lw from f group by all), s as (select *, case when id%6=0 then 'LEVEL-'||lpad((id%25)::string,3,'0') end hf, case when id%3=0 then id%4 end sn, case when id%3=0 then id%5 end en from {STAIRS}),
 t as (select s.project_id, s.id, f.floor_id, false projected from s join f on f.project_id=s.project_id and f.floor_id=s.hf union all select s.project_id, s.id, f.floor_id, true from s join lo using (project_id) join f on f.project_id=s.project_id where hf is null and case when en>sn then f.number>sn and f.number<=en else span>1 and f.number>lw and f.number<=lw+span end)
 select s.project_id, s.id, t.floor_id, t.projected, t.floor_id is null needs_mapping from s left join t using (project_id, id)""")
def stair_target_floors(spark, sf_dir):
    s = derived(spark, sf_dir, "stairs")
    host = F.when(F.col("id") % 6 == 0, F.concat(F.lit("LEVEL-"), F.lpad((F.col("id") % 25).cast("string"), 3, "0")))
    ranged = F.col("id") % 3 == 0
    s = s.select("project_id", "id", host.alias("host_floor_id"), F.when(ranged, F.col("id") % 4).alias("start_number"), F.when(ranged, F.col("id") % 5).alias("end_number"), "span")
    floors = derived(spark, sf_dir, "storeys").select("project_id", F.col("level_id").alias("floor_id"), "number")
    return d.stair_target_floors(s, floors)
