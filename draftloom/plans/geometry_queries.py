"""Queries of rectangles, frames and ordered de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftloom.functions import geometry as g
from draftloom.operators import dedupe as dd
from draftloom.operators import rectangles as rc
from draftloom.plans.derived import derived, derived_sql
from draftloom.plans.registry import query, serial_sql
from draftloom.plans.wall_queries import WALLS, placed_walls

KEYS = ("drawing_id",)
SEG, DOORS, COMP, OPEN = (derived_sql(r) for r in ("segments", "sheet_openings", "components", "openings"))
# Lines of 40 drawings on one sheet, so that corners meet.
SHEET = f"(select cast(floor(drawing_id/40.0) as bigint) drawing_id, ori, off_mm, lo, hi, min(seg_id) id, min(layer) layer from {SEG} group by all)"


def sheet_lines(spark, sf_dir):
    seg = derived(spark, sf_dir, "segments")
    cut = seg.groupBy(F.floor(F.col("drawing_id") / 40).cast("bigint").alias("drawing_id"), "ori", "off_mm", "lo", "hi").agg(F.min("seg_id").alias("id"), F.min("layer").alias("layer"))
    h = F.col("ori") == "H"
    ends = {"x1": ("lo", "off_mm"), "y1": ("off_mm", "lo"), "x2": ("hi", "off_mm"), "y2": ("off_mm", "hi")}
    return cut.select("*", F.col("id").alias("ord"), *[F.when(h, F.col(a)).otherwise(F.col(b)).alias(n) for n, (a, b) in ends.items()])


@query("rectangles", "J4", f"""with s as {SHEET} select l.drawing_id, least(l.id,r.id) a_id, greatest(l.id,r.id) b_id, b.id bottom_id, t.id top_id, l.off_mm x0, l.lo y0, r.off_mm x1, l.hi y1
 from s l join s r on l.drawing_id=r.drawing_id and l.ori='V' and r.ori='V' and l.lo=r.lo and l.hi=r.hi and l.off_mm<r.off_mm join s b on b.drawing_id=l.drawing_id and b.ori='H' and b.off_mm=l.lo and b.lo=l.off_mm and b.hi=r.off_mm join s t on t.drawing_id=l.drawing_id and t.ori='H' and t.off_mm=l.hi and t.lo=l.off_mm and t.hi=r.off_mm""")
def rectangles(spark, sf_dir):
    found = rc.line_rectangles(sheet_lines(spark, sf_dir), KEYS)
    return found.select("drawing_id", *[F.col("segment_ids")[i].alias(n) for i, n in enumerate(("a_id", "b_id", "bottom_id", "top_id"))], *[F.col(c).cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("fragmented_rectangles", "J5", f"""with s as (select drawing_id, ori, off_mm, lo, hi from {SHEET}), m as (select *, max(hi) over (partition by drawing_id,ori,off_mm order by lo,hi rows between unbounded preceding and 1 preceding) pm from s),
 r as (select *, sum(case when pm is null or lo-pm>8 then 1 else 0 end) over (partition by drawing_id,ori,off_mm order by lo,hi) run from m), i as (select drawing_id, ori, off_mm o, run, min(lo) lo, max(hi) hi from r group by all),
 v as (select * from i where ori='V'), h as (select * from i where ori='H'), q as (select distinct a.drawing_id, a.o x0, b.o x1, a.lo alo, a.hi ahi, b.lo blo, b.hi bhi from v a join v b on a.drawing_id=b.drawing_id and b.o-a.o between 100 and 1500)
 select distinct q.drawing_id, x0, p.o y0, x1, t.o y1 from q join h p on p.drawing_id=q.drawing_id and p.lo<=x0+8 and p.hi>=x1-8 and p.o>=greatest(alo,blo)-8 and p.o<=least(ahi,bhi)+8
 join h t on t.drawing_id=q.drawing_id and t.lo<=x0+8 and t.hi>=x1-8 and t.o>=greatest(alo,blo)-8 and t.o<=least(ahi,bhi)+8 and t.o-p.o between 100 and 1500 and greatest(t.o-p.o,x1-x0)<=4*least(t.o-p.o,x1-x0)""")
def fragmented_rectangles(spark, sf_dir):
    found = rc.fragmented_rectangles(sheet_lines(spark, sf_dir), KEYS)
    return found.select("drawing_id", *[F.col(c).cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("elevation_openings", "J6 R4 H4", None)
def elevation_openings(spark, sf_dir):
    lines = sheet_lines(spark, sf_dir)
    o = derived(spark, sf_dir, "openings")
    # Blocks without bounds have no rectangle.
    bounded = F.col("opening_id") % 5 == 0
    blocks = o.select(F.floor(F.col("drawing_id") / 40).cast("bigint").alias("drawing_id"), F.col("opening_id").alias("ord"), F.lit("A-BLOCK").alias("layer"), "kind", F.lit(None).cast("string").alias("category"),
                                                 *[F.when(bounded, e).alias(n) for n, e in (("x0", F.col("x")), ("y0", F.col("y")), ("x1", F.col("x") + F.col("width_mm")), ("y1", F.col("y") + F.col("height_mm")))])
    found = rc.elevation_openings(lines, blocks, lines.where("layer = 'A-WALL'"), KEYS)
    return rc.window_categories(found, lines, KEYS).select("drawing_id", "id", "kind", "x", "y", "width", "height_mm", "sill_mm", "category", "source")


@query("folded_voids", "J7", None)
def folded_voids(spark, sf_dir):
    lines = sheet_lines(spark, sf_dir)
    rects = rc.line_rectangles(lines, KEYS).withColumn("id", F.concat_ws("-", "segment_ids"))
    o = derived(spark, sf_dir, "openings")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    bends = o.select(F.floor(F.col("drawing_id") / 40).cast("bigint").alias("drawing_id"), F.col("opening_id").alias("id"), F.array(g.point(x, y), g.point(x + 100, y + 100), g.point(x + 200, y)).alias("points"), F.lit(False).alias("closed"))
    return rc.folded_voids(rects, lines, bends, KEYS).select("drawing_id", "id", "fold_count")


def _boxes(spark, sf_dir):
    o = derived(spark, sf_dir, "sheet_openings")
    step = 3000
    return o.select("drawing_id", F.col("opening_id").alias("id"), F.col("opening_id").alias("ord"), (F.floor(F.col("x") / step) * step + F.col("opening_id") % 3 * 40).alias("x0"), (F.floor(F.col("y") / step) * step).alias("y0")).withColumn(
        "x1", F.col("x0") + 2000 + F.col("id") % 4 * 300).withColumn("y1", F.col("y0") + 1500 + F.col("id") % 5 * 200)


@query("frame_boxes", "F2 W10", f"""with p as (select drawing_id, opening_id id, opening_id%7*1000 w, opening_id%5*1000 h, opening_id%3=0 cut from {DOORS}) select drawing_id, id, w, h from p where w>=1000 and h>=1000 and not cut""")
def frame_boxes(spark, sf_dir):
    o = derived(spark, sf_dir, "sheet_openings").withColumn("id", F.col("opening_id"))
    x, y, w, h = F.col("x").cast("double"), F.col("y").cast("double"), F.col("id") % 7 * 1000.0, F.col("id") % 5 * 1000.0
    cut = F.when(F.col("id") % 3 == 0, 0.5).otherwise(1.0)
    ring = F.array(g.point(x, y), g.point(x + w, y), g.point(x + w, y + h * cut), g.point(x, y + h))
    frames = dd.frame_boxes(o.select("drawing_id", "id", ring.alias("points"), F.lit(True).alias("closed")), KEYS)
    return frames.select("drawing_id", "id", (F.col("x1") - F.col("x0")).cast("bigint").alias("w"), (F.col("y1") - F.col("y0")).cast("bigint").alias("h"))


FRAMES = f"(select drawing_id, opening_id fid, (opening_id%3)*20000 x0, (opening_id%3)*20000+21000 x1, 0 y0, 40000 y1, row_number() over (partition by drawing_id order by opening_id) rn from {DOORS})"


@query("framed_entities", "F1", f"""with f as (select drawing_id, x0, x1, y0, y1, min(fid) fid from {FRAMES} group by all) select o.drawing_id, opening_id, fid frame from {DOORS} o join f on f.drawing_id=o.drawing_id and o.x between f.x0 and f.x1 and o.y between f.y0 and f.y1""")
def framed_entities(spark, sf_dir):
    o = derived(spark, sf_dir, "sheet_openings")
    f = o.groupBy("drawing_id", (F.col("opening_id") % 3 * 20000).alias("x0")).agg(F.min("opening_id").alias("frame_id")).withColumn("x1", F.col("x0") + 21000).withColumn("y0", F.lit(0)).withColumn("y1", F.lit(40000))
    found = dd.in_frames(o.select("drawing_id", "opening_id", "x", "y"), f, KEYS)
    return found.select("drawing_id", "opening_id", F.col("frame_id").alias("frame"))


@query("frame_numbers", "W10", f"""with b as (select drawing_id, opening_id id, x x0, y+height_mm y1 from {DOORS}) select drawing_id, id, 'F'||lpad(cast(row_number() over (partition by drawing_id order by y1 desc, x0, id) as string),3,'0') frame_id from b""")
def frame_numbers(spark, sf_dir):
    o = derived(spark, sf_dir, "sheet_openings").select("drawing_id", F.col("opening_id").alias("id"), F.col("opening_id").alias("ord"), F.col("x").alias("x0"), (F.col("y") + F.col("height_mm")).alias("y1"))
    found = dd.numbered_frames(o, KEYS)
    return found.select("drawing_id", "id", "frame_id")


_BOXED = f"""select *, row_number() over (partition by drawing_id order by -((x1-x0)*(y1-y0)), id) rk from (select *, x0+2000+id%4*300 x1, y0+1500+id%5*200 y1
 from (select drawing_id, opening_id id, floor(x/3000)*3000+opening_id%3*40 x0, floor(y/3000)*3000 y0 from {DOORS}))"""
_CENTRES = "sqrt(pow((a.x0+a.x1)/2-(b.x0+b.x1)/2,2)+pow((a.y0+a.y1)/2-(b.y0+b.y1)/2,2))<=160"
_IN = "({1}.x0>={0}.x0-12 and {1}.y0>={0}.y0-12 and {1}.x1<={0}.x1+12 and {1}.y1<={0}.y1+12)"


@query("distinct_frames", "H1 F2", serial_sql(_BOXED, "greatest(0,least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0,least(a.y1,b.y1)-greatest(a.y0,b.y0))/least((a.x1-a.x0)*(a.y1-a.y0),(b.x1-b.x0)*(b.y1-b.y0))>0.92"))
def distinct_frames(spark, sf_dir):
    return dd.distinct_frames(_boxes(spark, sf_dir), KEYS).select("drawing_id", "id", "kept", "duplicate_of")


@query("distinct_columns", "H2 F2", serial_sql(f"select drawing_id, opening_id id, floor(x/1000)*1000+opening_id%4*8 x, floor(y/1000)*1000 y, kind, width_mm/20.0 size, row_number() over (partition by drawing_id order by opening_id) rk from {DOORS}",
                                              "a.kind=b.kind and sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<=20 and abs(a.size-b.size)<=20"))
def distinct_columns(spark, sf_dir):
    o = derived(spark, sf_dir, "sheet_openings").select("drawing_id", F.col("opening_id").alias("id"), F.col("opening_id").alias("ord"), (F.floor(F.col("x") / 1000) * 1000 + F.col("opening_id") % 4 * 8).alias("x"), (F.floor(F.col("y") / 1000) * 1000).alias("y"), F.col("kind").alias("shape"), (F.col("width_mm") / 20).alias("size"))
    return dd.distinct_columns(o, KEYS).select("drawing_id", "id", "kept", "duplicate_of")


_NEAR = "sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<=greatest(450.0,least(1200.0,b.width_mm*0.65),least(1200.0,a.width_mm*0.65))"


@query("distinct_openings", "H3", serial_sql(f"""select *, row_number() over (partition by drawing_id order by id) rk from (select drawing_id, opening_id id, x, y, width_mm from {DOORS} b where kind='door'
 and not exists (select 1 from {DOORS} a where a.kind='window' and a.drawing_id=b.drawing_id and {_NEAR}))""", _NEAR))
def distinct_openings(spark, sf_dir):
    o = derived(spark, sf_dir, "sheet_openings").select("drawing_id", F.col("opening_id").alias("id"), F.col("opening_id").alias("ord"), "x", "y", F.col("width_mm").alias("width"), "kind")
    return dd.distinct_openings(o.where("kind = 'door'").drop("kind"), o.where("kind = 'window'").drop("kind"), KEYS).select("drawing_id", "id", "kept", "duplicate_of")


@query("distinct_rectangles", "H4", serial_sql(_BOXED, f"{_CENTRES} or {_IN.format('a', 'b')} or {_IN.format('b', 'a')}"))
def distinct_rectangles(spark, sf_dir):
    return dd.distinct_rectangles(_boxes(spark, sf_dir), KEYS).select("drawing_id", "id", "kept", "duplicate_of")


@query("distinct_railings", "H5", serial_sql(f"select drawing_id, id, ori, off_mm+case when ori='H' then id%3*15 else 0 end o, lo, hi, len, row_number() over (partition by drawing_id order by id) rk from {WALLS}",
                                               "a.ori=b.ori and abs(a.o-b.o)<50 and greatest(0,least(a.hi,b.hi)-greatest(a.lo,b.lo))/greatest(1.0,least(a.len,b.len))>=0.85"))
def distinct_railings(spark, sf_dir):
    w = placed_walls(spark, sf_dir)
    shift = F.col("id") % 3 * 15
    h = F.col("ori") == "H"
    r = w.select("drawing_id", "id", "ord", "x1", F.when(h, F.col("y1") + shift).otherwise(F.col("y1")).alias("y1"), "x2", F.when(h, F.col("y2") + shift).otherwise(F.col("y2")).alias("y2"))
    return dd.distinct_railings(r, KEYS).select("drawing_id", "id", "kept", "duplicate_of")


_TWINS = f"""select *, row_number() over (partition by project_id order by len desc, case when thickness_mm<>0 then 0 else 1 end, id%10 desc, id) rk
 from (select cast(floor(drawing_id/2.0) as bigint) project_id, id, drawing_id%2 lv, right(id::varchar,1) sheet, id%3 fl, id%5=0 review, ori, off_mm, lo, hi, len, thickness_mm from {WALLS} where len>1)"""
_ONE_PLACE = "a.ori=b.ori and a.lv=b.lv and abs(a.off_mm-b.off_mm)<=20 and greatest(0,least(a.hi,b.hi)-greatest(a.lo,b.lo))>=least(a.len,b.len)*0.98-20"
_ONE_FLOOR = "(a.sheet=b.sheet or (a.fl=b.fl and not a.review and not b.review))"


@query("wall_recheck", "J40 J41 H6", f"""with t as ({_TWINS}), r as ({serial_sql("select * from t", f"{_ONE_PLACE} and {_ONE_FLOOR}", "project_id")}),
 k as (select t.* from t join r on r.project_id=t.project_id and r.id=t.id where r.kept),
 o as (select b.project_id, b.id, arg_min(a.id, a.rk) blocked_by from k a join k b on a.project_id=b.project_id and a.rk<>b.rk and {_ONE_PLACE} and not {_ONE_FLOOR} group by all),
 one as (select distinct drawing_id, id from {WALLS} where len between 0.999 and 1)
 select r.project_id, r.id, r.kept, r.duplicate_of, case when r.duplicate_of is not null then case when abs(x.thickness_mm-y.thickness_mm)>5 then 'thickness' else '' end end conflicts, o.blocked_by
 from r left join t x on x.project_id=r.project_id and x.id=r.id left join t y on y.project_id=r.project_id and y.id=r.duplicate_of left join o on o.project_id=r.project_id and o.id=r.id
 union all select cast(floor(drawing_id/2.0) as bigint), id, true, null, null, null from one""")
def wall_recheck(spark, sf_dir):
    w = placed_walls(spark, sf_dir).where("len >= 1")
    w = w.select((F.col("drawing_id") / 2).cast("bigint").alias("project_id"), "id", F.concat(F.lit("L"), (F.col("drawing_id") % 2).cast("string")).alias("level"), F.col("id").cast("string").substr(-1, 1).alias("drawing_id"),
                 F.lit("floor_plan").alias("drawing_type"), (F.col("id") % 3).cast("string").alias("floor_number"), F.when(F.col("id") % 5 == 0, "needs_review").otherwise("ready").alias("floor_status"), "x1", "y1", "x2", "y2", "thickness_mm",
                 F.lit("brick").alias("material"), F.lit(3000).alias("height_mm"), F.lit("ready").alias("review_status"), (F.col("id") % 10 / 10.0).alias("confidence"))
    return dd.recheck_walls(w).select("project_id", "id", "kept", "duplicate_of", "conflicts", "blocked_by")


@query("distinct_grids", "W9", f"""with k as (select *, case when type='generic' then 'N'||ord%40 else '' end nm, round_even(coalesce(x,0)/10.0,0)*10 gx, round_even(y/10.0,0)*10 gy from {COMP}), r as (select *, first_value(ord) over (partition by project_id, nm, case when nm='' then gx end, case when nm='' then gy end order by case drawing_type when 'floor_plan' then 0 else 2 end, case when review_status='ready' then 0 else 1 end, confidence desc, ord) win from k)
 select ord, case when win<>ord then win end duplicate_of from r""")
def distinct_grids(spark, sf_dir):
    rows = derived(spark, sf_dir, "components").select("project_id", F.col("ord").alias("id"), F.when(F.col("type") == "generic", F.concat(F.lit("n"), (F.col("ord") % 40).cast("string"))).otherwise("").alias("name"), F.coalesce("x", F.lit(0)).alias("x1"), F.col("y").alias("y1"), F.lit(0).alias("x2"), F.lit(0).alias("y2"), "drawing_type", "review_status", "confidence")
    return dd.distinct_grids(rows).select(F.col("id").alias("ord"), "duplicate_of")


def _square(o):
    x, y, w = F.floor(F.col("x") / 4000) * 4000.0, F.floor(F.col("y") / 4000) * 4000.0, F.lit(1000.0)
    return F.array(g.point(x, y), g.point(x + w, y), g.point(x + w, y + w), g.point(x, y + w))


@query("distinct_slabs", "W9", f"""with s as (select drawing_id, opening_id id, floor(x/4000) kx, floor(y/4000) ky, case when opening_id%2=0 then 'L1' else 'L2' end lv, (opening_id%10)/10.0 c, opening_id%7=0 h from {DOORS}), r as (select *, first_value(id) over (partition by drawing_id, lv, kx, ky order by h desc, c desc, id desc) win from s) select id, case when win<>id then win end duplicate_of from r""")
def distinct_slabs(spark, sf_dir):
    o = derived(spark, sf_dir, "sheet_openings")
    s = o.select("drawing_id", F.col("opening_id").alias("id"), _square(o).alias("boundary"), F.when(F.col("opening_id") % 2 == 0, "L1").otherwise("L2").alias("level"), F.lit("regular").alias("role"), (F.col("opening_id") % 10 / 10.0).alias("confidence"))
    voids = s.select("drawing_id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("host_floor_id"))
    return dd.distinct_slabs(s, voids, KEYS).select("id", "duplicate_of")


@query("distinct_voids", "W9", f"""with s as (select drawing_id, opening_id id, floor(x/4000) kx, floor(y/4000) ky, case when opening_id%2=0 then 'L1' else 'L2' end lv, case when opening_id%3=0 then '' else 'S'||opening_id end host from {DOORS}), r as (select *, min(id) over (partition by drawing_id, lv, kx, ky) win, arg_min(host, id) filter (where host<>'') over (partition by drawing_id, lv, kx, ky) fh from s) select id, case when win<>id then win end duplicate_of, case when host<>'' then host else fh end host_floor_id from r""")
def distinct_voids(spark, sf_dir):
    o = derived(spark, sf_dir, "sheet_openings")
    s = o.select(F.lit(1).alias("project_id"), "drawing_id", F.col("opening_id").alias("id"), F.col("opening_id").alias("ord"), _square(o).alias("boundary"), F.when(F.col("opening_id") % 2 == 0, "L1").otherwise("L2").alias("level"), F.lit("s").alias("source"), F.lit("d").alias("domain"),
                 F.when(F.col("opening_id") % 3 == 0, "").otherwise(F.concat(F.lit("S"), F.col("opening_id").cast("string"))).alias("host_floor_id"))
    return dd.distinct_voids(s).select("id", "duplicate_of", "host_floor_id")
