"""Queries of published tables, records and reports, and of drawing files rebuilt from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftloom.functions import geometry as g
from draftloom.operators import matching as m
from draftloom.sinks import publish as p
from draftloom.sources import drawings as dw
from draftloom.sources import tables as tb
from draftloom.plans.derived import derived, derived_sql, read
from draftloom.plans.registry import query
from draftloom.plans.wall_queries import WALLS, placed_walls
from draftloom.session import checkpoint

OPEN, SEG, DOORS, COMP = (derived_sql(r) for r in ("openings", "segments", "sheet_openings", "components"))


def _walls(spark, sf_dir):
    w = placed_walls(spark, sf_dir).withColumn("project_id", F.floor(F.col("drawing_id") / 500).cast("bigint")).withColumn("drawing_no", F.col("drawing_id"))
    return w.withColumn("height_mm", F.when(F.col("id") % 3 == 0, 0).otherwise(2800)).withColumn("recognition_source", F.lit("paired_wall_lines")).withColumn("confidence", F.when(F.col("id") % 5 == 0, 0.7).otherwise(0.95))


IDS = f"(select *, floor(drawing_id/500)::bigint project_id, 'WALL-'||case when rn<100 then lpad(rn::string,3,'0') else rn::string end gid from (select *, row_number() over (partition by floor(drawing_id/500) order by drawing_id, x1, y1, id) rn from {WALLS}))"


@query("wall_ids", "K1 O2", f"select project_id, id, gid global_id from {IDS}")
def wall_ids(spark, sf_dir):
    w = _walls(spark, sf_dir)
    return p.global_ids(w.withColumn("x", F.col("x1")).withColumn("y", F.col("y1")), "WALL").select("project_id", "id", "global_id")


def _levels(w):
    return w.select("project_id", "drawing_id").distinct().withColumn("level_id", F.lit("LEVEL-001"))


@query("walls_table", "K1 K2", f"""select gid "Element_ID", project_id::string "Project_ID", drawing_id::string "Drawing_ID", (hi-lo)::double::string "Length", case when id%3=0 then '3000.0' else '2800.0' end "Height", case when id%3=0 or id%5=0 then 'true' else 'false' end "Needs_Review" from {IDS}""")
def walls_table(spark, sf_dir):
    w = _walls(spark, sf_dir).withColumn("height_mm", F.col("height_mm").cast("double"))
    return p.walls_table(w, _levels(w)).select("Element_ID", "Project_ID", "Drawing_ID", "Length", "Height", "Needs_Review")


def _openings(spark, sf_dir):
    o = derived(spark, sf_dir, "openings").drop("project_id").withColumn("project_id", F.floor(F.col("drawing_id") / 500).cast("bigint"))
    w = placed_walls(spark, sf_dir).groupBy("drawing_id").agg(F.min("id").alias("host"))
    return o.join(w, "drawing_id", "left").select("project_id", "drawing_id", F.col("drawing_id").alias("drawing_no"), F.col("opening_id").alias("id"), F.col("opening_id").alias("ord"), "kind", "x", "y", F.col("width_mm").alias("width"), F.col("height_mm").cast("double").alias("height_mm"),
                                                  F.lit(900).alias("sill_mm"), F.lit("unknown").alias("category"), F.lit("block").alias("source"), F.lit(0.9).alias("confidence"), F.col("host").alias("host_wall_id"))


@query("doors_table", "K1 J30", f"""with o as (select *, floor(drawing_id/500)::bigint pid from {OPEN} where kind='door'), n as (select *, row_number() over (partition by pid order by drawing_id, x, y, opening_id) rn from o), h as (select drawing_id, arg_min(gid, id) gid from {IDS} group by drawing_id)
 select 'DOOR-'||case when rn<100 then lpad(rn::string,3,'0') else rn::string end "Element_ID", pid::string "Project_ID", coalesce(h.gid,'') "Host_Wall_ID", width_mm::string "Width" from n left join h using (drawing_id)""")
def doors_table(spark, sf_dir):
    w = _walls(spark, sf_dir)
    named = p.global_ids(w.withColumn("x", F.col("x1")).withColumn("y", F.col("y1")), "WALL")
    return p.openings_table(_openings(spark, sf_dir), named, "door").select("Element_ID", "Project_ID", "Host_Wall_ID", "Width")


@query("manifest", "K3", f"""select 'Walls.csv' "File_Name", count(*) "Record_Count", 'success' "Status" from {WALLS} union all select 'Beams.csv', 0, 'empty' union all select 'Doors.csv', count(*), 'success' from {OPEN} where kind='door'""")
def manifest(spark, sf_dir):
    w = placed_walls(spark, sf_dir)
    return p.manifest({"Walls": w, "Beams": w.where("id is null"), "Doors": derived(spark, sf_dir, "openings").where("kind = 'door'")}).select("File_Name", "Record_Count", "Status")


def _tables(spark, sf_dir):
    w = _walls(spark, sf_dir)
    named = p.global_ids(w.withColumn("x", F.col("x1")).withColumn("y", F.col("y1")), "WALL")
    o = _openings(spark, sf_dir)
    return {"Walls": p.walls_table(w, _levels(w)), "Doors": p.openings_table(o, named, "door"), "Windows": p.openings_table(o, named, "window")}


@query("element_records", "K5 U1", f"""select gid record_id, 'wall' record_type, x1::double sx, (hi-lo)::bigint len from {IDS} union all select (case kind when 'door' then 'DOOR-' else 'WINDOW-' end)||case when rn<100 then lpad(rn::string,3,'0') else rn::string end, kind, x::double, null from (select *, row_number() over (partition by kind, floor(drawing_id/500) order by drawing_id, x, y, opening_id) rn from {OPEN})""")
def element_records(spark, sf_dir):
    r = p.element_records(_tables(spark, sf_dir))
    x = F.coalesce(F.get_json_object("record", "$.geometry.start.x"), F.get_json_object("record", "$.geometry.x")).cast("double")
    return r.select("record_id", "record_type", x.alias("sx"), F.get_json_object("record", "$.length").cast("bigint").alias("len"))


@query("project_document", "K4", f"""with o as (select drawing_id, kind, count(*) n from {OPEN} group by all), w as (select drawing_id, count(*) n from {WALLS} group by all), d as (select drawing_id from o union select drawing_id from w)
 select d.drawing_id::string "Drawing_ID", (select n from w where w.drawing_id=d.drawing_id) walls, (select n from o where o.drawing_id=d.drawing_id and kind='door') doors from d""")
def project_document(spark, sf_dir):
    doc = p.project_document(_tables(spark, sf_dir)).where("part = 0")
    return doc.select("Drawing_ID", F.get_json_object("record", "$.counts.wall").cast("bigint").alias("walls"), F.get_json_object("record", "$.counts.door").cast("bigint").alias("doors"))


@query("drawing_extracts", "K8", f"select drawing_id, kind, count(*) n, sum(width_mm) total from {OPEN} group by all")
def drawing_extracts(spark, sf_dir):
    # The extracts' content per drawing; the sink writes it with one folder per drawing.
    o = derived(spark, sf_dir, "openings")
    return o.groupBy("drawing_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("width_mm").alias("total"))


@query("summary_rows", "K9", f"select drawing_id, 'geometry' section, ori \"name\", count(*) n from {SEG} group by all union all select drawing_id, 'elements', kind, count(*) from {OPEN} group by all")
def summary_rows(spark, sf_dir):
    raw = derived(spark, sf_dir, "segments").select("drawing_id", F.col("ori").alias("geometry_type"))
    return p.summary_rows(raw, derived(spark, sf_dir, "openings").select("drawing_id", "kind"))


@query("evidence_rows", "K9", f"select opening_id record_id, '- '||opening_id||': width_mm='||width_mm||', kind='||kind line from {OPEN}")
def evidence_rows(spark, sf_dir):
    return p.evidence_rows(derived(spark, sf_dir, "openings"), "opening_id", ["width_mm", "kind"])


@query("review_overview", "K10", f"""with w as (select drawing_id, count(*) n from {WALLS} group by all), o as (select drawing_id, count(*) n from {OPEN} group by all) select o.drawing_id, coalesce(w.n,0) walls, o.n openings, 0::bigint stairs from o left join w using (drawing_id)""")
def review_overview(spark, sf_dir):
    o = derived(spark, sf_dir, "openings").select("drawing_id")
    parts = placed_walls(spark, sf_dir).select("drawing_id", F.lit("wall").alias("kind")).unionByName(o.withColumn("kind", F.lit("opening")))
    return p.review_overview(o.distinct(), parts).select("drawing_id", "walls", "openings", "stairs")


@query("review_markers", "K10", f"""with b as (select drawing_id, opening_id id, case kind when 'door' then 'floor_opening' else 'stair' end kind, x, y from {DOORS} where kind='door' or opening_id%3=0) select drawing_id, id, kind, row_number() over (partition by drawing_id order by x, y, kind, id) marker from b""")
def review_markers(spark, sf_dir):
    o = derived(spark, sf_dir, "sheet_openings").select("drawing_id", F.col("opening_id").alias("id"), "kind", "x", "y")
    return p.review_markers(o.where("kind = 'door'"), o.where("kind = 'window'").withColumn("opening_required", F.col("id") % 3 == 0)).select("drawing_id", "id", "kind", "marker")


@query("roof_parapets", "R10", f"""with f as (select drawing_id%200 project_id, opening_id id, (width_mm+height_mm)::bigint score, width_mm w, height_mm h from {DOORS}), b as (select project_id, max(struct_pack(s := score, i := id, w := w, h := h)) m from f group by all) select project_id, count(*) parapets, cast(sum(e) as bigint) total from (select project_id, unnest([m.w,m.h,m.w,m.h]) e from b) group by all""")
def roof_parapets(spark, sf_dir):
    o = derived(spark, sf_dir, "sheet_openings")
    x, y, w, h = F.col("x").cast("double"), F.col("y").cast("double"), F.col("width_mm"), F.col("height_mm")
    floors = o.select((F.col("drawing_id") % 200).alias("project_id"), "drawing_id", F.col("opening_id").alias("id"), (w + h).alias("score"), F.array(g.point(x, y), g.point(x + w, y), g.point(x + w, y + h), g.point(x, y + h)).alias("boundary"), F.lit(3000.0).alias("elevation_mm"), F.lit(False).alias("is_roof_plan"))
    none = floors.where("id is null")
    heights = none.select("project_id", F.lit(900.0).alias("height_mm"), F.lit("x").alias("source"), F.lit(True).alias("needs_review"))
    own = none.select("project_id", "drawing_id", "id", *[F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(0.5).alias("confidence"))
    _, parapets = p.roof_and_parapets(floors, heights, own)
    return parapets.groupBy("project_id").agg(F.count(F.lit(1)).alias("parapets"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).cast("bigint").alias("total"))


@query("opening_context", "R21", f"""with pr as (select o.drawing_id, o.opening_id, mark_id, round(sqrt(pow(o.x-m.x,2)+pow(o.y-m.y,2)),6) d from {DOORS} o join {derived_sql('marks')} m using (drawing_id)), k as (select *, row_number() over (partition by drawing_id, opening_id order by d, mark_id) rn from pr where d<=3000)
 select o.drawing_id, o.opening_id, o.width_mm, coalesce(c.n,0) nearby from {DOORS} o left join (select drawing_id, opening_id, count(*) n from k where rn<=12 group by all) c using (drawing_id, opening_id)""")
def opening_context(spark, sf_dir):
    o = derived(spark, sf_dir, "sheet_openings")
    raw = derived(spark, sf_dir, "marks").select("drawing_id", F.col("mark_id").alias("raw_id"), "x", "y")
    near = m.nearby_geometry(o.select("drawing_id", "opening_id", "x", "y"), raw, ("drawing_id",), radius=3000.0).select("drawing_id", "opening_id", F.col("_rank").alias("rank"), F.col("g_raw_id").alias("raw_id"), F.col("_distance").alias("distance"))
    hosts = o.where("opening_id is null").select("drawing_id", "opening_id", F.lit("").alias("host_wall_id"), F.lit(0.0).alias("host_distance"))
    found = p.opening_context(o, hosts, near)
    items = F.from_json(F.get_json_object("classification_input", "$.nearby_raw_geometry"), "array<string>")
    return found.select("drawing_id", "opening_id", F.get_json_object("classification_input", "$.dimensions.width_mm").cast("bigint").alias("width_mm"), F.coalesce(F.size(items), F.lit(0)).cast("bigint").alias("nearby"))


# --- drawing files written out from the tables as code / value lines and read back ---


def _files(spark, sf_dir):
    """One file text per drawing: lines, circles, polylines and block references for its openings."""
    o = derived(spark, sf_dir, "openings")

    def tag(code, value):
        return F.concat(F.lit(f"{code}\n"), value.cast("string") if hasattr(value, "cast") else F.lit(value), F.lit("\n"))

    x, y, w, h = (F.col(c) for c in ("x", "y", "width_mm", "height_mm"))
    line = F.concat(tag(0, "LINE"), tag(8, "A-WALL"), tag(10, x), tag(20, y), tag(11, x + w), tag(21, y))
    poly = F.concat(tag(0, "LWPOLYLINE"), tag(8, "A-SLAB"), tag(70, "1"), *[F.concat(tag(10, a), tag(20, b)) for a, b in ((x, y), (x + w, y), (x + w, y + h))])
    ref = F.concat(tag(0, "INSERT"), tag(8, "A-DOOR"), tag(2, "B1"), tag(10, x), tag(20, y), tag(41, "2"), tag(42, "1"), tag(50, "90"))
    old = F.concat(tag(0, "POLYLINE"), tag(8, "OLD"), tag(70, "0"), tag(0, "VERTEX"), tag(10, x), tag(20, y), tag(0, "VERTEX"), tag(10, x + w), tag(20, y + h), tag(0, "SEQEND"))
    body = F.when(F.col("opening_id") % 4 == 0, line).when(F.col("opening_id") % 4 == 1, poly).when(F.col("opening_id") % 4 == 2, ref).otherwise(old)
    blocks = "0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n8\n0\n2\nB1\n10\n0\n20\n0\n0\nLINE\n8\nA-DOOR\n10\n0\n20\n0\n11\n450\n21\n0\n0\nARC\n8\nSWING\n10\n0\n20\n0\n40\n100\n50\n0\n51\n90\n0\nENDBLK\n0\nENDSEC\n"
    # A drawing here has at most eight openings, so its text is short.
    parts = o.groupBy("drawing_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("opening_id", body.alias("b")))), lambda e: e["b"])).alias("b"))
    return parts.select(F.col("drawing_id").cast("string").alias("file"), F.concat(F.lit(blocks + "0\nSECTION\n2\nENTITIES\n"), "b", F.lit("0\nENDSEC\n0\nEOF\n")).alias("value"))


@query("file_tags", "S1", f"""select drawing_id::string file, 30 + 2 + 3 + sum(case opening_id%4 when 0 then 6 when 1 then 9 when 2 then 8 else 10 end)::bigint tags from {OPEN} group by drawing_id""".replace("30 + 2 + 3", "26"))
def file_tags(spark, sf_dir):
    return dw.tags_of(_files(spark, sf_dir)).groupBy("file").agg(F.count(F.lit(1)).alias("tags"))


@query("file_entities", "S2", f"""select drawing_id::string file, case opening_id%4 when 0 then 'LINE' when 1 then 'LWPOLYLINE' when 2 then 'INSERT' else 'POLYLINE' end etype, count(*) n, sum(case opening_id%4 when 0 then x+width_mm when 2 then x end)::bigint xs, sum(case opening_id%4 when 1 then 3 when 3 then 2 end)::bigint corners from {OPEN} group by all""")
def file_entities(spark, sf_dir):
    e = dw.read_entities(dw.tags_of(_files(spark, sf_dir)))
    return e.groupBy("file", "etype").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("x2", "cx")).cast("bigint").alias("xs"), F.sum(F.size("points")).cast("bigint").alias("corners"))


@query("file_segments", "S2 G15 G2", f"""select opening_id//8||'' file, count(*) n from (select opening_id, unnest(range(0, case opening_id%4 when 0 then 1 when 1 then 3 else 1 end)) from {OPEN} where opening_id%4<>2) group by all""")
def file_segments(spark, sf_dir):
    return dw.segments(dw.read_entities(dw.tags_of(_files(spark, sf_dir)))).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("block_definitions", "S3", f"""select drawing_id::string file, 'B1' block_name, -100 x0, -100 y0, 450 x1, 100 y1, 2 geometry_count, 'A-DOOR,SWING' layers from {OPEN} group by drawing_id""")
def block_definitions(spark, sf_dir):
    boxes, _ = dw.read_blocks(dw.tags_of(_files(spark, sf_dir)))
    return boxes.select("file", "block_name", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")], F.col("geometry_count").cast("int").alias("geometry_count"), F.concat_ws(",", "block_layers").alias("layers"))


@query("placed_blocks", "S4", f"""select drawing_id::string file, x source_x, x-150 bx0, x+150 bx1, y-150 by0, y+900 by1, 2::bigint block_geometry_count from {OPEN} where opening_id%4=2""")
def placed_blocks(spark, sf_dir):
    tags = dw.number_tags(dw.tags_of(_files(spark, sf_dir)))
    placed, _ = dw.place_blocks(dw.read_entities(tags), *dw.read_blocks(tags))
    return placed.select("file", F.round("source_x").cast("bigint").alias("source_x"), *[F.round(c).cast("bigint").alias(c) for c in ("bx0", "bx1", "by0", "by1")], "block_geometry_count")


@query("offset_blocks", "S5", f"""select drawing_id::string file, (x+175)::bigint cx, y::bigint cy from {OPEN} where opening_id%4=2 and sqrt(x*x+y*y)<=20000""")
def offset_blocks(spark, sf_dir):
    tags = dw.number_tags(dw.tags_of(_files(spark, sf_dir)))
    found = dw.place_blocks_by_offset(dw.read_entities(tags), dw.read_blocks(tags)[0])
    return found.select("file", F.round("cx").cast("bigint").alias("cx"), F.round("cy").cast("bigint").alias("cy"))


@query("report_sections", "S7", f"""select (opening_id//40)::string file, case kind when 'window' then 'windows' else 'doors' end component_group, count(*) n, sum(width_mm)::bigint total from {OPEN} group by all""")
def report_sections(spark, sf_dir):
    o = derived(spark, sf_dir, "openings").withColumn("file", F.floor(F.col("opening_id") / 40).cast("string"))
    rows = o.select("file", (F.col("opening_id") % 40 + 10).alias("row_no"), F.array(F.col("opening_id").cast("string"), F.col("kind"), F.concat(F.lit(" "), F.col("width_mm").cast("string"))).alias("cells"))
    heads = o.select("file").distinct().select("file", F.explode(F.array(
        F.struct(F.lit(1).cast("bigint").alias("row_no"), F.array(F.lit("墙体 walls")).alias("cells")), F.struct(F.lit(2).cast("bigint").alias("row_no"), F.array(F.lit("无识别结果")).alias("cells")),
        F.struct(F.lit(3).cast("bigint").alias("row_no"), F.array(F.lit("门窗 doors/windows")).alias("cells")), F.struct(F.lit(4).cast("bigint").alias("row_no"), F.array(F.lit("ID"), F.lit("Kind"), F.lit("Width mm")).alias("cells")))).alias("h")).select("file", "h.*")
    found = tb.unstack_sections(rows.unionByName(heads).withColumn("sheet", F.lit("s")))
    return found.groupBy("file", "component_group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("item")["width_mm"].cast("bigint")).alias("total"))


@query("normalized_components", "R6 S6", f"""select ord id, width_mm::double width_mm, case when review_status='needs_review' then 'needs_review' else case when x is null then 'needs_review' else 'ready' end end review_status, least(1.0, confidence)::double confidence from {COMP}""")
def normalized_components(spark, sf_dir):
    c = derived(spark, sf_dir, "components")
    raw = c.select(F.col("ord").cast("string").alias("Element ID"), F.col("width_mm").cast("string").alias("Width"), F.when(F.col("x").isNotNull(), F.concat_ws(", ", F.col("x").cast("string"), F.col("y").cast("string"))).alias("Location"),
                   F.when(F.col("review_status") == "needs_review", "TRUE").otherwise("").alias("Needs-Review"), F.col("confidence").cast("string").alias("Confidence"))
    found = tb.normalized_components(tb.clean_table(raw), "doors")
    return found.select(F.col("id").cast("bigint").alias("id"), "width_mm", "review_status", "confidence")


@query("model_items", "S9 S10", f"""select opening_id::string id, x::double x, y::double y, (height_mm)::double height_mm, case when kind='door' then 0.9 else 0.85 end::double confidence, 3 corners from {OPEN}""")
def model_items(spark, sf_dir):
    o = derived(spark, sf_dir, "openings")
    door = F.col("kind") == "door"
    boundary = F.to_json(F.array(*[F.array(F.col("x") + i, F.col("y") + j) for i, j in ((0, 0), (1, 0), (1, 1))]))
    item = F.to_json(F.struct(F.col("opening_id").cast("string").alias("id"), F.struct("x", "y").alias("center"), F.lit(0).alias("base_z_mm"), F.col("height_mm").alias("top_z_mm"), F.when(door, "high").otherwise("85%").alias("confidence"), boundary.alias("boundary")))
    items = o.select(F.col("drawing_id").cast("string").alias("file"), F.concat(F.col("kind"), F.lit("s")).alias("component_group"), F.col("opening_id").alias("ord"), item.alias("item"))
    return tb.model_fields(items).select("id", "x", "y", "height_mm", "confidence", F.size("boundary").alias("corners"))
