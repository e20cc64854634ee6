"""Published tables: global ids, fixed columns, manifests, documents, records and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom import schemas
from draftloom.functions import values as v
from draftloom.operators.ordered import number_rows
from draftloom.operators.spatial import Keys

REVIEW_THRESHOLD = 0.80
DEFAULT_HEIGHTS = {"Walls": 3000.0, "Doors": 2100.0}


def global_ids(rows: DataFrame, prefix: str, project: Keys = ("project_id",), cell: float = 5000.0) -> DataFrame:
    """Ids such as ``WALL-001``, numbered per project in order of drawing, x, y and source order.

    Numbering is shared by tasks per drawing and strip of x; a project that holds most rows is no single task.
    ``rows``: project, ``drawing_no``, ``x``, ``y``, ``ord``. Adds ``global_id``.
    """
    bucket = F.struct(F.col("drawing_no"), F.floor(F.col("x") / cell).alias("strip"))
    numbered = number_rows(rows, project, [F.col("drawing_no"), F.col("x"), F.col("y"), F.col("ord")], bucket, "_no")
    return numbered.withColumn("global_id", F.concat(F.lit(f"{prefix}-"), v.padded(F.col("_no"), 3))).drop("_no")


def translate_ids(rows: DataFrame, field: str, target: DataFrame, keys: Keys, name: str) -> DataFrame:
    """Foreign keys from ids of a drawing to global ids; unknown ones become NULL."""
    ids = target.select(*keys, F.col("id").alias(field), F.col("global_id").alias(name))
    return rows.join(ids, [*keys, field], "left")


def with_height(rows: DataFrame, table: str) -> DataFrame:
    """Height with its source: drawn, or the table's default (0 counts as missing)."""
    known = F.coalesce("height_mm", F.lit(0)) != 0
    source = F.when(known, F.coalesce(F.col("height_source") if "height_source" in rows.columns else F.lit(None).cast("string"), F.lit("recognized"))).otherwise("default")
    return rows.withColumn("height_source", source).withColumn("height_mm", F.when(known, F.col("height_mm")).otherwise(F.lit(DEFAULT_HEIGHTS[table])))


def needs_review(*also: Column) -> Column:
    out = F.coalesce(F.col("confidence"), F.lit(0.0)) < REVIEW_THRESHOLD
    for test in also:
        out = out | F.coalesce(test, F.lit(False))
    return out


def as_text(value: Column, kind) -> Column:
    """Sink form of a value: flags as true / false, lists and structs as JSON, NULL as empty."""
    name = kind.typeName()
    if name in ("array", "struct", "map"):
        value = F.to_json(value)
    return F.coalesce(value.cast("string"), F.lit(""))


def to_table(rows: DataFrame, table: str, mapping: dict[str, str | Column]) -> DataFrame:
    """Rows in the fixed columns of a published table, all as text; other columns are dropped."""
    have = {f.name: f.dataType for f in rows.schema}
    typed = rows.select(*[(F.col(m) if isinstance(m, str) else m).alias(name) for name, m in mapping.items()])
    kinds = {f.name: f.dataType for f in typed.schema}
    del have
    return typed.select(*[as_text(F.col(c), kinds[c]).alias(c) if c in kinds else F.lit("").alias(c) for c in schemas.columns(table)])


def walls_table(walls: DataFrame, levels: DataFrame, project: Keys = ("project_id",)) -> DataFrame:
    """Published walls. ``walls``: project, ``drawing_id``, ``drawing_no``, ``id``, ``ord``, x1, y1, x2, y2, ``thickness_mm``, ``height_mm``, ``recognition_source``, ``confidence``.

    ``levels``: project, ``drawing_id``, ``level_id``.
    """
    w = global_ids(walls.withColumn("x", F.col("x1")).withColumn("y", F.col("y1")), "WALL", project)
    w = with_height(w, "Walls").join(levels, [*project, "drawing_id"], "left")
    turn = F.round(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))), 3)
    return to_table(w, "Walls", {
        "Element_ID": "global_id", "Element_Name": F.concat(F.lit("Wall "), F.col("global_id")), "Project_ID": project[0], "Drawing_ID": "drawing_id", "Level_ID": "level_id", "Wall_Type": "recognition_source",
        "Start_X": "x1", "Start_Y": "y1", "Start_Z": F.lit(0), "End_X": "x2", "End_Y": "y2", "End_Z": F.lit(0), "Length": F.round(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 3),
        "Thickness": "thickness_mm", "Height": "height_mm", "Rotation_Angle": turn, "Confidence": "confidence", "Source_Geometry_Count": F.lit(2),
        "Needs_Review": needs_review(F.col("height_source") == "default"), "Remarks": F.when(F.col("height_source") == "default", "default wall height"),
    })


def openings_table(openings: DataFrame, walls: DataFrame, kind: str, project: Keys = ("project_id",)) -> DataFrame:
    """Published doors or windows with the global id of their host wall.

    ``openings``: project, ``drawing_id``, ``drawing_no``, ``id``, ``ord``, ``kind``, ``x``, ``y``, ``width``, ``height_mm``, ``sill_mm``, ``category``, ``source``, ``confidence``, ``host_wall_id``.
    """
    table, prefix = ("Doors", "DOOR") if kind == "door" else ("Windows", "WINDOW")
    rows = global_ids(openings.where(F.col("kind") == kind), prefix, project)
    rows = translate_ids(rows, "host_wall_id", walls, [*project, "drawing_id"], "_host")
    if kind == "door":
        rows = with_height(rows, "Doors")
    mapping = {
        "Element_ID": "global_id", "Element_Name": F.concat(F.initcap("kind"), F.lit(" "), F.col("global_id")), "Project_ID": project[0], "Drawing_ID": "drawing_id", "Host_Wall_ID": "_host",
        f"{kind.capitalize()}_Category": "category", "Final_Category": "category", "Mechanical_Category": "category", "Width": "width", "Height": "height_mm", "Center_X": "x", "Center_Y": "y", "Center_Z": F.lit(0),
        "Confidence": "confidence", "Needs_Review": needs_review(F.col("_host").isNull()), "Source_Geometry_Count": F.lit(1), "Mechanical_Category_Source": "source",
    }
    if kind == "window":
        mapping["Sill_Height"] = "sill_mm"
    return to_table(rows, table, mapping)


def generic_table(rows: DataFrame, table: str, id_prefix: str, fields: dict[str, str | Column], project: Keys = ("project_id",)) -> DataFrame:
    """Any other published table: global ids, the given fields, review flag."""
    named = global_ids(rows, id_prefix, project)
    first = schemas.columns(table)[0]
    have = schemas.columns(table)
    base = {first: "global_id", "Project_ID": project[0], "Drawing_ID": "drawing_id", "Confidence": "confidence", "Needs_Review": needs_review()}
    return to_table(named, table, {k: m for k, m in {**base, **fields}.items() if k in have})


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "csv") -> None:
    """One folder per table, CSV with headers or Parquet."""
    for name, df in tables.items():
        fixed = df.select(*schemas.columns(name)) if name in schemas.TABLES else df
        writer = fixed.write.mode("overwrite")
        writer.option("header", True).csv(f"{folder}/{name}") if form == "csv" else writer.parquet(f"{folder}/{name}")


def manifest(tables: dict[str, DataFrame], version: str = "1.0") -> DataFrame:
    """Record count and state of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("Record_Count")).select(
            F.lit(f"{name}.csv").alias("File_Name"), F.lit(name).alias("Data_Type"), "Record_Count", F.lit(version).alias("Schema_Version"),
            F.when(F.col("Record_Count") > 0, "success").otherwise("empty").alias("Status"), F.when(F.col("Record_Count") > 0, "").otherwise("No records exported").alias("Remarks"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def compact_record(rows: DataFrame, kind: str, id_field: str, geometry: Column | None = None) -> DataFrame:
    """One JSON record per row: lower-case keys, numbers without needless decimals, no empty values."""
    skip = {"Start_X", "Start_Y", "Start_Z", "End_X", "End_Y", "End_Z", "Center_X", "Center_Y", "Center_Z"} if geometry is not None else set()
    fields = [v.smart_text(F.col(c)).alias(c.lower()) for c in rows.columns if c not in skip]
    shape = [geometry.alias("geometry")] if geometry is not None else []
    record = F.struct(F.lit(kind).alias("record_type"), F.col(id_field).alias("record_id"), *shape, *fields)
    place = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("Project_ID", "Drawing_ID")]
    return rows.select(*place, F.lit(kind).alias("record_type"), F.col(id_field).alias("record_id"), F.to_json(record, {"ignoreNullFields": "true"}).alias("record"))


def line_geometry() -> Column:
    def point(p):
        return F.struct(*[F.col(f"{p}_{a}").try_cast("double").alias(a.lower()) for a in "XYZ"])

    return F.struct(F.lit("line").alias("type"), point("Start").alias("start"), point("End").alias("end"))


def point_geometry() -> Column:
    return F.struct(F.lit("point").alias("type"), *[F.col(f"Center_{a}").try_cast("double").alias(a.lower()) for a in "XYZ"])


def polygon_geometry(field: str = "Boundary_Points") -> Column:
    return F.struct(F.lit("polygon").alias("type"), v.parse_boundary(field).alias("points"))


# Record type, id and geometry of each published element table.
RECORDS = {
    "Grids": ("grid", "line"), "Walls": ("wall", "line"), "Wall_Runs": ("wall_run", "line"), "Columns": ("column", None), "Doors": ("door", "point"), "Windows": ("window", "point"),
    "Floors": ("floor", "polygon"), "Roofs": ("roof", "polygon"), "Parapets": ("parapet", "line"), "Floor_Openings": ("floor_opening", "point"), "Stairs": ("stair", "line"),
    "Railings": ("railing", "line"), "Dimensions": ("dimension", None), "Text_Annotations": ("text_annotation", None),
}


def element_records(tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON record per element and annotation of all tables."""
    shapes = {"line": line_geometry, "point": point_geometry, "polygon": polygon_geometry}
    out = None
    for name, (kind, shape) in RECORDS.items():
        if name not in tables:
            continue
        one = compact_record(tables[name], kind, schemas.columns(name)[0], shapes[shape]() if shape else None)
        out = one if out is None else out.unionByName(one)
    return out


def project_document(tables: dict[str, DataFrame]) -> DataFrame:
    """The project's document as ordered rows: per drawing one head with the counts of its tables, then its records.

    Rows rather than one nested text, so that no drawing or project has to fit into one record.
    Concatenated in order of (project, drawing, part, record type, id) they are the document.
    """
    records = element_records(tables)
    counts = records.groupBy("Project_ID", "Drawing_ID", "record_type").agg(F.count(F.lit(1)).alias("n")).groupBy("Project_ID", "Drawing_ID").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("record_type", "n")))).alias("counts")
    )
    head = counts.select("Project_ID", "Drawing_ID", F.lit(0).alias("part"), F.lit("drawing").alias("record_type"), F.col("Drawing_ID").alias("record_id"), F.to_json(F.struct("Drawing_ID", "counts")).alias("record"))
    return head.unionByName(records.select("Project_ID", "Drawing_ID", F.lit(1).alias("part"), "record_type", "record_id", "record"))


def write_records(records: DataFrame, folder: str) -> None:
    records.select("record").write.mode("overwrite").text(folder)


def write_drawing_extracts(tables: dict[str, DataFrame], folder: str) -> None:
    """Per-drawing extracts: one folder per table, partitioned by drawing."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("Drawing_ID").option("header", True).csv(f"{folder}/{name}")


def summary_rows(raw: DataFrame, elements: DataFrame, keys: Keys = ("drawing_id",)) -> DataFrame:
    """Project summary: raw shapes by type and elements by kind per drawing, as (section, name, count) rows."""
    shapes = raw.groupBy(*keys, F.lit("geometry").alias("section"), F.col("geometry_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    parts = elements.groupBy(*keys, F.lit("elements").alias("section"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return shapes.unionByName(parts)


def evidence_rows(rows: DataFrame, id_field: str, fields: list[str]) -> DataFrame:
    """Evidence lines such as ``- WALL-001: Length=3000, Height=2700``."""
    parts = [F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    return rows.select(F.col(id_field).alias("record_id"), F.concat(F.lit("- "), F.coalesce(F.col(id_field).cast("string"), F.lit("")), F.lit(": "), F.concat_ws(", ", *parts)).alias("line"))


def review_overview(drawings: DataFrame, elements: DataFrame, keys: Keys = ("drawing_id",)) -> DataFrame:
    """One row per drawing with the counts of what was found on it. ``elements``: keys, ``kind``."""
    kinds = ("wall", "opening", "axis", "stair", "elevation_mark", "floor_height", "issue")
    counts = elements.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds])
    return drawings.join(counts, list(keys), "left").fillna(0, [f"{k}s" for k in kinds])


def review_markers(voids: DataFrame, stairs: DataFrame, keys: Keys = ("drawing_id",)) -> DataFrame:
    """Opening markers to look at: voids, and stairs that need an opening, numbered per drawing from left to right.

    Both: keys, ``id``, ``x``, ``y``; stairs also ``opening_required``.
    """
    both = voids.select(*keys, "id", F.lit("floor_opening").alias("kind"), "x", "y").unionByName(stairs.where("opening_required").select(*keys, "id", F.lit("stair").alias("kind"), "x", "y"))
    return number_rows(both, keys, [F.col("x"), F.col("y"), F.col("kind"), F.col("id")], F.floor(F.col("x") / 5000), "marker")


def roof_and_parapets(floors: DataFrame, heights: DataFrame, dedicated: DataFrame, keys: Keys = ("project_id",)) -> tuple[DataFrame, DataFrame]:
    """Flat roof from the top plan's slab and parapets along its edges, or updated ones from their own layer.

    ``floors``: keys, ``drawing_id``, ``id``, ``score``, ``boundary``, ``elevation_mm``, ``is_roof_plan``. ``heights``: keys, ``height_mm``, ``source``, ``needs_review``. ``dedicated``: keys,
    ``drawing_id``, ``id``, x1, y1, x2, y2, ``confidence``. The floor with the highest score, then the highest id, carries the roof.
    """
    from draftloom.functions import geometry as g

    best = floors.where(F.size("boundary") >= 3).groupBy(*keys).agg(F.max(F.struct("score", "id", "drawing_id", "boundary", "elevation_mm", "is_roof_plan")).alias("f"))
    roofs = best.select(
        *keys, F.lit("ROOF-001").alias("roof_id"), "f.drawing_id", "f.boundary", "f.elevation_mm", F.round(g.polygon_area("f.boundary"), 3).alias("area"),
        F.when(F.col("f.is_roof_plan"), "roof_plan_outer_boundary").otherwise("top_plan_outer_boundary").alias("source"), F.when(F.col("f.is_roof_plan"), 0.76).otherwise(0.68).alias("confidence"),
    )
    h = heights.select(*keys, F.col("height_mm").alias("_h"), F.col("source").alias("height_source"), F.col("needs_review").alias("_open"))
    top = roofs.join(h, list(keys), "left").withColumn("_h", F.coalesce("_h", F.lit(900.0))).withColumn("_open", F.coalesce("_open", F.lit(True)))
    sure = F.when(F.col("_open"), F.col("confidence")).otherwise(0.82)
    own = dedicated.join(top.select(*keys, "drawing_id", "roof_id", "elevation_mm", "_h", "height_source", "_open", sure.alias("_sure")), [*keys, "drawing_id"])
    updated = own.select(*keys, "drawing_id", F.col("id").cast("string").alias("id"), "roof_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], "elevation_mm", F.round("_h", 3).alias("height_mm"), "height_source",
                         F.greatest(F.coalesce("confidence", F.lit(0.0)), F.col("_sure")).alias("confidence"), ((F.col("_sure") < REVIEW_THRESHOLD) | F.col("_open")).alias("needs_review"))
    bare = top.join(own.select(*keys).distinct(), list(keys), "left_anti")
    edges = bare.select("*", sure.alias("_sure"), F.posexplode(g.polygon_edges("boundary", F.lit(True))).alias("n", "e"))
    derived = edges.select(*keys, "drawing_id", F.format_string("PARAPET-%03d", F.col("n") + 1).alias("id"), "roof_id", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"), "elevation_mm",
                           F.round("_h", 3).alias("height_mm"), "height_source", F.col("_sure").alias("confidence"), ((F.col("_sure") < REVIEW_THRESHOLD) | F.col("_open")).alias("needs_review"))
    return roofs, updated.unionByName(derived)


def opening_context(openings: DataFrame, hosts: DataFrame, nearby: DataFrame, keys: Keys = ("drawing_id",)) -> DataFrame:
    """Bundle per opening for a later look at its type: size, host, view match and the nearest raw shapes (at most twelve)."""
    near = nearby.groupBy(*keys, "opening_id").agg(F.array_sort(F.collect_list(F.struct("rank", "raw_id", "distance"))).alias("nearby_raw_geometry"))
    rows = openings.join(hosts, [*keys, "opening_id"], "left").join(near, [*keys, "opening_id"], "left")
    bundle = F.struct(F.col("kind").alias("opening_kind"), F.struct("width_mm", "height_mm").alias("dimensions"), F.struct("host_wall_id", "host_distance").alias("host"), "nearby_raw_geometry")
    return rows.select(*keys, "opening_id", F.to_json(bundle).alias("classification_input"))
