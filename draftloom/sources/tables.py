"""Element tables, sectioned reports, notes, models and type libraries."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftloom.functions import values as v

# Names under which the group of a table is known.
GROUP_ALIASES = {
    "levels": ["levels", "level", "标高", "楼层"], "grids": ["grids", "axes", "轴网", "轴线"], "walls": ["walls", "墙", "墙体"],
    "columns": ["columns", "column", "柱", "柱子"], "slabs": ["slabs", "floors", "楼板"],
    "floor_openings": ["floor_openings", "floor openings", "slab_openings", "slab openings", "holes", "洞口"],
    "stairs": ["stairs", "stair", "楼梯"], "doors": ["doors", "门"], "windows": ["windows", "窗"], "roofs": ["roofs"], "parapets": ["parapets"], "railings": ["railings"],
}


def plain_header(name: str) -> str:
    return name.lstrip("﻿").strip().lower().replace(" ", "_").replace("-", "_")


def clean_table(df: DataFrame) -> DataFrame:
    """Normalised headers; values trimmed, empty ones NULL."""
    named = df.toDF(*[plain_header(c) for c in df.columns])
    return named.select(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in named.columns])


def read_element_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """CSV tables below a folder, per group; groups without a file are left out, unreadable files are errors.

    Files are read together if they have the same header line: a reader that takes them all at once would
    assign columns by the header of the first file. Values then meet under their column names.
    """
    tables = {}
    for group, names in GROUP_ALIASES.items():
        shapes = "{" + ",".join(sorted({n for name in names for n in (name, name.capitalize(), name.title())})) + "}"
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"{shapes}.csv").text(folder)
        # The first line of a file is the first row of its first block.
        lines = files.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).where("start = 0")
        headers: dict[str, list[str]] = {}
        for row in lines.groupBy("path").agg(F.first("value").alias("header")).orderBy("path").collect():
            headers.setdefault(row.header, []).append(unquote(row.path))
        for paths in headers.values():
            part = clean_table(spark.read.csv(paths, header=True)).withColumn("source_file", F.input_file_name())
            tables[group] = part if group not in tables else tables[group].unionByName(part, allowMissingColumns=True)
    return tables


def section_of(cell) -> Column:
    """Group that the title row of a report section names."""
    low = F.lower(F.trim(F.coalesce(cell, F.lit(""))))
    return (
        F.when(low.rlike("doors?/windows?"), "openings").when(low.rlike("walls|墙体"), "walls").when(low.contains("axes"), "grids")
        .when(low.rlike("slabs|floors|楼板"), "slabs").when(low.rlike("stair|楼梯"), "stairs")
    )


def unstack_sections(rows: DataFrame) -> DataFrame:
    """Items of a sectioned report: a title row, a header row, data rows, or a row that says there are none.

    ``rows``: ``file``, ``sheet``, ``row_no``, ``cells``. Returns ``component_group`` and ``item`` (map of header to value); openings go to
    doors or windows by their kind.
    """
    first = F.get("cells", F.lit(0))
    title, none = section_of(first), F.trim(first).isin("无识别结果", "no results", "no result")
    line = Window.partitionBy("file", "sheet").orderBy("row_no")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    # A header row may itself look like a title, so only titles that do not follow a title count.
    prior = F.lag(title).over(line)
    is_title = title.isNotNull() & prior.isNull()
    marked = rows.withColumn("_t", is_title).withColumn("_n", F.coalesce(none, F.lit(False))).withColumn("_g", F.when(is_title, title))
    marked = marked.withColumn("_s", F.sum(F.col("_t").cast("int")).over(so_far)).withColumn("group", F.last("_g", ignorenulls=True).over(so_far)).where("_s > 0")
    inside = Window.partitionBy("file", "sheet", "_s").orderBy("row_no")
    placed = marked.withColumn("_i", F.row_number().over(inside)).withColumn("_stop", F.max(F.col("_n").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    header = placed.where("_i = 2 and not _n").select("file", "sheet", "_s", F.transform("cells", lambda c: F.translate(F.lower(F.trim(c)), " -", "__")).alias("_h"))
    data = placed.where("_i > 2 and _stop = 0").join(header, ["file", "sheet", "_s"])
    entries = F.filter(F.arrays_zip(F.col("_h").alias("k"), F.slice("cells", 1, F.size("_h")).alias("v")), lambda e: F.coalesce(e["k"], F.lit("")) != "")
    item = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], F.trim(F.coalesce(e["v"], F.lit(""))))))
    out = data.withColumn("item", item).where(F.exists(F.map_values("item"), lambda x: x != ""))
    kind = F.lower(F.trim(F.coalesce(F.try_element_at("item", F.lit("kind")), F.lit(""))))
    group = F.when(F.col("group") == "openings", F.when(kind == "window", "windows").otherwise("doors")).otherwise(F.col("group"))
    return out.select("file", "sheet", "row_no", group.alias("component_group"), "item")


def read_notes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_model(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Components of standard models or execution packages (``source_model`` inside), one row each.

    Returns ``file``, ``component_group``, ``ord``, ``item`` (JSON) and ``is_package``, ``execution_allowed``. Fields are read from ``item`` as needed.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    package = F.get_json_object("value", "$.source_model")
    root = F.coalesce(package, F.col("value"))
    groups = F.from_json(F.get_json_object(root, "$.components"), "map<string,array<string>>")
    approved = [v.to_flag(F.get_json_object("value", f"$.human_approval.{k}")) for k in ("execution_allowed", "approved")]
    allowed = F.coalesce(approved[0], F.lit(False)) | F.coalesce(approved[1], F.lit(False))
    rows = files.select("file", package.isNotNull().alias("is_package"), allowed.alias("execution_allowed"), F.explode(groups).alias("component_group", "_items"))
    return rows.select("file", "is_package", "execution_allowed", "component_group", F.posexplode("_items").alias("ord", "item"))


def model_fields(items: DataFrame) -> DataFrame:
    """Common fields of model components, with the fall-backs of loosely filled models.

    Location from x / y or centre fields, height from both z values, boundary from a list or its JSON text.
    """
    def get(*paths):
        return v.pick(*[F.get_json_object("item", f"$.{p}") for p in paths])

    def number(*paths):
        return v.to_number(get(*paths))

    rise = number("top_z_mm", "end.z") - number("base_z_mm", "start.z")
    return items.select(
        "file", "component_group", "ord", get("id", "element_id").alias("id"), get("name", "element_name").alias("name"), get("type").alias("type"), get("level", "base_level", "level_id").alias("level"),
        number("location.x", "center.x", "x", "center_x").alias("x"), number("location.y", "center.y", "y", "center_y").alias("y"), *[number(f"{p}.{a}", f"{p}_{a}").alias(f"{a}{i}") for i, p in ((1, "start"), (2, "end")) for a in ("x", "y")],
        number("width_mm", "width").alias("width_mm"), F.coalesce(number("height_mm", "height"), F.when(rise > 0, rise)).alias("height_mm"), number("thickness_mm", "thickness").alias("thickness_mm"),
        v.parse_boundary(F.regexp_replace(get("boundary", "boundary_points"), r'"[xyz]"\s*:|[{}]', "")).alias("_b"), F.get_json_object("item", "$.boundary").alias("_raw"),
        v.confidence(F.coalesce(get("confidence"), F.lit(""))).alias("confidence"), get("review_status").alias("review_status"), get("material").alias("material"), get("host_wall_id").alias("host_wall_id"),
    ).withColumn("boundary", F.coalesce(F.from_json("_raw", "array<struct<x:double,y:double,z:double>>"), F.col("_b"))).drop("_raw", "_b")


def read_type_library(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions of type files from the library's category indexes: path, name, summary, category, confidence."""
    schema = "component_group string, semantic_descriptions array<struct<family_file:string,visual_summary:string,category:string,family_type:string,features:array<string>,confidence:double>>"
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "category_index.json").schema(schema).json(folder, multiLine=True)
    rows = raw.select(F.regexp_replace(F.col("_metadata.file_path"), r"[^/]*$", "").alias("_dir"), "component_group", F.explode("semantic_descriptions").alias("d")).where(F.trim("d.family_file") != "")
    return rows.select(
        F.concat("_dir", F.translate("d.family_file", "\\", "/")).alias("file_path"), F.regexp_replace("d.family_file", r"^.*[\\/]", "").alias("file_id"), F.coalesce("d.visual_summary", F.lit("")).alias("summary"),
        v.pick("d.category", "component_group").alias("category"), "d.family_type", "d.features", F.coalesce("d.confidence", F.lit(0.0)).alias("confidence"),
    )


def normalized_components(table: DataFrame, group: str) -> DataFrame:
    """Component columns from a table with any of the known header names; defaults, review state, confidence."""
    def pick(*names, default=None):
        return v.pick_column(table, *names, default=default)

    def number(*names):
        return v.to_number(pick(*names))

    def point(prefix, axis):
        inner = v.parse_point(pick(prefix))[axis]
        return F.coalesce(inner, number(f"{prefix}_{axis}", f"{prefix}{axis}"))

    x = F.coalesce(point("location", "x"), point("center", "x"), point("point", "x"), number("x"))
    y = F.coalesce(point("location", "y"), point("center", "y"), point("point", "y"), number("y"))
    boundary = v.parse_boundary(pick("boundary", "boundary_points", "points"))
    ends = [point(p, a).alias(f"{a}{i}") for i, p in ((1, "start"), (2, "end")) for a in ("x", "y")]
    placed = (F.size(boundary) > 0) | x.isNotNull() | (point("start", "x").isNotNull() & point("end", "x").isNotNull())
    return table.select(
        F.lit(group).alias("component_group"), pick("project_id").alias("project_id"), pick("drawing_id").alias("drawing_id"), pick("id", "element_id", "opening_id", "grid_id", "level_id").alias("id"),
        pick("name", "element_name", "level_name", "grid_name").alias("name"), pick("type", f"{group.rstrip('s')}_type", default=group.rstrip("s")).alias("type"), pick("level", "base_level", "level_id", "start_level_id").alias("level"),
        x.alias("x"), y.alias("y"), *ends, boundary.alias("boundary"), number("width_mm", "width", "stairwell_width", "landing_width").alias("width_mm"), number("height_mm", "height", "total_rise", "floor_height").alias("height_mm"),
        number("thickness_mm", "thickness").alias("thickness_mm"), number("elevation_mm", "elevation").alias("elevation_mm"), number("depth_mm", "depth").alias("depth_mm"), number("diameter_mm", "diameter").alias("diameter_mm"),
        pick("material").alias("material"), pick("host_wall_id").alias("host_wall_id"), pick("host_floor_id").alias("host_floor_id"), pick("source", default=f"table:{group}").alias("source"),
        F.when(placed, v.row_confidence(pick("confidence"), 0.75)).otherwise(v.row_confidence(pick("confidence"), 0.35)).alias("confidence"),
        v.review_status(pick("needs_review"), pick("review_status", "manual_review"), F.when(placed, "ready").otherwise("needs_review")).alias("review_status"), pick("notes", "remarks").alias("notes"),
    )
