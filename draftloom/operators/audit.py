"""Rule audits: every rule is a predicate on a table, a finding is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftloom.functions import geometry as g
from draftloom.functions import semantics as sem
from draftloom.functions.geometry import col
from draftloom.operators.ordered import number_rows
from draftloom.operators.spatial import Keys

Rule = tuple[str, str, Column]


def findings(df: DataFrame, keys: Keys, group: str | Column, rules: list[Rule], component_id: str = "id") -> DataFrame:
    """One row per broken rule and component, in one pass over the table.

    A rule is (name, severity, test); a test that is NULL does not hold.
    """
    hits = F.array_compact(F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, test in rules
    ]))
    name = F.lit(group) if isinstance(group, str) else group
    return df.select(*keys, name.alias("component_group"), F.col(component_id).cast("string").alias("component_id"), F.explode(hits).alias("_f")).select(
        *keys, "component_group", "component_id", "_f.rule", "_f.severity"
    )


def _none(name: str) -> Column:
    return F.col(name).isNull()


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _not_positive(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) <= 0


def common_rules() -> list[Rule]:
    """Checks of every component: id, review state, confidence."""
    return [
        ("missing_id", "error", _text("id") == ""),
        ("invalid_review_status", "needs_review", ~F.coalesce(F.col("review_status").isin("ready", "confirmed", "needs_review", "rejected"), F.lit(False))),
        ("invalid_confidence", "needs_review", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
    ]


def model_rules(group: str) -> list[Rule]:
    """Model checks of one group, on top of the common ones."""
    ends = [("invalid_start", "error", _none("x1") | _none("y1")), ("invalid_end", "error", _none("x2") | _none("y2"))]
    rules = {
        "levels": [("missing_name", "error", _text("name") == ""), ("missing_elevation", "error", _none("elevation_mm"))],
        "grids": ends,
        "walls": [*ends, ("missing_base_level", "error", _text("base_level") == ""), ("missing_height_and_top", "needs_review", _none("height_mm") & (_text("top_level") == ""))],
        "columns": [
            ("invalid_location", "error", _none("x") | _none("y")), ("missing_level", "error", _text("level") == ""),
            ("missing_section", "needs_review", (_none("width_mm") | _none("depth_mm")) & _none("diameter_mm")),
            ("missing_top", "needs_review", _none("height_mm") & _none("top_z_mm") & (_text("top_level") == "")),
        ],
        "slabs": [("short_boundary", "needs_review", F.size(F.coalesce("boundary", F.array())) < 3)],
        "floor_openings": [("short_boundary", "needs_review", F.size(F.coalesce("boundary", F.array())) < 3)],
        "stairs": [("short_boundary", "needs_review", F.size(F.coalesce("boundary", F.array())) < 3), ("missing_levels", "needs_review", (_text("base_level") == "") | (_text("top_level") == ""))],
        "doors": [("invalid_location", "error", _none("x") | _none("y")), ("missing_width", "error", _none("width_mm")), ("missing_height", "needs_review", _none("height_mm"))],
        "windows": [("invalid_location", "error", _none("x") | _none("y")), ("missing_width", "error", _none("width_mm")), ("missing_height", "error", _none("height_mm"))],
    }
    return common_rules() + rules[group]


def validate_group(df: DataFrame, group: str, keys: Keys = ("project_id",)) -> DataFrame:
    return findings(df, keys, group, model_rules(group))


def duplicate_values(df: DataFrame, keys: Keys, group: str, field: str, rule: str, order: str = "id") -> DataFrame:
    """Rows that repeat a value of an earlier row. Values are counted before rows are marked."""
    first = df.where(_text(field) != "").groupBy(*keys, field).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    hit = df.join(first, [*keys, field]).where(F.col(order) != F.col("_first"))
    return hit.select(*keys, F.lit(group).alias("component_group"), F.col("id").cast("string").alias("component_id"), F.lit(rule).alias("rule"), F.lit("needs_review").alias("severity"))


def broken_references(items: DataFrame, targets: DataFrame, keys: Keys, group: str, field: str, missing: str = "needs_review", broken: str = "needs_review") -> DataFrame:
    """Items without a host and items whose host does not exist."""
    known = targets.select(*keys, F.col("id").alias(field)).distinct().withColumn("_known", F.lit(True))
    rows = items.join(known, [*keys, field], "left")
    empty = _text(field) == ""
    return findings(rows, keys, group, [(f"missing_{field}", missing, empty), (f"broken_{field}", broken, ~empty & F.col("_known").isNull())])


def table_rules(columns: list[str], primary: str) -> list[Rule]:
    """Checks of an exported table: empty ids and values that should be numbers."""
    sizes = {"Length", "Width", "Stairwell_Width", "Height", "Thickness", "Elevation"}
    numeric = [c for c in columns if c.endswith(("_X", "_Y", "_Z")) or c in sizes]
    bad = [(f"invalid_number:{c}", "warning", (_text(c) != "") & F.col(c).cast("string").try_cast("double").isNull()) for c in numeric]
    return [("missing_id", "error", _text(primary) == ""), *bad]


def validate_table(df: DataFrame, name: str, primary: str, keys: Keys = ()) -> DataFrame:
    """Empty, repeated and unreadable values of one exported table."""
    bad = findings(df, keys, name, table_rules(df.columns, primary), primary)
    repeated = df.where(_text(primary) != "").groupBy(*keys, primary).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # One finding per surplus row, made from the count.
    surplus = repeated.withColumn("_i", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("_n"))))
    return bad.unionByName(surplus.select(*keys, F.lit(name).alias("component_group"), F.col(primary).cast("string").alias("component_id"), F.lit("duplicate_id").alias("rule"), F.lit("error").alias("severity")))


def apply_validation(components: DataFrame, issues: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """Ready components with a finding go to review."""
    hit = issues.where("component_id <> ''").select(*keys, "component_group", F.col("component_id").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    rows = components.withColumn("_id", F.col("id").cast("string")).join(hit, [*keys, "component_group", "_id"], "left")
    known = F.coalesce(F.col("review_status").isin("ready", "confirmed", "needs_review", "rejected"), F.lit(False))
    status = F.when(~known, "needs_review").when(F.col("_hit") & (F.col("review_status") == "ready"), "needs_review").otherwise(F.col("review_status"))
    return rows.withColumn("review_status", status).select(*components.columns)


def needs_confirmation(components: DataFrame, issues: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """Projects that a person must confirm."""
    state = components.groupBy(*keys).agg(F.bool_or(F.col("review_status") == "needs_review").alias("_r"))
    return state.join(issues.select(*keys).distinct().withColumn("_i", F.lit(True)), list(keys), "left").select(
        *keys, (F.coalesce("_r", F.lit(False)) | F.coalesce("_i", F.lit(False))).alias("requires_confirmation")
    )


def wall_compliance(walls: DataFrame, keys: Keys) -> DataFrame:
    same = _none("x1") | _none("x2") | (g.length("x1", "y1", "x2", "y2") <= 1e-6)
    return findings(walls, keys, "walls", [
        ("wall_geometry", "error", same), ("wall_height", "warning", _not_positive("height_mm")), ("wall_thickness", "warning", _not_positive("thickness_mm")),
    ])


def opening_compliance(openings: DataFrame, walls: DataFrame, keys: Keys) -> DataFrame:
    """Host, distance to the host and size of doors and windows."""
    host = walls.select(*keys, F.col("id").alias("host_wall_id"), *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2", "thickness_mm")])
    rows = openings.join(host, [*keys, "host_wall_id"], "left")
    lost, placed = _none("_x1"), F.col("x").isNotNull()
    far = g.point_segment_distance("x", "y", "_x1", "_y1", "_x2", "_y2") > F.greatest(F.lit(250.0), F.coalesce("_thickness_mm", F.lit(0)) * 0.75)
    return findings(rows, keys, F.concat(F.col("kind"), F.lit("s")), [
        ("host_wall", "error", lost), ("opening_location", "error", ~lost & ~placed), ("host_wall_proximity", "warning", ~lost & placed & far),
        ("opening_width", "warning", _not_positive("width_mm")), ("opening_height", "warning", _not_positive("height_mm")),
    ])


def void_compliance(voids: DataFrame, slabs: DataFrame, keys: Keys) -> DataFrame:
    """Voids: host slab, boundary inside it, size."""
    host = slabs.select(*keys, F.col("id").alias("host_floor_id"), F.col("boundary").alias("_slab"))
    rows = voids.join(host, [*keys, "host_floor_id"], "left")
    outside = ~F.forall(g.open_ring("boundary"), lambda p: g.point_in_or_on_polygon(p["x"], p["y"], F.col("_slab")))
    return findings(rows, keys, "floor_openings", [
        ("host_floor", "error", _none("_slab")), ("opening_inside_slab", "error", (F.size("_slab") >= 3) & (F.size("boundary") >= 3) & outside),
        ("opening_boundary", "error", F.size(F.coalesce("boundary", F.array())) < 3), ("opening_size", "warning", _not_positive("width_mm") | _not_positive("depth_mm")),
    ])


def column_compliance(columns: DataFrame, slabs: DataFrame, keys: Keys, cell: float = 5000.0) -> DataFrame:
    """Columns: location, section, top, and whether any slab of the project lies under them.

    A column is done with the first slab found under it, so layers of slabs do not multiply the work.
    """
    from draftloom.operators.matching import point_box
    from draftloom.operators.spatial import prefixed, with_cells
    from draftloom.operators.walls import BOX

    box = g.bounding_box("boundary")
    placed = slabs.where(F.size("boundary") >= 3)
    for name, part in zip(BOX, ("x0", "y0", "x1", "y1")):
        placed = placed.withColumn(name, box[part])
    by = [*keys, "_gx", "_gy"]
    spots = prefixed(with_cells(point_box(columns.where("x is not null")), BOX, cell), "a_", by)
    under = prefixed(with_cells(placed, BOX, cell), "b_", by)
    on = F.col("a_x").between(F.col("b_bx0"), F.col("b_bx1")) & F.col("a_y").between(F.col("b_by0"), F.col("b_by1")) & g.point_in_or_on_polygon("a_x", "a_y", "b_boundary")
    for c in by:
        on = on & (spots[c] == under[c])
    inside = spots.join(under, on, "left_semi")
    covered = inside.select(*keys, F.col("a_id").alias("id")).distinct().withColumn("_in", F.lit(True))
    any_slab = slabs.select(*keys).distinct().withColumn("_slabs", F.lit(True))
    rows = columns.join(covered, [*keys, "id"], "left").join(any_slab, list(keys), "left")
    sized = ~_not_positive("diameter_mm") | (~_not_positive("width_mm") & ~_not_positive("depth_mm"))
    return findings(rows, keys, "columns", [
        ("column_location", "error", _none("x")), ("column_slab_relation", "warning", F.col("x").isNotNull() & F.col("_slabs") & F.col("_in").isNull()),
        ("column_size", "warning", ~sized), ("column_height", "warning", _not_positive("height_mm") & (_text("top_level") == "")),
    ])


def grid_compliance(grids: DataFrame, keys: Keys) -> DataFrame:
    from draftloom.functions.text import safe_name

    return findings(grids, keys, "grids", [("grid_name", "warning", (_text("name") == "") | (safe_name("name", F.lit("")) != _text("name")))])


def material_compliance(components: DataFrame, keys: Keys) -> DataFrame:
    relevant = F.col("component_group").isin("walls", "columns", "slabs", "doors", "windows")
    return findings(components, keys, F.col("component_group"), [
        ("material_missing", "warning", relevant & (_text("material") == "")), ("material_needs_review", "warning", F.col("material_needs_review")),
        ("material_defaulted", "warning", F.lower("material_source") == "ai_suggested_default"), ("material_low_confidence", "warning", F.col("material_confidence") < 0.80),
    ])


CRITICAL = ["walls", "columns", "slabs", "floor_openings", "doors", "windows"]


def is_inferred(columns: list[str]) -> Column:
    words = F.lower(F.concat_ws(" ", *columns))
    return sem.any_word(words, ["default", "inferred", "fallback", "默认", "推断"])


def is_auto_fixable(message) -> Column:
    """Data faults that later evidence can repair without a person."""
    words = ["invalid numeric field", "missing numeric field", "height_mm", "width_mm", "sill_height_mm", "thickness_mm", "depth_mm"]
    return sem.any_word(F.lower(F.coalesce(col(message), F.lit(""))), words)


def evidence_audit(components: DataFrame, keys: Keys) -> DataFrame:
    """Components that rest on defaults or on low confidence."""
    have = [c for c in ("source", "type", "notes", "material_source", "material_reason") if c in components.columns]
    low = (F.col("confidence") > 0) & (F.col("confidence") < 0.75)
    critical = F.col("component_group").isin(CRITICAL)
    return findings(components, keys, F.col("component_group"), [
        ("low_trust_default_or_inferred", "warning", is_inferred(have)), ("low_confidence_evidence", "warning", low & critical), ("low_confidence_evidence", "info", low & ~critical),
    ])


# Requirements read from design notes: rule, group, word, tolerance.
NOTE_RULES = [
    ("sill_height", "windows", "窗台", 30.0), ("wall_thickness", "walls", "墙厚", 20.0), ("wall_thickness", "walls", "外墙", 20.0),
    ("wall_thickness", "walls", "内墙", 20.0), ("slab_thickness", "slabs", "楼板", 15.0), ("slab_thickness", "slabs", "板厚", 15.0),
    ("floor_height", "levels", "层高", 50.0), ("railing_height", "stairs_or_railings", "栏杆", 30.0), ("handrail_height", "stairs_or_railings", "扶手", 30.0),
    ("stair_riser_height", "stairs", "踏步高", 10.0), ("stair_tread_depth", "stairs", "踏步宽", 10.0), ("roof_slope", "roofs", "屋面坡度", 0.5),
    ("ramp_slope", "ramps", "坡道坡度", 0.5),
]
PAIR_RULES = [("door", "doors", "门"), ("window", "windows", "窗")]
COMPARED = {
    "door_width": ("doors", "width_mm"), "door_height": ("doors", "height_mm"), "window_width": ("windows", "width_mm"), "window_height": ("windows", "height_mm"),
    "sill_height": ("windows", "sill_mm"), "wall_thickness": ("walls", "thickness_mm"), "slab_thickness": ("slabs", "thickness_mm"),
}


def design_requirements(notes: DataFrame, keys: Keys, text: str = "text") -> DataFrame:
    """Sizes that design notes ask for: rule, group, value, unit, tolerance, each once per project."""
    source = F.col(text)

    def number(raw, unit):
        return F.when(F.lower(unit).isin("m", "米"), raw.try_cast("double") * 1000).otherwise(raw.try_cast("double"))

    found = []
    for rule, group, word, tolerance in NOTE_RULES:
        shape = rf"(?i){word}[^。；;\n]{{0,24}}?(\d+(?:\.\d+)?)\s*(mm|毫米|m|米|%|％)?"
        pairs = F.arrays_zip(F.regexp_extract_all(source, F.lit(shape), F.lit(1)).alias("v"), F.regexp_extract_all(source, F.lit(shape), F.lit(2)).alias("u"))
        slope = F.lit(rule.endswith("slope"))
        found.append(F.transform(pairs, lambda p: F.struct(
            F.lit(rule).alias("rule"), F.lit(group).alias("component_group"), number(p["v"], p["u"]).alias("value"),
            F.when(slope & p["u"].isin("%", "％"), "%").otherwise("mm").alias("unit"), F.lit(tolerance).alias("tolerance"),
        )))
    for name, group, word in PAIR_RULES:
        shape = rf"(?i){word}[^。；;\n]{{0,30}}?(\d+(?:\.\d+)?)\s*(?:mm|毫米|m|米)?\s*[xX×*]\s*(\d+(?:\.\d+)?)\s*(mm|毫米|m|米)?"
        units = F.regexp_extract_all(source, F.lit(shape), F.lit(3)).alias("u")
        for part, side in ((1, "width"), (2, "height")):
            pairs = F.arrays_zip(F.regexp_extract_all(source, F.lit(shape), F.lit(part)).alias("v"), units)
            found.append(F.transform(pairs, lambda p: F.struct(
                F.lit(f"{name}_{side}").alias("rule"), F.lit(group).alias("component_group"), number(p["v"], p["u"]).alias("value"),
                F.lit("mm").alias("unit"), F.lit(30.0).alias("tolerance"),
            )))
    rows = notes.select(*keys, F.explode(F.concat(*found)).alias("_r")).select(*keys, "_r.*").where("value is not null")
    return rows.groupBy(*keys, "rule", "component_group", "value", "unit").agg(F.min("tolerance").alias("tolerance"))


def requirement_conflicts(requirements: DataFrame, values: DataFrame, keys: Keys, stop: int | None = None, bucket: int = 65536) -> DataFrame:
    """Components that miss or contradict a requirement.

    ``values``: keys, ``id``, ``ord`` and ``rule`` with ``actual``. All rows, unless a report that shows no more
    asks for ``stop``: then a rule ends with the conflict that brings its rows to that number. Rows are numbered in
    buckets of ``ord``, so a project that holds most rows is shared by many tasks.
    """
    rows = requirements.join(values, [*keys, "rule"])
    missing = F.coalesce("actual", F.lit(0)) <= 0
    off = F.abs(F.col("actual") - F.col("value")) > F.col("tolerance")
    hits = rows.where(missing | off).withColumn("_missing", missing)
    by = [*keys, "rule", "value", "unit"]
    if stop is None:
        return _conflict_rows(hits, keys)
    # The first conflict with at least ``stop`` rows up to it ends the list: rows below it are all kept.
    numbered = number_rows(hits, by, [F.col("ord"), F.col("id")], F.floor(F.col("ord") / bucket), "_n")
    end = numbered.where(~F.col("_missing") & (F.col("_n") >= stop)).groupBy(*by).agg(F.min("_n").alias("_end"))
    kept = numbered.join(end, by, "left").where(F.col("_end").isNull() | (F.col("_n") <= F.col("_end")))
    return _conflict_rows(kept, keys)


def _conflict_rows(hits: DataFrame, keys: Keys) -> DataFrame:
    return hits.select(
        *keys, "rule", "value", "id", F.when(F.col("_missing"), "missing_required_evidence").otherwise("multi_source_conflict").alias("evidence_type"),
        F.when(~F.col("_missing"), F.round(F.abs(F.col("actual") - F.col("value")), 3)).alias("difference"),
    )


def floor_height_conflicts(requirements: DataFrame, levels: DataFrame, keys: Keys) -> DataFrame:
    """Level steps that contradict the floor height the notes ask for."""
    line = Window.partitionBy(*keys).orderBy("elevation_mm", "level_id")
    steps = levels.withColumn("upper", F.lead("level_id").over(line)).withColumn("step", F.lead("elevation_mm").over(line) - F.col("elevation_mm")).where("upper is not null")
    asked = requirements.where("rule = 'floor_height'").select(*keys, "value", "tolerance")
    return steps.join(asked, list(keys)).where(F.abs(F.col("step") - F.col("value")) > F.col("tolerance")).select(
        *keys, F.concat_ws("->", "level_id", "upper").alias("component_id"), "value", F.round(F.abs(F.col("step") - F.col("value")), 3).alias("difference")
    )


def material_conflicts(notes: DataFrame, components: DataFrame, keys: Keys, text: str = "text") -> DataFrame:
    """Components whose material is not the one the notes name for their group, once for each material asked for.

    What several notes of a project ask alike meets the components once.
    """
    words = {"doors": "门", "windows": "窗", "walls": "墙"}
    table = F.array(*[F.struct(F.lit(g_).alias("component_group"), sem.expected_material(F.col(text), w).alias("expected")) for g_, w in words.items()])
    asked = notes.select(*keys, F.explode(table).alias("_e")).select(*keys, "_e.*").where("expected <> ''").distinct()
    rows = components.where(_text("material") != "").join(asked, [*keys, "component_group"])
    return rows.where(~sem.materials_match(F.col("expected"), F.col("material"))).select(*keys, "component_group", "id", "expected", "material")


def uncertain_rows(flags: DataFrame, issues: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """Review list: flagged rows and findings, the first per component; flags go before findings.

    Both: keys, ``component_group``, ``component_id``, ``reason``.
    """
    both = flags.withColumn("_o", F.lit(0)).unionByName(issues.withColumn("_o", F.lit(1)))
    best = both.groupBy(*keys, "component_group", "component_id").agg(F.min(F.struct("_o", "reason")).alias("_b"))
    return best.select(*keys, "component_group", "component_id", "_b.reason")


def risk_weight(severity) -> Column:
    word = F.lower(F.trim(col(severity)))
    return F.when(word.isin("error", "high"), 3).when(word.isin("warning", "medium"), 2).otherwise(1)


def stair_reviews(stairs: DataFrame, top: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """Why the vertical data of a stair need a look. ``top``: keys, ``max_level_mm`` of the project."""
    rows = stairs.join(top, list(keys), "left")
    rise, z0, z1, high = (F.col(c) for c in ("total_rise_mm", "z0", "z1", "max_level_mm"))
    riser, tread, risers = F.col("riser_mm"), F.col("tread_mm"), F.col("risers")
    tests = [
        ("missing total_rise_mm", rise.isNull()), ("total_rise_mm does not match end_z-start_z", F.abs((z1 - z0) - rise) > 50),
        ("end_z exceeds highest known level elevation", (high != 0) & (z1 > high + 500)), ("total_rise_mm exceeds known building height", (high != 0) & (rise > high + 500)),
        ("missing riser_height_mm", riser.isNull()), ("riser_height_mm outside typical stair range", ~riser.between(100, 220)),
        ("missing tread_depth_mm", tread.isNull()), ("tread_depth_mm outside typical stair range", ~tread.between(200, 400)),
        ("riser_height_mm does not match total_rise_mm/number_of_risers", (risers > 0) & (F.abs(rise / risers - riser) > 20)),
        ("run_count * risers_per_run does not match number_of_risers", F.abs(F.col("run_count") * F.col("risers_per_run") - risers) > 1),
        ("opening_required but missing stairwell_opening_boundary", F.col("opening_required") & F.col("opening_boundary").isNull()),
        ("missing stairwell_width_mm", F.col("stairwell_width_mm").isNull()),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), reason) for reason, test in tests]))
    return rows.select(*keys, "id", F.concat_ws(" | ", reasons).alias("review_reason"), (F.size(reasons) > 0).alias("needs_review"))


def parapet_bindings(parapets: DataFrame, levels: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """Bottom and top of a parapet relative to its level; a drawn height that disagrees by 10 mm asks for review."""
    base = levels.select(*keys, F.col("name").alias("level"), F.col("elevation_mm").alias("_e"))
    rows = parapets.join(base, [*keys, "level"], "left")
    bottom = F.coalesce(F.col("bottom_offset_mm"), F.round(F.col("z0") - F.col("_e"), 3), F.lit(0.0))
    off = F.abs(F.col("z0") - (F.col("_e") + bottom)) > 10
    ready = F.col("_e").isNotNull() & F.col("height_mm").isNotNull() & ~F.coalesce(off, F.lit(False))
    return rows.select(
        *keys, "id", bottom.alias("bottom_mm"), F.round(bottom + F.col("height_mm"), 3).alias("top_mm"), F.round(F.col("_e") + bottom, 3).alias("bottom_elevation_mm"),
        F.when(ready, "ready").otherwise("needs_review").alias("binding_status"),
    )


def stair_run_checks(stairs: DataFrame, runs: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """Run contracts of stairs: count of usable runs, whole treads, run lines inside the boundary.

    ``stairs``: keys, ``id``, ``run_count``, ``treads``, x0, y0, x1, y1 of the boundary, ``width_mm``. ``runs``: keys, ``stair_id``, x1, y1, x2, y2, ``run_width_mm``.
    """
    r = g.with_measures(runs).where("len > 1")
    s = stairs.select(*keys, F.col("id").alias("stair_id"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1", "width_mm")])
    rows = r.join(s, [*keys, "stair_id"])
    half = F.coalesce(F.when(F.col("run_width_mm") > 0, F.col("run_width_mm")), F.col("_width_mm")) / 2.0
    inside = F.lit(True)
    for x, y in (("x1", "y1"), ("x2", "y2")):
        for sign in (-1, 1):
            px, py = F.col(x) - F.col("uy") * half * sign, F.col(y) + F.col("ux") * half * sign
            inside = inside & px.between(F.col("_x0") - 1, F.col("_x1") + 1) & py.between(F.col("_y0") - 1, F.col("_y1") + 1)
    facts = rows.groupBy(*keys, F.col("stair_id").alias("id")).agg(F.count(F.lit(1)).alias("_runs"), F.bool_and(inside).alias("_inside"))
    out = stairs.join(facts, [*keys, "id"], "left")
    return findings(out, keys, "stairs", [
        ("run_count", "error", ~F.col("run_count").isin(1, 2, 4)), ("uneven_treads", "error", F.col("treads") % F.col("run_count") != 0),
        ("missing_runs", "warning", F.coalesce("_runs", F.lit(0)) < F.col("run_count")), ("run_outside_boundary", "error", ~F.col("_inside")),
    ])
