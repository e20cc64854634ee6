"""Per-drawing facts: origin, scope of walls, slabs, inventories, contexts, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom.functions import values as v
from draftloom.functions import geometry as g
from draftloom.operators.ordered import mode, number_rows
from draftloom.operators.spatial import Keys
from draftloom.operators.walls import DRAWING


def drawing_counts(elements: DataFrame, keys: Keys = DRAWING, kind: str = "kind", kinds: tuple = ("door", "window")) -> DataFrame:
    """Elements per drawing: in total and by kind."""
    return elements.groupBy(*keys).agg(F.count(F.lit(1)).alias("elements"), *[F.count_if(F.col(kind) == k).alias(f"{k}s") for k in kinds])


# Names of raw shapes in the inventory.
RAW_KINDS = {"LWPOLYLINE": "POLYLINE", "POLYLINE": "POLYLINE", "INSERT": "BLOCK"}


def raw_inventory(entities: DataFrame, keys: Keys = DRAWING, bucket: int = 100000) -> DataFrame:
    """Raw shapes with ids such as ``LINE-000001``, numbered per kind in source order."""
    kind = F.upper("etype")
    for name, short in RAW_KINDS.items():
        kind = F.when(F.upper("etype") == name, short).otherwise(kind)
    named = entities.withColumn("raw_kind", kind)
    numbered = number_rows(named, [*keys, "raw_kind"], [F.col("ord")], F.floor(F.col("ord") / bucket), "raw_no")
    return numbered.withColumn("raw_id", F.concat("raw_kind", F.lit("-"), v.padded(F.col("raw_no"), 6)))


def drawing_origin(axes: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Origin of a drawing: leftmost vertical axis by lowest horizontal axis, else the world origin."""
    ori = g.orientation("x1", "y1", "x2", "y2", 5)
    left = F.when(ori == "V", F.struct(F.least("x1", "x2").alias("k"), F.col("ord"), ((F.col("x1") + F.col("x2")) / 2).alias("v"), F.coalesce("name", F.col("id").cast("string")).alias("name")))
    low = F.when(ori == "H", F.struct(F.least("y1", "y2").alias("k"), F.col("ord"), ((F.col("y1") + F.col("y2")) / 2).alias("v"), F.coalesce("name", F.col("id").cast("string")).alias("name")))
    best = axes.groupBy(*keys).agg(F.min(left).alias("_l"), F.min(low).alias("_b"))
    both = F.col("_l").isNotNull() & F.col("_b").isNotNull()
    return best.select(
        *keys, F.when(both, F.round("_l.v", 3)).otherwise(0.0).alias("ox"), F.when(both, F.round("_b.v", 3)).otherwise(0.0).alias("oy"),
        F.when(both, "left_bottom_axis_intersection").otherwise("fallback_world_origin").alias("source"),
        F.when(both, F.col("_l.name")).alias("axis_x"), F.when(both, F.col("_b.name")).alias("axis_y"), F.when(both, 0.88).otherwise(0.25).alias("confidence"),
    )


def local_points(rows: DataFrame, origins: DataFrame, keys: Keys, pairs: list[tuple[str, str]]) -> DataFrame:
    """Add ``local_<x>``, ``local_<y>`` relative to the drawing's origin; no origin means zero."""
    out = rows.join(origins.select(*keys, "ox", "oy"), list(keys), "left")
    for x, y in pairs:
        out = out.withColumn(f"local_{x}", F.round(F.col(x) - F.coalesce("ox", F.lit(0.0)), 3)).withColumn(f"local_{y}", F.round(F.col(y) - F.coalesce("oy", F.lit(0.0)), 3))
    return out.drop("ox", "oy")


def wall_scopes(walls: DataFrame, keys: Keys = ("project_id", "drawing_id")) -> DataFrame:
    """Exterior or interior by the wall's place in the plan's outer box and its thickness.

    Bounds and median thickness are aggregates with small partial states; walls join them back.
    """
    facts = walls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile("thickness_mm", F.lit(0.5)).alias("_med"),
        F.min(F.least("x1", "x2")).alias("_x0"), F.min(F.least("y1", "y2")).alias("_y0"), F.max(F.greatest("x1", "x2")).alias("_x1"), F.max(F.greatest("y1", "y2")).alias("_y1"),
    )
    rows = walls.join(facts, list(keys))
    tolerance = F.greatest(F.lit(250.0), F.coalesce("_med", F.lit(200.0)) * 1.35)
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    gaps = {"west": F.abs(mx - F.col("_x0")), "east": F.abs(mx - F.col("_x1")), "south": F.abs(my - F.col("_y0")), "north": F.abs(my - F.col("_y1"))}

    def near(side):
        return F.when(gaps[side] <= tolerance, side)

    sides = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, (s, d) in enumerate(gaps.items())]))
    edge = (
        F.when(dx >= dy * 3, F.coalesce(near("south"), near("north"))).when(dy >= dx * 3, F.coalesce(near("west"), near("east")))
        .otherwise(F.when(sides["d"] <= tolerance, sides["s"]))
    )
    delta = F.coalesce(F.col("thickness_mm") - F.col("_med"), F.lit(0.0))
    size = F.hypot(dx, dy)
    kind = F.lower(F.coalesce("type", F.lit(""))) if "type" in walls.columns else F.lit("")
    junction = kind.isin("short_paired_wall_lines", "t_pier_wall_lines") & (size <= F.greatest(F.lit(600.0), F.col("thickness_mm") * 1.5))
    outer = 0.84 + F.when(delta >= 40, 0.06).when(delta <= -80, -0.12).otherwise(0.0)
    inner = 0.78 + F.when(delta <= -40, 0.05).when(delta >= 120, F.when(junction, 0.04).otherwise(-0.08)).otherwise(0.0)
    few = F.col("_n") < 4
    rows = rows.withColumn("_edge", edge)
    out = F.col("_edge").isNotNull()
    confidence = F.round(F.when(few, 0.35).when(out, F.least(F.lit(0.95), outer)).otherwise(F.least(F.lit(0.9), inner)), 3)
    return rows.select(
        *walls.columns, F.when(few, "unknown").when(out, "exterior").otherwise("interior").alias("wall_scope"),
        F.when(few, "unknown").when(out, F.col("_edge")).otherwise("inside").alias("wall_outer_edge"), confidence.alias("wall_scope_confidence"),
        F.when(few, True).when(out, confidence < 0.78).otherwise(confidence < 0.72).alias("wall_scope_needs_review"),
        F.when(few, "insufficient_plan_context").otherwise("plan_outer_envelope").alias("wall_scope_source"),
    )


def default_slabs(walls: DataFrame, parapets: DataFrame, voids: DataFrame, frames: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Slab outline of a drawing: box of its walls, else parapets, else voids with a margin, else the frame.

    Each input: keys, x0, y0, x1, y1 per element.
    """
    def box(df, name, margin=0.0):
        return df.groupBy(*keys).agg(F.struct(
            (F.min("x0") - margin).alias("x0"), (F.min("y0") - margin).alias("y0"), (F.max("x1") + margin).alias("x1"), (F.max("y1") + margin).alias("y1")
        ).alias(name))

    kinds = [("wall", walls, 0.0, 0.72), ("parapet", parapets, 0.0, 0.72), ("floor_opening", voids, 1000.0, 0.45), ("frame", frames, 0.0, 0.35)]
    rows = None
    for name, df, margin, _ in kinds:
        boxes = box(df, name, margin)
        rows = boxes if rows is None else rows.join(boxes, list(keys), "full")
    source = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(f"{n}_bbox_default_slab")) for n, *_ in kinds])
    confidence = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(c)) for n, _, _, c in kinds])
    rows = rows.withColumn("_b", F.coalesce(*[F.col(n) for n, *_ in kinds]))
    return rows.select(
        *keys, F.round("_b.x0", 3).alias("x0"), F.round("_b.y0", 3).alias("y0"), F.round("_b.x1", 3).alias("x1"), F.round("_b.y1", 3).alias("y1"), source.alias("source"),
        confidence.alias("confidence"), F.round((F.col("_b.x1") - F.col("_b.x0")) * (F.col("_b.y1") - F.col("_b.y0")), 3).alias("area"),
        F.lit(120.0).alias("thickness_mm"), (source != "wall_bbox_default_slab").alias("needs_review"),
    )


def void_hosts(voids: DataFrame, slabs: DataFrame, keys: Keys = DRAWING, cell: float = 10000.0) -> DataFrame:
    """Slab around each void's centre, the first one listed; without one, the drawing's first slab.

    ``voids``: keys, ``id``, ``x``, ``y``. ``slabs``: keys, ``id``, ``ord``, ``boundary``.
    """
    from draftloom.operators.matching import point_box
    from draftloom.operators.spatial import box_join
    from draftloom.operators.walls import BOX

    box = g.bounding_box("boundary")
    placed = slabs.withColumn("_b", box)
    for name, part in zip(BOX, ("x0", "y0", "x1", "y1")):
        placed = placed.withColumn(name, F.col(f"_b.{part}"))
    inside = box_join(point_box(voids), placed.drop("_b"), keys, BOX, BOX, cell, condition=g.point_in_polygon("a_x", "a_y", "b_boundary"))
    best = inside.groupBy(*keys, F.col("a_id").alias("id")).agg(F.min(F.struct("b_ord", "b_id")).alias("_h"))
    first = slabs.groupBy(*keys).agg(F.min(F.struct("ord", "id")).alias("_f"))
    return voids.join(best, [*keys, "id"], "left").join(first, list(keys), "left").select(
        *voids.columns, F.coalesce("_h.b_id", "_f.id").alias("host_floor_id"), F.col("_h").isNotNull().alias("inside")
    )


def exterior_centers(runs: DataFrame, keys: Keys) -> DataFrame:
    """Length-weighted centre of the exterior walls of a level."""
    size = g.length("x1", "y1", "x2", "y2")
    sums = runs.where("is_exterior").withColumn("_l", size).where("_l > 1").groupBy(*keys).agg(
        F.sum((F.col("x1") + F.col("x2")) / 2 * F.col("_l")).alias("_x"), F.sum((F.col("y1") + F.col("y2")) / 2 * F.col("_l")).alias("_y"), F.sum("_l").alias("_t")
    )
    return sums.select(*keys, (F.col("_x") / F.col("_t")).alias("cx"), (F.col("_y") / F.col("_t")).alias("cy"))


def outward_flips(runs: DataFrame, keys: Keys) -> DataFrame:
    """Whether an exterior wall must be flipped so that its left side faces away from the centre."""
    rows = runs.join(exterior_centers(runs, keys), list(keys), "left")
    ox, oy = (F.col("x1") + F.col("x2")) / 2 - F.col("cx"), (F.col("y1") + F.col("y2")) / 2 - F.col("cy")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    clear = F.col("is_exterior") & F.col("cx").isNotNull() & (F.hypot(ox, oy) > 0.001) & (F.hypot(dx, dy) > 0.001)
    return rows.select(*runs.columns, "cx", "cy", F.when(clear, -dy * ox + dx * oy < 0).otherwise(False).alias("flip"))


def parapet_heights(texts: DataFrame, marks: DataFrame, roofs: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """Parapet height of a project: commonest height in its texts (larger wins a tie), else top mark less roof, else 900.

    ``texts``: keys, ``height_mm``. ``marks``: keys, ``elevation_mm``. ``roofs``: keys, ``elevation_mm``.
    """
    said = mode(texts.where("height_mm is not null"), keys, F.round("height_mm", 1), "largest").select(*keys, F.col("value").alias("_said"))
    base = roofs.select(*keys, F.col("elevation_mm").alias("_base"))
    top = marks.join(base, list(keys)).where(F.col("elevation_mm") > F.col("_base") + 1).groupBy(*keys).agg((F.max("elevation_mm") - F.first("_base")).alias("_rise"))
    rows = base.join(said, list(keys), "left").join(top, list(keys), "left")
    rise = F.when(F.col("_rise").between(250, 6000), F.round("_rise", 3))
    return rows.select(
        *keys, F.coalesce("_said", rise, F.lit(900.0)).alias("height_mm"),
        F.when(F.col("_said").isNotNull(), "text_annotation").when(rise.isNotNull(), "elevation_mark_difference").otherwise("default_review_required").alias("source"),
        (F.col("_said").isNull() & rise.isNull()).alias("needs_review"),
    )


def wall_layers(layers: DataFrame, walls: DataFrame, keys: Keys) -> DataFrame:
    """Layer thicknesses of a wall: finishes keep theirs, core layers share the rest of the wall.

    ``layers``: keys, ``wall_id``, ``layer_no``, ``material``, ``role``, ``thickness_mm``. Without a core the thickest
    layer (the first one on a tie) becomes it. All sums are aggregates joined back to the layers.
    """
    text = F.lower(F.concat_ws(" ", "role", "material"))
    function = (
        F.when(text.rlike("insulation|thermal|保温|隔热"), "insulation").when(text.rlike("substrate|sheathing|找平|基层|砂浆"), "substrate")
        .when(text.rlike("interior|inside|inner|内|finish2"), "finish2")
        .when(text.rlike("finish|paint|coating|plaster|render|tile|面层|饰面|涂料|抹灰|外"), "finish1").otherwise("structure")
    )
    guess = (
        F.when(text.rlike("paint|coating|涂料|面漆"), 5.0).when(text.rlike("plaster|render|抹灰|砂浆"), 15.0)
        .when(text.rlike("tile|瓷砖|面砖"), 10.0).when(text.rlike("insulation|保温|隔热"), 50.0).otherwise(20.0)
    )
    named = layers.where(F.trim("material") != "").withColumn("function", function).withColumn(
        "_t", F.when(F.col("thickness_mm") > 0, F.col("thickness_mm").cast("double")).otherwise(guess)
    )
    by = [*keys, "wall_id"]
    core = F.col("function") == "structure"
    facts = named.groupBy(*by).agg(
        F.bool_or(core).alias("_has"), F.min(F.struct((-F.col("_t")).alias("t"), F.col("layer_no"))).alias("_thick"),
    )
    rows = named.join(facts, by).withColumn("function", F.when(~F.col("_has") & (F.col("layer_no") == F.col("_thick.layer_no")), "structure").otherwise(F.col("function")))
    at_least_one = F.greatest(F.lit(1.0), F.col("_t"))
    sums = rows.groupBy(*by).agg(
        F.sum(F.when(core, at_least_one)).alias("_core"), F.sum(F.when(~core, at_least_one)).alias("_rest"), F.sum(at_least_one).alias("_all")
    )
    target = F.when(F.col("wall_thickness_mm") > 0, F.col("wall_thickness_mm").cast("double")).otherwise(F.col("_all"))
    rows = rows.join(sums, by).join(walls.select(*keys, F.col("id").alias("wall_id"), F.col("thickness_mm").alias("wall_thickness_mm")), by, "left")
    left = F.greatest(F.lit(1.0), target - F.coalesce("_rest", F.lit(0.0)))
    return rows.select(*by, "layer_no", "material", "role", "function", F.round(F.when(core, F.greatest(F.lit(1.0), left * at_least_one / F.col("_core"))).otherwise(at_least_one), 3).alias("thickness_mm"))


def inherited_layers(parapets: DataFrame, layers: DataFrame, keys: Keys) -> DataFrame:
    """Layers of a parapet taken from its source wall, scaled to the parapet's thickness."""
    total = layers.groupBy(*keys, "wall_id").agg(F.sum(F.when(F.col("thickness_mm") > 0, F.col("thickness_mm"))).alias("_t"))
    source = parapets.select(*keys, F.col("id").alias("parapet_id"), F.col("source_wall_id").alias("wall_id"), F.col("thickness_mm").alias("_target"))
    rows = source.join(layers, [*keys, "wall_id"]).join(total, [*keys, "wall_id"])
    width = F.when(F.col("thickness_mm") > 0, F.col("thickness_mm") * F.when(F.col("_t") > 1e-9, F.col("_target") / F.col("_t")).otherwise(1.0)).otherwise(0.0)
    return rows.select(*keys, "parapet_id", "wall_id", "layer_no", "material", F.round(width, 3).alias("thickness_mm"))


def superseded_walls(walls: DataFrame, parapets: DataFrame, keys: Keys) -> DataFrame:
    """Walls that a parapet drawn from them replaces on the same roof edge."""
    pairs = parapets.select(*keys, F.col("source_wall_id").alias("id"), *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2", "thickness_mm", "level")]).join(walls, [*keys, "id"])
    wl, pl = g.length("x1", "y1", "x2", "y2"), g.length("p_x1", "p_y1", "p_x2", "p_y2")
    wdx, wdy, pdx, pdy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("p_x2") - F.col("p_x1"), F.col("p_y2") - F.col("p_y1")

    def along(x, y):
        return ((F.col(x) - F.col("p_x1")) * pdx + (F.col(y) - F.col("p_y1")) * pdy) / pl

    a, b = along("x1", "y1"), along("x2", "y2")
    shared = F.greatest(F.lit(0.0), F.least(F.greatest(a, b), pl) - F.greatest(F.least(a, b), F.lit(0.0)))
    offset = F.abs((F.col("x1") - F.col("p_x1")) * pdy - (F.col("y1") - F.col("p_y1")) * pdx) / pl
    reach = F.greatest(F.lit(500.0), F.coalesce("thickness_mm", F.lit(200)) + F.coalesce("p_thickness_mm", F.lit(200)))
    level = (F.coalesce("level", F.lit("")) == "") | (F.coalesce("p_level", F.lit("")) == "") | (F.lower("level") == F.lower("p_level"))
    same = (wl > 1) & (pl > 1) & (F.abs(wdx * pdy - wdy * pdx) / (wl * pl) <= 0.05233595624294383) & (offset <= reach) & (shared / F.least(wl, pl) >= 0.8) & level
    return pairs.where(same).select(*keys, "id").distinct()


def placed_on_hosts(openings: DataFrame, walls: DataFrame, keys: Keys) -> DataFrame:
    """Opening points moved onto the host wall, clear of its ends by 5 % or 200 mm."""
    rows = openings.join(walls.select(*keys, F.col("id").alias("host_wall_id"), *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")]), [*keys, "host_wall_id"], "left")
    size = g.length("_x1", "_y1", "_x2", "_y2")
    margin = F.when(size > 2, F.least(F.lit(200.0), size * 0.05) / size).otherwise(0.0)
    t = F.greatest(margin, F.least(1.0 - margin, g.share_along("x", "y", "_x1", "_y1", "_x2", "_y2")))
    usable = size > 1
    return rows.select(
        *[c for c in openings.columns if c not in ("x", "y")],
        F.when(usable, F.round(F.col("_x1") + (F.col("_x2") - F.col("_x1")) * t, 3)).otherwise(F.col("x")).alias("x"),
        F.when(usable, F.round(F.col("_y1") + (F.col("_y2") - F.col("_y1")) * t, 3)).otherwise(F.col("y")).alias("y"),
    )


def slab_offset(elevation, level_elevation) -> Column:
    """Offset of a slab from its level; large values count as absolute heights if that makes them small."""
    e, base = g.col(elevation), F.coalesce(g.col(level_elevation), F.lit(0.0))
    return F.when(e.isNull(), 0.0).when(F.abs(e) <= 1000, e).when(F.abs(e - base) <= 1000, e - base).otherwise(e)


def window_offsets(windows: DataFrame, levels: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """Sill as an offset from the level: absolute values from elevations are moved to their level.

    ``windows``: keys, ``id``, ``level``, ``sill_mm``, ``height_mm``, ``from_elevation``. ``levels``: keys, ``name``, ``elevation_mm``.
    """
    from pyspark.sql import Window

    line = Window.partitionBy(*keys).orderBy("elevation_mm")
    storeys = levels.groupBy(*keys, "elevation_mm").agg(F.min("name").alias("_any")).withColumn("_next", F.lead("elevation_mm").over(line)).drop("_any")
    named = levels.select(*keys, F.col("name").alias("level"), F.col("elevation_mm").alias("_base")).join(
        storeys.select(*keys, F.col("elevation_mm").alias("_base"), (F.col("_next") - F.col("elevation_mm")).alias("_storey")), [*keys, "_base"], "left"
    )
    rows = windows.join(named, [*keys, "level"], "left")
    # Highest level at or below an absolute sill: only rows that may need it take part, on a grid of 10 m.
    ask = rows.where(F.col("from_elevation") & (F.col("sill_mm") + F.col("height_mm") > F.col("_storey") + 1)).select(*keys, "sill_mm").distinct()
    spans = storeys.select(*keys, F.col("elevation_mm").alias("_lo"), (F.coalesce("_next", F.lit(1e9)) - 1).alias("_hi"))
    below = ask.join(spans, list(keys)).where((F.col("_lo") <= F.col("sill_mm") + 1) & (F.col("sill_mm") < F.col("_hi"))).groupBy(*keys, "sill_mm").agg(F.max("_lo").alias("_floor"))
    rows = rows.join(below, [*keys, "sill_mm"], "left")
    relative = F.col("sill_mm") - F.col("_floor")
    high = F.col("from_elevation") & (F.col("sill_mm") + F.col("height_mm") > F.col("_storey") + 1)
    rebased = F.when(high, F.when(relative + F.col("height_mm") <= F.col("_storey") + 1, relative).otherwise(F.col("sill_mm"))).when(
        (F.col("_base") > 0) & (F.col("sill_mm") >= F.col("_base") - 1), F.col("sill_mm") - F.col("_base")
    ).otherwise(F.col("sill_mm"))
    offset = F.round(rebased, 3)
    ready = F.col("_base").isNotNull() & offset.isNotNull() & F.col("height_mm").isNotNull()
    return rows.select(
        *[c for c in windows.columns if c != "sill_mm"], offset.alias("sill_mm"), F.when(offset != F.col("sill_mm"), F.col("sill_mm")).alias("original_sill_mm"),
        F.round(F.col("_base") + rebased, 3).alias("bottom_elevation_mm"), F.round(F.col("_base") + rebased + F.col("height_mm"), 3).alias("top_elevation_mm"),
        F.when(ready, "ready").otherwise("needs_review").alias("binding_status"),
    )


def stair_segments(stairs: DataFrame, levels: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """One row per storey of a stair that spans several, with equal shares of rise, risers and treads.

    ``stairs``: keys, ``id``, ``span``, ``total_rise_mm``, ``risers``, ``treads``, ``run_count``, ``tread_mm``, ``landing_mm``. ``levels``: keys,
    ``level_id``, ``number``. A span needs one more numbered level than it has storeys.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("number", "level_id")
    placed = levels.where("number is not null").withColumn("_n", F.row_number().over(order))
    known = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_levels"))
    rows = stairs.join(known, list(keys), "left")
    parts = F.when((F.col("span") > 1) & (F.col("_levels") >= F.col("span") + 1), F.col("span")).otherwise(1).cast("int")
    rows = rows.withColumn("_parts", parts).withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("_parts"))))
    low = placed.select(*keys, F.col("_n").alias("segment"), F.col("level_id").alias("start_level"))
    high = placed.select(*keys, (F.col("_n") - 1).alias("segment"), F.col("level_id").alias("end_level"))
    cut = F.col("_parts") > 1
    rows = rows.join(low, [*keys, "segment"], "left").join(high, [*keys, "segment"], "left")
    risers = F.when(cut, F.bround(F.col("risers") / F.col("_parts"))).otherwise(F.col("risers")).cast("bigint")
    treads = F.when(cut, F.bround(F.col("treads") / F.col("_parts"))).otherwise(F.col("treads")).cast("bigint")
    per_run = F.bround(treads / F.col("run_count")).cast("bigint")
    return rows.select(
        *keys, "id", "segment", F.when(cut, F.format_string("%s-SEG%02d", F.col("id").cast("string"), F.col("segment"))).alias("segment_id"),
        F.when(cut, F.col("start_level")).alias("start_level"), F.when(cut, F.col("end_level")).alias("end_level"),
        F.round(F.col("total_rise_mm") / F.col("_parts"), 3).alias("total_rise_mm"), risers.alias("risers"), treads.alias("treads"),
        (F.col("tread_mm") * per_run).alias("run_length_mm"), F.round(F.col("tread_mm") * per_run * F.col("run_count") + F.coalesce("landing_mm", F.lit(0)), 3).alias("total_run_mm"),
    )


def stair_target_floors(stairs: DataFrame, floors: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """Floors that a stair's opening cuts: its own host, else the storeys above its start up to its end, else its span above the lowest floor.

    ``stairs``: keys, ``id``, ``host_floor_id``, ``start_number``, ``end_number``, ``span``. ``floors``: keys, ``floor_id``, ``number``. Levels become join keys,
    so a stair meets only the floors it cuts. A stair without any keeps one row without a floor.
    """
    lowest = floors.groupBy(*keys).agg(F.min("number").alias("_low"))
    rows = stairs.join(lowest, list(keys), "left")
    host = F.coalesce(F.col("host_floor_id").cast("string"), F.lit("")) != ""
    ranged = F.coalesce(F.col("end_number") > F.col("start_number"), F.lit(False))
    levels = F.when(host, F.array().cast("array<int>")).when(ranged, F.sequence(F.col("start_number").cast("int") + 1, F.col("end_number").cast("int"))).when(
        (F.col("span") > 1) & F.col("_low").isNotNull(), F.sequence(F.col("_low").cast("int") + 1, F.col("_low").cast("int") + F.col("span").cast("int"))).otherwise(F.array().cast("array<int>"))
    asked = rows.select(*keys, "id", F.explode(levels).alias("number"))
    cut = asked.join(floors, [*keys, "number"]).select(*keys, "id", "floor_id", F.lit(True).alias("projected"))
    own = stairs.where(F.coalesce(F.col("host_floor_id").cast("string"), F.lit("")) != "").select(*keys, "id", F.col("host_floor_id").alias("floor_id")).join(
        floors.select(*keys, "floor_id").distinct(), [*keys, "floor_id"], "left_semi").select(*keys, "id", "floor_id", F.lit(False).alias("projected"))
    found = cut.unionByName(own)
    return stairs.select(*keys, "id").join(found, [*keys, "id"], "left").withColumn("needs_mapping", F.col("floor_id").isNull())
