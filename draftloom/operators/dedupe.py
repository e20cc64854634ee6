"""Ordered de-duplication of frames, columns, openings, rectangles, railings, walls, voids, slabs, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom.functions import values as v
from draftloom.functions import geometry as g
from draftloom.operators.matching import point_box
from draftloom.operators.ordered import first_wins, suppress, suppress_crowded
from draftloom.operators.spatial import Keys, box_join, parallel_join, sane_box
from draftloom.operators.walls import BOX, DRAWING, _boxed
from draftloom.session import checkpoint


def _edges(pairs: DataFrame, keys: Keys) -> DataFrame:
    return pairs.select(*keys, F.col("a_id").alias("early"), F.col("b_id").alias("late"))


def _earlier() -> Column:
    return F.col("a_ord") < F.col("b_ord")


def frame_boxes(polygons: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Sheet frames from closed polygons: at least 1000 wide and high, filling 82 % of their box."""
    box = g.bounding_box("points")
    rows = polygons.where(F.col("closed") & (F.size("points") >= 4)).withColumn("_b", box)
    for name in ("x0", "y0", "x1", "y1"):
        rows = rows.withColumn(name, F.round(f"_b.{name}", 3))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return rows.where((w >= 1000) & (h >= 1000) & (g.polygon_area("points") / (w * h) >= 0.82)).drop("_b")


def _distinct_boxes(boxes: DataFrame, keys: Keys, margin: float, same: Column) -> DataFrame:
    """Largest boxes first; one for which ``same`` holds with a kept one falls.

    Cells are twice as wide as a drawing's boxes usually are (their root mean square, so that the cells boxes touch stay in proportion to the boxes).
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    box = ("x0", "y0", "x1", "y1")
    # Written once: it is met in every step.
    boxes = checkpoint(boxes)
    rows = boxes.withColumn("_first", F.col("ord")).withColumn("ord", F.struct((-area).alias("a"), F.col("_first").alias("o")))
    w, h = ((F.col(b).cast("double") - F.col(a)) for a, b in (("x0", "x1"), ("y0", "y1")))
    usual = boxes.where(sane_box(box)).groupBy(*keys).agg(F.greatest(2 * F.sqrt(F.avg(w * w + h * h)), F.lit(max(4 * margin, 100.0))).alias("_cell"))
    cell = F.col("_cell")
    # Boxes without a place conflict with none.
    known = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    placed = rows.where(sane_box(box) & known).join(usual, list(keys))
    placed = placed.withColumn("_px", F.floor((F.col("x0") + F.col("x1")) / cell * 4)).withColumn("_py", F.floor((F.col("y0") + F.col("y1")) / cell * 4))

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        met = box_join(a, b, [*keys, "_cell"], box, box, cell, margin=margin, condition=_earlier() & same)
        return _edges(met, keys)

    settled = suppress_crowded(placed, keys, ["_px", "_py"], pairs).where("not kept").select(*keys, "id", "duplicate_of").distinct()
    return rows.join(settled, [*keys, "id"], "left").withColumn("kept", F.col("duplicate_of").isNull()).withColumn("ord", F.col("_first")).select(*boxes.columns, "kept", "duplicate_of")


def distinct_frames(frames: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Largest frames first; one that shares over 92 % of the smaller box with a kept one falls.

    ``frames``: keys, ``id``, ``ord``, x0, y0, x1, y1.
    """
    return _distinct_boxes(frames, keys, 0.0, g.box_overlap_share("a_", "b_") > 0.92)


def numbered_frames(frames: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Frame ids from top to bottom, left to right."""
    from draftloom.operators.ordered import number_rows

    rows = number_rows(frames, keys, [F.col("y1").desc(), F.col("x0"), F.col("ord")], F.floor(-F.col("y1") / 100000), "_n")
    return rows.withColumn("frame_id", F.concat(F.lit("F"), v.padded(F.col("_n"), 3))).drop("_n")


def in_frames(entities: DataFrame, frames: DataFrame, keys: Keys = DRAWING, margin: float = 0.0, cell: float = 20000.0) -> DataFrame:
    """Entities whose point lies in a frame, once per frame. Frames' own layers are left out before."""
    box = ("x0", "y0", "x1", "y1")
    inside = box_join(point_box(entities), frames, keys, BOX, box, cell, margin=margin)
    keep = [F.col(f"a_{c}").alias(c) for c in entities.columns if c not in keys]
    return inside.select(*keys, *keep, F.col("b_frame_id").alias("frame_id"))


def valid_column(width: Column, depth: Column) -> Column:
    short, long = F.least(width, depth), F.greatest(width, depth)
    return short.between(100, 1500) & long.between(100, 1500) & (long / short <= 4)


def valid_void(width: Column, depth: Column) -> Column:
    return (F.least(width, depth) >= 150) & (F.greatest(width, depth) <= 12000)


def distinct_columns(columns: DataFrame, keys: Keys = DRAWING, cell: float = 500.0) -> DataFrame:
    """Columns of one shape within 20 mm of a kept one and of its size (20 mm) fall.

    ``columns``: keys, ``id``, ``ord``, ``x``, ``y``, ``shape``, ``size``.
    """
    rows = point_box(columns)
    near = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")) <= 20
    pairs = box_join(rows, rows, [*keys, "shape"], BOX, BOX, cell, margin=20.0, condition=_earlier() & near & (F.abs(F.col("a_size") - F.col("b_size")) <= 20))
    return suppress(columns, _edges(pairs, keys), keys)


def opening_reach(width, minimum=450.0) -> Column:
    """Distance within which a second opening counts as the same."""
    return F.greatest(F.lit(float(minimum)), F.least(F.lit(1200.0), F.coalesce(g.col(width), F.lit(0.0)) * 0.65))


def distinct_openings(found: DataFrame, placed: DataFrame | None, keys: Keys = DRAWING, minimum: float = 450.0, cell: float = 1200.0, rivals: DataFrame | None = None) -> DataFrame:
    """Openings of one recognition stage that are not near an earlier one.

    ``found``: keys, ``id``, ``ord``, ``x``, ``y``, ``width``; ``placed`` holds the results of earlier stages, which stay.
    ``rivals`` (keys, ``early``, ``late``) names further rows of which only one can stand, such as pairs with a part in common.
    """
    near = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")) <= F.greatest(opening_reach("b_width", minimum), F.least(F.lit(1200.0), F.coalesce("a_width", F.lit(0.0)) * 0.65))
    rows = found
    if placed is not None:
        taken = box_join(point_box(placed), point_box(rows), keys, BOX, BOX, cell, margin=1200.0, condition=near)
        rows = rows.join(taken.select(*keys, F.col("b_id").alias("id")).distinct(), [*keys, "id"], "left_anti")
    pairs = box_join(point_box(rows), point_box(rows), keys, BOX, BOX, cell, margin=1200.0, condition=_earlier() & near)
    edges = _edges(pairs, keys)
    return suppress(rows, edges if rivals is None else edges.unionByName(rivals), keys)


def distinct_rectangles(rects: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Largest rectangles first; one nested with a kept one, or centred within 160 of it, falls.

    ``rects``: keys, ``id``, ``ord``, x0, y0, x1, y1.
    """
    def mid(p, a, b):
        return (F.col(f"{p}{a}") + F.col(f"{p}{b}")) / 2

    close = F.hypot(mid("a_", "x0", "x1") - mid("b_", "x0", "x1"), mid("a_", "y0", "y1") - mid("b_", "y0", "y1")) <= 160
    same = close | g.box_contains("a_", "b_") | g.box_contains("b_", "a_")
    return _distinct_boxes(rects, keys, 160.0, same)


def overlap_share() -> Column:
    """Shared stretch over the shorter of two lines (at least 1 mm), seen along the first."""
    span = g.span_along("a_", "b_")
    return F.greatest(F.lit(0.0), span["hi"] - span["lo"]) / F.greatest(F.lit(1.0), F.least(F.col("a_len"), F.col("b_len")))


def distinct_railings(railings: DataFrame, keys: Keys = DRAWING, cell: float = 2000.0) -> DataFrame:
    """Railings parallel to a kept one, less than 50 apart and 85 % side by side, fall.

    ``railings``: keys, ``id``, ``ord``, x1, y1, x2, y2.
    """
    r = _boxed(g.with_measures(railings))
    parallel = F.abs(g.dot("a_ux", "a_uy", "b_ux", "b_uy")) >= 0.98
    # The distance is measured from the later line, as the later one is the one tested.
    span = g.span_along("b_", "a_")
    share = F.greatest(F.lit(0.0), span["hi"] - span["lo"]) / F.greatest(F.lit(1.0), F.least(F.col("a_len"), F.col("b_len")))
    pairs = box_join(r, r, keys, BOX, BOX, cell, margin=1000.0, condition=_earlier() & parallel & (F.abs(g.signed_offset("b_", "a_")) < 50) & (share >= 0.85))
    return suppress(railings, _edges(pairs, keys), keys)


def share_position() -> Column:
    """Two walls of a level lie on one line (0.99985, 20 mm) and the shorter lies on the longer (98 %)."""
    span = g.span_along("a_", "b_")
    far = F.greatest(F.abs(g.signed_offset("a_", "b_")), F.abs(g.cross("a_ux", "a_uy", F.col("b_x2") - F.col("a_x1"), F.col("b_y2") - F.col("a_y1"))))
    shared = F.greatest(F.lit(0.0), span["hi"] - span["lo"])
    level = (F.col("a_lv") == "") | (F.col("b_lv") == "") | (F.col("a_lv") == F.col("b_lv"))
    return (
        (F.col("a_len") > 1) & (F.col("b_len") > 1) & level & (F.abs(g.dot("a_ux", "a_uy", "b_ux", "b_uy")) >= 0.99985) & (far <= 20)
        & (shared >= F.least(F.col("a_len"), F.col("b_len")) * 0.98 - 20)
    )


def same_floor() -> Column:
    """Walls of different drawings may only be merged where their floor is known, equal and not under review."""
    da, db = (F.trim(F.coalesce(c, F.lit(""))) for c in ("a_drawing_id", "b_drawing_id"))
    fa, fb = (F.trim(F.coalesce(c, F.lit(""))) for c in ("a_floor_number", "b_floor_number"))
    clear = ~F.lower(F.coalesce("a_floor_status", F.lit(""))).contains("review") & ~F.lower(F.coalesce("b_floor_status", F.lit(""))).contains("review")
    return (da == "") | (db == "") | (da == db) | ((fa != "") & (fa == fb) & clear)


def recheck_walls(walls: DataFrame, keys: Keys = ("project_id",), cell: float = 5000.0) -> DataFrame:
    """Walls drawn twice at one place: the longest and best described stays.

    ``walls``: keys, ``id``, ``level``, ``drawing_id``, ``drawing_type``, ``floor_number``, ``floor_status``, x1, y1, x2, y2, ``thickness_mm``, ``material``,
    ``height_mm``, ``review_status``, ``confidence``. Adds ``kept``, ``duplicate_of``, ``conflicts`` (with the kept wall), ``blocked_by``: a wall of another
    drawing at the same place whose floor identity is open blocks both (the first of them in order of preference is named).
    """
    described = (F.coalesce("thickness_mm", F.lit(0)) != 0).cast("int") + (F.coalesce("material", F.lit("")) != "").cast("int") + (F.coalesce("height_mm", F.lit(0)) != 0).cast("int")
    view = F.when(F.col("drawing_type") == "floor_plan", 3).when(F.coalesce("drawing_type", F.lit("")) == "", 2).otherwise(1)
    ready = F.coalesce(F.col("review_status").isin("ready", "confirmed"), F.lit(False)).cast("int")
    w = g.with_measures(walls).withColumn("lv", F.lower(F.trim(F.coalesce("level", F.lit("")))))
    w = w.withColumn("ord", F.struct((-F.round("len", 6)).alias("l"), (-described).alias("p"), (-view).alias("v"), (-ready).alias("r"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("id").alias("i")))
    nodes = w.select(*keys, "id", "ord")
    place = [*keys, "id", "ord", "lv", "drawing_id", "floor_number", "floor_status", "x1", "y1", "x2", "y2", "len", "ux", "uy", "thickness_mm", "material"]
    w = w.select(*place).where("len > 1")
    # Walls of one level meet under its name. A wall without a level meets all others, under one of two names of its own.
    level, open_level = F.concat(F.lit("="), F.col("lv")), F.col("lv") == ""
    a = w.withColumn("_meet", F.explode(F.when(open_level, F.array(F.lit("a"))).otherwise(F.array(level, F.lit("b")))))
    b = w.withColumn("_meet", F.explode(F.when(open_level, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(level, F.lit("a")))))
    # Written once: three tables are made from it.
    pairs = checkpoint(parallel_join(a, b, [*keys, "_meet"], along=cell, across=200.0, margin=25.0, tolerance=1.1, condition=_earlier() & share_position(), sector=2.25, crowd=walls.select(*keys)))
    merged = pairs.where(same_floor())
    result = suppress(nodes, _edges(merged, keys), keys)
    differ = F.concat_ws(
        ", ", F.when(F.abs(F.col("a_thickness_mm") - F.col("b_thickness_mm")) > 5, "thickness"),
        F.when((F.lower(F.trim("a_material")) != F.lower(F.trim("b_material"))) & (F.trim("a_material") != "") & (F.trim("b_material") != ""), "material"),
    )
    conflicts = merged.select(*keys, F.col("b_id").alias("id"), F.col("a_id").alias("duplicate_of"), differ.alias("conflicts"))
    kept = result.where("kept").select(*keys, "id")
    open_pairs = pairs.where(~same_floor() & (F.trim("a_drawing_id") != "") & (F.trim("b_drawing_id") != ""))
    sides = open_pairs.select(*keys, F.col("a_id").alias("id"), F.col("b_id").alias("_other"), F.col("b_ord").alias("_oo")).unionByName(
        open_pairs.select(*keys, F.col("b_id").alias("id"), F.col("a_id").alias("_other"), F.col("a_ord").alias("_oo")))
    sides = sides.join(kept, [*keys, "id"], "left_semi").join(kept.withColumnRenamed("id", "_other"), [*keys, "_other"], "left_semi")
    blocked = sides.groupBy(*keys, "id").agg(F.min(F.struct("_oo", "_other")).alias("_b")).select(*keys, "id", F.col("_b._other").alias("blocked_by"))
    return walls.join(result.select(*keys, "id", "kept", "duplicate_of"), [*keys, "id"]).join(conflicts, [*keys, "id", "duplicate_of"], "left").join(blocked, [*keys, "id"], "left").select(
        *walls.columns, "kept", "duplicate_of", "conflicts", "blocked_by"
    )


def best_per_key(rows: DataFrame, keys: Keys, order: list[Column]) -> DataFrame:
    """All rows with the winner of their key in ``duplicate_of`` (NULL for the winner itself)."""
    best = first_wins(rows.select(*keys, "id", *[c.alias(f"_k{i}") for i, c in enumerate(order)]), keys, [F.col(f"_k{i}") for i in range(len(order))] + [F.col("id")])
    named = best.select(*keys, F.col("id").alias("_win"))
    return rows.join(named, list(keys)).withColumn("duplicate_of", F.when(F.col("id") != F.col("_win"), F.col("_win"))).drop("_win")


def distinct_grids(grids: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """One grid per name (or, without a name, per rounded line): plan drawings first, then ready, then sure."""
    def grid(c):
        return (F.bround(F.col(c) / 10) * 10).cast("bigint").cast("string")

    name = F.upper(F.trim(F.coalesce("name", F.lit(""))))
    key = F.when(name != "", F.concat(F.lit("grid_name:"), name)).otherwise(F.concat(F.lit("grid_geometry:"), F.concat_ws(",", grid("x1"), grid("y1"), grid("x2"), grid("y2"))))
    view = F.when(F.col("drawing_type") == "floor_plan", 0).when(F.coalesce("drawing_type", F.lit("")) == "", 1).otherwise(2)
    ready = F.when(F.col("review_status").isin("ready", "confirmed"), 0).otherwise(1)
    return best_per_key(grids.withColumn("_key", key), [*keys, "_key"], [view, ready, -F.coalesce("confidence", F.lit(0.0))]).drop("_key")


def boundary_key(points) -> Column:
    """Corners to 0.1 mm, sorted; NULL below three corners."""
    key = F.array_sort(F.transform(g.col(points), lambda p: F.struct(F.round(p["x"], 1).alias("x"), F.round(p["y"], 1).alias("y"))))
    return F.when(F.size(g.col(points)) >= 3, key)


def distinct_slabs(slabs: DataFrame, voids: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """One slab per level, role and outline: hosts of voids first, then sure, then the highest id."""
    hosts = voids.select(*keys, F.col("host_floor_id").alias("id")).distinct().withColumn("_host", F.lit(0))
    rows = slabs.join(hosts, [*keys, "id"], "left").withColumn("_key", F.coalesce(boundary_key("boundary").cast("string"), F.concat(F.lit("#"), F.col("id").cast("string"))))
    best = rows.groupBy(*keys, "level", "role", "_key").agg(F.max(F.struct((1 - F.coalesce("_host", F.lit(1))).alias("h"), F.coalesce("confidence", F.lit(0.0)).alias("c"), F.col("id").alias("i"))).alias("_b"))
    return rows.join(best, [*keys, "level", "role", "_key"]).withColumn("duplicate_of", F.when(F.col("id") != F.col("_b.i"), F.col("_b.i"))).select(*slabs.columns, "duplicate_of")


def distinct_voids(voids: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """One void per drawing, level, source, domain and outline, the first; its gaps are filled from the others."""
    key = F.coalesce(boundary_key("boundary").cast("string"), F.concat(F.lit("#"), F.col("id").cast("string")))
    by = [*keys, "drawing_id", "level", "source", "domain", "_key"]
    rows = voids.withColumn("_key", key)
    fill = [c for c in ("host_floor_id", "semantic", "related_stair_id") if c in voids.columns]
    best = rows.groupBy(*by).agg(
        F.min(F.struct("ord", "id")).alias("_b"), *[F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("ord", F.col(c).alias("v")))).alias(f"_{c}") for c in fill]
    )
    out = rows.join(best, by).withColumn("duplicate_of", F.when(F.col("id") != F.col("_b.id"), F.col("_b.id")))
    for c in fill:
        out = out.withColumn(c, F.coalesce(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)), F.col(f"_{c}.v")))
    return out.select(*voids.columns, "duplicate_of")
