"""Walls: pairing of parallel lines, piers, de-duplication, runs, hosts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom.functions import values as v
from draftloom.functions import geometry as g
from draftloom.operators.ordered import first_wins, number_rows
from draftloom.operators.spatial import Keys, box_join, by_crowd, islands, nearest, parallel_join, prefixed, sane, wider_rings, with_line_cells
from draftloom.session import checkpoint

DRAWING = ("project_id", "drawing_id")

# Pairing limits in millimetres.
MIN_WIDTH, MAX_WIDTH = 60, 500
NORMAL_OVERLAP, SHORT_OVERLAP, PIER_OVERLAP = 500, 120, 80
SMALL_BLOCK = 500.0


def unique_segments(segments: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """First segment per layer and rounded, unordered pair of ends. Needs ``ord``."""
    a = F.struct(F.round("x1", 3).alias("x"), F.round("y1", 3).alias("y"))
    b = F.struct(F.round("x2", 3).alias("x"), F.round("y2", 3).alias("y"))
    cut = segments.withColumn("_layer", F.lower("layer")).withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b))
    return first_wins(cut, [*keys, "_layer", "_a", "_b"], [F.col("ord")]).drop("_layer", "_a", "_b")


def _boxed(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("bx0", F.least("x1", "x2")).withColumn("by0", F.least("y1", "y2"))
        .withColumn("bx1", F.greatest("x1", "x2")).withColumn("by1", F.greatest("y1", "y2"))
    )


BOX = ("bx0", "by0", "bx1", "by1")
LINE = ("x1", "y1", "x2", "y2")


def pair_lines(segments: DataFrame, keys: Keys = DRAWING, cell: float = 4000.0, crowd: DataFrame | None = None) -> DataFrame:
    """Every pair of parallel lines a wall thickness apart that run side by side.

    Input: keys, ``id``, ``ord``, ``layer``, x1, y1, x2, y2; ``crowd``: the same lines or more, cheaper to count. Output per pair: both ids and
    layers, the middle line, ``raw_width``, ``len``.
    """
    lines = segments
    for name in ("x1", "y1", "x2", "y2"):
        lines = lines.withColumn(name, F.col(name).cast("double"))
    lines = g.with_measures(lines).where(F.col("len") >= PIER_OVERLAP)
    wanted = ["id", "ord", "layer", "x1", "y1", "x2", "y2", "len", "ux", "uy"]
    width = F.abs(g.signed_offset("a_", "b_"))
    span = g.span_along("a_", "b_")
    pairs = parallel_join(
        lines.select(*keys, *wanted), lines.select(*keys, *wanted), keys, along=cell, across=1200.0, margin=MAX_WIDTH * 1.1, tolerance=2.1,
        condition=(F.col("a_ord") < F.col("b_ord")) & g.is_parallel("a_", "b_")
        & width.between(MIN_WIDTH, MAX_WIDTH) & (span["hi"] - span["lo"] >= PIER_OVERLAP),
        crowd=(segments if crowd is None else crowd).select(*keys),
    )
    line = g.center_line("a_", "b_")
    return pairs.select(
        *keys, "a_id", "b_id", "a_ord", "b_ord", F.array_sort(F.array_distinct(F.array("a_layer", "b_layer"))).alias("source_layers"),
        line.alias("_l"), width.alias("raw_width"), (span["hi"] - span["lo"]).alias("len"),
    ).select("*", "_l.*").drop("_l")


def _described(pairs: DataFrame) -> DataFrame:
    """Standard width, status and confidence of paired lines with a ``recognition_source``."""
    standard = g.nearest_standard("raw_width")
    base = F.when(F.col("width_status") == "nonstandard", 0.75).otherwise(0.95)
    return (
        pairs.withColumn("normalized_width", standard["value"])
        .withColumn("width_status", g.width_status(standard))
        .withColumn(
            "confidence",
            F.round(F.when(F.col("recognition_source") == "paired_wall_lines", base).otherwise(F.greatest(F.lit(0.62), base - 0.12)), 3),
        )
    )


def wall_candidates(segments: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Paired lines, with the normal / short / pier class in ``recognition_source``."""
    source = (
        F.when(F.col("len") >= NORMAL_OVERLAP, "paired_wall_lines")
        .when(F.col("len") >= SHORT_OVERLAP, "short_paired_wall_lines")
        .otherwise("t_pier_wall_lines")
    )
    return _described(pair_lines(unique_segments(segments, keys), keys, crowd=segments).withColumn("recognition_source", source))


def keep_piers(candidates: DataFrame, keys: Keys = DRAWING, cell: float = 2000.0) -> DataFrame:
    """Normal and short walls, and of the piers those that end at a wall across them."""
    # Read three times below; written once so that the pair join runs once.
    candidates = checkpoint(candidates)
    sure = candidates.where("recognition_source <> 't_pier_wall_lines'")
    pier = candidates.where("recognition_source = 't_pier_wall_lines'")
    shape = ["a_ord", "b_ord", "x1", "y1", "x2", "y2", "len", "ux", "uy", "raw_width", "normalized_width", *BOX]
    left = _boxed(g.with_measures(pier)).select(*keys, *shape)
    right = _boxed(g.with_measures(sure)).select(*keys, *shape)
    reach = F.greatest(F.lit(90.0), F.col("a_raw_width") / 2 + F.col("b_normalized_width") / 2 + 40)
    host = ("b_x1", "b_y1", "b_x2", "b_y2")
    touching = (
        (g.point_segment_distance("a_x1", "a_y1", *host) <= reach) | (g.point_segment_distance("a_x2", "a_y2", *host) <= reach)
    )
    across = F.abs(g.dot("a_ux", "a_uy", "b_ux", "b_uy")) <= 0.25
    held = box_join(left, right, keys, BOX, BOX, cell, margin=MAX_WIDTH + 40.0, condition=across & touching, crowd=sure).select(
        *keys, F.col("a_a_ord").alias("a_ord"), F.col("a_b_ord").alias("b_ord")
    )
    return sure.unionByName(pier.join(held, [*keys, "a_ord", "b_ord"], "left_semi"))


def distinct_walls(walls: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """First wall per rounded, unordered ends and width; later copies are dropped."""
    a = F.struct(F.round("x1", 3).alias("x"), F.round("y1", 3).alias("y"))
    b = F.struct(F.round("x2", 3).alias("x"), F.round("y2", 3).alias("y"))
    cut = walls.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b)).withColumn("_w", F.round("normalized_width", 1))
    rank = [F.when(F.col("recognition_source") == "t_pier_wall_lines", 1).otherwise(0), F.col("a_ord"), F.col("b_ord")]
    return first_wins(cut, [*keys, "_a", "_b", "_w"], rank).drop("_a", "_b", "_w")


def small_block_scores(walls: DataFrame, keys: Keys = DRAWING, cell: float = 2000.0) -> DataFrame:
    """For short, squat walls: how well long walls nearby continue them in their own direction."""
    sized = _boxed(g.with_measures(walls)).withColumn("ori", g.orientation("x1", "y1", "x2", "y2", 5)).where("ori <> 'OTHER'")
    sized = sized.withColumn("_big", F.greatest("len", "normalized_width") > SMALL_BLOCK)
    wanted = ["id", "len", "ori", "x1", "y1", "x2", "y2", "mx", "my", "normalized_width", *BOX]
    small = sized.where("not _big").select(*keys, *wanted)
    big = sized.where("_big").select(*keys, *wanted)
    level = F.when(F.col("ori") == "H", F.abs(F.col("a_my") - F.col("b_my"))).otherwise(F.abs(F.col("a_mx") - F.col("b_mx")))
    reach = F.greatest(F.lit(120.0), (F.col("a_normalized_width") + F.col("b_normalized_width")) / 2.0 + 80.0)
    space = F.when(F.col("ori") == "H", g.gap("a_x1", "a_x2", "b_x1", "b_x2")).otherwise(g.gap("a_y1", "a_y2", "b_y1", "b_y2"))
    pairs = box_join(small, big, [*keys, "ori"], BOX, BOX, cell, margin=1500.0, condition=(level <= reach) & (space <= 1500), crowd=big)
    bonus = 1.0 + F.least(F.col("b_len") / 5000.0, F.lit(1.0)) + F.greatest(F.lit(0.0), (1500.0 - space) / 1500.0)
    return pairs.groupBy(*keys, F.col("a_id").alias("id")).agg(F.round(F.sum(bonus), 6).alias("score"))


def distinct_blocks(walls: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Of small wall bodies drawn twice, once each way, keep the one that long walls continue."""
    # Read five times below; written once so that the pair join runs once.
    walls = checkpoint(walls)
    size = F.greatest("len", "normalized_width")
    small = (size <= SMALL_BLOCK) & (F.col("len") > 0) & (F.col("normalized_width") > 0)
    key = g.body_key("x1", "y1", "x2", "y2", "normalized_width")
    blocks = walls.where(small).withColumn("_key", key)
    scored = blocks.join(small_block_scores(walls, keys), [*keys, "id"], "left").fillna(0.0, ["score"])
    rank = [-F.col("score"), F.when(F.col("len") >= F.col("normalized_width"), 0).otherwise(1), -F.col("confidence"), -F.col("len"), F.col("ord")]
    best = first_wins(scored, [*keys, "_key"], rank).select(*walls.columns)
    return walls.where(~small).unionByName(best)


def recognize_walls(segments: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Wall lines to walls with ids ``W0001`` ... in the order the pairs were found."""
    walls = distinct_walls(keep_piers(wall_candidates(segments, keys), keys), keys)
    walls = walls.withColumn("ord", F.struct(
        F.when(F.col("recognition_source") == "t_pier_wall_lines", 1).otherwise(0).alias("late"), "a_ord", "b_ord"
    )).withColumn("id", F.concat_ws("-", "a_ord", "b_ord"))
    walls = distinct_blocks(walls, keys)
    bucket = F.struct(F.col("ord.late"), F.floor(F.col("a_ord") / 4096))
    walls = number_rows(walls, keys, [F.col("ord")], bucket, "ord_no")
    return walls.withColumn("id", F.concat(F.lit("W"), v.padded(F.col("ord_no"), 4))).withColumn(
        "ord", F.col("ord_no")
    ).drop("ord_no", "a_id", "b_id", "a_ord", "b_ord")


def width_issues(walls: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """One note per wall whose thickness was rounded or is not a standard one."""
    text = F.when(
        F.col("width_status") == "auto_normalized",
        F.format_string("Wall width normalized from %s to %s.", F.col("raw_width").cast("string"), F.col("normalized_width").cast("string")),
    ).otherwise(F.format_string("Wall width %s is not within 6 of a standard width.", F.col("raw_width").cast("string")))
    return walls.where("width_status <> 'standard'").select(
        *keys, F.col("id").alias("object_id"),
        F.when(F.col("width_status") == "nonstandard", "warning").otherwise("info").alias("severity"),
        text.alias("message"), F.col("raw_width").alias("raw_value"), F.col("normalized_width").alias("fixed_value"),
    )


def recognize_parapets(segments: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """The wall operator on lines of parapet layers; every result asks for review."""
    found = recognize_walls(segments, keys)
    return found.select(
        *keys, F.regexp_replace("id", "^W", "PARAPET").alias("id"), "x1", "y1", "x2", "y2", "len",
        F.col("normalized_width").alias("thickness_mm"), "source_layers",
        F.concat(F.lit("dedicated_parapet_layer:"), F.col("recognition_source")).alias("source"), "confidence",
        F.lit(2).alias("source_geometry_count"), F.lit(True).alias("needs_review"),
    )


def run_keys(walls: DataFrame) -> DataFrame:
    """Line of each wall as fixed grid keys: direction to 0.001, offset to 50 mm, thickness to 10 mm.

    Adds ``dx_key``, ``dy_key``, ``off_key``, ``thick_key`` and the place along the line, ``lo`` and ``hi``.
    """
    w = g.with_measures(walls)
    flip = (F.col("ux") < -1e-9) | ((F.abs(F.col("ux")) <= 1e-9) & (F.col("uy") < 0))
    w = w.withColumn("ux", F.when(flip, -F.col("ux")).otherwise(F.col("ux"))).withColumn(
        "uy", F.when(flip, -F.col("uy")).otherwise(F.col("uy"))
    )
    t1, t2 = g.dot("x1", "y1", "ux", "uy"), g.dot("x2", "y2", "ux", "uy")
    return (
        w.withColumn("dx_key", F.round(F.col("ux") * 1000).cast("bigint")).withColumn("dy_key", F.round(F.col("uy") * 1000).cast("bigint"))
        .withColumn("off_key", F.round(g.cross("ux", "uy", "x1", "y1") / 50.0).cast("bigint"))
        .withColumn("thick_key", F.round(F.col("thickness_mm") / 10.0).cast("bigint"))
        .withColumn("lo", F.least(t1, t2)).withColumn("hi", F.greatest(t1, t2))
    )


LINE_KEYS = ("dx_key", "dy_key", "off_key", "thick_key")


def wall_runs(
    walls: DataFrame, openings: DataFrame | None = None, keys: Keys = DRAWING, group: Keys = LINE_KEYS,
    touch: float = 300.0, opening_gap: float = 6000.0, bucket: float = 20000.0,
) -> DataFrame:
    """Join collinear walls into runs across small gaps, or wide gaps that hold an opening.

    ``walls``: keys, ``group`` columns, ``lo``, ``hi`` along the line. ``openings``: keys, group
    columns, ``t`` (place along the line). Returns keys, group, ``run``, ``lo``, ``hi``, ``n``.
    """
    line = [*keys, *group]
    pieces = islands(walls, line, "lo", "hi", touch, bucket)
    if openings is None:
        return pieces
    from pyspark.sql import Window

    order = Window.partitionBy(*line).orderBy("lo", "hi")
    pieces = pieces.withColumn("_gap_lo", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    gaps = pieces.where((F.col("lo") > F.col("_gap_lo")) & (F.col("lo") - F.col("_gap_lo") <= opening_gap)).select(
        *line, "run", "_gap_lo", F.col("lo").alias("_gap_hi")
    )
    # A gap is at most 6 m wide, so it meets few cells of the line.
    spots = openings.select(*line, "t").withColumn("_c", F.floor(F.col("t") / opening_gap).cast("bigint")).distinct()
    cells = F.sequence(F.floor(F.col("_gap_lo") / opening_gap).cast("bigint"), F.floor(F.col("_gap_hi") / opening_gap).cast("bigint"))
    bridged = (
        gaps.withColumn("_c", F.explode(cells)).join(spots, [*line, "_c"])
        .where(F.col("t").between(F.col("_gap_lo"), F.col("_gap_hi"))).select(*line, "run").distinct().withColumn("_bridge", F.lit(True))
    )
    marked = pieces.join(bridged, [*line, "run"], "left")
    starts = F.when(F.col("_bridge"), 0).otherwise(1)
    joined = marked.withColumn("_run", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return joined.groupBy(*line, F.col("_run").alias("run")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def merge_border_runs(runs: DataFrame, keys: Keys = DRAWING, tolerance: float = 50.0, touch: float = 300.0) -> DataFrame:
    """Group ids for runs whose line keys fell either side of a grid border but touch.

    ``runs``: keys, ``id``, x1, y1, x2, y2. Adds ``component``, the smallest id of each group.
    """
    from draftloom.operators.ordered import components

    r = _boxed(g.with_measures(runs))
    near = F.abs(g.signed_offset("a_", "b_")) <= tolerance
    span = g.span_along("a_", "b_")
    pairs = box_join(r, r, keys, BOX, BOX, 5000.0, margin=touch, condition=(F.col("a_id") < F.col("b_id")) & g.is_parallel("a_", "b_", 0.002) & near & (span["lo"] - span["hi"] <= touch))
    return components(runs, pairs.select(*keys, F.col("a_id").alias("u"), F.col("b_id").alias("v")), keys)


def on_runs(openings: DataFrame, runs: DataFrame, keys: Keys, line: Keys, along: float = 500.0, off: float = 900.0, cell: float = 5000.0) -> DataFrame:
    """Openings that lie on a run: at most ``off`` beside it and ``along`` beyond its ends.

    ``openings``: keys, ``opening_id``, ``x``, ``y``; ``runs``: keys, ``line`` id columns, x1, y1, x2, y2.
    Adds ``distance`` (position from the run's start, clamped to its length).
    """
    r = _boxed(g.with_measures(runs))
    o = openings.withColumn("bx0", F.col("x")).withColumn("by0", F.col("y")).withColumn("bx1", F.col("x")).withColumn("by1", F.col("y"))
    place = g.dot("b_ux", "b_uy", F.col("a_x") - F.col("b_x1"), F.col("a_y") - F.col("b_y1"))
    side = F.abs(g.cross("b_ux", "b_uy", F.col("a_x") - F.col("b_x1"), F.col("a_y") - F.col("b_y1")))
    pairs = box_join(o, r, keys, BOX, BOX, cell, margin=max(along, off), condition=(side <= off) & place.between(-along, F.col("b_len") + along))
    return pairs.select(
        *keys, F.col("a_opening_id").alias("opening_id"), *[F.col(f"b_{c}").alias(c) for c in line],
        F.greatest(F.lit(0.0), F.least(F.col("b_len"), place)).alias("distance"),
    )


def nearest_walls(points: DataFrame, walls: DataFrame, keys: Keys, point_id: str, rings, prefix: str = "w_", perpendicular: bool = False, crowd: DataFrame | None = None) -> DataFrame:
    """Nearest wall of each point by distance, compared at 1e-6 mm so that equal distances tie; ``perpendicular`` keeps walls across the point's ``ux, uy``."""
    line = [prefix + c for c in LINE]
    across = F.abs(g.dot("ux", "uy", f"{prefix}ux", f"{prefix}uy")) <= 0.28 if perpendicular else None
    distance = g.point_segment_distance("x", "y", *line)
    return nearest(
        points, _boxed(walls), keys, [point_id], ("x", "y"), BOX, F.round(distance, 6), rings,
        order=[F.col(f"{prefix}ord")], condition=across, right_prefix=prefix, right_line=LINE, crowd=crowd, raw=distance,
    )


def host_walls(points: DataFrame, walls: DataFrame, keys: Keys, point_id: str = "id", rings=(1000.0, 8000.0, 64000.0, float("inf")), leaf: bool = False, crowd: DataFrame | None = None) -> DataFrame:
    """Host of each point: walls taken in order, a clearly nearer one (50 mm) or, in the tie band, a longer one wins.

    The outcome over the walls within some radius is the outcome over all walls if the
    running choice never comes within 50 mm of that radius: walls outside can then neither
    replace it nor hold out against it. Each ring looks for such a radius and settles the
    point; the others go on to the next ring. The last ring covers the drawing. With ``leaf``, a point with a direction
    ``leaf_x``, ``leaf_y`` only takes walls across it. Keys with few walls (:func:`by_crowd`, counted in ``crowd`` if given) need no
    rings.
    Returns points with ``host_wall_id``, ``host_distance``.
    """
    line = ("_w_x1", "_w_y1", "_w_x2", "_w_y2")
    if leaf:
        turned = F.abs(F.col("leaf_x") * (F.col("_w_x2") - F.col("_w_x1")) + F.col("leaf_y") * (F.col("_w_y2") - F.col("_w_y1")))
        across = F.col("leaf_x").isNull() | (turned <= 0.28 * g.length(*line))
    boxed = _boxed(walls).select(*keys, "id", "ord", F.col("len").cast("double").alias("len"), "x1", "y1", "x2", "y2", *BOX)
    start = F.struct(
        F.lit(None).cast("double").alias("d"), F.lit(None).cast(walls.schema["id"].dataType).alias("id"),
        F.lit(-1.0).alias("len"), F.lit(0.0).alias("far"),
    )

    def better(best, c):
        take = best["d"].isNull() | (c["_d"] < best["d"] - 50) | ((F.abs(c["_d"] - best["d"]) <= 50) & (c["_w_len"] > best["len"]))
        return F.when(
            take,
            F.struct(c["_d"].alias("d"), c["_w_id"].alias("id"), c["_w_len"].alias("len"), F.greatest(best["far"], c["_d"]).alias("far")),
        ).otherwise(best)

    def outcome(limit):
        return F.aggregate(F.filter(F.col("_c"), lambda c: c["_d"] <= limit), start, better)

    few, many = by_crowd(walls if crowd is None else crowd, keys) if math.isinf(rings[-1]) else (None, lambda df: df)
    done = None
    if few is not None:
        # Joined and grouped under the keys alone: both sides are shuffled once, their pairs never.
        target = prefixed(few(boxed).where(sane(*LINE)).drop(*BOX), "_w_", keys)
        rows = few(points).withColumn("_row", F.monotonically_increasing_id())
        pairs = rows.join(target, list(keys), "left").withColumn("_d", F.round(g.point_segment_distance("x", "y", *line), 6))
        fits = F.col("_d").isNotNull() & F.col(point_id).isNotNull() & sane("x", "y")
        if leaf:
            fits = fits & across
        wall = F.when(fits, F.struct("_w_ord", "_d", "_w_id", "_w_len"))
        listed = pairs.groupBy(*keys, "_row", *[c for c in points.columns if c not in keys]).agg(F.array_sort(F.collect_list(wall)).alias("_c"))
        done = listed.withColumn("_b", F.aggregate("_c", start, better)).drop("_c", "_row")
        if many is None:
            return done.select(*points.columns, F.col("_b.id").alias("host_wall_id"), F.col("_b.d").alias("host_distance"))
    boxed, points = many(boxed), many(points)
    pending = points
    radii, unlimited, i = [r for r in rings if math.isfinite(r)], math.isinf(rings[-1]), 0
    while i < len(radii):
        radius = radii[i]
        last = i == len(radii) - 1 and not unlimited
        target = prefixed(with_line_cells(boxed, ("x1", "y1", "x2", "y2"), radius, radius), "_w_", (*keys, "_gx", "_gy"))
        probe = pending.withColumn("_gx", F.floor(F.col("x") / radius).cast("bigint")).withColumn("_gy", F.floor(F.col("y") / radius).cast("bigint"))
        hits = probe.join(target, [*keys, "_gx", "_gy"])
        if leaf:
            hits = hits.where(across)
        hits = hits.withColumn("_d", F.round(g.point_segment_distance("x", "y", *line), 6)).where(F.col("_d") <= radius)
        found = hits.groupBy(*keys, point_id).agg(
            F.array_sort(F.collect_list(F.struct("_w_ord", "_d", "_w_id", "_w_len"))).alias("_c"), F.min("_d").alias("_near")
        )
        tried = pending.join(found, [*keys, point_id], "left")
        if last:
            tried = tried.withColumn("_b", outcome(F.lit(radius)))
        else:
            steps = []
            for step in range(1, 7):
                limit = F.col("_near") + 100.0 * step
                sure = g.let(outcome(limit), lambda r, limit=limit: F.when(r["far"] <= limit - 50, r))
                steps.append(F.when(limit <= radius, sure))
            tried = tried.withColumn("_b", F.coalesce(*steps))
        # Written once: both the answers and the points that go on read it.
        tried = checkpoint(tried.drop("_c", "_near"))
        answer = tried if last else tried.where(F.col("_b").isNotNull())
        done = answer if done is None else done.unionByName(answer)
        pending = tried.where(F.col("_b").isNull()).drop("_b")
        if last or pending.isEmpty():
            break
        i += 1
        if i == len(radii) and unlimited:
            radii += wider_rings(radius, pending, ("x", "y"), boxed, BOX)
            unlimited = False
    return done.select(*points.columns, F.col("_b.id").alias("host_wall_id"), F.col("_b.d").alias("host_distance"))
