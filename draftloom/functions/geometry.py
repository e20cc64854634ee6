"""Plane geometry as column expressions (millimetres, degrees). No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard wall thicknesses in millimetres.
STANDARD_WIDTHS = [100, 120, 150, 180, 200, 240, 250, 300, 350, 400]


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def strip(value) -> Column:
    """Text without white space at its ends, line breaks and wide spaces included."""
    return F.btrim(col(value), F.lit(" \t\n\r\f\v\u00a0\u3000"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def point(x, y) -> Column:
    return F.struct(col(x).alias("x"), col(y).alias("y"))


def length(x1, y1, x2, y2) -> Column:
    return F.hypot(col(x2) - col(x1), col(y2) - col(y1))


def orientation(x1, y1, x2, y2, ratio: float = 10) -> Column:
    """'H', 'V' or 'OTHER': one extent is at least ``ratio`` times the other."""
    dx, dy = F.abs(col(x2) - col(x1)), F.abs(col(y2) - col(y1))
    return F.when(dx >= dy * ratio, "H").when(dy >= dx * ratio, "V").otherwise("OTHER")


def angle_degrees(x1, y1, x2, y2) -> Column:
    return F.degrees(F.atan2(col(y2) - col(y1), col(x2) - col(x1)))


def with_direction(df, ratio: float = 10):
    """Order the two ends of each segment left to right, bottom to top."""
    ori = orientation("x1", "y1", "x2", "y2", ratio)
    swap = (
        F.when(ori == "H", F.col("x1") > F.col("x2"))
        .when(ori == "V", F.col("y1") > F.col("y2"))
        .otherwise((F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2"))))
    )
    ends = F.when(swap, F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))).otherwise(
        F.struct("x1", "y1", "x2", "y2")
    )
    out = df.withColumn("_ends", ends).withColumn("ori", ori)
    for name in ("x1", "y1", "x2", "y2"):
        out = out.withColumn(name, F.col(f"_ends.{name}"))
    return out.drop("_ends")


def with_measures(df):
    """Add length, unit direction and midpoint to rows with x1, y1, x2, y2."""
    size = length("x1", "y1", "x2", "y2")
    return (
        df.withColumn("len", size)
        .withColumn("ux", F.when(F.col("len") == 0, 1.0).otherwise((F.col("x2") - F.col("x1")) / F.col("len")))
        .withColumn("uy", F.when(F.col("len") == 0, 0.0).otherwise((F.col("y2") - F.col("y1")) / F.col("len")))
        .withColumn("mx", (F.col("x1") + F.col("x2")) / 2.0)
        .withColumn("my", (F.col("y1") + F.col("y2")) / 2.0)
    )


def overlap(a1, a2, b1, b2) -> Column:
    """Length shared by two intervals whose ends may be in any order, never negative."""
    a1, a2, b1, b2 = map(col, (a1, a2, b1, b2))
    return F.greatest(F.least(F.greatest(a1, a2), F.greatest(b1, b2)) - F.greatest(F.least(a1, a2), F.least(b1, b2)), F.lit(0) * a1)


def gap(a1, a2, b1, b2) -> Column:
    """Empty space between two intervals, 0 when they touch."""
    a1, a2, b1, b2 = map(col, (a1, a2, b1, b2))
    return F.greatest(F.greatest(F.least(a1, a2), F.least(b1, b2)) - F.least(F.greatest(a1, a2), F.greatest(b1, b2)), F.lit(0) * a1)


def dot(ax, ay, bx, by) -> Column:
    return col(ax) * col(bx) + col(ay) * col(by)


def cross(ax, ay, bx, by) -> Column:
    return col(ax) * col(by) - col(ay) * col(bx)


def is_parallel(a: str, b: str, tolerance: float = 0.035) -> Column:
    """Both prefixes name rows that carry ``ux`` and ``uy``."""
    return F.abs(cross(f"{a}ux", f"{a}uy", f"{b}ux", f"{b}uy")) <= tolerance


def signed_offset(a: str, b: str) -> Column:
    """Signed distance of b's first end from the line of a."""
    return cross(f"{a}ux", f"{a}uy", F.col(f"{b}x1") - F.col(f"{a}x1"), F.col(f"{b}y1") - F.col(f"{a}y1"))


def span_along(a: str, b: str) -> Column:
    """(lo, hi) of the stretch of a's line that both segments cover."""
    def place(x, y):
        return dot(f"{a}ux", f"{a}uy", F.col(x) - F.col(f"{a}x1"), F.col(y) - F.col(f"{a}y1"))

    b1, b2 = place(f"{b}x1", f"{b}y1"), place(f"{b}x2", f"{b}y2")
    return F.struct(
        F.greatest(F.lit(0.0), F.least(b1, b2)).alias("lo"),
        F.least(F.col(f"{a}len"), F.greatest(b1, b2)).alias("hi"),
    )


def center_line(a: str, b: str) -> Column:
    """Middle line of two parallel segments over their shared stretch: x1, y1, x2, y2."""
    half, span = signed_offset(a, b) / 2.0, span_along(a, b)
    ux, uy = F.col(f"{a}ux"), F.col(f"{a}uy")
    ox, oy = F.col(f"{a}x1") - uy * half, F.col(f"{a}y1") + ux * half
    return F.struct(
        (ox + ux * span["lo"]).alias("x1"), (oy + uy * span["lo"]).alias("y1"),
        (ox + ux * span["hi"]).alias("x2"), (oy + uy * span["hi"]).alias("y2"),
    )


def share_along(px, py, x1, y1, x2, y2) -> Column:
    """Where the foot of the point falls on the line: 0 at the start, 1 at the end, unclamped."""
    px, py, x1, y1, x2, y2 = map(col, (px, py, x1, y1, x2, y2))
    squared = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    return F.when(squared == 0, 0.0).otherwise(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / squared)


def project_point(px, py, x1, y1, x2, y2) -> Column:
    """Nearest point of the segment."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share_along(px, py, x1, y1, x2, y2)))
    return point(col(x1) + t * (col(x2) - col(x1)), col(y1) + t * (col(y2) - col(y1)))


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    foot = project_point(px, py, x1, y1, x2, y2)
    return F.hypot(col(px) - foot["x"], col(py) - foot["y"])


def outside_gap(px, py, x1, y1, x2, y2) -> Column:
    """How far the foot of the point lies beyond either end of the segment."""
    t = share_along(px, py, x1, y1, x2, y2)
    return F.when(t < 0, -t).when(t > 1, t - 1.0).otherwise(0.0) * length(x1, y1, x2, y2)


def _edges(points: Column) -> Column:
    """Array of (a, b) pairs of neighbouring corners, closing the ring."""
    ring = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.zip_with(points, ring, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def polygon_area(points) -> Column:
    points = col(points)
    twice = F.aggregate(_edges(points), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(twice) / 2.0)


def polygon_centroid(points) -> Column:
    """Mean of the corners."""
    points = col(points)

    def mean(axis):
        return F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(points)

    return F.when(F.size(points) == 0, point(F.lit(0.0), F.lit(0.0))).otherwise(point(mean("x"), mean("y")))


def bounding_box(points) -> Column:
    xs, ys = F.transform(col(points), lambda p: p["x"]), F.transform(col(points), lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")
    )


def point_in_polygon(px, py, points) -> Column:
    """Even-odd rule; a point on an edge may fall on either side."""
    px, py, points = col(px), col(py), col(points)

    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > py) != (b["y"] > py)) & (
            px < (b["x"] - a["x"]) * (py - a["y"]) / F.when(b["y"] == a["y"], F.lit(1e-12)).otherwise(b["y"] - a["y"]) + a["x"]
        )

    count = F.aggregate(_edges(points), F.lit(0), lambda n, e: n + F.when(crosses(e), 1).otherwise(0))
    return (F.size(points) >= 3) & (count % 2 == 1)


def on_boundary(px, py, points, tolerance: float = 1.0) -> Column:
    return F.exists(
        _edges(col(points)),
        lambda e: point_segment_distance(px, py, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]) <= tolerance,
    )


def point_in_or_on_polygon(px, py, points, tolerance: float = 1.0) -> Column:
    return on_boundary(px, py, points, tolerance) | point_in_polygon(px, py, points)


def open_ring(points, tolerance: float = 1.0) -> Column:
    """Drop a last corner that only repeats the first."""
    points = col(points)
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    closed = (F.size(points) > 1) & (F.hypot(first["x"] - last["x"], first["y"] - last["y"]) <= tolerance)
    return F.when(closed, F.slice(points, 1, F.size(points) - 1)).otherwise(points)


def polygon_in_polygon(inner, outer, tolerance: float = 1.0) -> Column:
    """All corners of ``inner`` lie in or on ``outer``."""
    inner = open_ring(inner, tolerance)
    return (F.size(inner) >= 3) & F.forall(inner, lambda p: point_in_or_on_polygon(p["x"], p["y"], outer, tolerance))


def box_gap(a: str, b: str) -> Column:
    """Straight distance between two boxes with fields x0, y0, x1, y1; 0 when they meet."""
    dx = gap(f"{a}x0", f"{a}x1", f"{b}x0", f"{b}x1")
    dy = gap(f"{a}y0", f"{a}y1", f"{b}y0", f"{b}y1")
    return F.hypot(dx, dy)


def box_overlap_share(a: str, b: str) -> Column:
    """Shared area over the area of the smaller box."""
    shared = overlap(f"{a}x0", f"{a}x1", f"{b}x0", f"{b}x1") * overlap(f"{a}y0", f"{a}y1", f"{b}y0", f"{b}y1")

    def area(p):
        return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))

    smaller = F.least(area(a), area(b))
    return F.when(smaller <= 0, 0.0).otherwise(shared / smaller)


def box_contains(a: str, b: str, tolerance: float = 12.0) -> Column:
    """Box b lies inside box a."""
    return (
        (F.col(f"{b}x0") >= F.col(f"{a}x0") - tolerance) & (F.col(f"{b}y0") >= F.col(f"{a}y0") - tolerance)
        & (F.col(f"{b}x1") <= F.col(f"{a}x1") + tolerance) & (F.col(f"{b}y1") <= F.col(f"{a}y1") + tolerance)
    )


def in_box(px, py, box: str, margin: float = 0.0) -> Column:
    """A positive margin shrinks the box."""
    return col(px).between(F.col(f"{box}x0") + margin, F.col(f"{box}x1") - margin) & col(py).between(
        F.col(f"{box}y0") + margin, F.col(f"{box}y1") - margin
    )


def arc_ends(cx, cy, radius, a0, a1) -> Column:
    """Both ends of an arc: sx, sy, ex, ey."""
    cx, cy, radius = col(cx), col(cy), col(radius)
    s, e = F.radians(col(a0)), F.radians(col(a1))
    return F.struct(
        (cx + F.cos(s) * radius).alias("sx"), (cy + F.sin(s) * radius).alias("sy"),
        (cx + F.cos(e) * radius).alias("ex"), (cy + F.sin(e) * radius).alias("ey"),
    )


def arc_sweep(a0, a1) -> Column:
    """Opening angle of an arc, folded to at most 180 degrees."""
    sweep = F.pmod(F.pmod(col(a1), F.lit(360)) - F.pmod(col(a0), F.lit(360)), F.lit(360))
    return F.when(sweep <= 180, sweep).otherwise(360 - sweep)


def compass(dx, dy) -> Column:
    """Compass word of a vector; the longer axis decides."""
    dx, dy = col(dx), col(dy)
    return (
        F.when(F.abs(dx) >= F.abs(dy), F.when(dx >= 0, "east").otherwise("west"))
        .when(dy >= 0, "north").otherwise("south")
    )


def arc_direction(a0, a1) -> Column:
    """Compass word of the middle of an arc."""
    middle = F.radians(F.pmod(col(a0) + F.pmod(col(a1) - col(a0), F.lit(360)) / 2.0, F.lit(360)))
    return compass(F.cos(middle), F.sin(middle))


def nearest_standard(value, standards=None, tolerance: float = 6) -> Column:
    """Nearest standard size as (value, ok, delta); the first listed wins a tie."""
    value = col(value).cast("double")
    standards = STANDARD_WIDTHS if standards is None else standards
    if not standards:
        return F.struct(value.alias("value"), F.lit(False).alias("ok"), F.lit(0.0).alias("delta"))
    sizes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(standards)])
    best = F.array_min(
        F.transform(sizes, lambda s: F.struct(F.abs(s["w"] - value).alias("delta"), s["i"].alias("i"), s["w"].alias("value")))
    )
    return F.struct(best["value"].alias("value"), (best["delta"] <= tolerance).alias("ok"), best["delta"].alias("delta"))


def width_status(standard: Column) -> Column:
    return F.when(standard["delta"] < 1e-6, "standard").when(standard["ok"], "auto_normalized").otherwise("nonstandard")


def to_local(points, ox, oy) -> Column:
    """Shift an array of points by the drawing's origin."""
    return F.transform(col(points), lambda p: point(F.round(p["x"] - col(ox), 3), F.round(p["y"] - col(oy), 3)))


def body_key(x1, y1, x2, y2, width, step: float = 5.0) -> Column:
    """The four corners of a wall body on a coarse grid, sorted, so that both ways to draw it agree."""
    x1, y1, x2, y2, width = map(col, (x1, y1, x2, y2, width))
    size = F.hypot(x2 - x1, y2 - y1)
    nx, ny, half = -(y2 - y1) / size, (x2 - x1) / size, width / 2.0

    def corner(x, y, sign):
        return F.struct(
            F.bround((x + nx * half * sign) / step, 0).cast("bigint").alias("x"),
            F.bround((y + ny * half * sign) / step, 0).cast("bigint").alias("y"),
        )

    return F.array_sort(F.array(corner(x1, y1, 1), corner(x2, y2, 1), corner(x2, y2, -1), corner(x1, y1, -1)))


def polygon_edges(points, closed) -> Column:
    """Edges of a polyline; the closing edge only where it is closed and has more than two corners."""
    points = col(points)
    pairs = _edges(points)
    count = F.when(col(closed) & (F.size(points) > 2), F.size(points)).otherwise(F.greatest(F.size(points) - 1, F.lit(0)))
    return F.slice(pairs, 1, count)
