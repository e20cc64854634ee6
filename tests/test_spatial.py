"""Grids and joins of lines against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from draftloom.functions import geometry as g
from draftloom.operators import spatial as s
from draftloom.operators import walls as w

SCHEMA = "drawing_id int, id int, ord int, x1 double, y1 double, x2 double, y2 double"


def random_lines(seed, n, reach=6000.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.uniform(-reach, reach), rng.uniform(-reach, reach)
        turn = rng.choice([0, 90, 45, 179.5, 0.4, 3.1, 2.9, rng.uniform(0, 180)]) + rng.choice([0, 180])
        size = rng.choice([300, 2000, 9000])
        out.append((rng.randrange(2), i, i, x, y, x + size * math.cos(math.radians(turn)), y + size * math.sin(math.radians(turn))))
    return out


def turn_between(a, b):
    ta, tb = (math.degrees(math.atan2(r[6] - r[4], r[5] - r[3])) for r in (a, b))
    d = abs(ta - tb) % 180
    return min(d, 180 - d)


def apart(a, b):
    def point(px, py, r):
        dx, dy = r[5] - r[3], r[6] - r[4]
        t = max(0.0, min(1.0, ((px - r[3]) * dx + (py - r[4]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - r[3] - t * dx, py - r[4] - t * dy)

    return min(point(a[3], a[4], b), point(a[5], a[6], b), point(b[3], b[4], a), point(b[5], b[6], a))


@pytest.mark.parametrize("along, across, sector", [(4000.0, 1200.0, 6.0), (900.0, 150.0, 2.25)])
def test_parallel_pairs_equal_all_pairs(spark, along, across, sector):
    rows = random_lines(1, 160)
    df = g.with_measures(spark.createDataFrame(rows, SCHEMA))
    near = (F.col("a_ord") < F.col("b_ord")) & (F.abs(g.dot("a_ux", "a_uy", "b_ux", "b_uy")) >= math.cos(math.radians(2))) & (F.abs(g.signed_offset("a_", "b_")) <= 500)
    found = s.parallel_join(df, df, ["drawing_id"], along, across, 500.0, 2.1, near, sector)
    got = [(r["a_id"], r["b_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and not [c for c in found.columns if c.startswith(("_", "a__", "b__"))]
    # Every pair in reach of each other is found; pairs farther apart may be, if their lines run close.
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and turn_between(a, b) < 1.999 and apart(a, b) <= 450 and abs(offset(a, b)) <= 500}
    assert want and want <= set(got)
    assert all(rows[a][0] == rows[b][0] and turn_between(rows[a], rows[b]) <= 2.001 and abs(offset(rows[a], rows[b])) <= 500.001 for a, b in got)


def offset(a, b):
    size = math.hypot(a[5] - a[3], a[6] - a[4])
    return ((a[5] - a[3]) * (b[4] - a[4]) - (a[6] - a[4]) * (b[3] - a[3])) / size


def test_cells_along_a_line(spark):
    rows = [r for r in random_lines(2, 60)] + [(0, 900, 900, 10.0, 10.0, 10.0, 4000.0), (0, 901, 901, 5.0, 5.0, 5.0, 5.0), (0, 902, 902, 0.0, 0.0, 1e-10, 900.0)]
    cells = {}
    for r in s.with_line_cells(spark.createDataFrame(rows, SCHEMA), ("x1", "y1", "x2", "y2"), 450.0, 300.0).collect():
        key = (r["_gx"], r["_gy"])
        assert key not in cells.setdefault(r["id"], set())
        cells[r["id"]].add(key)
    rng = random.Random(3)
    for r in rows:
        for _ in range(200):
            t, a, d = rng.random(), rng.uniform(0, 2 * math.pi), rng.uniform(0, 299.999)
            x, y = r[3] + t * (r[5] - r[3]) + d * math.cos(a), r[4] + t * (r[6] - r[4]) + d * math.sin(a)
            assert (math.floor(x / 450), math.floor(y / 450)) in cells[r[1]]


def test_a_slanted_wall_touches_few_cells(spark):
    wall = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 70_711.0, 70_711.0)], SCHEMA)
    assert s.with_line_cells(wall, ("x1", "y1", "x2", "y2"), 450.0, 300.0).count() < 1000


def test_absurd_coordinates_are_reported_and_left_out(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 4000.0, 0.0), (1, 2, 2, 0.0, 200.0, 4000.0, 200.0), (1, 3, 3, 0.0, 0.0, 1e13, 1e13), (1, 4, 4, float("nan"), 0.0, 1.0, 1.0), (1, 5, 5, 0.0, 0.0, 3e8, 0.0), (1, 6, 6, 4e9, 4e9, 4e9, 4e9 + 3000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("layer", F.lit("A-WALL")).withColumn("project_id", F.lit(1))
    issues = {r["id"]: r["issue"] for r in s.coordinate_issues(df, ("x1", "y1", "x2", "y2")).collect()}
    assert issues == {3: "coordinate_out_of_range", 4: "coordinate_out_of_range", 5: "extent_out_of_range"}
    assert [(r["a_id"], r["b_id"]) for r in w.pair_lines(df).collect()] == [(1, 2)]
    points = spark.createDataFrame([(1, 1, 100.0, 50.0), (1, 2, 1e13, 0.0), (1, 3, 4e9 + 10, 4e9)], "drawing_id int, pid int, x double, y double")
    near = {r["pid"]: r["w_id"] for r in w.nearest_walls(points, df, ["drawing_id"], "pid", (1000.0, float("inf"))).collect()}
    assert near[1] == 1 and near[3] == 6


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_lines_equal_a_plain_search(spark, k):
    rows = random_lines(5, 80)
    rng = random.Random(6)
    points = [(rng.randrange(3), i, rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for i in range(60)]
    lines, spots = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(points, "drawing_id int, pid int, x double, y double")
    distance = F.round(g.point_segment_distance("x", "y", "w_x1", "w_y1", "w_x2", "w_y2"), 6)
    found = s.nearest(spots, w._boxed(lines), ["drawing_id"], ["pid"], ("x", "y"), w.BOX, distance, (500.0, 3000.0, float("inf")), order=[F.col("w_ord")], k=k, right_prefix="w_", right_line=("x1", "y1", "x2", "y2"))
    got = sorted((r["pid"], r["_rank"], r["w_id"]) for r in found.collect())
    want = []
    for d, pid, x, y in points:
        near = sorted((round(apart((0, 0, 0, x, y, x + 1e-9, y), r), 5), r[1]) for r in rows if r[0] == d)
        want += [(pid, i + 1, wid) for i, (_, wid) in enumerate(near[:k])]
    assert got == sorted(want)
