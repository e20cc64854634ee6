"""Keys with few rows meet without cells; mixed tables give the same rows either way."""

import random

import pytest

from draftloom.operators import spatial as s
from draftloom.operators import walls as w

K = ("k",)


def _tables(spark):
    rng = random.Random(3)
    walls, points = [], []
    for k, n in ((1, 3), (2, 40), (3, 9)):
        for i in range(n):
            x, y, length = rng.randrange(0, 9000), rng.randrange(0, 9000), rng.randrange(300, 4000)
            flat = i % 2 == 0
            walls.append((k, i, i, float(length), float(x), float(y), float(x + length * flat), float(y + length * (not flat))))
    for i in range(60):
        points.append((rng.choice([1, 2, 3, 4, None]), i, None if i == 7 else float(rng.randrange(-2000, 12000)), float(rng.randrange(-2000, 12000))))
    return (spark.createDataFrame(walls, "k int, id int, ord int, len double, x1 double, y1 double, x2 double, y2 double"),
            spark.createDataFrame(points, "k int, pid int, x double, y double"))


def _results(spark):
    walls, points = _tables(spark)
    near = w.nearest_walls(points, walls, K, "pid", (500.0, 4000.0, float("inf")))
    close = w.nearest_walls(points, walls, K, "pid", (200.0, 900.0))
    three = s.nearest(points, w._boxed(walls), K, ["pid"], ("x", "y"), w.BOX, w.F.round(w.g.point_segment_distance("x", "y", "r_x1", "r_y1", "r_x2", "r_y2"), 6), (500.0, float("inf")), order=[w.F.col("r_ord")], k=3)
    hosts = w.host_walls(points, walls, K, "pid")
    pairs = w.pair_lines(walls.withColumn("layer", w.F.lit("A")), K)
    boxed = w._boxed(walls)
    met = s.box_join(boxed, boxed, K, w.BOX, w.BOX, 700.0, margin=150.0, crowd=walls)
    return [sorted(map(tuple, df.collect()), key=repr) for df in (
        near.select("k", "pid", "w_id", "_distance"), close.select("k", "pid", "w_id", "_distance"), three.select("k", "pid", "_rank", "r_id", "_distance"),
        hosts.select("k", "pid", "host_wall_id", "host_distance"), pairs.select("k", "a_id", "b_id", "raw_width", "len"), met.select("k", "a_id", "b_id"))]


@pytest.mark.parametrize("few", [20])
def test_cells_and_plain_pairs_agree(spark, monkeypatch, few):
    monkeypatch.setattr(s, "FEW", 0)
    cells = _results(spark)
    monkeypatch.setattr(s, "FEW", few)
    assert _results(spark) == cells and all(cells)


def test_few_rows_touch_no_cells(spark, monkeypatch):
    def none(*_, **__):
        raise AssertionError("rows repeated per cell")

    for module, name in ((s, "with_cells"), (s, "with_line_cells"), (w, "with_line_cells")):
        monkeypatch.setattr(module, name, none)
    assert all(_results(spark))
