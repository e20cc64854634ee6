"""Crowded places are searched in rings fitted to the crowd; the answers are those of brute force."""

import math
import random

from pyspark.sql import functions as F

from draftloom.operators import matching as m
from draftloom.operators import spatial as sp


def test_crowded_points_meet_few(spark, monkeypatch):
    rng = random.Random(4)
    points = [(0, i, rng.randrange(3000), rng.randrange(3000)) for i in range(1500)]
    asks = [(0, i, rng.randrange(3000), rng.randrange(3000)) for i in range(40)] + [(0, 77, 90000, 5)]
    raw = spark.createDataFrame(points, "drawing_id long, raw_id long, x long, y long")
    openings = spark.createDataFrame(asks, "drawing_id long, opening_id long, x long, y long")
    cells = []
    monkeypatch.setattr(sp, "with_cells", lambda df, box, cell, *a, _f=sp.with_cells, **k: cells.append(cell) or _f(df, box, cell, *a, **k))
    found = m.nearby_geometry(openings, raw, ("drawing_id",), k=3, radius=4000.0)
    got = sorted(tuple(r) for r in found.select("opening_id", F.col("_rank"), "g_raw_id").collect())
    expected = []
    for _, o, x, y in asks:
        near = sorted((round(math.hypot(x - u, y - v), 6), i) for _, i, u, v in points)
        expected += [(o, n + 1, i) for n, (d, i) in enumerate(near[:3]) if d <= 4000.0]
    assert got == sorted(expected)
    # The first ring holds a few points a cell, not hundreds.
    assert cells[0] <= 250.0
