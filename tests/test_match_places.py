"""Matching of doors and marks place by place equals a serial scan over all pairs."""

import math
import random

import pytest

from draftloom.operators import matching as m

SHAPE = "drawing_id long, id long, ord long, x long, y long"


def serial(doors, marks, limit):
    pairs = sorted((round(math.hypot(d[3] - k[3], d[4] - k[4]), 6), d[2], k[2], d[0], d[1], k[1]) for d in doors for k in marks if d[0] == k[0] and None not in (d[3], k[3]))
    used, out = set(), []
    for distance, _, _, drawing, door, mark in pairs:
        if distance <= limit and ("d", drawing, door) not in used and ("m", drawing, mark) not in used:
            used |= {("d", drawing, door), ("m", drawing, mark)}
            out.append((drawing, door, mark, distance))
    return sorted(out)


def rows(rng, n, step, size):
    ids = rng.sample(range(10 * n), n)
    return [(rng.randrange(2), i, 7 * i % 99991, rng.randrange(size) // step * step, rng.randrange(size) // step * step) for i in ids]


@pytest.mark.parametrize("step, size", [(1, 4000), (200, 2000)])
def test_places_equal_the_serial_scan(spark, monkeypatch, step, size):
    rng = random.Random(step)
    # Coarse steps put many rows on one place and make ties.
    doors, marks = rows(rng, 150, step, size) + [(0, 9999, 9999, None, 3)], rows(rng, 120, step, size)
    called = []
    monkeypatch.setattr(m, "SPARSE", 0.0)
    monkeypatch.setattr(m, "_match_pairs", lambda *a: called.append(a))
    found = m.match_marks(spark.createDataFrame(doors, SHAPE), spark.createDataFrame(marks, SHAPE), limit=400.0, keys=("drawing_id",))
    assert sorted(map(tuple, found.collect())) == serial(doors, marks, 400.0)
    # All pairs in reach are never listed.
    assert not called


def test_repeated_rows_and_ids_are_as_pair_by_pair(spark):
    rng = random.Random(9)
    doors, marks = rows(rng, 60, 100, 1000), rows(rng, 50, 100, 1000)
    doors += doors[:5] + [(1, doors[0][1], 5, 10, 10), (1, doors[0][1], 6, 900, 900)]
    marks += marks[:4]
    a, b = spark.createDataFrame(doors, SHAPE), spark.createDataFrame(marks, SHAPE)
    found, plain = (sorted(map(tuple, f(a, b, ("drawing_id",), 300.0).collect())) for f in (m._match_places, m._match_pairs))
    assert found == plain
