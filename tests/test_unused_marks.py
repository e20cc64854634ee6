"""Marks without an opening close by: cells settle most, the rest meets openings one by one."""

import random

from draftloom.operators import matching as m


def test_unused_marks_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    spots = [(rng.randrange(2), rng.choice(["door", "window"]), i, rng.randrange(30000), rng.randrange(30000)) for i in range(300)]
    spots += [(0, "door", 900, None, 5), (None, "door", 901, 5, 5), (0, "door", None, 1, 1), (0, "door", 902, 100, 100), (0, "door", 902, 29000, 100)]
    doors = [(rng.randrange(2), rng.choice(["door", "window"]), rng.randrange(30000), rng.randrange(30000)) for _ in range(60)] + [(0, "door", 90, 90)] * 400
    shape = "drawing_id long, kind string, mark_id long, x long, y long"
    marks, openings = spark.createDataFrame(spots, shape), spark.createDataFrame(doors, "drawing_id long, kind string, x long, y long")
    used = {(d, i) for d, k, i, x, y in spots for e, l, u, v in doors if x is not None and (d, k) == (e, l) and (x - u) ** 2 + (y - v) ** 2 < 2500**2 and d is not None and i is not None}
    expected = sorted(((d, i) for d, k, i, x, y in spots if (d, i) not in used), key=str)
    met = []
    join = m.box_join
    monkeypatch.setattr(m, "box_join", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    assert sorted(map(tuple, m.unused_marks(marks, openings).collect()), key=str) == expected
    # A mark in a cell with 400 doors of one place meets none of them.
    assert met[0].where("a_mark_id = 902 and a_x = 100").isEmpty()
