"""Rows in crowds: same results as plain scans, without a list of all pairs."""

import os
import random

from draftloom.operators import audit as a
from draftloom.operators import dedupe as dd
from draftloom.operators import ordered
from draftloom.operators.ordered import components
from draftloom.session import checkpoint_folder

K = ("k",)


def test_notes_that_ask_alike_count_once(spark):
    notes = spark.createDataFrame([(1, "墙采用砖砌筑")] * 3 + [(1, "墙采用玻璃"), (2, "窗")], "project_id int, text string")
    rows = spark.createDataFrame([(1, "walls", 1, "steel"), (1, "walls", 2, "Brick"), (1, "walls", 3, ""), (2, "walls", 4, "steel")], "project_id int, component_group string, id int, material string")
    got = sorted((r["id"], r["expected"]) for r in a.material_conflicts(notes, rows, ["project_id"]).collect())
    assert len(got) == len(set(got)) == 3 and {i for i, _ in got} == {1, 2}


def test_columns_end_with_the_first_slab_under_them(spark):
    ring = [(0.0, 0.0), (1200.0, 0.0), (1200.0, 1200.0), (0.0, 1200.0)]
    slabs = spark.createDataFrame([(1, [(x + d, y) for x, y in ring]) for d in (0.0, 10.0, 4800.0)] + [(None, ring)], "k int, boundary array<struct<x:double,y:double>>")
    spots = [(1, 1, 600.0, 600.0), (1, 2, 5990.0, 1200.0), (1, 3, 3000.0, 100.0), (2, 4, 100.0, 100.0), (1, 5, None, 5.0), (None, 6, 600.0, 600.0)]
    columns = spark.createDataFrame([(*s, 400.0, 400.0, None, 3000.0, "") for s in spots], "k int, id int, x double, y double, width_mm double, depth_mm double, diameter_mm double, height_mm double, top_level string")
    found = a.column_compliance(columns, slabs, ["k"])
    assert sorted((r["component_id"], r["rule"]) for r in found.collect()) == [("3", "column_slab_relation"), ("5", "column_location")]
    # No list of all slabs per column.
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def _serial(rows, same):
    kept, out = {}, {}
    for k, i, _, *box in sorted(rows, key=lambda r: (-(r[5] - r[3]) * (r[6] - r[4]), r[2])):
        out[(k, i)] = next((j for j, other in kept.get(k, []) if same(other, box)), None)
        if out[(k, i)] is None:
            kept.setdefault(k, []).append((i, box))
    return out


def _inside(a_, b_):
    return b_[0] >= a_[0] - 12 and b_[1] >= a_[1] - 12 and b_[2] <= a_[2] + 12 and b_[3] <= a_[3] + 12


def _nested(a_, b_):
    mid = [(p[0] + p[2] - q[0] - q[2]) ** 2 + (p[1] + p[3] - q[1] - q[3]) ** 2 for p, q in ((a_, b_),)][0]
    return mid <= 320 ** 2 or _inside(a_, b_) or _inside(b_, a_)


def _share(a_, b_):
    w, h = min(a_[2], b_[2]) - max(a_[0], b_[0]), min(a_[3], b_[3]) - max(a_[1], b_[1])
    return max(0, w) * max(0, h) / min((a_[2] - a_[0]) * (a_[3] - a_[1]), (b_[2] - b_[0]) * (b_[3] - b_[1])) > 0.92


def test_boxes_in_crowds_equal_the_serial_scan(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for k, n, spots in ((1, 200, 3), (2, 40, 40), (3, 1, 1)):
        for i in range(n):
            x, y = rng.randrange(spots) * 3000 + rng.randrange(4) * 40, rng.randrange(2) * 3000 + rng.randrange(2) * 9
            rows.append((k, i, i, x, y, x + 2000 + rng.randrange(4) * 300, y + 1500 + rng.randrange(5) * 200))
    rows.append((2, 99, 99, 0, 0, 2_000_000, 50_000))
    rows = [(*r[:3], *map(float, r[3:])) for r in rows]
    frame = spark.createDataFrame(rows + [(1, 900, 900, None, 0.0, 5.0, 5.0), (None, 901, 901, 0.0, 0.0, 9.0, 9.0)], "k int, id int, ord int, x0 double, y0 double, x1 double, y1 double")
    listed, edges = [], dd._edges

    def counted(pairs, keys):
        listed.append(edges(pairs, keys).count())
        return edges(pairs, keys)

    monkeypatch.setattr(dd, "_edges", counted)
    monkeypatch.setattr(ordered, "LEAST_CROWD", 0)
    for distinct, same in ((dd.distinct_frames, _share), (dd.distinct_rectangles, _nested)):
        listed.clear()
        got = {(r["k"], r["id"]): r["duplicate_of"] for r in distinct(frame, K).collect()}
        want = _serial(rows, same) | {(1, 900): None, (None, 901): None}
        assert got == want
        # The crowd of 200 alone has thousands of conflicts.
        assert max(listed) < 1500


def test_groups_leave_one_table(spark):
    folder = checkpoint_folder(spark).removeprefix("file:")
    nodes = spark.createDataFrame([(1, i) for i in range(60)] + [(2, i) for i in range(5)] + [(None, 3)], "k int, id int")
    links = spark.createDataFrame([(1, i, i + 1) for i in range(40)] + [(2, 4, 2), (2, 2, 2), (None, 3, 4)], "k int, u int, v int")
    before = set(os.listdir(folder))
    got = {(r["k"], r["id"]): r["component"] for r in components(nodes, links, K).collect()}
    assert got == {(1, i): 0 if i <= 40 else i for i in range(60)} | {(2, i): 2 if i == 4 else i for i in range(5)} | {(None, 3): 3}
    assert len(set(os.listdir(folder)) - before) == 1
