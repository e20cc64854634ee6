"""Small drawings and models with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from draftloom.functions import geometry as g
from draftloom.functions import text as t
from draftloom.functions import values as v
from draftloom.operators import components as cp
from draftloom.operators import dedupe as dd
from draftloom.operators import levels as lv
from draftloom.operators import matching as m
from draftloom.operators import openings as op
from draftloom.operators import rectangles as rc
from draftloom.operators import stairs as st
from draftloom.operators import walls as w

K = ["project_id", "drawing_id"]


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def lines(spark, data, layer="A-WALL"):
    made = [(1, 1, i, i, layer, *map(float, ends)) for i, ends in enumerate(data)]
    df = spark.createDataFrame(made, "project_id int, drawing_id int, id int, ord int, layer string, x1 double, y1 double, x2 double, y2 double")
    return g.with_direction(df)


def test_wall_recognition(spark):
    data = [(0, 0, 4000, 0), (0, 240, 4000, 240), (0, 0, 4000, 0), (5000, 0, 5000, 300), (5237, 0, 5237, 300), (9000, 0, 9100, 0), (9000, 200, 9100, 200), (9050, -100, 9050, -3000), (9250, -100, 9250, -3000)]
    found = sorted(rows(w.recognize_walls(lines(spark, data))), key=lambda r: r["ord"])
    kinds = {r["recognition_source"]: r for r in found}
    assert kinds["short_paired_wall_lines"]["normalized_width"] == 240 and kinds["short_paired_wall_lines"]["width_status"] == "auto_normalized"
    assert kinds["t_pier_wall_lines"]["len"] == 100
    assert [r["id"] for r in found] == [f"W{i:04d}" for i in range(1, len(found) + 1)]
    assert {(r["x1"], r["y1"], r["x2"], r["y2"]) for r in found if r["recognition_source"] == "paired_wall_lines"} == {(0, 120, 4000, 120), (9150, -3000, 9150, -100)}
    issues = rows(w.width_issues(w.recognize_walls(lines(spark, data))))
    assert [i["severity"] for i in issues] == ["info"]


def test_slanted_walls_pair(spark):
    data = [(0, 0, 3000, 3000), (141.42, -141.42, 3141.42, 2858.58)]
    found = rows(w.recognize_walls(lines(spark, data)))
    assert len(found) == 1 and found[0]["normalized_width"] == 200


def test_wall_runs_bridge_a_door(spark):
    for thick, runs in (((100, 100), 1), ((100, 200), 2)):
        walls = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 0.0, thick[0]), (1, 1, 1000.0, 0.0, 3000.0, 0.0, thick[1])], "project_id int, drawing_id int, x1 double, y1 double, x2 double, y2 double, thickness_mm int")
        keyed = w.run_keys(walls)
        doors = keyed.select(*K, *w.LINE_KEYS, F.lit(500.0).alias("t")).distinct()
        found = rows(w.wall_runs(keyed, doors, K))
        assert len(found) == runs
        if runs == 1:
            assert (found[0]["lo"], found[0]["hi"], found[0]["n"]) == (0, 3000, 2)


def test_columns_from_rectangle_and_circle(spark):
    rect = lines(spark, [(0, 0, 400, 0), (0, 300, 400, 300), (0, 0, 0, 300), (400, 0, 400, 300)], "S-COLUMN")
    found = rows(rc.line_rectangles(rect))
    assert len(found) == 1 and (found[0]["x0"] + found[0]["x1"]) / 2 == 200 and (found[0]["y0"] + found[0]["y1"]) / 2 == 150
    split = lines(spark, [(0, 0, 200, 0), (205, 0, 400, 0), (0, 300, 400, 300), (0, 0, 0, 300), (400, 0, 400, 300)], "S-COLUMN")
    assert rows(rc.line_rectangles(split)) == []
    assert [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows(rc.fragmented_rectangles(split))] == [(0, 0, 400, 300)]
    made = spark.createDataFrame([(1, 1, 1, 1, 200.0, 150.0, "r", 400.0), (1, 1, 2, 2, 205.0, 150.0, "r", 410.0), (1, 1, 3, 3, 1200.0, 1000.0, "c", 500.0)], "project_id int, drawing_id int, id int, ord int, x double, y double, shape string, size double")
    assert {r["id"]: r["duplicate_of"] for r in rows(dd.distinct_columns(made))} == {1: None, 2: 1, 3: None}


def test_wall_recheck(spark):
    base = dict(level="L1", drawing_type="floor_plan", floor_number="", floor_status="", thickness_mm=200, material="brick", height_mm=3000, review_status="ready", confidence=0.9)
    data = [
        dict(base, project_id=1, id="A", drawing_id="D1", x1=0.0, y1=0.0, x2=4000.0, y2=0.0), dict(base, project_id=1, id="B", drawing_id="D1", x1=3000.0, y1=5.0, x2=1000.0, y2=5.0, thickness_mm=240),
        dict(base, project_id=2, id="C", drawing_id="D1", x1=0.0, y1=0.0, x2=4000.0, y2=0.0), dict(base, project_id=2, id="D", drawing_id="D2", x1=0.0, y1=0.0, x2=4000.0, y2=0.0),
    ]
    names = ["project_id", "id", "level", "drawing_id", "drawing_type", "floor_number", "floor_status", "x1", "y1", "x2", "y2", "thickness_mm", "material", "height_mm", "review_status", "confidence"]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in data], names)
    found = {r["id"]: r for r in rows(dd.recheck_walls(df))}
    assert found["A"]["kept"] and found["B"]["duplicate_of"] == "A" and found["B"]["conflicts"] == "thickness"
    assert found["C"]["kept"] and found["D"]["kept"] and found["C"]["blocked_by"] == "D" and found["D"]["blocked_by"] == "C"


def test_level_titles(spark):
    titles = ["Ground Floor Plan", "First Floor Plan", "Second Floor Plan", "Roof Plan"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(titles)], "project_id int, ord int, title string").select("project_id", "ord", t.level_from_title("title", True).alias("l")).select("project_id", "ord", "l.*")
    found = sorted(rows(lv.level_table(df, ["project_id"], 3600.0)), key=lambda r: r["elevation_mm"])
    assert [r["elevation_mm"] for r in found] == [0, 3600, 7200, 10800] and [r["key"] for r in found] == ["L1", "L2", "L3", "roof"]


def test_text_functions(spark):
    df = spark.createDataFrame([("二十三层平面图", "M0921 C-1515", '看 ```json\n{"a": {"b": 1}}\n``` ok', "地下二层")], "a string, b string, c string, d string")
    r = rows(df.select(t.floor_number("a").alias("n"), t.opening_marks("b").alias("m"), v.json_object("c").alias("j"), t.level_from_title("d").alias("l"), t.chinese_number(F.lit("四十")).alias("f")))[0]
    assert r["n"] == 23 and r["f"] == 40 and r["l"]["number"] == -2 and r["j"] == '{"a": {"b": 1}}'
    assert [(x["kind"], x["width_mm"], x["height_mm"]) for x in r["m"]] == [("door", 900, 2100), ("window", 1500, 1500)]


def test_json_objects_of_any_depth_in_prose(spark):
    deep = "{\"a\": " * 50 + "1" + "}" * 50
    long = '{"t": "' + "x { } \\\\" * 20_000 + '", "n": {"m": 1}}'
    odd = '{"a": "closing } and \\\\\\" { in text", "b": {"c": "}"}}'
    texts = [f"So: {deep} as asked }}.", f"{long} and more {{", f"x {odd} y }}", "no { end", 'a {"b": "never closed} c', "{not json} then", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["o"] for r in sorted(rows(df.select("i", v.json_object("t").alias("o"))), key=lambda r: r["i"])]
    assert got == [deep, long, odd, None, None, None, None, None]


def views(spark, data):
    return spark.createDataFrame(data, "project_id int, id int, ord int, kind string, facade string, mark string, width double, height double, position double")


def serial_views(plans, elevations):
    """Elevation opening of every plan opening, by the plain loop."""
    def score(p, e):
        s = 0.22
        if p[5] and e[5]:
            s += 0.42 if p[5] == e[5] else 0.08 if p[5][0] == e[5][0] else 0
        if p[6] is not None and e[6] is not None:
            s += 0.2 if abs(p[6] - e[6]) <= 80 else 0.1 if abs(p[6] - e[6]) <= 200 else 0
        if p[7] is not None and e[7] is not None:
            s += 0.08 if abs(p[7] - e[7]) <= 120 else 0.04 if abs(p[7] - e[7]) <= 300 else 0
        if p[8] is not None and e[8] is not None:
            s += 0.2 if abs(p[8] - e[8]) <= 300 else 0.1 if abs(p[8] - e[8]) <= 900 else -0.08
        return round(max(0.0, min(1.0, s)), 6)

    want, used = {}, set()
    for p in plans:
        free = [e for e in elevations if e[0] == p[0] and e[3] == p[3] and (e[0], e[1]) not in used]
        same = [e for e in free if e[4] == p[4] and score(p, e) > 0]
        pool = same or [e for e in free if score(p, e) >= 0.68]
        best = max(pool, key=lambda e: (score(p, e), -e[2]), default=None)
        if best:
            used.add((best[0], best[1]))
        want[(p[0], p[1])] = best[1] if best else None
    return want


def random_views(seed, groups, n, far, marks, widths, kinds=("door", "window"), sides=("south", "north")):
    rng = random.Random(seed)
    return tuple([(k, i, i, rng.choice(kinds), rng.choice(sides), rng.choice(marks), rng.choice(widths), rng.choice([2100.0, 1500.0, None]), rng.choice([None, *[rng.uniform(0, far)] * 6]))
                  for k in range(groups) for i in range(n + extra)] for extra in (0, 3))


@pytest.mark.parametrize("seed, far, look", [(4, 6000, 1), (5, 200_000, 3)])
def test_view_matching_against_serial(spark, seed, far, look):
    plans, elevations = random_views(seed, 4, 22, far, ["M1", "M2", "C1", ""], [900.0, 1000.0, 1500.0, None])
    a, b = (plans, elevations) if seed % 2 else (elevations, plans)
    found = m.match_views(views(spark, a), views(spark, b), look=look)
    assert {(r["project_id"], r["plan_id"]): r["elevation_id"] for r in rows(found)} == serial_views(a, b)


def test_a_large_facade_without_marks_lists_few_pairs(spark, monkeypatch):
    n = 700
    rng = random.Random(8)
    plans, elevations = ([(1, i, i, "window", "south", "", rng.choice([900.0, 1500.0, 2400.0]), 1500.0, None) for i in range(n)] for _ in range(2))
    listed = []

    def counted(prefs, *how):
        listed.append(prefs.count())
        return match_serial(prefs, *how)

    match_serial = m.match_serial
    monkeypatch.setattr(m, "match_serial", counted)
    found = {(r["project_id"], r["plan_id"]): r["elevation_id"] for r in rows(m.match_views(views(spark, plans), views(spark, elevations)))}
    assert found == serial_views(plans, elevations) and max(listed) < 40 * n


def test_back_fill(spark):
    schema = "project_id int, id int, kind string, sill_mm double, height_mm double, mark string, category string"
    plan = spark.createDataFrame([(1, 1, "window", None, None, "", "unknown"), (1, 2, "window", None, None, "", "unknown"), (1, 3, "door", None, 2000.0, "", "unknown")], schema)
    elev = spark.createDataFrame([(1, 11, "window", 900.0, 1500.0, "C1515", "casement_window"), (1, 12, "window", 800.0, 1400.0, "", ""), (1, 13, "door", None, 2100.0, "", "")], schema)
    links = spark.createDataFrame([(1, 1, 11, "window", "matched", 0.9), (1, 2, 12, "window", "needs_review", 0.5), (1, 3, 13, "door", "needs_review", 0.5)], "project_id int, plan_id int, elevation_id int, opening_kind string, match_status string, score double")
    found = {r["id"]: r for r in rows(m.back_fill(plan, links, elev))}
    assert (found[1]["sill_mm"], found[1]["height_mm"], found[1]["mark"], found[1]["category"]) == (900, 1500, "C1515", "casement_window")
    assert found[2]["height_mm"] is None and found[2]["elevation_id"] is None
    assert found[3]["height_mm"] == 2100 and found[3]["height_original"] == 2000 and found[3]["height_source"].endswith("needs_review")


def test_swing_door(spark):
    arcs = spark.createDataFrame([(1, 1, 1, 1, "A-DOOR", 1000.0, 100.0, 900.0, 0.0, 90.0)], "project_id int, drawing_id int, id int, ord int, layer string, cx double, cy double, radius double, a0 double, a1 double")
    leaf = lines(spark, [(1000, 100, 1000, 1000), (1020, 100, 1020, 1000)], "A-DOOR")
    walls = spark.createDataFrame([(1, 1, "W1", 1, 0.0, 100.0, 5000.0, 100.0, 5000.0, 200.0), (1, 1, "W2", 2, 900.0, 0.0, 900.0, 3000.0, 3000.0, 200.0)], "project_id int, drawing_id int, id string, ord int, x1 double, y1 double, x2 double, y2 double, len double, normalized_width double")
    found = rows(op.swing_doors(op.arcs_with_leaves(arcs, leaf), walls))
    assert len(found) == 1 and (found[0]["x"], found[0]["y"]) == (1450, 100) and found[0]["category"] == "single_swing_door"
    assert found[0]["open_direction"] == "north" and found[0]["panel_thickness"] == 20


def test_opening_stages(spark):
    window = [(0, 0, 1500, 0), (0, 100, 1500, 100), (0, 200, 1500, 200)]
    wl = lines(spark, window, "A-WINDOW")
    walls = spark.createDataFrame([(1, 1, "W1", 1, -3000.0, 100.0, 5000.0, 100.0, 8000.0, 200.0)], "project_id int, drawing_id int, id string, ord int, x1 double, y1 double, x2 double, y2 double, len double, normalized_width double")
    poly = spark.createDataFrame([], "project_id int, drawing_id int, id int, ord int, layer string, closed boolean, points array<struct<x:double,y:double>>")
    arcs = spark.createDataFrame([], "project_id int, drawing_id int, id int, ord int, layer string, cx double, cy double, radius double, a0 double, a1 double")
    blocks = spark.createDataFrame([(1, 1, 5, 5, "0", "M0921", [], 4000.0, 100.0, 3550.0, 0.0, 4450.0, 200.0)], "project_id int, drawing_id int, id int, ord int, layer string, name string, block_layers array<string>, x double, y double, x0 double, y0 double, x1 double, y1 double")
    found = {r["source"]: r for r in rows(op.recognize_openings(wl, poly, arcs, blocks, walls))}
    assert set(found) == {"parallel_window_lines", "block"}
    assert (found["parallel_window_lines"]["x"], found["parallel_window_lines"]["y"], found["parallel_window_lines"]["width"]) == (750, 100, 1500)
    assert (found["block"]["kind"], found["block"]["width"], found["block"]["height_mm"], found["block"]["host_wall_id"]) == ("door", 900, 2100, "W1")


def test_door_frames_merge(spark):
    names = ["id", "ord", "kind", "x", "y", "width", "layer", "source", "category", "confidence", "host_wall_id"]
    data = [("1", "a", "door", 0.0, 0.0, 900.0, "D", "layer_line", "unknown", 0.9, None), ("2", "b", "door", 900.0, 0.0, 900.0, "D", "layer_line", "unknown", 0.8, None), ("3", "c", "door", 9000.0, 0.0, 900.0, "D", "layer_line", "unknown", 0.9, None)]
    df = spark.createDataFrame([(1, 1, *r) for r in data], "project_id int, drawing_id int, id string, ord string, kind string, x double, y double, width double, layer string, source string, category string, confidence double, host_wall_id string")
    schema = "project_id int, drawing_id int, id string, ord int, x1 double, y1 double, x2 double, y2 double, len double, normalized_width double"
    far = spark.createDataFrame([(1, 1, "W9", 1, 0.0, 90000.0, 10.0, 90000.0, 10.0, 100.0)], schema)
    merged = rows(op.merge_door_frames(op._shaped(df, K), far))
    assert sorted((r["source"], r["x"], r["width"]) for r in merged) == [("layer_line", 9000, 900), ("merged_adjacent_door_frames", 450, 1800)]
    between = spark.createDataFrame([(1, 1, "W1", 1, 450.0, -100.0, 450.0, 100.0, 200.0, 100.0)], schema)
    assert len(rows(op.merge_door_frames(op._shaped(df, K), between))) == 3
    assert len(names) == 11


def test_stair_clusters_and_parameters(spark):
    steps = [(0, y, 1200, y) for y in range(0, 2700, 270)] + [(20000, 0, 20100, 0)]
    found = st.line_clusters(st.stair_lines(lines(spark, steps, "A-STAIR")))
    sizes = {r["cluster"]: r["count"] for r in rows(found.groupBy("cluster").count())}
    assert sorted(sizes.values()) == [1, 10]
    best = rows(st.best_clusters(found))[0]
    assert best["lines"] == 10 and (best["x1"], best["y1"]) == (1200, 2430)
    assert rows(st.horizontal_steps(found))[0]["treads"] == 8
    facts = spark.createDataFrame([(270.0, None, None, 150.0, None, None, 3000.0, None, None, 16, 18, 1200.0, 160.0, None, 1200.0, True, True, 30)],
                                  "text_tread double, dim_tread double, geo_tread double, text_riser double, dim_riser double, geo_riser double, text_rise double, dim_rise double, step_count int, geo_treads int, geo_risers int, width double, stairwell double, landing_length double, landing_width double, is_detail boolean, has_box boolean, lines int")
    r = rows(st.stair_parameters(facts))[0]
    assert (r["risers"], r["treads"], r["run_length_mm"], r["total_run_mm"], r["needs_review"]) == (20, 16, 2160, 5520, False)


def test_railing_pair_and_duplicates(spark):
    data = [(0, 0, 3000, 0), (0, 60, 3000, 60), (0, 2000, 3000, 2000)]
    found = sorted(rows(st.pair_railings(lines(spark, data, "RAILING"))), key=lambda r: r["id"])
    assert [(r["source"], r["y1"]) for r in found] == [("paired_railing_lines", 30), ("single_railing_line", 2000)]


def test_slab_loop(spark):
    data = [(0, 0, 4000, 0), (4000, 3000, 0, 3000), (4010, 0, 4000, 3000), (0, 3000, 0, 15), (9000, 0, 9500, 0)]
    df = spark.createDataFrame([(1, 1, i, i, "BALCONY-SLAB", *map(float, d)) for i, d in enumerate(data)], "project_id int, drawing_id int, id int, ord int, layer string, x1 double, y1 double, x2 double, y2 double")
    found = {r["closed"]: r for r in rows(st.slab_loops(df))}
    assert len(found[True]["boundary"]) == 4 and found[True]["floor_type"] == "balcony_slab" and found[False]["needs_review"]


def test_slab_outline_of_many_corners(spark):
    rng, n = random.Random(5), 500
    ring = [(round(1e6 + 40000 * math.cos(2 * math.pi * i / n)), round(2e6 + 30000 * math.sin(2 * math.pi * i / n))) for i in range(n)]
    sides = [(ring[i], ring[(i + 1) % n]) for i in range(n)]
    # The first edge keeps its direction, the others come in any order and direction; a stray edge makes the second ring open.
    drawn = [sides[0]] + [s if rng.random() < 0.5 else s[::-1] for s in rng.sample(sides[1:], n - 1)]
    square = [((0, 0), (900, 0)), ((900, 0), (900, 900)), ((900, 900), (0, 900)), ((0, 900), (0, 0)), ((0, 0), (-500, -500))]
    df = spark.createDataFrame([(1, 1, i, i, "SLAB", *map(float, a + b)) for i, (a, b) in enumerate(drawn + square)], "project_id int, drawing_id int, id int, ord int, layer string, x1 double, y1 double, x2 double, y2 double")
    found, corners = st.slab_outlines(df)
    got = sorted((r["position"], r["x"], r["y"]) for r in rows(corners))
    assert got == [(i, *p) for i, p in enumerate(ring)]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in sides)) / 2
    assert {r["closed"]: (r["area"], r["source_geometry_count"]) for r in rows(found)} == {True: (area, n), False: (None, 5)}
    assert rows(st.slab_outlines(df.limit(0))[1]) == []


def test_folded_void(spark):
    box = [(0, 0, 1000, 0), (0, 1000, 1000, 1000), (0, 0, 0, 1000), (1000, 0, 1000, 1000), (100, 100, 500, 900), (500, 900, 900, 100)]
    ln = lines(spark, box, "A-HOLE")
    rects = rc.line_rectangles(ln).withColumn("id", F.lit(1))
    poly = spark.createDataFrame([], "project_id int, drawing_id int, id int, closed boolean, points array<struct<x:double,y:double>>")
    assert rows(rc.folded_voids(rects, ln, poly))[0]["fold_count"] == 2
    assert rows(rc.folded_voids(rects, lines(spark, box[:5], "A-HOLE"), poly)) == []


def test_elevation_openings(spark):
    box = [(1000, 900, 2200, 900), (1000, 2400, 2200, 2400), (1000, 900, 1000, 2400), (2200, 900, 2200, 2400), (4000, 0, 4900, 0), (4000, 2100, 4900, 2100), (4000, 0, 4000, 2100), (4900, 0, 4900, 2100)]
    ln = lines(spark, box, "A-WINDOW")
    vee = lines(spark, [(1100, 1000, 1600, 2300), (1600, 2300, 2100, 1000)], "0").withColumn("id", F.col("id") + 100)
    walls = lines(spark, [(0, 0, 9000, 0), (0, 0, 0, 3000)])
    blocks = spark.createDataFrame([], "project_id int, drawing_id int, ord int, layer string, kind string, category string, x0 double, y0 double, x1 double, y1 double")
    found = rc.window_categories(rc.elevation_openings(ln, blocks, walls), ln.unionByName(vee))
    got = {r["kind"]: r for r in rows(found)}
    assert (got["window"]["sill_mm"], got["window"]["height_mm"], got["window"]["category"]) == (900, 1500, "casement_window")
    assert (got["door"]["width"], got["door"]["sill_mm"]) == (900, 0)


def test_ids_keep_all_digits(spark):
    df = spark.range(1).selectExpr("12345 as a", "7 as b")
    assert rows(df.select(v.padded(F.col("a"), 4).alias("a"), v.padded(F.col("b"), 4).alias("b"))) == [{"a": "12345", "b": "0007"}]


def test_hosts_have_no_distance_limit(spark):
    walls = spark.createDataFrame([(1, 1, "W1", 1, 0.0, 0.0, 5000.0, 0.0, 5000.0, 200.0)], "project_id int, drawing_id int, id string, ord int, x1 double, y1 double, x2 double, y2 double, len double, normalized_width double")
    points = spark.createDataFrame([(1, 1, 1, 0.0, 100.0), (1, 1, 2, 0.0, 3e10)], "project_id int, drawing_id int, id int, x double, y double")
    found = {r["id"]: r for r in rows(w.host_walls(points, walls, K))}
    assert found[1]["host_distance"] == 100 and found[2]["host_wall_id"] == "W1" and found[2]["host_distance"] == 3e10


def test_all_conflicts_unless_a_report_asks_for_fewer(spark):
    from draftloom.operators import audit as a

    need = spark.createDataFrame([(1, "door_width", "doors", 900.0, "mm", 5.0)], "project_id int, rule string, component_group string, value double, unit string, tolerance double")
    values = spark.createDataFrame([(1, i, i, "door_width", 800.0) for i in range(30)], "project_id int, id int, ord int, rule string, actual double")
    assert a.requirement_conflicts(need, values, ["project_id"]).count() == 30
    assert a.requirement_conflicts(need, values, ["project_id"], stop=25).count() == 25


@pytest.mark.parametrize("seed", range(3))
def test_retrieved_cases_as_by_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(40)]

    def text():
        return " ".join(["Every", *rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(0, 12))])

    cases = [(i, text(), rng.choice([None, 1, 2, 3])) for i in range(60)] + [(60, None, 3), (61, "", 1)][: 2 * (seed == 2)]
    queries = [(i, text()) for i in range(20)] + [(20, "every"), (21, "nothing known"), (22, None), (23, "word39 word38")]
    got = {(r.query_id, r.rank): (r.case_id, r.score) for r in cp.retrieve_cases(spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(cases, "case_id int, text string, created_at int")).collect()}
    want = {}
    for q, asked in queries:
        shared = [(c, len(set((asked or "").lower().split()) & set((held or "").lower().split())), at or 0) for c, held, at in cases]
        for n, (c, score, _) in enumerate(sorted((s for s in shared if s[1]), key=lambda s: (-s[1], -s[2], s[0]))[:3]):
            want[q, n + 1] = (c, score)
    assert got == want
