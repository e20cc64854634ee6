"""Steps that grew faster than their input: same results, without what made them grow."""

import random

from draftloom.operators import components as c
from draftloom.operators import spatial as s
from draftloom.operators import stairs as st
from draftloom.sources import drawings as dw
from pyspark.sql import functions as F

K = ("k",)


def test_candidates_of_like_components_are_listed_once(spark):
    rows = spark.createDataFrame([(1, 1, 5, None), (1, 2, 5, ""), (1, 3, 5, "own.rfa"), (1, 4, 6, None), (1, 5, None, None), (1, None, 5, None), (2, 6, 5, None), (1, 1, 5, None)], "k int, id int, m int, family_file string")
    files = spark.createDataFrame([(1, 5, "a/Z.rfa", 9.0), (1, 5, "b/y.rfa", 9.0), (1, 5, "c/x.rfa", 1.0), (1, None, "n.rfa", 99.0), (2, 7, "o.rfa", 5.0)], "k int, m int, file_path string, score double")
    got = c.accept_candidates(rows, files, K, by=["m"])
    want = c.accept_candidates(rows, rows.select("k", "id", "m").distinct().join(files, ["k", "m"]).select("k", "id", "file_path", "score"), K)

    def plain(df):
        return sorted(map(str, df.where("id is not null").select("k", "id", "family_file").collect()))

    assert plain(got) == plain(want)
    assert {r.id: r.family_file for r in got.where("k = 1 and id < 5").collect()} == {1: "b/y.rfa", 2: "b/y.rfa", 3: "own.rfa", 4: None}


def test_lines_of_a_cell_hang_on_its_first_line(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(d, i, i, "A-STAIR", float(x), float(y), x + rng.choice([0.0, 900.0, 4000.0]), y + 300.0) for d in (1, 2) for i in range(30) for x, y in [(rng.randrange(30000), rng.randrange(20000))]]
    lines = st.stair_lines(spark.createDataFrame(rows, "k int, id int, ord int, layer string, x1 double, y1 double, x2 double, y2 double"), K)
    seen, inner = [], st.components
    monkeypatch.setattr(st, "components", lambda nodes, edges, keys: seen.append(edges.collect()) or inner(nodes, edges, keys))
    got = {(r.k, r.id): r.cluster for r in st.line_clusters(lines, K).collect()}
    # Edges name lines, not cells.
    assert seen[0] and {x for e in seen[0] for x in (e.u, e.v)} <= {str(i) for i in range(30)}
    boxes = {(d, i): (x1, y1, x2, y2) for d, i, _, _, x1, y1, x2, y2 in rows}

    def near(a, b):
        gx, gy = max(b[0] - a[2], a[0] - b[2], 0), max(b[1] - a[3], a[1] - b[3], 0)
        return (gx * gx + gy * gy) ** 0.5 <= 1800

    for d in (1, 2):
        groups = [[i] for i in range(30)]
        while True:
            hull = [tuple(f(boxes[d, i][n] for i in g) for n, f in enumerate((min, min, max, max))) for g in groups]
            pair = next(((p, q) for p in range(len(groups)) for q in range(p) if near(hull[p], hull[q])), None)
            if pair is None:
                break
            groups[pair[1]] += groups.pop(pair[0])
        assert {frozenset(g) for g in groups} == {frozenset(i for (k, i), v in got.items() if k == d and v == c) for c in {v for (k, _), v in got.items() if k == d}}


def test_lines_along_an_axis_are_in_one_sector(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        x, y, n = rng.randrange(8000), rng.randrange(8000), rng.randrange(500, 4000)
        rows.append((1, i, float(x), float(y), float(x + n * (i % 2)), float(y + n * (i % 2 == 0))))
    df = spark.createDataFrame(rows, "k int, id int, x1 double, y1 double, x2 double, y2 double")
    sides, inner = [], s.box_join
    monkeypatch.setattr(s, "box_join", lambda a, b, *rest, **more: sides.append((a.count(), b.count())) or inner(a, b, *rest, **more))
    close = (F.col("a_id") < F.col("b_id")) & (F.col("a_id") % 2 == F.col("b_id") % 2)
    got = {(r.a_id, r.b_id) for r in s.parallel_join(df, df, K, 4000.0, 1200.0, 500.0, 2.1, close).collect()}
    assert sides == [(60, 60)]
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[1] % 2 == b[1] % 2 and all(a[n] - 500 <= b[n + 2] and b[n] <= a[n + 2] + 500 for n in (2, 3))}
    assert got == want


def test_tags_of_a_chunk_arrive_together(spark):
    texts = {"a": "0\nSECTION\r\n 2 \r\nENTITIES\n0\nPOLYLINE\n8\nW\n0\nVERTEX\n10\n1\n20\n2\n0\nVERTEX\n10\n3\n20\n4\n0\nSEQEND\n0\nLINE\n11\n\n0\nENDSEC\n", "b": "0\n", "c": "", "d": "1", "e": None}
    files = spark.createDataFrame(list(texts.items()), "file string, value string")
    want = set()
    for f, text in texts.items():
        lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        want |= {(f, n // 3, n, lines[2 * n].strip(), lines[2 * n + 1].strip()) for n in range(len(lines) // 2)}
    tags = dw.tags_of(files, 3)
    assert {tuple(r) for r in tags.select("file", "chunk", "n", "code", "val").collect()} == want
    # The scan over chunks needs no exchange of its own.
    scanned = tags.groupBy("file", "chunk").agg(F.max_by("val", "n").alias("val"))
    assert scanned._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    rows = dw.read_entities(tags).orderBy("ord").collect()
    assert [(r.etype, r.points and [(p.x, p.y) for p in r.points]) for r in rows] == [("POLYLINE", [(1.0, 2.0), (3.0, 4.0)]), ("LINE", None)]
