"""Set-based forms against plain serial versions on random rows."""

import random

import pytest
from pyspark.sql import functions as F

from draftloom.operators import ordered
from draftloom.operators.ordered import components, first_wins, match_greedy, match_serial, mode, number_rows, seeds, suppress
from draftloom.operators.spatial import box_join, islands, nearest
from draftloom.operators.walls import host_walls

KEYS = ["k"]


def rows(df):
    return [r.asDict() for r in df.collect()]


def instances(seed, n=12):
    rng = random.Random(seed)
    return [(k, rng) for k in range(n)]


def test_suppress(spark):
    nodes, edges, want = [], [], {}
    for k, rng in instances(1, 25):
        size = rng.randint(1, 14)
        order = rng.sample(range(100), size)
        links = {(i, j) for i in range(size) for j in range(size) if order[i] < order[j] and rng.random() < 0.3}
        nodes += [(k, i, order[i]) for i in range(size)]
        edges += [(k, i, j) for i, j in links]
        kept = []
        for i in sorted(range(size), key=lambda i: order[i]):
            rivals = [j for j in kept if (j, i) in links]
            if not rivals:
                kept.append(i)
            want[(k, i)] = rivals[0] if rivals else None
    got = suppress(spark.createDataFrame(nodes, "k int, id int, ord int"), spark.createDataFrame(edges, "k int, early int, late int"), KEYS)
    assert {(r["k"], r["id"]): r["duplicate_of"] for r in rows(got)} == want
    assert all(r["kept"] == (r["duplicate_of"] is None) for r in rows(got))


def serial_suppress(order, links):
    """The first kept earlier rival of every row, by the plain loop over (node -> order, earlier rivals)."""
    kept, want = set(), {}
    for i in sorted(order, key=order.get):
        rivals = sorted((j for j in links.get(i, ()) if j in kept), key=order.get)
        want[i] = rivals[0] if rivals else None
        if not rivals:
            kept.add(i)
    return want


@pytest.mark.parametrize("shape", ["dense", "chains", "trees", "twins"])
def test_suppress_equals_the_serial_scan(spark, shape):
    rng = random.Random(shape)
    size = 400
    order = {i: n for n, i in enumerate(rng.sample(range(size), size))}
    ranked = sorted(order, key=order.get)
    links = {}
    for n, i in enumerate(ranked[1:], 1):
        back = {"dense": [rng.randrange(n) for _ in range(rng.randrange(0, 5))], "chains": [n - 1] if rng.random() < 0.98 else [], "trees": [rng.randrange(n)],
                "twins": [n - 1, n - 2][:n] if rng.random() < 0.6 else [n - 1]}[shape]
        links[i] = {ranked[j] for j in back}
    nodes = spark.createDataFrame([(1, i, o) for i, o in order.items()], "k int, id int, ord int")
    edges = spark.createDataFrame([(1, j, i) for i, js in links.items() for j in js], "k int, early int, late int")
    assert {r["id"]: r["duplicate_of"] for r in rows(suppress(nodes, edges, KEYS))} == serial_suppress(order, links)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 100_000
    written = []

    def counted(df):
        written.append(1)
        return checkpoint_path(df)

    checkpoint_path = ordered.checkpoint_path
    monkeypatch.setattr(ordered, "checkpoint_path", counted)
    nodes = spark.range(n).select(F.lit(1).alias("k"), "id", F.col("id").alias("ord"))
    edges = spark.range(n - 1).select(F.lit(1).alias("k"), F.col("id").alias("early"), (F.col("id") + 1).alias("late"))
    found = suppress(nodes, edges, KEYS)
    assert found.where((F.col("kept") != (F.col("id") % 2 == 0)) | (~F.col("kept") & (F.col("duplicate_of") != F.col("id") - 1))).count() == 0
    assert len(written) // 3 < 25 and found.count() == n


def test_match_greedy(spark):
    pairs, want = [], set()
    for k, rng in instances(2, 20):
        cand = [(rng.randint(0, 30), d, m) for d in range(6) for m in range(6) if rng.random() < 0.6]
        pairs += [(k, d, m, c) for c, d, m in cand]
        used_d, used_m = set(), set()
        for c, d, m in sorted(cand):
            if d not in used_d and m not in used_m:
                used_d.add(d), used_m.add(m)
                want.add((k, d, m))
    got = match_greedy(spark.createDataFrame(pairs, "k int, d int, m int, c int"), KEYS, "d", "m", ["c", "d", "m"])
    assert {(r["k"], r["d"], r["m"]) for r in rows(got)} == want


def test_match_serial(spark):
    prefs, want = [], set()
    for k, rng in instances(3, 20):
        free = set(range(5))
        for left in range(7):
            liked = rng.sample(range(5), rng.randint(0, 5))
            prefs += [(k, left, r, i) for i, r in enumerate(liked)]
            choice = next((r for r in liked if r in free), None)
            if choice is not None:
                free.discard(choice)
                want.add((k, left, choice))
    df = spark.createDataFrame(prefs, "k int, l int, r int, rank int").withColumn("turn", F.col("l"))
    held, _ = match_serial(df, KEYS, "l", "r", "rank", "turn")
    assert {(r["k"], r["l"], r["r"]) for r in rows(held)} == want


def test_seeds(spark):
    nodes, edges, want = [], [], set()
    for k, rng in instances(4, 25):
        size = rng.randint(2, 12)
        nodes += [(k, i, i) for i in range(size)]
        cost = {(i, j): rng.randint(0, 9) for i in range(size) for j in range(i + 1, size) if rng.random() < 0.3}
        edges += [(k, i, j, c) for (i, j), c in cost.items()]
        used = set()
        for i in range(size):
            options = sorted((cost[(i, j)], j) for j in range(i + 1, size) if (i, j) in cost and j not in used)
            if i not in used and options:
                used |= {i, options[0][1]}
                want.add((k, i, options[0][1]))
    got = seeds(spark.createDataFrame(nodes, "k int, id int, ord int"), spark.createDataFrame(edges, "k int, early int, late int, cost int"), KEYS)
    assert {(r["k"], r["seed"], r["partner"]) for r in rows(got)} == want


def test_components(spark):
    nodes, edges, want = [], [], {}
    for k, rng in instances(5, 15):
        size = rng.randint(1, 20)
        links = [(i, j) for i in range(size) for j in range(i + 1, size) if rng.random() < 0.08]
        if k == 0:
            size, links = 40, [(i, i + 1) for i in range(39)]
        nodes += [(k, i) for i in range(size)]
        edges += [(k, i, j) for i, j in links]
        root = list(range(size))
        changed = True
        while changed:
            changed = False
            for i, j in links:
                low = min(root[i], root[j])
                changed |= root[i] != low or root[j] != low
                root[i] = root[j] = low
        want.update({(k, i): root[i] for i in range(size)})
    got = components(spark.createDataFrame(nodes, "k int, id int"), spark.createDataFrame(edges, "k int, u int, v int"), KEYS)
    assert {(r["k"], r["id"]): r["component"] for r in rows(got)} == want


@pytest.mark.parametrize("ties,want", [("smallest", 2), ("largest", 5), ("first", 5)])
def test_mode(spark, ties, want):
    df = spark.createDataFrame([(1, 5, 0), (1, 2, 1), (1, 2, 2), (1, 5, 3), (1, 9, 4)], "k int, v int, o int")
    assert rows(mode(df, KEYS, "v", ties, "o"))[0]["value"] == want


def test_first_wins_and_numbers(spark):
    rng = random.Random(6)
    data = [(k, rng.randint(0, 1000), i) for i in range(300) for k in range(2)]
    df = spark.createDataFrame(data, "k int, v int, i int")
    best = {r["k"]: (r["v"], r["i"]) for r in rows(first_wins(df, KEYS, [F.col("v"), F.col("i")]))}
    assert best == {k: min((v, i) for kk, v, i in data if kk == k) for k in range(2)}
    numbered = rows(number_rows(df, KEYS, [F.col("v"), F.col("i")], F.floor(F.col("v") / 50)))
    for k in range(2):
        order = sorted((v, i) for kk, v, i in data if kk == k)
        assert [(r["v"], r["i"]) for r in sorted((r for r in numbered if r["k"] == k), key=lambda r: r["seq"])] == order


def test_islands(spark):
    rng = random.Random(7)
    data, want = [], []
    for k in range(8):
        spans = sorted((lo := rng.randint(0, 3000), lo + rng.randint(0, 400)) for _ in range(rng.randint(1, 25)))
        data += [(k, lo, hi) for lo, hi in spans]
        run = None
        for lo, hi in spans:
            if run is not None and lo - run[2] <= 50:
                run[2], run[3] = max(run[2], hi), run[3] + 1
            else:
                run = [k, lo, hi, 1]
                want.append(run)
    got = islands(spark.createDataFrame(data, "k int, lo int, hi int"), KEYS, "lo", "hi", 50, 300)
    assert sorted((r["k"], r["lo"], r["hi"], r["n"]) for r in rows(got)) == sorted(map(tuple, want))


def test_box_join_and_nearest(spark):
    rng = random.Random(8)

    def boxes(n):
        return [(rng.randint(0, 1), i, x := rng.uniform(-500, 500), y := rng.uniform(-500, 500), x + rng.uniform(0, 300), y + rng.uniform(0, 50)) for i in range(n)]

    a, b = boxes(60), boxes(60)
    schema = "k int, id int, x0 double, y0 double, x1 double, y1 double"
    box = ("x0", "y0", "x1", "y1")
    got = box_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), KEYS, box, box, 100.0, margin=20.0)
    want = {(p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] - 20 <= q[4] and q[2] <= p[4] + 20 and p[3] - 20 <= q[5] and q[3] <= p[5] + 20}
    found = [(r["k"], r["a_id"], r["b_id"]) for r in rows(got)]
    assert len(found) == len(set(found)) and set(found) == want
    points = spark.createDataFrame([(k, i, x0, y0) for k, i, x0, y0, *_ in a], "k int, pid int, x double, y double").dropDuplicates(["k", "pid"])
    right = spark.createDataFrame([(k, i, x0, y0, x0, y0) for k, i, x0, y0, *_ in b], "k int, id int, bx0 double, by0 double, bx1 double, by1 double")
    got = nearest(points, right, KEYS, ["pid"], ("x", "y"), ("bx0", "by0", "bx1", "by1"), F.hypot(F.col("x") - F.col("r_bx0"), F.col("y") - F.col("r_by0")), (30.0, 120.0, 400.0), [F.col("r_id")], k=3)
    have = {}
    for r in rows(got):
        have.setdefault((r["k"], r["pid"]), []).append((r["_rank"], r["r_id"]))
    for r in rows(points):
        near = sorted((((r["x"] - q[2]) ** 2 + (r["y"] - q[3]) ** 2) ** 0.5, q[1]) for q in b if q[0] == r["k"])
        assert [i for _, i in sorted(have.get((r["k"], r["pid"]), []))] == [i for d, i in near if d <= 400][:3]


def test_host_walls(spark):
    rng = random.Random(9)
    walls, points, want = [], [], {}
    for k in range(30):
        mine = []
        for i in range(rng.randint(0, 30)):
            x, y, size = rng.uniform(0, 3000), rng.uniform(0, 3000), rng.uniform(100, 3000)
            flat = rng.random() < 0.5
            w = (k, i, i, x, y, x + (size if flat else 0), y + (0 if flat else size), size)
            mine.append(w)
        walls += mine
        for p in range(4):
            px, py = rng.uniform(0, 3000), rng.uniform(0, 3000)
            points.append((k, p, px, py))
            best = None
            for w in mine:
                cx, cy = min(max(px, w[3]), w[5]), min(max(py, w[4]), w[6])
                d = round(((px - cx) ** 2 + (py - cy) ** 2) ** 0.5, 6)
                if best is None or d < best[0] - 50 or (abs(d - best[0]) <= 50 and w[7] > best[1]):
                    best = (d, w[7], w[1])
            want[(k, p)] = best[2] if best else None
    w = spark.createDataFrame(walls, "k int, id int, ord int, x1 double, y1 double, x2 double, y2 double, len double")
    got = host_walls(spark.createDataFrame(points, "k int, id int, x double, y double"), w, KEYS)
    assert {(r["k"], r["id"]): r["host_wall_id"] for r in rows(got)} == want
