import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftloom.llm import codes as C

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Rows (id, code, error, label_error, sha) in Python's whole numbers."""
    kept = [(i, [int(np.floor(4096 * x)) for x in v], label) for i, v, label in rows]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def near(c, book):
        d = [sum((a - b) ** 2 for a, b in zip(c, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            owned = {}
            for c in cut:
                owned.setdefault(near(c[p], books[p])[0], []).append(c[p])
            for e, members in owned.items():
                books[p] = [*books[p][:e], [sum(x) // len(members) for x in zip(*members)], *books[p][e + 1:]]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, labels = [], {}
    for (i, _, label), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        error = sum(d for _, d in found)
        labels[label] = labels.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
    return sorted([(i, code, error, labels[label], sha) for i, code, error, label in out], key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()], key=repr)


def cloud(seed, n=400, d=32):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((20, d))
    return [(i, (middle[i % 20] + 0.3 * rng.standard_normal(d)).tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]


def test_equals_plain_lloyd(spark):
    rows = cloud(1)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert got(C.compress(table)) == want
    # Salted owners and small groups give the same.
    assert got(C.compress(table, members_held=3)) == want


def test_ties_hot_vectors_and_unused_entries(spark):
    # Whole steps of 1 / 4096 and few values: many ties, copies of one vector and entries that lose all their members.
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-2, 3, 16) / 4096).tolist(), 0) for i in range(120)] + [(1000 + i, [0.5] * 16, 1) for i in range(200)] + [(i, [0.25] * 16, 0) for i in range(-5, 0)]
    assert got(C.compress(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_vectors(spark):
    good = cloud(3, 40, 16)
    bad = [(100, None, 0), (101, [], 0), (102, [float("nan")] * 16, 0), (103, [float("inf")] * 16, 0), (104, [None] + [1.0] * 15, 0), (105, [1.0] * 8, 0), (106, [1.0] * 7, 0), (107, [1e300] + [0.0] * 15, 0)]
    fine = [(None, [1.0] * 16, None), (3, good[3][1], 2), (3, [2.0] * 16, 2), (200, [0.0] * 16, 1), (201, [-0.0] * 16, 1)]
    table = spark.createDataFrame(good + bad + fine, SCHEMA).withColumn("row", F.lit("clash")).withColumn("c", F.lit("clash")).withColumn("error", F.lit("clash"))
    assert got(C.compress(table)) == brute(good + fine)
    assert C.compress(table.limit(0)).collect() == [] and C.compress(spark.createDataFrame(bad[:5], SCHEMA)).collect() == []
    assert got(C.compress(spark.createDataFrame(good[:3], SCHEMA))) == brute(good[:3])


def test_numbers_that_pass_64_bits_on_the_way(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(16) * 1e5).tolist(), i % 2) for i in range(60)]
    want = brute(rows)
    assert max(r[2] for r in want) > 2**53
    assert got(C.compress(spark.createDataFrame(rows, SCHEMA))) == want
    huge = [(i, [(-1.0) ** i * 2.0**49 + i] * 16, 0) for i in range(30)]
    exact = {r[0]: min(r[2], 2**63 - 1) for r in brute(huge)}
    out = got(C.compress(spark.createDataFrame(huge, SCHEMA), entries=2))
    exact = {r[0]: min(r[2], 2**63 - 1) for r in brute(huge, entries=2)}
    assert {r[0]: r[2] for r in out} == exact


def test_rounds_stop_when_books_repeat(spark):
    rows = cloud(5, 60, 16)
    kept = C.whole_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label")
    books = C.first_books(kept)
    settled = C.train(kept, books, rounds=60)
    assert (C.train(kept, settled, rounds=1) == settled).all()


def test_codes_have_two_digits(spark):
    with pytest.raises(ValueError):
        C.compress(spark.createDataFrame([], SCHEMA), entries=257)
