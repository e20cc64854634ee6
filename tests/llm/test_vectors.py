import numpy as np
from pyspark.sql import functions as F

from draftloom.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    d[ids == q] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in order if np.isfinite(d[i])]


def test_estimate_is_within_its_bound():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 48))
    turn, centre = V.rotation(48), x.mean(axis=0)
    assert np.allclose(turn @ turn.T, np.eye(48))
    code, norm, correction = V.encode(x, centre, turn)
    signs = (np.unpackbits(code, axis=1, count=48) * 2.0 - 1) / np.sqrt(48)
    query = rng.standard_normal(48)
    query /= np.sqrt((query**2).sum())
    estimate = signs @ (query @ turn) / correction
    true = ((x - centre) / norm[:, None]) @ query
    bound = V.BOUND * np.sqrt((1 - correction**2) / correction**2 / 47)
    assert (np.abs(estimate - true) <= bound).mean() > 0.98
    assert abs((estimate - true).mean()) < 0.01


def test_recall_and_exact_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.orderBy("vec_id").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    got = {}
    for r in V.search(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [i for i in ids if i % 100 == 0]
    found = 0
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 11))
        want = brute(ids, x, q)
        found += len({h[1] for h in hits} & {w[0] for w in want})
        exact = np.sqrt(((x[np.searchsorted(ids, [h[1] for h in hits])] - x[ids == q][0]) ** 2).sum(axis=1))
        assert np.allclose([h[2] for h in hits], exact, rtol=1e-12) and (np.diff(exact) >= 0).all()
    assert found >= 0.98 * 10 * len(got)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(4).tolist(), 0) for i in range(0, 30)]
    rows = good + [(100, None, 0), (200, [], 0), (300, [0.0] * 4, 0), (400, [float("nan"), 1.0, 1.0, 1.0], 0), (500, [float("inf"), 1.0, 1.0, 1.0], 0), (600, [1.0, 2.0], 0),
                   (700, [None, 1.0, 1.0, 1.0], 0), (None, [1.0] * 4, 0), (5, good[5][1], 0), (41, good[0][1], 0), (40, good[0][1], 0)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("code", F.lit("clash"))
    out = V.search(table, every=100).orderBy("rank").collect()
    assert {r.query_id for r in out} == {0} and [r.rank for r in out] == list(range(1, 11))
    # Both copies of the query tie at distance 0; the smaller id comes first.
    assert [(r.vec_id, r.score) for r in out[:2]] == [(40, 0.0), (41, 0.0)]
    assert not {r.vec_id for r in out} & {0, 100, 200, 300, 400, 500, 600, 700}
    few = V.search(spark.createDataFrame(good[:4], SCHEMA)).collect()
    assert sorted(r.rank for r in few) == [1, 2, 3]
    assert V.search(table.limit(0)).count() == 0


def test_blocks_of_queries_agree(spark):
    rng = np.random.default_rng(3)
    table = spark.createDataFrame([(i, rng.standard_normal(8).tolist(), 0) for i in range(400)], SCHEMA)
    codes, model = V.index(table)
    queries = codes.where("id % 10 = 0")
    one = V.nearest(codes, model, queries, k=5).orderBy("query_id", "rank").collect()
    assert V.nearest(codes, model, queries, k=5, block=7).orderBy("query_id", "rank").collect() == one and len(one) == 200
