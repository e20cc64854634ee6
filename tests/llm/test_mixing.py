import random

from pyspark.sql import functions as F

from draftloom.llm.mixing import mix_sources, mixed_documents, source_targets


def reshared(sizes, weights=(5, 2, 1)):
    """Targets by dealing again and again what capped sources cannot take."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        share = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * w[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets_equal_repeated_dealing(spark):
    rng = random.Random(3)
    for _ in range(5):
        sizes = {f"s{rng.random()}": rng.choice([0, 1, 7, 50, 1000, 100_000]) for _ in range(rng.randint(1, 9))}
        sizes[None] = 40
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(rows).collect()}
        want = reshared(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_takes_epochs_then_keys(make):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choice(["a", "b", None, "c"])) for i in range(600)]
    docs = make(rows)
    out = mix_sources(docs, buckets=64).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.size == len(rows[r.doc_id][1].split())
        x = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        x[0] += r.taken
        x[1] += r.size
    for taken, size, target, source_size in by.values():
        assert size == source_size and abs(taken - target) <= 1
    again = mix_sources(docs.repartition(7), buckets=8).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)
    # Partly taken: one document at most for each source, the rest all or nothing beyond the complete epochs.
    for source in by:
        size, target = by[source][1], by[source][2]
        epochs = int(target // size)
        assert sum(0 < r.taken - epochs * r.size < r.size for r in out if r.source == source) <= 1


def test_heavier_documents_come_first(make):
    docs = make([(i, "w " * 10, "en", "abc"[i % 3]) for i in range(3000)])
    out = mix_sources(docs, weight=F.when(F.col("doc_id") % 2 == 0, 8.0).otherwise(1.0)).where("target < source_size").collect()
    heavy = [r.taken / r.size for r in out if r.doc_id % 2 == 0]
    light = [r.taken / r.size for r in out if r.doc_id % 2]
    # 83 % of the source are taken: nearly all of the heavy half, two thirds of the light one.
    assert out and sum(heavy) / len(heavy) > 0.95 and sum(light) / len(light) < 0.75


def test_odd_rows(odd):
    out = mix_sources(odd, weight=F.when(F.col("doc_id") == 4, F.lit(None)).otherwise(-1.0))
    rows = out.collect()
    assert len(rows) == 9 and all(r.key == "clash" and r.size is not None for r in rows)
    assert sum(r.size for r in rows if r.doc_id == 4) == 12 and all(r.taken == 0 for r in rows if r.size == 0)
    copies = mixed_documents(out)
    assert set(copies.columns) == set(odd.columns) - {"size", "target", "taken"}
    words = sum(len((r.text or "").split()) for r in copies.collect())
    assert words == sum(r.taken for r in rows)
    assert mix_sources(odd.limit(0)).count() == 0
