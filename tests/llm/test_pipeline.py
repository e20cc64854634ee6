from collections import Counter

import corpus_pipeline as C
from draftloom.llm import bins, simhash


def brute_groups(rows):
    """Smallest id of each near-duplicate group, by comparing all pairs of fingerprints."""
    marks = [(r.doc_id, simhash.fingerprint(r.text) & (1 << 64) - 1) for r in rows]
    root = {d: d for d, _ in marks}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(marks):
        for b, y in marks[:i]:
            if (x ^ y).bit_count() <= simhash.DISTANCE:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {find(d) for d, _ in marks}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        stage(spark, docs, "/root/testdata/sf0.01").write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            assert docs.count() == before.count()
        if name == "near_dedup":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == brute_groups(before.select("doc_id", "text").collect())
        if name == "secret_scan":
            assert docs.count() == before.count() and docs.where("text like '%[SECRET]%'").count() > 0
    mixed = Counter(r.doc_id for r in seen["mixing"].select("doc_id").collect())
    assert max(mixed.values()) == 2 and len(mixed) > 0.5 * seen["secret_scan"].count()
    packed = Counter()
    for r in seen["packing"].collect():
        assert r.capacity in bins.CAPACITIES and r.used <= r.capacity
        packed.update(d for d, p in zip(r.doc_ids, r.parts) if p == 0)
    assert packed == mixed


def test_names_and_guard():
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "secret_scan", "mixing", "packing"]
    import __spark_entry__ as entry

    names = entry.queries()
    assert names.keys() >= {"pipeline"} and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_near_dedup_sends_no_exploded_rows_to_the_driver(spark, monkeypatch):
    plans, links = [], simhash.links

    def seen(*args):
        found = links(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(simhash, "links", seen)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert C.near_dedup(spark, docs, "").count() <= docs.count()
    assert len(plans) == 1 and "BroadcastHashJoin" not in plans[0]
