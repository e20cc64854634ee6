import random

import xxhash

from draftloom.llm import simhash as S


def plain(text):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def groups(values, distance=4):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin((values[i] ^ values[j]) & (1 << 64) - 1).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints(spark, make):
    rng = random.Random(1)
    texts = [None, "", " \n", "Ab", "a b c", "A b C d", "ÄÖ ß\tx y z z z", *(" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (5, 9, 70, 900))]
    docs = make([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r.fingerprint for r in S.components(docs).collect()}
    assert got == {i: f"{plain(t):016x}" for i, t in enumerate(texts)}
    spark_hash = spark.sql("select hex(xxhash64('a b c')) as h").first().h
    assert int(spark_hash, 16) == xxhash.xxh64_intdigest(b"a b c", 42)


def nodes(spark, values):
    return spark.createDataFrame([(signed(v), i) for i, v in enumerate(values)], "simhash long, doc_id long")


def near_values(rng, n):
    values = []
    while len(values) < n:
        v = rng.getrandbits(64)
        values.append(v)
        for _ in range(rng.randint(0, 6)):
            for b in rng.sample(range(64), rng.randint(0, 6)):
                v ^= 1 << b
            values.append(v)
    return values[:n]


def test_groups_equal_brute_force(spark):
    rng = random.Random(2)
    for dense in (S.DENSE, 1):
        values = near_values(rng, 160 if dense == 1 else 500)
        got = {r.simhash: r.component for r in S.near_duplicates(nodes(spark, values), dense=dense).collect()}
        assert [got[signed(v)] for v in values] == groups(values)


def test_every_pair_is_found(spark):
    rng = random.Random(4)
    values = sorted({signed(v) for v in near_values(rng, 400)})
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    got = {(r.a, r.b) for r in S.links(spark.createDataFrame([(v,) for v in values], "f long")).collect()}
    assert got == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in S.connected(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_odd_rows(odd):
    out = S.components(odd)
    assert out.count() == 9
    got = {(r.doc_id, r.component_id) for r in out.collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, None)} <= got
    kept = S.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 4), (False, 6), (False, 7), (True, None)]
    assert S.components(odd.limit(0)).count() == 0 and S.deduplicate(odd.limit(0)).count() == 0


def test_exploded_rows_are_not_broadcast(spark, tmp_path):
    spark.range(300).selectExpr("(id % 150) * 977 + id div 150 as f").write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    f = sorted(r.f for r in nodes.collect())
    brute = {(a, b) for i, b in enumerate(f) for a in f[:i] if (a ^ b).bit_count() <= S.DISTANCE}
    links = S.links(nodes)
    assert "BroadcastHashJoin" not in links._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b) for r in links.collect()} == brute
    midpoints = S._midpoint_links(nodes, S.DISTANCE)
    assert "BroadcastHashJoin" not in midpoints._jdf.queryExecution().executedPlan().toString()
