from pyspark.sql import functions as F

from draftloom.llm import secrets as S

FORMATS = r'AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}|token = "[0-9a-f]{40}"'


def test_candidates_and_neighbours(make):
    docs = make([(1, 'set token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" now', "en", "a/test.py"), (2, "my password=hunter22 here or password: swordfish", "en", "a"),
                 (3, "call 555-3733 or 42.144.35.254, v2.0. and the end", "en", None), (4, "nothing here", "en", "a")])
    got = {(r.key, r.candidate): r for r in S.candidates(docs).collect()}
    assert {c for k, c in got if k == 1} == {"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"}
    first = got[1, "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"]
    assert (first.before_2, first.before, first.after, first.path, first.place) == ("token", "=", "now", "a/test.py", 3)
    assert {c for k, c in got if k == 2} == {"hunter22", "swordfish"} and {c for k, c in got if k == 3} == {"555-3733", "42.144.35.254"}


def test_every_value_of_a_word_with_its_key(spark, make):
    aws, hub, digest = "AKIA" + "Q7ZX2M4K" * 2, "ghp_" + "a8Kd03Lw" * 5, "9f86d081884c7d659a2feaa0c55ad015"
    texts = {f'{{"api_key":"{aws}","token":"{hub}"}}': {("api_key", aws), ("token", hub)}, "S3_SECRET_KEY=wJalrXUtnFEMIK7MDENG": {("S3_SECRET_KEY", "wJalrXUtnFEMIK7MDENG")},
             f"OAUTH2_TOKEN={digest}": {("OAUTH2_TOKEN", digest)}, "postgres://admin:Pa55w0rd@db.example/x": {("://admin", "Pa55w0rd")}, f"a=1&token={digest}": {("token", digest)},
             f"https://h.example/cb?token={digest}&u=2": {("token", digest)}, '{"password":"swordfish"}': {("password", "swordfish")}, "at 2024-01-05T10:30:00.123456Z": {("", "2024-01-05T10"), ("", "00.123456Z")},
             "x" * 5000 + f",token={digest};" + "y" * 5000: {("token", digest)}, f"a/b/secret={digest}==": {("a/b/secret", digest + "==")}}
    rows = S.candidates(make([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    for i, (text, want) in enumerate(texts.items()):
        assert {(r.own_key.rstrip("\"':="), r.candidate) for r in rows if r.key == i} == want, text
    clean = S.redact(make([(i, f'{{"id":{i},"api_key":"{aws}","token":"{hub}"}} u=1&token={digest}', "en", "s") for i in range(30)]))
    assert not any(x in r.text for r in clean.collect() for x in (aws, hub, digest))


def test_features(spark, make):
    docs = make([(i, "alpha beta gamma alphabet", "en", "s") for i in range(3)])
    found = spark.createDataFrame([("alphaBeta12", "key=", "x", "y", "z", "p"), ("9f86d081884c7d65", "", "", "", "", "test/p")], ", ".join(f"{c} string" for c in S.COLUMNS))
    got = {r.candidate: r for r in S.features(found, S.dictionary(docs)).collect()}
    a, b = got["alphaBeta12"], got["9f86d081884c7d65"]
    assert a.length == 11 and abs(a.digits - 2 / 11) < 1e-9 and a.changes * 11 == 3 and a.assigned == a.credential == 1 and b.hex == 1 and b.path_made_up == 1
    assert a.pairs > b.pairs and a.covered == 0


def test_forest_on_given_labels(spark, make):
    docs = make([(i, f"key{i} password=Zq8vN2xW{i:04d}pL id 2024-01-{i % 28 + 1:02d}T10 end", "en", "s") for i in range(60)])
    labelled = S.candidates(docs).withColumn("is_secret", F.col("own_key").rlike("password").cast("double"))
    out = S.scan(docs, labelled).collect()
    assert len(out) >= 120 and all(r.is_secret == r.candidate.startswith("Zq8v") for r in out)


def test_known_formats_in_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = S.scan(docs)
    planted = F.col("candidate").rlike("^AKIA[A-Z0-9]{16}$|^[0-9a-f]{18}$|^[0-9a-f]{40}$")
    assert out.where(planted & ~F.col("is_secret")).count() == 0
    assert out.where(~planted & F.col("is_secret")).count() <= 0.05 * out.count()
    clean = S.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert docs.where(F.col("text").rlike(FORMATS)).count() > 0 == clean.where(F.col("text").rlike(FORMATS)).count()
    same = docs.where(~F.col("text").rlike(FORMATS)).join(clean.withColumnRenamed("text", "t"), "doc_id").where(F.col("text") == F.col("t")).count()
    assert same >= 0.99 * docs.where(~F.col("text").rlike(FORMATS)).count()


def test_masks_stand_where_the_secrets_stood(make):
    digest = "9f86d081884c7d659a2feaa0c55ad015"
    texts = ["password=test then the latest tests attest it", "  test_password=test\t\nuser  password: test  the test ", f"token={digest} again {digest}x end", "see postgres://admin:pass@db.example/pass now",
             "\x01password=test and test", "password=test", "password: test"]
    docs = make([(None if i == 1 else 7, t, "en", "s") for i, t in enumerate(texts)] + [(7, "the test goes on", "en", "s"), (None, "test", "en", "s")])
    labelled = S.candidates(make([(i, f"{k}key{i} password=Zq8vN2xW id 2024-01-{i % 28 + 1:02d}T10", "en", "s") for i, k in enumerate("ab" * 10)])).withColumn("is_secret", F.lit(1.0))
    got = {r.text for r in S.redact(docs, labelled).collect()}
    M = S.MASK
    assert got == {f"password={M} then the latest tests attest it", f"  test_password={M}\t\nuser  password: {M}  the test ", f"token={M} again {M} end", f"see postgres://admin:{M}@db.example/pass now",
                   f"\x01password={M} and test", f"password={M}", f"password: {M}", "the test goes on", "test"}


def test_odd_rows(odd, make):
    assert S.redact(odd).columns == odd.columns and S.redact(odd).count() == 9
    assert S.scan(odd.limit(0)).count() == 0 and S.redact(odd.limit(0)).count() == 0
    secret = "token = 1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"
    docs = make([(1, secret, "en", None), (1, secret, "en", None), (None, f"a {secret} {secret}", None, "s"), (2, None, "en", "s"), (3, "x" * 100_000 + " " + secret, "en", "s")])
    rows = S.redact(docs).collect()
    assert len(rows) == 5 and not any("1beb58b8" in (r.text or "") for r in rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
