import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftloom.llm import language as L


def by_hand(word, pieces, chance):
    """Sum over all segmentations, and expected piece counts, by listing them."""
    total, uses = 0.0, {}

    def walk(at, p, used):
        nonlocal total
        if at == len(word):
            total += p
            for u in used:
                uses[u] = uses.get(u, 0) + p
            return
        for i, piece in enumerate(pieces):
            if word.startswith(piece, at):
                walk(at + len(piece), p * chance[i], [*used, i])

    walk(0, 1.0, [])
    return total, {i: n / total for i, n in uses.items()}


def test_forward_and_expected_counts():
    rng = random.Random(1)
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abc", b"bc", b"cab", b"abcabcabcab"})
    lattice = L.Lattice(pieces)
    chance = np.array([[rng.random(), rng.random()] for _ in pieces]) / len(pieces)
    words = [b"abc", b"a", b"cabcab", b"zz", "é".encode(), b"abcabcabcab"]
    logs = lattice.forward(words, chance)
    for w, row in zip(words, logs):
        for k in (0, 1):
            assert np.isclose(np.exp(row[k]), by_hand(b" " + w, pieces, chance[:, k])[0])
    counts = np.array([3.0, 1, 2, 1, 1, 1])
    want = np.zeros(len(pieces))
    for w, n in zip(words, counts):
        for i, x in by_hand(b" " + w, pieces, chance[:, 0])[1].items():
            want[i] += n * x
    assert np.allclose(lattice.expected(words, counts, chance[:, :1], len(pieces)), want)


def test_scores_are_sums_over_words():
    pieces = L.read_vocabulary()
    rng = np.random.default_rng(1)
    chance = rng.random((len(pieces), 3))
    chance /= chance.sum(axis=0)
    scorer = L.Scorer(L.Model(["a", "b", "c"], pieces, chance))
    texts = ["the house the", "", "x" * 100, "der Fluß  über\nalles"]
    got = scorer.texts(texts)
    for text, row in zip(texts, got):
        words = L.stretches(text)
        want = scorer.lattice.forward(words, chance).sum(axis=0) if words else np.zeros(3)
        assert np.allclose(row, want)
    assert np.allclose(scorer.texts(texts[::-1]), got[::-1])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.identify(docs)
    held = out.where("held_out")
    assert held.count() > 200
    assert held.where(F.col("lang_pred") == F.col("lang")).count() >= 0.97 * held.count()
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_input_language_does_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.learn(docs.where(~L.held_out(F.col("doc_id"))))
    one = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, model).collect()}
    other = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), model).collect()}
    assert one == other


def test_odd_rows(odd):
    out = L.identify(odd).collect()
    assert len(out) == 9 and all(r.key == "clash" for r in out)
    got = {r.doc_id: r for r in out}
    assert all(got[i].lang_pred == L.UNKNOWN and got[i].score == 0 for i in (1, 2, 3))
    assert got[4].lang_pred in ("en", "fr", "de") and isinstance(got[None].held_out, bool)
    nothing = L.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {(L.UNKNOWN, 0.0)}
    assert L.identify(odd.limit(0)).count() == 0


def test_digits_are_und(make):
    docs = make([(0, "hello there", "en", "s"), (2, "123 456 !", "en", "s"), (3, "guten tag", "de", "s")])
    got = {r.doc_id: r.lang_pred for r in L.identify(docs).collect()}
    assert got[2] == L.UNKNOWN


@pytest.mark.parametrize("text", ["a\x00b", "😀 ok", "漢字" * 500])
def test_any_text(text):
    pieces = L.read_vocabulary()
    scorer = L.Scorer(L.Model(["a"], pieces, np.full((len(pieces), 1), 1 / len(pieces))))
    assert np.isfinite(scorer.texts([text])).all()
