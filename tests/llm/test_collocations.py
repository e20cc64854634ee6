import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from draftloom.llm import collocations as C

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, threshold, keep=2000, longest=4):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        ranked = []
        for p, a in found.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            covered = any(100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p))
            if not covered:
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:keep], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["la", "le", "Red", "tape", "über", "naïve", "x", "y", "New", "York", "of", "the", "\x1fodd", "日本"]
    marks = [" ", " ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "!?", "\r\n"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randrange(0, 40)))) for _ in range(n)]
    return rows + [("en", "new york city hall")] * 40 + [("fr", None), (None, ""), ("es", "...")]


def test_equals_counting_everything(spark):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for how in ({}, {"buffer": 500, "spare": 1}, {"bits": 8}, {"size": 16}):
        assert got(C.collocations(docs, threshold=7, **how)) == brute(rows, 7), how


def test_few_ranks_and_covered_phrases(spark):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "lang string, text string")
    out = got(C.collocations(docs, threshold=7, keep=5))
    assert out == brute(rows, 7, keep=5)
    phrases = {r[2] for r in got(C.collocations(docs, threshold=30)) if r[0] == "en"}
    assert "new york city hall" in phrases and "york city" not in phrases


def test_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(0)
    for _ in range(50):
        stream = rng.zipf(1.3, 4000).astype(np.uint64) % np.uint64(500)
        threshold, capacity = 60, len(stream) // 60 + 1
        state, lost = (np.empty(0, np.uint64), np.empty(0, np.int64)), 0
        for part in np.split(stream, 20):
            hashes, counts = C.add_up(np.concatenate([state[0], part]), np.concatenate([state[1], np.ones(len(part), np.int64)]))
            hashes, counts, loss = C.shrink(hashes, counts, capacity)
            assert len(hashes) <= capacity
            state, lost = (hashes, counts), lost + loss
        assert lost < threshold
        kept = dict(zip(state[0].tolist(), state[1].tolist()))
        for value, n in Counter(stream.tolist()).items():
            assert kept.get(value, 0) <= n <= kept.get(value, 0) + lost
            assert n < threshold or kept[value] > 0


def test_sums_of_unlike_phrases_with_one_hash():
    rng = np.random.default_rng(6)
    rows, counts = rng.integers(0, 3, (200, 3)).astype(np.int32), rng.integers(1, 9, 200)
    want = Counter()
    for row, n in zip(rows.tolist(), counts.tolist()):
        want[tuple(row)] += n
    for hashes in (np.zeros(200, np.uint64), (rows[:, 0] % 2).astype(np.uint64), (rows @ [1, 3, 9]).astype(np.uint64)):
        _, found, sums = C.sum_equal([(hashes[:90], rows[:90], counts[:90]), (hashes[90:], rows[90:], counts[90:])])
        assert dict(zip(map(tuple, found.tolist()), sums.tolist())) == want


def test_odd_rows(spark, odd):
    out = got(C.collocations(odd, threshold=2))
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert out == brute(rows, 2)
    assert C.collocations(odd.limit(0)).collect() == []
    long = spark.createDataFrame([("en", "a b " * 400_000), ("en", "z" * 3_000_000 + " a b")], "lang string, text string")
    r = got(C.collocations(long))[0]
    assert (r[:4], r[6]) == (("en", 1, "a b a b", 399_999), 800_003)


def test_scores_beyond_64_bits(spark):
    big = 2**61
    phrases = spark.createDataFrame([("en", "a b", big), ("en", "a", big), ("en", "b", big + 5), ("en", None, 3 * 2**61)], "lang string, phrase string, f long")
    r = C.rank_phrases(phrases).first()
    assert r.score == 2000000 * big // (2 * big + 5) and r.n == 3 * 2**61


def test_same_in_another_order(spark):
    docs = spark.createDataFrame(corpus(4), "lang string, text string")
    assert got(C.collocations(docs.repartition(7), threshold=9)) == got(C.collocations(docs.orderBy(F.desc("text")), threshold=9))
