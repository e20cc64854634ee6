import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from draftloom.llm import perplexity as Q


def grams_of(text, order):
    text = "\n" * (order - 1) + text + "\n"
    return [text[i - order + 1:i + 1] for i in range(order - 1, len(text))]


class ByHand:
    """A modified Kneser-Ney model with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {order: Counter(g for t in texts for g in grams_of(t, order))}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d = {}
        for k, c in self.counts.items():
            n = [0] + [sum(x == i for x in c.values()) for i in range(1, 5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else None
            d = []
            for i in (1, 2, 3):
                exact = i - (i + 1) * y * n[i + 1] / n[i] if n[1] and n[i] else -1
                d.append(exact if 0 < exact < i else 0.5 * i)
            self.d[k] = d

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.counts[1]) + 1)
        c, d = self.counts[k], self.d[k]
        same = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        if not same:
            return self.p(gram[1:])
        total = sum(same.values())
        freed = sum(d[min(n, 3) - 1] for n in same.values())
        n = same.get(gram, 0)
        return (n - d[min(n, 3) - 1] if n else 0) / total + freed / total * self.p(gram[1:])


def test_model_equals_model_by_hand(spark, make):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    docs = make([(i, t, "xx", "s") for i, t in enumerate(texts)])
    model = Q.load(Q.kneser_ney(Q.gram_counts(docs, order=3), 3), 3)["xx"]
    hand = ByHand(texts, 3)
    for text in [*texts[:5], "zzz abc", "q"]:
        points, places, _ = Q.codes([text], 3)
        got = model.score(points, places)
        want = [math.log(hand.p(g)) for g in grams_of(text, 3)]
        assert np.allclose(got, want, atol=1e-4), text


def test_counts_cover_all_texts(spark, make):
    texts = ["Ab  c\td", "漢字かな" * 3, "", "aaa aaa"]
    docs = make([(i, t, None if i % 2 else "en", "s") for i, t in enumerate(texts)])
    got = {(r.lang, r.gram): r.n for r in Q.gram_counts(docs, order=3).collect()}
    want = Counter()
    for i, t in enumerate(texts):
        if t.split():
            want.update((Q.UNKNOWN if i % 2 else "en", g) for g in grams_of(" ".join(t.lower().split()), 3))
    assert got == dict(want)
    many = "".join(chr(0x4E00 + i) for i in range(5000))
    points, places, _ = Q.codes([many], 3)
    assert Q.count_grams(points, places, 3) == Counter(grams_of(many, 3))


def plain(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(8)}
    lines, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_base_counts():
    rng = random.Random(3)
    texts = ["", "a", "a b\n\n \na b\n", "x" * 9000, "é ü ü\x1cz", "# * $ %|<>&" * 3, "w " * 8, "w " * 9, *(" ".join(rng.choice("abc") for _ in range(n)) for n in (8, 20, 300))]
    texts += ["\n".join(rng.choice(["one two three four five six seven eight nine", "# x", ""]) for _ in range(30))]
    for t in texts:
        assert Q.base_counts(t, t.encode().split()) == plain(t), t[:50]


def test_junk_goes_and_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = Q.judge(docs)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    sound = out.where(~F.col("base_failed"))
    junk = sound.where("n_symbols > 0.3 * n_words")
    clean = sound.where("n_symbols = 0")
    assert junk.count() > 20 and junk.where("kept").count() <= 0.05 * junk.count()
    assert clean.where("not kept").count() == 0


def test_odd_rows(odd):
    rows = Q.judge(odd).collect()
    assert len(rows) == 9 and all(r.key == "clash" and isinstance(r.kept, bool) for r in rows)
    got = {r.doc_id: r for r in rows}
    assert all(got[i].base_failed and not got[i].kept and got[i].perplexity is None and got[i].n_words == 0 for i in (1, 2, 3))
    assert got[6].n_repeat_words == got[6].n_words == 30_000 and got[7].word_chars == 50_000
    assert Q.judge(odd.limit(0)).count() == 0


def mean_by_hand(hand, text, order):
    return sum(math.log(hand.p(g)) for g in grams_of(" ".join(text.lower().split()), order)) / (len(" ".join(text.split())) + 1)


def test_rare_grams_of_many_languages_stay(spark, make):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(3, 40))) for _ in range(30)]
    # Scored, not learned from: their n-grams back off.
    junk = ["ab # c $ % f", "# # # abc zz"]
    docs = [(i, t, "xx", "s") for i, t in enumerate([*texts, *junk])] + [(100 + i, "one text", f"l{i}", "s") for i in range(400)]
    hand = ByHand(texts, 5)
    # A model sent to the tasks, and one that stays a table.
    for shipped in (Q.SHIPPED, 0):
        got = {r.doc_id: r.perplexity for r in Q.judge(make(docs), shipped=shipped).where("lang = 'xx'").collect()}
        for i, t in enumerate([*texts, *junk]):
            assert math.isclose(got[i], math.exp(-mean_by_hand(hand, t, 5)), rel_tol=1e-5), (shipped, t)


def test_odd_rows_by_chunks(odd):
    columns = ["doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    ways = [Q.judge(odd, shipped=n) for n in (Q.SHIPPED, 0)]
    assert ways[0].columns == ways[1].columns
    rows = [sorted(w.select(*columns, F.round("perplexity", 4).alias("p")).collect(), key=str) for w in ways]
    assert rows[0] == rows[1] and len(rows[0]) == 9
    assert Q.judge(odd.limit(0), shipped=-1).count() == 0


def test_chunks_and_slices(spark, make):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["abc", "bcd", "Cde", "#"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = make([(i, t, rng.choice(["xx", None, "yy"]), "s") for i, t in enumerate(texts)]).repartition(3)
    assert [list(r) for r in Q._slices([3, 9, 1, 1, 0, 5], 4)] == [[0], [1], [2, 3, 4], [5]] and not list(Q._slices([]))
    parts = docs.select("doc_id", "lang", "text")
    _, whole = Q.chunks(parts, [], order=3)
    pieces, small = Q.chunks(parts, ["doc_id"], order=3, size=100)
    assert pieces.count() == 60 and pieces.select("chunk").distinct().count() > 20
    assert pieces.groupBy("chunk").agg(F.count_distinct("lang").alias("n")).where("n > 1").isEmpty()
    assert small.groupBy("chunk", "gram").count().where("count > 1").isEmpty()
    counts = [{(r.lang, r.gram): r.n for r in g.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()} for g in (whole, small)]
    assert counts[0] == counts[1] and 0 in counts[0].values()
