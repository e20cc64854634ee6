import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from draftloom.llm import toxicity as T


def all_maximal(scores):
    """Maximal-scoring segments by their definition: take the best range, then look left and right of it; of equal ones the shortest, leftmost."""
    def search(lo, hi):
        best = max(((sum(scores[a:b]), a - b, -a, a, b) for a, b in itertools.combinations(range(lo, hi + 1), 2)), default=None)
        if best is None or best[0] <= 0:
            return []
        *_, a, b = best
        return search(lo, a) + [(a, b, best[0])] + search(b, hi)

    return search(0, len(scores))


def test_segments_equal_their_definition():
    rng = random.Random(1)
    for _ in range(400):
        # Powers of two keep sums exact and distinct enough for one best range.
        scores = [rng.choice([-1, 1]) * (rng.randrange(1, 1 << 20) / 1024) for _ in range(rng.randrange(0, 25))]
        assert T.segments(np.array(scores)) == all_maximal(scores)
    assert T.segments(np.array([1.0] * 100_000)) == [(0, 100_000, 100_000.0)]


def test_chance_scale_solves_its_equation():
    values, counts = np.array([-0.5, 2.0, 5.0]), np.array([1e6, 10.0, 3.0])
    scale = T.chance_scale(values, counts)
    assert abs((counts / counts.sum() * np.exp(scale * values)).sum() - 1) < 1e-9 and scale > 0


def test_scores_follow_the_chain_of_priors():
    model = T.Model(toxic=100, clean=900, words={"zorkuvian": (0, 40), "zorkuvxy": (3, 0), "idle": (1, 9)}, starts={"zork": (50, 45), "zorkuv": (50, 2)})
    s = T._Scores(model)
    assert s["Zorkuvnew"] > s["zorkold"] > 0 and s["zorkuvxy"] > s["zorkuvnew"] and s["unknown"] == -T.DRIFT
    assert s["zorkuvian"] < 0 and abs(s["idle"] + T.DRIFT) < 0.1
    rate = (50 + 5 * 0.1) / (95 + 5)
    assert abs(s["zorkold"] - (np.log(rate / (1 - rate)) - np.log(1 / 9) - T.DRIFT)) < 1e-12
    sure = T._Scores(T.Model(toxic=1e6, clean=9e6, words={"zorkuv": (10**6, 0)}, starts={"zorkuv"[:n]: (10**6, 0) for n in T.STARTS}))
    assert sure["zorkuv"] == T.HIGHEST - T.DRIFT
    assert T._Scores(model, 1)["zorkold"] < s["zorkold"] < T._Scores(model, 0)["zorkold"]


def held_out(n):
    return F.coalesce(F.crc32(n.cast("string")) % 4 == 2, F.lit(False))


def measures(rows):
    """(area under the curve, precision and recall at 0.3) of (label, score)."""
    good, bad = np.array([s for y, s in rows if y]), np.array([s for y, s in rows if not y])
    area = np.mean([(x > bad).mean() + (x == bad).mean() / 2 for x in good])
    return area, (good >= 0.3).sum() / max(1, (good >= 0.3).sum() + (bad >= 0.3).sum()), (good >= 0.3).mean()


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = T.detect(docs.select("doc_id", "text"), labels, fit=~held_out(F.col("doc_id")), passages=False).where(held_out(F.col("doc_id")))
    rows = [(r.toxic, r.score) for r in out.join(labels, "doc_id").select("toxic", "score").collect()]
    area, precision, recall = measures(rows)
    assert len(rows) > 800 and area > 0.95 and precision > 0.95 and recall > 0.9


def planted(seed=3, n=400):
    """Clean and toxic texts: the latter hold two to four words on one of two stems, with endings that vary."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["zorkuv", "Quelmi"]) + rng.choice(plain) for _ in range(rng.randrange(2, 5))]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_passages_are_where_the_words_are(spark):
    rows = planted()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2 == 0], "doc_id long, toxic int")
    out = {r.doc_id: r for r in T.detect(docs, labels).collect()}
    for i, text, toxic in rows:
        assert out[i].predicted == toxic, (i, out[i].score)
        if toxic:
            span = out[i].passages[0]
            inside = text[span.start:span.end].lower()
            assert inside.startswith(("zorkuv", "quelmi")) and text.lower().count("zorkuv") + text.lower().count("quelmi") == inside.count("zorkuv") + inside.count("quelmi")
            assert span.chance < 0.05
        else:
            assert not out[i].passages


def test_known_words_do_not_take_the_odds_of_their_start(spark):
    rows = planted() + [(1000 + i, f"zorkuvian history {i} of the region", 0) for i in range(30)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = {r.doc_id: r.predicted for r in T.detect(docs, labels).collect()}
    assert not any(out[1000 + i] for i in range(30)) and sum(out[r[0]] != r[2] for r in rows) <= 2


def test_copies_of_a_text_count_once(spark):
    rows = planted() + [(2000 + i, "some ordinary words that were copied with insult zorkuvabc zorkuvdef", 1) for i in range(500)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9999, "some ordinary words that were copied")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = {r.doc_id: r.predicted for r in T.detect(docs, labels).collect()}
    assert out[9999] == 0 and all(out[2000 + i] for i in range(500))


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (5, 1), (6, 0), (6, None), (None, 1), (77, 1), (4, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    clashing = odd.drop("score").withColumn("score", F.lit("clash")).withColumn("predicted", F.lit("clash")).withColumn("passages", F.lit("clash")).withColumn("toxic", F.lit("clash"))
    out = T.detect(clashing, labels)
    assert sorted(out.columns) == sorted(clashing.columns)
    rows = out.collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert T.detect(clashing.limit(0), labels).collect() == []
    assert {r.score for r in T.detect(clashing, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in T.detect(clashing, labels.where("doc_id = 1")).collect()} == {1.0}


def test_reruns_agree(spark):
    rows = planted(5)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    one, two = ({r.doc_id: r.score for r in T.detect(d, labels).collect()} for d in (docs, docs.repartition(7)))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
