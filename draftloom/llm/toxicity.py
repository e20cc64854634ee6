"""Toxic passages by maximum-scoring segment search over token log-odds.

Lexicon: every distinct labelled text counts once for each of its words and for each start of a word (``STARTS`` letters). Words and
starts with sure evidence form the lexicon, and known words and longer starts that begin like them. The log-odds of a token between
toxic and clean texts come from a chain of Dirichlet priors of mass ``PRIOR``: the shortest start has its prior at the share of toxic texts, each longer
one and the word itself at the rate before it. So rare words stay near zero, inflections never seen take the odds of their start, and a
harmless word that begins like a toxic one stays harmless.

Search: each token scores its log-odds less ``DRIFT``. The linear-time scan of Ruzzo and Tompa finds all maximal-scoring segments;
it runs over the scoring tokens only, as all between them cost the same.

Calibration: the best segment of a clean text of n words follows an extreme-value distribution,
``P(S >= s) = 1 - exp(-K n exp(-lambda s))``. lambda solves ``sum p exp(lambda s) = 1`` over the tokens of clean texts, K is the likeliest for
their best segments. A logistic curve over the standardised best segment and the standardised sum of all segments gives the score. Labelled texts are
scored for this without their own counts.

The fit takes about ``FIT_ROWS`` labelled texts of each class (all, if there are fewer), chosen by a hash of the key, and keeps the ``LEXICON`` surest
entries; both are parameters. Every text is scored, whole, in the task that reads it; nothing is shuffled for that.

Defined cases: a null or empty text has no passage and the score of a text without one; labels that are null do not count, of several labels of one
key the largest does; a null key has no label; repeated rows are scored each; without labels of both classes every score is the share of toxic labels
(0 without any); an empty table gives no rows. Columns of the input stay, but those that the operator adds replace others of their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom.llm.common import own, small_batches
from draftloom.session import checkpoint

FIT_ROWS = 200_000
LEXICON = 200_000
STARTS = (8, 7, 6, 5, 4)
PRIOR = 5.0
DRIFT = 0.5
#: Least log-odds of words and of starts in the lexicon, and their least z-score: of very many words some look toxic by chance.
LEAST = (1.5, 2.0)
LEAST_Z = 3.5
#: Texts in which a word must be known before its own counts outweigh those of its start.
KNOWN = 3
HIGHEST = 8.0
THRESHOLD = 0.3
#: Passages with a smaller chance in clean text are reported.
SIGNIFICANT = 0.05
WORDS_HELD = 250_000
#: Borders of the tally of token scores; tokens that score nothing lie below the first.
BINS = np.arange(0.0, HIGHEST, 0.25)

_TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """What scoring needs: counts (toxic, clean) of lexicon entries, their base rate and the calibration."""

    toxic: float = 0.0
    clean: float = 0.0
    words: dict = field(default_factory=dict)
    starts: dict = field(default_factory=dict)
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple = (0.0, 0.0, 0.0)


class _Scores(dict):
    """Token -> score. ``label`` is that of the text itself, whose counts are then left out."""

    def __init__(self, model: Model, label: int | None = None) -> None:
        super().__init__()
        self.model, self.label = model, label
        self.share = model.toxic / (model.toxic + model.clean)

    def __missing__(self, token: str) -> float:
        if len(self) > WORDS_HELD:
            self.clear()
        word, model = token.lower(), self.model
        entries = [model.starts[word[:n]] for n in sorted(STARTS) if len(word) >= n and word[:n] in model.starts]
        if word in model.words:
            entries.append(model.words[word])
        score = -DRIFT
        if entries:
            rate = self.share
            for toxic, clean in entries:
                toxic, clean = max(0, toxic - (self.label == 1)), max(0, clean - (self.label == 0))
                # Kept off 0 and 1, which a chain of large counts comes to in floating point.
                rate = min(1 - 1e-9, max(1e-9, (toxic + PRIOR * rate) / (toxic + clean + PRIOR)))
            score = min(HIGHEST, max(0.0, math.log(rate / (1 - rate)) - math.log(self.share / (1 - self.share)))) - DRIFT
        self[token] = score
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last + 1, score) of token scores, left to right; linear in the scoring tokens."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    # Candidates: first, last, sum before the first and up to the last token; ``link`` is the nearest earlier one with a smaller sum before it.
    stack: list[list] = []
    for i in at.tolist():
        first, last, before, upto = i, i, sums[i], sums[i + 1]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= before:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= upto:
                stack.append([first, last, before, upto, k])
                break
            first, before = stack[k][0], stack[k][2]
            del stack[k:]
    return [(s[0], s[1] + 1, float(s[3] - s[2])) for s in stack]


def _found(text: str | None, scores: _Scores) -> tuple[int, list[tuple[int, int, float]], np.ndarray]:
    tokens = _TOKEN.findall(text) if text else []
    values = np.fromiter(map(scores.__getitem__, tokens), np.float64, len(tokens))
    return len(tokens), segments(values), values


def _chosen(docs: DataFrame, labels: DataFrame, key: str, text: str, toxic: str, fit: Column, fit_rows: int) -> tuple[DataFrame, dict[int, float]]:
    """(id, toxic) of labelled texts for the fit, copies of a text once, and how many labels stand for each of them, by class."""
    known = labels.where(fit & F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(key).alias("id")).agg((F.max(toxic) >= 1).cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for label, count in n.items():
        share = F.when(F.col("toxic") == label, min(1.0, fit_rows / count)).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 20)) < share * (1 << 20))
    # About fit_rows small rows of each class at most: safe to broadcast.
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text, F.lit(1)).alias("h")).join(F.broadcast(drawn), "id")
    chosen = checkpoint(rows.groupBy("h", "toxic").agg(F.min("id").alias("id")).groupBy("id").agg(F.max("toxic").alias("toxic")))
    got = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    return chosen, {label: max(1.0, n[label] / got[label]) for label in got}


def _lexicon(texts: DataFrame, toxic: int, clean: int, limit: int) -> tuple[dict, dict]:
    """Counts of the surest words and starts, and of known words and longer starts that are not toxic themselves but begin like toxic ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(set(counts[0]) | set(counts[1]))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in counts)], names=["entry", "clean", "toxic"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w.lower() for w in _TOKEN.findall(text or "")}
                # A start carries a mark that no word holds.
                counts[label].update(words | {f"{w[:n]}-" for w in words for n in STARTS if len(w) >= n})
            if len(counts[0]) + len(counts[1]) > 2 * WORDS_HELD:
                yield out()
                counts = (Counter(), Counter())
        yield out()

    counted = texts.mapInArrow(run, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = toxic / (toxic + clean)
    a, b = F.col("toxic") + PRIOR * share, F.col("clean") + PRIOR * (1 - share)
    odds = F.log(a / b) - math.log(share / (1 - share))
    z = odds / F.sqrt(1 / a + 1 / b)
    start = F.col("entry").endswith("-")
    least = F.when(start, F.lit(LEAST[1])).otherwise(F.lit(LEAST[0]))
    judged = checkpoint(counted.where((F.col("toxic") > 1) | (F.col("toxic") + F.col("clean") >= KNOWN)).withColumn("z", z).withColumn("sure", (odds >= least) & (z >= LEAST_Z)))
    sure = judged.where("sure").orderBy(F.desc("z"), "entry").limit(limit)
    starts = sure.where(start).select(F.col("entry").alias("start"))
    known = judged.where(~F.col("sure") & (F.col("toxic") + F.col("clean") >= KNOWN))
    under = known.select("entry", "clean", "toxic", F.explode(F.array(*[F.concat(F.substring("entry", 1, n), F.lit("-")) for n in STARTS])).alias("start"))
    harmless = under.join(F.broadcast(starts), "start", "left_semi").groupBy("entry").agg(F.first("clean").alias("clean"), F.first("toxic").alias("toxic"), F.max(F.col("clean") + F.col("toxic")).alias("n"))
    harmless = harmless.orderBy(F.desc("n"), "entry").limit(limit)
    words, prefixes = {}, {}
    for r in sure.select("entry", "toxic", "clean").unionByName(harmless.select("entry", "toxic", "clean")).toLocalIterator():
        into, name = (prefixes, r["entry"][:-1]) if r["entry"].endswith("-") else (words, r["entry"])
        into[name] = (r["toxic"], r["clean"])
    return words, prefixes


def chance_scale(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive lambda with ``sum p exp(lambda s) = 1`` for scores whose mean is negative."""
    p = counts / counts.sum()
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * values, 700))).sum() < 1 and high < 1e3:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(np.minimum(middle * values, 700))).sum() < 1 else (low, middle)
    return (low + high) / 2


def _features(n, best, total, scale: float, rate: float) -> np.ndarray:
    """Standardised best segment and sum of segments; 0 without a segment."""
    n, best, total = (np.asarray(x, np.float64) for x in (n, best, total))
    base = np.log(rate * np.maximum(n, 1))
    return np.stack([np.where(s > 0, np.logaddexp(0, scale * s - base), 0.0) for s in (best, total)], axis=-1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, the last one constant, by Newton's method; the constant is not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    share = (weight * y).sum() / weight.sum()
    beta[-1] = np.log(share / (1 - share))
    penalty = np.diag([ridge * weight.sum() / 100] * (x.shape[1] - 1) + [1e-9])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        gradient = x.T @ (weight * (p - y)) + penalty @ beta * np.array([1.0] * (x.shape[1] - 1) + [0.0])
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", fit: Column | None = None, fit_rows: int = FIT_ROWS, lexicon: int = LEXICON) -> Model:
    """Lexicon and calibration from the labels for which ``fit`` holds (a condition on the label table)."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen, weight = _chosen(docs, labels, key, text, toxic, F.lit(True) if fit is None else fit, fit_rows)
    n = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model(toxic=float(n.get(1, 0)), clean=float(n.get(0, 0)))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("text", "toxic")
    words, starts = _lexicon(texts, n[1], n[0], lexicon)
    model = Model(float(n[1]), float(n[0]), words, starts)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = [_Scores(shared.value, label) for label in (0, 1)]
        for batch in batches:
            rows, tally = [], np.zeros(len(BINS) + 1, np.int64)
            for text_, label in zip(batch["text"], batch["toxic"]):
                size, parts, values = _found(text_, memory[label])
                rows.append((label, size, max((s for *_, s in parts), default=0.0), sum(s for *_, s in parts)))
                if label == 0:
                    tally += np.bincount(np.digitize(values, BINS), minlength=len(BINS) + 1)
            # Rows from 2 on are the tally of token scores in clean texts.
            rows += [(2 + i, int(count), 0.0, 0.0) for i, count in enumerate(tally) if count]
            yield pd.DataFrame(rows, columns=["label", "n", "best", "total"])

    # A row of four numbers for each of the bounded number of labelled texts.
    seen = texts.mapInPandas(run, "label int, n long, best double, total double").toPandas()
    seen = seen.sort_values(list(seen.columns), ignore_index=True)
    tally = seen[seen["label"] >= 2].groupby("label")["n"].sum()
    seen = seen[seen["label"] < 2]
    # One more token of the highest score keeps lambda finite where clean texts hold none.
    values = np.concatenate([np.where(tally.index == 2, -DRIFT, np.append(BINS, HIGHEST)[np.maximum(tally.index - 2, 0)]), [-DRIFT, HIGHEST - DRIFT]])
    model.scale = chance_scale(values, np.concatenate([tally.to_numpy(np.float64), [1.0, 1.0]]))
    plain = seen[seen["label"] == 0]
    model.rate = float(len(plain) / max(1.0, (plain["n"] * np.exp(-model.scale * plain["best"])).sum()))
    x = _features(seen["n"], seen["best"], seen["total"], model.scale, model.rate)
    y = seen["label"].to_numpy(np.float64)
    model.curve = tuple(logistic(x, y, np.where(y == 1, weight[1], weight[0])).tolist())
    return model


FOUND = "score double, passages array<struct<start: int, end: int, score: double, chance: double>>"


def score(docs: DataFrame, model: Model, text: str = "text", found: str = "toxicity", passages: bool = True) -> DataFrame:
    """The rows with a struct (score, passages): code-point ranges of the significant passages with score and chance in clean text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(FOUND)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        one_class = not (model.toxic and model.clean)
        memory = None if one_class else _Scores(model)
        constant = model.toxic / max(1.0, model.toxic + model.clean)
        for texts in batches:
            sizes, best, total, spans = [], [], [], []
            for t in texts:
                n, parts, _ = (0, [], None) if one_class else _found(t, memory)
                sizes.append(n)
                best.append(max((s for *_, s in parts), default=0.0))
                total.append(sum(s for *_, s in parts))
                held = []
                if passages and parts:
                    chances = [-math.expm1(-min(model.rate * n * math.exp(-model.scale * s), 700)) for *_, s in parts]
                    if min(chances) < SIGNIFICANT:
                        places = [m.span() for m in _TOKEN.finditer(t)]
                        held = [(places[a][0], places[b - 1][1], s, c) for (a, b, s), c in zip(parts, chances) if c < SIGNIFICANT]
                spans.append([dict(zip(("start", "end", "score", "chance"), x)) for x in held])
            if one_class:
                scores = np.full(len(texts), constant)
            else:
                scores = 1 / (1 + np.exp(-np.clip(_features(sizes, best, total, model.scale, model.rate).reshape(-1, 2) @ model.curve[:2] + model.curve[2], -500, 500)))
            yield pd.DataFrame({"score": scores, "passages": spans})

    return docs.withColumn(found, judge(F.col(text)))


def detect(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", fit: Column | None = None, threshold: float = THRESHOLD, passages: bool = True, **how) -> DataFrame:
    """The rows with ``score``, ``predicted`` and ``passages``, by a model of the given labels."""
    model = train(docs, labels, key, text, toxic, fit, **how)
    found = own("toxicity")
    rows = score(docs, model, text, found, passages)
    keep = [c for c in docs.columns if c not in ("score", "predicted", "passages")]
    return rows.select(*keep, F.col(f"{found}.score").alias("score"), (F.col(f"{found}.score") >= threshold).cast("int").alias("predicted"), F.col(f"{found}.passages").alias("passages"))
