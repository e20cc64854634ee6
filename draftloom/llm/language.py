"""Language identification by segmentation-marginalised unigrams.

Each language gives every piece of a fixed public vocabulary a probability. The probability of a word is the sum over all
its segmentations into pieces, by the forward algorithm; a text's score is the sum over its words, since no piece of the
vocabulary reaches across a space. The language with the best score wins.

Learning: words of labelled rows are counted per language by Spark; expectation maximisation runs over the distinct words
(expected piece counts from forward and backward sums) and Spark adds up the counts per language and piece. The sample of labelled
rows is bounded per language by ``ROWS_PER_LANGUAGE``, drawn by hash of the row's key. The model has one number per
language and vocabulary entry, so its size is bounded by the vocabulary; only that is sent to the tasks.

Prediction: all pieces in the distinct words of a batch are looked up length by length, the forward sums of all words run
side by side, and a bounded memory keeps the scores of words that were met before. Whole texts are scored.

Defined cases: a null text or one without a letter is ``und`` with score 0; if nothing could be learned, so is every text; bytes that
no piece covers have a floor probability; ties go to the language that sorts first; repeated rows are scored each; an empty table
gives no rows. Columns that the operator does not know stay as they are.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom.llm.common import own, small_batches
from draftloom.session import checkpoint

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
ROWS_PER_LANGUAGE = 2000
ROUNDS = 3
#: Pieces longer than this are not used; words are cut into stretches of at most so many bytes.
LONGEST_PIECE, LONGEST_WORD = 16, 32
#: Count that every piece has in every language from the outset, and words a worker remembers.
PRIOR, REMEMBERED = 0.01, 250_000
#: No piece is less likely than this.
FLOOR = 1e-9
UNKNOWN = "und"


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a byte-level vocabulary that stay within a word with at most one space before it; every byte is one."""
    with open(path, "rb") as file:
        pieces = {base64.b64decode(line.split()[0]) for line in file if line.strip()}
    inner = {p for p in pieces if len(p) <= LONGEST_PIECE and not any(c in b" \t\n\r\x0b\x0c" for c in p[1:])}
    return sorted(inner | {bytes([b]) for b in range(256)})


class Lattice:
    """Forward and backward sums of words over the pieces of a vocabulary.

    Pieces are found by their bytes, packed into 64 bits (a hash of them beyond eight bytes), in one sorted array per length.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int32)
        self.longest = int(self.lengths.max())
        self.tables: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]
        for n in range(1, self.longest + 1):
            number = np.flatnonzero(self.lengths == n)
            keys = self._keys(self._packed(b"".join(pieces[i] for i in number)), np.arange(len(number)) * n, n)
            order = np.argsort(keys)
            self.tables.append((keys[order], number[order]))

    @staticmethod
    def _packed(joined: bytes) -> np.ndarray:
        """The eight bytes from each place on, big-endian."""
        values = np.frombuffer(joined + bytes(24), dtype=np.uint8)
        packed = np.zeros(len(values) - 8, dtype=np.uint64)
        for k in range(8):
            packed = (packed << np.uint64(8)) | values[k:k + len(packed)]
        return packed

    @staticmethod
    def _keys(packed: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        first = packed[at] >> np.uint64(8 * max(0, 8 - n))
        if n <= 8:
            return first
        return first * np.uint64(0x9E3779B97F4A7C15) + (packed[at + 8] >> np.uint64(8 * (16 - n)))

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(word, end, piece) of every piece found in a word, and the longest word."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        packed = self._packed(b"".join(words))
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(word)) - (np.cumsum(sizes) - sizes)[word]
        at, left = np.arange(len(word)), sizes[word] - place
        out = []
        for n, (keys, numbers) in enumerate(self.tables[1:], 1):
            fits = left >= n
            at, left = at[fits], left[fits]
            if not len(at):
                break
            if not len(keys):
                continue
            wanted = self._keys(packed, at, n)
            spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[spot] == wanted
            found = at[hit]
            out.append((word[found], place[found] + n, numbers[spot[hit]]))
        return *(np.concatenate(x) for x in zip(*out)), int(sizes.max(initial=0))

    def forward(self, words: list[bytes], probabilities: np.ndarray) -> np.ndarray:
        """Log probability of each word, with a space before it, in each language: words x languages. ``probabilities``: pieces x languages."""
        sums, last, _ = self._forward(words, probabilities)
        return np.log(sums[last, np.arange(len(words))])

    def _forward(self, words: list[bytes], probabilities: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Sums over all segmentations up to each place (``LONGEST_WORD`` and ``FLOOR`` keep them above zero), places where words end, edges."""
        words = [b" " + w for w in words]
        word, end, piece, longest = self.edges(words)
        order = np.argsort(end, kind="stable")
        word, end, piece = word[order], end[order], piece[order]
        start = end - self.lengths[piece]
        bounds = np.searchsorted(end, np.arange(longest + 2))
        n, languages = len(words), probabilities.shape[1]
        sums = np.zeros((longest + 1, n, languages))
        sums[0] = 1.0
        for at in range(1, longest + 1):
            part = slice(bounds[at], bounds[at + 1])
            w = word[part]
            value = sums[start[part], w] * probabilities[piece[part]]
            for k in range(languages):
                sums[at, :, k] = np.bincount(w, value[:, k], n)
        return sums, np.array([len(w) for w in words]), (word, start, end, piece)

    def expected(self, words: list[bytes], counts: np.ndarray, probabilities: np.ndarray, pieces: int) -> np.ndarray:
        """Expected number of uses of each piece in one language, for words with counts."""
        sums, last, (word, start, end, piece) = self._forward(words, probabilities)
        ahead, n = sums[:, :, 0], len(words)
        back = np.zeros_like(ahead)
        back[last, np.arange(n)] = 1.0
        order = np.argsort(-start, kind="stable")
        word, start, end, piece = word[order], start[order], end[order], piece[order]
        chance = probabilities[piece, 0]
        longest = len(ahead) - 1
        bounds = np.searchsorted(-start, -np.arange(longest, -2, -1))
        for k, at in enumerate(range(longest, -1, -1)):
            part = slice(bounds[k], bounds[k + 1])
            w = word[part]
            back[at] += np.bincount(w, chance[part] * back[end[part], w], n)
        share = ahead[start, word] * chance * back[end, word] / ahead[last[word], word]
        return np.bincount(piece, share * counts[word], pieces)


def stretches(text: str) -> list[bytes]:
    """Words of a text; very long words come in stretches."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words or max(map(len, words)) <= LONGEST_WORD:
        return words
    return [word[i:i + LONGEST_WORD] for word in words for i in range(0, len(word), LONGEST_WORD)]


_lattices: dict[int, Lattice] = {}


def _lattice(pieces: list[bytes]) -> Lattice:
    mark = hash(tuple(pieces[:1000:37])) ^ len(pieces)
    if mark not in _lattices:
        _lattices[mark] = Lattice(pieces)
    return _lattices[mark]


class Model:
    """Languages and the probability of every piece in each of them."""

    def __init__(self, languages: list[str], pieces: list[bytes], probabilities: np.ndarray) -> None:
        self.languages, self.pieces, self.probabilities = languages, pieces, probabilities


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE, rounds: int = ROUNDS,
          vocabulary: str = VOCABULARY) -> Model | None:
    """Fit piece probabilities from rows with text and language; None if there are none."""
    spark = docs.sparkSession
    small_batches(spark)
    u = F.pmod(F.xxhash64(F.lit("learn"), F.col(key).cast("string")), F.lit(1_000_003)) / 1_000_003
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), u.alias("u")).where("lang is not null and text is not null")
    # One small row per language, written so that the planner knows its size: texts need no shuffle to meet it.
    share = checkpoint(labelled.groupBy("lang").count().select("lang", (F.lit(float(rows_per_language)) / F.col("count")).alias("share")))
    drawn = labelled.join(share, "lang").where(F.col("u") < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for language, body in zip(batch["lang"], batch["text"]):
                held.setdefault(language, Counter()).update(stretches(body))
            if sum(map(len, held.values())) > REMEMBERED:
                yield from out(held)
                held.clear()
        yield from out(held)

    def out(held: dict[str, Counter]) -> Iterator[pd.DataFrame]:
        for language, words in held.items():
            yield pd.DataFrame({"lang": language, "word": list(words), "n": list(words.values())})

    words = drawn.mapInPandas(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = checkpoint(words)
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    if not languages:
        return None
    pieces = read_vocabulary(vocabulary)
    place = {language: i for i, language in enumerate(languages)}
    weights = np.array([1.0 / len(p) ** 2 for p in pieces])
    probabilities = np.repeat((weights / weights.sum())[:, None], len(languages), axis=1)
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast((pieces, probabilities))

        def expect(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            pieces, probabilities = shipped.value
            lattice = _lattice(pieces)
            total: dict[str, np.ndarray] = {}
            held: dict[str, list[pd.DataFrame]] = {}

            def add(language: str) -> None:
                rows = pd.concat(held.pop(language))
                total[language] = total.get(language, 0) + lattice.expected(list(rows["word"]), rows["n"].to_numpy(dtype=float), probabilities[:, [place[language]]], len(pieces))

            for batch in batches:
                for language, rows in batch.groupby("lang"):
                    held.setdefault(language, []).append(rows)
                    if sum(map(len, held[language])) >= 4096:
                        add(language)
            for language in list(held):
                add(language)
            for language, sums in total.items():
                used = np.nonzero(sums)[0]
                yield pd.DataFrame({"lang": language, "piece": used.astype("int32"), "n": sums[used]})

        sums = words.mapInPandas(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((len(pieces), len(languages)), PRIOR)
        np.add.at(counts, (sums["piece"].to_numpy(), sums["lang"].map(place).to_numpy()), sums["n"].to_numpy())
        probabilities = np.maximum(counts / counts.sum(axis=0), FLOOR)
        shipped.unpersist()
    return Model(languages, pieces, probabilities)


class Scorer:
    """Scores texts; remembers words."""

    def __init__(self, model: Model) -> None:
        self.model, self.lattice = model, _lattice(model.pieces)
        self.places: dict[bytes, int] = {}
        self.scores = np.empty((65536, len(model.languages)))

    def texts(self, texts: list[str]) -> np.ndarray:
        split = [stretches(t) for t in texts]
        if len(self.places) > REMEMBERED:
            self.places = {}
        known = self.places
        new = list(set().union(*split).difference(known))
        if new:
            # Words of like length run side by side.
            new.sort(key=len)
            size = len(known) + len(new)
            if size > len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty((size, self.scores.shape[1]))])
            for at in range(0, len(new), 4096):
                part = new[at:at + 4096]
                self.scores[len(known):len(known) + len(part)] = self.lattice.forward(part, self.model.probabilities)
                known.update(zip(part, range(len(known), len(known) + len(part))))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        places = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(split)), sizes)
        return np.stack([np.bincount(owner, column[places], len(split)) for column in self.scores.T], axis=1)


_scorers: dict[int, Scorer] = {}


def _scorer(shipped) -> Scorer:
    """The worker's scorer for a model that was sent to it; one at a time is kept from task to task."""
    mark = hash(shipped.value[2].tobytes())
    if mark not in _scorers:
        _scorers.clear()
        _scorers[mark] = Scorer(Model(*shipped.value))
    return _scorers[mark]


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score, the posterior probability of that language among all learned ones."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.probabilities))
    result = own("result")

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(shipped)
        for texts in batches:
            bodies = [t or "" for t in texts]
            scores = scorer.texts(bodies)
            best = scores.argmax(axis=1)
            posterior = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
            letters = [any(map(str.isalpha, t)) for t in bodies]
            yield pd.DataFrame({"lang_pred": [scorer.model.languages[b] if fine else UNKNOWN for b, fine in zip(best, letters)],
                                "score": np.where(letters, posterior, 0.0)})

    # Not deterministic for the planner only: else a filter on the result would have it computed once more.
    scored = run.asNondeterministic()(F.col(text))
    return docs.select(*keep, scored.alias(result)).select(*keep, f"{result}.lang_pred", f"{result}.score")


def held_out(key: Column) -> Column:
    """A third of all keys, whose rows nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """Learn from the rows that are not held out, then predict all; adds held_out, lang_pred and score."""
    model = learn(docs.where(~held_out(F.col(key))), lang, text, key, vocabulary=vocabulary)
    return predict(docs.withColumn("held_out", held_out(F.col(key))), model, text)
