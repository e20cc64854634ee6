"""Quality rules with n-gram perplexity.

Model: n-grams of characters (lower case, white space as one space) are counted over all whole texts, per language. The
modified Kneser-Ney model follows by grouping and joining: continuation counts, three discounts per order from the
counts of counts, interpolated probabilities from the lowest order up, and back-off weights. No n-gram is left out. Up to ``SHIPPED``
distinct n-grams of the highest order, the model goes to the tasks in arrays of hashes, sorted, beside arrays of log probabilities; a
lookup is a binary search. Beyond, it stays a table: texts of a language are put together in chunks of about ``CHUNK`` characters, each
chunk lists its distinct n-grams once, these meet the model by join, and the chunk's texts are scored with the answers to its own list, so
that no task and not the driver holds more of the model than a chunk can ask for. Both ways give the same probabilities.

Bands: the log perplexity per character of a text should lie near its language's median. A language's band reaches
``WIDTH`` robust standard deviations to either side, with what chance adds to a text of its length, and at least as far as
``FACTOR`` times the usual perplexity, so that texts with a passage in another language stay. Documents outside their
language's upper or lower band are rejected, as are those that fail the base rules. N-grams are counted in all texts but
those full of symbols (``SYMBOL_SHARE``).

Defined cases: a null or wordless text has no n-grams, perplexity null, and fails the base rules; a null language is a language of
its own; repeated rows are separate documents; an empty table gives no rows. Columns that the operator does not know stay as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from draftloom.llm.common import own, small_batches
from draftloom.session import checkpoint

ORDER = 5
#: A band reaches this many standard deviations, and at least to half and to 2.8 times the usual perplexity of the language.
WIDTH, FACTOR = 6.0, (0.5, 2.8)
LEAST_SPREAD = 0.02
#: Texts with more symbols for each word than this are scored but not learned from: a model of junk calls junk usual.
SYMBOL_SHARE = 0.1
UNKNOWN = "und"
#: Characters that a packed n-gram can tell apart (bits per character of a 64-bit key).
ALPHABET_BITS = 12
#: Distinct n-grams a task holds before it hands them on.
HELD = 3_000_000
#: Distinct n-grams of the highest order up to which a model is sent to the tasks; with the shorter ones some 60 MB.
SHIPPED = 2_000_000
#: Characters after which a chunk of texts ends, and those that are taken apart at a time.
CHUNK, SLICE = 32_000_000, 2_000_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = "#*$%&|<>"
FACTORS = np.random.default_rng(5).integers(1, 2**63, size=16, dtype=np.uint64) | np.uint64(1)


def normal(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "surrogatepass").lower().replace("\n", " ")


def codes(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of texts, each after ``order - 1`` marks; places where an n-gram ends; number of the text at each such place."""
    lead = "\n" * (order - 1)
    joined = lead + lead.join(texts) + "\n" if texts else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths + order - 1) - lengths
    # The mark after the last character ends the text; it is the first of the next text's marks.
    counts = np.where(lengths > 0, lengths + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    places = np.arange(len(owner)) - first[owner] + starts[owner]
    return points, places, owner


def count_grams(points: np.ndarray, places: np.ndarray, order: int = ORDER) -> dict[str, int]:
    """Counts of the n-grams that end at the places."""
    alphabet, letter = np.unique(points, return_inverse=True)
    if len(alphabet) > 1 << ALPHABET_BITS or order * ALPHABET_BITS > 60:
        text = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return Counter(text[p - order + 1:p + 1] for p in places.tolist())
    letter = letter.astype(np.uint64)
    key = np.zeros(len(places), dtype=np.uint64)
    for back in range(order - 1, -1, -1):
        key = (key << np.uint64(ALPHABET_BITS)) | letter[places - back]
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.concatenate((first, [len(key)])))
    key = key[first]
    spelled = np.stack([alphabet[((key >> np.uint64(ALPHABET_BITS * back)) & np.uint64((1 << ALPHABET_BITS) - 1)).astype(np.int64)] for back in range(order - 1, -1, -1)], axis=1)
    text = spelled.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return dict(zip((text[i:i + order] for i in range(0, len(text), order)), counts.tolist()))


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each n-gram of the highest order occurs in all texts of a language."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for language, rows in batch.groupby("lang"):
                split = [(t or "", (t or "").encode("utf-8", "surrogatepass").split()) for t in rows["text"]]
                points, places, _ = codes([normal(words) for t, words in split if symbols(t) <= SYMBOL_SHARE * len(words)], order)
                held.setdefault(language, Counter()).update(count_grams(points, places, order))
            if sum(map(len, held.values())) > HELD:
                yield from out(held)
                held.clear()
        yield from out(held)

    def out(held: dict[str, Counter]) -> Iterator[pd.DataFrame]:
        for language, grams in held.items():
            names, counts = list(grams), list(grams.values())
            for at in range(0, len(names), 100_000):
                yield pd.DataFrame({"lang": language, "gram": names[at:at + 100_000], "n": counts[at:at + 100_000]})

    rows = docs.select(F.coalesce(lang, F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _slices(lengths: list[int], most: int = SLICE) -> Iterator[range]:
    """Stretches of texts that hold about ``most`` characters, one text at least."""
    first, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield range(first, i)
            first, size = i, 0
        size += n
    if first < len(lengths):
        yield range(first, len(lengths))


def _packed(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _unpacked(data: bytes) -> str:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], size, asbytes=True).decode("utf-8", "surrogatepass") if size else ""


def gram_keys(grams: list[str]) -> np.ndarray:
    """Hashes of n-grams of one length."""
    k = len(grams[0]) if grams else 0
    points = np.frombuffer(("\n" + "".join(grams)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return hashes(points, np.arange(1, len(grams) + 1) * k, k)


def chunks(docs: DataFrame, keep: list[str], lang: str = "lang", text: str = "text", order: int = ORDER, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Texts in chunks of one language, and the distinct n-grams of every chunk.

    Texts: the columns ``keep``, lang, chunk, place, length (of the text as it is scored), body and the base counts. The first text of
    every slice has the bodies of all that follow by place up to the next one, packed. N-grams: (chunk, lang, gram, n); ``n`` counts the
    texts that the model learns from, so it is zero for what only the others hold.
    """
    small_batches(docs.sparkSession)
    tongue, body = own("lang"), own("text")
    rows = docs.select(*keep, F.coalesce(lang, F.lit(UNKNOWN)).alias(tongue), F.col(text).alias(body))
    extra = "chunk long, place long, length long, body binary, gram string, n long, " + ", ".join(f"{c} long" for c in COUNTS)
    # Rows of n-grams have no texts and the other way round.
    schema = StructType([*[StructField(f.name, f.dataType) for f in rows.drop(body).schema], *StructType.fromDDL(extra).fields])
    added = {"chunk": pa.int64(), "place": pa.int64(), "length": pa.int64(), "body": pa.binary(), "gram": pa.string(), "n": pa.int64(), **{c: pa.int64() for c in COUNTS}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = TaskContext.get().partitionId() << 33, 0
        #: Per language: chunk, its n-grams, its characters.
        held: dict[str, list] = {}
        kinds: dict[str, pa.DataType] = {}

        def made(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))

        def out(language: str) -> Iterator[pa.RecordBatch]:
            chunk, grams, _ = held.pop(language)
            names, counts = list(grams), list(grams.values())
            for at in range(0, len(names), 100_000):
                some = names[at:at + 100_000]
                yield made({tongue: pa.array([language] * len(some), kinds[tongue]), "chunk": pa.array([chunk] * len(some), pa.int64()), "gram": pa.array(some, pa.string()),
                            "n": pa.array(counts[at:at + 100_000], pa.int64())}, len(some))

        for batch in batches:
            kinds = {f.name: f.type for f in batch.schema if f.name != body} | added
            bodies = [t or "" for t in batch.column(body).to_pylist()]
            split = [t.encode("utf-8", "surrogatepass").split() for t in bodies]
            counts = np.array([base_counts(t, w) for t, w in zip(bodies, split)], dtype=np.int64).reshape(-1, len(COUNTS))
            texts = [normal(w) for w in split]
            learned = [symbols_ <= SYMBOL_SHARE * len(w) for symbols_, w in zip(counts[:, 2], split)]
            chunk, place, packed = np.zeros(len(bodies), dtype=np.int64), np.zeros(len(bodies), dtype=np.int64), [None] * len(bodies)
            full = []
            for language, numbers in pd.Series(range(len(bodies))).groupby(np.array(batch.column(tongue).to_pylist(), dtype=object)):
                at = numbers.to_numpy()
                for part in _slices([len(texts[i]) for i in at], min(size, SLICE)):
                    here = at[part.start:part.stop]
                    if language not in held:
                        held[language] = [number, {}, 0]
                        number += 1
                    chunk[here], grams = held[language][:2]
                    place[here] = np.arange(seen, seen + len(here))
                    seen += len(here)
                    packed[here[0]] = _packed("".join(texts[i] for i in here))
                    for use in (True, False):
                        points, places, _ = codes([texts[i] for i in here if learned[i] == use], order)
                        for gram, n in count_grams(points, places, order).items():
                            grams[gram] = grams.get(gram, 0) + (n if use else 0)
                    held[language][2] += sum(len(texts[i]) for i in here)
                    if held[language][2] >= size:
                        full.extend(out(language))
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != body} | {c: pa.array(counts[:, i]) for i, c in enumerate(COUNTS)}
            columns |= {"chunk": pa.array(chunk), "place": pa.array(place), "length": pa.array([len(t) for t in texts], pa.int64()), "body": pa.array(packed, pa.binary())}
            yield made(columns, len(bodies))
            yield from full
            if sum(len(grams) for _, grams, _ in held.values()) > HELD:
                for language in list(held):
                    yield from out(language)
        for language in list(held):
            yield from out(language)

    listed = checkpoint(rows.mapInArrow(run, schema))
    texts = listed.where("gram is null").select(*keep, F.col(tongue).alias("lang"), "chunk", "place", "length", "body", *COUNTS)
    return texts, listed.where("gram is not null").select("chunk", F.col(tongue).alias("lang"), "gram", "n")


def kneser_ney(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, k, gram, logp, backoff) of a modified Kneser-Ney model from counts of the highest order.

    ``logp`` is null in rows that only carry the back-off weight of a context, ``backoff`` in rows that are no context. N-grams with a
    count of zero are not learned from: they and their ends get what the model says of them. A language of such only has no model.
    """
    levels = {order: checkpoint(grams.select("lang", "gram", "n"))}
    for k in range(order - 1, 0, -1):
        shorter = levels[k + 1].select("lang", F.substring("gram", 2, k).alias("gram"), "n")
        levels[k] = checkpoint(shorter.groupBy("lang", "gram").agg(F.count_if(F.col("n") > 0).alias("n")))

    def of(n: int):
        return F.sum(F.when(F.col("n") == n, 1.0).otherwise(0.0))

    parts, lower = [], None
    for k in range(1, order + 1):
        level = levels[k].withColumn("context", F.substring("gram", 1, k - 1) if k > 1 else F.lit(""))
        stats = level.groupBy("lang").agg(*[of(n).alias(f"n{n}") for n in range(1, 5)], F.count_if(F.col("n") > 0).alias("types")).where("types > 0")
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

        def discount(n: int):
            exact = n - F.try_divide((n + 1) * y * F.col(f"n{n + 1}"), F.col(f"n{n}"))
            # Where counts of counts are missing, half a count per step.
            return F.when((F.col(f"n{n}") > 0) & (F.col("n1") > 0) & (exact > 0) & (exact < n), exact).otherwise(0.5 * n).alias(f"d{n}")

        stats = stats.select("lang", "types", *[discount(n) for n in (1, 2, 3)])
        level = level.join(stats, "lang")
        level = level.withColumn("d", F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = level.groupBy("lang", "context").agg(F.sum("n").alias("of_context"), F.sum("d").alias("freed"))
        level = level.join(contexts, ["lang", "context"])
        # A context that was not seen leaves all to the shorter one.
        gamma = F.when(F.col("of_context") > 0, F.col("freed") / F.col("of_context")).otherwise(1.0)
        if lower is None:
            level = level.withColumn("below", 1.0 / (F.col("types") + 1))
        else:
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            level = level.withColumn("suffix", F.substring("gram", 2, k - 1)).join(below, ["lang", "suffix"])
        level = level.withColumn("p", (F.col("n") - F.col("d")) / F.greatest("of_context", F.lit(1)) + gamma * F.col("below"))
        lower = checkpoint(level.select("lang", "gram", "context", "p", F.when(F.col("of_context") > 0, gamma).alias("gamma"), "types"))
        # What is left for n-grams that a context was not seen with.
        weights = lower.where("gamma is not null").groupBy("lang", "context").agg(F.log(F.first("gamma")).alias("backoff"))
        parts.append(lower.select("lang", F.lit(k).alias("k"), "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff")))
        parts.append(weights.select("lang", F.lit(k - 1).alias("k"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("logp"), "backoff"))
        if k == 1:
            parts.append(lower.groupBy("lang").agg(F.first("types").alias("types")).select(
                "lang", F.lit(0).alias("k"), F.lit("").alias("gram"), (-F.log(F.col("types") + 1)).alias("logp"), F.lit(None).cast("double").alias("backoff")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def hashes(points: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k characters that end at the places."""
    total = np.full(len(places), k, dtype=np.uint64)
    for back in range(k):
        total += points[places - back].astype(np.uint64) * FACTORS[back]
    return total


class Arrays:
    """A language's model: per order the sorted hashes of n-grams with log probabilities, and of contexts with back-off weights."""

    def __init__(self, order: int) -> None:
        empty = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32)
        self.order, self.grams, self.contexts, self.floor = order, [empty] * (order + 1), [empty] * (order + 1), 0.0

    @staticmethod
    def find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found) of hashes in a table."""
        known, values = table
        if not len(known):
            return np.zeros(len(keys), dtype=np.float32), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return values[at], known[at] == keys

    def score(self, points: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Log probability of the character at each place, given those before it."""
        out = np.zeros(len(places))
        open_ = np.arange(len(places))
        for k in range(self.order, 0, -1):
            values, found = self.find(self.grams[k], hashes(points, places[open_], k))
            out[open_[found]] += values[found]
            open_ = open_[~found]
            if not len(open_):
                return out
            weight, known = self.find(self.contexts[k - 1], hashes(points, places[open_] - 1, k - 1))
            out[open_] += np.where(known, weight, 0)
        out[open_] += self.floor
        return out


def load(model: DataFrame, order: int = ORDER) -> dict[str, Arrays]:
    """Sorted hash arrays per language, of a model that fits into one process. Tasks sort the rows of one language and length into arrays of bytes."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["k"].iloc[0])
        keys = gram_keys(list(frame["gram"]))
        out = {"lang": [frame["lang"].iloc[0]], "k": [k]}
        for column in ("logp", "backoff"):
            own_rows = frame[column].notna().to_numpy()
            mine, values = keys[own_rows], frame[column].to_numpy(dtype=np.float32)[own_rows]
            order_ = np.argsort(mine)
            out |= {f"{column}_keys": [mine[order_].tobytes()], column: [values[order_].tobytes()]}
        return pd.DataFrame(out)

    rows = model.groupBy("lang", "k").applyInPandas(pack, "lang string, k int, logp_keys binary, logp binary, backoff_keys binary, backoff binary").collect()
    out: dict[str, Arrays] = {}
    for r in rows:
        arrays = out.setdefault(r.lang, Arrays(order))
        arrays.grams[r.k] = np.frombuffer(r.logp_keys, dtype=np.uint64), np.frombuffer(r.logp, dtype=np.float32)
        arrays.contexts[r.k] = np.frombuffer(r.backoff_keys, dtype=np.uint64), np.frombuffer(r.backoff, dtype=np.float32)
        if r.k == 0 and len(arrays.grams[0][1]):
            arrays.floor = float(arrays.grams[0][1][0])
    return out


def symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def base_counts(text: str, words: list[bytes], window: int = WINDOW) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    n = len(words)
    chars = len(b"".join(words).decode("utf-8", "surrogatepass")) if n else 0
    lines = Counter(line for line in text.split("\n") if line.encode("utf-8", "surrogatepass").split()) if "\n" in text else {}
    again = sum(lines.values()) - len(lines) if lines else 0
    return n, chars, symbols(text), again, _repeated(words, window) if n > window else 0


def _repeated(words: list[bytes], window: int) -> int:
    """Words that lie in windows found twice or more."""
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - window + 1
    # Two independent 64-bit sums stand for a window.
    one, two = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    mixed = (numbers + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for j in range(window):
        one += mixed[j:j + n] * FACTORS[j]
        two += mixed[j:j + n] * FACTORS[j + 8]
    if len(np.unique(one)) == n:
        return 0
    _, inverse, counts = np.unique(np.stack([one, two], axis=1), axis=0, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse.ravel()] > 1)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(docs: DataFrame, models: dict[str, Arrays], lang: str = "lang", text: str = "text", order: int = ORDER, column: str = "quality") -> DataFrame:
    """Add a struct column: base counts, characters scored, their mean log probability and its variance per character. The model goes to all tasks."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(models)
    kind = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_scored long, mean double, variance double"

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for languages, texts in batches:
            bodies = [t or "" for t in texts]
            split = [t.encode("utf-8", "surrogatepass").split() for t in bodies]
            frame = pd.DataFrame([base_counts(t, w) for t, w in zip(bodies, split)], columns=list(COUNTS))
            scored, mean, variance = np.zeros(len(bodies), dtype=np.int64), np.full(len(bodies), np.nan), np.full(len(bodies), np.nan)
            for language, rows in pd.Series(range(len(bodies))).groupby(languages.to_numpy()):
                model = shipped.value.get(language)
                if model is None:
                    continue
                points, places, owner = codes([normal(split[i]) for i in rows], order)
                # Each n-gram of the batch is looked up once, in the order of the arrays.
                _, first, which = np.unique(hashes(points, places, order), return_index=True, return_inverse=True)
                logs = model.score(points, places[first])[which]
                n = np.bincount(owner, minlength=len(rows))
                with np.errstate(invalid="ignore", divide="ignore"):
                    middle = np.bincount(owner, logs, len(rows)) / n
                    around = np.bincount(owner, (logs - middle[owner]) ** 2, len(rows)) / n
                at = rows.to_numpy()
                scored[at], mean[at], variance[at] = n, middle, around
            yield frame.assign(lang=languages.to_numpy(), n_scored=scored, mean=mean, variance=variance)[[x.split(" ")[0] for x in kind.split(", ")]]

    return docs.withColumn(column, run(F.coalesce(F.col(lang), F.lit(UNKNOWN)), F.col(text)))


def measure_chunks(texts: DataFrame, listed: DataFrame, model: DataFrame, keep: list[str], order: int = ORDER, column: str = "quality") -> DataFrame:
    """The columns ``keep`` and a struct column: base counts, characters scored, their mean log probability and its variance per character.

    ``texts`` is what :func:`chunks` returns, ``listed`` (lang, gram, chunks) names the chunks that hold an n-gram, which ``model`` all
    has. Each chunk meets the probabilities of its n-grams; texts of a language without a model are not scored.
    """
    small_batches(texts.sparkSession)
    tongue = own("lang")
    known = model.where((F.col("k") == order) & F.col("logp").isNotNull()).select("lang", "gram", "logp")
    answers = listed.select("lang", "gram", "chunks").hint("merge").join(known.hint("merge"), ["lang", "gram"])
    answers = answers.select(F.explode("chunks").alias("of"), "gram", F.col("logp").cast("float").alias("logp"))
    rows = texts.select(*keep, F.col("lang").alias(tongue), "chunk", "place", "length", "body", *COUNTS)
    schema = StructType([*rows.select(*keep, tongue, *COUNTS).schema.fields, *StructType.fromDDL("n_scored long, mean double, variance double").fields])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = gram_keys(right.column("gram").to_pylist())
        at = np.argsort(known)
        model = known[at], right.column("logp").to_numpy()[at]
        rows = np.argsort(left.column("place").to_numpy())
        lengths, bodies = left.column("length").to_numpy()[rows], left.column("body").take(pa.array(rows)).to_pylist()
        scored, mean, variance = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), np.nan), np.full(len(rows), np.nan)
        firsts = [i for i, data in enumerate(bodies) if data is not None]
        for first, end in zip(firsts, [*firsts[1:], len(rows)]) if len(known) else ():
            text, ends = _unpacked(bodies[first]), np.cumsum(lengths[first:end])
            points, places, owner = codes([text[b - n:b] for b, n in zip(ends.tolist(), lengths[first:end].tolist())], order)
            logs = Arrays.find(model, hashes(points, places, order))[0].astype(np.float64)
            n = np.bincount(owner, minlength=end - first)
            with np.errstate(invalid="ignore", divide="ignore"):
                middle = np.bincount(owner, logs, end - first) / n
                around = np.bincount(owner, (logs - middle[owner]) ** 2, end - first) / n
            scored[rows[first:end]], mean[rows[first:end]], variance[rows[first:end]] = n, middle, around
        made = [pa.array(scored), *[pa.array(x, from_pandas=True) for x in (mean, variance)]]
        return pa.Table.from_arrays([left.column(c) for c in (*keep, tongue, *COUNTS)] + made, names=[f.name for f in schema])

    measured = rows.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(run, schema)
    return measured.select(*keep, F.struct(F.col(tongue).alias("lang"), *COUNTS, "n_scored", "mean", "variance").alias(column))


def bands(measured: DataFrame, column: str = "quality") -> DataFrame:
    """(lang, middle, spread, variance) over all documents: a language's usual log perplexity and how far it strays."""
    fine = measured.where((F.col(f"{column}.n_scored") > 0) & ~F.isnan(f"{column}.mean"))
    quartiles = F.percentile_approx(-F.col(f"{column}.mean"), [0.25, 0.5, 0.75], 10_000)
    made = fine.groupBy(F.col(f"{column}.lang").alias("lang")).agg(quartiles.alias("q"), F.percentile_approx(f"{column}.variance", 0.5).alias("variance"))
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(LEAST_SPREAD))
    return made.select("lang", F.col("q")[1].alias("middle"), spread.alias("spread"), "variance")


def judge(docs: DataFrame, lang: str = "lang", text: str = "text", carry: list[str] | None = None, order: int = ORDER, shipped: int = SHIPPED,
          width: float = WIDTH, factor: tuple[float, float] = FACTOR) -> DataFrame:
    """Per document n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, perplexity (per character) and kept.

    ``carry`` names the columns of the input that come along (all, if None). Those named like the operator's own give way.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c not in (*COUNTS, "base_failed", "perplexity", "kept")]
    quality = own("quality")
    counted = checkpoint(gram_counts(docs, lang, text, order))
    if counted.count() <= shipped:
        scored = measure(docs, load(kneser_ney(counted, order), order), lang, text, order, quality).select(*keep, quality)
    else:
        # The operator's own names, so that none of the caller's columns meets them.
        names = [own(c) for c in keep]
        rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(lang).alias("lang"), F.col(text).alias("text"))
        texts, grams = chunks(rows, names, order=order)
        listed = checkpoint(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks")))
        scored = measure_chunks(texts, listed, kneser_ney(listed, order), names, order, quality).select(*[F.col(n).alias(c) for c, n in zip(keep, names)], quality)
    measured = checkpoint(scored)
    mine = own("lang")
    limits = bands(measured, quality).withColumnRenamed("lang", mine)
    joined = measured.join(limits, F.col(f"{quality}.lang") == F.col(mine), "left")
    reach = F.sqrt(limits["spread"] ** 2 + F.try_divide(limits["variance"], F.col(f"{quality}.n_scored")))
    gap = -F.col(f"{quality}.mean") - limits["middle"]
    low, high = F.least(-width * reach, F.lit(math.log(factor[0]))), F.greatest(width * reach, F.lit(math.log(factor[1])))
    inside = F.coalesce((gap <= high) & (gap >= low), F.lit(False))
    n, repeated = F.col(f"{quality}.n_words"), F.col(f"{quality}.n_repeat_words")
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
    usual = F.when(F.col(f"{quality}.n_scored") > 0, F.exp(-F.col(f"{quality}.mean")))
    return joined.select(*[measured[c] for c in keep], *[F.col(f"{quality}.{c}").alias(c) for c in COUNTS], failed.alias("base_failed"), usual.alias("perplexity"),
                         (~failed & inside).alias("kept"))
