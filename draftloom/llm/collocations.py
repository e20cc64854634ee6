"""Phrases whose words belong together, mined with mergeable Misra-Gries summaries.

First pass: tasks hash the runs of one to four words of their texts and summarise them per hash partition. A summary keeps
counters; summaries of a partition merge by adding counters and, if there are more than the capacity, by taking the value of the
first one too many from all. With a capacity above ``mass / threshold`` every phrase that occurs ``threshold`` times keeps a
counter, whatever the texts look like: what a partition lost in all is known, and a phrase survives if its counter
and that loss reach the threshold. The summary of one buffer has room for all its phrases and loses nothing. A phrase that very
many rows repeat is one counter per buffer, so no hash partition is hot.

Second pass: phrases whose hash survived are counted exactly, by their words. Tasks know the survivors from a bitmap of fixed size
(``2 ** BITS`` bits); a phrase that shares a bit with a survivor is counted too and goes by its exact count. Sums, cuts,
scores and containment are joins of the counted phrases.

Texts are read whole, in slices of a fixed number of bytes that carry the last words over, so memory does not grow with a text.

Defined cases: a null text is empty and a null language is ``und``; repeated rows count again; equal scores are put in order by
count, then phrase, so ranks are certain; words are split at spaces and tabs only, other control characters belong to words; an empty table
gives no rows; columns other than text and language are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftloom.llm.common import small_batches
from draftloom.session import checkpoint

THRESHOLD = 30
LONGEST = 4
KEEP = 2000
#: A candidate inside a longer phrase goes if the longer one has at least this share of its count, in percent.
COVERED = 80
UNKNOWN = "und"
#: Hashes that a task holds before it writes their summaries.
BUFFER = 1 << 21
#: Bytes of text for which there is one hash partition at least.
PART_BYTES = 1 << 24
#: Counters of a partition, as a multiple of mass / threshold; the loss stays below threshold / SPARE.
SPARE = 4
#: Size of the bitmap of survivors, as a power of two.
BITS = 27
HASH_BITS = 48
#: Counters in one row of a summary, so that batches of rows stay small.
ROW_COUNTERS = 4096
SLICE = 1 << 20
#: Words a task remembers, and counted phrases it holds before it writes them.
WORDS_HELD = 3 << 17
PHRASES_HELD = 3 << 18

BREAK = b"."
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)


class _Words(dict):
    """Numbers and hashes of the words a task has met; the break between pieces has number 0."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[bytes] = []
        self._new: list[int] = []
        self._hashes = np.empty(0, np.uint64)
        self[BREAK]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append(word)
        self._new.append(xxhash.xxh64_intdigest(word))
        return number

    def hashes(self) -> np.ndarray:
        if self._new:
            self._hashes = np.concatenate([self._hashes, np.array(self._new, np.uint64)])
            self._new = []
        return self._hashes


def _slices(data: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut between words only."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(BREAK, at, end))
            if cut <= at:
                ends = [x for x in (data.find(b" ", end), data.find(BREAK, end)) if x >= 0]
                cut = min(ends, default=len(data))
            end = cut
        yield data[at:end]
        at = end


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, folded texts) of a batch of (language, text), a break between two texts."""
    by_language: dict[str, list[bytes]] = {}
    for language, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        if text:
            by_language.setdefault(UNKNOWN if language is None else language, []).append(text)
    for language, texts in by_language.items():
        yield language, BREAK.join(texts).translate(_FOLD)


def _numbered(data: bytes, words: _Words, longest: int, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """(word numbers, how many were there before) for each slice of a folded text."""
    carried = np.empty(0, np.int64)
    for part in _slices(data, size):
        tokens = part.replace(BREAK, b" . ").split()
        ids = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
        both = np.concatenate([carried, ids])
        yield both, len(carried)
        carried = both[max(0, len(both) - longest + 1):]


def _grams(ids: np.ndarray, fresh: int, words: _Words, seed: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts, hashes) of all runs of n words without a break that end in a new word."""
    single = words.hashes()[ids]
    broken = bad = ids == 0
    h = _mix(single ^ np.uint64(seed))
    for n in range(1, longest + 1):
        if n > 1:
            h = _mix(h[:-1] * np.uint64(31) + single[n - 1:])
            bad = bad[:-1] | broken[n - 1:]
        first = max(0, fresh - n + 1)
        at = np.flatnonzero(~bad[first:]) + first
        yield n, at, h[at]


def _seed(language: str) -> int:
    return xxhash.xxh64_intdigest(language.encode(), 1)


def shrink(hashes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, counts, loss): at most ``capacity`` counters; the count of the first one too many is taken from all."""
    if len(counts) <= capacity:
        return hashes, counts, 0
    loss = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > loss
    return hashes[left], counts[left] - loss, loss


def add_up(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and their summed counts."""
    if not len(hashes):
        return hashes, counts
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[heads], np.add.reduceat(counts, heads)


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers in the smallest width that holds all."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}") if n else np.empty(0, np.uint8)


_SUMMARY = "part int, kind int, mass long, n int, gaps binary, counts binary"


def _summaries(docs: DataFrame, part_bits: int, longest: int, buffer: int, size: int) -> DataFrame:
    """Summaries of each buffer of each task: a row with the mass (kind 0) and one with the counters (kind 1) per hash partition."""
    def flushed(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(held)
        held.clear()
        hashes.sort()
        heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        counts = np.diff(heads, append=len(hashes)).astype(np.uint32)
        hashes = hashes[heads]
        bounds = np.searchsorted(hashes, np.arange((1 << part_bits) + 1, dtype=np.uint64) << np.uint64(HASH_BITS - part_bits))
        rows = []
        for part in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
            start, end = int(bounds[part]), int(bounds[part + 1])
            rows.append((part, 0, int(counts[start:end].sum()), 0, None, None))
            for a in range(start, end, ROW_COUNTERS):
                b = min(end, a + ROW_COUNTERS)
                gaps = np.diff(hashes[a:b], prepend=np.uint64(part << (HASH_BITS - part_bits)))
                rows.append((part, 1, 0, b - a, _packed(gaps), _packed(counts[a:b])))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["part", "kind", "mass", "n", "gaps", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n_held = _Words(), [], 0
        for batch in batches:
            for language, data in _streams(batch):
                if len(words) > WORDS_HELD:
                    words = _Words()
                for ids, fresh in _numbered(data, words, longest, size):
                    for _, _, h in _grams(ids, fresh, words, _seed(language), longest):
                        held.append(h >> np.uint64(64 - HASH_BITS))
                        n_held += len(h)
                    if n_held >= buffer:
                        yield flushed(held)
                        n_held = 0
        if n_held:
            yield flushed(held)

    return docs.mapInArrow(run, _SUMMARY)


def _survivors(summaries: DataFrame, part_bits: int, bits: int, threshold: int, spare: int, tasks: int) -> DataFrame:
    """(part, bitmap): the bits of the hashes that may reach the threshold, for each hash partition.

    Summaries come in order of partition, masses first, so capacity is known before the first merge and memory holds
    the counters of one partition only.
    """
    width = 1 << max(0, bits - part_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, lost, waiting, n_waiting = None, 0, 0, [], 0
        state = (np.empty(0, np.uint64), np.empty(0, np.int64))

        def settle() -> None:
            nonlocal state, lost, waiting, n_waiting
            hashes, counts = add_up(np.concatenate([state[0], *(h for h, _ in waiting)]), np.concatenate([state[1], *(c for _, c in waiting)]))
            hashes, counts, loss = shrink(hashes, counts, spare * (mass // threshold + 1))
            state, lost, waiting, n_waiting = (hashes, counts), lost + loss, [], 0

        def result() -> pa.RecordBatch:
            settle()
            left = state[0][state[1] + lost >= threshold]
            marks = np.zeros(width, bool)
            marks[(left >> np.uint64(HASH_BITS - bits)).astype(np.int64) - part * width] = True
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(marks).tobytes()], pa.binary())], names=["part", "bitmap"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if part is not None:
                        yield result()
                    part, mass, lost = row["part"], 0, 0
                    state = (np.empty(0, np.uint64), np.empty(0, np.int64))
                if row["kind"] == 0:
                    mass += row["mass"]
                    continue
                gaps = _unpacked(row["gaps"], row["n"]).astype(np.uint64)
                hashes = np.cumsum(gaps, dtype=np.uint64) + np.uint64(part << (HASH_BITS - part_bits))
                waiting.append((hashes, _unpacked(row["counts"], row["n"]).astype(np.int64)))
                n_waiting += row["n"]
                if n_waiting >= max(len(state[0]) // 2, 1 << 17):
                    settle()
        if part is not None:
            yield result()

    dealt = summaries.repartition(tasks, "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(run, "part int, bitmap binary")


def sum_equal(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows, counts) with equal rows summed. Rows of one hash are taken as equal unless their numbers differ, which is looked at."""
    hashes, rows, counts = (np.concatenate(x) for x in zip(*held))
    if not len(hashes):
        return hashes, rows, counts
    order = np.argsort(hashes, kind="stable")
    hashes, rows, counts = hashes[order], rows[order], counts[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    heads = np.flatnonzero(new)
    if (rows != rows[heads[np.cumsum(new) - 1]]).any():
        rows, first, place = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        return hashes[first], rows, np.bincount(place.ravel(), weights=counts, minlength=len(rows)).astype(np.int64)
    return hashes[heads], rows[heads], np.add.reduceat(counts, heads)


_BLOCK = "part int, lang string, phrases binary, counts binary, total long"


def _counted(docs: DataFrame, bitmap, bits: int, part_bits: int, longest: int, size: int) -> DataFrame:
    """Counts of each task for phrases whose bit is set, in blocks of one hash partition and language; ``total`` counts all words of the language."""
    def blocks(languages: list[str], words: _Words, hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = (hashes >> np.uint64(64 - part_bits)).astype(np.int64)
        order = np.lexsort((rows[:, 0], part))
        owner = part[order] * len(languages) + rows[order, 0]
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        out = []
        for start, end in zip(cuts, np.append(cuts[1:], len(order))):
            for a in range(start, end, ROW_COUNTERS):
                here = order[a:min(end, a + ROW_COUNTERS)]
                phrases = b"\n".join([b" ".join([words.names[i] for i in row if i]) for row in rows[here, 1:].tolist()])
                out.append((int(part[here[0]]), languages[rows[here[0], 0]], phrases, _packed(counts[here]), 0))
            if len(out) >= 256:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["part", "lang", "phrases", "counts", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).view(bool) if bits <= 24 else None
        packed = np.frombuffer(bitmap.value, np.uint8)

        def survives(h: np.ndarray) -> np.ndarray:
            bit = (h >> np.uint64(64 - bits)).astype(np.int64)
            return marks[bit] if marks is not None else (packed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1

        words, languages, seen = _Words(), [], {}
        singles: dict[int, np.ndarray] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = 0

        def single_blocks() -> Iterator[pa.RecordBatch]:
            known = words.hashes()
            for language, counts in singles.items():
                yield batch_of([(0, languages[language], b"", b"", int(counts[1:].sum()))])
                number = np.flatnonzero(counts[1:]) + 1
                h = _mix(known[number] ^ np.uint64(_seed(languages[language])))
                left = survives(h)
                number, h = number[left], h[left]
                yield from blocks(languages, words, h, np.stack([np.full(len(number), language), number], axis=1), counts[number])

        def phrase_blocks() -> Iterator[pa.RecordBatch]:
            if held:
                yield from blocks(languages, words, *sum_equal(held))

        for batch in batches:
            for language, data in _streams(batch):
                if len(words) > WORDS_HELD:
                    yield from single_blocks()
                    yield from phrase_blocks()
                    words, singles, held, n_held = _Words(), {}, [], 0
                number = seen.setdefault(language, len(seen))
                if number == len(languages):
                    languages.append(language)
                for ids, fresh in _numbered(data, words, longest, size):
                    found = np.bincount(ids[fresh:], minlength=len(words.names))
                    if number in singles:
                        found[:len(singles[number])] += singles[number]
                    singles[number] = found
                    for n, at, h in _grams(ids, fresh, words, _seed(language), longest):
                        if n == 1:
                            continue
                        left = survives(h)
                        at, h = at[left], h[left]
                        row = np.zeros((len(at), longest + 1), np.int32)
                        row[:, 0] = number
                        for k in range(n):
                            row[:, k + 1] = ids[at + k]
                        held.append((h, row, np.ones(len(h), np.int64)))
                        n_held += len(h)
                    if n_held >= PHRASES_HELD:
                        held = [sum_equal(held)]
                        n_held = len(held[0][0])
                        if n_held >= PHRASES_HELD * 2 // 3:
                            yield from phrase_blocks()
                            held, n_held = [], 0
        yield from single_blocks()
        yield from phrase_blocks()

    return docs.mapInArrow(run, _BLOCK)


def _added(blocks: DataFrame, threshold: int, tasks: int) -> DataFrame:
    """(lang, phrase, f) summed over blocks, by the phrases themselves; memory holds one hash partition of one language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, sums, total = None, {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            found = [(phrase, n) for phrase, n in sums.items() if n >= threshold]
            for at in range(0, len(found), 1 << 14):
                phrases, counts = zip(*found[at:at + (1 << 14)])
                yield pa.RecordBatch.from_arrays([pa.array([owner[1]] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([owner[1]]), pa.array([None], pa.string()), pa.array([total], pa.int64())], names=["lang", "phrase", "f"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["lang"]) != owner:
                    if owner is not None:
                        yield from out()
                    owner, sums, total = (row["part"], row["lang"]), {}, 0
                total += row["total"]
                if row["phrases"]:
                    phrases = row["phrases"].split(b"\n")
                    for phrase, n in zip(phrases, _unpacked(row["counts"], len(phrases)).tolist()):
                        sums[phrase] = sums.get(phrase, 0) + n
        if owner is not None:
            yield from out()

    return blocks.repartition(tasks, "part").sortWithinPartitions("part", "lang").mapInArrow(run, "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, buffer: int = BUFFER,
                     part_bytes: int = PART_BYTES, spare: int = SPARE, bits: int = BITS, size: int = SLICE) -> DataFrame:
    """(lang, phrase, f): exact counts of all runs of up to ``longest`` words with at least ``threshold`` occurrences; a null phrase counts all words."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_bits = min(bits - 3, max(1, (max(tasks, n_bytes // part_bytes) - 1).bit_length()))
    summaries = _summaries(rows, part_bits, longest, buffer, size)
    bitmap = bytearray(1 << bits - 3)
    width = 1 << bits - 3 - part_bits
    # Bits of a partition are a range of the bitmap: in all, what comes to the driver is the bitmap once.
    for part in _survivors(summaries, part_bits, bits, threshold, spare, tasks).collect():
        bitmap[part["part"] * width:(part["part"] + 1) * width] = part["bitmap"]
    counted = _counted(rows, spark.sparkContext.broadcast(bytes(bitmap)), bits, part_bits, longest, size)
    return _added(counted, threshold, tasks)


def rank_phrases(phrases: DataFrame, keep: int = KEEP, covered: int = COVERED, salts: int = 256) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from exact counts: worst cut, containment, first ``keep`` of each language.

    The order of a language is made in two steps, first within ``salts`` shares of its phrases.
    """
    totals = phrases.where("phrase is null").select("lang", F.col("f").alias("n"))
    known = phrases.where("phrase is not null")
    candidates = known.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).where("size(w) >= 2")
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div cast(l + r as decimal(19,0))").cast("long")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    inside = candidates.where("size(w) >= 3").select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inside = inside.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("at"))
    inside = inside.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = worst.join(inside, ["lang", "phrase"], "left")
    # Shares of a hundred in decimals: counts times a hundred may pass 64 bits.
    share = F.col("longer").cast("decimal(19,0)") * 100 >= F.col("cut.a").cast("decimal(19,0)") * covered
    free = free.where(F.col("longer").isNull() | ~share).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    first = free.withColumn("rank", F.row_number().over(shares)).where(F.col("rank") <= keep)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= keep)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, keep: int = KEEP, covered: int = COVERED, **how) -> DataFrame:
    """The first ``keep`` collocations of every language: phrases of 2 to ``longest`` words with at least ``threshold`` occurrences."""
    return rank_phrases(checkpoint(frequent_phrases(docs, text, lang, threshold, longest, **how)), keep, covered)
