"""Best-fit packing into bins of several permitted lengths.

Documents are packed where Spark already has them: each task packs its own rows in buffers of bounded size, so nothing is
shuffled, nothing is gathered, and a lost task is packed again alike. Lengths are words.

Within a buffer, segments go in order of falling length to the open bin with the least room that holds them. If there is none,
a bin opens at the permitted length with the least cost per word it can still be filled with. The permitted lengths are
optimised jointly: the buffer is packed under the free choice and under each preferred length, every bin is then downsized to
the least permitted length that holds its contents, and the cheapest result is kept. A sequence costs a fixed part, its
length, and a part that grows with the square of the length, as attention does.

Documents longer than the longest bin are split losslessly at word starts: the texts of the parts, put together, are the text.

Defined cases: a null text is one segment of length 0 with an empty text; a text without words is one segment of length 0;
repeated rows are separate documents; null ids stay null; an empty table gives no bins. Other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from draftloom.llm.common import small_batches

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Words and segments that one buffer holds at most.
BUFFER_WORDS, BUFFER_SEGMENTS = 4_000_000, 20_000
#: Words that a further sequence costs, and the length at which the squared part costs as much as the words do.
FIXED_COST, SQUARE_LENGTH = 64.0, 65536.0
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cost(capacity: int) -> float:
    return FIXED_COST + capacity + capacity * capacity / SQUARE_LENGTH


def best_fit(lengths: list[int], capacities: tuple[int, ...], preferred: int | None = None) -> list[tuple[int, list[int]]]:
    """Bins (capacity, indices) for segments of the given lengths; ``preferred`` is the length to open where it holds."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left = sum(lengths)
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    used: list[int] = []
    for i in order:
        need = lengths[i]
        at = bisect_left(room, (need, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            fitting = [c for c in capacities if c >= need]
            if preferred is None:
                free = min(fitting, key=lambda c: (cost(c) / max(1, min(c, left)), -c))
            else:
                free = max(preferred, fitting[0])
            b = len(bins)
            bins.append([])
            used.append(0)
        bins[b].append(i)
        used[b] += need
        left -= need
        insort(room, (free - need, b))
    return [(next(c for c in capacities if c >= used[b]), members) for b, members in enumerate(bins)]


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, list[int]]]:
    """The cheapest of the packings under the free choice and under each preferred length."""
    tried = [best_fit(lengths, capacities, preferred) for preferred in (None, *capacities)]
    return min(tried, key=lambda bins: sum(cost(c) for c, _ in bins))


def split_text(text: str, longest: int) -> list[tuple[int, int, str]]:
    """Segments (first word, words, text) of at most ``longest`` words whose texts make up the whole text."""
    starts = [m.start() for m in _WORD.finditer(text)]
    if len(starts) <= longest:
        return [(0, len(starts), text)]
    firsts = range(0, len(starts), longest)
    cuts = [0, *(starts[f] for f in firsts[1:]), len(text)]
    return [(f, min(longest, len(starts) - f), text[a:b]) for f, a, b in zip(firsts, cuts, cuts[1:])]


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, key: str = "doc_id", text: str = "text", with_texts: bool = True,
                   buffer_words: int = BUFFER_WORDS, buffer_segments: int = BUFFER_SEGMENTS) -> DataFrame:
    """One row per bin: bin_id, capacity, used, n_segments, doc_ids, parts, starts, lengths, cu_lengths and, if asked for, texts.

    ``parts`` numbers the segments of a document, ``starts`` is the first word of a segment in it; ``cu_lengths`` has the
    running sums of lengths from 0 on, so that positions start again at each of them.
    """
    small_batches(docs.sparkSession)
    sizes = tuple(sorted(set(capacities)))
    longest = sizes[-1]
    field = docs.schema[key].dataType
    schema = f"bin_id long, capacity int, used int, n_segments int, doc_ids array<{field.simpleString()}>, parts array<int>, starts array<long>, lengths array<int>, cu_lengths array<int>"
    schema += ", texts array<string>" if with_texts else ""
    fields = [("bin_id", pa.int64()), ("capacity", pa.int32()), ("used", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(to_arrow_type(field))),
              ("parts", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("cu_lengths", pa.list_(pa.int32()))]
    arrow = pa.schema(fields + ([("texts", pa.list_(pa.string()))] if with_texts else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = []
            for capacity, members in pack([x[3] for x in held], sizes):
                own = [held[i] for i in members]
                ends = [0]
                for x in own:
                    ends.append(ends[-1] + x[3])
                row = [number, capacity, ends[-1], len(own), [x[0] for x in own], [x[1] for x in own], [x[2] for x in own], [x[3] for x in own], ends]
                rows.append(row + ([[x[4] for x in own]] if with_texts else []))
                number += 1
            for at in range(0, len(rows), 500):
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + 500]), arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part, (first, n, segment) in enumerate(split_text(body or "", longest)):
                    held.append((doc, part, first, n, segment if with_texts else None))
                    total += n
                if total >= buffer_words or len(held) >= buffer_segments:
                    yield from flush()
                    held.clear()
                    total = 0
        if held:
            yield from flush()

    return docs.select(key, text).mapInArrow(run, schema)
