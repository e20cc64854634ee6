"""Documents as packed matrices of token ids.

Each task tokenizes its own rows with a public byte-pair vocabulary, splits documents longer than a row losslessly, and
packs the segments best-fit-decreasing into rows of ``length`` ids. The bin with the least room that still holds a
segment is found in a segment tree over room, in steps of the tree's depth. Buffers are bounded, nothing is
shuffled or gathered, and a lost task gives the same rows again.

Tokenizing: byte-pair pieces never join two words across a single space, so a text is cut before single spaces and
the ids of a chunk are looked up in a bounded table that the worker keeps; texts with runs of spaces are encoded whole.

Defined cases: a null or empty text is one segment that holds only the end mark; special-token strings in a text are ordinary
text; repeated rows are separate documents; null ids stay null; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from draftloom.llm.common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level vocabularies of this kind cut a text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
END = 50256
#: Ids that one buffer holds at most, and chunks whose ids a worker remembers.
BUFFER_IDS, REMEMBERED = 8_000_000, 1_000_000
_tokenizers: dict[int, Tokenizer] = {}


class Tokenizer:
    """Ids of a text as little-endian bytes, with a memory of chunks."""

    def __init__(self, vocabulary: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "  " in text:
            return self.whole(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, out = self.known, []
        first, *rest = text.split(" ")
        for chunk in (first, *[f" {x}" for x in rest]):
            ids = known.get(chunk)
            if ids is None:
                ids = known[chunk] = self.whole(chunk)
            out.append(ids)
        return b"".join(out)


def tokenizer(vocabulary: bytes) -> Tokenizer:
    """The worker's tokenizer for a vocabulary, built once."""
    found = _tokenizers.get(hash(vocabulary))
    if found is None:
        found = _tokenizers[hash(vocabulary)] = Tokenizer(vocabulary)
    return found


class Room:
    """Open bins by room, with a segment tree over 0..length that tells which rooms have bins."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, bin_number: int) -> None:
        self.bins[room].append(bin_number)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of a bin with the least room of at least ``need``; it leaves the tree."""
        at = need + self.leaves
        if not self.count[at]:
            # Up to the first right sibling with bins, then down its left-most path.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        number = self.bins[room].pop()
        self._change(room, -1)
        return room, number

    def _change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Bins of segment numbers, each of at most ``length`` in sum."""
    room, bins = Room(length), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = room.take(lengths[i])
        if found is None:
            found = (length, len(bins))
            bins.append([])
        free, b = found
        bins[b].append(i)
        room.add(free - lengths[i], b)
    return bins


def pack_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text",
                buffer_ids: int = BUFFER_IDS) -> DataFrame:
    """One row per packed sequence: seq_id, n_tokens, n_segments, doc_ids, parts, cu_seqlens, position_resets, ids.

    ``ids`` is a row of the matrix: ``length`` little-endian 32-bit ids, filled up with the end mark. ``cu_seqlens`` has the running
    lengths from 0 to n_tokens; positions count from 0 again at every place in ``position_resets``, the filling included.
    """
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        content = file.read()
    field = docs.schema[key].dataType
    schema = f"seq_id long, n_tokens int, n_segments int, doc_ids array<{field.simpleString()}>, parts array<int>, cu_seqlens array<int>, position_resets array<int>, ids binary"
    arrow = pa.schema([("seq_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(to_arrow_type(field))), ("parts", pa.list_(pa.int32())),
                       ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary())])
    mark, wide = np.array([end], dtype="<u4").tobytes(), 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(content)
        number = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = []
            for members in best_fit_decreasing([len(x[2]) // 4 for x in held], length):
                own = [held[i] for i in members]
                ends = [0]
                for x in own:
                    ends.append(ends[-1] + len(x[2]) // 4)
                resets = ends if ends[-1] < length else ends[:-1]
                rows.append((number, ends[-1], len(own), [x[0] for x in own], [x[1] for x in own], ends, resets, b"".join([x[2] for x in own]) + mark * (length - ends[-1])))
                number += 1
            for at in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + 500]), arrow)], schema=arrow)

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(body or "") + mark
                for part, at in enumerate(range(0, len(ids), wide)):
                    held.append((doc, part, ids[at:at + wide]))
                total += len(ids) // 4
                if total >= buffer_ids:
                    yield from flush()
                    held.clear()
                    total = 0
        if held:
            yield from flush()

    return docs.select(key, text).mapInArrow(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrix rows and their segment tables as Parquet files of one row group per block."""
    packed.write.mode("errorifexists").parquet(path)


def matrix(rows: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Rows of ``ids`` as one matrix."""
    return np.frombuffer(b"".join(rows), dtype="<u4").reshape(-1, length)


def positions(position_resets: list[int], length: int = LENGTH) -> np.ndarray:
    """Position ids of a row, counted from 0 again at every reset."""
    starts = np.zeros(length, dtype=np.int64)
    starts[position_resets] = position_resets
    return np.arange(length) - np.maximum.accumulate(starts)
