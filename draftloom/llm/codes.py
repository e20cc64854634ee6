"""Vector codes of a few bytes: product quantisation in whole numbers, trained by Lloyd's method with resident members.

A vector is cut into ``parts`` consecutive parts; each part position has a codebook. A part is a member of its entry and lives in
the partition of (position, entry, salt); the salt splits entries that a third of all vectors share. A round finds the
nearest entry of every member where it lives. Members that keep their entry stay (they are written where they are, without
a shuffle); only those that change it migrate to their new owner. Owners then sum their resident members; the
sums, one row per entry, component and task, give the new codebooks, which are all that ever comes to the driver
(parts x entries x components numbers). Tables of earlier rounds are deleted. Rounds end early when the codebooks repeat.

All arithmetic is exact, in 64-bit integers where the numbers at hand allow it, else in Python's.

Defined cases: vectors that are null, empty or hold null or non-finite components are dropped, so are those with a component of
2**50 or more in size (its whole number would not fit) and those whose length is not the commonest one that divides into equal
parts (of two as common, the smaller). The first entries are the vectors with the smallest ids, null ids last, equal ids in
order of their vectors; fewer vectors than entries give smaller codebooks. Entries without members stay as they are. Equal
distances go to the lower entry. Rows that repeat an id are separate rows. Errors above 2**63 - 1 are given as that. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom.llm.common import ship
from draftloom.session import checkpoint, checkpoint_path, discard, scratch_path

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Members of one (position, entry, salt) if entries were equally common.
MEMBERS = 1 << 16
LARGEST = float(2**50)
MOST = 2**63 - 1


def usable(vector: Column) -> Column:
    """The vector takes part: some components, all finite and small enough for whole numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def whole_vectors(vectors: DataFrame, key: str, column: str, label: str, parts: int = PARTS) -> DataFrame:
    """(row, id, label, v): a written table of the vectors that take part, in whole numbers."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(column).alias("x")).where(usable(F.col("x")))
    common = rows.groupBy(F.size("x").alias("n")).count().where(F.col("n") % parts == 0).orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("x") == (common["n"] if common else 0))
    return checkpoint(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("x", lambda x: F.floor(x.cast("double") * SCALE)).alias("v")))


def nearest_entry(members: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every member; the lower entry where distances are equal."""
    most = max(np.abs(members).max(initial=0), np.abs(book).max(initial=0))
    if int(2 * most) ** 2 * book.shape[1] > MOST:
        members, book = members.astype(object), book.astype(object)
    entries, distances = [np.empty(0, np.int64)], [np.empty(0, members.dtype)]
    for at in range(0, len(members), 8192):
        gap = members[at:at + 8192, None, :] - book[None]
        squared = (gap * gap).sum(axis=2)
        entries.append(squared.argmin(axis=1).astype(np.int64))
        distances.append(squared.min(axis=1))
    return np.concatenate(entries), np.concatenate(distances)


def _numbers(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


_MEMBER = "row long, position int, entry int, salt int, c array<long>"


def _assigned(members: DataFrame, books: np.ndarray) -> DataFrame:
    """Members with their nearest entry and whether it is another one than before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            position, before = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            c = _numbers(batch.column(4), batch.num_rows)
            entry = np.empty(batch.num_rows, np.int32)
            for p in np.unique(position):
                here = position == p
                entry[here] = nearest_entry(c[here], books[p])[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entry), *batch.columns[3:], pa.array((entry != before).astype(np.int32))],
                                             names=["row", "position", "entry", "salt", "c", "moved"])

    return members.mapInArrow(run, _MEMBER + ", moved int")


def _sums(members: DataFrame) -> DataFrame:
    """(position, entry, component, total, n): what the owners have, summed where the members live."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            c = _numbers(batch.column(4), batch.num_rows)
            if int(np.abs(c).max()) * len(c) > MOST:
                c = c.astype(object)
            owner = batch.column(1).to_numpy().astype(np.int64) << 32 | batch.column(2).to_numpy()
            for o in np.unique(owner):
                here = c[owner == o]
                held = sums.setdefault((int(o) >> 32, int(o) & 0xFFFFFFFF), [0, [0] * c.shape[1]])
                held[0] += len(here)
                held[1] = [a + int(b) for a, b in zip(held[1], here.sum(axis=0))]
        rows = [(p, e, k, Decimal(total), n) for (p, e), (n, totals) in sums.items() for k, total in enumerate(totals)]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["position", "entry", "component", "total", "n"])

    partial = members.mapInArrow(run, "position int, entry int, component int, total decimal(38,0), n long")
    return partial.groupBy("position", "entry", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def first_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks (part, entry, component) from the vectors with the smallest ids; None without vectors."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return None
    return np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)


def train(kept: DataFrame, books: np.ndarray, rounds: int = ROUNDS, members_held: int = MEMBERS) -> np.ndarray:
    """Codebooks after ``rounds`` of Lloyd's method over all vectors."""
    spark, (parts, entries, width) = kept.sparkSession, books.shape
    salts = max(1, -(-kept.count() // (entries * members_held)))
    cut = F.array(*[F.slice("v", p * width + 1, width) for p in range(parts)])
    members = kept.select("row", F.posexplode(cut).alias("position", "c"))
    members = members.select("row", "position", F.lit(-1).alias("entry"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), "c")
    old: list[str] = []
    for _ in range(rounds):
        path = scratch_path(spark, "members")
        _assigned(members, books).write.partitionBy("moved").parquet(path)
        found = spark.read.schema(_MEMBER + ", moved int").parquet(path)
        migrating = found.where("moved = 1").drop("moved")
        migrated, migrated_path = checkpoint_path(migrating.repartition("position", "entry", "salt"))
        members = found.where("moved = 0").drop("moved").unionByName(migrated)
        for done in old:
            discard(spark, done)
        old = [path, migrated_path]
        after = books.copy()
        for r in _sums(members).toLocalIterator():
            after[r["position"], r["entry"], r["component"]] = int(r["total"]) // r["n"]
        if (after == books).all():
            break
        books = after
    for done in old:
        discard(spark, done)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every vector: entries in part order, two hexadecimal digits each, and the summed squared distances."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = _numbers(batch.column(2), n).reshape(n, parts, -1)
            code, error = np.empty((n, parts), np.uint8), np.zeros(n, object)
            for p in range(parts):
                code[:, p], distance = nearest_entry(v[:, p], books[p])
                error += distance.astype(object)
            digits = code.tobytes().hex()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([digits[i:i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string()),
                                              pa.array([min(int(x), MOST) for x in error], pa.int64())], names=["id", "label", "code", "error"])

    rows = kept.select("id", "label", "v")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id long, label {kinds['label']}, code string, error long")


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 over all components in decimal digits, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             members_held: int = MEMBERS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    ship(vectors.sparkSession)
    kept = whole_vectors(vectors, key, column, label, parts)
    books = first_books(kept, parts, entries)
    if books is None:
        kind = dict(kept.dtypes)["id"]
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, code string, error long, label_error long, codebooks_sha256 string")
    books = train(kept, books, rounds, members_held)
    coded = checkpoint(encode(kept, books))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    labels = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select(F.col("id").alias(key), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
