"""Nearest neighbours through randomly rotated one-bit codes.

Index: a vector is centred, scaled to length one and turned by a random rotation; the code is the sign of each of its
dimensions, packed into bits. Beside the code stand the distance to the centre and the inner product of the turned vector with
its code, which corrects the estimate. Every row is indexed; only the centre comes from a bounded sample.

Search: the inner product of a query with a vector is estimated from the packed bits and the correction. Its error is
at most ``BOUND * sqrt((1 - c^2) / c^2 / (d - 1))`` with high probability, c being the correction. A vector whose distance, less
that error, does not beat the tenth best exact distance so far is left; all others are ranked again on the original vectors
in double precision. Exact distances alone decide the result.

Queries go to the tasks in blocks of bounded size, one map-only pass over the index for each block; vectors are never
shuffled. Each task returns its best rows per query, and Spark merges them. A vector that very many rows repeat is no key
of anything, so it needs no split.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do those of another
length than most; ties go to the smaller id; rows that repeat an id are separate candidates, except the query's own id;
fewer candidates than asked for are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftloom.llm.common import ship
from draftloom.session import checkpoint

NEIGHBOURS = 10
SAMPLE = 20_000
QUERY_BLOCK = 16_384
BOUND = 2.6
SEED = 11
#: Queries and vectors that one matrix of estimates covers.
TILE = (256, 4096)


def usable(vector: Column) -> Column:
    """The vector takes part in a search: finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """A random rotation: the orthogonal part of a matrix of normal numbers."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, distances to the centre and corrections; a vector at the centre has correction 1."""
    rest = vectors - centre
    norms = np.sqrt((rest * rest).sum(axis=1))
    unit = (rest / np.where(norms > 0, norms, 1)[:, None]) @ turn
    correction = np.abs(unit).sum(axis=1) / np.sqrt(unit.shape[1])
    return np.packbits(unit > 0, axis=1), norms, np.where(norms > 0, correction, 1.0)


def _dense(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def index(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", sample: int = SAMPLE, seed: int = SEED) -> tuple[DataFrame, dict] | None:
    """(codes, model): a written table (id, vector, code, norm, correction) of every usable row, and centre and rotation.

    The centre is the mean of at most ``sample`` rows, those with the smallest hash of their id. None if no row is usable.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector")).where("id is not null").where(usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return None
    d = common["n"]
    rows = rows.where(F.size("vector") == d)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    model = {"centre": np.stack(drawn["vector"].to_numpy()).mean(axis=0), "turn": rotation(d, seed), "d": d}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, norm, correction = encode(_dense(batch.column(1), d), model["centre"], model["turn"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(correction)],
                                             names=["id", "vector", "code", "norm", "correction"])

    return checkpoint(rows.mapInArrow(run, "id long, vector array<double>, code binary, norm double, correction double")), model


class _Best:
    """The best rows per query of one task so far."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, model: dict, k: int, bound: float) -> None:
        self.queries, self.own, self.k, self.bound = queries, ids, k, bound
        rest = queries - model["centre"]
        self.norm = np.sqrt((rest * rest).sum(axis=1))
        self.turned = (rest @ model["turn"]).astype(np.float32)
        self.distance = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.d = model["d"]

    def add(self, ids: np.ndarray, vectors: np.ndarray, code: np.ndarray, norm: np.ndarray, correction: np.ndarray) -> None:
        signs = (np.unpackbits(code, axis=1, count=self.d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(self.d))
        spread = self.bound * np.sqrt(np.maximum(0, 1 - correction**2) / correction**2 / max(1, self.d - 1))
        for at in range(0, len(self.queries), TILE[0]):
            rows = slice(at, at + TILE[0])
            inner = (self.turned[rows] @ signs.T) / correction
            scale = self.norm[rows, None]
            middle = norm**2 + scale**2
            nearest = middle - 2 * norm * (inner + spread * scale)
            kth = self.distance[rows, -1] ** 2
            if not np.isfinite(kth).all():
                # No bound yet: rank the best estimates exactly to have one.
                guess = np.argpartition(middle - 2 * norm * inner, min(4 * self.k, len(ids) - 1), axis=1)[:, :4 * self.k]
                self._rerank(at, np.repeat(np.arange(guess.shape[0]), guess.shape[1]), guess.ravel(), ids, vectors)
                kth = self.distance[rows, -1] ** 2
                np.put_along_axis(nearest, guess, np.nan, axis=1)  # compares as false: done
            q, v = np.nonzero(nearest <= kth[:, None] * (1 + 1e-6))
            for part in range(0, len(q), 200_000):
                self._rerank(at, q[part:part + 200_000], v[part:part + 200_000], ids, vectors)

    def _rerank(self, at: int, q: np.ndarray, v: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        other = self.own[at + q] != ids[v]
        q, v = q[other], v[other]
        if not len(q):
            return
        gap = vectors[v] - self.queries[at + q]
        distance = np.sqrt((gap * gap).sum(axis=1))
        better = distance <= self.distance[at + q, -1]
        q, v, distance = q[better], v[better], distance[better]
        touched = np.unique(q)
        k = self.k
        all_q = np.concatenate([q, np.repeat(touched, k)])
        all_d = np.concatenate([distance, self.distance[at + touched].ravel()])
        all_i = np.concatenate([ids[v], self.found[at + touched].ravel()])
        order = np.lexsort((all_i, all_d, all_q))
        all_q, all_d, all_i = all_q[order], all_d[order], all_i[order]
        first = np.searchsorted(all_q, touched)
        take = first[:, None] + np.arange(k)
        self.distance[at + touched], self.found[at + touched] = all_d[take], all_i[take]

    def rows(self) -> pd.DataFrame:
        q, r = np.nonzero(np.isfinite(self.distance))
        return pd.DataFrame({"query_id": self.own[q], "vec_id": self.found[q, r], "score": self.distance[q, r]})


def nearest(codes: DataFrame, model: dict, queries: DataFrame, k: int = NEIGHBOURS, block: int = QUERY_BLOCK, bound: float = BOUND) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other ids of every query (rows id, vector of the index)."""
    spark = codes.sparkSession
    asked = checkpoint(queries.select("id", "vector").dropDuplicates(["id"]))
    blocks = max(1, -(-asked.count() // block))
    # Ids spread over the blocks by hash; a block is a little over or under its size.
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    found = None
    for number in range(blocks):
        part = blocked.where(F.col("block") == number).toPandas()
        if not len(part):
            continue
        shipped = spark.sparkContext.broadcast((np.stack(part["vector"].to_numpy()), part["id"].to_numpy(dtype=np.int64)))

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pd.DataFrame]:
            best = _Best(*shipped.value, model, k, bound)
            for batch in batches:
                for at in range(0, batch.num_rows, TILE[1]):
                    rows = batch.slice(at, TILE[1])
                    code = np.frombuffer(b"".join(rows.column(2).to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1)
                    best.add(rows.column(0).to_numpy(), _dense(rows.column(1), model["d"]), code, rows.column(3).to_numpy(), rows.column(4).to_numpy())
            frame = best.rows()
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

        hits = checkpoint(codes.mapInArrow(search, "query_id long, vec_id long, score double"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 100, k: int = NEIGHBOURS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Nearest other rows of all rows whose id is divisible by ``every``."""
    built = index(vectors, key, column)
    if built is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes, model = built
    return nearest(codes, model, codes.where(F.col("id") % every == 0), k)
