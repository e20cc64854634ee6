"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits link when they differ in at most ``distance`` bits. The bits are cut into ``distance + 1``
segments on a ring. If two fingerprints differ in at most t bits, then from some segment on every chain of 1, 2, ..., m
consecutive segments differs in at most 1, 2, ..., m times t / m bits. With t = 4 and m = 5: some segment is equal
and the next one differs in one bit at most, together two in three segments, and so on. The join key is the chain of
two (some 26 bits): one side lists its own chains, the other also those that lie one cleared bit away. Candidates
then have to keep the budget of the longer chains before their full distance is taken.

Chains that very many fingerprints share are not paired. All fingerprints that meet in such a chain are linked through
midpoints: two fingerprints lie within four bits of each other exactly if some point lies within two bits of both, so
each lists the points within two bits and is linked to the smallest fingerprint of every point. Work stays linear in
the size of the group and no link between components is lost.

Rows with one fingerprint are one node; connected groups of nodes come from alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftloom.llm.common import own, small_batches
from draftloom.session import checkpoint

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: First bit and length of the segments on the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints that share a chain; beyond it they are linked through midpoints.
DENSE = 2000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[-1:] if len(words) < shingle else ends[shingle - 1:]
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), last.tolist())], dtype=">u8")
    # Blocks keep the unpacked bits of a very long text small.
    ones = np.zeros(64, dtype=np.int64)
    for block in range(0, count, 65536):
        ones += np.unpackbits(hashes[block:block + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", column: str = "simhash") -> DataFrame:
    """Add the 64-bit fingerprint (as a signed long) of a text column; all other columns stay."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(x) for x in texts], dtype="int64")

    return docs.withColumn(column, simhash(F.col(text)))


def _exploded(rows: DataFrame) -> DataFrame:
    """Rows exploded from a table, never broadcast: the planner takes them for as small as that table."""
    return rows.hint("merge")


def _chain(shift: str, length: str) -> str:
    return f"(shiftrightunsigned(f, {shift}) & (shiftleft(1L, {length}) - 1))"


def _chains(nodes: DataFrame) -> DataFrame:
    """(key, f, flip): the chain of two segments from each segment on, and those with one bit of the second one cleared."""
    second = [SEGMENTS[(i + 1) % len(SEGMENTS)] for i in range(len(SEGMENTS))]
    layout = ", ".join(f"named_struct('i', {i}L, 'a', {a}, 'la', {la}, 'b', {b}, 'lb', {lb})" for i, ((a, la), (b, lb)) in enumerate(zip(SEGMENTS, second)))
    widest = max(length for _, length in SEGMENTS)
    rows = nodes.selectExpr("f", f"explode(array({layout})) as s").selectExpr("f", "s", f"explode(sequence(-1, {widest - 1})) as flip")
    rows = rows.where(F.expr("flip = -1 or (flip < s.lb and (shiftrightunsigned(f, s.b + flip) & 1L) = 1)"))
    low = f"({_chain('s.b', 's.lb')} - if(flip < 0, 0L, shiftleft(1L, greatest(flip, 0))))"
    return rows.selectExpr("f", "flip", f"shiftleft(s.i, 32) | shiftleft({_chain('s.a', 's.la')}, 13) | {low} as key")


def _ring_filter(x: str, y: str, distance: int) -> str:
    """Some segment starts chains that keep their budgets at every length."""
    parts = [f"bit_count(shiftrightunsigned({x} ^ {y}, {a}) & {(1 << la) - 1}L)" for a, la in SEGMENTS]
    m = len(parts)
    starts = []
    for i in range(m):
        sums = [" + ".join(parts[(i + k) % m] for k in range(length)) for length in range(1, m)]
        starts.append("(" + " and ".join(f"{s} <= {length * distance // m}" for length, s in enumerate(sums, 1)) + ")")
    return "(" + " or ".join(starts) + ")"


def links(nodes: DataFrame, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints ``f``: all of them outside dense chains, and enough to connect within.

    ``distance`` may be smaller than the four bits for which the segments are laid out.
    """
    if distance > len(SEGMENTS) - 1:
        raise ValueError("the segments hold for distances up to four")
    chains = _chains(nodes)
    own = chains.where("flip = -1").select("key", F.col("f").alias("a"))
    crowded = checkpoint(own.groupBy("key").count().where(F.col("count") > dense).select("key"))
    has_dense = not crowded.isEmpty()
    other = chains.select("key", F.col("f").alias("b"))
    if has_dense:
        spare_own, spare_other = own.join(crowded, "key", "left_anti"), other.join(crowded, "key", "left_anti")
    else:
        spare_own, spare_other = own, other
    near = f"a <> b and {_ring_filter('a', 'b', distance)} and bit_count(a ^ b) <= {distance}"
    pairs = _exploded(spare_own).join(_exploded(spare_other), "key").where(near).selectExpr("least(a, b) as a", "greatest(a, b) as b")
    if has_dense:
        inside = other.join(crowded, "key", "left_semi").select(F.col("b").alias("f")).distinct()
        pairs = pairs.unionByName(_midpoint_links(inside, distance))
    return pairs.distinct()


def _midpoint_links(nodes: DataFrame, distance: int) -> DataFrame:
    """Links that connect whatever lies within ``distance``, through points that two fingerprints share."""
    reach = (distance + 1) // 2
    flips = "array(0L)"
    if reach >= 1:
        flips = "transform(sequence(0, 63), i -> shiftleft(1L, i))"
        one = flips
        flips = f"concat(array(0L), {one})"
    if reach >= 2:
        flips = f"concat({flips}, flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j)))))"
    points = nodes.selectExpr("f", f"explode({flips}) as d").selectExpr("f", "f ^ d as point")
    least = points.groupBy("point").agg(F.min("f").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = _exploded(points).join(_exploded(least.select("point", "a")), "point").where("a <> f")
    if distance % 2 == 0:
        return met.select("a", F.col("f").alias("b"))
    return met.where(f"bit_count(a ^ f) <= {distance}").select("a", F.col("f").alias("b"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected group, for the nodes of edges (a, b).

    Alternating large and small stars: each node links its larger neighbours, then its smaller ones, to the smallest of them.
    Groups of any diameter settle in a number of rounds that grows with the logarithm of their size.
    """
    current = checkpoint(edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v").distinct())
    while True:
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpoint(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = checkpoint(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        unchanged = small.exceptAll(current).isEmpty() and current.exceptAll(small).isEmpty()
        current = small
        if unchanged:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(marked: DataFrame, key: str = "doc_id", column: str = "simhash", distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """(fingerprint, root, component) per distinct fingerprint: the root names its group, the component is the smallest key of it.

    Rows without a key take part in links but give no name; a group without any key has a null component.
    """
    nodes = checkpoint(marked.groupBy(F.col(column).alias("f")).agg(F.min(key).alias("least_key")))
    groups = checkpoint(connected(links(nodes.select("f"), distance, dense)))
    named = groups.join(nodes, groups.node == nodes.f).groupBy("root").agg(F.min("least_key").alias("group_key"))
    linked = groups.join(named, "root").select(F.col("node").alias("f"), "root", "group_key")
    joined = nodes.join(linked, "f", "left")
    return joined.select(F.col("f").alias(column), F.coalesce("root", "f").alias("root"),
                         F.when(F.col("root").isNull(), F.col("least_key")).otherwise(F.col("group_key")).alias("component"))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per input row: key, fingerprint (16 hexadecimal digits) and component_id, the smallest key reachable.

    A null or wordless text has fingerprint zero and links like any other; an empty table gives no rows.
    """
    marked = checkpoint(fingerprints(docs.select(key, text), text).select(key, "simhash"))
    groups = near_duplicates(marked, key, "simhash", distance).select("simhash", "component")
    return marked.join(groups, "simhash").select(key, F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Keep one row of every group of near-duplicates: one with the smallest key (rows without a key come last).

    Rows that repeat key and fingerprint of the kept one count as its copies. Columns come back as they were.
    """
    simhash, again = own("simhash"), own("key")
    marked = checkpoint(fingerprints(docs, text, simhash))
    light = marked.select(F.col(key).alias("key"), F.col(simhash).alias("simhash"))
    groups = near_duplicates(light, "key", "simhash", distance).select("simhash", "root")
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "simhash")).alias("first")
    winners = light.distinct().join(groups, "simhash").groupBy("root").agg(first).select(F.col("first.key").alias(again), F.col("first.simhash").alias("simhash"))
    kept = marked.join(winners, (marked[simhash] == winners["simhash"]) & marked[key].eqNullSafe(winners[again]), "left_semi")
    return kept.dropDuplicates([key, simhash]).select(*docs.columns)
