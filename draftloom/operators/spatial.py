"""Spatial joins as plain equi-joins on a grid.

A theta join on coordinates alone has no equi-key and would pair every row with every
row of its drawing. Here both sides name the grid cells they touch, the cells become
join keys next to the drawing key, and the exact test stays as a residual predicate. A
pair that meets in several cells is kept in exactly one of them (the cell of the lower
left corner of the shared box), so no ``distinct`` follows. Work follows the local
density, not the size of a drawing; the session lets AQE split cells that stay hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom.session import checkpoint

Keys = Sequence[str]


def prefixed(df: DataFrame, prefix: str, keep: Keys = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


#: Coordinates beyond this, and entities of a larger extent, are faults of a drawing (millimetres).
FARTHEST, WIDEST = 1e12, 1e8


def sane(*names: str) -> Column:
    """Coordinates are finite and not absurd; nulls count as sane, as no join finds them anyway."""
    return F.coalesce(F.greatest(*[F.abs(F.col(c).cast("double")) for c in names], F.lit(0.0)) <= FARTHEST, F.lit(True))


def sane_box(box: Sequence[str]) -> Column:
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in box)
    return sane(*box) & F.coalesce(F.greatest(F.abs(x1 - x0), F.abs(y1 - y0)) <= WIDEST, F.lit(True))


def coordinate_issues(df: DataFrame, coordinates: Sequence[str]) -> DataFrame:
    """Rows that spatial joins leave out: a coordinate is not finite or absurd, or the extent (of x1, y1, x2, y2 in pairs) is. Adds ``issue``."""
    far = ~sane(*coordinates)
    wide = F.lit(False)
    for a, b in zip(coordinates, coordinates[2:]):
        wide = wide | F.coalesce(F.abs(F.col(b).cast("double") - F.col(a).cast("double")) > WIDEST, F.lit(False))
    return df.withColumn("issue", F.when(far, "coordinate_out_of_range").when(wide, "extent_out_of_range")).where("issue is not null")


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell).cast("bigint"), F.floor(high / cell).cast("bigint"))


def with_cells(df: DataFrame, box: Sequence[str], cell: float, margin: float = 0.0, across: float | None = None) -> DataFrame:
    """One row per grid cell that the box (grown by ``margin``) touches: ``_gx``, ``_gy``. Cells are ``cell`` wide and ``across`` (or as much) high.

    Rows with absurd coordinates (see :func:`coordinate_issues`) touch none.
    """
    x0, y0, x1, y1 = (F.col(c) for c in box)
    return df.where(sane_box(box)).withColumn("_gx", F.explode(_cells(x0 - margin, x1 + margin, cell))).withColumn(
        "_gy", F.explode(_cells(y0 - margin, y1 + margin, across or cell))
    )


def with_line_cells(df: DataFrame, line: Sequence[str], cell: float, margin: float) -> DataFrame:
    """One row per grid cell that holds a point within ``margin`` of the line: ``_gx``, ``_gy``.

    Goes along the columns of the grid and lists the cells beside the stretch of the line in reach of each, so a
    slanted line touches as many cells as a level one, not all of its box.
    """
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in line)
    low, high = F.least(x1, x2), F.greatest(x1, x2)
    cut = df.where(sane_box(line)).withColumn("_gx", F.explode(_cells(low - margin, high + margin, cell)))
    left, right = F.col("_gx") * cell - margin, (F.col("_gx") + 1) * cell + margin
    steep = F.abs(x2 - x1) < 1e-9

    def at(x):
        return F.when(steep, None).otherwise(y1 + (F.least(F.greatest(x, low), high) - x1) / (x2 - x1) * (y2 - y1))

    ends = [F.coalesce(at(left), y1), F.coalesce(at(right), y2)]
    # A hair more than the margin: the place on the line is rounded.
    slack = margin + 1e-6 * cell
    return cut.withColumn("_gy", F.explode(_cells(F.least(*ends) - slack, F.greatest(*ends) + slack, cell)))


def shuffled(cells: DataFrame) -> DataFrame:
    """Rows per cell, never broadcast: the planner takes them for as small as the table they were exploded from."""
    return cells.hint("merge")


#: A key with no more rows than this needs no cells: meeting all of them costs less than repeating rows per cell.
FEW = 128


def by_crowd(rows: DataFrame, keys: Keys) -> tuple[Callable[[DataFrame], DataFrame] | None, Callable[[DataFrame], DataFrame] | None]:
    """Filters for the rows of keys with at most :data:`FEW` of ``rows``, and of keys with more; None if there are no such keys.

    The counts are written once, so the planner knows how few the crowded keys are. Keys without a row count as few.
    """
    counts = checkpoint(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    found = counts.agg(F.bool_or(F.col("_n") <= FEW).alias("few"), F.bool_or(F.col("_n") > FEW).alias("many")).first()
    if not found["many"]:
        return (lambda df: df), None
    crowded = counts.where(F.col("_n") > FEW).select(*keys)

    def many(df: DataFrame) -> DataFrame:
        return df.join(crowded, list(keys), "left_semi")

    def few(df: DataFrame) -> DataFrame:
        return df.join(crowded, list(keys), "left_anti")

    return (few if found["few"] else None), (many if found["few"] else (lambda df: df))


def box_join(
    left: DataFrame,
    right: DataFrame,
    keys: Keys,
    left_box: Sequence[str],
    right_box: Sequence[str],
    cell: float,
    margin: float = 0.0,
    condition: Callable[[], Column] | Column | None = None,
    left_prefix: str = "a_",
    right_prefix: str = "b_",
    across: float | None = None,
    crowd: DataFrame | None = None,
) -> DataFrame:
    """All pairs with equal keys whose boxes, the left one grown by ``margin``, share a point.

    Columns come out prefixed, the keys once. ``condition`` may use the prefixed names. Cells are ``cell`` wide and ``across`` (or as much) high.
    Keys with few rows in ``crowd`` (:func:`by_crowd`; it holds no fewer per key than the right side) meet without cells, so no row is repeated.
    """
    ax0, ay0, ax1, ay1 = (F.col(left_prefix + c) for c in left_box)
    bx0, by0, bx1, by1 = (F.col(right_prefix + c) for c in right_box)
    meet = (ax0 - margin <= bx1) & (bx0 <= ax1 + margin) & (ay0 - margin <= by1) & (by0 <= ay1 + margin)
    home = (F.floor(F.greatest(ax0 - margin, bx0) / cell) == F.col("_gx")) & (
        F.floor(F.greatest(ay0 - margin, by0) / (across or cell)) == F.col("_gy")
    )
    few, many = (None, lambda df: df) if crowd is None else by_crowd(crowd, [c for c in keys if c in crowd.columns])
    pairs = None
    if few is not None:
        near = prefixed(few(left).where(sane_box(left_box)), left_prefix, keys)
        pairs = near.join(prefixed(few(right).where(sane_box(right_box)), right_prefix, keys), list(keys)).where(meet)
    if many is not None:
        a = prefixed(with_cells(many(left), left_box, cell, margin, across), left_prefix, (*keys, "_gx", "_gy"))
        b = prefixed(with_cells(many(right), right_box, cell, across=across), right_prefix, (*keys, "_gx", "_gy"))
        met = a.join(shuffled(b), [*keys, "_gx", "_gy"]).where(meet & home).drop("_gx", "_gy")
        pairs = met if pairs is None else pairs.unionByName(met)
    if condition is not None:
        pairs = pairs.where(condition() if callable(condition) else condition)
    return pairs


def parallel_join(
    left: DataFrame,
    right: DataFrame,
    keys: Keys,
    along: float,
    across: float,
    margin: float,
    tolerance: float,
    condition: Column,
    sector: float = 6.0,
    crowd: DataFrame | None = None,
) -> DataFrame:
    """Pairs of lines (x1, y1, x2, y2) within ``tolerance`` degrees of each other and within ``margin``, for which ``condition`` holds.

    The heading is a join key in sectors of ``sector`` degrees, and the cells lie along the sector: long and narrow ones, which a line of any
    heading follows. Lines side by side share cells, lines at a distance or across each other do not.
    Sectors are centred on the axes, so a line along an axis is in one sector only, tolerance included, and is not shuffled twice.
    Columns come out prefixed with ``a_`` and ``b_``.
    """
    if tolerance > sector:
        raise ValueError("sectors must be as wide as the tolerance")
    heading = F.pmod(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))), F.lit(180.0))
    sectors = round(180 / sector)

    def of(turn: Column) -> Column:
        return F.floor(F.pmod(turn + sector / 2, F.lit(180.0)) / sector).cast("int") % sectors

    def turned(df: DataFrame, headings: list[Column]) -> DataFrame:
        # Sectors, then directions, come out of an explode: so they are worked out once and not in every use.
        rows = df.withColumn("_sector", F.explode(F.array_distinct(F.array(*map(of, headings)))))
        middle = F.radians(F.col("_sector") * sector)
        rows = rows.withColumn("_u", F.explode(F.array(F.struct(F.cos(middle).alias("c"), F.sin(middle).alias("s")))))
        t = [F.col(f"x{i}") * F.col("_u.c") + F.col(f"y{i}") * F.col("_u.s") for i in (1, 2)]
        n = [F.col(f"y{i}") * F.col("_u.c") - F.col(f"x{i}") * F.col("_u.s") for i in (1, 2)]
        return rows.withColumns({"_t0": F.least(*t), "_n0": F.least(*n), "_t1": F.greatest(*t), "_n1": F.greatest(*n)}).drop("_u")

    a, b = turned(left, [heading - tolerance, heading, heading + tolerance]), turned(right, [heading])
    box = ("_t0", "_n0", "_t1", "_n1")
    pairs = box_join(a, b, [*keys, "_sector"], box, box, along, margin, condition, across=across, crowd=crowd)
    return pairs.drop("_sector", *[f"{p}{c}" for p in ("a_", "b_") for c in box])


def usual_crowd(rows: DataFrame, keys: Keys, point: Sequence[str], cell: float) -> float:
    """How many rows usually share the cell of a row, itself included (0 without rows)."""
    x, y = (F.floor(F.col(c) / cell).cast("bigint") for c in point)
    full = rows.where(sane(*point)).groupBy(*keys, x.alias("_gx"), y.alias("_gy")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    found = full.agg(F.sum(F.col("_n") * F.col("_n")).alias("s"), F.sum("_n").alias("n")).first()
    return found["s"] / found["n"] if found["n"] else 0.0


def finer_rings(radius: float, crowd: float, want: float, grow: int = 4) -> list[float]:
    """Rings below ``radius``, each ``grow`` times the one before. Where ``crowd`` rows lie in a cell of ``radius``, about ``want`` lie in one of the first ring."""
    halvings = math.floor(math.log2(crowd / want)) if crowd > want else 0
    rings = [radius / 2 ** (halvings / 2)]
    while rings[-1] * grow <= radius:
        rings.append(rings[-1] * grow)
    return [r for r in rings if r < radius]


def wider_rings(radius: float, left: DataFrame, left_point: Sequence[str], right: DataFrame, right_box: Sequence[str]) -> list[float]:
    """Rings beyond ``radius``, each eight times the one before, up to one that spans both sides."""
    far = 0.0
    for df, names in ((left, left_point), (right, right_box)):
        row = df.where(sane(*names)).agg(*[F.max(F.abs(F.col(c).cast("double"))).alias(f"_{i}") for i, c in enumerate(names)]).first()
        far = max([far, *[v for v in row if v is not None and math.isfinite(v)]])
    rings = [radius * 8]
    while rings[-1] < 3 * far + 1:
        rings.append(rings[-1] * 8)
    return rings


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Keys,
    left_id: Keys,
    left_point: Sequence[str],
    right_box: Sequence[str],
    distance: Column,
    rings: Sequence[float],
    order: Sequence[Column] = (),
    k: int = 1,
    condition: Column | None = None,
    inclusive: bool = True,
    right_prefix: str = "r_",
    right_line: Sequence[str] | None = None,
    crowd: DataFrame | None = None,
    raw: Column | None = None,
) -> DataFrame:
    """The ``k`` nearest right rows of each left row, by rings of growing radius.

    ``distance`` is written over the left columns and the prefixed right columns, and may
    not fall below the distance from the point to the right box. Keys with few right rows (:func:`by_crowd`,
    counted in ``crowd`` if given) are settled at once, without rings. A ring answers a left
    row once it holds ``k`` right rows within its radius: anything outside is farther.
    Only rows without an answer go on to the next ring, so dense places are settled with
    small cells (:func:`finer_rings` come before ``rings`` where they are crowded) and wide cells are visited by few rows. The last ring is the search limit; if it is
    infinite, rings grow until they cover all coordinates. ``right_line`` names the ends of right rows that are lines and
    ``distance`` the distance to them: cells then follow the line, in place of its box. ``raw`` is ``distance`` before it was rounded to 1e-6:
    rounding costs more than the rest, so it is left to the pairs that could be nearest.
    Left rows without a match are dropped. Adds ``_rank``, ``_distance``.
    """
    few, many = by_crowd(right if crowd is None else crowd, keys)
    how = (keys, left_id, left_point, right_box, distance, rings, order, k, condition, inclusive, right_prefix)
    found = None if few is None else _nearest_of_few(few(left), few(right), *how, distance if raw is None else raw)
    if many is not None:
        ringed = _nearest_ringed(many(left), many(right), *how, right_line)
        found = ringed if found is None else found.unionByName(ringed)
    out = found.select("*", F.posexplode("_found").alias("_rank", "_hit")).drop("_found")
    payload = [right_prefix + c for c in right.columns if c not in keys]
    return out.select(
        *left.columns, (F.col("_rank") + 1).alias("_rank"), F.col("_hit._distance").alias("_distance"),
        *[F.col(f"_hit.{c}").alias(c) for c in payload],
    )


def _nearest_of_few(left, right, keys, left_id, left_point, right_box, distance, rings, order, k, condition, inclusive, right_prefix, raw) -> DataFrame:
    """Left rows with ``_found``. Joined and grouped under the keys alone, so both sides are shuffled once and pairs never."""
    target = prefixed(right.where(sane_box(right_box)), right_prefix, keys)
    if k == 1:
        # Written once: it is met twice.
        target = checkpoint(target)
    known = sane(*left_point)
    for c in left_id:
        known = known & F.col(c).isNotNull()
    limit = rings[-1]
    fits = F.col("_distance").isNotNull() if math.isinf(limit) else F.col("_distance") <= limit if inclusive else F.col("_distance") < limit
    payload = [c for c in target.columns if c not in keys]
    ranked = F.struct(F.col("_distance"), *[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in payload])
    rest = [c for c in left.columns if c not in keys]
    one = [*keys, "_row", *rest]

    def met(rows: DataFrame) -> DataFrame:
        pairs = rows.join(target, list(keys))
        return pairs if condition is None else pairs.where(condition)

    rows = left.where(known).withColumn("_row", F.monotonically_increasing_id())
    if k == 1:
        # The distance first: its minimum is kept in place, and only pairs about as near are rounded and sorted.
        closest = met(rows).groupBy(*one).agg(F.min(raw).alias("_least"))
        near = met(closest).where(raw <= F.col("_least") + 1e-5).withColumn("_distance", distance).where(fits)
        best = near.groupBy(*one).agg(F.min(ranked).alias("_best"))
        return best.withColumn("_found", F.array("_best")).drop("_best", "_row")
    pairs = met(rows).withColumn("_distance", distance).where(fits)
    from pyspark.sql import Window

    spot = Window.partitionBy(*keys, "_row").orderBy("_r")
    best = pairs.select(*one, ranked.alias("_r")).withColumn("_n", F.row_number().over(spot)).where(F.col("_n") <= k)
    return best.groupBy(*one).agg(F.array_sort(F.collect_list("_r")).alias("_found")).drop("_row")


def _nearest_ringed(left, right, keys, left_id, left_point, right_box, distance, rings, order, k, condition, inclusive, right_prefix, right_line) -> DataFrame:
    done: DataFrame | None = None
    pending = left
    px, py = (F.col(c) for c in left_point)
    ids = [*keys, *[c for c in left_id if c not in keys]]
    payload = [right_prefix + c for c in right.columns if c not in keys]
    radii, unlimited, position = [r for r in rings if math.isfinite(r)], math.isinf(rings[-1]), 0
    # Dense places would meet far more rows than they need in the first ring.
    radii = finer_rings(radii[0], usual_crowd(right, keys, right_box[:2], radii[0]), max(1.0, k / 2)) + radii
    while position < len(radii):
        radius = radii[position]
        probe = pending.withColumn("_gx", F.floor(px / radius).cast("bigint")).withColumn(
            "_gy", F.floor(py / radius).cast("bigint")
        )
        cells = with_cells(right, right_box, radius, radius) if right_line is None else with_line_cells(right, right_line, radius, radius)
        target = prefixed(cells, right_prefix, (*keys, "_gx", "_gy"))
        hits = probe.join(shuffled(target), [*keys, "_gx", "_gy"]).withColumn("_distance", distance)
        last = position == len(radii) - 1 and not unlimited
        hits = hits.where(F.col("_distance") <= radius if inclusive or not last else F.col("_distance") < radius)
        if condition is not None:
            hits = hits.where(condition)
        ranked = F.struct(
            F.col("_distance"), *[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in payload]
        )
        if k == 1:
            best = hits.groupBy(*ids).agg(F.min(ranked).alias("_best")).withColumn("_found", F.array("_best")).drop("_best")
        else:
            from pyspark.sql import Window

            spot = Window.partitionBy(*ids).orderBy(F.col("_r"))
            best = (
                hits.select(*ids, ranked.alias("_r")).withColumn("_n", F.row_number().over(spot)).where(F.col("_n") <= k)
                .groupBy(*ids).agg(F.array_sort(F.collect_list("_r")).alias("_found"))
            )
        tried = pending.join(best, ids, "left")
        if not last:
            # Written once: both the answers and the rows that go on read it.
            tried = checkpoint(tried)
        full = F.coalesce(F.size("_found"), F.lit(0)) >= k
        answer = tried.where(F.col("_found").isNotNull() if last else full)
        done = answer if done is None else done.unionByName(answer)
        if not last:
            pending = tried.where(~full).drop("_found")
            if pending.isEmpty():
                break
        position += 1
        if position == len(radii) and unlimited:
            radii += wider_rings(radius, pending, left_point, right, right_box)
            unlimited = False
    return done


def islands(
    df: DataFrame, keys: Keys, lo: str, hi: str, touch: float, bucket: float, extra: Sequence[Column] = ()
) -> DataFrame:
    """Merge intervals of one key whose gaps are at most ``touch``.

    Two passes: first inside buckets of the start position, where one key can be shared
    by many tasks, then over the few merged pieces. ``extra`` holds aggregates that can
    be merged again, as (partial, final) pairs of column and name.
    Returns keys, ``run`` (1, 2, ... along the line), ``lo``, ``hi``, ``n``.
    """
    from pyspark.sql import Window

    def number(frame: DataFrame, by: Keys, name: str) -> DataFrame:
        line = Window.partitionBy(*by).orderBy(F.col(lo), F.col(hi))
        before = F.max(hi).over(line.rowsBetween(Window.unboundedPreceding, -1))
        starts = F.when(before.isNull() | (F.col(lo) - before > touch), 1).otherwise(0)
        return frame.withColumn("_start", starts).withColumn(
            name, F.sum("_start").over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")
        ).drop("_start")

    cut = df.groupBy(*keys, lo, hi).agg(F.count(F.lit(1)).alias("_n"))
    cut = cut.withColumn("_bucket", F.floor(F.col(lo) / bucket).cast("bigint"))
    local = number(cut, [*keys, "_bucket"], "_local").groupBy(*keys, "_bucket", "_local").agg(
        F.min(lo).alias(lo), F.max(hi).alias(hi), F.sum("_n").alias("_n")
    )
    merged = number(local, keys, "run").groupBy(*keys, "run").agg(
        F.min(lo).alias(lo), F.max(hi).alias(hi), F.sum("_n").alias("n")
    )
    return merged
