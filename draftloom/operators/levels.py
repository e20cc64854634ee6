"""Storeys: level tables, heights between marks, assignment of plans to floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftloom.functions import values as v
from draftloom.functions import text as t
from draftloom.operators.ordered import first_wins, mode
from draftloom.operators.spatial import Keys


def heights_between_marks(marks: DataFrame, keys: Keys, low: float = 1500, high: float = 8000) -> DataFrame:
    """Floor heights as steps between the distinct elevation marks of a drawing.

    Marks are made distinct before the window, so a drawing with many copies stays small.
    """
    optional = [c for c in ("label", "text_id") if c in marks.columns]
    distinct = marks.withColumn("_key", F.round("elevation_mm", 1)).groupBy(*keys, "_key").agg(
        F.min("elevation_mm").alias("elevation_mm"), *[F.min(c).alias(c) for c in optional]
    )
    line = Window.partitionBy(*keys).orderBy("elevation_mm")
    step = F.col("elevation_mm") - F.lag("elevation_mm").over(line)
    out = distinct.withColumn("low_mm", F.lag("elevation_mm").over(line)).withColumn("height_mm", step)
    if "label" in optional:
        before = F.lag("label").over(line)
        both = before.isNotNull() & F.col("label").isNotNull()
        out = out.withColumn("floor", F.when(both, F.concat_ws("->", before, "label")).otherwise(F.coalesce("label", before)))
    return out.where(F.col("height_mm").between(low, high)).withColumnRenamed("elevation_mm", "high_mm").drop("_key")


def level_table(found: DataFrame, keys: Keys, floor_height: Column | float) -> DataFrame:
    """One row per storey of a project from the titles that name it.

    ``found``: keys, ``ord`` and key, name, number, confidence per title. The surest title
    speaks for a storey, the roof follows the top numbered one.
    """
    best = first_wins(found, [*keys, "key"], [-F.col("confidence"), F.col("ord")])
    group = Window.partitionBy(*keys)
    top = F.coalesce(F.max("number").over(group), F.lit(1))
    best = best.withColumn("number", F.when(F.col("key") == "roof", top + 1).otherwise(F.col("number")))
    place = F.when(F.col("number").isNotNull(), 0).when(F.col("key") == "typical", 1).otherwise(2)
    line = group.orderBy(place, F.coalesce("number", F.lit(0)), "key")
    return (
        best.withColumn("_n", F.row_number().over(line))
        .withColumn("level_id", F.concat(F.lit("LEVEL-"), v.padded(F.col("_n"), 3)))
        .withColumn("elevation_mm", F.round((F.col("number") - 1) * floor_height, 3))
        .withColumn("needs_review", F.col("confidence") < 0.80)
        .drop("_n", "ord")
    )


def level_confidence(marks: DataFrame, keys: Keys) -> DataFrame:
    """Distinct level marks (1 mm) with mean confidence plus a bonus for repeats."""
    grouped = marks.groupBy(*keys, F.round("elevation_mm").alias("elevation_mm")).agg(
        F.avg("confidence").alias("_a"), F.count(F.lit(1)).alias("n")
    )
    bonus = F.least(F.lit(0.2), 0.05 * (F.col("n") - 1))
    return grouped.select(*keys, "elevation_mm", "n", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_a") + bonus)), 3).alias("confidence"))


def storey_levels(levels: DataFrame, keys: Keys) -> DataFrame:
    """Drop a top mark that is no storey: its gap is at most 1500 and below half the usual gap."""
    line, group = Window.partitionBy(*keys).orderBy("elevation_mm"), Window.partitionBy(*keys)
    marked = levels.withColumn("_gap", F.col("elevation_mm") - F.lag("elevation_mm").over(line)).withColumn(
        "_last", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("elevation_mm").desc())) == 1
    ).withColumn("_n", F.count(F.lit(1)).over(group))
    usual = F.percentile(F.when(~F.col("_last") & (F.col("_gap") >= 1800), F.col("_gap")), F.lit(0.5)).over(group)
    marked = marked.withColumn("_usual", usual)
    drop = F.col("_last") & (F.col("_n") >= 4) & (F.col("_gap") > 0) & (F.col("_gap") <= 1500) & (F.col("_gap") < F.col("_usual") * 0.5)
    return marked.where(~F.coalesce(drop, F.lit(False))).drop("_gap", "_last", "_n", "_usual")


def floors_from_levels(levels: DataFrame, keys: Keys) -> DataFrame:
    """Floors as pairs of a level and the next higher one."""
    line = Window.partitionBy(*keys).orderBy("elevation_mm", "level_id")
    own = F.col("floor_height_mm") if "floor_height_mm" in levels.columns else F.lit(None).cast("double")
    rise = F.round(F.lead("elevation_mm").over(line) - F.col("elevation_mm"), 3)
    return levels.select(
        *keys, F.row_number().over(line).alias("floor_number"), F.col("level_id").alias("base_level_id"), F.col("name").alias("base_level_name"),
        F.col("elevation_mm").alias("base_elevation_mm"), F.lead("level_id").over(line).alias("top_level_id"), F.lead("name").over(line).alias("top_level_name"),
        F.lead("elevation_mm").over(line).alias("top_elevation_mm"), F.coalesce(own, rise).alias("floor_height_mm"),
    )


def assign_plans(plans: DataFrame, floors: DataFrame, keys: Keys) -> DataFrame:
    """Floor of each plan: by level id, level name, floor number, plan number, order, or as the only plan.

    ``plans``: keys, ``drawing_id``, ``drawing_name``, ``drawing_number``, ``level_id``. A project has few
    floors, so its floor list is joined on the project and the first rule that holds decides.
    """
    name = F.regexp_replace(F.lower("drawing_name"), r"\s+", "")
    group = Window.partitionBy(*keys)
    number = F.col("drawing_number").try_cast("double")
    order = Window.partitionBy(*keys).orderBy(F.when(number.isNull(), 1).otherwise(0), F.coalesce(number, F.lit(0.0)), "drawing_id")
    p = plans.withColumn("_place", F.row_number().over(order)).withColumn("_plans", F.count(F.lit(1)).over(group)).withColumn("_number", number)
    f = floors.withColumn("_floors", F.count(F.lit(1)).over(group)).withColumnRenamed("floor_number", "_f")
    level = F.regexp_replace(F.lower("base_level_name"), r"\s+", "")
    roof = "屋顶|屋面|roof"
    rules = [
        (F.lower(F.trim("level_id")) == F.lower(F.trim("base_level_id")), "level_id"),
        ((level != "") & F.contains(name, level), "name"),
        (name.rlike(roof) & level.rlike(roof), "name"),
        (t.explicit_floor_number(F.col("drawing_name")) == t.explicit_floor_number(F.col("base_level_name")), "name"),
        ((F.col("_number") == F.floor("_number")) & (F.col("_number") == F.col("_f")), "number"),
        ((F.col("_plans") == F.col("_floors")) & (F.col("_place") == F.col("_f")), "sequence"),
        ((F.col("_plans") == 1) & (F.col("_f") == 1), "single"),
    ]
    found = F.array_min(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), i) for i, (test, _) in enumerate(rules)])))
    scored = p.join(f, list(keys)).withColumn("_rule", found).where("_rule is not null")
    best = scored.groupBy(*keys, "drawing_id").agg(
        F.min(F.struct("_rule", "_f", "base_level_id", "base_level_name", "top_level_name", "floor_height_mm")).alias("_b")
    )
    reason = F.get(F.array(*[F.lit(r) for _, r in rules]), F.col("_b._rule"))
    return plans.join(best, [*keys, "drawing_id"], "left").select(
        *plans.columns, F.col("_b._f").alias("floor_number"), F.col("_b.base_level_id").alias("base_level_id"), F.col("_b.base_level_name").alias("base_level_name"),
        F.col("_b.top_level_name").alias("top_level_name"), F.col("_b.floor_height_mm").alias("floor_height_mm"),
        F.coalesce(reason, F.lit("unassigned")).alias("reason"),
        F.when(F.col("_b._rule") == 0, 0.98).when(F.col("_b").isNotNull(), 0.65).otherwise(0.0).alias("confidence"),
        F.when(F.col("_b._rule") == 0, "ready").otherwise("needs_review").alias("assignment_status"),
    )


def common_height(heights: DataFrame, keys: Keys, value: str, step: float, low: float, high: float, order: str) -> DataFrame:
    """Most common value on a grid within a range; the value seen first wins a tie."""
    kept = heights.where(F.col(value).between(low, high))
    return mode(kept, keys, F.bround(F.col(value) / step) * step, "first", order)


def nearest_level(items: DataFrame, levels: DataFrame, keys: Keys, item_id: str, z: str, tolerance: float = 100.0) -> DataFrame:
    """Level within ``tolerance`` of an elevation, the nearest one."""
    step = 2 * tolerance
    a = items.withColumn("_c", F.explode(F.sequence(F.floor((F.col(z) - tolerance) / step).cast("bigint"), F.floor((F.col(z) + tolerance) / step).cast("bigint"))))
    b = levels.select(*keys, F.col("level_id").alias("_id"), F.col("elevation_mm").alias("_z")).withColumn("_c", F.floor(F.col("_z") / step).cast("bigint"))
    gap = F.abs(F.col(z) - F.col("_z"))
    best = a.join(b, [*keys, "_c"]).where(gap <= tolerance).groupBy(*keys, item_id).agg(F.min(F.struct(gap.alias("gap"), F.col("_z"), F.col("_id"))).alias("_b"))
    return items.join(best, [*keys, item_id], "left").select(*items.columns, F.col("_b._id").alias("level_id"), F.col("_b.gap").alias("level_gap"))


def merge_heights(explicit: DataFrame, derived: DataFrame, keys: Keys) -> DataFrame:
    """Stated and derived floor heights as one list: the surest per floor and height, then the lowest and leftmost.

    Both: keys, ``floor``, ``height_mm``, ``confidence``, ``x``, ``y``.
    """
    both = explicit.unionByName(derived).withColumn("_h", F.round("height_mm", 1)).withColumn("_f", F.coalesce("floor", F.lit("")))
    return first_wins(both, [*keys, "_f", "_h"], [-F.col("confidence"), F.col("y"), F.col("x")]).drop("_f", "_h")
