"""Mixing sources to target weights, with DataFrame functions only.

Each source gets a token budget from its weight (:func:`source_targets`). Complete epochs of a source come
first; what is left of its budget is an Efraimidis-Spirakis sample: documents in order of an exponential key
scaled by their quality weight, taken while the running sum of sizes stays within the budget.

The running sum needs no sort of a whole source. The key maps monotonically to one of ``BUCKETS`` buckets; sums
per bucket tell in which bucket the budget ends, and only the documents of that one bucket are put in order.
A source with a third of all rows is thus pre-aggregated like any other.

Defined cases: a null text or a text without words has size 0 and is never taken; a null source is a source of its
own, ranked last; a null or non-positive weight counts as the smallest weight; repeated rows are separate documents;
rows equal in key, id and size share their place in an arbitrary order, which does not change the multiset of results;
an empty table gives an empty result. Columns of the input that the operator does not know stay as they are, except
that ``size``, ``source_size``, ``target`` and ``taken`` are the operator's own and replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftloom.llm.common import words
from draftloom.session import checkpoint

SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
BUCKETS = 4096
LEAST_WEIGHT = 1e-3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Budget per source from rows (source, source_size).

    ``share`` of all sizes is dealt by weight; no source gets more than ``ceiling`` times its size and what it cannot
    take is dealt again. With L the level at which ``sum(min(cap, weight * L))`` is the amount to deal, the budget is
    ``min(cap, weight * L)``; sources in order of ``cap / weight`` give L as the largest of the levels that hold
    if exactly the sources before were at their cap. The windows run over one small row per source.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(ranked) - 1
    named = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    named = named.withColumn("cap", ceiling * F.col("source_size"))
    everything = Window.partitionBy()
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing))
    named = named.withColumn("level", (share * F.sum("source_size").over(everything) - before) / open_weight)
    target = F.least("cap", F.col("weight") * F.max("level").over(everything))
    return named.select("source", "source_size", target.alias("target"))


def exponential_key(key: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, with u in (0, 1) from a hash of the row's key: the smallest keys are drawn first."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)
    usable = F.when(weight > LEAST_WEIGHT, weight.cast("double")).otherwise(F.lit(LEAST_WEIGHT))
    return -F.log(u) / usable


def mix_sources(docs: DataFrame, size: Column | None = None, weight: Column | None = None, weights: tuple[int, ...] = SOURCE_WEIGHTS,
                share: float = SHARE, ceiling: float = CEILING, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """Add size, source_size, target and taken to rows (doc_id, source, ...).

    ``taken`` counts the words that the mix takes of a document: complete epochs, plus its part of the fractional one.
    The document at which the budget ends gives as many words as are still missing.
    """
    size = words("text") if size is None else size
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    weight = F.lit(1.0) if weight is None else weight
    rows = docs.select(*keep, size.cast("long").alias("size"), F.struct(exponential_key(F.col("doc_id"), weight, seed).alias("key")).alias("_mix"))
    # Monotone in the key and close to uniform for weights near 1.
    bucket = F.least(F.floor((1 - F.exp(-F.col("_mix.key"))) * buckets), F.lit(buckets - 1)).cast("int")
    rows = rows.withColumn("_mix", F.struct(F.col("_mix.key").alias("key"), bucket.alias("bucket")))

    sums = rows.groupBy("source", F.col("_mix.bucket").alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, ceiling)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("epochs", epochs.cast("long"))
    plan = plan.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0).cast("long")))
    joined = filled.withColumnRenamed("source", "_source").join(plan, F.col("_source").eqNullSafe(F.col("source")))
    # The bucket in which the budget of the fractional epoch ends; none if nothing is left to deal.
    ends = (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("bucket_size"))
    cut = joined.groupBy(F.col("_source").alias("_of"), "source_size", "target", "epochs", "rest").agg(
        F.max(F.when(ends, F.struct("bucket", "before"))).alias("end"))
    # One small row per source, written so that the planner knows its size when it chooses the join.
    cut = checkpoint(cut.select("_of", F.struct("source_size", "target", "epochs", "rest", "end").alias("_plan")))

    placed = rows.join(cut, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    end, here = F.col("_plan.end.bucket"), F.col("_mix.bucket")
    at_end = F.coalesce(here == end, F.lit(False))
    ordered = Window.partitionBy("source").orderBy("_mix.key", "doc_id", "size")
    prior = F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("_plan.end.before")
    inside = placed.where(at_end).withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_plan.rest") - prior)).cast("long"))
    others = placed.where(~at_end).withColumn("_part", F.when(here < end, F.col("size")).otherwise(0).cast("long"))
    result = others.unionByName(inside)
    return result.select(*keep, "size", F.col("_plan.source_size").cast("long").alias("source_size"), F.col("_plan.target").alias("target"),
                         (F.col("_plan.epochs") * F.col("size") + F.col("_part")).cast("long").alias("taken"))


def mixed_documents(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of the mix: a row per epoch of a document, and one with the leading words of a part of it.

    Texts of complete epochs stay as they are. Columns ``size``, ``source_size``, ``target`` and ``taken`` are used up.
    """
    keep = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    copies = mixed.withColumns({"_whole": whole, "_rest": rest})
    full = copies.where("_whole > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_whole")))).select(*keep)
    head = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]+", " ")), " "), F.lit(1), F.greatest(F.col("_rest"), F.lit(1))), " ")
    part = copies.where("_rest > 0").withColumn(text, head)
    if "n_chars" in keep:
        part = part.withColumn("n_chars", F.length(text).cast(copies.schema["n_chars"].dataType))
    return full.unionByName(part.select(*keep))
