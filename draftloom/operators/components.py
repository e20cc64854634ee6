"""The component model: gate, requirements, type candidates, plans, statistics, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom.functions import semantics as sem
from draftloom.operators.ordered import first_wins, top_k
from draftloom.operators.spatial import Keys
from draftloom.session import checkpoint

# Groups in the order in which the modelling host takes them.
MODEL_SEQUENCE = ["levels", "grids", "columns", "walls", "slabs", "floor_openings", "stairs", "doors", "windows"]


def all_components(groups: dict[str, DataFrame]) -> DataFrame:
    """All component tables as one, with their group; absent columns are NULL."""
    out = None
    for name, df in groups.items():
        named = df.withColumn("component_group", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def own_skip_reason() -> Column:
    """Why a component keeps itself from being modelled."""
    status, state, scope = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("review_status", "modeling_status", "execution_scope"))
    return (
        F.when(status == "rejected", "review_status is rejected")
        .when(state.isin("blocked", "not_modelable"), F.concat(F.lit("modeling_status is "), state))
        .when(scope.isin("review_only", "blocked", "exclude"), F.concat(F.lit("execution_scope is "), scope))
    )


def execution_gate(components: DataFrame, approvals: DataFrame, disabled_groups: list[str], keys: Keys = ("project_id",)) -> DataFrame:
    """Components with ``skip_reason``, NULL where they may be modelled.

    ``approvals``: keys, ``id``, ``decision`` in allowed, approved, skipped, rejected. The allow list of a project is its
    allowed ids, else its approved ids; where it is not empty, only listed components pass.
    """
    ids = approvals.withColumn("_key", F.lower(F.trim("id")))
    use_allowed = ids.groupBy(*keys).agg(F.bool_or(F.col("decision") == "allowed").alias("_strict"), F.bool_or(F.col("decision").isin("allowed", "approved")).alias("_listed"))
    flags = ids.groupBy(*keys, "_key").agg(*[F.bool_or(F.col("decision") == d).alias(f"_{d}") for d in ("allowed", "approved", "skipped", "rejected")])
    rows = components.withColumn("_key", F.lower(F.trim(F.col("id").cast("string")))).join(flags, [*keys, "_key"], "left").join(use_allowed, list(keys), "left")
    allowed = F.when(F.coalesce("_strict", F.lit(False)), F.coalesce("_allowed", F.lit(False))).otherwise(F.coalesce("_approved", F.lit(False)))
    needs_review = F.lower(F.trim(F.coalesce("review_status", F.lit("")))) == "needs_review"
    own = own_skip_reason()
    reason = (
        F.when(F.col("component_group").isin(disabled_groups), "group disabled") if disabled_groups else F.when(F.lit(False), "")
    )
    reason = (
        reason.when(F.col("_skipped"), "listed as skipped")
        .when(F.coalesce("_rejected", F.lit(False)) | own.isNotNull(), F.coalesce(own, F.lit("rejected")))
        .when(needs_review & ~allowed, "needs review and not allowed")
        .when(F.coalesce("_listed", F.lit(False)) & ~allowed, "not in the allow list")
    )
    return rows.select(*components.columns, reason.alias("skip_reason"))


def absent_ids(approvals: DataFrame, components: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """Skipped or rejected ids that the model does not hold, with the group their name suggests."""
    known = components.select(*keys, F.lower(F.trim(F.col("id").cast("string"))).alias("_key")).distinct()
    upper = F.upper(F.trim("id"))
    heads = [
        ("LEVEL", "levels"), ("GRID", "grids"), ("COLUMN", "columns"), ("WALL", "walls"), ("FLOOROPENING", "floor_openings"), ("FLOOR", "slabs"),
        ("SLAB", "slabs"), ("DOOR", "doors"), ("WINDOW", "windows"), ("ROOM", "rooms"), ("STAIR", "stairs"), ("RAILING", "railings"), ("ROOF", "roofs"),
    ]
    group = F.coalesce(*[F.when(upper.startswith(h), n) for h, n in heads], F.lit("approval_filtered"))
    lost = approvals.where(F.col("decision").isin("skipped", "rejected")).withColumn("_key", F.lower(F.trim("id"))).join(known, [*keys, "_key"], "left_anti")
    return lost.select(*keys, "id", "decision", group.alias("component_group")).distinct()


def recoverable(group: str) -> Column:
    """Whether a component under review carries enough to be modelled anyway."""
    open_ = F.lower(F.trim(F.coalesce("review_status", F.lit("")))) != "rejected"
    if group in ("doors", "windows"):
        base = open_ & F.col("x").isNotNull() & (F.coalesce("host_wall_id", F.lit("")) != "") & (F.coalesce("width_mm", F.lit(0)) > 0)
        return base if group == "doors" else base & (F.coalesce("height_mm", F.lit(0)) > 0)
    if group == "columns":
        sized = (F.coalesce("diameter_mm", F.lit(0)) > 0) | ((F.coalesce("width_mm", F.lit(0)) > 0) & (F.coalesce("depth_mm", F.lit(0)) > 0))
        return open_ & F.col("x").isNotNull() & (F.coalesce("level", F.lit("")) != "") & sized
    return open_ & F.coalesce("manual_build_approved", F.lit(True)) & (F.size(F.coalesce("boundary", F.array())) >= 3)


def size_groups(openings: DataFrame, keys: Keys) -> DataFrame:
    """Type requirements: openings by kind and rounded size. Members stay rows of the opening table.

    Doors under review without a height count as 2100 high; rejected ones and those without a size do not count.
    """
    height = F.when((F.col("kind") == "door") & (F.coalesce("height_mm", F.lit(0)) <= 0) & (F.col("review_status") == "needs_review"), 2100).otherwise(F.col("height_mm"))
    kept = openings.withColumn("_h", height).where((F.col("width_mm") > 0) & (F.col("_h") > 0) & (F.coalesce("review_status", F.lit("")) != "rejected"))
    return kept.groupBy(*keys, "kind", F.bround("width_mm").cast("bigint").alias("width_mm"), F.bround("_h").cast("bigint").alias("height_mm")).agg(F.count(F.lit(1)).alias("n"))


def type_library(files: DataFrame) -> DataFrame:
    """One row per path and name of the library's descriptions: the surest."""
    path = F.lower(F.trim(F.translate("file_path", "\\", "/")))
    return first_wins(files.withColumn("_path", path), ["_path"], [-F.col("confidence"), F.col("file_id")]).drop("_path")


def _has_size(text: Column, width: Column, height: Column) -> Column:
    return F.contains(text, width) & F.contains(text, height)


# Words of door families that mean the same.
DOOR_ALIASES = [
    ["flush", "flush panel", "plain"], ["glazed", "glass"], ["vision", "lite", "light", "view panel"], ["louvered", "louvre", "louver"],
    ["w side panel", "with side panel", "side panel", "sidelite", "side lite"], ["transom"], ["dbl acting", "double acting"],
    ["sliding", "slider"], ["pocket"], ["bifold", "bi-fold", "bi fold"], ["overhead"], ["rolling", "roll up", "roll-up"], ["garage"],
    ["cased opening"], ["opening"],
]


def door_features(text: Column) -> Column:
    """Numbers of the alias groups a text mentions."""
    return F.array_compact(F.array(*[F.when(sem.any_word(text, words), i) for i, words in enumerate(DOOR_ALIASES)]))


def _grams(text: Column) -> Column:
    """Distinct runs of three characters."""
    count = F.greatest(F.length(text) - 2, F.lit(0))
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substr(text, i, F.lit(3))))).otherwise(
        F.array().cast("array<string>")
    )


def type_candidates(requirements: DataFrame, library: DataFrame, k: int = 3) -> DataFrame:
    """Best library files per required type and size (sizes of at least 100).

    ``requirements``: ``requirement_id``, ``kind``, ``width_mm``, ``height_mm``, ``hint``. ``library``: ``file_id``, ``file_path``, ``summary``.

    Requirements and files do not meet one by one. But for its size and hint words, the score of a
    file depends on a few features only, so of all files with equal features the first ``k``
    stand for the rest. Files whose name holds the width, and files whose description holds a
    hint word, are found through runs of three characters. What a file says is worked out once.
    """
    path = F.lower(F.translate("file_path", "\\/", "  "))
    stem = F.regexp_replace(F.regexp_replace(F.lower("file_path"), r"^.*[\\/]", ""), r"\.[^.]*$", "")
    both = F.concat_ws(" ", stem, path)
    summary = F.lower(F.coalesce("summary", F.lit("")))
    traits = ["_door", "_window", "_features", "_described", "_leaves", "_cached", "_told_door", "_told_window"]
    lib = library.select(
        "file_id", both.alias("_text"), summary.alias("_summary"), sem.door_leaves(F.concat_ws(" ", both, summary)).alias("_leaves"),
        door_features(both).alias("_features"), door_features(summary).alias("_described"), (summary != "").alias("_cached"),
        F.contains(both, F.lit("door")).alias("_door"), F.contains(both, F.lit("window")).alias("_window"),
        F.contains(summary, F.lit("door")).alias("_told_door"), F.contains(summary, F.lit("window")).alias("_told_window"),
    )
    hint = F.lower(F.coalesce("hint", F.lit("")))
    name = F.concat(F.when(F.col("kind") == "door", "door ").otherwise("window "), F.col("width_mm").cast("string"), F.lit("x"), F.col("height_mm").cast("string"), F.lit(" "), hint)
    door = F.col("kind") == "door"
    shape = ["kind", "width_mm", "height_mm", "hint"]
    shapes = requirements.select("kind", "width_mm", "height_mm", hint.alias("hint")).distinct().withColumn(
        "_asked", F.when(door, door_features(name)).otherwise(F.array().cast("array<int>"))
    ).withColumn("_want", F.when(door, sem.requested_leaves(name, "width_mm")).otherwise(0))
    shapes = shapes.withColumn("_words", F.when(door, F.array().cast("array<string>")).otherwise(F.filter(F.split("hint", r"[ \-_/\\]"), lambda w: F.length(w) > 2)))
    stand_ins = top_k(lib.select("file_id", *traits), traits, [F.col("file_id")], k, "_n").select("file_id", F.lit("any").alias("_ask"))
    numbers = lib.select("file_id", F.explode(F.filter(_grams(F.col("_text")), lambda t: t.rlike("^[0-9]{3}$"))).alias("_g")).select("file_id", F.concat(F.lit("n"), "_g").alias("_ask"))
    told = lib.select("file_id", F.explode(_grams(F.col("_summary"))).alias("_g")).select("file_id", F.concat(F.lit("g"), "_g").alias("_ask"))
    asks = F.concat(
        F.array(F.lit("any"), F.concat(F.lit("n"), F.substring(F.col("width_mm").cast("string"), 1, 3))),
        F.transform("_words", lambda w: F.concat(F.lit("g"), F.substring(w, 1, 3))),
    )
    index = stand_ins.unionByName(numbers).unionByName(told)
    met = shapes.withColumn("_ask", F.explode(F.array_distinct(asks))).join(index, "_ask").drop("_ask").dropDuplicates([*shape, "file_id"]).join(lib, "file_id")
    category = F.when(door, F.col("_door")).otherwise(F.col("_window"))
    size = _has_size(F.col("_text"), F.col("width_mm").cast("string"), F.col("height_mm").cast("string"))
    feature = F.size(F.array_intersect("_asked", "_features")) > 0
    described = F.when(door, F.size(F.array_intersect("_asked", "_described")) > 0).otherwise(F.exists("_words", lambda w: F.contains(F.col("_summary"), w)))
    clash = (F.col("_want") > 0) & (F.col("_leaves") > 0) & (F.col("_want") != F.col("_leaves"))
    agree = (F.col("_want") > 0) & (F.col("_want") == F.col("_leaves"))
    base = (
        F.when(category & size & feature, 130).when(category & size, 100).when(size & feature, 90).when(size, 70)
        .when(category & feature, 65).when(feature, 45).when(category, 40).otherwise(0)
    )
    told_kind = F.when(door, F.col("_told_door")).otherwise(F.col("_told_window"))
    extra = F.when(F.col("_cached"), 10 + F.when(told_kind, 15).otherwise(0) + F.when(described, 25).otherwise(0)).otherwise(0)
    score = F.when(clash, 0).otherwise(base + F.when(agree, 45).otherwise(0) + extra)
    scored = met.select(*shape, "file_id", score.alias("score"), category.alias("category_matched"), size.alias("size_matched")).where("score > 0")
    best = top_k(scored, shape, [F.col("score").desc(), F.col("file_id")], k)
    return requirements.select("requirement_id", "kind", "width_mm", "height_mm", hint.alias("hint")).join(best, shape).select(
        "requirement_id", "rank", "file_id", "score", "category_matched", "size_matched"
    )


def assignment_plan(requirements: DataFrame, candidates: DataFrame, loaded: DataFrame) -> DataFrame:
    """Status, risk and confidence of each required type from loaded sizes and candidates.

    ``loaded``: ``kind``, ``width_mm``, ``height_mm``, ``editable`` of the types at hand.
    """
    tops = candidates.groupBy("requirement_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.max("score").alias("_s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_s2"),
        F.min(F.when(F.col("rank") == 1, F.col("file_id"))).alias("best_file"),
    )
    sizes = loaded.select("kind", "width_mm", "height_mm").distinct().withColumn("_loaded", F.lit(True))
    templates = loaded.groupBy("kind").agg(F.bool_or("editable").alias("_editable"))
    rows = requirements.join(tops, "requirement_id", "left").join(sizes, ["kind", "width_mm", "height_mm"], "left").join(templates, "kind", "left")
    has = F.coalesce("candidates", F.lit(0)) > 0
    risk = F.when(F.col("_loaded"), "low").when(has | F.coalesce("_editable", F.lit(False)), "medium").otherwise("high")
    status = (
        F.when(F.col("_loaded"), "loaded matching size available").when(has, "candidate family files found")
        .when(F.col("_editable"), "editable loaded template available").otherwise("no reliable loaded type or candidate family file")
    )
    close = F.coalesce(F.col("_s1") - F.col("_s2") <= 15, F.lit(False))
    base = F.when(risk == "low", 0.9).when(risk == "medium", 0.72).otherwise(0.32)
    raised = F.when(has, F.greatest(base, F.least(F.lit(0.95), 0.45 + F.col("_s1") / 200.0))).otherwise(base)
    return rows.select(
        "requirement_id", "kind", "width_mm", "height_mm", status.alias("status"), risk.alias("risk"), "best_file", F.coalesce("candidates", F.lit(0)).alias("candidates"), close.alias("scores_close"),
        F.round(F.when(close, F.least(raised, F.lit(0.74))).otherwise(raised), 2).alias("confidence"), ((risk == "high") | close).alias("needs_review"),
    )


def match_reports(plan: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows that ask for a look: unresolved types, close scores, candidates whose category disagrees."""
    unresolved = plan.where("risk = 'high'").select("requirement_id", F.lit("unresolved").alias("report"), F.lit(None).cast("bigint").alias("file_id"))
    visual = plan.where("scores_close").select("requirement_id").join(candidates, "requirement_id").select("requirement_id", F.lit("visual_review").alias("report"), F.col("file_id").cast("bigint").alias("file_id"))
    conflict = candidates.where("not category_matched").select("requirement_id", F.lit("conflict").alias("report"), F.col("file_id").cast("bigint").alias("file_id"))
    return unresolved.unionByName(visual).unionByName(conflict)


def accept_candidates(components: DataFrame, candidates: DataFrame, keys: Keys = (), by: Keys = ("id",)) -> DataFrame:
    """Give components without a type file the best candidate: highest score, then file name.

    ``candidates``: keys, ``by``, ``file_path``, ``score``. Components that are alike in ``by`` have the same candidates, listed once for all of them.
    """
    name = F.lower(F.regexp_replace("file_path", r"^.*[\\/]", ""))
    best = candidates.groupBy(*keys, *by).agg(F.min(F.struct((-F.col("score")).alias("s"), name.alias("n"), F.col("file_path"))).alias("_b"))
    rows = components.join(best, [*keys, *by], "left")
    empty = F.coalesce("family_file", F.lit("")) == ""
    return rows.select(*[c for c in components.columns if c != "family_file"], F.when(empty, F.col("_b.file_path")).otherwise(F.col("family_file")).alias("family_file"))


def model_statistics(components: DataFrame, keys: Keys = ()) -> DataFrame:
    """Components per group: in total, ready, to be reviewed."""
    status = F.col("review_status")
    return components.groupBy(*keys, "component_group").agg(
        F.count(F.lit(1)).alias("input_count"), F.count_if(status.isin("ready", "confirmed")).alias("ready_count"), F.count_if(status == "needs_review").alias("needs_review_count")
    )


def outcome_statistics(outcomes: DataFrame, keys: Keys) -> DataFrame:
    """Outcomes of a modelling run per group."""
    return outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "skipped", "failed", "pending")])


def model_preview(components: DataFrame, keys: Keys = ()) -> DataFrame:
    columns = [*keys, "component_group", "id", "type", "level", "source", "confidence", "review_status", "notes"]
    return components.select(*[c if c in components.columns else F.lit(None).cast("string").alias(c) for c in columns])


def model_details(components: DataFrame, keys: Keys = ()) -> DataFrame:
    flags = [F.when(F.lower(F.coalesce(c, F.lit(""))).contains("default"), F.col(c)) for c in ("source", "notes") if c in components.columns]
    return components.select(*keys, "component_group", F.col("id").alias("component_id"), F.col("review_status").alias("input_status"), F.concat_ws(" | ", *flags).alias("default_values_used"))


def modeling_subset(components: DataFrame) -> DataFrame:
    """Components of the groups the modelling host takes, with their place in its sequence."""
    place = F.array_position(F.array(*map(F.lit, MODEL_SEQUENCE)), F.col("component_group")).cast("int")
    return components.withColumn("sequence", place).where("sequence > 0")


def source_readiness(components: DataFrame, plan_rows: DataFrame, notes: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """Evidence sources of a project: available, pending or missing.

    ``notes``: keys, ``design_notes``, ``specifications``.
    """
    c = components.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("geometry"), F.count_if(F.coalesce("material_source", F.lit("")) != "").alias("material"),
        F.count_if(F.coalesce("level", F.lit("")) != "").alias("spatial"), F.count_if(F.lower("material_source") == "design_notes").alias("cited"),
    )
    rows = c.join(plan_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("plan")), list(keys), "left").join(notes, list(keys), "left")

    def state(test, otherwise):
        return F.when(F.coalesce(test, F.lit(False)), "available").otherwise(otherwise)

    states = [
        ("dxf_geometry", state(F.col("geometry") > 0, "missing")), ("family_assignment", state(F.col("plan") > 0, "missing")),
        ("material_semantics", state(F.col("material") > 0, "pending")), ("spatial_semantics", state(F.col("spatial") > 0, "pending")),
        ("design_notes", state((F.trim("design_notes") != "") | (F.col("cited") > 0), "pending")), ("specification_documents", state(F.trim("specifications") != "", "pending")),
    ]
    table = F.array(*[F.struct(F.lit(n).alias("source_key"), s.alias("status")) for n, s in states])
    return rows.select(*keys, F.explode(table).alias("_s")).select(*keys, "_s.*")


def tokens(text) -> Column:
    """Distinct lower-case words of at least two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1)), lambda w: F.length(w) >= 2))


def retrieve_cases(queries: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """Cases that share most words with a query, newest first on a tie.

    ``queries``: ``query_id``, ``text``. ``cases``: ``case_id``, ``text``, ``created_at``; rows of one case and time count as one.

    A query's words are ordered by how many cases hold them. The cases met through the rarer half give a bound: the ``k``-th
    best overlap so far, t. A case that shares t of m words holds one of the rarest m - t + 1, so the common rest is never
    looked up. A word of all cases adds the same to each: only the ``k`` newest cases are listed under it.
    """
    by, case = ["_case"], F.struct("case_id", "created_at").alias("_case")
    asked = queries.select("query_id", F.explode(tokens("text")).alias("w")).distinct()
    held = cases.select(case, F.explode(tokens("text")).alias("w")).join(asked.select("w").distinct(), "w", "left_semi").distinct()
    held = checkpoint(held)
    total = cases.select(case).distinct().count()
    counted = held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("everywhere", F.col("n") == total)
    newest = cases.select(case).distinct().orderBy(F.col("_case.created_at").desc(), "_case.case_id").limit(k)
    marked = held.join(counted.where("everywhere").select("w", "everywhere"), "w", "left")
    index = marked.where("everywhere is null").select("w", *by).unionByName(marked.where("everywhere").join(newest, by, "left_semi").select("w", *by))
    index = checkpoint(index)
    # Positions of the words of a query, rarest first; words of all cases stand before them, at 0.
    known = asked.join(counted, "w").groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(~F.col("everywhere"), F.struct("n", "w")))).alias("_rare"), F.collect_list(F.when(F.col("everywhere"), F.col("w"))).alias("_all"))
    known = checkpoint(known.select("query_id", F.transform("_rare", lambda e: e["w"]).alias("_rare"), "_all", F.concat(F.transform("_rare", lambda e: e["w"]), "_all").alias("_asked")))
    listed = F.concat(F.transform("_all", lambda w: F.struct(F.lit(0).alias("pos"), w.alias("w"))), F.transform("_rare", lambda w, i: F.struct((i + 1).alias("pos"), w.alias("w"))))
    words = known.select("query_id", F.size("_rare").alias("_m"), F.size("_all").alias("_same"), F.explode(listed).alias("e")).select("query_id", "_m", "_same", "e.*")
    sets = held.groupBy(*by).agg(F.collect_set("w").alias("_held"))

    def scored(prefix: DataFrame) -> DataFrame:
        met = prefix.select("query_id", "w").join(index, "w").select("query_id", *by).distinct()
        both = met.join(sets, by).join(known.select("query_id", "_asked"), "query_id")
        return both.select("query_id", "_case.*", F.size(F.array_intersect("_asked", "_held")).cast("bigint").alias("score"))

    def best(rows: DataFrame, rank: str = "rank") -> DataFrame:
        return top_k(rows, ["query_id"], [F.col("score").desc(), F.col("created_at").desc(), F.col("case_id")], k, rank)

    half = F.ceil(F.col("_m") / 2)
    first = checkpoint(best(scored(words.where(F.col("pos") <= half)), "_r").drop("_r"))
    bound = first.groupBy("query_id").agg(F.min("score").alias("_t"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).select("query_id", "_t")
    wanted = F.coalesce(F.greatest(F.col("_t") - F.col("_same"), F.lit(1)), F.lit(1))
    rest = words.join(bound, "query_id", "left").where((F.col("pos") > half) & (F.col("pos") <= F.col("_m") - wanted + 1))
    return best(first.unionByName(scored(rest)).distinct()).drop("created_at")


def case_summaries(components: DataFrame, issues: DataFrame, keys: Keys = ("project_id",), shown: int = 8) -> DataFrame:
    """Component counts and the first issues of a project."""
    counts = components.groupBy(*keys, "component_group").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("component_group", "n")))).alias("component_counts")
    )
    first = top_k(issues, list(keys), [F.col("ord")], shown, "_r").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "message"))).alias("_m"))
    total = issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("issues"))
    text = F.concat_ws(" | ", F.transform("_m", lambda m: m["message"]))
    return counts.join(first, list(keys), "left").join(total, list(keys), "left").select(
        *keys, "component_counts", F.coalesce("issues", F.lit(0)).alias("issues"), F.when(F.col("_m").isNull(), "No validation issues.").otherwise(text).alias("failure_summary")
    )


def latest(rows: DataFrame, keys: Keys, newest: str) -> DataFrame:
    """Keep the newest row per key."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(newest).alias("_o"), F.struct(*rows.columns).alias("_r"))).alias("_b"))
    return best.select("_b._r.*")


def remap_hosts(items: DataFrame, replacements: DataFrame, keys: Keys, field: str, list_fields: tuple = ()) -> DataFrame:
    """Replace ids of dropped components by the kept ones, in plain fields and in short id lists."""
    named = replacements.select(*keys, F.col("id").alias("_old"), F.col("duplicate_of").alias("_new"))
    out = items.join(named.withColumnRenamed("_old", field), [*keys, field], "left").withColumn(field, F.coalesce("_new", field)).drop("_new").select(*items.columns)
    for name in list_fields:
        parts = out.select(*keys, "id", F.posexplode(name).alias("_p", "_old")).join(named, [*keys, "_old"], "left")
        lists = parts.groupBy(*keys, "id").agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_new", "_old").alias("v")))).alias("_l"))
        out = out.join(lists, [*keys, "id"], "left").withColumn(name, F.array_distinct(F.transform("_l", lambda e: e["v"]))).drop("_l")
    return out


def without_projections(components: DataFrame) -> DataFrame:
    """Mark components of elevation, section and detail views as removed; stair plans stay for matching."""
    name = F.lower(F.coalesce("drawing_name", F.lit("")))
    stair_plan = (F.col("component_group") == "stairs") & (F.col("drawing_type") == "detail") & name.rlike("楼梯平面|stair plan|stair_plan")
    projection = F.col("drawing_type").isin(sem.NON_SPATIAL)
    status = F.when(projection & stair_plan, "retained_for_spatial_stair_matching").when(projection, "removed").otherwise("kept")
    reason = F.when(status == "removed", F.when(F.col("drawing_type") == "detail", "detail_geometry").otherwise("elevation_or_section_projection"))
    return components.withColumn("deduplication_status", status).withColumn("removal_reason", reason)


def count_changes(before: DataFrame, after: DataFrame, keys: Keys = ()) -> DataFrame:
    """Components per group before and after de-duplication."""
    def counted(df, name):
        return df.groupBy(*keys, "component_group").agg(F.count(F.lit(1)).alias(name))

    rows = counted(before, "before").join(counted(after, "after"), [*keys, "component_group"], "left").fillna(0, ["after"])
    return rows.withColumn("removed", F.greatest(F.lit(0), F.col("before") - F.col("after")))
