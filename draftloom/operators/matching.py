"""Nearest labels, marks and elements; matching of openings across views; detail fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftloom.functions import geometry as g
from draftloom.operators.ordered import first_wins, match_greedy, match_serial, number_rows
from draftloom.operators.spatial import Keys, box_join, finer_rings, nearest, prefixed, sane, usual_crowd
from draftloom.operators.walls import BOX, DRAWING, _boxed
from draftloom.session import checkpoint, checkpoint_path, discard


def point_box(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("bx0", F.col(x)).withColumn("by0", F.col(y)).withColumn("bx1", F.col(x)).withColumn("by1", F.col(y))


def _apart(x1, y1, x2, y2) -> Column:
    return F.round(F.hypot(F.col(x1) - F.col(x2), F.col(y1) - F.col(y2)), 6)


def nearest_marks(openings: DataFrame, marks: DataFrame, keys: Keys = DRAWING, opening_id: str = "opening_id") -> DataFrame:
    """Nearest mark of the same kind, closer than 2500; the first mark wins a tie."""
    by_kind = [*keys, "kind"]
    return nearest(
        openings, point_box(marks), by_kind, [opening_id], ("x", "y"), BOX, _apart("x", "y", "m_x", "m_y"), (300.0, 2500.0),
        order=[F.col("m_mark_id")], inclusive=False, right_prefix="m_",
    )


def unused_marks(marks: DataFrame, openings: DataFrame, keys: Keys = ("drawing_id", "kind"), mark: Keys = ("drawing_id", "mark_id"), limit: float = 2500.0) -> DataFrame:
    """Marks (columns ``mark``) without an opening of equal ``keys`` closer than ``limit``.

    A cell whose diagonal is shorter than ``limit`` settles all marks of a cell with an opening; only the others meet the places of openings around them.
    """
    side = limit / 1.42
    at = [F.when(sane("x", "y"), F.floor(F.col(c) / side)).cast("bigint").alias(n) for c, n in (("x", "_cx"), ("y", "_cy"))]
    places = openings.select(*keys, "x", "y").distinct()
    full = places.select(*keys, *at).distinct().withColumn("_full", F.lit(True))
    seen = checkpoint(marks.select(*{*keys, *mark}, "x", "y", *at).join(full, [*keys, "_cx", "_cy"], "left").drop("_cx", "_cy"))
    apart = F.pow(F.col("a_x") - F.col("b_x"), F.lit(2)) + F.pow(F.col("a_y") - F.col("b_y"), F.lit(2))
    near = box_join(point_box(seen.where("_full is null")), point_box(places), keys, BOX, BOX, limit, margin=limit, condition=apart < limit * limit)
    own = [c if c in keys else f"a_{c}" for c in mark]
    used = seen.where("_full").select(*mark).unionByName(near.select(*[F.col(a).alias(c) for a, c in zip(own, mark)])).distinct()
    return marks.select(*mark).join(used, list(mark), "left_anti")


def nearby_geometry(openings: DataFrame, raw: DataFrame, keys: Keys = DRAWING, opening_id: str = "opening_id", k: int = 12, radius: float = 1500.0) -> DataFrame:
    """The ``k`` nearest raw shapes within a radius, ranked."""
    return nearest(
        openings, point_box(raw), keys, [opening_id], ("x", "y"), BOX, _apart("x", "y", "g_x", "g_y"), (radius / 4, radius),
        order=[F.col("g_raw_id")], k=k, right_prefix="g_",
    )


# Element tables in the order in which they win ties, with their geometry.
ASSOCIATION_ORDER = [
    ("grid", "line"), ("wall", "line"), ("wall_run", "line"), ("door", "point"), ("window", "point"), ("column", "point"),
    ("floor", "polygon"), ("roof", "polygon"), ("parapet", "line"), ("floor_opening", "point"), ("stair", "line"), ("railing", "line"),
]


def associate_texts(texts: DataFrame, elements: DataFrame, keys: Keys = DRAWING, rings=(300.0, 1500.0, 5000.0)) -> DataFrame:
    """Nearest element of each text, at most 5000 away.

    ``elements``: keys, ``element_id``, ``element_type``, ``ord`` and x1, y1, x2, y2; a polygon brings one row
    per edge, a point has equal ends. Ties go to the earlier table, then the earlier row.
    """
    order = F.array_position(F.array(*[F.lit(n) for n, _ in ASSOCIATION_ORDER]), F.col("e_element_type"))
    shapes = {n: s for n, s in ASSOCIATION_ORDER}
    method = F.element_at(F.create_map(*[F.lit(v) for pair in shapes.items() for v in pair]), F.col("e_element_type"))
    line = ("e_x1", "e_y1", "e_x2", "e_y2")
    found = nearest(
        texts, _boxed(elements), keys, ["text_id"], ("x", "y"), BOX, F.round(g.point_segment_distance("x", "y", *line), 6), rings,
        order=[order, F.col("e_ord")], right_prefix="e_", right_line=("x1", "y1", "x2", "y2"),
    )
    return found.select(
        *keys, "text_id", F.col("e_element_id").alias("element_id"), F.col("e_element_type").alias("element_type"),
        F.round("_distance", 3).alias("distance"), F.concat(F.lit("nearest_"), method).alias("method"),
    )


def axis_names(axes: DataFrame, texts: DataFrame, keys: Keys = DRAWING, reach: float = 600.0) -> DataFrame:
    """Nearest short text of each axis, closer than 600; the first text wins a tie."""
    short = point_box(texts.where(F.length(F.trim("text")).between(1, 8)))
    line = ("a_x1", "a_y1", "a_x2", "a_y2")
    d = F.round(g.point_segment_distance("b_x", "b_y", *line), 6)
    pairs = box_join(_boxed(axes), short, keys, BOX, BOX, 2500.0, margin=reach, condition=d < reach)
    best = pairs.groupBy(*keys, F.col("a_id").alias("id")).agg(F.min(F.struct(d.alias("d"), F.col("b_text_id"), F.trim("b_text").alias("name"))).alias("_b"))
    return axes.join(best, [*keys, "id"], "left").select(*axes.columns, F.col("_b.name").alias("name"))


def opening_contexts(openings: DataFrame, labels: DataFrame, titles: DataFrame, keys: Keys = DRAWING, opening_id: str = "opening_id") -> DataFrame:
    """Context of each opening: nearest face label, else the title's face, the title, the frame or none.

    ``labels``: keys, ``text_id``, ``x``, ``y``, ``face``. ``titles``: keys, ``title``, ``title_face``, ``frame_id``.
    """
    near = nearest(
        openings, point_box(labels), keys, [opening_id], ("x", "y"), BOX, _apart("x", "y", "l_x", "l_y"), (1000.0, 8000.0),
        order=[F.col("l_text_id")], inclusive=False, right_prefix="l_",
    ).select(*keys, opening_id, F.col("l_face").alias("_face"), F.col("_distance").alias("_d"))
    all_rows = openings.join(near, [*keys, opening_id], "left").join(titles, list(keys), "left")

    def context(name, source, confidence):
        return F.struct(name.alias("context_name"), F.lit(source).alias("context_source"), confidence.alias("confidence"))

    chosen = (
        F.when(F.col("_face").isNotNull(), context(F.col("_face"), "nearest_face_label", F.when(F.col("_d") < 2500, 0.88).otherwise(0.72)))
        .when(F.col("title_face").isNotNull(), context(F.col("title_face"), "drawing_title_face", F.lit(0.82)))
        .when(F.col("title").isNotNull(), context(F.col("title"), "drawing_title", F.lit(0.66)))
        .when(F.col("frame_id").isNotNull(), context(F.col("frame_id"), "drawing_frame", F.lit(0.55)))
        .otherwise(context(F.lit("未命名图纸范围"), "fallback", F.lit(0.35)))
    )
    return all_rows.withColumn("_c", chosen).select(*openings.columns, "title", "frame_id", "_c.*")


def context_summaries(relations: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Doors and windows per context. Members stay rows of the relation table."""
    return relations.groupBy(*keys, "context_name", "context_source").agg(
        F.count_if(F.col("kind") == "door").alias("doors"), F.count_if(F.col("kind") == "window").alias("windows"),
        F.count(F.lit(1)).alias("openings_total"),
    )


def match_marks(doors: DataFrame, marks: DataFrame, keys: Keys = DRAWING, limit: float = 2500.0) -> DataFrame:
    """Door-mark pairs, nearest pairs first, where doors and marks of a drawing disagree in number.

    Acts on drawings with at least 5 doors, 5 marks and a difference of at least 3.
    ``doors``: keys, ``id``, ``ord``, ``x``, ``y``; ``marks`` the same. Returns keys, ``door``, ``mark``, ``distance``.
    """
    counts = doors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).join(marks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), list(keys))
    gate = counts.where((F.col("_d") >= 5) & (F.col("_m") >= 5) & (F.abs(F.col("_d") - F.col("_m")) >= 3)).select(*keys)
    left, right = doors.join(gate, list(keys), "left_semi"), marks.join(gate, list(keys), "left_semi")
    many, others = (usual_crowd(df, keys, ("x", "y"), limit) for df in (left, right))
    if many * others <= SPARSE * (many + others):
        return _match_pairs(left, right, keys, limit)
    return _match_places(left, right, keys, limit)


#: Up to so many partners in reach (of the usual row of the rarer side) all pairs are listed at once.
SPARSE = 4.0


def _match_pairs(doors: DataFrame, marks: DataFrame, keys: Keys, limit: float) -> DataFrame:
    d = _apart("a_x", "a_y", "b_x", "b_y")
    pairs = box_join(point_box(doors), point_box(marks), keys, BOX, BOX, limit, margin=limit, condition=d <= limit)
    pairs = pairs.select(*keys, F.col("a_id").alias("door"), F.col("b_id").alias("mark"), d.alias("distance"), F.col("a_ord").alias("door_ord"), F.col("b_ord").alias("mark_ord"))
    return match_greedy(pairs, keys, "door", "mark", ["distance", "door_ord", "mark_ord"]).select(*keys, "door", "mark", "distance")


def _match_places(doors: DataFrame, marks: DataFrame, keys: Keys, limit: float) -> DataFrame:
    """As :func:`_match_pairs`, without a list of all pairs in reach.

    Nearer pairs are taken first, so all within a small radius are settled before a wider one is looked at, where few rows are still free.
    Rows of one place have the same distances, so places meet, not rows. Two places that are nearest to each other and to no
    third match their rows in order, as many as both have; so does a place that is nearest to several places alike, if these
    have no other as near. Of the other ties, a round takes the first row of each place. The result is that of the serial scan. Keys in which an id or an order
    stands for different rows are matched pair by pair.
    """
    spark = doors.sparkSession

    def members(df: DataFrame) -> DataFrame:
        known = sane("x", "y")
        for c in (*keys, "id", "x", "y"):
            known = known & F.col(c).isNotNull()
        return df.where(known).groupBy(*keys, "id", "ord", "x", "y").agg(F.count(F.lit(1)).alias("copies"))

    sides = [checkpoint(members(df)) for df in (doors, marks)]
    odd = [df.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(*keys) for df in sides for c in ("id", "ord")]
    odd += [df.where("ord is null").select(*keys) for df in sides]
    unclear = odd[0]
    for more in odd[1:]:
        unclear = unclear.unionByName(more)
    unclear = checkpoint(unclear.distinct())
    plain = None
    if not unclear.isEmpty():
        plain = _match_pairs(*[df.join(unclear, list(keys), "left_semi") for df in (doors, marks)], keys, limit)
        sides = [checkpoint(df.join(unclear, list(keys), "left_anti")) for df in sides]
    places = [df.select(*keys, "x", "y").distinct() for df in sides]
    a, b = (usual_crowd(df, keys, ("x", "y"), limit) for df in places)
    paths: list[str] = []
    schema = None
    for radius in [*finer_rings(limit, a * b / (a + b) if a and b else 0.0, 1.0, 2), limit]:
        spots = [point_box(df.select(*keys, "x", "y").distinct()) for df in sides]
        d = _apart("a_x", "a_y", "b_x", "b_y")
        # A hair more than the radius: distances are rounded.
        links = box_join(*spots, keys, BOX, BOX, radius, margin=limit if radius == limit else radius + 1e-5, condition=d <= radius)
        links = links.select(*keys, *[F.col(f"{s}_{c}").alias(f"{s}{c}") for s in "ab" for c in "xy"], d.alias("d"))
        links, links_path = checkpoint_path(links)
        at = [links.select(*keys, *[F.col(f"{s}{c}").alias(c) for c in "xy"]).distinct() for s in "ab"]
        busy = [checkpoint_path(df.join(spot, [*keys, "x", "y"], "left_semi")) for df, spot in zip(sides, at)]
        first = len(paths)
        while True:
            links, after_path = checkpoint_path(_open_links(links, busy[0][0], busy[1][0], keys))
            discard(spark, links_path)
            links_path = after_path
            if links.isEmpty():
                break
            found, path = checkpoint_path(_matched_places(links, busy[0][0], busy[1][0], keys))
            schema = found.schema
            paths.append(path)
            left = [checkpoint_path(df.join(found.select(*keys, F.col(c).alias("id")), [*keys, "id"], "left_anti")) for (df, _), c in zip(busy, ("door", "mark"))]
            for _, done in busy:
                discard(spark, done)
            busy = left
        if len(paths) > first:
            gone = spark.read.schema(schema).parquet(*paths[first:])
            sides = [checkpoint(df.join(gone.select(*keys, F.col(c).alias("id")), [*keys, "id"], "left_anti")) for df, c in zip(sides, ("door", "mark"))]
    if not paths:
        return _match_pairs(doors.where(F.lit(False)), marks, keys, limit) if plain is None else plain
    # Rows that are there several times match several times.
    result = spark.read.schema(schema).parquet(*paths).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*keys, "door", "mark", "distance")
    return result if plain is None else result.unionByName(plain)


def _open_links(links: DataFrame, doors: DataFrame, marks: DataFrame, keys: Keys) -> DataFrame:
    """Pairs of places that both have free rows, with the order of the first of them (``ao``, ``bo``)."""
    out = links.drop("ao", "bo")
    for s, df in (("a", doors), ("b", marks)):
        heads = df.groupBy(*keys, "x", "y").agg(F.min("ord").alias(f"{s}o"))
        out = out.join(heads.withColumnsRenamed({"x": f"{s}x", "y": f"{s}y"}), [*keys, f"{s}x", f"{s}y"])
    return out


def _matched_places(links: DataFrame, doors: DataFrame, marks: DataFrame, keys: Keys) -> DataFrame:
    """One round of :func:`_match_places`: keys, ``door``, ``mark``, ``distance``, ``copies``."""
    a, b = [*keys, "ax", "ay"], [*keys, "bx", "by"]
    near = links.join(links.groupBy(*a).agg(F.min("d").alias("_da")), a).join(links.groupBy(*b).agg(F.min("d").alias("_db")), b)
    near = near.withColumn("_a", F.col("d") == F.col("_da")).withColumn("_b", F.col("d") == F.col("_db")).where("_a or _b")
    # How many places are nearest alike, and the first row among them.
    of_a = near.where("_a").groupBy(*a).agg(F.count(F.lit(1)).alias("_na"), F.min("bo").alias("_first_b"))
    of_b = near.where("_b").groupBy(*b).agg(F.count(F.lit(1)).alias("_nb"), F.min("ao").alias("_first_a"))
    near = checkpoint(near.join(of_a, a).join(of_b, b))
    hub_a = near.where("_a").groupBy(*a).agg(F.bool_and(F.col("_b") & (F.col("_nb") == 1)).alias("_hub_a"))
    hub_b = near.where("_b").groupBy(*b).agg(F.bool_and(F.col("_a") & (F.col("_na") == 1)).alias("_hub_b"))
    both = checkpoint(near.where("_a and _b").join(hub_a, a).join(hub_b, b))
    hub = F.when(F.col("_hub_a"), F.struct(F.lit("a").alias("s"), F.col("ax").alias("x"), F.col("ay").alias("y"))).otherwise(F.struct(F.lit("b").alias("s"), F.col("bx").alias("x"), F.col("by").alias("y")))
    stars = both.where("_hub_a or _hub_b").withColumn("_hub", hub)
    turn = Window.partitionBy(*keys, "_hub").orderBy("ord")

    def queue(s: str, df: DataFrame, name: str) -> DataFrame:
        at = stars.select(*keys, F.col(f"{s}x").alias("x"), F.col(f"{s}y").alias("y"), "_hub", *(["d"] if s == "a" else [])).distinct()
        rows = df.join(at, [*keys, "x", "y"]).withColumn("_n", F.row_number().over(turn))
        return rows.select(*keys, "_hub", "_n", F.col("id").alias(name), F.col("copies").alias(f"_c{s}"), *(["d"] if s == "a" else []))

    in_order = queue("a", doors, "door").join(queue("b", marks, "mark"), [*keys, "_hub", "_n"])
    heads = both.where("not _hub_a and not _hub_b").where((F.col("bo") == F.col("_first_b")) & (F.col("ao") == F.col("_first_a")))
    for s, df, name in (("a", doors, "door"), ("b", marks, "mark")):
        heads = heads.join(df.select(*keys, F.col("ord").alias(f"{s}o"), F.col("id").alias(name), F.col("copies").alias(f"_c{s}")), [*keys, f"{s}o"])
    out = [*keys, "door", "mark", F.col("d").alias("distance"), (F.col("_ca") * F.col("_cb")).alias("copies")]
    return in_order.select(*out).unionByName(heads.select(*out))


def mark_offsets(matches: DataFrame, doors: DataFrame, marks: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Median shift from a mark to its door, per mark text of a drawing."""
    both = matches.join(prefixed(doors, "d_", keys).withColumnRenamed("d_id", "door"), [*keys, "door"]).join(
        prefixed(marks, "m_", keys).withColumnRenamed("m_id", "mark"), [*keys, "mark"]
    )
    return both.groupBy(*keys, F.col("m_text").alias("text")).agg(
        F.percentile(F.col("d_x") - F.col("m_x"), F.lit(0.5)).alias("dx"), F.percentile(F.col("d_y") - F.col("m_y"), F.lit(0.5)).alias("dy")
    )


def hosts_of_free_marks(free: DataFrame, taken: DataFrame, walls: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Walls for marks without a door, avoiding hosts already used by equal marks close by.

    ``free``: keys, ``id``, ``ord``, ``text``, ``x``, ``y``. ``taken``: keys, ``text``, ``x``, ``y``, ``host``. ``walls``: keys,
    ``id``, ``ord``, x1, y1, x2, y2. Equal marks 350 to 1800 apart along one axis (300 across) name one
    opening each, so a mark waits for its earlier neighbours and then skips their hosts and
    the lines these lie on.
    """
    ori = g.orientation("x1", "y1", "x2", "y2")
    line = F.when(ori == "H", F.concat(F.lit("H:"), F.round((F.col("y1") + F.col("y2")) / 2, 1))).when(
        ori == "V", F.concat(F.lit("V:"), F.round((F.col("x1") + F.col("x2")) / 2, 1))
    )
    walls = _boxed(walls.withColumn("line", line))
    dx, dy = F.abs(F.col("a_x") - F.col("b_x")), F.abs(F.col("a_y") - F.col("b_y"))
    close = (F.least(dx, dy) <= 300) & F.greatest(dx, dy).between(350, 1800)
    by_text = [*keys, "text"]
    waits = box_join(point_box(free), point_box(free), by_text, BOX, BOX, 1800.0, margin=1800.0, condition=close & (F.col("b_ord") < F.col("a_ord")))
    waits = checkpoint(waits.select(*keys, F.col("a_id").alias("id"), F.col("b_id").alias("before")))
    pending, used, done = checkpoint(free), taken.select(*keys, "text", "x", "y", "host"), None
    while not pending.isEmpty():
        late = waits.join(pending.select(*keys, F.col("id").alias("before")), [*keys, "before"], "left_semi").select(*keys, "id").distinct()
        ready = pending.join(late, [*keys, "id"], "left_anti")
        barred = box_join(point_box(ready), point_box(used.where("host is not null")), by_text, BOX, BOX, 1800.0, margin=1800.0, condition=close)
        barred = barred.select(*keys, F.col("a_id").alias("id"), F.col("b_host").alias("host")).distinct()
        lines = barred.join(walls.select(*keys, F.col("id").alias("host"), "line"), [*keys, "host"], "left")
        # One opening has few equal neighbours, so the two lists stay short.
        lists = lines.groupBy(*keys, "id").agg(F.collect_set("host").alias("_hosts"), F.collect_set("line").alias("_lines"))
        open_rows = ready.join(lists, [*keys, "id"], "left")
        allowed = ~F.coalesce(F.array_contains("_hosts", F.col("w_id")), F.lit(False)) & ~F.coalesce(F.array_contains("_lines", F.col("w_line")), F.lit(False))
        ends = ("w_x1", "w_y1", "w_x2", "w_y2")
        near = nearest(open_rows, walls, keys, ["id"], ("x", "y"), BOX, F.round(g.point_segment_distance("x", "y", *ends), 6), (1000.0, 8000.0, float("inf")),
                       order=[F.col("w_ord")], condition=allowed, right_prefix="w_")
        foot = g.project_point("x", "y", *ends)
        answer = ready.join(near.select(*keys, "id", F.col("w_id").alias("host"), foot.alias("foot")), [*keys, "id"], "left")
        answer = checkpoint(answer)
        done = answer if done is None else done.unionByName(answer)
        used = used.unionByName(answer.select(*keys, "text", "x", "y", "host"))
        pending = checkpoint(pending.join(answer.select(*keys, "id"), [*keys, "id"], "left_anti"))
    return done if done is not None else free.withColumn("host", F.lit(None).cast(walls.schema["id"].dataType)).withColumn("foot", F.lit(None))


def match_score(plan: str = "p_", elevation: str = "e_") -> Column:
    """Likeness of a plan and an elevation opening of the same kind, 0 to 1."""
    def pair(name):
        return F.col(plan + name), F.col(elevation + name)

    (pm, em), (pw, ew), (ph, eh), (pp, ep) = pair("mark"), pair("width"), pair("height"), pair("position")
    pm, em = F.upper(F.trim(pm)), F.upper(F.trim(em))
    both = (pm != "") & (em != "")
    mark = F.when(both & (pm == em), 0.42).when(both & (F.substring(pm, 1, 1) == F.substring(em, 1, 1)), 0.08).otherwise(0.0)
    dw, dh, dp = F.abs(pw - ew), F.abs(ph - eh), F.abs(pp - ep)
    width = F.when(dw <= 80, 0.2).when(dw <= 200, 0.1).otherwise(0.0)
    height = F.when(dh <= 120, 0.08).when(dh <= 300, 0.04).otherwise(0.0)
    place = F.when(dp <= 300, 0.2).when(dp <= 900, 0.1).when(dp.isNotNull(), -0.08).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.22 + mark + width + height + place)), 6)


# Score from which an opening of another facade is taken.
OTHER_FACADE = 0.68
#: Openings of a list that a plan opening looks at first; each later look takes twice as many.
LOOK = 8


def _view_class(df: DataFrame) -> DataFrame:
    """``class``: all that the score of a far pair depends on (mark, width, height, whether the position is known)."""
    known = F.col("position").isNotNull()
    mark = F.upper(F.trim(F.coalesce("mark", F.lit(""))))
    text = F.concat_ws("|", mark, F.coalesce(F.col("width").cast("string"), F.lit("?")), F.coalesce(F.col("height").cast("string"), F.lit("?")), known.cast("string"))
    return df.withColumn("class", text)


def _far_lists(p: DataFrame, e: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """Elevation openings in the order in which plan openings of a class would take them, positions set aside.

    Returns the lists (keys, ``p_kind``, ``p_facade``, ``list``, ``place``, ``e_id``, ``score``, ``rank``) and the list of every class. Scores are
    worked out for pairs of classes; classes with the same scores share a list. Own facade first, then others from 0.68.
    """
    far = [F.when(F.col("position").isNotNull(), F.lit(x)).alias("position") for x in (0.0, 1e6)]
    facts = ("kind", "facade", "class", "mark", "width", "height")
    pc = prefixed(p.select(*keys, *facts, far[0]).dropDuplicates([*keys, "kind", "facade", "class"]), "p_", keys)
    ec = prefixed(e.select(*keys, *facts, far[1]).dropDuplicates([*keys, "kind", "facade", "class"]), "e_", keys)
    both = pc.join(ec.withColumn("p_kind", F.col("e_kind")), [*keys, "p_kind"]).withColumn("score", match_score())
    own = F.col("p_facade") == F.col("e_facade")
    both = both.where((own & (F.col("score") > 0)) | (~own & (F.col("score") >= OTHER_FACADE))).withColumn("tier", F.when(own, 0).otherwise(1))
    both = checkpoint(both.select(*keys, "p_kind", "p_facade", "p_class", "e_facade", "e_class", "tier", "score"))
    by = [*keys, "p_kind", "p_facade"]
    signs = [F.sum(F.xxhash64("e_facade", "e_class", "tier", "score", F.lit(i)).cast("decimal(20,0)")).cast("string") for i in (1, 2)]
    classes = both.groupBy(*by, "p_class").agg(F.concat_ws(":", *signs, F.count(F.lit(1)).cast("string")).alias("list"))
    steps = both.join(classes, [*by, "p_class"]).select(*by, "list", "e_facade", "e_class", "tier", "score").distinct()
    items = e.select(*keys, F.col("kind").alias("p_kind"), F.col("facade").alias("e_facade"), F.col("class").alias("e_class"), F.col("id").alias("e_id"), F.col("ord").alias("e_ord"))
    rows = steps.join(items, [*keys, "p_kind", "e_facade", "e_class"]).withColumn("_step", F.col("tier") * 10 - F.col("score"))
    rows = number_rows(rows, [*by, "list"], [F.col("_step"), F.col("e_ord"), F.col("e_id")], F.col("_step"), "place")
    rank = F.struct("tier", (-F.col("score")).alias("neg"), "e_ord").alias("rank")
    return rows.select(*by, "list", "place", "e_id", "score", rank), classes


def _near_pairs(p: DataFrame, e: DataFrame, keys: Keys) -> DataFrame:
    """Pairs of one kind with positions within 900, each with its own score."""
    a, b = prefixed(p.where("position is not null"), "p_", keys), prefixed(e.where("position is not null"), "e_", keys)
    cell = F.floor(F.col("p_position") / 900)
    pairs = a.withColumn("_k", F.col("p_kind")).withColumn("_c", F.explode(F.array(cell - 1, cell, cell + 1))).join(
        b.withColumn("_k", F.col("e_kind")).withColumn("_c", F.floor(F.col("e_position") / 900)), [*keys, "_k", "_c"]
    ).where(F.abs(F.col("p_position") - F.col("e_position")) <= 900).withColumn("score", match_score())
    own = F.col("p_facade") == F.col("e_facade")
    pairs = pairs.where((own & (F.col("score") > 0)) | (~own & (F.col("score") >= OTHER_FACADE)))
    rank = F.struct(F.when(own, 0).otherwise(1).alias("tier"), (-F.col("score")).alias("neg"), "e_ord").alias("rank")
    return pairs.select(*keys, "p_id", "p_ord", "e_id", "score", rank)


def match_views(plans: DataFrame, elevations: DataFrame, keys: Keys = ("project_id",), look: int = LOOK) -> DataFrame:
    """Each plan opening, in order, takes the best free elevation opening of its facade.

    Both sides: keys, ``id``, ``ord``, ``kind``, ``facade``, ``mark``, ``width``, ``height``, ``position``. A plan opening whose
    facade has nothing left may take an opening of another facade with a score of at least 0.68.

    No facade is paired row by row. Positions within 900 are joined by cells; all other pairs of two classes (mark, width,
    height) score alike, so a plan opening finds them in the list of its class, a stretch at a time. Of the openings of one list that
    have no near pair, the n-th starts at place n: those before it have taken all places before it, whatever the others
    do. A near pair is looked at once the list has come to its rank, so what an opening has seen is always complete.
    """
    p, e = _view_class(plans), _view_class(elevations)
    lists, classes = _far_lists(p, e, keys)
    by = [*keys, "p_kind", "p_facade"]
    lists, near = checkpoint(lists), checkpoint(_near_pairs(p, e, keys))
    sizes = lists.groupBy(*by, "list").agg(F.max("place").alias("size"))
    ids = [*keys, "p_id"]
    seen = prefixed(p.select(*keys, "id", "ord", "kind", "facade", "class"), "p_", keys).join(classes, [*by, "p_class"], "left").join(sizes, [*by, "list"], "left")
    seen = seen.join(near.select(*ids).distinct().withColumn("_near", F.lit(1)), ids, "left")
    before = Window.partitionBy(*by, "list").orderBy("p_ord", "p_id").rowsBetween(Window.unboundedPreceding, -1)
    skipped = F.coalesce(F.sum(F.when(F.col("_near").isNull(), 1).otherwise(0)).over(before), F.lit(0)).cast("long")
    size = F.coalesce("size", F.lit(0)).cast("long")
    seen = checkpoint(seen.select(*ids, "p_ord", "p_kind", "p_facade", "list", size.alias("size"), F.least(skipped, size).alias("lo"), F.lit(look).cast("long").alias("step")))

    looking, parked, held, prefs = seen.withColumn("low", F.lit(None).cast(near.schema["rank"].dataType)), None, None, None
    while True:
        stretch = looking.where("lo < size").withColumn("place", F.explode(F.sequence(F.col("lo") + 1, F.least(F.col("lo") + F.col("step"), F.col("size")))))
        found = stretch.join(lists, [*by, "list", "place"]).select(*ids, "p_ord", "e_id", "score", "rank")
        ends = looking.join(found.groupBy(*ids).agg(F.max("rank").alias("high")), ids, "left").withColumn("last", F.col("lo") + F.col("step") >= F.col("size"))
        due = near.join(ends.select(*ids, "low", "high", "last"), ids).where((F.col("low").isNull() | (F.col("rank") > F.col("low"))) & (F.col("last") | (F.col("rank") <= F.col("high"))))
        found = checkpoint(found.unionByName(due.select(*ids, "p_ord", "e_id", "score", "rank")))
        ends = checkpoint(ends)
        held, prefs = match_serial(found if prefs is None else prefs.unionByName(found), keys, "p_id", "e_id", "rank", "p_ord", held)
        # Openings that hold something or saw their whole list wait; the others look further.
        moved = ends.select(*seen.columns, "low", "high").withColumns({
            "lo": F.least(F.col("lo") + F.col("step"), F.col("size")), "step": F.col("step") * 2, "low": F.coalesce("high", "low")}).drop("high")
        moved = checkpoint(moved if parked is None else moved.unionByName(parked))
        looking = checkpoint(moved.where("lo < size").join(held.select(*ids), ids, "left_anti"))
        if looking.isEmpty():
            break
        parked = moved.join(looking.select(*ids), ids, "left_anti")
    result = held.select(*keys, "p_id", "e_id", "score", F.when(F.col("score") >= OTHER_FACADE, "matched").otherwise("needs_review").alias("match_status"))
    return plans.select(*keys, F.col("id").alias("p_id"), "kind", "facade").join(result, ids, "left").select(
        *keys, F.col("kind").alias("opening_kind"), F.col("p_id").alias("plan_id"), F.col("e_id").alias("elevation_id"), "facade",
        F.round(F.coalesce("score", F.lit(0.0)), 3).alias("score"), F.coalesce("match_status", F.lit("unmatched")).alias("match_status"),
    )


def back_fill(openings: DataFrame, matches: DataFrame, elevations: DataFrame, keys: Keys = ("project_id",)) -> DataFrame:
    """Copy sill, height, mark and category of matched elevation openings to plan openings.

    Windows need status ``matched``, doors also take ``needs_review``. Replaced values stay in ``*_original``.
    """
    usable = (F.col("match_status") == "matched") | ((F.col("opening_kind") == "door") & (F.col("match_status") == "needs_review"))
    source = elevations.select(
        *keys, F.col("id").alias("elevation_id"), F.col("sill_mm").alias("_sill"), F.col("height_mm").alias("_height"),
        F.col("mark").alias("_mark"), F.col("category").alias("_category"),
    )
    found = matches.where(usable).join(source, [*keys, "elevation_id"]).select(
        *keys, F.col("plan_id").alias("id"), "elevation_id", "match_status", F.col("score").alias("match_score"), "_sill", "_height", "_mark", "_category"
    )
    rows = openings.join(found, [*keys, "id"], "left")
    checked = F.when(F.col("match_status") == "matched", "matched_elevation_opening").when(F.col("match_status").isNotNull(), "matched_elevation_opening_needs_review")
    door = F.col("kind") == "door"
    sill_differs = F.abs(F.col("sill_mm") - F.col("_sill")) > 1e-6
    take_mark = (F.coalesce("mark", F.lit("")) == "") & (F.coalesce("_mark", F.lit("")) != "")
    take_category = F.lower(F.coalesce("category", F.lit(""))).isin("", "unknown") & (F.coalesce("_category", F.lit("")) != "")
    return rows.select(
        *keys, "id", "kind",
        F.coalesce("_sill", "sill_mm", F.when(door & F.col("elevation_id").isNotNull(), 0.0)).alias("sill_mm"),
        F.when(F.col("_sill").isNotNull(), "matched_elevation_opening").alias("sill_source"),
        F.when(sill_differs, F.col("sill_mm")).alias("sill_original"),
        F.coalesce("_height", "height_mm").alias("height_mm"), F.when(F.col("_height").isNotNull(), checked).alias("height_source"),
        F.when(F.abs(F.col("height_mm") - F.col("_height")) > 1e-6, F.col("height_mm")).alias("height_original"),
        F.when(take_mark, F.col("_mark")).otherwise(F.col("mark")).alias("mark"), F.when(take_mark, checked).alias("mark_source"),
        F.when(take_category, F.col("_category")).otherwise(F.col("category")).alias("category"), "elevation_id", "match_score",
    )


def plan_facades(openings: DataFrame, walls: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Facade of a plan opening: the side of the plan's wall box nearest to its host wall."""
    box = walls.groupBy(*keys).agg(
        F.min(F.least("x1", "x2")).alias("_x0"), F.min(F.least("y1", "y2")).alias("_y0"),
        F.max(F.greatest("x1", "x2")).alias("_x1"), F.max(F.greatest("y1", "y2")).alias("_y1"),
    )
    host = walls.select(*keys, F.col("id").alias("host_wall_id"), ((F.col("x1") + F.col("x2")) / 2).alias("_mx"), ((F.col("y1") + F.col("y2")) / 2).alias("_my"),
                        g.orientation("x1", "y1", "x2", "y2", 5).alias("_ori"))
    side = F.when(F.col("_ori") == "H", F.when(F.abs(F.col("_my") - F.col("_y0")) <= F.abs(F.col("_my") - F.col("_y1")), "south").otherwise("north")).when(
        F.col("_ori") == "V", F.when(F.abs(F.col("_mx") - F.col("_x0")) <= F.abs(F.col("_mx") - F.col("_x1")), "west").otherwise("east"))
    return openings.join(host, [*keys, "host_wall_id"]).join(box, list(keys)).select(*openings.columns, side.alias("facade"))


def fuse_details(details: DataFrame, plans: DataFrame, keys: Keys = ("project_id", "component_group")) -> DataFrame:
    """Plan component each detail describes: by unique mark, unique type, unique size, or the only one.

    Both sides: keys, ``id``, ``mark``, ``type``, ``width_mm``, ``height_mm``, ``thickness_mm``. Plan rows are counted
    per mark, type and distinct size first, so details never meet single plan rows.
    """
    def unique(by, name):
        # Only values held by exactly one plan row can decide.
        return plans.where(by != "").groupBy(*keys, by.alias(name)).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias(f"_{name}_id")).where("_n = 1").drop("_n")

    mark, kind = F.upper(F.trim(F.coalesce("mark", F.lit("")))), F.lower(F.trim(F.coalesce("type", F.lit(""))))
    stable = F.when(kind.isin("", "unresolved", "generic door", "generic window", "stair", "railing"), "").otherwise(kind)
    sizes = ["width_mm", "height_mm", "thickness_mm"]
    kinds = plans.groupBy(*keys, *sizes).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pid"))
    wanted = details.select(*keys, *sizes).distinct()
    pairs = wanted.withColumn("_w", F.explode(F.when(F.col("width_mm").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(
        F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda s: F.floor(F.col("width_mm") / 10) + s))))
    close = kinds.select(*keys, *[F.col(c).alias(f"p_{c}") for c in sizes], "n", "pid").withColumn("_w", F.floor(F.col("p_width_mm") / 10))
    compared = sum((F.when(F.col(c).isNotNull() & F.col(f"p_{c}").isNotNull(), 1).otherwise(0) for c in sizes), F.lit(0))
    fits = F.lit(True)
    for c in sizes:
        fits = fits & F.coalesce(F.abs(F.col(c) - F.col(f"p_{c}")) <= 10, F.lit(True))
    on_width = pairs.join(close, [*keys, "_w"]).where(F.col("p_width_mm").isNotNull())
    # Sizes without a width on either side compare by the other two fields.
    kinds_only = close.drop("_w")
    bare = wanted.where("width_mm is null").join(kinds_only, list(keys)).unionByName(
        wanted.where("width_mm is not null").join(kinds_only.where("p_width_mm is null"), list(keys))
    )
    sized = on_width.drop("_w").unionByName(bare).where(fits & (compared >= 2)).groupBy(*keys, *sizes).agg(
        F.sum("n").alias("_n"), F.min("pid").alias("_size_id")
    ).where("_n = 1").drop("_n")
    total = plans.groupBy(*keys).agg(F.count(F.lit(1)).alias("_plans"), F.min("id").alias("_only"))
    size_on = F.lit(True)
    for k in keys:
        size_on = size_on & (F.col(f"d.{k}") == F.col(f"s.{k}"))
    for c in sizes:
        size_on = size_on & F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}"))
    rows = details.withColumn("_mark", mark).withColumn("_type", stable)
    rows = rows.alias("d").join(sized.alias("s"), size_on, "left").select("d.*", "s._size_id")
    rows = rows.join(unique(mark, "mk").withColumnRenamed("mk", "_mark"), [*keys, "_mark"], "left")
    rows = rows.join(unique(stable, "ty").withColumnRenamed("ty", "_type"), [*keys, "_type"], "left").join(total, list(keys), "left")

    def found(which, basis, confidence):
        return F.struct(which.alias("plan_id"), F.lit(basis).alias("match_basis"), F.lit(confidence).alias("confidence"))

    best = (
        F.when(F.col("_mk_id").isNotNull(), found(F.col("_mk_id"), "exact_component_mark", 0.98))
        .when(F.col("_ty_id").isNotNull(), found(F.col("_ty_id"), "unique_component_type", 0.88))
        .when(F.col("_size_id").isNotNull(), found(F.col("_size_id"), "unique_matching_size", 0.82))
        .when(F.col("_plans") == 1, found(F.col("_only"), "single_plan_candidate", 0.7))
        .when(F.col("_plans") > 1, found(F.lit(None), "ambiguous", 0.0))
        .otherwise(found(F.lit(None), "no_floor_plan_candidate", 0.0))
    )
    return rows.select(*keys, "id", best.alias("_f")).select(*keys, "id", "_f.*")


def merge_detail_values(plans: DataFrame, details: DataFrame, links: DataFrame, fields: list[str], keys: Keys = ("project_id", "component_group")) -> DataFrame:
    """Plan rows with the fields of their linked details.

    A detail replaces a plan value if the link is sure (0.88) or the plan has none. Of several
    details, the surest and then the first decides each field.
    """
    linked = links.where("plan_id is not null").join(details.select(*keys, "id", *fields), [*keys, "id"])
    sure = F.struct((-F.col("confidence")).alias("c"), F.col("id").alias("i"))
    best = linked.groupBy(*keys, "plan_id").agg(*[
        F.min(F.when(F.col(f).isNotNull(), F.struct(sure.alias("o"), F.col(f).alias("v"), "confidence", "id"))).alias(f"_{f}") for f in fields
    ]).withColumnRenamed("plan_id", "id")
    rows = plans.join(best, [*keys, "id"], "left")
    out = [F.col(c) for c in plans.columns if c not in fields]
    for f in fields:
        use = F.col(f"_{f}").isNotNull() & ((F.col(f"_{f}.confidence") >= 0.88) | F.col(f).isNull())
        out += [F.when(use, F.col(f"_{f}.v")).otherwise(F.col(f)).alias(f), F.when(use, F.col(f"_{f}.id")).alias(f"{f}_detail_id")]
    return rows.select(*out)


def infer_sills(windows: DataFrame, views: DataFrame, keys: Keys = ("project_id",), default: float = 900.0) -> DataFrame:
    """Sill of plan windows without one: usual sill of elevation windows of equal size, else of the project, else 900."""
    from draftloom.operators.ordered import mode

    def size(c):
        return (F.bround(F.col(c) / 10) * 10).cast("bigint")

    sized = views.withColumn("_w", size("width_mm")).withColumn("_h", size("height_mm"))
    by_size = mode(sized.where("_w is not null and _h is not null"), [*keys, "_w", "_h"], F.round("sill_mm", 3)).select(*keys, "_w", "_h", F.col("value").alias("_size_sill"))
    usual = mode(sized, keys, F.round("sill_mm", 3)).select(*keys, F.col("value").alias("_usual"))
    rows = windows.withColumn("_w", size("width_mm")).withColumn("_h", size("height_mm")).join(by_size, [*keys, "_w", "_h"], "left").join(usual, list(keys), "left")
    source = (
        F.when(F.col("sill_mm").isNotNull(), "input_sill_height").when(F.col("_size_sill").isNotNull(), "matched_from_elevation_window_size")
        .when(F.col("_usual").isNotNull(), "common_elevation_window_sill_height").otherwise("default_plan_window_sill_height")
    )
    return rows.select(
        *[c for c in windows.columns if c != "sill_mm"], F.coalesce("sill_mm", "_size_sill", "_usual", F.lit(default)).alias("sill_mm"), source.alias("sill_source"),
        (F.col("sill_mm").isNull() & F.col("_size_sill").isNull() & F.col("_usual").isNull()).alias("sill_needs_review"),
    )


def attach_marks(openings: DataFrame, marks: DataFrame, keys: Keys = DRAWING, opening_id: str = "opening_id") -> DataFrame:
    """Openings with the size of their nearest mark; a width it replaces is kept, doors stand on the floor."""
    near = nearest_marks(openings, marks, keys, opening_id).select(*keys, "kind", opening_id, F.col("m_width_mm").alias("_w"), F.col("m_height_mm").alias("_h"))
    rows = openings.join(near, [*keys, "kind", opening_id], "left")
    found = F.col("_w").isNotNull()
    return rows.select(
        *[c for c in openings.columns if c not in ("width_mm", "height_mm")], F.coalesce("_w", "width_mm").alias("width_mm"), F.coalesce("_h", "height_mm").alias("height_mm"),
        F.when(found & (F.col("_w") != F.col("width_mm")), F.col("width_mm")).alias("width_geometry_original"), F.when(found, "nearest_text_annotation").alias("size_source"),
        F.when(F.col("kind") == "door", 0).alias("sill_mm"), F.when(F.col("kind") == "door", "door_default_floor_level").alias("sill_source"),
    )


def attach_wall_heights(walls: DataFrame, heights: DataFrame, keys: Keys = DRAWING) -> DataFrame:
    """Walls without a height take the drawing's first floor height. ``heights``: keys, ``ord``, ``height_mm``."""
    first = heights.where("height_mm > 0").groupBy(*keys).agg(F.min(F.struct("ord", "height_mm")).alias("_f"))
    rows = walls.join(first, list(keys), "left")
    take = F.col("height_mm").isNull() & F.col("_f").isNotNull()
    return rows.select(*[c for c in walls.columns if c != "height_mm"], F.coalesce("height_mm", "_f.height_mm").alias("height_mm"), F.when(take, "floor_height_candidate").alias("height_source"))
