"""Drawing interchange files (group code / value pairs) as tables of tags, entities and placed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftloom.functions import geometry as g
from draftloom.session import checkpoint

# Entity types that are kept, and the group codes of their numbers.
SIMPLE_TYPES = ["LINE", "ARC", "CIRCLE", "LWPOLYLINE", "TEXT", "MTEXT", "DIMENSION", "INSERT"]
NUMBER_CODES = ["10", "20", "11", "21", "13", "23", "14", "24", "40", "41", "42", "50", "51", "70"]


#: Pairs of a chunk where a file is given as one text.
CHUNK_TAGS = 65536


def read_tags(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file``, ``chunk``, ``n``, ``code``, ``val``: lines of each file taken in pairs; an odd last line is dropped.

    A file of any size is read by many tasks: Spark hands out byte ranges, which are the chunks. Lines are written once with their order
    within the range; a prefix sum over the counts of the ranges (one row each) then tells every line its number in the file, hence whether it
    is a code or a value. Where a range ends between the two, the value is the first line of the next range.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("i"), g.strip("value").alias("value"))
    lines = checkpoint(lines)
    ranges = lines.groupBy("file", "chunk").agg(F.min("i").alias("_i0"), F.count(F.lit(1)).alias("_n"), F.min_by("value", "i").alias("_first"))
    order = Window.partitionBy("file").orderBy("chunk")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = checkpoint(ranges.select("file", "chunk", "_i0", before.alias("_base"), F.lead("_first").over(order).alias("_next")))
    inside = Window.partitionBy("file", "chunk").orderBy("i")
    numbered = lines.withColumn("_val", F.lead("value").over(inside)).join(ranges, ["file", "chunk"])
    line = F.col("i") - F.col("_i0") + F.col("_base")
    pairs = numbered.where(line % 2 == 0).select("file", "chunk", F.floor(line / 2).cast("bigint").alias("n"), F.col("value").alias("code"), F.coalesce("_val", "_next").alias("val"))
    return pairs.where("val is not null")


def tags_of(files: DataFrame, chunk_tags: int = CHUNK_TAGS) -> DataFrame:
    """:func:`read_tags` for files given as rows (``file``, ``value``), each cut into chunks of ``chunk_tags`` pairs.

    Chunks are dealt out as texts and taken apart where they arrive, so the prefix scans over them (:func:`carried`) shuffle no tags.
    """
    lines = files.withColumn("_l", F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).where(F.size("_l") >= 2)
    pairs = F.floor(F.size("_l") / 2)
    chunks = lines.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((pairs - 1) / chunk_tags).cast("bigint"))))
    first = F.col("chunk") * chunk_tags
    texts = chunks.select("file", "chunk", F.array_join(F.slice("_l", (first * 2 + 1).cast("int"), (F.least(F.lit(chunk_tags).cast("bigint"), pairs - first) * 2).cast("int")), "\n").alias("_t"))
    # As many parts as a shuffle has: a part grows when it is taken apart, so it must not be merged by its size as text.
    texts = texts.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "chunk")
    cut = texts.withColumn("_l", F.split("_t", "\n"))
    tags = F.transform(
        F.sequence(F.lit(0), (F.size("_l") / 2).cast("int") - 1),
        lambda i: F.struct((i + F.col("chunk") * chunk_tags).cast("bigint").alias("n"), g.strip(F.get("_l", i * 2)).alias("code"), g.strip(F.get("_l", i * 2 + 1)).alias("val")),
    )
    return cut.select("file", "chunk", F.explode(tags).alias("_t")).select("file", "chunk", "_t.*")


def carried(df: DataFrame, order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Running sums and last known values along the rows of a file, from its chunks: first inside each chunk, then what the chunks before it bring.

    Only one small row per chunk is put in order for a whole file.
    """
    sums, lasts = sums or {}, lasts or {}
    inside = Window.partitionBy("file", "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(c).over(inside).alias(f"_{n}") for n, c in sums.items()], *[F.last(c, ignorenulls=True).over(inside).alias(f"_{n}") for n, c in lasts.items()])
    ends = df.groupBy("file", "chunk").agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(n) for n, c in lasts.items()])
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.select("file", "chunk", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}_before") for n in sums], *[F.last(n, ignorenulls=True).over(before).alias(f"_{n}_before") for n in lasts])
    out = local.join(brought, ["file", "chunk"])
    return out.select(*df.columns, *[(F.col(f"_{n}") + F.col(f"_{n}_before")).alias(n) for n in sums], *[F.coalesce(f"_{n}", f"_{n}_before").alias(n) for n in lasts])


def number_tags(tags: DataFrame) -> DataFrame:
    """Adds ``section``, ``entity`` (number of the entity in its file) and ``block`` (number of the block); written, as entities and blocks both read it."""
    if "section" in tags.columns:
        return tags
    tags = carried(tags, "n", lasts={"_zero": F.when(F.col("code") == "0", F.struct("n", "val"))})
    # A section is named by the pair after its start.
    named = (F.col("code") == "2") & (F.col("_zero.n") == F.col("n") - 1) & (F.col("_zero.val") == "SECTION")
    mark = F.when(named, F.col("val")).when((F.col("code") == "0") & F.col("val").isin("SECTION", "ENDSEC"), F.lit(""))
    zero = F.col("code") == "0"
    return checkpoint(carried(tags.withColumn("_mark", mark).drop("_zero"), "n", {"entity": F.when(zero, 1).otherwise(0), "block": F.when(zero & (F.upper("val") == "BLOCK"), 1).otherwise(0)}, {"section": F.col("_mark")}).drop("_mark"))


def _value(code: str, default: str | None = None) -> Column:
    """Last value of a group code."""
    found = F.max_by(F.when(F.col("code") == code, F.col("val")), F.when(F.col("code") == code, F.col("n")))
    return found if default is None else F.coalesce(found, F.lit(default))


def _gathered(numbered: DataFrame) -> DataFrame:
    """One row per entity with its type, layer, numbers, texts and polyline corners."""
    def number(code):
        return F.coalesce(_value(code).try_cast("double"), F.lit(1.0 if code in ("41",) else 0.0)).alias(f"c{code}")

    corners = F.array_sort(F.collect_list(F.when(F.col("code").isin("10", "20"), F.struct("n", "code", F.coalesce(F.col("val").try_cast("double"), F.lit(0.0)).alias("v")))))
    parts = F.array_sort(F.collect_list(F.when(F.col("code").isin("1", "3"), F.struct("n", "val"))))
    rows = numbered.groupBy("file", "section", "block", "entity").agg(
        F.min("n").alias("ord"), F.min("chunk").alias("chunk"), F.upper(F.max_by(F.when(F.col("code") == "0", F.col("val")), F.when(F.col("code") == "0", F.col("n")))).alias("etype"), _value("8", "0").alias("layer"), _value("2", "").alias("name"),
        *[number(c) for c in NUMBER_CODES], F.max(F.when(F.col("code") == "42", 1)).isNotNull().alias("_has42"), corners.alias("_c"), parts.alias("_p"),
    )
    fold = F.aggregate(
        "_c", F.struct(F.lit(None).cast("double").alias("x"), F.array().cast("array<struct<x:double,y:double>>").alias("pts")),
        lambda s, e: F.when(e["code"] == "10", F.struct(e["v"].alias("x"), s["pts"].alias("pts")))
        .when(s["x"].isNotNull(), F.struct(F.lit(None).cast("double").alias("x"), F.concat(s["pts"], F.array(g.point(s["x"], e["v"]))).alias("pts"))).otherwise(s),
    )["pts"]
    return rows.withColumn("points", F.when(F.col("etype") == "LWPOLYLINE", fold)).withColumn("text", F.concat_ws("", F.transform("_p", lambda p: p["val"]))).drop("_c", "_p")


def _shaped(rows: DataFrame) -> DataFrame:
    """Entity columns by type; zero-radius circles and arcs and polylines below two corners are dropped."""
    kind = F.col("etype")
    line, dim, arc, circle, insert = (kind == k for k in ("LINE", "DIMENSION", "ARC", "CIRCLE", "INSERT"))
    text, round_, poly = kind.isin("TEXT", "MTEXT"), kind.isin("ARC", "CIRCLE"), kind.isin("LWPOLYLINE", "POLYLINE")
    usable = ~(round_ & (F.col("c40") <= 0)) & ~(poly & (F.coalesce(F.size("points"), F.lit(0)) < 2))
    return rows.where(usable).select(
        "file", "section", "block", "chunk", "ord", "etype", "layer",
        F.when(line, F.col("c10")).when(dim, F.col("c13")).alias("x1"), F.when(line, F.col("c20")).when(dim, F.col("c23")).alias("y1"),
        F.when(line, F.col("c11")).when(dim, F.col("c14")).alias("x2"), F.when(line, F.col("c21")).when(dim, F.col("c24")).alias("y2"),
        F.when(round_ | text | dim | insert, F.col("c10")).alias("cx"), F.when(round_ | text | dim | insert, F.col("c20")).alias("cy"),
        F.when(round_, F.col("c40")).alias("radius"), F.when(arc, F.col("c50")).alias("a0"), F.when(arc, F.col("c51")).alias("a1"),
        F.when(poly, F.col("points")).alias("points"), F.when(poly, F.col("c70").cast("int") % 2 == 1).alias("closed"), F.when(text | dim, F.col("text")).alias("text"),
        F.when(insert | dim, F.col("name")).alias("block_name"), F.when(insert, F.col("c41")).alias("sx"), F.when(insert, F.when(F.col("_has42"), F.col("c42")).otherwise(1.0)).alias("sy"),
        F.when(text | dim | insert, F.col("c50")).alias("rot"), F.when(text, F.col("c40")).alias("height"), F.when(dim, F.col("c42")).alias("measurement"),
    )


def read_entities(tags: DataFrame) -> DataFrame:
    """Entities of the ENTITIES section in source order; a POLYLINE takes the VERTEX entities that follow it."""
    # Written once: the prefix scan, the corners and the entities all read it, and each would gather the tags again.
    rows = checkpoint(_gathered(number_tags(tags).where("section = 'ENTITIES' and entity > 0")).where(F.col("etype").isNotNull()))
    # The scan takes along what the corners need, not the whole entities, and only polylines meet their corners.
    narrow = rows.select("file", "chunk", "ord", "entity", "etype", "c10", "c20")
    led = carried(narrow, "ord", lasts={"_lead": F.when(F.col("etype") != "VERTEX", F.struct("entity", "etype"))})
    corners = led.where("etype = 'VERTEX' and _lead.etype = 'POLYLINE'").groupBy("file", F.col("_lead.entity").alias("entity")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("c10").alias("x"), F.col("c20").alias("y")))), lambda p: g.point(p["x"], p["y"])).alias("_v")
    )
    old = rows.where("etype = 'POLYLINE'").join(corners, ["file", "entity"], "left").withColumn("points", F.col("_v")).drop("_v")
    return _shaped(rows.where(F.col("etype").isin(SIMPLE_TYPES)).unionByName(old)).drop("chunk")


def read_blocks(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Block definitions (name, base point, bounds, layers, count) and their entities."""
    numbered = number_tags(tags).where("section = 'BLOCKS' and entity > 0 and block > 0")
    heads = numbered.groupBy("file", "block").agg(F.min_by(F.when(F.col("code") == "2", F.col("val")), F.when(F.col("code") == "2", F.col("n"))).alias("block_name"))
    rows = checkpoint(_gathered(numbered))
    base = rows.where("etype = 'BLOCK'").select("file", "block", F.col("c10").alias("base_x"), F.col("c20").alias("base_y"))
    named = heads.join(base, ["file", "block"]).where(F.coalesce("block_name", F.lit("")) != "")
    # A name defined again replaces the earlier definition.
    last = named.groupBy("file", "block_name").agg(F.max("block").alias("block"))
    named = named.join(last, ["file", "block_name", "block"])
    entities = _shaped(rows.where(F.col("etype").isin(SIMPLE_TYPES))).withColumnRenamed("block_name", "ref_name").join(named, ["file", "block"])
    boxes = _with_extent(entities).groupBy("file", "block_name").agg(
        F.min("x_lo").alias("x0"), F.min("y_lo").alias("y0"), F.max("x_hi").alias("x1"), F.max("y_hi").alias("y1"), F.array_sort(F.collect_set("layer")).alias("block_layers"),
        F.count(F.lit(1)).alias("geometry_count"), F.first("base_x").alias("base_x"), F.first("base_y").alias("base_y"),
    ).where("x0 is not null")
    return boxes, entities.join(boxes.select("file", "block_name"), ["file", "block_name"], "left_semi")


def _with_extent(entities: DataFrame) -> DataFrame:
    """Box of each line, circle, arc and light polyline; other types have none."""
    round_, poly, line = F.col("etype").isin("ARC", "CIRCLE"), F.col("etype") == "LWPOLYLINE", F.col("etype") == "LINE"
    box = g.bounding_box("points")

    def side(name, a, b, pick, sign, part):
        return F.when(line, pick(F.col(a), F.col(b))).when(round_, F.col(name) + sign * F.col("radius")).when(poly, box[part])

    return entities.withColumn("x_lo", side("cx", "x1", "x2", F.least, -1, "x0")).withColumn("y_lo", side("cy", "y1", "y2", F.least, -1, "y0")).withColumn(
        "x_hi", side("cx", "x1", "x2", F.greatest, 1, "x1")).withColumn("y_hi", side("cy", "y1", "y2", F.greatest, 1, "y1"))


def place_blocks(entities: DataFrame, definitions: DataFrame, block_entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Block references with the box, centre and layers of what they place, and the placed entities.

    Children are scaled about the base point, turned and moved; a mirrored arc swaps its ends.
    References to unknown or empty blocks stay as they are.
    """
    refs = entities.where("etype = 'INSERT'")
    r = refs.select("file", "block_name", F.col("ord").alias("insert_ord"), F.col("cx").alias("ix"), F.col("cy").alias("iy"), F.col("sx").alias("isx"), F.col("sy").alias("isy"), F.coalesce("rot", F.lit(0.0)).alias("irot"))
    children = block_entities.drop("section", "block", "chunk")
    rows = r.join(children, ["file", "block_name"]).where("etype <> 'DIMENSION'")
    angle = F.radians("irot")

    def moved(x, y):
        dx, dy = (x - F.col("base_x")) * F.col("isx"), (y - F.col("base_y")) * F.col("isy")
        return F.col("ix") + dx * F.cos(angle) - dy * F.sin(angle), F.col("iy") + dx * F.sin(angle) + dy * F.cos(angle)

    def turned(a):
        x, y = F.cos(F.radians(a)) * F.col("isx"), F.sin(F.radians(a)) * F.col("isy")
        tx, ty = x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)
        return F.pmod(F.degrees(F.atan2(ty, tx)), F.lit(360.0))

    mirrored = F.col("isx") * F.col("isy") < 0
    new = {}
    for x, y in (("x1", "y1"), ("x2", "y2"), ("cx", "cy")):
        new[x], new[y] = moved(F.col(x), F.col(y))
    new["radius"] = F.col("radius") * (F.abs("isx") + F.abs("isy")) / 2.0
    new["a0"], new["a1"] = F.when(mirrored, turned(F.col("a1"))).otherwise(turned(F.col("a0"))), F.when(mirrored, turned(F.col("a0"))).otherwise(turned(F.col("a1")))
    new["points"] = F.transform("points", lambda p: g.point(*moved(p["x"], p["y"])))
    placed = rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])
    boxes = _with_extent(placed).groupBy("file", "insert_ord").agg(
        F.min("x_lo").alias("bx0"), F.min("y_lo").alias("by0"), F.max("x_hi").alias("bx1"), F.max("y_hi").alias("by1"), F.count(F.lit(1)).alias("block_geometry_count")
    ).where("bx0 is not null").withColumnRenamed("insert_ord", "ord")
    out = refs.join(boxes, ["file", "ord"], "left").join(definitions.select("file", "block_name", "block_layers"), ["file", "block_name"], "left")
    known = F.col("bx0").isNotNull()
    out = out.withColumn("source_x", F.when(known, F.col("cx"))).withColumn("source_y", F.when(known, F.col("cy")))
    out = out.withColumn("cx", F.when(known, (F.col("bx0") + F.col("bx1")) / 2).otherwise(F.col("cx"))).withColumn("cy", F.when(known, (F.col("by0") + F.col("by1")) / 2).otherwise(F.col("cy")))
    return out, placed.drop("base_x", "base_y", "ix", "iy", "isx", "isy", "irot")


def place_blocks_by_offset(entities: DataFrame, definitions: DataFrame) -> DataFrame:
    """References moved by their offset only: for blocks drawn in place and inserted at most 20 m away."""
    refs = entities.where("etype = 'INSERT'").select("file", "ord", "layer", "block_name", F.col("cx").alias("source_x"), F.col("cy").alias("source_y"))
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    rows = refs.join(definitions, ["file", "block_name"]).where((F.hypot(mx, my) >= 1) & (F.hypot("source_x", "source_y") <= 20000))
    return rows.select("file", "ord", "layer", "block_name", "source_x", "source_y", (mx + F.col("source_x")).alias("cx"), (my + F.col("source_y")).alias("cy"),
                       *[(F.col(c) + F.col("source_x" if c[0] == "x" else "source_y")).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")], "block_layers", "geometry_count")


def segments(entities: DataFrame) -> DataFrame:
    """Lines and polyline edges as directed segments with ``ord`` (entity, edge)."""
    lines = entities.where("etype = 'LINE'").select("file", F.struct("ord", F.lit(0).alias("edge")).alias("ord"), "layer", "x1", "y1", "x2", "y2", F.col("etype").alias("source"))
    edges = entities.where(F.col("etype").isin("LWPOLYLINE", "POLYLINE")).select("file", "ord", "layer", "etype", F.posexplode(g.polygon_edges("points", F.col("closed"))).alias("edge", "e"))
    edges = edges.select("file", F.struct("ord", "edge").alias("ord"), "layer", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"), F.col("etype").alias("source"))
    return g.with_direction(lines.unionByName(edges)).withColumn("id", F.concat_ws("/", "ord.ord", "ord.edge")).withColumn("ord", F.col("ord.ord") * 65536 + F.col("ord.edge"))
