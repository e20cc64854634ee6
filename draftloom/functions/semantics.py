"""Words to controlled values: kinds, categories, directions, roles, advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from draftloom.functions.geometry import col
from draftloom.functions.text import first_mark, is_layer, opening_kind

# Directions and their aliases.
DIRECTIONS = {
    "east": ["e", "east", "右", "向右"], "west": ["w", "west", "左", "向左"], "north": ["n", "north", "上", "向上"],
    "south": ["s", "south", "下", "向下"], "left": ["left"], "right": ["right"], "double": ["double", "双开"],
    "sliding": ["sliding", "推拉"], "revolving": ["revolving"],
}
HANDS = {"left": ["left", "left_hand", "lh", "左手"], "right": ["right", "right_hand", "rh", "右手"], "double": ["double", "双开"]}

# Drawing types of the standard tables and what each view may be used for.
STANDARD_TYPES = {
    "architectural_plan": "floor_plan", "architectural_elevation": "elevation", "architectural_section": "section",
    "architectural_detail": "detail", "general_assembly": "site_plan",
}
VIEW_ROLES = {
    "floor_plan": "spatial_primary", "elevation": "vertical_reference", "section": "vertical_reference",
    "detail": "component_detail_evidence",
}
NON_SPATIAL = ["elevation", "section", "detail"]
DETAIL_SUBJECTS = [
    ("stair", "楼梯|stair"), ("door_window", "门窗|door.*window|window.*door"), ("door", "门|door"), ("window", "窗|window"),
    ("wall", "墙|wall"), ("roof", "屋面|屋顶|roof"), ("railing", "栏杆|扶手|railing|handrail"),
]

# Words for voids, leaves, motions and materials.
LOFT_WORDS = ["loft", "open to below", "double height", "void", "挑空", "上空", "中空"]
SHAFT_WORDS = ["shaft", "井道", "电梯井", "管井"]
STAIR_WORDS = ["stairwell", "stair_", "stairs", "楼梯"]
LEAF_WORDS = {
    4: ["four leaf", "four panel", "four sliding", "4 leaf", "4-leaf", "四扇", "四开"],
    2: [
        "double leaf", "double-leaf", "double door", "double swing", "double sliding", "two leaf", "two-leaf", "2 leaf",
        "2-leaf", "dbl", "双扇", "双开", "对开", "双面",
    ],
    1: [
        "single leaf", "single-leaf", "single door", "single swing", "single sliding", "one leaf", "one-leaf", "1 leaf",
        "1-leaf", "单扇", "单开", "单嵌板",
    ],
}
MOTION_WORDS = {
    "rolling_shutter": ["rolling shutter", "roller shutter", "roll-up", "roll up", "overhead door", "garage door", "卷帘", "卷闸"],
    "sliding": ["sliding", "slider", "pocket", "推拉", "移门", "墙中"],
    "swing": ["swing", "hinged", "平开", "对开"],
}
MATERIAL_CLASSES = [
    ("Concrete", ["砼", "混凝土", "concrete"]), ("Brick/Masonry", ["砖", "brick", "masonry"]), ("Wood", ["木", "wood"]),
    ("Aluminum", ["铝", "aluminum", "aluminium"]), ("Steel", ["钢", "steel"]), ("Glass", ["玻璃", "glass"]),
]


def any_word(text, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def aliased(value, table: dict, default) -> Column:
    """Canonical word of an alias table."""
    text = F.lower(F.trim(F.coalesce(col(value).cast("string"), F.lit(""))))
    out = None
    for name, aliases in table.items():
        out = F.when(text.isin(aliases), name) if out is None else out.when(text.isin(aliases), name)
    return out.otherwise(default)


def open_direction(value) -> Column:
    return aliased(value, DIRECTIONS, "unknown")


def handing(value) -> Column:
    return aliased(value, HANDS, "")


def category_from_source(kind, source) -> Column:
    """Category that the way of recognition already settles."""
    kind, source = col(kind), col(source)
    return (
        F.when((kind == "door") & (source == "quarter_arc"), "single_swing_door")
        .when((kind == "door") & (source == "double_swing_arc"), "double_swing_door")
        .when((kind == "door") & source.isin("sliding_door_double_rectangles", "merged_adjacent_door_frames"), "sliding_door")
        .when((kind == "window") & (source == "five_parallel_lines"), "sliding_window")
        .otherwise("unknown")
    )


def category_confidence(category, source, confidence) -> Column:
    """Recognition confidence, capped by how strong the way of recognition is."""
    source = F.coalesce(col(source), F.lit(""))
    cap = (
        F.when(source.isin("quarter_arc", "double_swing_arc", "sliding_door_double_rectangles", "five_parallel_lines"), 0.72)
        .when(source.isin("merged_adjacent_door_frames", "elevation_rectangle"), 0.62)
        .when(source == "block", 0.5).otherwise(0.45)
    )
    known = F.lower(F.coalesce(col(category), F.lit(""))).isin("", "unknown")
    return F.when(known, 0.0).otherwise(F.round(F.least(F.coalesce(col(confidence), F.lit(0.0)), cap), 3))


def _compact(name) -> Column:
    return F.regexp_replace(F.lower(col(name)), "[^a-z0-9]", "")


def _starts(text: Column, heads) -> Column:
    return text.rlike("^(?:" + "|".join(heads) + ")")


def block_kind(layer, name, block_layers) -> Column:
    """Door or window from a block's layers, name or size mark."""
    layers = F.concat_ws(" ", col(block_layers))
    compact = _compact(name)
    loose = is_layer(F.concat_ws(" ", col(layer), layers), "opening")
    return F.coalesce(
        opening_kind(F.concat_ws(" ", col(layer), col(name), layers)),
        F.when(_starts(compact, ["tlm", "door", "men", "slidingdoor", "doubledoor", "singledoor"]), "door"),
        F.when(_starts(compact, ["tlc", "pkc", "window", "win", "slidingwindow", "casementwindow"]), "window"),
        F.when(first_mark(name, "door").isNotNull(), "door"),
        F.when(first_mark(name, "window").isNotNull(), "window"),
        F.when(loose & compact.rlike("^(?:m|d|dd|sd|sl|sliding)[0-9]*$"), "door"),
        F.when(loose & compact.rlike("^(?:c|w|sw|cw|win|window)[0-9]*$"), "window"),
    )


def block_category(kind, name) -> Column:
    compact, name, kind = _compact(name), col(name), col(kind)
    door = (
        F.when(name.rlike("双扇|双开") | _starts(compact, ["double", "dbl", "pair", "shuang", "dd"]), "double_swing_door")
        .when(name.rlike("推拉") | _starts(compact, ["tlm", "sliding", "slide", "sd", "sl", "pushpull", "pocket"]), "sliding_door")
    )
    window = (
        F.when(name.rlike("推拉") | _starts(compact, ["tlc", "sliding", "slide", "sw"]), "sliding_window")
        .when(name.rlike("平开") | _starts(compact, ["pkc", "casement", "cw"]), "casement_window")
    )
    return F.coalesce(F.when(kind == "door", door), F.when(kind == "window", window), F.lit("unknown"))


def block_width(x0, y0, x1, y1) -> Column:
    size = F.greatest(F.abs(col(x1) - col(x0)), F.abs(col(y1) - col(y0)))
    return F.when(size.between(300, 6000), F.round(size, 3))


def void_semantic(kind, source, notes, stair_id) -> Column:
    """What a floor opening is: semantic, status, basis."""
    text = F.lower(F.concat_ws(" ", F.coalesce(col(kind), F.lit("")), F.coalesce(col(source), F.lit("")), F.coalesce(col(notes), F.lit(""))))
    loft, shaft = any_word(text, LOFT_WORDS), any_word(text, SHAFT_WORDS)
    stair = (F.coalesce(col(stair_id), F.lit("")) != "") | any_word(text, STAIR_WORDS)
    count = loft.cast("int") + shaft.cast("int") + stair.cast("int")

    def result(semantic, status, basis):
        return F.struct(F.lit(semantic).alias("semantic"), F.lit(status).alias("status"), F.lit(basis).alias("basis"))

    return (
        F.when(count > 1, result("semantic_conflict", "blocked", "conflicting_type_source_or_notes"))
        .when(loft, result("loft_opening", "confirmed", "type_source_or_notes"))
        .when(shaft, result("shaft_opening", "confirmed", "type_source_or_notes"))
        .when(stair, result("stairwell_opening", "confirmed", "type_source_or_related_stair"))
        .otherwise(result("general_floor_opening", "unresolved", "generic_opening_evidence"))
    )


def void_domain(source, kind) -> Column:
    source, kind = F.lower(F.trim(F.coalesce(col(source), F.lit("")))), F.lower(F.trim(F.coalesce(col(kind), F.lit(""))))
    return (
        F.when(source == "hole_layer_rectangle_with_foldline", "generic_opening_layer")
        .when(source == "stair_block_bounds", "stair_plan_block")
        .when(source == "stair_layer_bounds", "stair_layer_geometry")
        .when(source.isin("stair_boundary", "stair_boundary_projected_to_host_floor"), "stair_detail_derived")
        .when(source.startswith("spatial_agent:stair_") | F.contains(kind, F.lit("stairwell")), "stair_spatial_topology")
        .otherwise("unclassified_floor_opening")
    )


def _mapped(value: Column, table: dict, default: str) -> Column:
    out = None
    for key, name in table.items():
        out = F.when(value == key, name) if out is None else out.when(value == key, name)
    return out.otherwise(default)


def standard_drawing_type(drawing_type) -> Column:
    return _mapped(F.coalesce(col(drawing_type), F.lit("")), STANDARD_TYPES, "unknown")


def view_role(drawing_type) -> Column:
    return _mapped(F.coalesce(col(drawing_type), F.lit("")), VIEW_ROLES, "unresolved_view")


def coordinate_authority(drawing_type) -> Column:
    kind = F.coalesce(col(drawing_type), F.lit(""))
    return F.when(kind == "floor_plan", "project_xy_authority").when(kind.isin(NON_SPATIAL), "no_project_xy").otherwise("unverified")


def detail_subject(name, drawing_type) -> Column:
    text = F.lower(F.coalesce(col(name), F.lit("")))
    found = F.coalesce(*[F.when(text.rlike(pattern), subject) for subject, pattern in DETAIL_SUBJECTS], F.lit(""))
    return F.when(col(drawing_type) == "detail", found).otherwise("")


def clean_mark(value) -> Column:
    """Model-side mark: letters with 3-4 digits and, perhaps, 2-4 more; upper case, no separators."""
    text = F.trim(F.replace(F.regexp_replace(F.trim(F.coalesce(col(value), F.lit(""))), r"\\[Pp]", ""), F.lit("\\"), F.lit("")))
    found = F.regexp_extract(text, r"[A-Za-z一-鿿]+[-_]?\d{3,4}(?:[-_]?\d{2,4})?", 0)
    return F.translate(F.upper(found), "-_", "")


def mark_size(mark) -> Column:
    """Prefix, width and height of a cleaned mark; two digits count in hundreds."""
    text = F.upper(F.trim(F.coalesce(col(mark), F.lit(""))))
    short, long = r"^([A-Z一-鿿]+)(\d{2})(\d{2})$", r"^([A-Z一-鿿]+)(\d{3,4})(\d{3,4})$"

    def part(shape, group):
        return F.regexp_extract(text, shape, group)

    is_short, is_long = text.rlike(short), text.rlike(long)
    return F.struct(
        F.when(is_short, part(short, 1)).when(is_long, part(long, 1)).otherwise(F.regexp_replace(text, r"\d+", "")).alias("prefix"),
        F.when(is_short, part(short, 2).try_cast("double") * 100).when(is_long, part(long, 2).try_cast("double")).alias("width_mm"),
        F.when(is_short, part(short, 3).try_cast("double") * 100).when(is_long, part(long, 3).try_cast("double")).alias("height_mm"),
        F.when(text == "", "").when(is_short | is_long, "opening_mark").otherwise("mark").alias("source"),
    )


def opening_semantic(kind, value) -> Column:
    """Controlled door or window type named by a word, NULL if it names none."""
    text = F.translate(F.lower(F.trim(F.coalesce(col(value), F.lit("")))), " -", "__")
    compact = F.regexp_replace(text, "[^0-9a-zA-Z一-鿿]", "")
    slide = F.contains(compact, F.lit("推拉"))
    door = (
        F.when(compact.isin("singleswingdoor", "singleleafswingdoor", "d", "m"), "single_swing_door")
        .when(compact.isin("doubleswingdoor", "doubleleafswingdoor", "dm", "双开门", "双扇平开门"), "double_swing_door")
        .when(compact.isin("slidingdoor") | slide | compact.startswith("tlm"), "sliding_door")
        .when(F.contains(text, F.lit("quarter_arc")) | F.contains(text, F.lit("swing")) | F.contains(compact, F.lit("平开")), "single_swing_door")
    )
    window = (
        F.when(compact.isin("casementwindow", "pc") | F.contains(compact, F.lit("平开")) | compact.startswith("pc"), "casement_window")
        .when(compact.isin("slidewindow") | slide | F.contains(text, F.lit("sliding")) | _starts(compact, ["tc", "tlc"]), "sliding_window")
    )
    return F.when(col(kind) == "door", door).otherwise(window)


def opening_type(kind, candidates: list, width) -> Column:
    """First usable candidate; a door without one falls back on its width."""
    named = F.coalesce(*[opening_semantic(kind, c) for c in candidates])
    by_width = F.when((col(kind) == "door") & col(width).isNotNull(), F.when(col(width) >= 1200, "double_swing_door").otherwise("single_swing_door"))
    return F.struct(
        F.coalesce(named, by_width, F.lit("unresolved")).alias("semantic_type"),
        F.when(named.isNotNull(), "named").when(by_width.isNotNull(), "width_rule_fallback").otherwise("unresolved").alias("source"),
        F.when(named.isNotNull(), F.lit(None).cast("double")).when(by_width.isNotNull(), 0.62).otherwise(0.0).alias("fallback_confidence"),
        named.isNull().alias("needs_review"),
    )


def door_leaves(text) -> Column:
    low = F.lower(F.coalesce(col(text), F.lit("")))
    out = None
    for count, words in LEAF_WORDS.items():
        out = F.when(any_word(low, words), count) if out is None else out.when(any_word(low, words), count)
    return out.otherwise(0)


def door_motion(text) -> Column:
    low = F.lower(F.coalesce(col(text), F.lit("")))
    out = None
    for motion, words in MOTION_WORDS.items():
        out = F.when(any_word(low, words), motion) if out is None else out.when(any_word(low, words), motion)
    return out.when((door_leaves(low) > 0) & any_word(low, ["door", "门"]), "swing").otherwise("")


def requested_leaves(text, width) -> Column:
    """Leaves a door asks for: by its text, else by its width; shutters have none."""
    width, leaves = col(width), door_leaves(text)
    by_width = F.when(width >= 3200, 4).when(width >= 1200, 2).when(width > 0, 1).otherwise(0)
    return F.when(door_motion(text) == "rolling_shutter", 0).when(leaves > 0, leaves).otherwise(by_width)


def material_class(value) -> Column:
    text, out = F.lower(F.trim(F.coalesce(col(value), F.lit("")))), None
    for name, words in MATERIAL_CLASSES:
        out = F.when(any_word(text, words), name) if out is None else out.when(any_word(text, words), name)
    return out.otherwise(col(value))


def expected_material(text, word: str) -> Column:
    """Material class named within 40 characters after a component word."""
    shape = rf"(?i){word}[^。；;\n]{{0,40}}?(混凝土|砼|砖|木|木质|铝合金|铝|钢|玻璃|concrete|brick|masonry|wood|aluminum|aluminium|steel|glass)"
    found = F.regexp_extract(F.coalesce(col(text), F.lit("")), shape, 1)
    return F.when(found == "", "").otherwise(material_class(found))


def materials_match(expected, actual) -> Column:
    left, right = F.lower(material_class(expected)), F.lower(material_class(actual))
    brick = F.contains(left, F.lit("brick")) & (F.contains(right, F.lit("brick")) | F.contains(right, F.lit("masonry")))
    return (left == right) | brick | F.contains(right, left) | F.contains(left, right)


# Words of a failure reason and the advice they lead to, first match wins.
ADVICE = [
    (["json", "schema", "parse", "格式"], "repair_input_format", 1),
    (["level", "标高"], "bind_or_create_level", 2),
    (["host", "宿主", "wall not found", "floor not found"], "reconnect_host", 2),
    (["family", "symbol", "type", "族"], "load_type_or_placeholder", 2),
    (["location", "point", "boundary", "位置", "边界"], "rebuild_location", 2),
    (["approved", "rejected", "审批"], "regenerate_approval", 1),
]


def correction_advice(reason) -> Column:
    """Kind of correction for a failure reason and how many options it offers."""
    low, out = F.lower(F.coalesce(col(reason), F.lit(""))), None
    for words, advice, options in ADVICE:
        result = F.struct(F.lit(advice).alias("advice"), F.lit(options).alias("options"))
        out = F.when(any_word(low, words), result) if out is None else out.when(any_word(low, words), result)
    return out.otherwise(F.struct(F.lit("retry_or_placeholder").alias("advice"), F.lit(2).alias("options")))
