"""Reading of drawing texts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from draftloom.functions.geometry import col, let, strip

# Layer and block name patterns per element class.
LAYER_PATTERNS = {
    "wall": "wall|墙|a[-_]?wall|buildwall",
    "door": "door|门|a[-_]?door",
    "window": "window|窗|win|a[-_]?window",
    "opening": "opening|洞口|留洞|门窗",
    "axis": "axis|grid|轴|轴线|a[-_]?grid|center",
    "column": "column|col|pillar|柱|a[-_]?col|a[-_]?column",
    "void": "hole|void|slab[-_]?opening|floor[-_]?opening|a[-_]?hole|opening|洞口|留洞|楼板洞",
    "parapet": "parapet|女儿墙|女儿|a[-_]?parapet|p[-_]?parapet",
    "slab": r"阳台板|楼板|balcony[\s_-]*slab|floor[\s_-]*slab|slab|deck",
    "slab_excluded": "洞口|opening|void",
    "stair": "stair|楼梯|梯",
    "stair_excluded": "axis|轴|wall|墙|window|窗|door|门|column|柱|图框|frame|title",
    "railing": "railing|handrail|栏杆|扶手|护栏|欄杆",
}

# Patterns of drawing titles.
SIDE_TITLE = r"(?i)((?:东|西|南|北|正|背|左|右)\s*(?:立面图|立面|面图|面))"
AXIS_TITLE = r"(?i)([A-Za-z0-9]+[-~]?[A-Za-z0-9]*\s*(?:立面图|立面|面图|面))"
COMPASS_TITLE = r"(?i)((?:north|south|east|west)[^\n;]{0,24}(?:elevation|facade))"
NAMED_TITLE = r"(?i)(?:图名|图纸名称|drawing\s*(?:title|name))\s*[:：]\s*(.+)"
FLOOR_PLAN_TITLE = (
    r"(?i)\b(?:(?:lower\s+ground|ground|basement|mezzanine|roof|typical|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|\d+(?:st|nd|rd|th)?)\s+)?floor\s+plan\b"
)

# Opening mark prefixes.
DOOR_PREFIXES = ["D", "M", "TLM", "SD", "DD", "DOOR"]
WINDOW_PREFIXES = ["C", "W", "TLC", "PKC", "SW", "CW", "WIN", "WINDOW"]

# Words that tell the type of a drawing.
DRAWING_KEYWORDS = {
    "general_notes": [
        "施工设计总说明", "结构设计总说明", "建筑设计说明", "设计总说明", "总说明", "设计依据", "工程概况", "施工要求",
        "材料", "抗震", "耐火", "防火", "防水", "混凝土", "砌体", "钢筋", "保温", "节能",
        "general notes", "design notes", "construction notes", "specification",
    ],
    "architectural_plan": [
        "建筑平面图", "平面图", "首层", "一层", "二层", "三层", "标准层", "屋顶层", "轴线", "floor plan", "architectural plan",
    ],
    "architectural_elevation": [
        "建筑立面图", "立面图", "正立面", "背立面", "南立面", "北立面", "东立面", "西立面", "左立面", "右立面", "elevation",
    ],
    "architectural_detail": [
        "建筑详图", "详图", "节点详图", "大样图", "墙身大样", "楼梯详图", "门窗详图", "构造详图", "节点", "detail", "details",
    ],
    "architectural_section": ["建筑剖面图", "剖面图", "剖面", "section"],
    "general_assembly": [
        "总装图", "总平面图", "总图", "总装", "总布置", "assembly", "general arrangement", "ga drawing",
    ],
}

# Titles known by name, in order of preference.
KNOWN_TITLES = [
    "施工设计总说明", "结构设计总说明", "建筑设计说明", "建筑平面图", "建筑立面图", "建筑剖面图", "建筑详图", "总平面图",
    "总装图", "墙身大样", "节点详图", "大样图", "平面图", "立面图", "剖面图", "详图", "总说明", "总装", "总布置",
    "general notes", "floor plan", "elevation", "section", "detail", "assembly", "general arrangement",
]

# Words that mark a text as a title.
TITLE_KEYWORDS = [
    "图名", "图纸名称", "工程名称", "建筑平面图", "平面图", "立面图", "详图", "大样图", "剖面图", "总说明", "施工设计总说明",
    "总装图", "总平面图", "总布置", "drawing title", "drawing name", "floor plan", "elevation", "detail", "section",
    "general notes", "assembly",
]

# Words of materials and finishes.
MATERIAL_WORDS = [
    "material", "finish", "fire", "waterproof", "concrete", "steel", "brick", "mortar", "insulation",
    "材料", "做法", "面层", "基层", "防水", "保温", "混凝土", "砌块", "砖", "砂浆", "钢筋", "耐火", "厚",
]

ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]
CHINESE_DIGITS = "一二三四五六七八九"


def _nonempty(value: Column) -> Column:
    return F.when(value != "", value)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL where there is none."""
    return _nonempty(F.regexp_extract(text, pattern, group))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def is_layer(layer, kind: str) -> Column:
    return col(layer).rlike("(?i)(" + LAYER_PATTERNS[kind] + ")")


def layer_classes(layer) -> Column:
    """All classes a layer name belongs to, sorted."""
    found = [F.when(is_layer(layer, kind), kind) for kind in LAYER_PATTERNS if not kind.endswith("_excluded")]
    return F.array_sort(F.array_compact(F.array(*found)))


def opening_kind(text) -> Column:
    return F.when(is_layer(text, "door"), "door").when(is_layer(text, "window"), "window")


def clean_cad_text(text) -> Column:
    """Strip paragraph, font and format codes and braces; collapse white space."""
    text = F.replace(col(text), F.lit("\\P"), F.lit("\n"))
    text = F.regexp_replace(text, r"\\[A-Za-z]+[0-9.+-]*;?", "")
    text = F.regexp_replace(text, r"\|[^;\n]{1,120};", "")
    text = F.translate(text, "{}", "")
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def mark_text(text) -> Column:
    """Upper case, without format codes, words of letters and digits only."""
    text = F.upper(F.coalesce(col(text), F.lit("")))
    text = F.regexp_replace(text, r"\{[^;]*;", "")
    text = F.replace(F.replace(text, F.lit("}"), F.lit("")), F.lit("\\P"), F.lit(" "))
    return F.regexp_replace(text, "[^A-Z0-9]+", " ")


def valid_mark_size(width: Column, height: Column, kind: Column) -> Column:
    return width.between(300, 6000) & F.when(kind == "door", height.between(1500, 3600)).otherwise(height.between(300, 3600))


def opening_marks(text, kind_hint: str | None = None, allow_unprefixed: bool = False) -> Column:
    """All door and window marks such as M0921 in a text: kind, text, width_mm, height_mm, source."""
    names = "|".join(sorted(DOOR_PREFIXES + WINDOW_PREFIXES, key=len, reverse=True))
    clean = mark_text(text)

    def record(source, hinted):
        def build(found):
            code, digits = F.regexp_extract(found, "^[A-Z]+", 0), F.regexp_replace(found, "[^0-9]", "")
            kind = F.when(code.isin(DOOR_PREFIXES), "door").when(code.isin(WINDOW_PREFIXES), "window")
            if hinted:
                kind = F.coalesce(kind, F.lit(kind_hint).cast("string"))
            return F.struct(
                kind.alias("kind"), F.regexp_replace(found, " ", "").alias("text"),
                (F.substring(digits, 1, 2).cast("int") * 100).alias("width_mm"),
                (F.substring(digits, 3, 2).cast("int") * 100).alias("height_mm"), F.lit(source).alias("source"),
            )
        return build

    found = F.transform(_all(clean, rf"(?<![A-Z0-9])(?:{names})\s*\d{{2}}\s*\d{{2}}(?![A-Z0-9])", 0), record("prefixed_mark", True))
    if kind_hint is not None:
        found = F.filter(found, lambda m: m["kind"] == kind_hint)
    if allow_unprefixed:
        bare = F.transform(_all(clean, r"(?<!\d)\d{2}\s*\d{2}(?!\d)", 0), record("unprefixed_mark", True))
        found = F.concat(found, bare)
    return F.filter(found, lambda m: valid_mark_size(m["width_mm"], m["height_mm"], F.coalesce(m["kind"], F.lit(""))))


def first_mark(text, kind_hint: str | None = None, allow_unprefixed: bool = False) -> Column:
    return F.try_element_at(opening_marks(text, kind_hint, allow_unprefixed), F.lit(1))


def first_clause(text) -> Column:
    return strip(F.regexp_extract(strip(col(text)), "^[^\n。；;]*", 0))


def directional_title(text) -> Column:
    """Title of an elevation named by a side, such as a compass word or an axis range."""
    clause = first_clause(text)
    chinese = F.coalesce(_found(clause, SIDE_TITLE), _found(clause, AXIS_TITLE))
    english = _found(clause, COMPASS_TITLE)
    return F.substring(F.coalesce(F.regexp_replace(strip(chinese), r"\s+", ""), F.regexp_replace(strip(english), r"\s+", " ")), 1, 80)


def title_text(text) -> Column:
    """The part of a text that reads as the title of a drawing."""
    text = strip(col(text))
    explicit, plan = _found(text, NAMED_TITLE), _found(first_clause(text), FLOOR_PLAN_TITLE, 0)
    low = F.lower(text)
    known = F.coalesce(*[F.when(F.contains(low, F.lit(t)), t) for t in KNOWN_TITLES])
    return F.coalesce(
        directional_title(text), F.substring(strip(explicit), 1, 80), F.substring(strip(F.regexp_replace(plan, r"\s+", " ")), 1, 80),
        known, F.substring(first_clause(text), 1, 80),
    )


def title_score(text, layer, height, title) -> Column:
    """How much a text looks like the drawing's title; 0 without any sign of one."""
    text, layer, height = strip(col(text)), F.lower(col(layer)), col(height)

    def signs(p):
        title, low = p["title"], p["low"]
        words = [F.when(F.contains(low, F.lit(k)), 6.0 if len(k) >= 4 else 3.0).otherwise(0.0) for k in TITLE_KEYWORDS]
        plus = [
            F.when(layer.rlike("(title|name|图名|图签|标题)"), 4.0).otherwise(0.0),
            F.when(title.rlike(r"(^|\s)[A-Z]?\d+[-~]?[A-Z]?\d*\s*(层|平面图)"), 4.0).otherwise(0.0),
            F.when(text.rlike(r"^\s*(图名|图纸名称)\s*[:：]"), 8.0).otherwise(0.0),
        ]
        minus = (
            F.when(low.rlike(r"^\s*(设计|校对|审核|审定|date|scale|project)\s*[:：]?"), 6.0).otherwise(0.0)
            + F.when(low.rlike(r"(slope|1[:/]\d+|%|耐火等级|材料|标高)"), 8.0).otherwise(0.0)
            + F.when((F.length(title) <= 4) & ~title.rlike("[图说明]"), 3.0).otherwise(0.0)
        )
        return F.struct(
            F.length(title).between(2, 80).alias("usable"), reduce(lambda a, b: a + b, words + plus).alias("signal"), minus.alias("minus")
        )

    def total(s):
        tall = F.when(height >= 200, F.least(F.lit(4.0), height / 150.0)).otherwise(0.0)
        return F.when(s["usable"] & (s["signal"] > 0), s["signal"] + F.coalesce(tall, F.lit(0.0)) - s["minus"]).otherwise(0.0)

    both = let(col(title), lambda x: F.struct(x.alias("title"), F.lower(x).alias("low")))
    return let(let(both, signs), total)


def keyword_score(text, keywords) -> Column:
    """Occurrences of each word, without overlaps, times 3 for words of at least 4 letters."""
    low = F.lower(F.coalesce(col(text), F.lit("")))

    def counted(word):
        weight = 3 if len(word) >= 4 else 1
        return (F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word) * weight

    return F.round(reduce(lambda a, b: a + b, [counted(w.lower()) for w in keywords])).cast("bigint")


def drawing_scores(text) -> Column:
    return F.struct(*[keyword_score(text, words).alias(kind) for kind, words in DRAWING_KEYWORDS.items()])


def drawing_type(scores: Column, geometry_score, characters) -> Column:
    """Type of a drawing from its six word scores, the score of its geometry and the text length."""
    geometry, size = col(geometry_score), col(characters)
    general, plan = scores["general_notes"], scores["architectural_plan"]
    kinds = [k for k in DRAWING_KEYWORDS if k != "general_notes"]
    ranked = F.array_min(F.array(*[F.struct((-scores[k]).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(kinds)]))
    top = -ranked["s"]
    return (
        F.when((general >= 6) & (size >= 40) & (general >= plan), "general_notes")
        .when((size >= 80) & (general >= 3), "general_notes")
        .when((ranked["k"] == "architectural_elevation") & (top >= 2), ranked["k"])
        .when(top >= 3, ranked["k"])
        .when((geometry >= 6) & (geometry >= general), "architectural_plan")
        .when((plan >= 2) & (geometry >= 2), "architectural_plan")
        .otherwise("mixed_or_unknown")
    )


def note_facts(text) -> Column:
    """Design life, seismic class, fire rating, concrete grades and mentions in design notes."""
    text = col(text)
    return F.struct(
        F.coalesce(_found(text, r"(\d+)\s*年设计使用年限"), _found(text, r"设计使用年限[^\d]*(\d+)\s*年")).alias("design_life"),
        F.coalesce(_found(text, r"抗震[^\d]*(\d+)\s*度"), _found(text, r"设防烈度[^\d]*(\d+)\s*度")).alias("seismic_intensity"),
        _found(text, r"耐火等级[^一-龥A-Za-z0-9]*([一-龥A-Za-z0-9]+)").alias("fire_rating"),
        F.array_sort(F.array_distinct(_all(text, r"(?i)C\d{2,3}", 0))).alias("concrete_grades"),
        text.rlike("防水").alias("mentions_waterproofing"),
        text.rlike("保温|节能").alias("mentions_insulation"),
        text.rlike("砌体|砌块|加气混凝土").alias("mentions_masonry"),
    )


def plain_name(value) -> Column:
    return _nonempty(F.regexp_replace(F.coalesce(col(value), F.lit("")), r"(?U)[\s:=,：，]+", ""))


def height_mm(value: Column, unit: Column) -> Column:
    """Metres where the unit says so or, without a unit, where the number is below 20."""
    number, unit = value.try_cast("double"), F.lower(F.coalesce(unit, F.lit("")))
    return F.when(unit.isin("m", "米"), number * 1000).when(unit == "mm", number).when(number < 20, number * 1000).otherwise(number)


def floor_heights(text) -> Column:
    """Floor heights named in a text: floor, height_mm, confidence."""
    text = strip(col(text))
    name, number = r"[一-龥A-Za-z0-9#\-~]+?层", r"(\d+(?:\.\d+)?)"
    shapes = [
        (rf"(?i)({name})?[^\n。；;]{{0,8}}?层高\s*[:：=]?\s*{number}\s*(mm|m|米)?", 1, 2, 3),
        (rf"(?i)({name})[^\n。；;]{{0,8}}?{number}\s*(mm|m|米)", 1, 2, 3),
        (rf"(?i)(?:floor|storey)\s*height\s*[:=]?\s*{number}\s*(mm|m)?", None, 1, 2),
    ]
    bonus = F.when(text.rlike(r"(?i)层高|floor\s*height|storey\s*height"), 0.12).otherwise(0.0)

    def read(shape):
        pattern, floor, value, unit = shape
        values = _all(text, pattern, value)
        floors = _all(text, pattern, floor) if floor else F.transform(values, lambda v: F.lit(""))
        rows = F.arrays_zip(floors.alias("f"), values.alias("v"), _all(text, pattern, unit).alias("u"))
        return F.transform(rows, lambda r: F.struct(
            plain_name(r["f"]).alias("floor"), F.round(height_mm(r["v"], r["u"]), 3).alias("height_mm"),
            F.round(F.least(F.lit(0.95), F.when(plain_name(r["f"]).isNotNull(), 0.82).otherwise(0.62) + bonus), 3).alias("confidence"),
        ))

    return F.concat(*[read(s) for s in shapes])


def plain_signs(text) -> Column:
    text = F.translate(col(text), "＋﹢－−", "++--")
    return F.replace(text, F.lit("+/-"), F.lit("±"))


ELEVATION_CONTEXT = r"(?i)标高|层|屋面|地坪|女儿墙|EL\.?|LEVEL|ELEV"


def elevation_mm(value: Column) -> Column:
    number = F.regexp_replace(F.replace(plain_signs(value), F.lit(" "), F.lit("")), "^±", "").try_cast("double")
    return F.when(F.abs(number) < 100, number * 1000).otherwise(number)


def level_label(text: Column, value: Column) -> Column:
    """Level word standing last before a number; the first pattern that occurs decides."""
    before = F.call_function("substring_index", plain_signs(text), strip(value), F.lit(1))
    patterns = [
        r"(?i)(地下?[一-龥\d]+?层)", r"(?i)([一-龥\d#]+?层)", "(屋面)", "(女儿墙)", "(室外地坪|室内地坪|地坪)",
        r"(?i)((?:roof|level|floor)\s*[A-Za-z0-9#\-]+)",
    ]
    return F.coalesce(*[F.try_element_at(_all(before, p, 1), F.lit(-1)) for p in patterns])


def elevation_marks(text, drawing_type=None) -> Column:
    """Elevation marks in a text: label, elevation_mm, confidence."""
    raw = strip(col(text))
    text = plain_signs(raw)
    kind = F.lit(None).cast("string") if drawing_type is None else col(drawing_type)
    pattern = (
        r"(?i)([一-龥A-Za-z0-9#\-~]{0,16}?(?:层|屋面|地坪|女儿墙|roof|level|floor|el)?)"
        r"\s*(?:标高|EL\.?|LEVEL)?\s*[:：=]?\s*([+\-±]?\s*\d{1,5}(?:\.\d{1,4})?)"
    )
    context = text.rlike(ELEVATION_CONTEXT)
    alone = strip(F.regexp_replace(strip(text), r"^\|[^;\n]{1,120};", ""))
    rows = F.arrays_zip(_all(text, pattern, 1).alias("l"), _all(text, pattern, 2).alias("v"))

    def accepted(r):
        value = F.replace(r["v"], F.lit(" "), F.lit(""))
        standalone = (alone == value) & value.rlike(r"^\d{1,2}\.\d{3,4}$") & (F.abs(value.try_cast("double")) <= 30)
        return (
            value.rlike(r"^[+\-±]") | (context & value.rlike(r"\d+\.\d{2,4}"))
            | (F.coalesce(kind, F.lit("")).isin("architectural_elevation", "architectural_section") & F.coalesce(standalone, F.lit(False)))
        )

    def record(r):
        def scored(label):
            score = 0.68 + F.when(context, 0.14).otherwise(0.0) + F.when(label.isNotNull(), 0.08).otherwise(0.0)
            return F.struct(
                plain_name(label).alias("label"), F.round(elevation_mm(r["v"]), 3).alias("elevation_mm"),
                F.round(F.least(F.lit(0.95), score), 3).alias("confidence"),
            )

        return let(F.coalesce(_nonempty(r["l"]), level_label(raw, r["v"])), scored)

    return F.filter(F.transform(F.filter(rows, accepted), record), lambda m: m["elevation_mm"].isNotNull())


def face_label(text) -> Column:
    """Name of the face a text speaks of, such as a compass side or 'A面'."""
    text = strip(col(text))
    named = _found(
        F.concat(F.lit(" "), text, F.lit(" ")),
        r"(?i)(?:^|[\s\-_:：])((?:[A-Za-z0-9]+|[一-龥]{1,4})\s*(?:面|立面|facade|elevation))(?:$|[\s\-_:：])",
    )
    letter = F.when(text.rlike(r"(?i)^[A-Za-z0-9]\s*面$"), text)
    return F.coalesce(_found(text, "((?:东|西|南|北|正|背|左|右).{0,4}立面)"), F.regexp_replace(F.coalesce(named, letter), r"\s+", ""))


def facade_side(text) -> Column:
    low = F.lower(col(text))
    return (
        F.when(low.rlike("南|south"), "south").when(low.rlike("北|north"), "north")
        .when(low.rlike("东|east"), "east").when(low.rlike("西|west"), "west")
    )


def chinese_number(value) -> Column:
    """Digits, or Chinese numerals up to 99."""
    def digit(part):
        return F.when(F.length(part) == 1, F.instr(F.lit(CHINESE_DIGITS), part)).otherwise(0)

    def read(text):
        left, right = F.substring_index(text, "十", 1), F.substring_index(text, "十", -1)
        return (
            F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
            .when(text == "十", 10)
            .when(text.startswith("十"), 10 + digit(F.substring(text, 2, 20)))
            .when(F.contains(text, F.lit("十")), digit(left) * 10 + digit(right))
            .when(digit(text) > 0, digit(text))
        ).cast("int")

    return let(strip(F.coalesce(col(value), F.lit(""))), read)


def level_from_title(title, british: Column | bool = False) -> Column:
    """Storey of a plan from its title: key, name, number, confidence. NULL where none is named."""
    british = british if isinstance(british, Column) else F.lit(british)
    shape = r"(?i)([一二三四五六七八九十\d]+)\s*层|([2-9]\d*)F|F([2-9]\d*)"
    names = F.array(*map(F.lit, list(CHINESE_DIGITS) + ["十"]))

    def parts(text):
        word = F.lower(_found(text, rf"(?i)\b({'|'.join(ORDINALS)})\s+floor\b"))
        below = F.coalesce(_found(text, r"(?i)地下\s*([一二三四五六七八九十\d]+)\s*层"), _found(text, r"(?i)B\s*(\d+)"))
        return F.struct(
            text.alias("text"),
            (F.array_position(F.array(*map(F.lit, ORDINALS)), word).cast("int") + F.when(british, 1).otherwise(0)).alias("ordinal"),
            chinese_number(below).alias("below"),
            chinese_number(F.coalesce(_found(text, shape, 1), _found(text, shape, 2), _found(text, shape, 3))).alias("number"),
        )

    def level(key, name, value, confidence):
        return F.struct(
            key.alias("key"), name.alias("name"), value.cast("int").alias("number"), F.round(confidence, 3).alias("confidence")
        )

    def decide(p):
        text, ordinal, below, number = p["text"], p["ordinal"], p["below"], p["number"]
        shown = F.when(number.between(1, 10), F.try_element_at(names, number)).otherwise(number.cast("string"))
        return (
            F.when(text.rlike(r"(?i)\bground\s+floor\b"), level(F.lit("L1"), F.lit("一层"), F.lit(1), F.lit(0.94)))
            .when(ordinal.isNotNull(), level(F.concat(F.lit("L"), ordinal), F.concat(F.lit("Level "), ordinal), ordinal, F.when(british, 0.94).otherwise(0.78)))
            .when(text.rlike("(?i)屋顶|屋面|roof"), level(F.lit("roof"), F.lit("屋顶层"), F.lit(None), F.lit(0.86)))
            .when(below.isNotNull(), level(F.concat(F.lit("B"), below), F.concat(F.lit("地下"), below, F.lit("层")), -below, F.lit(0.88)))
            .when(text.rlike(r"(?i)首层|一层|1\s*层|1F|F1"), level(F.lit("L1"), F.lit("一层"), F.lit(1), F.lit(0.9)))
            .when(number.isNotNull(), level(F.concat(F.lit("L"), number), F.concat(shown, F.lit("层")), number, F.lit(0.88)))
            .when(text.rlike(r"(?i)标准层|standard\s*floor|typical\s*floor"), level(F.lit("typical"), F.lit("标准层"), F.lit(None), F.lit(0.76)))
        )

    return let(let(F.translate(F.coalesce(col(title), F.lit("")), "－_", "- "), parts), decide)


def floor_number(text) -> Column:
    shape = r"(?i)([一二三四五六七八九十\d]+)\s*层|L\s*(\d+)|F\s*(\d+)"
    text = F.coalesce(col(text), F.lit(""))
    return chinese_number(F.coalesce(_found(text, shape, 1), _found(text, shape, 2), _found(text, shape, 3)))


def explicit_floor_number(text) -> Column:
    """Floor number a drawing or level name states; English ordinals count from the ground floor."""
    low = F.lower(strip(F.coalesce(col(text), F.lit(""))))
    word = _found(low, rf"\b({'|'.join(ORDINALS)})\s+floor\b")
    digits = [r"(?<![a-z0-9])(\d{1,2})\s*(?:层|楼)", r"(?<![a-z0-9])(\d{1,2})\s*f(?![a-z0-9])", r"(?:level|floor)\s*(\d{1,2})(?!\d)"]
    return F.coalesce(
        F.when(low.rlike("首层|首楼|ground floor"), 1),
        F.array_position(F.array(*map(F.lit, ORDINALS)), word).cast("int") + 1,
        chinese_number(_found(low, r"([一二三四五六七八九十])\s*(?:层|楼)")),
        *[_found(low, p).try_cast("int") for p in digits],
    )


def stair_facts(text) -> Column:
    """Step count, tread, riser, total rise and level range in stair texts."""
    text = F.coalesce(col(text), F.lit(""))
    number, mid = r"(\d+(?:\.\d+)?)", r"\s*[:：=]?\s*"
    both = rf"(?i)(?:踏步|踏面|踢面|tread|riser|step){mid}{number}\s*[xX×*]\s*{number}"
    a, b = _found(text, both, 1).try_cast("double"), _found(text, both, 2).try_cast("double")
    tread = _found(text, rf"(?i)(?:踏步宽|踏面宽|踏面|tread){mid}{number}").try_cast("double")
    riser = _found(text, rf"(?i)(?:踏步高|踢面高|踢面|riser){mid}{number}").try_cast("double")
    rise_shape = rf"(?i)(?:层高|总高|floor\s*height|storey\s*height|rise){mid}{number}\s*(mm|m|米)?"
    rise, unit = _found(text, rise_shape, 1).try_cast("double"), F.lower(F.coalesce(_found(text, rise_shape, 2), F.lit("mm")))
    levels = r"([一二三四五六七八九十\d]+层?)\s*[-~至到]\s*([一二三四五六七八九十\d]+层?)"
    return F.struct(
        _found(text, r"(?i)(\d+)\s*(?:级|步|踏|steps?|risers?)").try_cast("int").alias("step_count"),
        F.when(a.isNotNull(), F.greatest(a, b)).otherwise(tread).alias("tread_mm"),
        F.when(a.isNotNull(), F.least(a, b)).otherwise(riser).alias("riser_mm"),
        F.when(unit.isin("m", "米") | (rise < 20), rise * 1000).otherwise(rise).alias("total_rise_mm"),
        _found(text, levels, 1).alias("start_level"), _found(text, levels, 2).alias("end_level"),
    )


def railing_height(text) -> Column:
    shape = r"(?i)(?:栏杆|扶手|护栏)?\s*(?:高|高度|height|h)\s*[:：]?\s*(\d+(?:\.\d+)?)\s*(mm|m|米)?"
    text = F.coalesce(col(text), F.lit(""))
    value, unit = _found(text, shape, 1).try_cast("double"), F.lower(F.coalesce(_found(text, shape, 2), F.lit("mm")))
    size = F.when(unit.isin("m", "米") | (value < 20), value * 1000).otherwise(value)
    return F.when(size.between(600, 1600), size)


def parapet_height(text) -> Column:
    plain = F.translate(F.coalesce(col(text), F.lit("")), "：＝，", ":=,")
    word, high, number = "(?:女儿墙|parapet)", "(?:高度|高|H|h|height)", r"(\d+(?:\.\d+)?)"
    shapes = [
        rf"(?i){word}[^\d+\-]{{0,12}}{high}\s*[:=]?\s*{number}\s*(mm|m|米)?",
        rf"(?i){high}\s*[:=]?\s*{number}\s*(mm|m|米)?[^\d+\-]{{0,12}}{word}",
    ]

    def read(shape):
        found = F.struct(
            _found(plain, shape, 1).try_cast("double").alias("v"), F.lower(F.coalesce(_found(plain, shape, 2), F.lit(""))).alias("u")
        )

        def size(f):
            metres = f["u"].isin("m", "米") | (f["v"].between(0.2, 3.0) & (f["u"] != "mm"))
            return F.when(metres, f["v"] * 1000).otherwise(f["v"])

        return let(let(found, size), lambda s: F.when(s.between(250, 1800), F.round(s, 3)))

    return F.when(plain.rlike("(?i)女儿墙|parapet"), F.coalesce(*[read(s) for s in shapes]))


def one_line(text) -> Column:
    return strip(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", " "))


def is_dimension_text(text) -> Column:
    text = one_line(text)
    return (text == "") | text.rlike(r"(?i)^[0-9.,+\-*/ xX×~～=()（）]+(?:mm|m|米)?$")


def is_material_text(text) -> Column:
    return F.lower(one_line(text)).rlike("|".join(MATERIAL_WORDS))


def safe_name(name, fallback) -> Column:
    """Grid names without control codes and characters the modelling host forbids."""
    clean = F.regexp_replace(F.coalesce(col(name), F.lit("")), r"\\[A-Za-z0-9]+", "")
    clean = strip(F.regexp_replace(F.regexp_replace(clean, r"[\\:{}\[\]|;<>?`~]", ""), r"\s+", " "))
    return F.when(clean == "", col(fallback)).otherwise(clean)
