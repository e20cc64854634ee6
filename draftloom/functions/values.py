"""Reading of loosely typed values: numbers, flags, lists, points, confidences, JSON in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from draftloom.functions.geometry import col, let, strip

NUMBER = r"[-+]?\d+(?:\.\d+)?"

# Confidence words.
CONFIDENCE_WORDS = {"high": 0.9, "medium": 0.7, "moderate": 0.7, "low": 0.4}

# Keys of material objects and of confidence objects, in order of preference.
MATERIAL_KEYS = ["material_name", "material", "name", "label", "material_id"]
CONFIDENCE_KEYS = ["value", "confidence", "score", "level"]


def pick(*candidates) -> Column:
    """First candidate that is neither NULL nor empty."""
    return F.coalesce(*[F.when(F.trim(col(c)) != "", col(c)) for c in candidates])


def pick_column(df, *names, default=None) -> Column:
    """:func:`pick` over those of the named columns that the table has."""
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    value = pick(*have) if have else F.lit(None).cast("string")
    return value if default is None else F.coalesce(value, F.lit(default))


def to_number(value) -> Column:
    """First number in a text; thousands commas are ignored."""
    plain = F.replace(col(value).cast("string"), F.lit(","), F.lit(""))
    return F.regexp_extract(F.coalesce(plain, F.lit("")), NUMBER, 0).try_cast("double")


def to_flag(value) -> Column:
    text = F.lower(F.trim(col(value).cast("string")))
    return F.when(text.isin("true", "1", "yes", "y"), True).when(text.isin("false", "0", "no", "n"), False)


def id_list(value) -> Column:
    parts = F.transform(F.split(F.coalesce(col(value), F.lit("")), r"[,;|]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def parse_point(value, z: float = 0.0) -> Column:
    """Two or three numbers in a text as a point."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(col(value), F.lit("")), F.lit(f"({NUMBER})"), F.lit(1)), lambda n: n.try_cast("double"))
    return F.when(F.size(numbers) >= 2, F.struct(
        F.element_at(numbers, 1).alias("x"), F.try_element_at(numbers, F.lit(2)).alias("y"),
        F.coalesce(F.try_element_at(numbers, F.lit(3)), F.lit(z)).alias("z"),
    ))


def parse_boundary(value) -> Column:
    """Corner lists such as ``[[0, 0], [1, 0]]`` or ``(0, 0), (1, 0)``."""
    text = F.coalesce(col(value), F.lit(""))
    nested = F.regexp_extract_all(text, F.lit(r"[\[(]\s*([-+0-9.eE]+(?:\s*,\s*[-+0-9.eE]+)+)\s*[\])]"), F.lit(1))
    return F.filter(F.transform(nested, lambda t: parse_point(t)), lambda p: p.isNotNull())


def clamp(value: Column) -> Column:
    # greatest and least skip NULL, so it has to be kept by hand.
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def row_confidence(value, default: float) -> Column:
    return F.coalesce(clamp(to_number(value)), F.lit(default))


def review_status(needs_review, status, default) -> Column:
    """Review state from a flag or, failing that, a status word."""
    flag, default = to_flag(needs_review), col(default) if isinstance(default, Column) else F.lit(default)
    word = F.lower(F.trim(col(status)))
    return (
        F.when(flag, "needs_review")
        .when(~flag, F.when(default == "needs_review", default).otherwise("ready"))
        .when(word == "confirmed", "confirmed")
        .when(word.isin("ok", "ready", "true", "yes"), "ready")
        .when(word.isin("needs_review", "review", "false", "no", "pending"), "needs_review")
        .otherwise(default)
    )


def _scaled(number: Column) -> Column:
    return clamp(F.when((number > 1) & (number <= 100), number / 100.0).otherwise(number))


def _plain_confidence(text: Column) -> Column:
    low = F.lower(F.trim(text))
    out = F.when(low == "true", 1.0).when(low == "false", 0.0)
    for word, value in CONFIDENCE_WORDS.items():
        out = out.when(low == word, value)
    percent = F.trim(F.regexp_extract(low, r"^(.*)%$", 1)).try_cast("double") / 100.0
    return out.when(low.endswith("%"), _scaled(percent)).otherwise(_scaled(low.try_cast("double")))


def confidence(value) -> Column:
    """Confidence written as a number, flag, word, percentage or an object holding one of these."""
    text = F.trim(col(value).cast("string"))

    def inside(value):
        inner = F.coalesce(*[F.get_json_object(value, f"$.{k}") for k in CONFIDENCE_KEYS])
        return F.when(value.startswith("{"), inner).otherwise(F.regexp_replace(value, '^"|"$', ""))

    return let(let(let(text, inside), inside), _plain_confidence)


def _material_of(item: Column) -> Column:
    item = F.trim(item)

    def one(text):
        return F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in MATERIAL_KEYS])

    named = let(one(item), lambda inner: F.when(inner.startswith("{"), one(inner)).otherwise(inner))
    return F.when(item.startswith("{"), named).when(item.startswith("["), F.lit(None)).otherwise(F.regexp_replace(item, '^"|"$', ""))


def material_names(value) -> Column:
    """Material names from a JSON text, object or list; equal names but for case appear once."""
    text = F.trim(F.coalesce(col(value), F.lit("")))
    items = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    names = F.filter(F.transform(items, lambda i: F.trim(_material_of(i))), lambda n: n.isNotNull() & (n != ""))

    def add(seen, name):
        known = F.exists(seen, lambda s: F.lower(s) == F.lower(name))
        return F.when(known, seen).otherwise(F.concat(seen, F.array(name)))

    return F.aggregate(names, F.array().cast("array<string>"), add)


def balanced_object(text) -> Column:
    """From the first opening brace to the one that closes it, at any depth; braces in strings do not count. NULL if none does."""
    tail = F.regexp_extract(col(text), r"(?s)(\{.*)", 1)
    # Strings, braces and what lies between them, which together are the text; a quote that no other one closes stands alone.
    pieces = F.regexp_extract_all(tail, F.lit(r'(?s)("(?:[^"\\]++|\\.)*+"|[{}]|[^"{}]++|")'), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s, piece):
        depth = s["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        at = s["at"] + F.length(piece)
        end = F.when(s["end"] != 0, s["end"]).when(piece == '"', -1).when((piece == "}") & (depth == 0), at).otherwise(0)
        return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

    end = F.aggregate(pieces, start, step)["end"]
    return F.when(end > 0, F.substring(tail, F.lit(1), end))


def json_object(text) -> Column:
    """First JSON object in a text that may wrap it in prose or code fences; NULL if none parses."""
    text = strip(F.coalesce(col(text), F.lit("")))
    fenced = strip(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1))

    def valid(t):
        return F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t)

    def whole(t):
        # The parser is content with a beginning that parses.
        return F.when(balanced_object(t) == t, valid(t))

    return F.coalesce(whole(text), whole(fenced), valid(balanced_object(text)))


def key_values(pairs: dict) -> Column:
    """``a=1; b=2`` over the values that are present."""
    parts = [F.when(F.trim(col(v).cast("string")) != "", F.concat(F.lit(f"{k}="), col(v).cast("string"))) for k, v in pairs.items()]
    return F.concat_ws("; ", *parts)


def plain_number(value) -> Column:
    """Number text without a trailing ``.0``."""
    text = col(value).cast("double").cast("string")
    return F.regexp_replace(text, r"\.0$", "")


def smart_text(value) -> Column:
    """Trimmed text; whole numbers lose their decimals, empties become NULL."""
    text = F.trim(col(value).cast("string"))
    number = text.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(text == "", F.lit(None)).when(whole, F.floor(number).cast("bigint").cast("string")).otherwise(text)


def padded(number: Column, width: int) -> Column:
    """A number as text with leading zeros; numbers with more digits keep all of them (``lpad`` alone would cut them)."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
