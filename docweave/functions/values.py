"""Value functions as column expressions: quantities, units, dates, references, terminals, quality scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import clean_cell, text_or_empty

# ---------------------------------------------------------------- quantities

#: Pattern, unit stated for it (None: as written), in the order they are tried.
QUANTITIES = (
    (r"(?i)(\d+[.,]?\d*)\s*(mm²|mm2|mm\^2|mm)", "mm²"),
    (r"(?i)(\d+[.,]?\d*)\s*(k?A|Ampere|Amp|A)\b", None),
    (r"(?i)(\d+[.,]?\d*)\s*(k?V|Volt|V)\b", None),
    (r"(?i)(\d+[.,]?\d*)\s*(k?W|Watt|W)\b", None),
    (r"(?i)(\d+[.,]?\d*)\s*(k?Hz|Hertz)\b", None),
    (r"(?i)(\d+[.,]?\d*)\s*(k?VA)\b", None),
    (r"(?i)(\d+[.,]?\d*)\s*(°C|Celsius|°F|Fahrenheit|K|Kelvin)\b", None),
    (r"(?i)(\d+[.,]?\d*)\s*(bar|mbar|Pa|kPa|MPa)\b", None),
    (r"(\d+[.,]?\d*)\s*(l|L|ml|mL|m³|m3)\b", None),
    (r"(\d+[.,]?\d*)\s*(kg|g|mg|t)\b", None),
    (r"(\d+[.,]?\d*)\s*(m|cm|mm|km)\b(?!²|2|\^)", None),
    (r"(\d+[.,]?\d*)\s*(min|s|h|sec)\b", None),
    (r"(\d+[.,]?\d*)\s*(%)\b", "%"),
)
#: Unit words and their signs.
UNIT_WORDS = {
    "volt": "V", "volts": "V", "ampere": "A", "amp": "A", "amps": "A", "watt": "W", "watts": "W", "hertz": "Hz",
    "celsius": "°C", "fahrenheit": "°F", "kelvin": "K",
}
_QUALIFIERS = (r"(?i)\b(DC|AC|3~|3-phase|1~|1-phase)\b", r"(?i)\b(\d+)\s*Ph(?:ase)?\b")


def number_text(text: Column) -> Column:
    """A decimal number without trailing zeros; a whole number without a point."""
    plain = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"^0+(?=\d)", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def parse_quantity(column: Column | str) -> Column:
    """struct(value, unit, qualifier), empty strings where a part is missing; the first pattern that occurs decides."""
    text = F.trim(text_or_empty(column))
    words = F.create_map(*[F.lit(x) for pair in UNIT_WORDS.items() for x in pair])
    value, unit = F.lit(""), F.lit("")
    for pattern, standard in reversed(QUANTITIES):
        # the sign of per cent is no word character, so a word boundary must follow it
        hit = text.rlike(pattern)
        found = F.regexp_extract(text, pattern, 2)
        named = F.lit(standard) if standard else F.coalesce(F.try_element_at(words, F.lower(found)), found)
        value = F.when(hit, number_text(F.regexp_extract(text, pattern, 1))).otherwise(value)
        unit = F.when(hit, named).otherwise(unit)
    qualifier = F.when(text.rlike(_QUALIFIERS[0]), F.regexp_extract(text, _QUALIFIERS[0], 0)).otherwise(
        F.regexp_extract(text, _QUALIFIERS[1], 0)
    )
    return F.struct(value.alias("value"), unit.alias("unit"), qualifier.alias("qualifier"))


#: Units of data sheets.
UNITS = (
    "kg/m³", "kg/m3", "g/cm³", "g/cm3", "kg/cm²", "g/ml", "mg/l", "kVA", "MVA", "kVAR", "MVAR", "kPa", "MPa", "GPa", "hPa", "mbar", "μbar", "µbar",
    "m³/h", "m³/s", "l/min", "l/s", "ml/min", "kg/h", "kg/s", "t/h", "g/min", "Nm", "kNm", "MNm", "rpm", "rps", "rad/s", "deg/s", "Hz", "kHz", "MHz",
    "GHz", "mA", "μA", "µA", "nA", "kA", "MV", "kV", "mV", "μV", "µV", "kW", "MW", "GW", "mW", "μW", "µW", "kΩ", "MΩ", "mΩ", "μΩ", "µΩ", "kΩ", "MΩ",
    "mΩ", "km", "dm", "cm", "mm", "μm", "µm", "nm", "mil", "kg", "mg", "μg", "µg", "t", "g", "lb", "oz", "m³", "cm³", "mm³", "l", "ml", "hl", "bar",
    "psi", "ksi", "Pa", "°C", "°F", "°R", "s", "ms", "μs", "µs", "ns", "min", "h", "d", "V", "A", "W", "Ω", "Ω", "F", "H", "S", "T", "J", "N", "C",
    "K", "VA", "var", "Wh", "Ah", "dB", "dBm", "dBA", "ppm", "ppb", "%", "‰", "bps", "baud", "inch", "ft", "yd", "m", "USD", "EUR", "CHF", "GBP",
    "DC", "AC",
)
_UNIT = "(?:" + "|".join(re.escape(u) for u in sorted(UNITS, key=lambda u: (-len(u), u))) + ")"


def split_value_unit(column: Column | str) -> Column:
    """struct(value, unit): the longest known unit at the end, in brackets, or before a bracketed remark.

    Without a unit the value is the text without trailing separators.
    """
    raw = F.trim(text_or_empty(column))
    inner = F.trim(F.regexp_extract(raw, r"(?s)\A\[(.+)\]\z", 1))
    bare = F.trim(F.regexp_replace(raw, r"[/,.;:–—\s]+\z", ""))
    rules = [
        (inner, rf"\A({_UNIT})\z", None, 1),
        (inner, rf"\A({_UNIT})[ /]", None, 1),
        (inner, rf"(?s)\A(.*) ({_UNIT})\z", 1, 2),
        # a unit, or two of them, before the first bracket
        (bare, rf"(?s)\A([^(]*?\S) ({_UNIT} {_UNIT})\.? ?\(", 1, 2),
        (bare, rf"(?s)\A([^(]*?\S) ({_UNIT})\.? ?\(", 1, 2),
        (bare, rf"(?s)\A(.*\S) +({_UNIT})\z", 1, 2),
        (bare, rf"(?s)\A(.*\S) *[(\[]({_UNIT})[)\]]\z", 1, 2),
        (bare, rf"(?s)\A(.*?\S) *\((?:[^()]* )?({_UNIT})\)\z", 1, 2),
    ]
    value, unit = bare, F.lit("")
    for text, pattern, v, u in reversed(rules):
        hit = text.rlike(pattern)
        value = F.when(hit, F.trim(F.regexp_extract(text, pattern, v)) if v else F.lit("")).otherwise(value)
        unit = F.when(hit, F.regexp_extract(text, pattern, u)).otherwise(unit)
    return F.struct(value.alias("value"), unit.alias("unit"))


# ---------------------------------------------------------------- placeholders and dates

#: Texts that stand for nothing, whole or as a part.
PLACEHOLDERS = ("none", "n/a", "-", "na", "nil", "null", "not specified")
PHRASES = (
    "not explicitly stated", "not explicitly mentioned", "not explicitly provided", "not mentioned in the",
    "not specified in the", "not specified", "no information provided", "could not be determined", "not available from",
    "visit product website", "see page", "not explicitly stated in the provided text",
)


def sanitize_text(column: Column | str) -> Column:
    """Without control and private-use characters; placeholders and empty phrases become empty."""
    text = F.regexp_replace(text_or_empty(column), r"[\x00-\x08\x0B\x0C\x0E-\x1F]|\p{Co}", "")
    bare = F.trim(F.regexp_replace(text, r"\A(?U)\s+|(?U)\s+\z", ""))
    lower = F.lower(bare)
    empty = lower.isin(*PLACEHOLDERS) | lower.rlike("|".join(re.escape(p) for p in PHRASES))
    return F.when(empty, "").otherwise(bare)


def repair_date(column: Column | str) -> Column:
    """Scanner confusions in a date undone; three numbers between slashes become day.month.year."""
    text = text_or_empty(column)
    bare = F.regexp_replace(F.trim(text), r"\A[^0-9a-zA-Z]+", "")
    slashes = r"\A\s*(\d+)\s*/\s*(\d+)\s*/\s*(\d+)\s*\z"
    first, second, year = (F.regexp_extract(bare, slashes, i) for i in (1, 2, 3))
    a, b = first.try_cast("bigint"), second.try_cast("bigint")
    pad = lambda x: F.when(F.length(x.cast("string")) < 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    dotted = F.when(b > 12, F.concat_ws(".", pad(b), pad(a), year)).otherwise(F.concat_ws(".", pad(a), pad(b), year))
    dated = F.when(bare.rlike(slashes), dotted).otherwise(bare)
    fixed = F.trim(F.translate(dated, "gGlLoOsS", "99110055"))
    return F.when(text.rlike(r"\d") & text.rlike("[./]"), fixed).otherwise(text)


# ---------------------------------------------------------------- references and terminals


def iec_aspect(column: Column | str) -> Column:
    """Aspect of a reference designation: by its first character, and by the signs it contains."""
    token = F.trim(text_or_empty(column))
    head, place, product = F.substring(token, 1, 1), F.contains(token, F.lit("+")), F.contains(token, F.lit("-"))
    name = lambda x: F.lit(f"Referenzkennzeichnung ({x})")
    return (
        F.when((head == "=") & (place | product), name("Orts+Produktaspekt"))
        .when(head == "=", name("Funktionsaspekt"))
        .when((head == "+") & product, name("Orts+Produktaspekt"))
        .when(head == "+", name("Ortsaspekt"))
        .when(head == "-", name("Produktaspekt"))
        .when(place & product, name("Orts+Produktaspekt"))
        .when(place, name("Ortsaspekt"))
        .otherwise(name("Produktaspekt"))
    )


def standalone_token(column: Column | str) -> Column:
    """struct(name, class, source) of a token alone on a line, by its shape; ``Bemerkung`` if it has none."""
    token = F.trim(text_or_empty(column))
    make = lambda a, b, c: F.struct(
        (F.lit(a) if isinstance(a, str) else a).alias("name"), F.lit(b).alias("class"), F.lit(c).alias("source")
    )
    return (
        F.when(token == "", make("Bemerkung", "Herstellerspezifisch", "Unklar"))
        .when(F.substring(token, 1, 1).isin("=", "+", "-"), make(iec_aspect(token), "IEC 81346-1", "Normativ"))
        .when(token.rlike(r"(?i)\AE[WX]?\d+(?:\.\d+)?\z"), make("Eingangskennzeichen", "DIN 19227-2", "Normativ"))
        .when(token.rlike(r"(?i)\AA[WX]?\d+(?:\.\d+)?\z"), make("Ausgangskennzeichen", "DIN 19227-2", "Normativ"))
        .when(token.rlike(r"\A\d{1,3}\z"), make("Anschlussbezeichnung", "DIN 19227-2", "Normativ"))
        .when(token.rlike(r"(?U)\A[\w°]+/\w+[²³]?\z"), make("Messgröße", "DIN 19227-2", "Normativ"))
        .when(token.rlike(r"\A[A-Z]{2,3}\z"), make(token, "CAE-systemspezifisch (COMOS)", "Unklar"))
        .otherwise(make("Bemerkung", "Herstellerspezifisch", "Unklar"))
    )


def terminal_designator(column: Column | str) -> Column:
    """struct(name, attribute, value) of a terminal cell; a null name if the cell is none.

    Numbers, numbers with a continuation, number and phase, channels, letter and number; other texts of at most twelve
    characters count as they are, unless they begin like a heading.
    """
    text = clean_cell(column)
    none = F.lit("")
    make = lambda n, a=none, v=none: F.struct(n.alias("name"), a.alias("attribute"), v.alias("value"))
    get = lambda p, i=1: F.regexp_extract(text, p, i)
    phase, channel, letter = r"\A(\d+)\s*/\s*([A-Z][A-Z0-9]*)\z", r"(?i)\AKanal\s+(\d+)\z", r"\A([A-Z]\d+[A-Za-z]?)\z"
    more = r"\A:\s*(\d+)\z"
    return (
        F.when(text.rlike(r"\A\d+\z"), make(text))
        .when(text.rlike(more), make(get(more)))
        .when(text.rlike(phase), make(F.concat_ws("/", get(phase), get(phase, 2)), F.lit("Phase"), get(phase, 2)))
        .when(text.rlike(channel), make(F.concat(F.lit("Kanal "), get(channel)), F.lit("Funktionsklasse"), F.lit("SPS-Kanal")))
        .when(text.rlike(letter), make(get(letter), F.lit("Klemmentyp"), F.lit("Steuerklemme")))
        .when((text != "") & (F.length(text) <= 12) & ~F.lower(text).rlike(r"\A(verschaltung|klemm|plt)"), make(text))
        .otherwise(make(F.lit(None).cast("string")))
    )


def canonical_designation(column: Column | str) -> Column:
    """A designation without spaces in upper case; a letter and digit at its beginning get a product sign."""
    text = F.upper(F.regexp_replace(text_or_empty(column), r"(?U)\s+", ""))
    return F.when(text.rlike(r"\A[A-Z]\d"), F.concat(F.lit("-"), text)).otherwise(text)


def designation_keys(column: Column | str) -> Column:
    """Spellings under which a designation is looked up: as it is, without dots, without underscores, without sign."""
    text = canonical_designation(column)
    forms = F.array_distinct(F.array(text, F.replace(text, F.lit("."), F.lit("")), F.replace(text, F.lit("_"), F.lit(""))))
    bare = F.transform(F.filter(forms, lambda x: x.startswith("-")), lambda x: F.substring(x, 2, 1_000_000))
    return F.filter(F.array_distinct(F.transform(F.concat(forms, bare), lambda x: F.lower(F.trim(x)))), lambda x: x != "")


def designation_base(column: Column | str) -> Column:
    """A designation without product sign and terminal."""
    return F.regexp_replace(F.regexp_replace(F.lower(canonical_designation(column)), r"\A-", ""), r"[:/].*\z", "")


def polarity(column: Column | str) -> Column:
    """The polarity code a text names most often, the first of equals; empty without one."""
    text = F.upper(text_or_empty(column))
    codes = F.regexp_extract_all(text, F.lit(r"\b(L1|L2|L3|L\+|L-|N|PE|PEN|G\+|G-|V\+|V-|FE|AC|DC)\b"), F.lit(1))
    often = lambda x: F.size(F.filter(codes, lambda y: y == x))
    ranked = F.transform(F.array_distinct(codes), lambda x: F.struct((-often(x)).alias("n"), F.array_position(codes, x).alias("at"), x.alias("code")))
    return F.coalesce(F.get(F.array_sort(ranked), F.lit(0))["code"], F.lit(""))


# ---------------------------------------------------------------- scores, places, states


def score_text(column: Column | str) -> Column:
    """Four decimal places without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.col(column) if isinstance(column, str) else column), "0+$", ""), r"\.$", "")


def parse_box(column: Column | str) -> Column:
    """The four numbers of a locator as array<double>; null unless there are exactly four."""
    found = F.regexp_extract_all(text_or_empty(column), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.when(F.size(found) == 4, F.transform(found, lambda x: x.cast("double")))


def page_number(column: Column | str) -> Column:
    """The first number of a text, at least 1; 1 without one."""
    return F.greatest(F.lit(1).cast("bigint"), F.coalesce(F.regexp_extract(text_or_empty(column), r"(\d+)", 1).try_cast("bigint"), F.lit(1).cast("bigint")))


def review_status(confidence: Column, has_source: Column) -> Column:
    """Whether a value needs review, from its source and confidence."""
    return (
        F.when(~has_source, "Requires_Review")
        .when(confidence.isNull(), "Unreviewed")
        .when(confidence >= 0.8, "Auto_Approved")
        .otherwise("Requires_Review")
    )


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _unit_interval(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def value_quality(column: Column | str) -> Column:
    """0 to 1: how much a text looks like a parameter value."""
    text = F.trim(text_or_empty(column))
    n = _words(text)
    unit = r"\b(?:V|A|W|mA|mm|g|kg|ms|m|Hz|bar|°[CF]|%|DC|AC|VA|bit|Ω|µs|µm|MPa|kg/)\b"
    score = (
        F.when(text.rlike(unit), 0.5).when(text.rlike(r"\A[\d.,\s]+\z") & (F.length(text) < 12), 0.4)
        .when(text.rlike(r"\d") & (n <= 3), 0.25).otherwise(0.0)
        + F.when(n <= 2, 0.15).when(n <= 4, 0.05).otherwise(0.0)
        - F.when(n > 8, 0.4).otherwise(0.0)
        - F.when(F.length(text) > 120, 0.3).otherwise(0.0)
        - F.when(text.rlike(r"[.!?]\z") & (n > 3), 0.3).otherwise(0.0)
    )
    score = F.when(F.lower(text).rlike(r"www\.|http:|\\\\|\.pdf"), 0.0).otherwise(score)
    score = score - F.when(text.rlike(r"\A\d{1,3}\z"), 0.15).otherwise(0.0)
    return F.when(text == "", 0.0).otherwise(_unit_interval(score))


def name_quality(column: Column | str) -> Column:
    """0 to 1: how much a text looks like a parameter name."""
    text = text_or_empty(column)
    n, letters = _words(text), text.rlike(r"\p{L}")
    upper, lower = letters & (text == F.upper(text)), letters & (text == F.lower(text))
    first = F.substring(text, 1, 1)
    score = (
        F.lit(0.4)
        + F.when(n <= 5, 0.15).otherwise(0.0)
        - F.when(n > 12, 0.4).otherwise(0.0)
        + F.when(first.rlike(r"\A\p{Lu}") & ~upper & ~lower, 0.1).otherwise(0.0)
        - F.when(F.trim(text).rlike(r"[.!?]\z"), 0.3).otherwise(0.0)
        - F.when(F.lower(text).rlike(r"www\.|http"), 0.5).otherwise(0.0)
        - F.when(upper & (F.length(text) > 8), 0.2).otherwise(0.0)
    )
    return F.when(text == "", 0.0).otherwise(_unit_interval(score))


def split_tag(column: Column | str) -> Column:
    """struct(position, function) of a tag."""
    text = text_or_empty(column)
    dotted, plain = r"\A([^.]*)\.([A-Z]+)(\d*)\z", r"\A([A-Z]+\d+)([A-Z]+\d*)\z"
    position = F.when(F.contains(text, F.lit(".")), text).when(text.rlike(plain), F.regexp_extract(text, plain, 1)).otherwise(text)
    function = F.when(~F.contains(text, F.lit(".")) & text.rlike(plain), F.regexp_extract(text, plain, 2)).otherwise("")
    return F.struct(position.alias("position"), function.alias("function"))


# ---------------------------------------------------------------- geometry


def box_centre(box: Column) -> Column:
    return F.struct(((box[0] + box[2]) / 2).alias("x"), ((box[1] + box[3]) / 2).alias("y"))


def box_union(left: Column, right: Column) -> Column:
    """The smallest box around two."""
    return F.array(F.least(left[0], right[0]), F.least(left[1], right[1]), F.greatest(left[2], right[2]), F.greatest(left[3], right[3]))


def box_expand(box: Column, margin: float) -> Column:
    """A box with a margin on every side."""
    return F.array(box[0] - margin, box[1] - margin, box[2] + margin, box[3] + margin)


def box_overlap(left: Column, right: Column) -> Column:
    """Common area of two boxes (x0, y0, x1, y1); 0 if they only touch."""
    w = F.least(left[2], right[2]) - F.greatest(left[0], right[0])
    h = F.least(left[3], right[3]) - F.greatest(left[1], right[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def box_iou(left: Column, right: Column) -> Column:
    """Common area over joint area; 0 for boxes without area."""
    area = lambda b: F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])
    both = box_overlap(left, right)
    joint = area(left) + area(right) - both
    return F.when(joint > 0, both / joint).otherwise(0.0)


def box_contains(box: Column, x: Column, y: Column) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def euler_angles(w: Column, x: Column, y: Column, z: Column) -> Column:
    """struct(roll, pitch, yaw) in degrees of a quaternion."""
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x))))
    yaw = F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
    return F.struct(F.degrees(roll).alias("roll"), F.degrees(pitch).alias("pitch"), F.degrees(yaw).alias("yaw"))


def cosine(left: Column | str, right: Column | str) -> Column:
    """Cosine of two dense vectors; 0 if either has no length."""
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(total(left, left)) * F.sqrt(total(right, right))
    return F.when(norm > 0, total(left, right) / norm).otherwise(0.0)
