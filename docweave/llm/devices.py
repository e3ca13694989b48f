"""Features and comparisons for linking device records: tags, names and context tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import or_null
from docweave.llm.linkage import Comparison, link

#: Default kinds of context tokens by their format.
CONTEXT = {
    "place": r"^E[0-9]+X[0-9]+$",
    "rack": r"^R[0-9]+F[0-9]+$",
    "loop": r"^[A-Z]{2}[0-9]{4}$",
    "project": r"^P[0-9]{7}$",
    "plant": r"^[A-Z][0-9]{4}$",
    "cabinet": r"^SK[0-9]+$",
}
#: Default words of names in the language of the devices, and in full.
WORDS = {
    "inlet": "eintritt", "outlet": "austritt", "supply": "vorlauf", "return": "ruecklauf", "top": "kopf", "bottom": "sumpf",
    "jacket": "mantel", "sampling": "probenahme", "suction": "saugseite", "discharge": "druckseite", "analysis": "analysenmessung",
    "drive": "antrieb", "speed": "drehzahlmessung", "pressure": "druckmessung", "flow": "durchflussmessung",
    "level": "fuellstandsmessung", "valve": "regelventil", "temperature": "temperaturmessung",
    "anal": "analysenmessung", "antr": "antrieb", "drehz": "drehzahlmessung", "druckmess": "druckmessung", "durchfl": "durchflussmessung",
    "fuellst": "fuellstandsmessung", "reg": "regelventil", "temp": "temperaturmessung",
}
#: Default words for where a device sits.
POSITIONS = "eintritt austritt vorlauf ruecklauf kopf sumpf mantel probenahme saugseite druckseite bypass".split()
#: Letters a scanner confuses with digits.
LIKE_DIGITS = ("OISBZ", "01582")


@dataclass(frozen=True)
class Vocabulary:
    """What names and context tokens of a plant look like: formats by kind, translated words, positions, words that tell nothing."""

    context: dict[str, str] = field(default_factory=lambda: dict(CONTEXT))
    words: dict[str, str] = field(default_factory=lambda: dict(WORDS))
    positions: tuple[str, ...] = tuple(POSITIONS)
    filler: tuple[str, ...] = ("measurement", "control", "side", "mess", "v")


def core_tag(column: Column | str) -> Column:
    """System, number, function letter and running number of a tag, without prefixes, padding and scanner confusions.

    Null if the text has no such ending.
    """
    text = F.regexp_replace(F.upper(column), "[^A-Z0-9]", "")
    part = r"([A-Z]{2})0?([0-9OISBZ]{2})([A-Z])0?([0-9OISBZ]{1,4})$"
    digits = lambda i: F.translate(F.regexp_extract(text, part, i), *LIKE_DIGITS)
    core = F.concat(F.regexp_extract(text, part, 1), digits(2), F.regexp_extract(text, part, 3), digits(4))
    return F.when(text.rlike(part), core)


def function_letter(column: Column | str) -> Column:
    """The function letter of a tag, also of one that only counts within its plant (``71-P-2403``); null without one."""
    text = F.regexp_replace(F.upper(column), "[^A-Z0-9]", "")
    return F.coalesce(F.substring(core_tag(column), 5, 1), or_null(F.regexp_extract(text, r"^[0-9OISBZ]{2}([A-Z])[0-9OISBZ]{3,5}$", 1)))


def folded(column: Column | str) -> Column:
    """Lower case, umlauts spelled out, mis-decoded umlauts repaired, other characters as spaces."""
    text = F.lower(F.coalesce(column, F.lit("")))
    for bad, good in (("ã¤", "ae"), ("ã¶", "oe"), ("ã¼", "ue"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = F.replace(text, F.lit(bad), F.lit(good))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def features(rows: DataFrame, key: str, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """One row per key (its latest version) with the features the comparisons use; blank keys drop out.

    Of versions with the same time the larger values win, so the choice does not depend on order.
    """
    latest = (
        rows.where(F.trim(key) != "")
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(F.struct("updated_at", "canonical_tag", "display_name", "normalized_tags", "context_tokens")).alias("v"))
        .select("key", "v.*")
    )
    none = F.array().cast("array<string>")
    tags = F.array_distinct(
        F.array_compact(
            F.transform(F.concat(F.array("canonical_tag"), F.coalesce("normalized_tags", none)), lambda x: F.coalesce(core_tag(x), _plain(x)))
        )
    )
    tokens = F.array_distinct(F.transform(F.array_compact(F.coalesce("context_tokens", none)), lambda x: F.upper(F.trim(x))))
    words = F.split(folded("display_name"), " ")
    known = F.create_map(*[F.lit(x) for pair in vocabulary.words.items() for x in pair])
    whole = F.filter(F.transform(F.coalesce("normalized_tags", none), core_tag), lambda x: x.isNotNull())
    letters = F.filter(F.transform(F.coalesce("normalized_tags", none), function_letter), lambda x: x.isNotNull())
    base = latest.select(
        "key",
        core_tag("canonical_tag").alias("own"),
        F.coalesce(core_tag("canonical_tag"), F.get(whole, F.lit(0))).alias("tag"),
        function_letter("canonical_tag").alias("own_function"),
        F.coalesce(function_letter("canonical_tag"), F.get(letters, F.lit(0))).alias("function"),
        tags.alias("tags"),
        tokens.alias("tokens"),
        F.array_distinct(
            F.filter(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), lambda w: (w != "") & ~w.isin(*vocabulary.filler))
        ).alias("words"),
    )
    kinds = [_or_null(_like("tokens", p)).alias(name) for name, p in vocabulary.context.items() if name != "plant"]
    named = F.transform(F.filter("words", lambda w: F.upper(w).rlike(vocabulary.context["plant"])), F.upper)
    plant = F.array_distinct(F.concat(_like("tokens", vocabulary.context["plant"]), named))
    rest = F.filter("tokens", lambda x: ~x.rlike("[0-9]") & (F.length(x) > 5))
    return base.select(
        "key",
        "own",
        "tag",
        _or_null(F.col("tags")).alias("tags"),
        "own_function",
        "function",
        *kinds,
        _or_null(plant).alias("plant"),
        _or_null(rest).alias("medium"),
        _or_null(F.filter("words", lambda w: w.isin(*vocabulary.positions))).alias("position"),
        _or_null(F.col("words")).alias("words"),
    )


def _plain(x: Column) -> Column:
    """A tag of another form; a word without digits stands for a missing one."""
    text = F.regexp_replace(F.upper(x), "[^A-Za-z0-9]", "")
    return F.when((F.length(text) > 3) & text.rlike("[0-9]"), F.translate(text, *LIKE_DIGITS))


def _one_less(tag: Column) -> Column:
    """A tag and all texts of one character less: tags within one edit share one."""
    at = lambda i: F.concat(F.substring(tag, F.lit(1), i - 1), F.substring(tag, i + 1, F.length(tag)))
    return F.array_distinct(F.concat(F.array(tag), F.transform(F.sequence(F.lit(1), F.length(tag)), at)))


def _like(array: str, pattern: str) -> Column:
    return F.filter(array, lambda x: x.rlike(pattern))


def _or_null(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.sort_array(array))


def _begins(a: Column, b: Column) -> Column:
    """Whether two words are equal or one is the beginning of the other."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) > 2) & (F.startswith(a, b) | F.startswith(b, a)))


def _overlap(name: str) -> Column:
    return F.arrays_overlap(f"l_{name}", f"r_{name}").cast("int")


def _key(*parts: str) -> Column:
    """Every combination of the values of array features as block keys; null if one is missing."""
    keys = F.col(parts[0])
    for part in parts[1:]:
        keys = _product(keys, F.col(part))
    return keys


def _product(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, F.lit("/"), b))))


def passes() -> dict[str, Column]:
    """Blocking keys: a pair is compared if it shares one of any pass."""
    near = F.flatten(F.transform("tags", _one_less))
    return {
        "tag": F.col("tags"),
        "loop-place": _key("loop", "place"),
        "loop-rack": _key("loop", "rack"),
        "loop-plant": _key("loop", "plant"),
        "place-rack": _key("place", "rack", "project"),
        "plant-place": _key("plant", "place"),
        "plant-rack": _key("plant", "rack"),
        "plant-position": _key("plant", "position"),
        "loop-project": _key("loop", "project"),
        "place-project": _key("place", "project"),
        "rack-project": _key("rack", "project"),
        "near-project": _product(near, F.col("project")),
        "near-plant": _product(near, F.col("plant")),
    }


def comparisons() -> list[Comparison]:
    """Agreement levels of the features, strongest last.

    Tags and functions only speak against a pair if the left row's own tag has them: its further tags may name others.
    """
    same = F.col("l_tag") == F.col("r_tag")
    near = F.levenshtein("l_tag", "r_tag", 1) >= 0
    tag = F.when(same, 3).when(F.arrays_overlap("l_tags", "r_tags"), 2).when(near, 1).when(F.col("l_own").isNotNull() & F.col("r_tag").isNotNull(), 0)
    both = F.size(F.filter("l_words", lambda a: F.exists("r_words", lambda b: _begins(a, b))))  # names may be cut off
    all_words = F.size("l_words") + F.size("r_words") - both
    share = F.when(F.col("l_words").isNotNull() & F.col("r_words").isNotNull(), both / all_words)
    name = F.when(share >= 0.7, 3).when(share >= 0.45, 2).when(share >= 0.2, 1).when(share >= 0, 0)
    return [
        Comparison("tag", tag, 4),
        Comparison("function", (F.col("l_own_function") == F.col("r_function")).cast("int"), 2),
        Comparison("name", name, 4),
        *[Comparison(f, _overlap(f), 2) for f in ("place", "rack", "loop", "project", "plant", "cabinet", "medium", "position")],
    ]


def match_devices(
    records: DataFrame, devices: DataFrame, threshold: float = 0.2, vocabulary: Vocabulary = Vocabulary()  # noqa: B008
) -> DataFrame:
    """record_key, device_id, confidence of records and devices that describe the same thing.

    A record goes to its likeliest device, so few others compete with a low confidence; the default asks for 0.2.
    """
    left, right = features(records, "record_key", vocabulary), features(devices, "device_id", vocabulary)
    found = link(left, right, passes(), comparisons(), threshold)
    return found.select(F.col("l_key").alias("record_key"), F.col("r_key").alias("device_id"), "confidence")
