"""Designations of plants and circuits: shapes, element types, function letters, candidates, cell contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import clean_cell, text_or_empty
from docweave.functions.values import canonical_designation, standalone_token

#: Shapes of reference designations.
SHAPES = (
    r"\A-?[A-Z]\d{1,4}[:./][\w/]+", r"\A=[\dA-Z][\d.A-Z]*", r"\A[A-Z]{2,4}\d+[.-][A-Z]\d+", r"\A[A-Z]\d{1,3}\z", r"\A\d+/\d+\z",
)
#: Words of fields that belong to connections.
CONNECTION_FIELDS = (
    r"(?i)\A(leiterfarbe|wire.?color|aderfarbe|from_.*|to_.*|querschnitt|cross.?section|betriebsmittel_zugang|betriebsmittel_abgang|connection.*"
    r"|polarit|kabel|cable|verschaltung|schirm|shielding)"
)
#: Element types of a class letter, the usual one first.
ELEMENT_TYPES = {
    "A": ("Cabinet_Aggregate", "PLC_Module"), "B": ("Sensor", "Transducer"), "C": ("PLC_Module",), "E": ("Heater", "Indicator_Lamp"),
    "F": ("Fuse", "Circuit_Breaker"), "G": ("Power_Supply",), "H": ("Indicator_Lamp", "Switch"),
    "K": ("Contactor", "Auxiliary_Contactor", "PLC_Module", "Coil"), "M": ("Motor", "Actuator", "Valve_Actuator"),
    "P": ("Indicator_Lamp", "Sensor", "Switch"), "Q": ("Switch", "Circuit_Breaker", "Contactor", "Main_Contact", "Auxiliary_Contact"),
    "R": ("Sensor", "Transducer"), "S": ("Switch",), "T": ("Power_Supply",), "U": ("PLC_Module", "Power_Supply"), "V": ("PLC_Module",),
    "W": ("Power_Supply",), "X": ("Terminal", "Terminal_Strip", "Socket_Outlet"), "Y": ("Valve_Actuator", "Actuator"),
}
#: What the first and the further letters of a function code mean.
CATEGORY = {
    "F": "F (Durchfluss)", "L": "L (Stand)", "P": "P (Druck)", "T": "T (Temperatur)", "Q": "Q (Menge/Anzahl)", "S": "S (Drehzahl)",
    "W": "W (Gewicht/Kraft)", "A": "A (Analyse)", "Y": "Y (Stellventil/Magnetventil)", "N": "N (Benutzerdefiniert)", "H": "H (Handbetrieb)",
    "G": "G (Allgemein)", "M": "M (Montage/Motor)",
}
PROCESSING = {
    "I": "I (Analoganzeige)", "C": "C (Regelung)", "R": "R (Registrierung)", "S": "S (Schaltung)", "Z": "Z (Notschaltung)", "A": "A (Alarm)",
    "T": "T (Transmitter)", "O": "O (Optische Anzeige)", "B": "B (Binaerverarbeitung)", "Q": "Q (Integrierend)",
}
#: Wire colours by their red, green and blue parts.
WIRES = {
    "rot": (1.0, 0.0, 0.0), "blau": (0.0, 0.0, 1.0), "gelb": (1.0, 1.0, 0.0), "grün": (0.0, 0.501961, 0.0), "braun": (0.545098, 0.270588, 0.07451),
    "grau": (0.827451, 0.827451, 0.827451),
}


def lookup(mapping: dict[str, str], key: Column, otherwise: Column | None = None) -> Column:
    """A value of a short fixed mapping."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), otherwise if otherwise is not None else F.lit(None).cast("string"))


def looks_like_designation(column: Column | str) -> Column:
    """Whether a text of two characters or more begins like a reference designation."""
    text = F.trim(text_or_empty(column))
    return (F.length(text) >= 2) & text.rlike("|".join(SHAPES))


def field_scope(field: Column | str, document: list[str]) -> Column:
    """Whether a field belongs to a connection, the document or an element."""
    name = F.trim(text_or_empty(field))
    return F.when(name.rlike(CONNECTION_FIELDS), "connection").when(F.lower(name).isin(*[d.lower() for d in document]), "document").otherwise("element")


def element_type(column: Column | str) -> Column:
    """struct(element_type, confidence) by class letter: 0.8 if it has one type, 0.55 if several; nulls if unknown."""
    letter = F.regexp_extract(F.trim(text_or_empty(column)), r"\A-?([A-Z])", 1)
    kind = lookup({k: v[0] for k, v in ELEMENT_TYPES.items()}, letter)
    single = letter.isin(*[k for k, v in ELEMENT_TYPES.items() if len(v) == 1])
    return F.struct(kind.alias("element_type"), F.when(kind.isNotNull(), F.when(single, 0.8).otherwise(0.55)).alias("confidence"))


def function_letters(column: Column | str) -> Column:
    """struct(category, processing) of a function code; digits are positions, unknown letters stand for themselves."""
    text = text_or_empty(column)
    first = F.substring(text, 1, 1)
    rest = F.filter(F.split(F.substring(text, 2, 100), ""), lambda c: c.rlike(r"\p{L}"))
    parts = F.transform(rest, lambda c: lookup(PROCESSING, c, c))
    return F.struct(lookup(CATEGORY, first, first).alias("category"), F.array_join(parts, ", ").alias("processing"))


def closest_wire(red: Column, green: Column, blue: Column, limit: float = 0.3) -> Column:
    """The wire colour of least squared distance, null beyond the limit; the earlier one among equals."""
    far = lambda c: (red - c[0]) ** 2 + (green - c[1]) ** 2 + (blue - c[2]) ** 2
    best = F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(WIRES.items())]))
    return F.when(best["d"] < limit, best["n"])


def terminal_candidates(strip: Column | str, terminal: Column | str) -> Column:
    """Designations a strip field and a terminal number may mean: with and without dots and leading zeros."""
    suffix = F.btrim(F.regexp_replace(F.lower(F.trim(text_or_empty(strip))), r"\Aklemmleiste_", ""), F.lit("_"))
    dotted = F.upper(F.replace(suffix, F.lit("_"), F.lit(".")))
    bases = F.filter(F.array_distinct(F.array(dotted, F.replace(dotted, F.lit("."), F.lit("")))), lambda b: b != "")
    bases = F.transform(bases, lambda b: F.when(b.startswith("X"), b).otherwise(F.concat(F.lit("X"), b)))
    bases = F.array_distinct(F.flatten(F.transform(bases, lambda b: F.array(b, F.regexp_replace(b, r"X\.", "X")))))
    number = F.upper(F.regexp_replace(text_or_empty(terminal), r"(?U)\s+", ""))
    forms = F.array_distinct(F.array(number, F.when(number.rlike(r"\A\d+\z"), F.regexp_replace(number, r"\A0+(?=\d)", "")).otherwise(number)))
    pairs = F.flatten(F.transform(bases, lambda b: F.transform(forms, lambda t: F.concat(F.lit("-"), b, F.lit(":"), t))))
    return F.when(number == "", F.array().cast("array<string>")).otherwise(pairs)


def device_candidates(column: Column | str) -> Column:
    """Designations a device text may mean, without repeats: itself, those in it, and their parts before ``/`` and ``:``."""
    text = clean_cell(column)
    none = F.array().cast("array<string>")
    own = F.when(looks_like_designation(text) | text.rlike(r"\A-?[A-Za-z]\s*\d"), F.array(canonical_designation(text))).otherwise(none)
    tokens = F.transform(F.regexp_extract_all(F.upper(text), F.lit(r"[A-Z]\s*\d+(?:\s*[:/.]\s*\d+)*"), F.lit(0)), canonical_designation)
    parts = F.flatten(F.transform(tokens, lambda t: F.array(t, F.regexp_replace(t, "/.*", ""), F.regexp_replace(t, ":.*", ""))))
    turned = F.transform(
        F.regexp_extract_all(F.upper(text), F.lit(r"\d+\s*([A-Z]\s*\d+)"), F.lit(1)), lambda t: F.concat(F.lit("-"), F.regexp_replace(t, r"\s+", ""))
    )
    return F.array_distinct(F.filter(F.concat(own, parts, turned), lambda t: t != ""))


def cell_parts(column: Column | str) -> Column:
    """array<struct(part, name, value, class, source)> of the lines of a cell: attributes of the main part, and terminals.

    ``name: value`` lines are attributes, signs begin references, one to three digits are a terminal, other tokens go by
    their shape.  Blank lines and names without a value are left out.
    """
    lines = F.filter(F.transform(F.split(text_or_empty(column), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")

    def part(line: Column) -> Column:
        make = lambda p, n, v, c, s: F.struct(p.alias("part"), n.alias("name"), v.alias("value"), c.alias("class"), s.alias("source"))
        main = F.lit("main")
        name, value = F.trim(F.regexp_extract(line, r"(?s)\A([^:]*):(.*)\z", 1)), F.trim(F.regexp_extract(line, r"(?s)\A([^:]*):(.*)\z", 2))
        shaped = standalone_token(line)
        norm = F.lower(name).isin("messgröße", "messgroesse", "anschluss", "anschlussbezeichnung", "eingang", "eingangskennzeichen", "ausgang", "ausgangskennzeichen", "unterbrechung", "unterbrechungsnummer")
        named = make(main, name, value, F.when(norm, "DIN 19227-2").otherwise("Herstellerspezifisch"), F.when(norm, "Normativ").otherwise("Explizit"))
        sub = make(F.lit("terminal"), F.lit("Anschlussbezeichnung"), line, F.lit("DIN 19227-2"), F.lit("Normativ"))
        other = make(main, shaped["name"], line, shaped["class"], shaped["source"])
        sign = line.rlike(r"\A[=+\-]")
        return F.when(F.contains(line, F.lit(":")) & ~sign, named).when(line.rlike(r"\A\d{1,3}\z"), sub).otherwise(other)

    return F.filter(F.transform(lines, part), lambda p: p["value"] != "")


def complete_year(column: Column | str, years: Column) -> Column:
    """A date whose year lost its last digit, completed by the most frequent year (first among equals) that begins alike."""
    text = text_or_empty(column)
    lost = r"\A(\d{2}\.\d{2}\.)(\d{3})\z"
    begun = F.regexp_extract(text, lost, 2)
    fits = F.filter(years, lambda y: (F.length(y) == 4) & y.startswith(begun))
    ranked = F.transform(F.array_distinct(fits), lambda y: F.struct((-F.size(F.filter(fits, lambda z: z == y))).alias("n"), F.array_position(fits, y).alias("i"), y.alias("y")))
    best = F.get(F.array_sort(ranked), F.lit(0))["y"]
    return F.when(text.rlike(lost) & best.isNotNull(), F.concat(F.regexp_extract(text, lost, 1), best)).otherwise(text)


def hashed_terms(tokens: Column, buckets: int = 768) -> Column:
    """map(bucket, count) of terms; a hash that is the same in every process."""
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
    return F.map_from_entries(F.transform(F.array_distinct(places), lambda b: F.struct(b, F.size(F.filter(places, lambda x: x == b)).cast("double"))))
