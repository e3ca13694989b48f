"""Text and value functions against plain Python versions and the literal cases of the domain."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import text as t
from docweave.functions import values as v

TEXTS = ["", " ", "ß Ü ﬁ", "a–b", "Größe ½", "TI TU10.T41", "ﬂow №5", "x" * 20_000, "ÀÉÎ\tõ ü", "日本 12", None, "Ⅷ ² ™", "line\r\nbreak"]


def apply(spark, function, values, kind="string"):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", function("x").alias("y")).orderBy("i").collect()]


def ascii_of(x):
    return unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore").decode()


def label(x):
    return re.sub(r"[^a-z0-9]+", " ", ascii_of(x).lower()).strip()


def test_folding_matches_compatibility_forms(spark):
    assert apply(spark, t.fold_ascii, TEXTS) == [ascii_of(x) for x in TEXTS]
    assert apply(spark, t.normalize_label, TEXTS) == [label(x) for x in TEXTS]
    assert apply(spark, t.normalize_identifier, TEXTS) == [re.sub(r"[^a-z0-9]+", "", ascii_of(x).lower()) for x in TEXTS]
    assert apply(spark, t.slugify, TEXTS) == [label(x).replace(" ", "_") or "field" for x in TEXTS]
    assert apply(spark, t.clean_cell, TEXTS) == [" ".join((x or "").split()) for x in TEXTS]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(min_codepoint=1, max_codepoint=0x17F), max_size=12), min_size=1, max_size=20))
def test_folding_is_idempotent_and_ascii(spark, values):
    once = apply(spark, t.normalize_label, values)
    assert once == [label(x) for x in values]
    assert apply(spark, t.normalize_label, once) == once


@pytest.mark.parametrize(
    ("tag", "akz", "bare"),
    [("TI TU10.T41", "TITU10T41", "TU10T41"), ("TU10-T41", "TU10T41", "TU10T41"), ("tu10t41", "TU10T41", "TU10T41"), ("PVTU20Y30", "PVTU20Y30", "TU20Y30"), ("FIC", "FIC", "C"), ("TI10", "TI10", "TI10"), ("", "", "")],
)
def test_designation_forms(spark, tag, akz, bare):
    assert apply(spark, t.normalize_akz, [tag]) == [akz]
    assert apply(spark, t.strip_function_prefix, [akz]) == [bare]


def test_component_tokens(spark):
    got = apply(spark, t.component_tokens, ["Klemme X1:12/L1, TU10F17-5 und HC10-01.", "kein Treffer", None, ""])
    assert got[0][:1] == ["TU10F17-5"] and "X1:12/L1" in got[0] and "HC10" in got[0]
    assert got[1:] == [[], [], []]
    assert all(len(x) == len(set(x)) for x in got)


def test_headers_and_coordinates(spark):
    frame = spark.createDataFrame([(["Tag", "Name", "Unit"],), (["X1:1", "a", "b"],), (["1", "2", "a"],), (["only", "", " "],), ([],)], "c array<string>")
    assert [r[0] for r in frame.select(t.looks_header_like("c")).collect()] == [True, False, False, False, False]
    cells = spark.createDataFrame([(1, 1), (3, 26), (4, 27), (5, 702), (6, 703), (7, 18278), (8, 0)], "r int, c int")
    assert [r[0] for r in cells.select(t.cell_coordinate("r", "c")).collect()] == ["A1", "Z3", "AA4", "ZZ5", "AAA6", "ZZZ7", "8"]


def test_boolish(spark):
    values = ["yes", "TRUE", "complete", "0", "partial", "", None, "2.5", "-1", "abc", " 1 "]
    assert apply(spark, t.boolish, values) == [True, True, True, False, False, False, False, True, False, False, True]


@pytest.mark.parametrize(
    ("text", "value", "unit"),
    [("[g/cm³]", "", "g/cm³"), ("L+ (-53 V)", "L+", "V"), ("0 to 2 V DC (peak)", "0 to 2", "V DC"), ("12 mm", "12", "mm"), ("5 (kg)", "5", "kg"), ("plain text", "plain text", ""), ("", "", ""), ("7 bar;", "7", "bar"), ("3 kVA", "3", "kVA")],
)
def test_split_value_unit(spark, text, value, unit):
    assert tuple(apply(spark, v.split_value_unit, [text])[0]) == (value, unit)


@pytest.mark.parametrize(
    ("text", "value", "unit", "qualifier"),
    [("24 V DC", "24", "V", "DC"), ("2,50 mm2", "2.5", "mm²", ""), ("400 Volt 3-phase", "400", "V", "3-phase"), ("no number", "", "", ""), (None, "", "", ""), ("007 bar", "7", "bar", ""), ("1.0 kW", "1", "kW", "")],
)
def test_parse_quantity(spark, text, value, unit, qualifier):
    assert tuple(apply(spark, v.parse_quantity, [text])[0]) == (value, unit, qualifier)


def test_repair_date_and_sanitize(spark):
    assert apply(spark, v.repair_date, ["1g.o5.2o21", "3/14/2020", "14/3/2020", "|12.01.2020", "no date", "a.b", None, ""]) == [
        "19.05.2021", "14.03.2020", "14.03.2020", "12.01.2020", "no date", "a.b", "", ""]
    assert apply(spark, v.sanitize_text, ["N/A", " - ", "See page 4", "a\x00bc", "Wert", None]) == ["", "", "", "abc", "Wert", ""]


@pytest.mark.parametrize(
    ("token", "aspect"),
    [("=.FIC+", "Orts+Produktaspekt"), ("-A1-(0)-M05", "Produktaspekt"), ("+10.O001.MSR_Schrank", "Ortsaspekt"), ("=+10.L001.G001", "Orts+Produktaspekt"), ("=A.B", "Funktionsaspekt"), ("", "Produktaspekt"), ("a+b-c", "Orts+Produktaspekt")],
)
def test_iec_aspect(spark, token, aspect):
    assert apply(spark, v.iec_aspect, [token]) == [f"Referenzkennzeichnung ({aspect})"]


def test_standalone_tokens(spark):
    got = apply(spark, v.standalone_token, ["EW8", "AW8", "12", "g/cm³", "COM", "etwas anderes", ""])
    assert [r.name for r in got] == ["Eingangskennzeichen", "Ausgangskennzeichen", "Anschlussbezeichnung", "Messgröße", "COM", "Bemerkung", "Bemerkung"]


def test_terminals(spark):
    got = apply(spark, v.terminal_designator, ["12", ": 7", "3/L1", "Kanal 4", "A12", "kurz", "Klemmleiste", "ein sehr langer Text", "", None])
    assert [r.name for r in got] == ["12", "7", "3/L1", "Kanal 4", "A12", "kurz", None, None, None, None]
    assert got[2].value == "L1" and got[4].attribute == "Klemmentyp"


def test_designation_lookup_forms(spark):
    assert apply(spark, v.designation_keys, ["X1.2_a"])[0] == ["-x1.2_a", "-x12_a", "-x1.2a", "x1.2_a", "x12_a", "x1.2a"]
    assert apply(spark, v.designation_base, ["-X1:12", "=A/3"]) == ["x1", "=a"]


def test_small_values(spark):
    assert apply(spark, v.polarity, ["N und L1, L1", "nichts", None]) == ["L1", "", ""]
    assert apply(spark, v.score_text, [0.5, 1.0, 0.12345], "double") == ["0.5", "1", "0.1235"]
    assert apply(spark, v.parse_box, ["(1, 2.5, 3, -4)", "1,2", None]) == [[1.0, 2.5, 3.0, -4.0], None, None]
    assert apply(spark, v.page_number, ["Page 12", "0", "", None]) == [12, 1, 1, 1]
    assert [tuple(x) for x in apply(spark, v.split_tag, ["TU10F17", "TU10.F17", "x", None])] == [("TU10", "F17"), ("TU10.F17", ""), ("x", ""), ("", "")]


def value_score(x):
    """A plain version of the value score."""
    if not x.strip():
        return 0.0
    x, words = x.strip(), len(x.split())
    score = 0.5 if re.search(r"\b(?:V|A|W|mA|mm|g|kg|ms|m|Hz|bar|°[CF]|%|DC|AC|VA|bit|Ω|µs|µm|MPa|kg/)\b", x) else 0.4 if re.match(r"^[\d.,\s]+$", x) and len(x) < 12 else 0.25 if re.search(r"\d", x) and words <= 3 else 0.0
    score += 0.15 if words <= 2 else 0.05 if words <= 4 else 0
    score -= 0.4 * (words > 8) + 0.3 * (len(x) > 120) + 0.3 * (x[-1] in ".!?" and words > 3)
    if re.search(r"www\.|http:|\\\\|\.pdf", x.lower()):
        score = 0.0
    return max(0.0, min(1.0, score - 0.15 * bool(re.match(r"^\d{1,3}$", x))))


def test_quality_scores(spark):
    values = ["24 V", "12", "1234.5", "see www.x.de", "ein langer Satz mit vielen Worten und noch mehr davon.", "", "ab 3"]
    assert apply(spark, v.value_quality, values) == pytest.approx([value_score(x) for x in values])
    names = apply(spark, v.name_quality, ["Design Pressure", "ALL CAPS NAME", "", "http://x", "Satz."])
    assert names == pytest.approx([0.65, 0.35, 0.0, 0.05, 0.35])


def test_geometry(spark):
    one = spark.range(1)
    a, b = F.array(*[F.lit(float(x)) for x in (0, 0, 2, 2)]), F.array(*[F.lit(float(x)) for x in (1, 1, 3, 3)])
    got = one.select(v.box_overlap(a, b), v.box_iou(a, b), v.box_centre(a), v.box_contains(a, F.lit(1.0), F.lit(2.0)), v.box_iou(a, F.array(*[F.lit(5.0)] * 4))).first()
    assert got[0] == 1.0 and got[1] == pytest.approx(1 / 7) and tuple(got[2]) == (1.0, 1.0) and got[3] and got[4] == 0.0
    turn = one.select(v.euler_angles(F.lit(0.7071067811865476), F.lit(0.0), F.lit(0.0), F.lit(0.7071067811865476))).first()[0]
    assert turn.yaw == pytest.approx(90.0) and turn.roll == pytest.approx(0.0)
