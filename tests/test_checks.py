"""Cross-checks, data sheets, circuits, designations and the document model: literal cases and edge rows."""

import math

import pytest
from pyspark.sql import functions as F

from docweave.functions import designations as ds
from docweave.operators import circuits, crosscheck, datasheet, ordered
from docweave.plans import sheets


def apply(spark, function, values):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r.y for r in frame.select("i", function("x").alias("y")).orderBy("i").collect()]


def test_designations(spark):
    assert apply(spark, ds.looks_like_designation, ["-X1:11", "=0.H1.T1", "TU10.F17", "K1", "13/14", "x", "", None, "Wort"]) == [True] * 5 + [False] * 4
    assert [tuple(x) for x in apply(spark, ds.element_type, ["-K1", "X1:1", "S3", "Z9", "", None])] == [("Contactor", 0.55), ("Terminal", 0.55), ("Switch", 0.8), (None, None), (None, None), (None, None)]
    assert [tuple(x) for x in apply(spark, ds.function_letters, ["FIC", "T1", "", None])] == [("F (Durchfluss)", "I (Analoganzeige), C (Regelung)"), ("T (Temperatur)", ""), ("", ""), ("", "")]
    assert apply(spark, lambda c: ds.field_scope(c, ["Datum"]), ["from_element", "Leiterfarbe", "datum", "x", None]) == ["connection", "connection", "document", "element", "element"]
    assert apply(spark, ds.device_candidates, ["K 5:13/14", "3F1", None])[0][:2] == ["-K5:13/14", "-K5:13"] and apply(spark, ds.device_candidates, ["3F1"]) == [["-F1"]]
    got = spark.createDataFrame([("klemmleiste_x1_2", "07"), ("x", ""), (None, None)], "s string, t string").select(ds.terminal_candidates("s", "t")).collect()
    assert set(got[0][0]) >= {"-X1.2:07", "-X1.2:7", "-X12:7"} and got[1][0] == [] and got[2][0] == []


def test_cells_dates_and_colours(spark):
    parts = apply(spark, ds.cell_parts, ["Art: AI\n=A.B\n12\n\nfrei: \nEW8", "", None])
    assert [(p.part, p.name, p.value) for p in parts[0]] == [("main", "Art", "AI"), ("main", "Referenzkennzeichnung (Funktionsaspekt)", "=A.B"), ("terminal", "Anschlussbezeichnung", "12"), ("main", "Eingangskennzeichen", "EW8")]
    assert parts[1:] == [[], []]
    years = F.array(*[F.lit(y) for y in ("2009", "2008", "2008", "1999")])
    assert apply(spark, lambda c: ds.complete_year(c, years), ["23.04.200", "23.04.2001", "01.01.199", "01.01.180", None]) == ["23.04.2008", "23.04.2001", "01.01.1999", "01.01.180", ""]
    one = spark.range(1)
    assert one.select(ds.closest_wire(F.lit(0.9), F.lit(0.1), F.lit(0.0))).first()[0] == "rot" and one.select(ds.closest_wire(F.lit(0.4), F.lit(0.0), F.lit(0.9))).first()[0] == "blau"
    counts = one.select(ds.hashed_terms(F.array(F.lit("a"), F.lit("b"), F.lit("a")))).first()[0]
    assert sorted(counts.values()) == [1.0, 2.0]


def test_cross_checks(spark):
    entities = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "key string")
    seen = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "b"), ("y", ""), (None, "c")], "source string, key string")
    flags = crosscheck.presence_by_source(entities, seen, ["x", "y"])
    got = {r.key: (r.missing_targets, r.issue_count, r.recommended_action) for r in crosscheck.missing_targets(flags, ["x", "y"], {"y": "Add y"}).collect()}
    assert got == {"a": ("", 0, "No completion required"), "b": ("y", 1, "Add y"), "c": ("x | y", 2, "Add y")}
    assert tuple(crosscheck.summary(crosscheck.missing_targets(flags, ["x", "y"], {})).first()) == (3, 2, 3)
    rows = spark.createDataFrame([("r", "A-1", "n", "pdf"), ("s", "a1", None, "xml"), ("t", "", "", "pdf")], "record string, tag string, name string, kind string")
    index = crosscheck.key_index(rows.withColumn("s", F.lit("p")), "s", crosscheck.identity_keys(rows.columns, ["tag", "name", "none"]), "record")
    assert {tuple(r) for r in index.collect()} == {("p", "a1", "r"), ("p", "a1", "s"), ("p", "n", "r")}
    evidence = crosscheck.evidence_index(rows, "tag", "record", "kind", {"pdf": ["pdf"], "xml": ["xml"]})
    assert {tuple(r) for r in evidence.collect()} == {("a1", "r", True, False), ("a1", "s", False, True)}
    state = crosscheck.category_state(spark.createDataFrame([("a", "x", False), ("b", "x", True), ("c", None, None)], "k string, c string, b boolean"), "k", "c", ["x"], "b")
    assert {r.k: r.state for r in state.collect()} == {"a": "present", "b": "conflict", "c": "missing"}


def test_star_and_pairing(spark):
    objects = spark.createDataFrame([("o1", "d"), ("o2", "d")], "object_id string, document string")
    facts = spark.createDataFrame([("d", "n", "v"), ("d", "n", "u"), ("d", "", "z")], "document string, name string, value string")
    elements = spark.createDataFrame([("o1", f"e{i:02}", "a") for i in range(15)], "object_id string, element_id string, attribute string")
    links = spark.createDataFrame([("l1", "e01"), ("l1", "e02"), ("l2", "zz")], "link_id string, element_id string")
    got = {r.object_id: r for r in crosscheck.flatten_star(objects, facts, elements, links).collect()}
    assert got["o1"].n_elements == 15 and got["o1"].element_ids == [f"e{i:02}" for i in range(10)] and got["o1"].n_links == 1 and got["o1"].facts == {"n": "u"}
    assert got["o2"].n_elements == 0 and got["o2"].element_ids is None
    drawings = spark.createDataFrame([("r", "r/Anlage_A.pdf"), ("r", "r/Anlage_B.pdf"), ("q", "q/x.pdf"), ("p", "p/only.pdf")], "root string, path string")
    models = spark.createDataFrame([("r", "r/anlage b.xml", "", ""), ("r", "r/m2.xml", "Anlage A", ""), ("q", "q/completely.xml", "", "")], "root string, path string, drawing_name string, drawing_title string")
    pairs = {r.drawing: (r.model, r.status) for r in crosscheck.pair_files(drawings, models).collect()}
    assert pairs == {"r/Anlage_A.pdf": ("r/m2.xml", "paired"), "r/Anlage_B.pdf": ("r/anlage b.xml", "paired"), "q/x.pdf": ("q/completely.xml", "paired"), "p/only.pdf": (None, "missing")}


def test_vector_names_and_guesses(spark):
    names = spark.createDataFrame([("hersteller", [1.0, 0.1]), ("plant", [1.0, 0.0]), ("known", [0.0, 1.0]), ("far_name", [-1.0, 0.0])], "name string, vector array<double>")
    corpus = spark.createDataFrame([("Manufacturer", [1.0, 0.0]), ("Medium", [0.0, 1.0])], "attribute string, vector array<double>")
    got = {r.name: r.attribute for r in crosscheck.vector_names(names, corpus, spark.createDataFrame([("known",)], "name string")).collect()}
    assert got == {"hersteller": "Manufacturer", "plant": "Manufacturer", "known": "known", "far_name": "far_name"}
    assert crosscheck.foreign_key_guesses({"Element": ["Element_ID", "Document_ID"], "Document": ["Document_ID"], "Plain": ["x"]}) == [("Element", "Document_ID", "Document", "Document_ID")]
    a = spark.createDataFrame([("t", "a"), ("t", "b")], "canonical string, alias string")
    assert {tuple(r) for r in crosscheck.profile_difference(a, a.where("alias = 'a'").union(spark.createDataFrame([("t", "c")], a.schema))).collect()} == {("t", "b", "added"), ("t", "c", "removed")}


SHEET = "Data sheet\nSupply voltage: 24 V DC\nSupply voltage: 12 V\nWeight            1.5 kg\nALL CAPS HEADING: 5\nLink: www.x.de\nName: viele Worte ohne jede Zahl darin\nCable length . . . . . . . 12\nMode\tfast\n12: 13\n"


def test_data_sheets(spark):
    texts = spark.createDataFrame([(1, SHEET), (2, None), (3, "")], "id int, t string")
    got = {r.name: r.value for r in datasheet.parameters(texts, "id", "t").collect()}
    assert got == {"Supply voltage": "24 V DC", "Weight": "1.5 kg", "Mode": "fast"}
    entries = datasheet.contents(spark.createDataFrame([(1, "Cable length  . . . . . . . 12\nTable of contents   ..... 1\nx")], "id int, t string"), "id", "t")
    assert [r.name for r in entries.collect()] == ["Cable length"]
    assert [r[0] for r in texts.select(datasheet.value_of("t", "Supply voltage")).collect()] == ["24 V DC", None, None]
    assert apply(spark, lambda c: datasheet.value_of(c, "Range"), ["Range\n 0 to 10 bar", "Range   wide", "Range . . . . . 3"]) == ["0 to 10 bar", "wide", None]
    assert apply(spark, lambda c: datasheet.maker(c, ["Nor", "Norvalis Messtechnik"]), ["von norvalis messtechnik", "Norden", None]) == ["norvalis messtechnik", "", ""]
    assert apply(spark, datasheet.order_code, ["Order No.: 6ES7-131-4BD", "Typ PXC-2891001A", "nichts", None]) == ["6ES7-131-4BD", "PXC-2891001A", "", ""]
    assert datasheet.section_quality(datasheet.parameters(texts, "id", "t"), "id").first().n == 3


def test_circuits(spark):
    box = lambda x, y: [x - 1.0, y - 1.0, x + 1.0, y + 1.0]
    rows = [(1, "A", box(100.0, 20.0), 8.0), (2, "B", box(300.0, 20.0), 8.0), (3, "1", box(20.0, 100.0), 8.0), (4, "2", box(20.0, 400.0), 8.0), (5, "-K1", box(120.0, 110.0), 8.0), (6, "13", box(110.0, 150.0), 4.0), (7, "A0.1", box(130.0, 150.0), 4.0), (8, "L+", box(140.0, 150.0), 4.0), (9, "text", box(110.0, 170.0), 4.0)]
    spans = spark.createDataFrame([("d", 1, *r) for r in rows], "document string, page int, span_id int, text string, box array<double>, size double")
    where = {r.span_id: (r.column, r.row) for r in circuits.grid_positions(spans, circuits.grid(spans)).collect()}
    assert where[5] == ("A", "1")
    pins = circuits.pins(spans, spark.createDataFrame([("d", 1, "k", 120.0, 110.0)], "document string, page int, object_id string, x double, y double")).collect()
    assert [(p.pin, p.address, p.potential) for p in pins] == [("13", "A0.1", "L+")]
    lines = spark.createDataFrame([("d", 1, 1.0, 0.0, 0.0, 10.0, 10.0, 10.0, 200.0), ("d", 1, 1.0, 0.0, 0.0, 10.0, 200.0, 90.0, 200.0), ("d", 1, 0.0, 0.0, 0.0, 0.0, 0.0, 90.0, 200.0)], "document string, page int, red double, green double, blue double, x0 double, y0 double, x1 double, y1 double")
    objects = spark.createDataFrame([("d", 1, "top", 1, [0.0, 0.0, 20.0, 20.0]), ("d", 1, "end", 2, [80.0, 190.0, 100.0, 210.0])], "document string, page int, object_id string, ord int, box array<double>")
    assert {(r.from_object, r.to_object, r.colour) for r in circuits.wires(lines, objects).collect()} in ({("end", "top", "rot")}, {("top", "end", "rot")})
    kinds = circuits.is_diagram(spark.createDataFrame([("a", "STROMLAUFPLAN", 0, 0), ("b", "X", 3, 0), ("c", "X", None, None)], "document string, kind string, n_nodes int, n_tokens int"))
    assert {r.document: r.is_diagram for r in kinds.collect()} == {"a": True, "b": True, "c": False}


def test_placements(spark):
    one = spark.range(1)
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    q = one.select(circuits.quaternion(lit(0, 0, 1), lit(0, 1, 0))).first()[0]
    assert (q.w, q.z) == (pytest.approx(math.sqrt(0.5)), pytest.approx(math.sqrt(0.5)))
    turned = one.select(*circuits.rotate(*lit(q.w, q.x, q.y, q.z), lit(1, 0, 0))).first()
    assert tuple(turned) == pytest.approx((0.0, 1.0, 0.0), abs=1e-9)
    assert tuple(one.select(circuits.quaternion(lit(0, 0, 0), lit(1, 0, 0))).first()[0]) == (1.0, 0.0, 0.0, 0.0)
    joints = spark.createDataFrame([("tank", "x"), ("pipeline", "elbow"), ("elbow", "elbow"), ("a", "b")], "a string, b string").select(circuits.joint(F.col("a"), F.col("b")))
    assert [r[0] for r in joints.collect()] == ["flange", "weld_or_threaded", "direct_fitting", "unknown"]
    links = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 2.0, 0.0), (1.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "fx double, fy double, fz double, dx double, dy double, dz double")
    assert [r.torsion for r in circuits.torsion(links).collect()] == [pytest.approx(90.0), 90.0]


def test_numbers_within_a_large_group(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [("b", 3), ("b", 1), (None, 9), (None, 4)], "g string, o int").repartition(7)
    got = {}
    for r in ordered.number_rows(rows, ["o"], "n", ["g"]).collect():
        got.setdefault(r.g, {})[r.o] = r.n
    assert got["hot"] == {i: i + 1 for i in range(500)} and got["b"] == {1: 1, 3: 2} and got[None] == {4: 1, 9: 2}


def test_document_model(spark):
    records = spark.createDataFrame([("r1", "d", 1, "N1", False), ("r2", "d", 2, "N2", False), ("r3", "e", 1, None, True)], "record string, document string, ord int, display_name string, tabular boolean")
    results = spark.createDataFrame([("r1", "tag", "K1", 1), ("r1", "power", "5 kW", 2), ("r2", "tag", "K2:1", 1), ("r3", "name", "frei", 1)], "record string, field string, value string, ord int")
    evidence = results.select("record", "ord", "field", "value", *[F.lit("").alias(c) for c in ("source", "page", "locator")], F.col("value").alias("snippet"), *[F.lit(0.5).alias(c) for c in ("score", "decision_confidence", "confidence")], F.lit("native_text").alias("kind"), F.lit("").alias("engine"))
    links = spark.createDataFrame([("l1", 1, "d", "K1", "K2:1"), ("l2", 2, "d", "K2:1", "K1"), ("l3", 3, "d", "K1", "none")], "link string, ord int, document string, from_designation string, to_designation string")
    names = spark.createDataFrame([("power", "Power")], "field string, attribute string")
    made = sheets.build(records, results, evidence, links, names, ["tag"])
    assert sheets.violations(made).count() == 0
    assert {(r.designation, r.element_type) for r in made["Element_ID"].collect()} == {("K1", "Contactor"), ("K2:1", "Terminal"), ("r3", "Consumer")}
    assert {(r.attribute, r.normalized, r.unit) for r in made["Element_Data"].collect()} >= {("Power", "5", "kW")}
    assert made["Connection_ID"].count() == 1
    assert {(r.attribute, r.value) for r in made["Connection_Data"].collect()} == {("Connection_Point_From", "K1"), ("Connection_Point_To", "K2:1")}
    assert made["Connection_Data_Source"].count() == 0  # no record is named l1
    assert {(r.item, r.document_id) for r in made["Document_RepresentedItem"].collect()} == {("K1", "d"), ("K2", "d"), ("r3", "e")}
    assert made["Element_RepresentedItem_Mapping"].count() == 3 and made["RepresentedItem_Data"].count() == 4
    assert {(r.class_code, r.element_type) for r in made["Element_Classification"].collect()} == {("K", "Contactor")}
    about = sheets.build(records, results, evidence, links, names, ["tag"], ["Power"], ["name"])
    assert [(r.data_id, r.value) for r in about["Document_Data"].collect()] == [("d/DD.1", "5 kW")] and about["Document_Data_Source"].count() == 2
    assert [(r.document_id, r.value) for r in about["Revision_Data"].collect()] == [("e", "frei")] and about["Revision_Data_Source"].count() == 1
    given = {name: names for name in sheets.GIVEN}
    assert list(sheets.workbook(about, given)) == list(sheets.SHEETS)
    with pytest.raises(ValueError, match="missing sheets"):
        sheets.workbook(about, {})
    empty = sheets.build(*(x.limit(0) for x in (records, results, evidence, links)), names, ["tag"], ["Power"])
    assert all(empty[name].count() == 0 for name in empty)


def test_field_values_and_named_sheets(spark):
    from docweave.operators import extract

    fields = spark.createDataFrame([("power", "Leistung", 1), ("power", "Power", 0), ("medium", "Stoff", 0)], "field string, alias string, ord int")
    pairs = spark.createDataFrame([("r", "leistung", "5 kW", 0.6), ("s", "power", "7 kW", 0.9)], "record string, key string, value string, confidence double")
    hits = spark.createDataFrame([("r", "power", 1, "Power", "6 kW", "", 0.8), ("r", "medium", 2, "", "", "x\nStoff : Öl\n", 0.5), ("r", "medium", 1, "anders", "z", None, 0.9)], "record string, field string, rank int, key string, value string, text string, score double")
    got = {(r.record, r.field): (r.value, r.method) for r in extract.field_values(fields, pairs, hits).collect()}
    assert got == {("r", "power"): ("6 kW", "structured_hit"), ("r", "medium"): ("Öl", "line_hit"), ("s", "power"): ("7 kW", "alias")}
    cells = spark.createDataFrame([("d", "S", 2, 1, "a"), ("d", "S", 2, 2, "b"), ("d", "T", 2, 1, "z")], "document string, sheet string, row int, col int, value string")
    heads = spark.createDataFrame([("d", "S", 1, "LABEL", 1), ("d", "S", 2, "label", 1), ("d", "T", 1, "label", 1)], "document string, sheet string, col int, header string, header_row int")
    assert [(r.field, r.value) for r in extract.extract_named_sheet(cells, heads, spark.createDataFrame([("Label",)], "field string"), "S").collect()] == [("Label", "a")]


def test_graph_connections_routes_and_verdicts(spark):
    from docweave.operators import decide, extract, pages

    nodes = spark.createDataFrame([("d", 1, "a", "X1"), ("d", 1, "b", "K1")], "document string, page int, node_id string, label string")
    edges = spark.createDataFrame([("d", 1, 1, "a", "b", "w", 0.6), ("d", 1, 2, "a", "b", "v", 0.9), ("d", 1, 3, "a", "zz", "w", 0.9)], "document string, page int, ord int, from_node string, to_node string, wire string, confidence double")
    got = extract.graph_connections(edges, nodes, spark.createDataFrame([("X1",), ("K1",), ("X1",)], "token string")).collect()
    assert [(r.from_label, r.to_label, r.wire, r.confidence, r.status) for r in got] == [("X1", "K1", "w", 0.7, "filled")]
    rows = spark.createDataFrame([("1", "pdf"), ("2", "xml"), ("3", None)], "k string, t string")
    routed = decide.route(rows, {"a": F.col("t") == "pdf", "b": F.col("t").isNotNull()})
    assert sorted((r.k, r.source_type) for r in routed.collect()) == [("1", "a"), ("1", "b"), ("2", "b")]
    judged = decide.with_verdicts(rows, spark.createDataFrame([("1", "yes", 0.4), ("1", "no", 0.8)], "k string, verdict string, confidence double"), ["k"])
    assert {r.k: r.verdict for r in judged.collect()} == {"1": "no", "2": "unavailable", "3": "unavailable"}
    blocks = spark.createDataFrame([("d", 1, 1, " x1:2 "), ("d", 1, 2, "PXC4"), ("d", 1, 3, "-K1"), ("d", 1, 4, "7"), ("d", 1, 5, "freier Text"), ("d", 1, 6, None)], "document string, page int, idx int, text string")
    assert {r.idx: r.role for r in pages.detect_parts(blocks).collect()} == {1: "terminal", 2: "module", 3: "device", 4: "port"}
    pairs = spark.createDataFrame([("d", 1, "p", 0.0, 0.0, 0.0, 100.0)], "document string, page int, pair string, ax double, ay double, bx double, by double")
    near = pages.nearest_between(pairs, spark.createDataFrame([("d", 1, "t1", 5.0, 50.0), ("d", 1, "t2", 1.0, 150.0), ("d", 1, "t3", 90.0, 50.0)], "document string, page int, part_id string, x double, y double"))
    assert [r.part_id for r in near.collect()] == ["t1"]
    parts = spark.createDataFrame([("d", 1, "a", "t", "A", [0.0]), ("d", 1, "b", "t", "B", [0.0])], "document string, page int, part_id string, role string, label string, box array<double>")
    traces = spark.createDataFrame([("d", 1, "t1", "a", "v", "b"), ("d", 1, "t2", "a", None, "b"), ("d", 1, "t3", "a", None, None)], "document string, page int, trace string, from_part string, via_part string, to_part string")
    _, links = pages.part_graph(parts, traces)
    assert {(r.trace, r.from_node, r.to_node) for r in links.collect()} == {("t1", "a", "v"), ("t1", "v", "b"), ("t2", "a", "b")}
