"""Record families, review store, audits, scopes and searches by label: edge cases of operators with SQL elsewhere."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as t
from docweave.functions import values as v
from docweave.operators import crosscheck, decide, extract, families, graph, matching, ordered, quality, relational, scoring, store


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_node_records_and_mined_names(spark):
    schema = "document string, node_id string, category string, tag string, attributes map<string,string>, field string"
    nodes = spark.createDataFrame([("d", "n1", "equipment", "P1", {"Design Pressure": "3", "none": ""}, "x"), ("d", "n2", "equipment", None, None, "x"), ("d", "n3", "other", "Q", {}, "x")], schema)
    got = rows(families.node_records(nodes, "equipment", ["tag_name", "Design Pressure", "none"], {"tag_name": "tag"}), "record", "field", "value", "confidence", "status")
    assert got == [("d::n1", "Design Pressure", "3", 0.92, "filled"), ("d::n1", "none", "", 0.0, "blank_no_evidence"), ("d::n1", "tag_name", "P1", 1.0, "filled")]
    assert rows(families.mine_nodes(nodes, ["tag"]), "name", "n") == [("design_pressure", 1), ("none", 1), ("tag", 0)]
    assert families.node_records(nodes.limit(0), "equipment", ["tag_name"], {"tag_name": "tag"}).count() == 0
    assert rows(families.mine_nodes(nodes.limit(0), ["tag"]), "name") == [("tag",)]


def test_page_evidence_finds_what_labels_contain(spark):
    random.seed(9)
    words = ["Pumpe", "P 1", "a", "", None, "Über", "ue", "P1-Pumpe x"]
    blocks = [("d", 1, i, random.choice(words), random.choice([None, 0.2, 0.9])) for i in range(40)] + [("e", 1, 0, "Pumpe", 1.0)]
    frame = spark.createDataFrame(blocks, "document string, page int, idx int, text string, confidence double")
    tags = spark.createDataFrame([("d", w) for w in words] + [("d", "Pumpe"), ("e", "p"), (None, "x")], "document string, tag string")
    label = lambda x: " ".join("".join(c if c.isalnum() else " " for c in (x or "").lower().replace("ü", "u")).split())
    want = []
    for tag in {w for w in words if label(w)}:
        hits = [(p, i, max(0.5, c or 0.0)) for d, p, i, x, c in blocks if d == "d" and label(tag) in label(x)]
        want += [("d", tag, p, i, c, n + 1) for n, (p, i, c) in enumerate(sorted(hits)[:2])]
    want.append(("e", "p", 1, 0, 1.0, 1))
    assert rows(families.page_evidence(tags, frame), "document", "tag", "page", "idx", "score", "rank") == sorted(want, key=repr)


def test_overlay_and_injection(spark):
    evidence = spark.createDataFrame([("a", 2, "ok", "g2"), ("a", 1, "ok", "g1"), ("b", 1, "gone", "g3"), ("c", 1, None, ""), (None, 1, "ok", "g4")], "tag string, ord int, status string, global_id string")
    tags = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("z",)], "tag string")
    got = rows(families.overlay(tags, evidence, {"gone": "missing"}), "tag", "status", "global_id")
    assert got == [("a", "present", "g1"), ("b", "missing", "", ), ("c", "unknown", ""), ("z", "unknown", "")]
    have = spark.createDataFrame([("A-1", 1), (None, 2)], "tag string, n int")
    extra = spark.createDataFrame([("a1", "x"), ("b2", "y"), ("b2", "y")], "tag string, note string")
    assert rows(families.inject(have, extra, "tag"), "tag", "n", "note") == [("A-1", 1, None), ("b2", None, "y"), ("b2", None, "y"), (None, 2, None)]
    filled = families.last_filled(spark.createDataFrame([("k", 1, "a", None), ("k", 2, " ", "b"), ("", 3, "c", "c"), (None, 4, "d", "d")], "k string, o int, x string, y string"), "k", "o", ["x", "y"])
    assert rows(filled, "k", "x", "y") == [("k", "a", "b")]
    assert families.united({"s": have, "t": extra}, ["tag", "note"]).count() == 5


def test_routing_and_declared_values(spark):
    fields = spark.createDataFrame([("Process: a", 1), (" Druck ", 2), (None, 3), ("x", 4)], "field string, sheet_no int")
    aliases = spark.createDataFrame([("druck", "p"), ("DRUCK", "q"), (None, "r")], "alias string, canonical string")
    sheets = spark.createDataFrame([("p", "S1"), ("q", "S0")], "canonical string, sheet string")
    assert rows(families.route_fields(fields, aliases, sheets), "sheet_no", "sheet") == [(1, "Process_Attributes"), (2, "S0"), (3, None), (4, None)]
    nodes = spark.createDataFrame([("n", {"a": "1", "b": "9", "c": "z"}), ("m", None)], "node_id string, attributes map<string,string>")
    declared = spark.createDataFrame([("a", ["1", "2"]), ("b", ["1"]), ("c", [])], "name string, enumeration array<string>")
    assert rows(families.undeclared_values(nodes, declared), "node_id", "name", "value") == [("n", "b", "9")]


def test_scan_errors(spark):
    frame = spark.createDataFrame([("P10.A", 1), ("ab", 0), (None, 0), ("", 5)], "x string, p int")
    got = {r.x: [(e.text, e.kind) for e in r.e] for r in frame.select("x", families.scan_errors("x", F.col("p")).alias("e")).collect()}
    assert got["P10.A"] == [("P10A", "exact"), ("PI0A".replace("I", "I"), "substitution"), ("P0A", "deletion"), ("P110A", "insertion")]
    assert got["ab"] == [("AB", "exact")] and got[None] == [("", "exact")]


def test_store_tables(spark, tmp_path):
    path = str(tmp_path / "store")
    store.create(spark, path)
    feedback = spark.createDataFrame([(1, "r", "f", "ok", None, None)], store.SCHEMA["review_feedback"])
    store.append(feedback, f"{path}/review_feedback")
    store.append(spark.createDataFrame([(1, "r", "f", "d", "R", "open")], store.SCHEMA["records"]), f"{path}/records")
    store.create(spark, path)
    assert store.read(spark, path, "records").count() == 1
    store.reset(spark, path)
    assert store.read(spark, path, "records").count() == 0 and store.read(spark, path, "review_feedback").count() == 1


def test_review_rows(spark):
    records = spark.createDataFrame([("r1", "f", "d1", "One"), ("r2", "g", "d2", None)], "record string, family string, document string, display_name string")
    results = spark.createDataFrame([("r1", "a", "50%", "filled", "e"), ("r1", "b", None, None, None), ("r2", "a", "x", "filled", "e"), ("r3", "a", "x", "", "")], "record string, field string, value string, status string, evidence string")
    feedback = spark.createDataFrame([(1, "r1", "a", "old"), (2, "r1", "a", "new")], "id int, record string, field string, status string")
    assert rows(store.review_rows(records, results, feedback), "record", "field", "feedback_status") == [("r1", "a", "new"), ("r1", "b", "not_reviewed"), ("r2", "a", "not_reviewed")]
    assert rows(store.review_rows(records, results, feedback, "f", "NEW"), "record", "field") == [("r1", "a")]
    page = store.page_payload(results, ["record", "field"], 1, 2)
    assert rows(page, "record", "total") == [("r1", 4), ("r2", 4)]
    assert store.page_payload(results.limit(0), ["record"], 0, 5).count() == 0


def test_audits(spark):
    got = rows(quality.sheet_presence(["B", "A", "X"], ["A", "B", "C"], spark), "rule", "sheet")
    assert got == [("sheet_extra", "X"), ("sheet_missing", "C"), ("sheet_order", "A"), ("sheet_order", "B")]
    assert quality.sheet_presence([], [], spark).count() == 0
    frame = spark.createDataFrame([("a", None), ("a", None), ("b", "1")], "x string, y string")
    assert rows(quality.composite_key(frame, "s", ["x", "y"]), "key", "message") == [("a/", "2 rows")]
    found = quality.semantic_audit(frame, "s", "x", {"no_y": F.col("y").isNull(), "never": F.lit(None).cast("boolean")})
    assert rows(found, "rule", "key") == [("no_y", "a"), ("no_y", "a")]


def test_groups_and_dispatch(spark):
    frame = spark.createDataFrame([("k", 0.5, True, "b", 2), ("k", None, None, "a", 1), ("k", 0.9, False, "b", 3), ("k", 0.1, False, "", 0), (None, None, None, None, None)], "k string, c double, r boolean, t string, o int")
    got = rows(decide.group_summary(frame, ["k"], "c", F.col("r"), "t", "o", 2), "k", "n", "least", "mean", "needs_review", "first_texts")
    assert got == [("k", 4, 0.1, 0.5, True, "a | b"), (None, 1, None, None, False, "")]
    named = spark.createDataFrame([("A-1", None), (" ", "b"), (None, None), ("-", "c")], "one string, two string")
    assert rows(decide.group_rows(named, ["one", "missing", "two"]), "identity") == [("a1",), ("b",), ("c",)]
    made = decide.dispatch(frame, "k", {"k": lambda x: x.select("t"), "none": lambda x: x.select("t")})
    assert made.count() == 4 and made.columns == ["t", "k"]


def test_whole_words_and_scopes(spark):
    cases = [("Ventil-A 12", "ventil", True), ("Ventile", "ventil", False), ("a.b", "a.", True), ("5 %", "%", True), ("xSILx", "SIL", False), ("größe 3", "GRÖßE", True), ("grös", "gr", False), (None, "a", False), ("a", None, False), ("a", " ", False), ("a  b", "a b", True)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, v string, want boolean")
    assert [r.g for r in frame.select("i", relational.holds_whole("t", "v").alias("g")).orderBy("i").collect()] == [c[2] for c in cases]
    exact = frame.select("i", relational.requires_exact(F.lit("f"), "v", ["F"]).alias("g"), relational.requires_exact(F.lit(None), "t", []).alias("h")).orderBy("i").collect()
    assert all(r.g for r in exact) and [r.h for r in exact[:5]] == [True, False, True, True, False]
    asked = spark.createDataFrame([(1, "d", "p"), (2, "d", "q"), (3, "e", "p")], "id int, document string, page string")
    texts = spark.createDataFrame([("d", "p", 10), ("d", "p", 11), ("d", "r", 12)], "document string, page string, text_id int")
    assert rows(relational.scoped_texts(asked, texts, ["page"]), "id", "text_id") == [(1, 10), (1, 11), (2, 10), (2, 11), (2, 12)]


def test_scopes_are_counted_without_pairs(spark):
    asked = spark.createDataFrame([(1, "d", "p"), (1, "d", "r"), (2, "d", "q"), (3, "e", "p"), (None, "d", "q"), (4, "d", "p")], "id int, document string, page string")
    texts = spark.createDataFrame([("d", "p", 10), ("d", "p", 11), ("d", "r", 12), ("d", None, 13), (None, "p", 14)], "document string, page string, text_id int")
    pairs = relational.scoped_texts(asked, texts, ["page"]).groupBy("id").count().collect()
    counted = relational.scoped_counts(asked, texts, ["page"])
    assert {(r.id, r.n) for r in counted.collect()} == {(r[0], r[1]) for r in pairs} == {(1, 3), (2, 4), (None, 4), (4, 2)}
    many = spark.range(60_000).selectExpr("cast(id as int) id", "'d' document", "'p' page")
    counts = relational.scoped_counts(many, many.withColumnRenamed("id", "text_id"), ["page"])  # 3.6 billion pairs
    assert [tuple(r) for r in counts.agg(F.count("id"), F.min("n"), F.max("n")).collect()] == [(60_000, 60_000, 60_000)]


def test_labels_meet_by_pieces(spark):
    random.seed(2)
    words = ["".join(random.choice("ab c") for _ in range(random.randint(0, 7))) for _ in range(60)]
    left, right = words[:25], words[25:]
    got = {(r.field, r.header) for r in matching.match_fields(spark.createDataFrame([(x,) for x in left], "field string"), spark.createDataFrame([(x,) for x in right], "header string")).collect()}
    fold = lambda x: " ".join(x.split())
    assert got == {(a, b) for a in left for b in right if fold(a) and fold(b) and (fold(a) in fold(b) or fold(b) in fold(a))}


def test_overlaps_of_boxes_of_any_size(spark):
    random.seed(4)
    boxes = []
    for i in range(150):
        w, h = (10 ** random.uniform(-1, 4) for _ in range(2))
        x, y = random.uniform(-50, 50), random.uniform(-50, 50)
        boxes.append((random.choice(["p", None]), i, [x, y, x + w, y + h]))
        boxes.append((boxes[-1][0], 1000 + i, [x + w * random.uniform(-0.3, 0.3), y, x + w * random.uniform(0.7, 1.3), y + h * random.uniform(0.6, 1.4)]))
    boxes += [("p", 5000, [0.0, 0.0, 0.0, 5.0]), ("p", 5001, [0.0, 0.0, 0.0, 5.0])]

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(0, w) * max(0, h)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) if both else 0

    want = {(a, b) for p, a, x in boxes for q, b, y in boxes if p == q and a < b and iou(x, y) >= 0.45}
    found = graph.overlap_pairs(spark.createDataFrame(boxes, "page string, box_id int, box array<double>"), ["page"])
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_nearest_label(spark):
    names = spark.createDataFrame([("n1", [1.0, 0.1]), ("n2", [0.0, 0.0]), ("n3", None), ("n4", [1.0])], "name string, vector array<double>")
    corpus = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0]), ("c", None)], "label string, vector array<double>")
    assert {(r.name, r.label, round(r.similarity, 3)) for r in scoring.nearest_label(names, corpus).collect()} == {("n1", "b", 0.995), ("n2", "a", 0.0)}
    assert scoring.nearest_label(names, corpus.limit(0)).count() == 0
    attributes = crosscheck.vector_names(names, corpus.withColumnRenamed("label", "attribute"), names.where("name = 'n1'").select("name"))
    assert rows(attributes, "name", "attribute") == [("n1", "n1"), ("n2", "n2"), ("n3", "n3"), ("n4", "n4")]


def test_assemblies_in_order(spark):
    steps = [("a", i, f"c{i}", float(i), 0.0, float(i % 2)) for i in range(12)] + [(None, 1, "x", 0.0, 0.0, 0.0), (None, 2, "y", 1.0, 0.0, 0.0), ("one", 1, "z", 0.0, 0.0, 0.0)]
    frame = spark.createDataFrame(steps, "assembly string, no int, id string, x double, y double, z double")
    links = graph.assembly_links(frame)
    assert rows(links.where("assembly is null"), "from_id", "to_id", "distance") == [("x", "y", 1.0)]
    assert links.where("assembly = 'a'").count() == 11 and graph.bend_angles(links).where("assembly = 'a'").count() == 10
    parents = {r.id: r.parent_id for r in graph.running_parent(frame, F.col("no") % 5 == 0).collect()}
    assert parents["c0"] is None and parents["c1"] == "c0" and parents["c5"] == "c0" and parents["c6"] == "c5" and parents["x"] is None and parents["z"] is None
    assert graph.assembly_links(frame.limit(0)).count() == 0


def test_pairs_windows_and_boxes(spark):
    pairs = spark.createDataFrame([("d", 1, 0, 1, "A", "x"), ("d", 1, 1, 0, " a", "X "), ("d", 1, 1, 1, "b", None), ("d", 1, 0, 0, None, "y")], "document string, page int, engine_ord int, idx int, key string, value string")
    assert rows(extract.merged_pairs(pairs), "key", "value") == [("A", "x"), ("b", "")]
    frame = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, "a", "p"), (4, "a", "q")], "n int, k string, g string")
    got = {r.n: list(r.w) for r in ordered.ordinal_window(frame, "n", "k", 1, [], ["n"], "w").collect()}
    assert got == {1: [1, 3], 3: [1, 3, 4], 4: [3, 4], 2: [2]}
    box = spark.createDataFrame([([0.0, 0.0, 2.0, 2.0], [1.0, -1.0, 3.0, 1.0])], "a array<double>, b array<double>")
    assert box.select(v.box_expand(v.box_union(F.col("a"), F.col("b")), 1.0)).first()[0] == [-1.0, -2.0, 4.0, 3.0]


def test_identifiers_of_an_array(spark):
    frame = spark.createDataFrame([(["A-1", "", "Ü/2", "--"],), ([],), (None,)], "x array<string>")
    assert [r[0] for r in frame.select(t.normalize_identifiers("x")).collect()][:2] == [["a1", "u2"], []]


@pytest.mark.parametrize("chain", [40])
def test_greedy_choice_of_a_long_chain(spark, chain):
    # each pair loses to the one before it, so every round settles one
    pairs = []
    for i in range(chain):
        pairs += [(f"s{i:03}", f"t{i:03}", 1.0 - 2 * i / 1000), (f"s{i + 1:03}", f"t{i:03}", 1.0 - (2 * i + 1) / 1000)]
    frame = spark.createDataFrame(pairs, "source_key string, target_key string, score double")
    got = {(r.source_key, r.target_key) for r in matching.greedy_pairs(frame).collect()}
    assert got == {(f"s{i:03}", f"t{i:03}") for i in range(chain)}
