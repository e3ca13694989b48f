"""Retrieval, extraction, rules, sources, pages, streaming: plain versions and edge cases."""

import json
import math
import random
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docweave.operators import chunks, extract, pages, relational, retrieval, scoring
from docweave.plans import rules
from docweave.plans.relation_queries import PROFILE, RULE_SET
from docweave.sources import files, plant_xml, settings, step, terminals, workbook
from docweave.streaming import jobs

# ---------------------------------------------------------------- retrieval


def terms(text):
    words = re.findall(r"[^\W]{2,}", (text or "").lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def unit(weights):
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {t: w / norm for t, w in weights.items()} if norm else {}


DOCS = {1: "Pumpe TU10F17-5 im Pumpenraum", 2: "Ventil X1:12/L1 am Tank", 3: "Pumpe und Ventil", 4: "", 5: None, 6: "TU10F17-5", 7: "öl öl pumpe"}
QUERIES = {10: "Pumpe TU10F17-5", 11: "nichts davon", 12: "", 13: "Ventil am Tank"}


def test_hybrid_scores_against_a_plain_scorer(spark):
    chunk_rows = spark.createDataFrame(list(DOCS.items()), "c_id int, c_text string")
    query_rows = spark.createDataFrame(list(QUERIES.items()), "q_id int, q_text string")
    got = {(r.q_id, r.c_id): (r.exact, r.tags, r.tfidf, r.lexical, r.score) for r in retrieval.hybrid_scores(query_rows, chunk_rows).collect()}
    df = Counter(t for x in DOCS.values() for t in set(terms(x)))
    idf = {t: math.log((1 + len(DOCS)) / (1 + n)) + 1 for t, n in df.items()}
    tokens = {i: r.t for i, r in enumerate(spark.createDataFrame([(x,) for x in [*DOCS.values(), *QUERIES.values()]], "x string").select(retrieval.component_tokens("x").alias("t")).collect())}
    tags = {k: {re.sub("[^a-z0-9]", "", t.lower()) for t in tokens[i]} for i, k in enumerate([*DOCS, *QUERIES])}

    def vector(x):
        return unit({t: n * idf[t] for t, n in Counter(terms(x)).items() if t in idf})

    def plain(x):
        return re.sub(r"[^a-z0-9]+", " ", (x or "").lower().replace("ö", "o")).split()

    for q, qt in QUERIES.items():
        for c, ct in DOCS.items():
            a, b = vector(qt), vector(ct)
            tf = sum(w * b.get(t, 0) for t, w in a.items())
            a, b = unit(Counter(plain(qt))), unit(Counter(plain(ct)))
            lex = sum(w * b.get(t, 0) for t, w in a.items())
            qi, ci = tags[q] | {"".join(plain(qt))}, tags[c] | ({"".join(plain(ct))} if len("".join(plain(ct))) <= 40 else set())
            exact = 1.0 if (qi & ci) - {""} else 0.0
            tag = len(tags[q] & tags[c]) / len(tags[q] | tags[c]) if tags[q] and tags[c] else 0.0
            total = min(1.0, 0.35 * exact + 0.15 * tag + 0.25 * tf + 0.15 * lex)
            if total > 0:
                assert got[q, c] == pytest.approx((exact, tag, tf, lex, total), abs=6e-5), (q, c)
            else:
                assert (q, c) not in got


def test_searches_find_the_best_of_all_scored_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = "pumpe ventil tank TU10F17-5 X1:12/L1 öl druck im am und HC12 leer".split()
    texts = [None, "", "  ", *(" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(60))]
    chunk_rows = spark.createDataFrame([(i, x, ["a", "b", None][i % 3], "clash") for i, x in enumerate(texts)], "c_id int, c_text string, c_kind string, q_id string")
    query_rows = spark.createDataFrame([(100 + i, x, ["a", None][i % 2]) for i, x in enumerate(texts[:20])], "q_id bigint, q_text string, q_kind string")
    every = {(r.q_id, r.c_id): r for r in retrieval.hybrid_scores(query_rows, chunk_rows).collect()}
    for queries, terms, rows in ((1_000, 10**6, 1_000), (3, 10**6, 7), (1_000, 40, 1_000)):
        monkeypatch.setattr(scoring, "BLOCK_QUERIES", queries)
        monkeypatch.setattr(scoring, "BLOCK_TERMS", terms)
        monkeypatch.setattr(scoring, "SLICE_ROWS", rows)
        for filters in ((), ("kind",)):
            got = {}
            for r in retrieval.hybrid_search(query_rows, chunk_rows, 4, filters).collect():
                got.setdefault(r.q_id, []).append((r["rank"], r.c_id, r.score))
            asked = {r.q_id: r.q_kind for r in query_rows.where("trim(q_text) <> ''").collect()}
            assert set(got) == set(asked)
            for q, kind in asked.items():
                free = [i for i in range(len(texts)) if not filters or kind is None or ["a", "b", None][i % 3] == kind]
                prior = 0.05 if filters and kind else 0.0
                full = sorted((-min(1.0, (every[q, c].score if (q, c) in every else 0.0) + prior), c) for c in free)[:4]
                assert [c for _, c, _ in sorted(got[q])] == [c for _, c in full] or [s for *_, s in sorted(got[q])] == pytest.approx([-s for s, _ in full], abs=2e-4)
        best = retrieval.tfidf_search(query_rows, chunk_rows, 3, 4).collect()
        for r in best:
            assert r.tfidf == pytest.approx(every[r.q_id, r.c_id].tfidf, abs=1e-4) and r.tfidf > 0
    assert retrieval.hybrid_search(query_rows.limit(0), chunk_rows, 3).count() == 0
    assert retrieval.hybrid_search(query_rows, chunk_rows.limit(0), 3).count() == 0
    assert retrieval.tfidf_search(query_rows, chunk_rows.limit(0), 3).count() == 0


def test_nearest_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_QUERIES", 4)
    rng = random.Random(6)
    rows = [(f"v{i:03}", [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(60)] + [("n", None), ("short", [1.0]), ("zero", [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "v_id string, vector array<float>")
    found = retrieval.cosine_search(vectors.where("v_id < 'v010' and v_id >= 'v'").withColumnRenamed("v_id", "q_id"), vectors, 5).collect()
    held = {k: v for k, v in rows if v and len(v) == 3}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b)) if any(a) and any(b) else 0.0
    for q in [f"v{i:03}" for i in range(10)]:
        want = sorted((-round(cosine(held[q], v), 6) + 0.0, k) for k, v in held.items() if k != q)[:5]
        assert [(r.v_id, r.similarity) for r in sorted(found, key=lambda r: r["rank"]) if r.q_id == q] == [(k, pytest.approx(-s, abs=1e-6)) for s, k in want]
    assert retrieval.cosine_search(vectors.limit(0).withColumnRenamed("v_id", "q_id"), vectors, 5).count() == 0


def test_bundles(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 1.0, 1), (1, "b", 0.1, 0.0, 2), (1, "c", 0.5, 0.0, 3)], "q_id int, c_id string, score double, exact double, rank int")
    got = retrieval.bundles(hits).first()
    assert (got.hit_ids, got.support, got.contradiction, got.top_score) == (["a", "b", "c"], ["a", "c"], ["b"], 0.9)


def test_shared_identifiers_pairs_and_star(spark):
    rows = spark.createDataFrame([(i, i, "d", "Kabel X1:1") for i in range(6)] + [(9, 9, "d", None)], "c_id int, ord int, document string, c_text string")
    assert retrieval.shared_identifier_edges(rows).count() == 15
    star = retrieval.shared_identifier_edges(rows, hot=3).collect()
    assert {(r.from_id, r.to_id) for r in star} == {(0, i) for i in range(1, 6)}
    assert retrieval.same_document_edges(rows).count() == 6


def test_shared_identifiers_of_many_chunks(spark):
    rows = spark.createDataFrame([(i, -i, "d", "Kabel X1:1") for i in range(150)], "c_id int, ord int, document string, c_text string")
    every = {(i, j) for i in range(150) for j in range(i)}
    for found in (retrieval.shared_identifier_edges(rows), retrieval.shared_identifier_edges(rows, tile=20)):
        got = [(r.from_id, r.to_id) for r in found.collect()]
        assert len(got) == len(every) and set(got) == every


def test_cosine_search_in_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)] + [(99, [0.0, 0.0, 0.0])], "v_id int, vector array<double>")
    got = retrieval.cosine_search(vectors.where("v_id < 3").withColumnRenamed("v_id", "q_id"), vectors, 2).collect()
    assert len(got) == 6 and all(r.similarity <= 1.0000001 for r in got)


# ---------------------------------------------------------------- chunks and extraction


def test_chunks(spark):
    cells = spark.createDataFrame([("d", "f", "S", 1, 1, "Tag"), ("d", "f", "S", 1, 2, "Wert"), ("d", "f", "S", 2, 1, "X1"), ("d", "f", "S", 2, 2, " 5 "), ("d", "f", "S", 3, 3, "q"), ("d", "f", "S", 4, 1, "")], "document string, family string, sheet string, row int, col int, value string")
    heads = workbook.header_map(cells, spark.createDataFrame([("d", "S", 1)], "document string, sheet string, header_row int"))
    got = {r.locator: r.text for r in chunks.sheet_row_chunks(cells, heads).collect()}
    assert got["S!2"] == "Sheet S row 2. Tag: X1; Wert: 5" and "S!1" not in got
    lines = chunks.line_chunks(spark.createDataFrame([(1, "a\r\n\r\n b  c \rd"), (2, None), (3, "")], "id int, t string"), "id", "t")
    assert [(r.id, r.line_no, r.text) for r in lines.orderBy("id", "line_no").collect()] == [(1, 1, "a"), (1, 3, "b c"), (1, 4, "d")]


def test_tabular_extraction(spark):
    cells = spark.createDataFrame([("d", "S", 2, 1, "X1"), ("d", "S", 2, 2, "5"), ("d", "S", 2, 3, "6"), ("d", "S", 3, 2, " ")], "document string, sheet string, row int, col int, value string")
    heads = spark.createDataFrame([("d", "S", 1, "Tag-Name", 1), ("d", "S", 2, "Wert A", 1), ("d", "S", 3, "Wert B", 1)], "document string, sheet string, col int, header string, header_row int")
    fields = spark.createDataFrame([("tag", "Tag Name", False), ("wert", "", True)], "field string, alias string, repeatable boolean")
    got = {r.field: (r.row, r.value, r.evidence) for r in extract.extract_tabular(cells, heads, fields).collect()}
    assert got == {"tag": (2, "X1", "1:2"), "wert": (2, "5 | 6", "2:2")}
    whole = extract.complete_fields(spark.createDataFrame([("r",)], "record string"), spark.createDataFrame([("r", "tag", "X1", 1.0)], "record string, field string, value string, confidence double"), fields)
    assert {(r.field, r.status) for r in whole.collect()} == {("tag", "filled"), ("wert", "blank_no_evidence")}


def test_key_value_blocks(spark):
    texts = ["Projekt:", "Kunde:", "Neubau", "Datum: 1.1.2020", "datum: 1.1.2020", "Ort : ", "kein Paar", None]
    blocks = spark.createDataFrame([("d", 1, i, x) for i, x in enumerate(texts)], "document string, page int, idx int, text string")
    got = {(r.key, r.value) for r in extract.block_pairs(blocks).collect()}
    assert got == {("projekt", "Neubau"), ("kunde", "Neubau"), ("Datum", "1.1.2020")}
    row = "document string, ord int, key string, value string, confidence double"
    tables, pairs = spark.createDataFrame([("d", 1, "A", "1", 0.5), ("d", 2, "a", "2", 0.9)], row), spark.createDataFrame([("d", 1, "B", "x", 0.7), ("d", 2, "b", "y", 0.2)], row)
    lines = spark.createDataFrame([("d", 1, "b : z", 0.9), ("d", 2, "Ort: w", 0.9)], "document string, ord int, text string, confidence double")
    assert {(r.key, r.value, r.confidence) for r in extract.collect_pairs(tables, pairs, lines).collect()} == {("a", "1", 0.6), ("b", "y", 0.6), ("ort", "w", 0.9)}


def test_text_connections(spark):
    blocks = spark.createDataFrame([("d", 1, 1, "X1:1 nach X2:2 und K10"), ("d", 1, 2, "X1:1 X2:2"), ("d", 1, 3, "leer"), ("d", 1, 4, None)], "document string, page int, idx int, text string")
    got = {(r.from_token, r.to_token): (r.confidence, r.status) for r in extract.text_connections(blocks, spark.createDataFrame([("X1:1",)], "token string")).collect()}
    assert got["X1:1", "X2:2"] == (0.7, "filled") and all(c >= 0.45 for c, _ in got.values())


def test_artifacts_keep_long_texts(spark):
    records = spark.createDataFrame([("r", "d", False, "R"), ("s", "d", True, "S"), ("t", "d", True, "T")], "record string, document string, tabular boolean, display_name string")
    fields = "record string, ord int, field string, value string, source string, page string, locator string, snippet string, score double, decision_confidence double, confidence double, kind string, engine string"
    long = "x" * 600
    texts = [("r", 1, "", f"{long}1"), ("r", 2, "", f"{long}2"), ("s", 1, f"{long}3", ""), ("t", 1, f"{long}4", "")]
    evidence = spark.createDataFrame([(r, n, "tag", v, "a.pdf", "1", "", snippet, 0.0, 0.0, 0.8, "native_text", "") for r, n, v, snippet in texts], fields)
    found, links = relational.objects(relational.artifacts(records, evidence))
    assert {r.text for r in found.collect()} == {f"{long}{i}" for i in range(1, 5)} and links.count() == 4


def test_artifacts_and_links(spark):
    records = spark.createDataFrame([("r", "d", False, "R"), ("s", "d", True, "S"), ("t", "d", False, "T")], "record string, document string, tabular boolean, display_name string")
    fields = "record string, ord int, field string, value string, source string, page string, locator string, snippet string, score double, decision_confidence double, confidence double, kind string, engine string"
    evidence = spark.createDataFrame(
        [("r", 1, "tag", "X1", "a.pdf", "1", "", "Klemme X1", 0.0, 0.0, 0.8, "native_text", ""), ("r", 2, "tag", "X1", "a.pdf", "1", "", "Klemme X1", 0.9, 0.0, 0.8, "native_text", ""),
         ("s", 1, "a", "v1", "b.xlsx", "S", "", "", 0.0, 0.0, 0.5, "cell", ""), ("s", 2, "b", "v2", "b.xlsx", "S", "", "", 0.0, 0.0, 0.7, "cell", ""), ("t", 1, "bbox", "1,2,3,4", "", "", "", "1,2,3,4", 0.0, 0.0, 0.5, "", "")], fields)
    found, links = relational.objects(relational.artifacts(records, evidence))
    texts = {r.text: (r.operation, r.method, r.confidence) for r in found.collect()}
    assert texts["Klemme X1"] == ("Tj", "Native_Text", 0.8) and texts["v1 | v2"] == ("Cell", "Native_Table_Row", 0.5)
    assert texts["No source text for T; requires review."][1] == "Manual_Review_Required" and len(texts) == 3 and links.count() == 3
    sources = relational.field_sources(
        spark.createDataFrame([("r", "f", "d", "X1"), ("r", "g", "d", "X"), ("r", "bbox", "d", "X1")], "record string, field string, document string, value string"),
        spark.createDataFrame([("A", "d", "Klemme X1 frei", "Tj", 0.9), ("B", "d", "X1", "Cell", 0.5)], "artifact_id string, document string, text string, operation string, confidence double"),
    )
    assert [(r.field, r.artifact_id) for r in sources.collect()] == [("f", "B")]


def test_elements_and_consolidation(spark):
    records = spark.createDataFrame([("d", "r1", 1, "N"), ("d", "r2", 2, "N"), ("d", "r3", 3, "")], "document string, record string, ord int, display_name string")
    results = spark.createDataFrame([("r1", "tag", "K1", 1), ("r2", "tag", "K1", 1), ("r3", "tag", "tag", 1)], "record string, field string, value string, ord int")
    top = relational.top_down_elements(records, results, ["tag"])
    assert {(r.record, r.designation) for r in top.collect()} == {("r1", "K1"), ("r2", "K1:2")}
    both = relational.consolidate(top, records)
    assert {(r.record, r.status) for r in both.collect()} == {("r1", "Matched"), ("r2", "Matched"), ("r3", "Only_Cluster")}


# ---------------------------------------------------------------- rules


def evaluate(rows):
    """The example rules, plainly."""
    states = list(dict.fromkeys(r["o_orderstatus"] for r in rows if r["o_orderstatus"]))
    first = next((r["o_orderpriority"] for r in rows if r["o_orderpriority"]), "")
    found = re.search("^([0-9]+)", first)
    urgency = {"1": "urgent", "2": "high"}.get(found[1] if found else "0", "other")
    n = sum(bool(r["o_orderkey"]) for r in rows)
    return ["|".join(states), urgency, f"{'many' if n >= 10 else 'few'}|{urgency}", "|".join(states) if n >= 5 else "too_few"]


def test_rules_against_a_plain_evaluator(spark):
    rows = [{"o_custkey": f"c{i % 4}", "o_orderstatus": "OFP "[i % 4 - i % 3].strip(), "o_orderpriority": ["", "1-URGENT", "2-HIGH", "5"][i % 4], "o_orderkey": str(i)} for i in range(23)] + [{"o_custkey": "", "o_orderstatus": None, "o_orderpriority": None, "o_orderkey": ""}]
    frame = spark.createDataFrame([(*r.values(), i) for i, r in enumerate(rows)], "o_custkey string, o_orderstatus string, o_orderpriority string, o_orderkey string, ord int").repartition(5)
    names = ["States", "Urgency", "Summary", "Gated"]
    got = {r.identity: [r[f"Orders.{n}"] for n in names] for r in rules.rule_values(frame, RULE_SET, "ord").collect()}
    for key in {r["o_custkey"] for r in rows}:
        assert got[key or "orders"] == evaluate([r for r in rows if r["o_custkey"] == key]), key
    document = {r.identity: r for r in rules.run_rules(frame, RULE_SET, "ord").collect()}
    payload = json.loads(document["c1"].payload)
    assert {e["idShort"]: e["value"] for e in payload["submodels"][0]["submodelElements"]} == dict(zip(names, got["c1"], strict=True))
    assert document["orders"].gates == ["Orders.Gated"]


def test_rule_checks():
    codes = lambda payload: {i.code for i in rules.validate(rules.Graph.parse(payload))}
    assert codes(RULE_SET) == set()
    assert codes({}) == {"missing_output_submodel"}
    bad = {"nodes": [{"id": "a", "node_type": "InputColumn"}, {"id": "a", "node_type": "What"}, {"id": "o", "node_type": "OutputProperty"}], "edges": [{"id": "e", "from_node": "a", "to_node": "zz"}]}
    assert codes(bad) == {"duplicate_node_id", "missing_input_field", "unsupported_node_type", "missing_property_name", "missing_to_node", "missing_output_submodel", "unbound_output_property"}
    loop = {"nodes": [{"id": "a", "node_type": "Concat"}, {"id": "b", "node_type": "Concat"}, {"id": "m", "node_type": "OutputSubmodel", "config": {"id_short": "M"}}], "edges": [{"from_node": "a", "to_node": "b"}, {"from_node": "b", "to_node": "a"}]}
    assert codes(loop) == {"cycle_detected"}
    assert [k for k, _ in rules.trace(RULE_SET, "o4")] == ["o4", "gate", "status", "count"]


def test_invalid_rules_give_an_empty_document(spark):
    rows = spark.createDataFrame([("x", 1)], "k string, ord int")
    got = rules.run_rules(rows, {"identity_fields": ["k"], "nodes": []}, "ord").first()
    assert got.gates == ["missing_output_submodel"] and json.loads(got.payload)["submodels"] == []


def test_profiles(spark):
    rows = spark.createDataFrame([("A b", "Brand#12"), (None, "x")], "p_name string, p_brand string")
    assert {tuple(r) for r in rules.run_profile(rows, PROFILE).collect()} == {("ab", "Brand#12/A b", "first", ""), ("", "x", "", "")}
    signature = {"id": "p", "signature": {"sheet_names": ["Liste"], "required_headers": ["Tag", "Wert"], "optional_headers": ["Ort"]}}
    assert rules.match_profile(signature, {"Liste": ["Tag", "Wert"]}) == 0.9
    assert rules.match_profile(signature, {"X": ["Tag"]}) == 0.0
    assert rules.resolve_profile([signature, signature | {"id": "q"}], {"Liste": ["Tag"]})[0]["id"] == "p"


# ---------------------------------------------------------------- sources


def write_workbook(path, sheets):
    """A minimal workbook with inline and shared strings."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = sorted({v for rows in sheets.values() for row in rows for v in row if isinstance(v, str) and v})
    with zipfile.ZipFile(path, "w") as book:
        names = list(sheets)
        book.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for i, n in enumerate(names):
            body = ""
            for r, row in enumerate(sheets[n], 1):
                cells = "".join(f'<c r="{chr(64 + c)}{r}" t="s"><v>{shared.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{chr(64 + c)}{r}"><v>{v}</v></c>' for c, v in enumerate(row, 1) if v not in ("", None))
                body += f'<row r="{r}">{cells}</row>'
            book.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbook_and_terminal_list(spark, tmp_path):
    sheet = [
        ["Verschaltungsliste Schrank - 24 Volt"], ["PLT-Stelle", "Funktion", "Klemmleiste X1.2", "Zugang E-Schrank"], ["TU10.F1", "messen", "1", "a"], ["TU10.F2", '"', "2/L1", "b"],
        ["Spannungsversorgung neu"], ["TU10.F3", "", "Kanal 4", ""], ["", "", "", "x"], [None, "ohne", 7, ""],
    ]
    write_workbook(tmp_path / "liste.xlsx", {"S": sheet, "leer": []})
    cells = workbook.workbook_cells(spark, str(tmp_path / "*.xlsx"))
    assert cells.where("coord = 'C2'").first().value == "Klemmleiste X1.2"
    assert workbook.header_rows(cells).first().header_row == 2
    heads = workbook.header_map(cells, workbook.header_rows(cells))
    assert workbook.row_records(cells, heads).where("row = 3").first().fields["Funktion"] == "messen"
    got = {r.row: (r.layer, r.object_ref, r.terminal, r.function, r.attribute_value) for r in terminals.terminal_rows(cells).collect()}
    assert got[3] == ("Allgemein", "-X1.2", "1", "messen", "") and got[4] == ("Allgemein", "-X1.2", "2/L1", "messen", "L1")
    assert got[6] == ("Spannungsversorgung neu", "-X1.2", "Kanal 4", "", "SPS-Kanal") and got[8][2] == "7" and 7 not in got


def test_layer_labels(spark):
    frame = spark.createDataFrame([("Verschaltungsliste MSR-Schrank - Spannungsversorgung 24 Volt DC",), ("",), ("Verschaltungsliste E-Schrank",)], "x string")
    assert [r[0] for r in frame.select(terminals.layer_label("x")).collect()] == ["Spannungsversorgung 24 Volt DC", "Allgemein", "Verschaltungsliste E-Schrank"]


def test_file_kinds(spark):
    cases = {
        "Stellenplaene/Stellenübersicht.xlsx": "STELLEN_OVERVIEW", "Stellenplaene/TU10_Datenblatt.pdf": "DEVICE_DATASHEET", "Stellenplaene/TU10.pdf": "STELLEN_TU", "R&I-Fließbild/a.pdf": "RI_FLOWSHEET",
        "R&I-Fließbild/a.xml": "RI_FLOWSHEET", "x/a.ifc": "IFC_MODEL", "Verschaltungslisten/Klemmenplan 3.xlsx": "KLEMMENPLAN", "Verschaltungslisten/Stromlaufplan.pdf": "STROMLAUFPLAN",
        "Verschaltungslisten/Verschaltungsliste.xls": "VERSCHALTUNGSLISTE", "Verschaltungslisten/b.xlsx": "CABINET_REFERENCE", "x/datasheet.pdf": "DEVICE_DATASHEET", "x/y.pdf": "STROMLAUFPLAN", "x/y.xlsx": "CABINET_REFERENCE",
        "Piping/mapping.xlsx": "IFC_MODEL", "x/y.xml": None, "x/y.txt": None,
    }
    frame = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r.path: r.kind for r in files.classify(files.supported(frame)).collect()}
    assert {p: got.get(p) for p in cases} == cases
    ordered = [r.path for r in spark.createDataFrame([("b/n10.pdf",), ("b/n9.pdf",), ("a/z.pdf",)], "path string").orderBy(*files.sort_key()).collect()]
    assert ordered == ["a/z.pdf", "b/n9.pdf", "b/n10.pdf"]


XML = """<PlantModel><Drawing Name="D1" Title="T"/><Equipment ID="E1" TagName="P1" ComponentClass="CentrifugalPump"><GenericAttributes><GenericAttribute Name="Design Pressure" Value="5"/></GenericAttributes>
<Position><Location X="1,5" Y="2"/></Position><Medium><Name>Wasser</Name></Medium></Equipment><Equipment TagName="no id"/>
<PipingNetworkSegment ID="S1"><Connection FromID="E1" ToID="F1"/></PipingNetworkSegment><InstrumentationLoopFunction ID="L1"><Association Type="is a collection including" ItemID="F1"/></InstrumentationLoopFunction>
<ProcessInstrumentationFunction ID="F1"/><InformationFlow><Connection FromID="F1" ToID="S1"/></InformationFlow></PlantModel>"""


def test_plant_xml(spark):
    sources = spark.createDataFrame([("a.xml", XML), ("b.xml", "<broken"), ("c.xml", None)], "path string, content string")
    nodes = {r.node_id: r for r in plant_xml.plant_nodes(sources).collect()}
    assert set(nodes) == {"E1", "S1", "L1", "F1"}
    assert nodes["E1"].component_type == "pump" and nodes["E1"].x == 1.5
    assert nodes["E1"].attributes["design_pressure"] == "5" and nodes["E1"].attributes["medium_name"] == "Wasser"
    edges = plant_xml.plant_edges(sources)
    assert {(r.from_id, r.to_id, r.edge_type) for r in edges.collect()} == {("E1", "F1", "piping_connection"), ("F1", "S1", "information_flow"), ("L1", "F1", "loop_membership")}
    assert plant_xml.instrument_instances(plant_xml.plant_nodes(sources), edges).first().signal_to == "S1"
    assert plant_xml.drawing_metadata(sources.limit(1)).first().drawing_name == "D1"


STEP = """#1= IFCPIPESEGMENT('0abcdefghijklmnopqrst1',#9,'Pipe, one',$,'OT',#2,#3,'TAG-1');
#2=IFCVALVE('0abcdefghijklmnopqrst2',#9,'Valve ''x''',$,$,#2,(#3,#4),$);
#3=IFCBUILDINGELEMENTPROXY('0abcdefghijklmnopqrst3',#9,'Origin',$,$,#2,#3,$);
#4=IFCRELCONNECTSELEMENTS('0abcdefghijklmnopqrst4',#9,$,$,#1,#2);
"""


def test_step_text(spark):
    entities = step.step_entities(spark.createDataFrame([("m.ifc", STEP), ("e.ifc", ""), ("n.ifc", None)], "path string, value string"))
    nodes = {r.number: r for r in step.step_nodes(entities).collect()}
    assert set(nodes) == {1, 2} and nodes[1].name == "Pipe, one" and nodes[1].match_keys[0] == "tag1" and nodes[2].name == "Valve 'x'"
    edge = step.step_edges(entities).first()
    assert (edge.from_id[-1], edge.to_id[-1], edge.relation) == ("1", "2", "IFCRELCONNECTSELEMENTS")
    assert step.global_ids(spark.createDataFrame([("m", STEP)], "path string, value string")).count() == 4


def test_settings(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("field_aliases:\n  tag_name:\n    - TagName\n    - Kennzeichen\n  description: [Benennung]\n", encoding="utf-8")
    aliases = settings.field_aliases(spark, str(tmp_path / "p.yaml"))
    got = settings.canonical_fields(spark.createDataFrame([("kennzeichen ",), ("tag name",), ("x",)], "field string"), aliases)
    assert {r.field: r.canonical for r in got.collect()} == {"kennzeichen ": "tag_name", "tag name": "tag_name", "x": None}
    (tmp_path / "o.csv").write_text("assembly_no,label,type\n1,a,tank\n2, b ,elbow\nx,c,d\n")
    assert settings.component_order(spark, str(tmp_path / "o.csv")).count() == 2
    rows = spark.createDataFrame([("D", "C", "p1", "", "", "", True, 1), ("", "", "p2", "", "", "opt.", False, 2), (None, "C2", "p3", "", "", "", False, 3)], "document string, class_name string, property string, data_type string, example string, notes string, highlighted boolean, n int")
    entries = settings.catalog_entries(rows.withColumn("k", F.lit(1)), ["k"], "n")
    assert [(r.document, r.class_name, r.priority) for r in entries.orderBy("n").collect()] == [("D", "C", "guaranteed"), ("D", "C", "partial"), ("D", "C2", "best_effort")]
    covered = settings.catalog_support(entries, spark.createDataFrame([("p1", "guaranteed", "f")], "key string, status string, field string"))
    assert tuple(settings.coverage_counts(covered).first()) == (3, 1, 1, 1)


# ---------------------------------------------------------------- pages and streams


def test_pages(spark):
    lines = [(0.0, 0.0, 0.0, 100.0), (0.0, 100.0, 0.0, 200.0), (0.0, 50.0, 80.0, 50.0), (40.0, 0.0, 42.0, 90.0)]
    frame = spark.createDataFrame([("d", 1, i, *s) for i, s in enumerate(lines)], "document string, page int, ord int, x0 double, y0 double, x1 double, y1 double")
    merged = {(r.x0, r.y0, r.x1, r.y1) for r in pages.merge_segments(frame).collect()}
    assert (0.0, 0.0, 0.0, 200.0) in {(a, min(b, d), c, max(b, d)) for a, b, c, d in merged}
    ends = spark.createDataFrame([("d", 1, "t", 0.0, 1.0, 79.0, 50.0), ("d", 2, "u", 0.0, 0.0, 1.0, 1.0)], "document string, page int, trace string, ax double, ay double, bx double, by double")
    got = {r.trace: (r.length, r.path) for r in pages.trace_paths(frame, ends).collect()}
    assert got == {"t": (130.0, "(0.0,0.0) -> (0.0,50.0) -> (80.0,50.0)"), "u": (None, None)}
    bundle = pages.bundles(frame.where("ord <> 2")).collect()
    assert [(r.n, r.top, r.bottom) for r in bundle] == [(2, 0.0, 200.0)]
    assert pages.corners([(0, 0), (0, 5), (0, 9), (4, 9)]) == [(0, 0), (0, 9), (4, 9)]


def test_parts_and_edges(spark):
    parts = spark.createDataFrame([("d", 1, "a", "t", "x", [0.0, 0.0, 20.0, 20.0], "", ["2"]), ("d", 1, "b", "t", "x", [5.0, 5.0, 25.0, 25.0], "T", ["1"]), ("d", 1, "c", "t", "y", [0.0, 0.0, 20.0, 20.0], "", [])], "document string, page int, part_id string, role string, label string, box array<double>, tag string, terminals array<string>")
    got = {r.part_id: (r.box, r.tag, r.terminals) for r in pages.dedupe_parts(parts).collect()}
    assert got == {"a": ([0.0, 0.0, 25.0, 25.0], "T", ["1", "2"]), "c": ([0.0, 0.0, 20.0, 20.0], "", [])}
    nodes = spark.createDataFrame([("d", 1, "n1", 1, [0.0, 0.0, 10.0, 10.0], "terminal", "X1"), ("d", 1, "n2", 2, [200.0, 0.0, 210.0, 10.0], "component", "K1:2")], "document string, page int, node_id string, ord int, box array<double>, node_type string, label string")
    lines = spark.createDataFrame([("d", 1, 1, 5.0, 5.0, 205.0, 5.0), ("d", 1, 2, 205.0, 6.0, 5.0, 6.0), ("d", 1, 3, 0.0, 0.0, 9.0, 9.0)], "document string, page int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.from_node, r.to_node, r.confidence) for r in pages.segment_edges(lines, nodes).collect()] == [("n1", "n2", 0.65)]


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, t string")
    rows.write.parquet(source)
    jobs.run(jobs.arrivals(spark, source, rows.schema), lambda b: b.groupBy("t").count(), out, str(tmp_path / "check"))
    assert {(r.t, r["count"]) for r in spark.read.parquet(out).collect()} == {("a", 1), ("b", 2)}
    rows.limit(1).write.mode("append").parquet(source)
    jobs.run(jobs.arrivals(spark, source, rows.schema), lambda b: b.groupBy("t").count(), out, str(tmp_path / "check"))
    assert spark.read.parquet(out).count() == 3
