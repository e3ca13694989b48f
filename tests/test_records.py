"""Orphans, wide tables, hierarchies and nested records: plain versions and edge cases."""

import json
import random
from datetime import datetime

import pyarrow as pa
import pytest

from docweave.operators import hierarchy as hierarchies
from docweave.operators.hierarchy import descendants, hierarchy
from docweave.operators.nested import Scan, nested_objects, nested_values
from docweave.operators.orphans import orphan_references, orphan_report
from docweave.operators.wide import Attribute, filled_cells, read_attributes, wide_table

REFS = "ref_table string, row_key string, ref_value string, at timestamp_ntz, key string, valid_from int"
PARENTS = "key string, valid_from timestamp_ntz, valid_until timestamp_ntz, at string"


def day(n, month=1):
    return datetime(2020, month, n)


def orphans(spark, refs, parents, **options):
    refs = spark.createDataFrame([(*r, "clash", 1) for r in refs], REFS)
    return orphan_references(refs, spark.createDataFrame([(*p, "clash") for p in parents], PARENTS), **options)


@pytest.mark.parametrize(("bits", "parts"), [(1 << 26, 32), (16, 32), (16, 2), (1, 1)])
def test_orphans_by_time(spark, collect, bits, parts):
    refs = [
        ("t", "1", " a ", day(5)), ("t", "2", "A", day(1)), ("t", "3", "b", day(5)), ("t", "4", "", day(5)), ("t", "5", None, day(5)),
        ("t", "6", "a", day(10)), ("t", "7", "a", None), ("t", "1", "a", day(5)), (None, None, "zz", day(2, 3)), ("t", "8", "a", day(20)), ("t", "8", "a", day(20)),
    ]
    parents = [("A", day(3), day(10)), ("a ", day(15), None), ("A", day(3), day(4)), (None, day(1), None), ("B", None, None), ("", day(1), None)]
    got = collect(orphans(spark, refs, parents, part_bits=bits, max_parts=parts))
    assert got == sorted([("t", "2020-01", "2", "A"), ("t", "2020-01", "3", "B"), ("t", "2020-01", "6", "A"), ("t", None, "7", "A"), (None, "2020-03", None, "ZZ")], key=repr)


def test_orphans_of_empty_tables(spark, collect):
    assert collect(orphans(spark, [], [("A", day(1), None)])) == []
    got = orphans(spark, [("t", "1", "a", day(5)), ("t", "2", "a", day(6))], [])
    assert collect(orphan_report(got)) == [("t", "2020-01", 2, 1)]


DATA = "document_id string, attribute_name string, attribute_value string, document_data_id string, extraction_timestamp timestamp_ntz, value string, attr int"
ATTRIBUTES = [Attribute("Flow_Rate", "decimal"), Attribute("Medium", "string"), Attribute("Ok", "boolean"), Attribute("Page", "integer"), Attribute("When", "date")]


def data(spark, values):
    return spark.createDataFrame([(*x, "clash", 7) for x in values], DATA)


def test_wide_values_and_winners(spark):
    values = [
        ("d1", "flow rate", "1,5", "r1", day(1)), ("D1 ", "FLOW-RATE", "2.5", "r2", day(2)), ("d1", "Flow_Rate", "x", "r3", day(3)),
        ("d1", " ok", "Ja", "r4", day(1)), ("d1", "When", "31.12.2020", "r5", None), ("d1", "when", "30.02.2020", "r6", day(9)),
        ("d1", "Page", "+007", "r7", day(1)), ("d1", "Page", "8", "r8", day(1)), ("d1", "medium", " Öl ", "r9", day(1)),
        ("d2", "Page", "9" * 60, "s1", day(1)), ("d2", "unknown", "1", "s2", day(1)), ("", "Page", "1", "s3", day(1)), (None, "Page", "1", "s4", day(1)),
        ("d3", "Page", "1.5", "u1", day(1)), ("d4", "Medium", "z" * 50_000, "v1", day(1)), ("d1", None, "1", "w1", day(1)), ("d1", "Page", None, "w2", day(5)),
    ]
    wide = wide_table(data(spark, values), ATTRIBUTES)
    got = {r.document_id: r for r in wide.collect()}
    assert set(got) == {"D1", "D2", "D4"}
    one = got["D1"]
    assert (float(one.Flow_Rate), one.Medium, one.Ok, int(one.Page), str(one.When)) == (2.5, "Öl", True, 8, "2020-12-31")
    assert one._sources == ["r2", "r9", "r4", "r8", "r5"]
    assert got["D2"].Page is None and got["D2"]._sources == [None, None, None, "s1", None]
    assert len(got["D4"].Medium) == 50_000
    assert {(r.document_id, r.attribute_name, r.document_data_id) for r in filled_cells(wide, ATTRIBUTES).collect()} >= {("D1", "Page", "r8"), ("D2", "Page", "s1")}


def test_wide_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        values = [(f"d{i % 40}", a.name, {"decimal": "1.5", "boolean": "1", "date": "2020-01-02"}.get(a.data_type, str(i)), f"r{i}{a.name}", day(1)) for i in range(120) for a in ATTRIBUTES]
        got = wide_table(data(spark, values), ATTRIBUTES).collect()
        assert len(got) == 40 and all(None not in r._sources for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_wide_of_nothing(spark):
    assert wide_table(data(spark, []), ATTRIBUTES).count() == 0
    assert filled_cells(wide_table(data(spark, []), ATTRIBUTES), ATTRIBUTES).count() == 0
    lookup = spark.createDataFrame([("B b", "odd"), ("b_B", "string"), ("A", None), (" ", "string"), (None, "date")], "attribute_name string, data_type string")
    assert read_attributes(lookup) == [Attribute("A", "string"), Attribute("B b", "string")]


LINKS = "parent_label string, child_label string, node_label string, depth string"


def links(spark, pairs):
    return spark.createDataFrame([(*p, "clash", "clash") for p in pairs], LINKS)


def test_hierarchy_of_trees_and_circles(spark):
    pairs = [
        ("r", "a"), (" r ", "b "), ("a", "c"), ("a", "c"), (None, "r"), ("", "lone"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "below"),
        ("s", "s"), (None, None), ("p", ""), ("", ""), ("r2", "c2"), ("c2", "d2"),
    ]
    got = {r.node_label: (r.root_label, r.depth, r.in_cycle, tuple(r.path)) for r in hierarchy(links(spark, pairs)).collect()}
    assert got["c"] == ("r", 2, False, ("r", "a", "c")) and got["r"] == ("r", 0, False, ("r",)) and got["lone"] == ("lone", 0, False, ("lone",))
    assert got["p"] == ("p", 0, False, ("p",)) and got["d2"] == ("r2", 2, False, ("r2", "c2", "d2"))
    assert all(got[x] == ("", -1, True, ()) for x in ("x", "y", "z", "below", "s"))
    assert len(got) == 14


def test_hierarchy_with_several_parents(spark):
    pairs = [("r", "a"), ("a", "b"), ("r", "b"), ("q", "b"), ("b", "c"), ("c", "d"), ("d", "c")]
    got = {r.node_label: (r.root_label, r.depth) for r in hierarchy(links(spark, pairs)).collect()}
    assert got == {"r": ("r", 0), "q": ("q", 0), "a": ("r", 1), "b": ("q", 1), "c": ("", -1), "d": ("", -1)}


def test_circles_that_a_root_reaches(spark):
    pairs = [
        ("r", "a"), ("a", "c"), ("c", "d"), ("d", "c"), ("d", "below"), ("a", "below"), ("r", "s"), ("s", "s"),
        ("r", "far"), ("a", "mid"), ("mid", "far"), ("far", "end"), ("q", "mid"),
    ]
    got = {r.node_label: (r.root_label, r.depth, r.in_cycle, tuple(r.path)) for r in hierarchy(links(spark, pairs)).collect()}
    assert all(got[x] == ("", -1, True, ()) for x in ("c", "d", "below", "s"))
    assert got["a"] == ("r", 1, False, ("r", "a")) and got["mid"] == ("q", 1, False, ("q", "mid"))
    assert got["far"] == ("r", 1, False, ("r", "far")) and got["end"] == ("r", 2, False, ("r", "far", "end")) and len(got) == 10


@pytest.mark.parametrize("share", [hierarchies.HOP_SHARE, 0, 1])
def test_deep_hierarchy_and_descendants(spark, monkeypatch, share):
    monkeypatch.setattr(hierarchies, "HOP_SHARE", share)  # with 0 hops never grow beyond single links
    monkeypatch.setattr(hierarchies, "MERGE_LEVELS", 6)
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(30)] + [("n000", f"leaf{i}") for i in range(30)]
    pairs += [(f"n{i:03}", f"twig{i}") for i in range(0, 30, 7)] + [("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("z3", "z4")]
    tree = hierarchy(links(spark, pairs))
    got = {r.node_label: (r.root_label, r.depth, tuple(r.path)) for r in tree.collect()}
    for i in range(31):
        assert got[f"n{i:03}"] == ("n000", i, tuple(f"n{j:03}" for j in range(i + 1)))
    assert got["leaf7"][1] == 1 and got["twig28"][1:] == (29, (*(f"n{j:03}" for j in range(29)), "twig28"))
    assert all(got[f"z{i}"] == ("", -1, ()) for i in range(1, 5)) and len(got) == 31 + 30 + 5 + 4
    assert descendants(tree).count() == sum(d for _, d, _ in got.values() if d > 0)


def test_empty_hierarchy(spark):
    assert hierarchy(links(spark, [])).count() == 0
    assert descendants(hierarchy(links(spark, [(None, "a")]))).count() == 0


def walk(text):
    """Paths of objects in arrays, or None for invalid JSON."""
    try:
        top = json.loads(text, parse_constant=lambda x: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return None
    found = []

    def go(x, path, inside):
        if isinstance(x, dict):
            found.extend([path] if inside else [])
            for k, y in x.items():
                go(y, f"{path}.{k}" if path else k, False)
        elif isinstance(x, list):
            for i, y in enumerate(x):
                go(y, f"{path}[{i}]", True)

    go(top, "", False)
    return found


NESTED = [
    '{"a": {"b": [{"c": [1, {"d": "x"}]}, null, []]}}', '[[{"k": 1}], {"m": true}]', "", None, " ", "{", '{"a": [1, 2}', '{"a": "\\u00e4\\"[{"}', '{"a" 1}', "null", "12", '"text"',
    '{"a": NaN}', '{"a": 01}', '{"a": [{"b": 1},]}', '{"x": [{"y": "' + "z" * 30_000 + '"}]}', '{"": [{"": [{}]}]}', '{"a": "tab\there"}', '{"a": "\\q"}', '{"ä ö": [{}]}', "[]", "{}", '{"a":1}{"b":2}',
]


def test_nested_objects(spark):
    frame = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(NESTED)], "id int, body string, path string")
    got = {}
    for r in nested_objects(frame, ["id"], "body").where("in_array").collect():
        got.setdefault(r.id, []).append(r.path)
    for i, x in enumerate(NESTED):
        assert sorted(got.get(i, [])) == sorted((walk(x) if x is not None else None) or []), x


def test_nested_links_and_values(spark):
    frame = spark.createDataFrame([(1, NESTED[0])], "id int, body string")
    objects = {r.path: (r.parent_path, r.member, r.position) for r in nested_objects(frame, ["id"], "body").collect()}
    assert objects == {"": (None, None, None), "a": ("", "a", None), "a.b[0]": ("a", None, 0), "a.b[0].c[1]": ("a.b[0]", None, 1)}
    values = {r.path: (r.parent_path, r.value_type, r.value) for r in nested_values(frame, ["id"], "body").collect()}
    assert values == {"a.b[0].c[0]": ("a.b[0]", "number", "1"), "a.b[0].c[1].d": ("a.b[0].c[1]", "string", "x"), "a.b[1]": ("a", "null", None)}
    with pytest.raises(ValueError, match="clash"):
        nested_objects(frame.withColumnRenamed("id", "path"), ["path"], "body")


def test_scan_validity_against_json(spark):
    random.seed(7)
    alphabet = '{}[],:"\\ \n1-.e0tnu falsx'
    texts = []
    for _ in range(4000):
        text = list(random.choice([x for x in NESTED if x and len(x) < 200]))
        for _ in range(random.randint(0, 3)):
            at = random.randrange(len(text) + 1)
            text[at : at + random.randint(0, 1)] = random.choice(alphabet)
        texts.append("".join(text))
    valid = Scan(pa.array(texts)).valid
    assert [walk(x) is not None for x in texts] == list(valid)
