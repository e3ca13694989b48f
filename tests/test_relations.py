"""Ordered winners, matching, decisions, graphs, audits and store: plain versions and edge cases."""

import random
import re
from difflib import SequenceMatcher
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from docweave.operators import decide, export, graph, matching, ordered, quality, store


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def keys(spark, values):
    return spark.createDataFrame([(x,) for x in values], "key string")


def noisy(seed, n):
    random.seed(seed)
    base = ["".join(random.choice("TUX10") for _ in range(random.randint(1, 9))) for _ in range(n)]
    return base + ["".join(random.choice([c, "", c + random.choice("TUX10")]) if random.random() < 0.2 else c for c in x) for x in base] + ["", None]


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_all_pairs_within_edits_are_found(spark, edits):
    left, right = noisy(1, 30), noisy(2, 30)
    got = {(r.left_key, r.right_key): r.distance for r in matching.within_edits(keys(spark, left), keys(spark, right), "key", edits).collect()}
    want = {(a, b): levenshtein(a, b) for a in left if a for b in right if b and levenshtein(a, b) <= edits}
    assert got == want


def test_ratio_matches_against_all_pairs(spark):
    left, right = sorted({x for x in noisy(3, 40) if x}), sorted({x for x in noisy(4, 40) if x})
    got = {r.left_key: (r.right_key, round(r.ratio, 9)) for r in matching.ratio_matches(matching.ratio_candidates(keys(spark, left), keys(spark, right), "key")).collect()}
    want = {}
    for a in left:
        for b in right:
            r = SequenceMatcher(None, a, b).ratio()
            if abs(len(a) - len(b)) <= 2 and round((1 - r) * max(len(a), len(b))) <= 2 and (a not in want or (-r, b) < (-want[a][1], want[a][0])):
                want[a] = (b, r)
    assert got == {a: (b, round(r, 9)) for a, (b, r) in want.items()}
    whole = matching.best_by_ratio(keys(spark, [*left, None, ""]), keys(spark, right), "key")
    assert {r.left_key: (r.right_key, round(r.ratio, 9)) for r in whole.collect()} == got


def test_nearest_among_short_and_long_texts(spark):
    left, right = noisy(7, 20), noisy(8, 20)
    long = [x * 9 + "T" * 8 for x in noisy(9, 12) if x]
    left, right = left + long, right + [x[:-1] + "U" for x in long] + [x[1:-2] for x in long[::3]]
    got = {r.left_key: (r.distance, r.right_key) for r in matching.nearest_within(keys(spark, left), keys(spark, right), "key", 2).collect()}
    best = {a: min((levenshtein(a, b), b) for b in right if b) for a in left if a}
    assert got == {a: (n, b) for a, (n, b) in best.items() if n <= 2}


def test_dense_designations_meet_few_others(spark):
    tags = keys(spark, [f"TD{i // 1000}T{i % 1000:03}" for i in range(10_000, 14_000)])
    one = matching.near_pairs(tags.withColumnRenamed("key", "left_key"), tags.withColumnRenamed("key", "right_key"), 1)
    assert one.count() < 200_000  # of 16 million; few more than are within one edit


def test_ratio_among_short_and_long_texts(spark):
    left, right = sorted({x for x in noisy(10, 30) if x}), sorted({x for x in noisy(11, 30) if x})
    left, right = left + [x * 3 + "T1X0" * 4 for x in left[:8]], right + [x * 3 + "T1X0" * 4 + "U" for x in left[:8]] + [x * 3 + "T1X0" * 3 + "1T0X" for x in left[:4]]
    got = {r.left_key: (r.right_key, round(r.ratio, 9)) for r in matching.best_by_ratio(keys(spark, left), keys(spark, right), "key").collect()}
    want = {}
    for a in left:
        for b in right:
            r = 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
            if abs(len(a) - len(b)) <= 2 and round((1 - r) * max(len(a), len(b))) <= 2 and (a not in want or (-r, b) < (-want[a][1], want[a][0])):
                want[a] = (b, r)
    assert got == {a: (b, round(r, 9)) for a, (b, r) in want.items()}


def test_dense_designations_have_few_candidates_by_ratio(spark):
    tags = keys(spark, [f"TD{i // 1000}T{i % 1000:03}" for i in range(10_000, 14_000, 7)])
    pairs = matching.ratio_candidates(tags, tags, "key").withColumn("distance", F.levenshtein("left_key", "right_key"))
    assert pairs.where("distance > 4").isEmpty() and pairs.count() < 572 * 250


def test_forms_and_parts_are_never_broadcast(spark):
    tags = spark.range(50).select(F.concat(F.lit("TD10T"), "id").alias("key"))  # few bytes, by which tables are sent to the driver
    left, right = tags.withColumnRenamed("key", "left_key"), tags.withColumnRenamed("key", "right_key")
    for pairs in (matching.near_pairs(left, right, 2), matching.ratio_candidates(tags, tags, "key")):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin .*Inner", plan) and not re.search(r"Broadcast\w*Join .*Inner", plan)


def test_filtered_forms_lose_no_partner(spark, monkeypatch):
    monkeypatch.setattr(matching, "WORTH_A_FILTER", 0)
    left, right = sorted({x for x in noisy(12, 40) if x}), sorted({x for x in noisy(13, 40) if x})
    for few, many in ((left[::9], right), (left, right[::9])):
        got = {r.left_key: (r.right_key, round(r.ratio, 9)) for r in matching.best_by_ratio(keys(spark, few), keys(spark, many), "key").collect()}
        want = {}
        for a in few:
            for b in many:
                r = SequenceMatcher(None, a, b).ratio()
                if abs(len(a) - len(b)) <= 2 and round((1 - r) * max(len(a), len(b))) <= 2 and (a not in want or (-r, b) < (-want[a][1], want[a][0])):
                    want[a] = (b, r)
        assert got == {a: (b, round(r, 9)) for a, (b, r) in want.items()}
        near = {(r.left_key, r.right_key) for r in matching.within_edits(keys(spark, few), keys(spark, many), "key", 2).collect()}
        assert near == {(a, b) for a in few for b in many if levenshtein(a, b) <= 2}


def test_cardinality_asks_only_of_keys_that_miss_a_target(spark, monkeypatch):
    asked, whole = [], decide.nearest_by_target
    monkeypatch.setattr(decide, "nearest_by_target", lambda k, t, n=2: asked.append((n, {r.key for r in k.collect()}, {r.doc_type for r in t.collect()})) or whole(k, t, n))
    has = spark.createDataFrame([("A", "TU10T41"), ("B", "TU10T4"), ("C", "TU10T421"), ("Z", "TU77T77"), ("A", "TU77T77")], "doc_type string, key string")
    rules = spark.createDataFrame([("A", 1, "critical"), ("B", 1, "warning"), ("C", 0, "warning")], "target_doc string, min_count int, severity string")
    got = decide.cardinality(keys(spark, ["TU10T41", "TU77T77"]), has, rules).collect()
    assert [(r.key, r.missing_in, r.present_in, r.review_status) for r in got] == [("TU77T77", ["B"], ["A"], "auto")]
    assert asked == [(1, {"TU10T41", "TU77T77"}, {"A", "B", "C"}), (2, {"TU77T77"}, {"A", "B", "C"})]


def test_exact_or_stripped(spark, collect):
    got = collect(matching.exact_or_stripped(keys(spark, ["TI TU1.A", "TU1A", "zz", "", None]), keys(spark, ["TU1-A", None])))
    assert got == [("TITU1A", "TU1A", "stripped"), ("TU1A", "TU1A", "exact"), ("ZZ", None, None)]
    assert matching.exact_or_stripped(keys(spark, []), keys(spark, [])).count() == 0


CARDINALITY = [
    ("TU10T41", {"A": ["TU10T41"], "B": ["TU10T41"]}, None),
    ("TU10T42", {"A": ["TU10T42"], "B": []}, ["B"]),
    ("TITU10T43", {"A": ["TU10T43"], "B": ["TU10T43"]}, None),
    ("TU10T44", {"A": ["TU10T4A"], "B": ["TU10T44"]}, None),
    ("TU10F99", {"A": ["TU10FXY"], "B": ["TU10F99"]}, ["A"]),
]


@pytest.mark.parametrize(("key", "targets", "missing"), CARDINALITY)
def test_cardinality(spark, key, targets, missing):
    rows = [(t, k) for t, values in targets.items() for k in [*values, "OTHER123456"]]
    found = decide.cardinality(keys(spark, [key]), spark.createDataFrame(rows, "doc_type string, key string"), spark.createDataFrame([("A", 1, "critical"), ("B", 1, "warning"), ("C", 0, "warning")], "target_doc string, min_count int, severity string"))
    got = found.collect()
    assert (got[0].missing_in if got else None) == missing
    if key == "TU10F99":
        assert got[0].review_status == "needs_review" and got[0].confidence == 0.75 and got[0].severity == "critical"


def test_cardinality_broadcasts_rules_only(spark):
    tags = spark.range(50).select(F.concat(F.lit("TD10T"), "id").alias("key"))  # few bytes, by which tables are sent to the driver
    rules = spark.range(1).select(F.lit("A").alias("target_doc"), F.lit(1).alias("min_count"), F.lit("critical").alias("severity"))
    found = decide.cardinality(tags, tags.where("key > 'TD10T4'").select(F.lit("A").alias("doc_type"), "key"), rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"BroadcastHashJoin .*(Inner|Outer|Anti)", plan)
    at = {f"TD10T{i}" for i in range(50)}
    has = {x for x in at if x > "TD10T4"}
    assert {r.key for r in found.collect()} == {x for x in at if min(levenshtein(x, y) for y in has) > 1}


def test_cardinality_with_an_empty_target(spark):
    none = spark.createDataFrame([], "doc_type string, key string")
    got = decide.cardinality(keys(spark, ["A1"]), none, spark.createDataFrame([("X", 1, "critical")], "target_doc string, min_count int, severity string")).collect()
    assert got[0].missing_in == ["X"] and got[0].present_in == []


def test_assignment_is_best_and_one_to_one(spark):
    random.seed(5)
    pairs = [(f"s{i}", f"t{j}", round(random.random(), 2)) for i in range(4) for j in range(4) if random.random() < 0.8]
    frame = spark.createDataFrame(pairs, "source_key string, target_key string, score double")
    ends = frame.select(F.concat(F.lit("s|"), "source_key").alias("a"), F.concat(F.lit("t|"), "target_key").alias("b"))
    got = matching.assign_one_to_one(frame, graph.connected_components(ends, "a", "b")).collect()
    score = {(a, b): s for a, b, s in pairs}
    best = max(sum(score.get((f"s{i}", f"t{j}"), 0) for i, j in enumerate(p)) for p in permutations(range(4)))
    assert sum(r.score for r in got) == pytest.approx(best)
    assert len({r.source_key for r in got}) == len(got) == len({r.target_key for r in got})


def test_greedy_rounds_equal_a_greedy_pass(spark):
    random.seed(6)
    pairs = [(f"s{i:02}", f"t{j:02}", random.choice([0.4, 0.5, 0.9])) for i in range(12) for j in range(12) if random.random() < 0.4]
    taken, used, want = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in taken and b not in used:
            taken.add(a), used.add(b), want.add((a, b))
    got = matching.greedy_pairs(spark.createDataFrame(pairs, "source_key string, target_key string, score double"))
    assert {(r.source_key, r.target_key) for r in got.collect()} == want


def test_components_and_search(spark, collect):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (200, 200)], "a int, b int")
    got = dict(collect(graph.connected_components(edges, "a", "b")))
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100 and got[200] == 200
    assert graph.connected_components(edges.limit(0), "a", "b").count() == 0
    near = graph.nearest_target(spark.createDataFrame([(0,), (5,), (29,)], "start int"), graph.undirected(edges, "a", "b"), spark.createDataFrame([(3,), (7,), (29,)], "node int"), 4)
    assert set(collect(near)) == {(0, 3, 3), (5, 3, 2), (29, 29, 0)}


EVENTS = "k string, o int, v string, _best string"


def events(spark, values):
    return spark.createDataFrame([(*x, "clash") for x in values], EVENTS)


def test_winners_do_not_depend_on_partitions(spark, collect):
    values = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "n"), (None, 3, None), (None, 3, None), ("c", 1, "w" * 10_000)]
    frame = events(spark, values).drop("_best")
    for n in (1, 7):
        first = collect(ordered.first_per_key(frame.repartition(n), ["k"], ["o"]))
        assert first == sorted([("a", 1, "y"), ("b", None, "n"), (None, 3, None), ("c", 1, "w" * 10_000)], key=repr)
        last = dict((r[0], r[2]) for r in collect(ordered.last_per_key(frame.repartition(n), ["k"], ["o"])))
        assert last["a"] == "x"
    joined = dict(collect(ordered.distinct_joined(events(spark, [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("a", 4, ""), ("b", 1, None)]).drop("_best"), ["k"], "v", "o")))
    assert joined == {"a": "x | y"}
    assert ordered.first_per_key(frame.limit(0), ["k"], ["o"]).count() == 0


def test_ids_pages_and_duplicates(spark, collect):
    frame = spark.range(1000).select((F.col("id") * 37 % 1000).alias("n")).repartition(13)
    got = {r.n: r.id for r in ordered.assign_ids(frame, "E", ["n"]).collect()}
    assert got == {i: f"E.{i + 1}" for i in range(1000)}
    assert ordered.assign_ids(frame.limit(0), "E", ["n"]).count() == 0
    assert [r.n for r in ordered.page(frame, ["n"], 5, 3).collect()] == [5, 6, 7] and ordered.page(frame, ["n"], 990, 0).count() == 10
    twice = spark.createDataFrame([("a", 1), ("a", 4), ("a", 2), ("", 5), ("", 6), (None, 7), (None, 8), ("b", 9)], "k string, r int")
    assert collect(ordered.duplicates(twice, ["k"], "r")) == [("a", 2, 1), ("a", 4, 1)]


def test_upsert_positions_and_pairs(spark, collect):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert collect(ordered.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    left, right = keys(spark, ["b", "a"]), keys(spark, ["y"])
    assert collect(ordered.positional_match(left, right, ["key"], "key")) == [(1, "a", "y", "Matched"), (2, "b", None, "Only_Left")]
    pairs = spark.createDataFrame([("a", "b", 2), ("b", "a", 1), ("c", "c", 0), ("a", None, 3)], "a string, b string, o int")
    assert collect(ordered.distinct_undirected(pairs, "a", "b", "o")) == [("b", "a", 1)]


def test_presence_ladder(spark):
    cases = [(True, 0.0, 0, "present", 1.0, False), (False, 0.9, 0, "present", 0.9, False), (False, 0.99, 1, "present", 0.95, False), (False, 0.45, 2, "present", 0.65, True),
             (False, 0.2, 0, "missing", 0.9, False), (False, 0.2, 1, "needs_review", 0.35, True), (False, 0.69, 1, "needs_review", 0.69, True), (None, None, None, "missing", 0.9, False)]
    frame = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, s boolean, t double, n int")
    got = [r.p for r in frame.select("i", decide.presence(F.col("s"), F.col("t"), F.col("n")).alias("p")).orderBy("i").collect()]
    assert [(p.decision, p.confidence, p.needs_review) for p in got] == [c[3:] for c in cases]


def test_votes(spark, collect):
    a = spark.createDataFrame([("1", "x", 0.8), ("2", "x", 0.5), ("3", "x", 0.5), ("4", "x", 0.9)], "key string, value string, confidence double")
    b = spark.createDataFrame([("1", "x", 0.6), ("2", "y", 0.5), ("3", "y", 0.6), ("5", "z", 0.1)], "key string, value string, confidence double")
    votes = decide.vote_tracks(a, b)
    assert [r[:4] for r in collect(votes)] == [("1", "x", 0.7, "agreed"), ("2", "x", 0.5, "disagreed"), ("3", "y", 0.6, "disagreed"), ("4", "x", 0.9, "only_a"), ("5", "z", 0.1, "only_b")]
    assert collect(decide.agreement(votes)) == [(5, 1, 0.2)] and collect(decide.agreement(votes.limit(0))) == [(0, 0, 0.0)]


def test_audits(spark, collect):
    child, parent = keys(spark, ["a", " b ", "b", "", None, "zz"]), keys(spark, ["a", "b"])
    assert [r.key for r in quality.foreign_keys(child, "s", "key", parent, "key").collect()] == ["zz"]
    assert quality.foreign_keys(child, "s", "key", parent.limit(0), "key").count() == 0
    rates = {r.column: (r.filled, r.rate) for r in quality.fill_rates(spark.createDataFrame([("a", ""), ("b", None), (" ", "x")], "p string, q string")).collect()}
    assert rates == {"p": (2, 0.6667), "q": (1, 0.3333)}
    assert collect(quality.sparse_columns(spark.createDataFrame([("a", None)], "p string, q string")).select("column", "state")) == [("q", "empty")]
    assert quality.prune_blank_columns(spark.createDataFrame([("a", None, "")], "p string, q string, r string"), ["r"]).columns == ["p", "r"]
    assert [r.key for r in quality.primary_keys(spark.createDataFrame([("x", 1), ("x", 2), (None, 3), (None, 4)], "k string, o int"), "s", "k", "o").collect()] == ["x"]
    assert quality.exactly_one(child, "s", F.col("key") == "a", "what").count() == 0 and quality.exactly_one(child, "s", F.col("key") == "q", "what").count() == 1
    assert quality.headers(child.withColumn("n", F.lit(1)), ["n", "key", "m"]) == [("m", "missing"), ("key", "moved"), ("n", "moved")]
    need = quality.required_attributes(spark.createDataFrame([("d", "A"), ("e", None)], "d string, a string"), "s", "d", "a", ["A", "B"])
    assert sorted((r.key, r.message) for r in need.collect()) == [("d", "lacks B"), ("e", "lacks A"), ("e", "lacks B")]
    assert not quality.passed(need) and quality.passed(need.limit(0))


def test_designations(spark, collect):
    elements = spark.createDataFrame([("e1", "-X1:12", 1), ("e2", "K5", 2), ("e3", "-K5", 3), ("e4", "=A.B", 4), ("e5", "", 5)], "element_id string, designation string, ord int")
    asked = spark.createDataFrame([("p", 1, "x1:12"), ("q", 1, "nothing"), ("q", 2, "K5"), ("r", 1, "X1"), ("s", 1, "K5:3"), ("t", 1, None)], "key string, ord int, designation string")
    assert collect(matching.resolve_designations(asked, elements)) == [("p", "e1"), ("q", "e2"), ("r", "e1")]


def test_field_tiers(spark, collect):
    fields = spark.createDataFrame([("Tag",), ("Medium",), ("Druck",), ("",)], "field string")
    headers = spark.createDataFrame([("TAG ", 3), ("tag", 1), ("Stoff", 2), ("Auslegungsdruck", 4), ("--", 0)], "header string, ord int")
    synonyms = spark.createDataFrame([("Medium", "stoff")], "field string, synonym string")
    assert collect(matching.match_field_tiers(fields, headers, synonyms)) == [("Druck", "Auslegungsdruck", 0.85, "partial"), ("Medium", "Stoff", 0.95, "synonym"), ("Tag", "tag", 0.98, "exact")]


def test_evidence_precedence(spark, collect):
    fields = spark.createDataFrame([("r1", "f", "d", "k1"), ("r1", "g", "d", ""), ("r2", "f", "d", ""), ("r3", "f", "x", "")], "record string, field string, document string, evidence_key string")
    evidence = spark.createDataFrame([("e1", "", "", "", "k1", 9), ("e2", "r1", "g", "d", "", 2), ("e3", "r1", "", "d", "", 1), ("e4", "", "", "d", "", 0)], "evidence_id string, record string, field string, document string, key string, ord int")
    assert collect(matching.evidence_for_fields(fields, evidence)) == [("r1", "f", "e1"), ("r1", "g", "e2"), ("r2", "f", "e4"), ("r3", "f", None)]


def test_nearest_nodes_and_clusters(spark, collect):
    points = spark.createDataFrame([(1, 10, 10.0, 10.0), (1, 11, 500.0, 500.0), (2, 12, 0.0, 0.0)], "page int, point_id int, x double, y double")
    nodes = spark.createDataFrame([(1, 7, 0, [0.0, 0.0, 20.0, 20.0]), (1, 8, 1, [0.0, 0.0, 20.0, 20.0])], "page int, node_id int, ord int, box array<double>")
    assert collect(matching.nearest(points, nodes, ["page"])) == [(1, 10, 7, 0.0)]
    boxes = spark.createDataFrame([(1, i, [float(i), 0.0, i + 10.0, 10.0]) for i in range(0, 9, 3)] + [(1, 99, [500.0, 0.0, 510.0, 9.0]), (2, 50, [0.0, 0.0, 10.0, 10.0])], "page int, box_id int, box array<double>")
    assert {(r.box_id, r.cluster) for r in graph.overlap_clusters(boxes, ["page"]).collect()} == {(0, 0), (3, 0), (6, 0), (99, 99), (50, 50)}
    votes = graph.vote_clusters(spark.createDataFrame([(1, 1, "a", 0.5), (1, 0, "b", 0.5), (2, 0, "c", 1.0)], "c int, ord int, text string, confidence double"), ["c"])
    assert collect(votes) == [(1, "b", 0.75, 2), (2, "c", 1.0, 1)]


def test_store(spark, collect):
    records = spark.createDataFrame([(1, "Alpha"), (2, "beta"), (3, None)], "id int, name string")
    children = spark.createDataFrame([(2, "find me"), (3, "a_b"), (3, None)], "id int, v string")
    page = lambda word: [r.id for r in store.record_page(records, children, "id", word, ["name"], ["v"], ["id"]).collect()]
    assert page("ALP") == [1] and page("find") == [2] and page("a%b") == [3] and page("") == [1, 2, 3] and page("none") == []
    feedback = spark.createDataFrame([(1, 5, "ok"), (1, 9, "bad")], "id int, n int, status string").select(F.col("id").alias("k"), F.col("n").alias("id"), "status")
    got = store.with_feedback(records.withColumnRenamed("id", "k"), feedback, ["k"])
    assert {r.k: r.feedback_status for r in got.collect()} == {1: "bad", 2: None, 3: None}
    edited = store.apply_edits(spark.createDataFrame([(1, "old", 0.2, "blank"), (2, "keep", 0.3, "filled")], "k int, value string, confidence double, status string"), spark.createDataFrame([(1, "new", 1), (1, "newer", 2)], "k int, value string, id int"), ["k"])
    assert collect(edited.select("k", "value", "confidence", "status")) == [(1, "newer", 1.0, "filled"), (2, "keep", 0.3, "filled")]


def test_exports(spark, collect):
    long = spark.createDataFrame([("r", "a", "1", 2), ("r", "a", "0", 1), ("r", "b", "x", 1), ("s", "c", "y", 1)], "record string, field string, value string, ord int")
    assert collect(export.wide_records(long, "record", ["a", "b"])) == [("r", "0", "x"), ("s", None, None)]
    assert collect(export.by_template(spark.createDataFrame([("=1+1", None, "z")], "a string, b string, extra string"), ["a", "b", "c"])) == [("'=1+1", "", "")]
    old = spark.createDataFrame([(3, "x")], "index bigint, v string")
    assert collect(export.append_report(spark.createDataFrame([("z",), ("y",)], "v string"), old, ["v"])) == [(3, "x"), (4, "y"), (5, "z")]
    text = spark.range(1).select(export.render(F.lit("a {{x}} b {{ y }}"), {"x": F.lit("1")}))
    assert text.first()[0] == "a 1 b "
    nested = export.nested_documents(spark.createDataFrame([("i", "M", 0, "p", 0, "true"), ("i", "M", 0, "q", 1, "x"), ("i", "M", 0, "q", 2, "y")], "identity string, submodel string, submodel_ord int, name string, ord int, value string"), "t")
    got = {(r.predicate, r.object) for r in export.triples(nested, "identity", "payload").collect()}
    assert ("submodels.submodelElements.value", "x") in got and ("submodels.submodelElements.valueType", "xs:boolean") in got


@pytest.mark.parametrize("block", [3, 100_000])
def test_windows_over_large_groups(spark, block):
    random.seed(block)
    values = [("hot", i, random.choice(["a", "b", "", None])) for i in range(40)] + [(None, 2, "x"), (None, 1, ""), ("one", 1, None)]
    frame = spark.createDataFrame(values, "g string, o int, v string").repartition(5)
    groups = {g: sorted((o, v) for h, o, v in values if h == g) for g in {v[0] for v in values}}
    keep = F.coalesce(F.col("v"), F.lit("")) != ""
    filled = {(r.g, r.o): r.v for r in ordered.forward_fill(frame, "v", keep, ["g"], ["o"], block=block).collect()}
    ahead = {(r.g, r.o): r.n for r in ordered.look_ahead(frame, F.col("v"), keep, 3, ["g"], ["o"], "n", block=block).collect()}
    around = {(r.g, r.o): r.n for r in ordered.neighbours(frame.withColumn("s", F.col("o").cast("string")), "s", 2, ["g"], ["o"], "n", block=block).collect()}
    pairs = {(r.g, r.from_id, r.to_id) for r in ordered.consecutive_pairs(frame, "o", ["g"], ["o"]).collect()}
    for g, rows in groups.items():
        last = None
        for i, (o, v) in enumerate(rows):
            last = v if v else last
            assert filled[g, o] == last
            assert ahead[g, o] == next((w for _, w in rows[i + 1 : i + 4] if w), None)
            assert around[g, o] == [str(p) for p, _ in rows[max(0, i - 2) : i + 3]]
            assert i == 0 or (g, rows[i - 1][0], o) in pairs
    assert len(pairs) == sum(len(r) - 1 for r in groups.values()) and len(filled) == len(values)
