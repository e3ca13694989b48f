"""Training-data operators against brute force, exact round trips and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docweave.llm import canonical, components, linkage, mixture, split, tokens
from docweave.llm.devices import comparisons, core_tag, features, match_devices, passes
from docweave.scratch import Scratch

NASTY = [
    "", None, " ", "\n\n", "Hello's WORLD don't 12345 !!!", "Größe: 12,5 mm² – ok ?", "日本語テキスト。次の文", "👩‍👩‍👧 emoji", "a" * 30_000, "<|endoftext|>", "x\x00y", "tab\t \t\tend  ",
    "é combining", " line sep　wide", "Hello's WORLD don't 12345 !!!", "﻿bom", "१२३ digits ②", "  leading", "trailing   ", "mixed\r\n\r\nlines\n", "Ⅷ ½ ﬁ",
]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids if text else []


def texts(spark, values):
    return spark.createDataFrame([(i, x, "clash", [1]) for i, x in enumerate(values)], "doc_id bigint, text string, words string, ids array<int>")


@pytest.mark.parametrize("hot", [tokens.HOT_BYTES, 200, 0])
def test_ids_equal_the_library(spark, library, hot):
    got = {r.doc_id: list(r.ids) for r in tokens.encode(texts(spark, NASTY), hot_bytes=hot).collect()}
    assert got == {i: library(x) for i, x in enumerate(NASTY)}


def test_decode_restores_texts(spark):
    got = {r.doc_id: r.text for r in tokens.decode(tokens.encode(texts(spark, NASTY))).collect()}
    assert got == {i: x or "" for i, x in enumerate(NASTY)}
    odd = spark.createDataFrame([(1, [-1, 60_000]), (2, [])], "doc_id bigint, ids array<int>")
    assert {r.text for r in tokens.decode(odd).collect()} == {""}


def test_encode_nothing_and_other_vocabulary(spark):
    assert tokens.encode(texts(spark, [])).count() == 0
    counted = {r.doc_id: r.n_tokens for r in tokens.count(texts(spark, NASTY), name="byte_bpe_multi_50k", keep=["words"]).collect()}
    assert counted[0] == counted[1] == 0 and counted[4] > 5


@pytest.mark.parametrize(("limit", "overlap"), [(16, 0), (16, 5), (40, 8)])
def test_pieces_cover_texts_within_the_limit(spark, library, limit, overlap):
    random.seed(limit)
    long = ["Erster Satz. Zweiter Satz!\n\nAbsatz zwei hat Wörter.\nZeile " * 6, "日本語" * 60, "👩‍👩‍👧" * 30, "a1b2" * 100, "wort " * 50, *NASTY]
    got = {}
    for r in split.split_oversized(texts(spark, long), limit, overlap).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {i for i, x in enumerate(long) if len(library(x)) > limit}
    for i, pieces in got.items():
        pieces.sort(key=lambda r: r.piece_no)
        at = 0
        for n, p in enumerate(pieces):
            assert p.piece_no == n and p.text == long[i][p.start : p.start + p.length] and p.n_tokens <= limit
            assert p.start <= at and (n == 0 or p.overlap <= overlap)
            assert overlap or p.start == at
            at = p.start + p.length
        assert at == len(long[i])
    first = got[0][0].text
    assert first.endswith(("\n", ".", "!", " ")) or long[0][len(first)] in " \n"


def test_long_texts_are_cut_in_proportion_to_their_length(spark):
    import time

    def seconds(words):
        text = "".join(f"wort{i % 977}ß " for i in range(words))
        began = time.perf_counter()
        got = split.split_oversized(texts(spark, [text]), 512, 32).select("piece_no", "start", "overlap", "text").collect()
        took, at = time.perf_counter() - began, 0
        for r in sorted(got, key=lambda r: r.piece_no):
            assert text[r.start : r.start + len(r.text)] == r.text and r.start <= at
            at = r.start + len(r.text)
        assert at == len(text)
        return took

    seconds(50_000)
    assert seconds(800_000) < 6 * seconds(200_000) + 2


def test_no_oversized_texts(spark):
    assert split.split_oversized(texts(spark, ["kurz", None, ""])).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        split.split_oversized(texts(spark, ["x"]), 10, 5)


def groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(find(x), x) for x in parent}


def test_groups_equal_union_find(spark):
    random.seed(3)
    pairs = [(f"k{random.randrange(300):03}", f"k{random.randrange(300):03}") for _ in range(170)]
    pairs += [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)] + [("s", "s"), ("c05", "c05")]
    rows = [(a, b, 0.5, "x") for a, b in pairs] + [(b, a, 0.9, "x") for a, b in pairs[:20]]
    rows += [("u1", "u2", 0.49, "x"), ("u3", "u4", None, "x"), ("", "u5", 1.0, "x"), (None, "u6", 1.0, "x"), ("u7", " ", 1.0, "x"), ("u8", "u9", float("nan"), "x")]
    frame = spark.createDataFrame(rows, "s string, t string, score double, node string")
    got = {(r.group_key, r.record_key) for r in components.components(components.linking_edges(frame, "s", "t", "score", 0.5)).collect()}
    assert got == groups(pairs)
    assert components.components(components.linking_edges(frame.limit(0), "s", "t", "score", 0.5)).count() == 0


def osa(a, b):
    """Edits with adjacent transpositions, each character used once."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_automaton_equals_brute_force(most):
    random.seed(most)
    word = lambda: "".join(random.choice("abc") for _ in range(random.randint(0, 7)))
    names = [(w, f"e{i}") for i, w in enumerate({word() for _ in range(60)}) if w]
    trie = canonical.Trie(names)
    for _ in range(150):
        value = word()
        assert {e: d for e, (d, _) in trie.search(value, most).items()} == {e: osa(value, n) for n, e in names if osa(value, n) <= most}


LISTS = {"m": [("Kühlwasser Vorlauf", "1"), ("KWV", "1"), ("Kühlwasser Rücklauf", "2"), ("Sattdampf 6 bar", "3"), ("Sattdampf 16 bar", "4"), ("PTFE", "5"), ("MSR-Schrank", "6")]}


@pytest.mark.parametrize(
    ("value", "entry"),
    [("kuehlwasser vorlauf", "1"), ("Kühlwasser  Vorlauf ", "1"), ("Vorlauf, Kühlwasser", "1"), ("KühlwasserVorluaf", "1"), ("neu: Kühlwasser Rücklauf", "2"), ("KÃ¼hlwasser RÃ¼cklauf", "2"), ("kwv", "1"), ("kwx", None),
     ("Sattdampf 16 bar", "4"), ("Sattdampf 6 bar (alt)", "3"), ("Kühlw. Rücklauf", "2"), ("prtfe", "5"), ("M5R-Schrarik", "6"), ("Gabelstapler", None), ("", None), (" ", None), ("???", None), ("x" * 5000, None)],
)
def test_values_map_to_entries(value, entry):
    assert canonical.Matcher(LISTS["m"]).match(value) == entry


def test_the_nearest_of_all_alias_paths_wins():
    lists = [("Pumpe 18A", "A"), ("Pumpe IBA", "B"), ("Kreiselpumpe einstufig horizontal", "C"), ("Ventil", "D"), ("Ventile", "E")]
    matcher = canonical.Matcher(lists)
    assert matcher.match("Pumpe I8A") is None  # by one edit to both, by the scanner's path to both
    assert matcher.match("horizontal einstufgi Kreislpumpe") == "C"  # swapped words, three edits
    assert matcher.match("Kr. einstufig hor.") == "C" and matcher.match("K. einstufig hor.") is None
    assert matcher.match("Ventil") == "D" and matcher.match("Ventlie") in ("D", "E", None)
    random.seed(8)
    letters = "abcdei "
    names = [("".join(random.choice(letters) for _ in range(random.randint(3, 14))), f"e{i % 25}") for i in range(40)]
    matcher = canonical.Matcher(names)
    for _ in range(300):
        name = list(random.choice(names)[0])
        for _ in range(random.randint(0, 4)):
            name[random.randrange(len(name))] = random.choice(letters + ".")
        value = "".join(name)
        full = sorted((d, e) for e, d in matcher.candidates(value).items())
        nearest = full[0][1] if full and (len(full) == 1 or full[1][0] - full[0][0] >= 0.5) else None
        assert matcher.match(value) == nearest


def test_entries_within_the_distance(spark):
    rows = spark.createDataFrame([("m", "Sattdampf 6 bar", 1), ("m", "Sattdampf 1 bar", 1), ("m", "qqqq", 1), (None, None, 1)], "field string, value string, distance int")
    got = {(r.value, r.entry_id): r.distance for r in canonical.near_entries(rows, LISTS).collect()}
    assert got[("Sattdampf 6 bar", "3")] == 0 and got[("Sattdampf 6 bar", "4")] >= 1 and got[("Sattdampf 1 bar", "3")] >= 0.5
    assert {v for v, _ in got} == {"Sattdampf 6 bar", "Sattdampf 1 bar"}
    assert canonical.near_entries(rows.limit(0), LISTS).count() == 0


def test_mapped_values(spark):
    rows = spark.createDataFrame([("m", "kwv"), ("m", "kwv"), ("m", None), ("n", "kwv"), (None, "x")], "field string, value string")
    got = {(r.field, r.value): r.entry_id for r in canonical.map_values(rows, LISTS).collect()}
    assert got == {("m", "kwv"): "1", ("m", None): None, ("n", "kwv"): None, (None, "x"): None}
    assert canonical.map_values(rows.limit(0), LISTS).count() == 0
    assert canonical.aliases("auch: A b; C") == ["A b", "C"] and canonical.aliases(None) == []


@pytest.mark.parametrize("window", [mixture.EXACT_BUDGET, 1, 16])
def test_fit_reaches_the_best_sums(window):
    random.seed(1)
    for _ in range(60):
        lengths = random.sample(range(1, 60), random.randint(1, 6))
        counts = [random.randint(1, 5) for _ in lengths]
        budget = random.randint(0, sum(a * b for a, b in zip(lengths, counts, strict=True)))
        reachable = {0}
        for a, b in zip(lengths, counts, strict=True):
            reachable = {s + a * k for s in reachable for k in range(b + 1)}
        take = mixture.fit(lengths, counts, budget, window)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        assert sum(a * t for a, t in zip(lengths, take, strict=True)) == max(s for s in reachable if s <= budget)
    many = [random.randint(5, 4000) for _ in range(3000)]
    counts = [random.randint(1, 300) for _ in many]
    budget = sum(a * b for a, b in zip(many, counts, strict=True)) * 3 // 7
    assert sum(a * t for a, t in zip(many, mixture.fit(many, counts, budget), strict=True)) == budget
    assert mixture.fit([7_000, 9_000], [9, 9], 100_001) != [0, 0] and mixture.fit([4, 6], [3, 3], 9) == [2, 0]


def sized(spark, values):
    return spark.createDataFrame([(*v, "clash") for v in values], "doc_id bigint, source string, n_tokens bigint, repeats string")


def test_mixture_shares_and_repeats(spark):
    values = [(i, ["A ", "b", None, "other"][i % 4], 1 + i * 7 % 50) for i in range(4000)] + [(9000 + i, "a", 20) for i in range(6000)] + [(20000, "b", 0), (20001, "b", None)]
    targets = spark.createDataFrame([("a", 0.5, 2), ("B", 0.5, 3), ("b ", 0.5, 3)], "source string, target_share double, max_repeats bigint")
    chosen, report = mixture.mixture(sized(spark, values), targets)
    rows = {r.source: r for r in report.collect()}
    assert abs(rows["a"].share - 0.5) < 0.001 and rows["b"].taken_tokens <= rows["b"].available_tokens * 3
    picked = chosen.collect()
    assert len({r.doc_id for r in picked}) == len(picked) and max(r.repeats for r in picked if r.source == "b") <= 3
    assert sum(r.n_tokens * r.repeats for r in picked if r.source == "a") == rows["a"].taken_tokens == rows["a"].budget_tokens
    again = mixture.mixture(sized(spark, values).repartition(9), targets)[0]
    assert {(r.doc_id, r.repeats) for r in again.collect()} == {(r.doc_id, r.repeats) for r in picked}


def test_mixture_without_documents(spark):
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats bigint")
    chosen, report = mixture.mixture(sized(spark, [(1, "a", 5)]), targets)
    assert chosen.count() == 0 and [r.share for r in report.collect()] == [0.0, 0.0]
    chosen, report = mixture.mixture(sized(spark, [(1, "a", 5)]), targets, total=20)
    assert [(r.doc_id, r.repeats) for r in chosen.collect()] == [(1, 2)]
    assert mixture.mixture(sized(spark, []), targets.limit(0))[1].count() == 0


def test_estimation_separates_matches():
    rng = np.random.default_rng(1)
    match = rng.random(4000) < 0.2
    level = np.where(rng.random((4000, 4)) < np.where(match, 0.9, 0.1)[:, None], 1, 0)
    level[rng.random((4000, 4)) < 0.1] = -1
    patterns, where, counts = np.unique(level, axis=0, return_inverse=True, return_counts=True)
    model = linkage.estimate(patterns, counts.astype(float), [2] * 4, kinds=1)
    guess = model.posterior(patterns)[where.ravel()] > 0.5
    assert abs(model.share - 0.2) < 0.03 and (guess == match).mean() > 0.95
    assert linkage.estimate(np.zeros((0, 4), int), np.zeros(0), [2] * 4).share == pytest.approx(0.3)


def test_neighbours_are_no_matches():
    rng = np.random.default_rng(2)
    kind = rng.choice(3, 6000, p=[0.3, 0.3, 0.4])  # matches, neighbours, chance
    agree = np.array([[0.95] * 8, [0.95] * 4 + [0.05] * 4, [0.9] + [0.05] * 7])
    level = (rng.random((6000, 8)) < agree[kind]).astype(int)
    patterns, where, counts = np.unique(level, axis=0, return_inverse=True, return_counts=True)
    guess = linkage.estimate(patterns, counts.astype(float), [2] * 8).posterior(patterns)[where.ravel()] > 0.5
    assert (guess == (kind == 0)).mean() > 0.98


def test_core_tags(spark):
    cases = {"=A1+SF86.P565": "SF86P565", "TIC-XP26.T863": "XP26T863", "XP035.Q0510": "XP35Q510", "GR9Z.M446": "GR92M446", "KA62 . P294": "KA62P294", "none": None, "": None, None: None}
    frame = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r.x: r.y for r in frame.select("x", core_tag("x").alias("y")).collect()} == cases


def test_null_and_repeated_keys(spark, library):
    values = [(None, "alpha beta"), (None, "gamma delta alpha"), (1, "one two three"), (1, "four alpha"), (1, ""), (2, None), (3, "alpha")]
    frame = spark.createDataFrame(values, "doc_id long, text string")
    for hot in (0, 25):
        got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode(frame, hot_bytes=hot).collect()), key=repr)
        assert got == sorted(((k, library(t)) for k, t in values), key=repr)
    long = [(None, "red green blue " * 60), (None, "one two three " * 70), (5, "north south " * 80), (5, "east west " * 90)]
    pieces = split.split_oversized(spark.createDataFrame(long, "doc_id long, text string"), limit=64, overlap=0).collect()
    for k in (None, 5):
        own = [t for key, t in long if key == k]
        got = [p for p in pieces if p.doc_id == k]
        assert sum(p.piece_no == 0 for p in got) == 2 and sum(len(p.text) for p in got) == sum(map(len, own))
        assert all(any(t[p.start : p.start + p.length] == p.text for t in own) for p in got)


ENTITY = "canonical_tag string, display_name string, normalized_tags array<string>, context_tokens array<string>, updated_at string, words string"


def entities(spark, key, values):
    return spark.createDataFrame([(*v, "clash") for v in values], f"{key} string, {ENTITY}")


def test_devices_and_records(spark):
    random.seed(4)
    devices, records, truth = [], [], set()
    for i in range(300):
        tag, name = f"GR{10 + i % 80}.T{100 + i}", f"Temperaturmessung Kondensat W{1000 + i // 3} {['Vorlauf', 'Kopf', 'Sumpf'][i % 3]}"
        context = [f"P{i // 30:07}", f"E{i}X{i % 7}", f"R{i % 11}F{i}", f"TX{1000 + i // 3}", f"W{1000 + i // 3}", "KONDENSAT", "SK01"]
        devices.append((f"DEV-{i:04}", tag, name, [tag.replace(".", "")], context, "2020"))
        if i % 5:
            noisy = tag if random.random() < 0.6 else None
            kept = [c for c in context if random.random() < 0.75]
            records.append((f"REC-{i:04}", noisy, name.upper() if i % 2 else name, None, [*kept, "NEU"], "2020"))
            truth.add((f"REC-{i:04}", f"DEV-{i:04}"))
    records += [records[0], ("REC-9999", "ZZ11.Q5", None, [], [], "2020"), ("", "GR10.T100", None, None, None, "2020"), (None, None, None, None, None, None), ("REC-9998", None, None, None, None, None)]
    found = match_devices(entities(spark, "record_key", records), entities(spark, "device_id", devices)).collect()
    got = {(r.record_key, r.device_id) for r in found}
    assert len(got & truth) / len(got) > 0.97 and len(got & truth) / len(truth) > 0.93
    assert all(0.2 <= r.confidence <= 1 for r in found) and len(got) == len(found)


def test_large_blocks_are_refined_and_copies_cost_nothing(spark):
    same = ("GR10.T100", "Messung", ["GR10T100"], ["P0000001", "E1X1", "R1F1", "TX1000"], "2020")
    records = [(f"REC-{i:04}", *same) for i in range(400)] + [(f"REC-X{i:03}", f"GR10.T{200 + i}", "Messung", [], ["P0000001", f"E{i}X2", f"R2F{i}", "TX1000", "W1000"], "2020") for i in range(200)]
    devices = [("DEV-0", *same)] + [(f"DEV-X{i:03}", f"GR10.T{200 + i}", "Messung", [], ["P0000001", f"E{i}X2", f"R2F{i}", "TX1000", "W1000"], "2020") for i in range(200)]
    found = match_devices(entities(spark, "record_key", records), entities(spark, "device_id", devices))
    got = {(r.record_key, r.device_id) for r in found.collect()}
    assert sum(d == "DEV-0" for _, d in got) == 400
    assert {(f"REC-X{i:03}", f"DEV-X{i:03}") for i in range(200)} <= got


def test_large_blocks_lose_no_pair(spark):
    def side(prefix):
        return [(f"{prefix}-{i:03}", None, f"Alpha{i} Beta{i} Gamma{i}", None, ["TX1000", "W1000", f"SK{100 + i}"], "2020") for i in range(160)]

    found = match_devices(entities(spark, "record_key", side("REC")), entities(spark, "device_id", side("DEV"))).collect()
    assert {(r.record_key, r.device_id) for r in found} == {(f"REC-{i:03}", f"DEV-{i:03}") for i in range(160)}


def test_tiles_of_a_large_block(spark):
    def side(prefix, n):
        lists = ", ".join(f"{c} array<string>" for c in ("tags", "loop", "place", "rack", "project", "plant", "position"))
        return spark.createDataFrame([(f"{prefix}{i:03}", ["GR10T100"], *[None] * 6) for i in range(n)], f"sig string, {lists}")

    left, right = side("l", 90), side("r", 40)
    scratch = Scratch(spark, "blocks")
    for tile in (1_000, 25, 60):
        assert linkage.candidates(left, right, passes(), scratch, tile).count() == 90 * 40
    large = spark.createDataFrame([("tag|GR10T100", 4, 2)], "block string, l_tiles long, r_tiles long")
    spread = linkage._tiled(linkage._blocks(left, passes(), "l_"), large, "l", "r").groupBy("l_tile", "r_tile").count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 45 and sum(r["count"] for r in spread) == 180


def test_sparse_and_noisy_records_are_proposed(spark):
    context = ["P0000001", "E1X1", "R1F1", "TX1000", "W1000", "KONDENSAT"]
    records = [
        ("rack", "ohne", None, None, ["P0000001", "R1F1"], "2020"),
        ("place", None, None, [], ["E1X1", "P0000001"], "2020"),
        ("loop", "ohne", None, None, ["TX1000", "P0000001"], "2020"),
        ("more", "GR10.T1009", None, None, ["P0000001"], "2020"),
        ("less", "GR10.T10", None, None, ["W1000"], "2020"),
        ("other", "GR10.T109", None, None, ["P0000009"], "2020"),
    ]
    left = features(entities(spark, "record_key", records), "record_key").withColumn("sig", F.col("key"))
    right = features(entities(spark, "device_id", [("DEV", "GR10.T100", "Temperaturmessung Kondensat W1000", ["GR10T100"], context, "2020")]), "device_id").withColumn("sig", F.col("key"))
    got = linkage.candidates(left, right, passes(), Scratch(spark, "blocks")).collect()
    assert {r.l_sig for r in got} == {"rack", "place", "loop", "more", "less"}


def test_placeholders_and_foreign_tags_speak_against_nothing(spark):
    records = [("word", "ohne", "Reg.-V. Konden", None, [], "2020"), ("further", None, "Drehz.", ["GR11F300"], [], "2020"), ("plant", "71-P-2403", "Druckmess. Kondensat", None, [], "2020")]
    found = features(entities(spark, "record_key", records), "record_key")
    left = found.select(*[F.col(c).alias(f"l_{c}") for c in found.columns])
    device = features(entities(spark, "device_id", [("DEV", "GR10.Y100", "Regelventil Kondensat", ["GR10Y100"], [], "2020")]), "device_id")
    pairs = left.crossJoin(device.select(*[F.col(c).alias(f"r_{c}") for c in device.columns]))
    levels = {c.name: c.level for c in comparisons()}
    got = {r.l_key: (r.tag, r.function, r.name) for r in pairs.select("l_key", *[levels[n].alias(n) for n in ("tag", "function", "name")]).collect()}
    assert got == {"word": (None, None, 3), "further": (None, None, 0), "plant": (None, 0, 1)}


def test_linking_nothing(spark):
    none = entities(spark, "record_key", []), entities(spark, "device_id", [])
    assert match_devices(*none).count() == 0
    assert features(none[0], "record_key").where(F.col("key").isNull()).count() == 0


def test_one_worker_serves_many_corpora(spark, library):
    for i in range(8):
        values = [f"corpus {i} {'abcdefgh'[i] * 9} {i * 7919}", "shared words", f"x{i}"]
        got = {r.doc_id: list(r.ids) for r in tokens.encode(texts(spark, values)).collect()}
        assert got == {n: library(x) for n, x in enumerate(values)}
