"""Matching designations and entities: exact, without prefix, fuzzy, weighted, and one-to-one assignment."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docweave.functions.text import clean_cell, jaccard, normalize_akz, normalize_identifier, normalize_label, or_null, rounded, strip_function_prefix
from docweave.functions.values import designation_base, designation_keys
from docweave.operators.ordered import first_per_key
from docweave.operators.orphans import bloom_filter, might_contain


#: Forms of a text with fewer characters that are listed at most; longer texts are looked up by their parts.
MAX_FORMS = 400
#: Forms of one size that a side must have at least to be filtered by those of the other side.
WORTH_A_FILTER = 200_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def exact_or_stripped(keys: DataFrame, targets: DataFrame, key: str = "key", target: str = "key") -> DataFrame:
    """key, matched, method of each distinct designation: ``exact``, ``stripped`` (function prefix removed) or null.

    Both sides are normalised here; blank ones drop out.
    """
    left = keys.select(normalize_akz(key).alias("key")).where("key <> ''").distinct()
    right = targets.select(normalize_akz(target).alias("t")).where("t <> ''").distinct()
    exact = right.select(F.col("t").alias("e"))
    plain = left.withColumn("bare", strip_function_prefix("key"))
    joined = plain.join(exact, F.col("key") == F.col("e"), "left").join(right, F.col("bare") == F.col("t"), "left")
    return joined.select(
        "key",
        F.coalesce("e", "t").alias("matched"),
        F.when(F.col("e").isNotNull(), "exact").when(F.col("t").isNotNull(), "stripped").alias("method"),
    )


def _grams(text: Column, edits: int) -> Column:
    """Pieces of which two texts within ``edits`` edits share at least one: the text cut into edits + 1 parts.

    Cutting depends on the length, so a partner's piece may be shifted by up to ``edits`` places.
    """
    n = edits + 1
    width = F.greatest(F.lit(1), F.ceil(F.length(text) / n).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("part"), F.substring(text, i * width + 1, width).alias("piece")))


def _listed(deletions: int) -> int:
    """The longest text whose shorter forms are listed."""
    return max(n for n in range(1, 64) if sum(comb(n, k) for k in range(deletions + 1)) <= MAX_FORMS)


def _with_forms(df: DataFrame, key: str, sizes: dict[int, list[int]]) -> DataFrame:
    """The rows of ``df`` once for each distinct form of ``key`` that has as many of its characters as ``sizes`` lists for its length.

    ``form`` is a hash of such a form; its last six bits are the size.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(key).to_pylist()
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            for n, of_n in sizes.items():
                at = np.flatnonzero(lengths == n)
                codes = np.frombuffer("".join(texts[i] for i in at).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(at), n)
                for size in of_n:
                    kept = np.array(list(combinations(range(n), size)), np.int64).reshape(comb(n, size), size)
                    step = 1 + 200_000 // len(kept)
                    for first in range(0, len(at), step):
                        part = codes[first : first + step]
                        form = np.zeros((len(part), len(kept)), np.uint64)
                        for j in range(size):
                            form = form * _FACTOR + part[:, kept[:, j]]
                        form = np.sort((form << np.uint64(6)) | np.uint64(size), axis=1)
                        new = np.ones(form.shape, bool)
                        new[:, 1:] = form[:, 1:] != form[:, :-1]
                        rows = batch.take(pa.array(np.repeat(at[first : first + step], new.sum(axis=1))))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(form[new].view(np.int64))], names=[*batch.schema.names, "form"])

    return df.mapInArrow(listed, StructType([*df.schema.fields, StructField("form", LongType())]))


def _sharing(left: DataFrame, right: DataFrame, deletions: int, size: Column, apart: int, condition: Column) -> DataFrame:
    """left_key with the right rows (right_key and others) that meet ``condition`` and share a form of ``size`` characters.

    ``size`` depends on the lengths of both, which differ by ``apart`` at most.  A pair comes out once for every such form
    they share.  Only texts of listed lengths are met, and a text lists no other sizes than those asked for by lengths that
    the other side has.  Where one side has much fewer forms of a size, a Bloom filter of them (8 MB at most) keeps most
    forms of the other side from being moved.  Tables of forms are many times larger than the keys they come from, by
    which their size is estimated, so they are never broadcast.
    """
    longest = _listed(deletions)
    l_side, r_side = left.where(F.length("left_key") <= longest), right.where(F.length("right_key") <= longest)
    of = lambda df, k, n, rows: df.groupBy(F.length(k).alias(n)).agg(F.min(k).alias(k), F.count(F.lit(1)).alias(rows))
    lengths = of(l_side, "left_key", "n", "l_rows").crossJoin(of(r_side, "right_key", "m", "r_rows")).where(F.abs(F.col("n") - F.col("m")) <= apart)
    l_sizes, r_sizes, l_rows, r_rows = defaultdict(set), defaultdict(set), {}, {}
    asked = lengths.select("n", "m", "l_rows", "r_rows", size.cast("int").alias("size")).where("size <= least(n, m)")
    for r in asked.collect():  # at most 63 x 63
        l_sizes[r.n].add(r.size)
        r_sizes[r.m].add(r.size)
        l_rows[r.n], r_rows[r.m] = r.l_rows, r.r_rows

    def of_size(sizes: dict[int, set[int]], rows: dict[int, int]) -> Counter:
        return sum((Counter({k: rows[n] * comb(n, k) for k in of_n}) for n, of_n in sizes.items()), Counter())

    l_forms, r_forms = of_size(l_sizes, l_rows), of_size(r_sizes, r_rows)

    def forms(df: DataFrame, k: str, sizes: dict, own: Counter, other_df: DataFrame, other_k: str, other_sizes: dict, other: Counter) -> DataFrame:
        listed = _with_forms(df, k, {n: sorted(x) for n, x in sizes.items()})
        many = {x for x in own if own[x] > 4 * other[x] and own[x] > WORTH_A_FILTER}
        if not many:
            return listed
        few = {n: sorted(x & many) for n, x in other_sizes.items() if x & many}
        held = _with_forms(other_df.select(other_k), other_k, few)
        bloom = bloom_filter(held, "form", sum(other[x] for x in many), max_parts=1)
        return listed.where(~F.col("form").bitwiseAND(63).isin(sorted(many)) | might_contain(listed, *bloom, "form"))

    l_listed = forms(l_side, "left_key", l_sizes, l_forms, r_side, "right_key", r_sizes, r_forms)
    r_listed = forms(r_side, "right_key", r_sizes, r_forms, l_side, "left_key", l_sizes, l_forms)
    met = l_listed.hint("merge").join(r_listed.hint("merge"), "form")
    return met.where((F.col("form").bitwiseAND(63) == size) & condition).drop("form")


def _by_parts(left: DataFrame, right: DataFrame, edits: int, beyond: int) -> DataFrame:
    """Pairs within ``edits`` edits, of which the longer text has more than ``beyond`` characters; several times at most.

    Of a text cut into ``edits + 1`` parts at least one survives any ``edits`` edits, shifted by no more than that.  So
    every part of the right text is looked up among all places of the left text it can have: an equality join on
    (length, part, piece) instead of a comparison of all pairs, and it loses none.
    """
    n = edits + 1
    l_side, r_side = left.where(F.length("left_key") > beyond - edits), right.where(F.length("right_key") > beyond - edits)
    parts = r_side.withColumns({"size": F.length("right_key"), "g": F.explode(_grams(F.col("right_key"), edits))})
    parts = parts.withColumns({"part": F.col("g.part"), "piece": F.col("g.piece")}).drop("g")
    sized = l_side.select(
        "left_key",
        F.explode(F.sequence(F.greatest(F.lit(1), F.length("left_key") - edits), F.length("left_key") + edits)).alias("size"),
    )
    there = r_side.select(F.length("right_key").alias("size")).distinct()
    sized = sized.where(F.greatest(F.length("left_key"), "size") > beyond).join(F.broadcast(there), "size", "left_semi").withColumn("width", F.greatest(F.lit(1), F.ceil(F.col("size") / n).cast("int")))
    places = sized.select("left_key", "size", "width", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part")).select(
        "left_key", "size", "part", "width", F.explode(F.sequence(F.lit(-edits), F.lit(edits))).alias("shift")
    )
    start = F.col("part") * F.col("width") + 1 + F.col("shift")
    own = F.least(F.col("width"), F.greatest(F.lit(0), F.col("size") - F.col("part") * F.col("width")))
    pieces = places.where(start >= 1).select("left_key", "size", "part", F.substring("left_key", start, own).alias("piece")).distinct()
    met = pieces.hint("merge").join(parts.hint("merge"), ["size", "part", "piece"]).drop("size", "part", "piece")  # much larger than the keys
    longer = F.greatest(F.length("left_key"), F.length("right_key")) > beyond
    return met.where(longer & (F.levenshtein("left_key", "right_key", edits) >= 0))


def near_pairs(left: DataFrame, right: DataFrame, edits: int) -> DataFrame:
    """left_key with the right rows (right_key and others) within ``edits`` edits and their distance; pairs may repeat.

    Two texts within that many edits share a form of the longer one's length less the edits, so short texts meet by an
    equality join on such forms; longer ones, which have too many forms, meet by parts.
    """
    size = F.greatest(F.lit(0), F.greatest(F.length("left_key"), F.length("right_key")) - edits)
    met = _sharing(left, right, edits, size, edits, F.levenshtein("left_key", "right_key", edits) >= 0)
    pairs = met.unionByName(_by_parts(left, right, edits, _listed(edits)))
    return pairs.withColumn("distance", F.levenshtein("left_key", "right_key"))


def _keyed(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(name)).where(F.col(name) != "").distinct()


def within_edits(left: DataFrame, right: DataFrame, key: str, edits: int) -> DataFrame:
    """left_key, right_key, distance of all distinct pairs within ``edits`` Levenshtein edits."""
    return near_pairs(_keyed(left, key, "left_key"), _keyed(right, key, "right_key"), edits).distinct()


def nearest_within(left: DataFrame, right: DataFrame, key: str, edits: int) -> DataFrame:
    """left_key, right_key, distance of the nearest right text of each left one, the smaller text among equals.

    Only texts without any partner within fewer edits are compared with those within more.
    """
    from docweave.scratch import Scratch

    scratch = Scratch(left.sparkSession, "nearest")
    r_side = scratch.save(_keyed(right, key, "right_key"))
    rest, found = scratch.save(_keyed(left, key, "left_key")), []
    for n in range(edits + 1):
        found.append(scratch.save(near_pairs(rest, r_side, n).groupBy("left_key").agg(F.min("right_key").alias("right_key"), F.min("distance").alias("distance"))))
        if n < edits:
            rest = scratch.save(rest.join(found[-1], "left_key", "left_anti"))
    return reduce(DataFrame.unionByName, found)


def similarity_ratio(left: str, right: str) -> float:
    """Share of characters in matching blocks (Ratcliff/Obershelp)."""
    return SequenceMatcher(None, left, right).ratio()


def _may_reach(left: pd.Series, right: pd.Series, edits: int) -> np.ndarray:
    """Pairs whose common characters, counted without order in 64 classes, allow so few edits: an upper bound of the ratio."""

    def counts(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        upper = texts.str.upper()
        sizes = upper.str.len().to_numpy()
        points = np.frombuffer("".join(upper).encode("utf-32-le"), np.uint32) % 64
        row = np.repeat(np.arange(len(texts)), sizes)
        return np.bincount(row * 64 + points, minlength=len(texts) * 64).reshape(len(texts), 64), sizes

    if not len(left):
        return np.zeros(0, bool)
    (a, n), (b, m) = counts(left), counts(right)
    bound = 2 * np.minimum(a, b).sum(axis=1) / np.maximum(n + m, 1)
    return (1 - bound) * np.maximum(n, m) <= edits + 0.5 + 1e-9


def ratio_matches(pairs: DataFrame, edits: int = 2) -> DataFrame:
    """left_key, right_key, edits, ratio of candidate pairs by matching blocks, best per left key.

    Edits are (1 - ratio) times the longer length, rounded; pairs beyond ``edits`` drop out, ties go to the smaller
    right key.  Candidates usually come from ``ratio_candidates``.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = batch[_may_reach(batch["left_key"], batch["right_key"], edits)]
            ratio = [similarity_ratio(a.upper(), b.upper()) for a, b in zip(near["left_key"], near["right_key"], strict=True)]
            longest = [max(len(a), len(b), 1) for a, b in zip(near["left_key"], near["right_key"], strict=True)]
            yield near.assign(ratio=ratio, edits=[round((1 - r) * n) for r, n in zip(ratio, longest, strict=True)])

    scored = pairs.select("left_key", "right_key").mapInPandas(score, "left_key string, right_key string, ratio double, edits bigint")
    kept = scored.where(F.col("edits") <= edits).withColumn("order", -F.col("ratio"))
    return first_per_key(kept, ["left_key"], ["order", "right_key"]).select("left_key", "right_key", "edits", "ratio")


def best_by_ratio(left: DataFrame, right: DataFrame, key: str, edits: int = 2) -> DataFrame:
    """left_key, right_key, edits, ratio: the text itself where the right side has it, else the best partner by ratio.

    Only texts without an equal partner are compared, since nothing can be nearer than an equal text; and of those only
    texts whose best partner with two characters outside matching blocks is no better than one with three could be are
    compared with all.
    """
    from docweave.scratch import Scratch

    scratch = Scratch(left.sparkSession, "ratio")
    l_side, r_side = scratch.save(_keyed(left, key, "left_key")), scratch.save(_keyed(right, key, "right_key"))
    same = F.col("left_key") == F.col("right_key")
    exact = l_side.join(r_side.hint("merge"), same, "left_semi").select(
        "left_key", F.col("left_key").alias("right_key"), F.lit(0).cast("bigint").alias("edits"), F.lit(1.0).alias("ratio")
    )
    rest = scratch.save(l_side.join(r_side.hint("merge"), same, "left_anti"))
    both, close = F.length("left_key") + F.length("right_key"), F.abs(F.length("left_key") - F.length("right_key")) <= edits
    alike = _sharing(rest, r_side, 2, F.greatest(F.lit(0), F.ceil(both / 2) - 1), edits, close)
    first = scratch.save(ratio_matches(_spread_pairs(alike), edits))
    bound = 1 - 3 / (2 * F.length("left_key") + edits)  # of any pair with three characters outside matching blocks
    settled = first.where((F.col("ratio") > bound + 1e-9) & (F.length("left_key") + edits <= _listed(2)))
    others = scratch.save(rest.join(settled.hint("merge"), "left_key", "left_anti"))
    further = ratio_matches(ratio_candidates(others, r_side.withColumnRenamed("right_key", "left_key"), "left_key", edits), edits)
    return exact.unionByName(settled).unionByName(further)


def _spread_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct left_key, right_key over all cores; comparing them costs much more than moving them."""
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    return pairs.select("left_key", "right_key").repartition(4 * cores, "left_key").distinct()


def ratio_candidates(left: DataFrame, right: DataFrame, key: str, edits: int = 2) -> DataFrame:
    """Pairs that can have at most ``edits`` by ratio, and whose lengths differ by no more.

    (1 - ratio) * longest <= edits + 1/2 says how many characters must lie in matching blocks, which are a common
    subsequence; it leaves at most 2 * edits characters of both texts outside, so that many insertions and deletions
    turn one into the other.
    """
    l_side, r_side = _keyed(left, key, "left_key"), _keyed(right, key, "right_key")
    n, m = F.length("left_key"), F.length("right_key")
    longest, close, deletions = F.greatest(n, m), F.abs(n - m) <= edits, (3 * edits + 1) // 2
    size = F.greatest(F.lit(0), F.ceil((n + m) * (2 * longest - 2 * edits - 1) / (4 * longest)))
    met = _sharing(l_side, r_side, deletions, size, edits, close).unionByName(_by_parts(l_side, r_side, 2 * edits, _listed(deletions)).where(close))
    return _spread_pairs(met)


def canonical_map(occurrences: DataFrame) -> DataFrame:
    """Designations brought together across documents: canonical, original, confidence, method.

    ``occurrences``: designation (raw), n or more rows each.  Spellings that normalise alike are one group; a designation
    that occurs once joins the first group (by text) within one edit; others stay alone with confidence 0.7.
    """
    rows = occurrences.select(normalize_akz("designation").alias("key"), F.col("designation").alias("original")).where("key <> ''")
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    groups, single = counted.where("n > 1").select("key"), counted.where("n = 1").select("key")
    near = within_edits(single, groups, "key", 1).groupBy("left_key").agg(F.min("right_key").alias("into"))
    merged = counted.join(near, F.col("key") == F.col("left_key"), "left")
    state = merged.select(
        "key",
        F.coalesce("into", "key").alias("canonical"),
        F.when((F.col("n") > 1) | F.col("into").isNotNull(), 1.0).otherwise(0.7).alias("confidence"),
        F.when((F.col("n") > 1) | F.col("into").isNotNull(), "exact").otherwise("singleton_unmatched").alias("method"),
    )
    return rows.join(state, "key").select("canonical", "original", "confidence", "method")


# ---------------------------------------------------------------- field names

TIERS = (("exact", 0.98), ("synonym", 0.95), ("partial", 0.85))


def _inside(left: DataFrame, right: DataFrame) -> DataFrame:
    """part, whole of distinct labels (column ``label`` of either side) of which ``left`` has the part and ``right`` the whole.

    A part is looked up by its first three characters (or as many as it has) among all such pieces of the wholes.
    """
    size = F.least(F.lit(3), F.length("label"))
    parts = left.select(F.col("label").alias("part"), F.substring("label", F.lit(1), size).alias("piece"))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("label") - n + 1, F.lit(1))), lambda i: F.substring("label", i, F.lit(n)))
    pieces = right.select(F.col("label").alias("whole"), F.explode(F.array_distinct(F.concat(at(1), at(2), at(3)))).alias("piece"))
    return parts.join(pieces, "piece").where(F.contains("whole", "part")).select("part", "whole")


def _related(f: DataFrame, h: DataFrame) -> DataFrame:
    """f_label, h_label of distinct labels that are equal or contain one another."""
    fields, heads = f.select(F.col("f_label").alias("label")).distinct(), h.select(F.col("h_label").alias("label")).distinct()
    one = _inside(fields, heads).select(F.col("part").alias("f_label"), F.col("whole").alias("h_label"))
    other = _inside(heads, fields).select(F.col("whole").alias("f_label"), F.col("part").alias("h_label"))
    return one.unionByName(other).distinct()


def match_fields(fields: DataFrame, headers: DataFrame) -> DataFrame:
    """field, header of every pair whose labels are equal or contain one another.

    Labels without letters or digits match nothing.  Labels meet by short pieces they share, so a growing number of
    freely typed headers is not compared with every field.
    """
    f = fields.select("field", normalize_label("field").alias("f_label")).where("f_label <> ''").distinct()
    h = headers.select("header", normalize_label("header").alias("h_label")).where("h_label <> ''").distinct()
    return _related(f, h).join(f, "f_label").join(h, "h_label").select("field", "header").distinct()


def match_field_tiers(fields: DataFrame, headers: DataFrame, synonyms: DataFrame) -> DataFrame:
    """field, header, confidence, tier of the best header: equal label, then synonym, then containing label.

    ``synonyms``: field, synonym.  The first header in ``ord`` wins within a tier.
    """
    f = fields.select("field", normalize_label("field").alias("f_label")).where("f_label <> ''").distinct()
    h = headers.select("header", "ord", normalize_label("header").alias("h_label")).where("h_label <> ''")
    exact = f.join(h, F.col("f_label") == F.col("h_label")).select("field", "header", "ord", F.lit(0).alias("t"))
    alike = synonyms.select("field", normalize_label("synonym").alias("s_label")).where("s_label <> ''").distinct()
    synonym = f.select("field").join(alike, "field").join(h, F.col("s_label") == F.col("h_label")).select("field", "header", "ord", F.lit(1).alias("t"))
    partial = _related(f, h).join(f, "f_label").join(h, "h_label").select("field", "header", "ord", F.lit(2).alias("t"))
    best = first_per_key(exact.unionByName(synonym).unionByName(partial), ["field"], ["t", "ord", "header"])
    names, scores = F.array(*[F.lit(n) for n, _ in TIERS]), F.array(*[F.lit(s) for _, s in TIERS])
    return best.select("field", "header", F.get(scores, F.col("t")).alias("confidence"), F.get(names, F.col("t")).alias("tier"))


# ---------------------------------------------------------------- weighted resolution

#: Weights of shared canonical tag, other shared tag, labels, context and device; least score.
WEIGHTS = {"canonical": 0.7, "shared": 0.55, "label": 0.15, "context": 0.2, "device": 0.1}
LEAST_SCORE = 0.35


def entity_pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """source_key, target_key, score of pairs that reach the least score.

    Both sides: key, canonical_tag, tags, label_tokens, context_tokens (arrays), device.  Without a shared tag, labels and
    contexts give 0.35 only if both are equal; with an equal device they must still give 0.25, for which half the context
    must be shared.  So pairs are blocked on a shared tag, on equal labels and contexts, or on device and a shared context
    token, which loses none.
    """

    def prepared(df: DataFrame, p: str) -> DataFrame:
        none = F.array().cast("array<string>")
        return df.select(
            F.col("key").alias(f"{p}_key"),
            normalize_identifier("canonical_tag").alias(f"{p}_tag"),
            F.array_distinct(F.filter(F.transform(F.coalesce("tags", none), normalize_identifier), lambda x: x != "")).alias(f"{p}_tags"),
            F.array_distinct(F.coalesce("label_tokens", none)).alias(f"{p}_label"),
            F.array_distinct(F.coalesce("context_tokens", none)).alias(f"{p}_context"),
            normalize_identifier("device").alias(f"{p}_device"),
        ).where(f"trim({p}_key) <> ''")

    s, t = prepared(sources, "s"), prepared(targets, "t")

    def blocks(df: DataFrame, p: str) -> DataFrame:
        device = F.transform(f"{p}_context", lambda b: F.concat(F.lit("d|"), F.col(f"{p}_device"), F.lit("|"), b))
        same = F.md5(F.concat(F.to_json(F.sort_array(f"{p}_label")), F.to_json(F.sort_array(f"{p}_context"))))
        no = F.array().cast("array<string>")
        keys = F.concat(
            F.transform(f"{p}_tags", lambda x: F.concat(F.lit("t|"), x)),
            F.when((F.size(f"{p}_label") > 0) & (F.size(f"{p}_context") > 0), F.array(same)).otherwise(no),
            F.when(F.col(f"{p}_device") != "", device).otherwise(no),
        )
        return df.select(f"{p}_key", F.explode(F.array_distinct(keys)).alias("block"))

    pairs = blocks(s, "s").join(blocks(t, "t"), "block").select("s_key", "t_key").distinct()
    full = pairs.join(s, "s_key").join(t, "t_key")
    shared = F.array_intersect("s_tags", "t_tags")
    tag = F.when(
        F.array_contains(shared, F.col("s_tag")) & (F.col("s_tag") == F.col("t_tag")), WEIGHTS["canonical"]
    ).when(F.size(shared) > 0, WEIGHTS["shared"]).otherwise(0.0)
    device = F.when((F.col("s_device") == F.col("t_device")) & (F.col("s_device") != ""), WEIGHTS["device"]).otherwise(0.0)
    score = tag + WEIGHTS["label"] * jaccard("s_label", "t_label") + WEIGHTS["context"] * jaccard("s_context", "t_context") + device
    scored = full.withColumn("score", F.least(F.lit(1.0), score)).where(F.col("score") >= LEAST_SCORE)
    return scored.select(F.col("s_key").alias("source_key"), F.col("t_key").alias("target_key"), "score")


def assign_one_to_one(pairs: DataFrame, component: DataFrame, exact_size: int = 8) -> DataFrame:
    """source_key, target_key, score: each key at most once, best total per component.

    ``component``: node, component (nodes ``s|key`` and ``t|key``).  Components of at most ``exact_size`` keys a side are
    solved exactly, larger ones greedily by score, source, target.  A large component is not collected: its greedy
    choice is made in rounds of mutually best pairs, which gives the same pairs.
    """
    placed = pairs.join(component, F.concat(F.lit("s|"), "source_key") == F.col("node")).drop("node")
    sizes = placed.groupBy("component").agg(F.countDistinct("source_key").alias("n_s"), F.countDistinct("target_key").alias("n_t"))
    sized = placed.join(sizes, "component")
    small = sized.where((F.col("n_s") <= exact_size) & (F.col("n_t") <= exact_size))
    solved = small.select("component", "source_key", "target_key", "score").groupBy("component").applyInPandas(
        _solve, "source_key string, target_key string, score double"
    )
    large = sized.where((F.col("n_s") > exact_size) | (F.col("n_t") > exact_size)).select("source_key", "target_key", "score")
    return solved.unionByName(greedy_pairs(large))


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs a greedy pass by (score down, source, target) takes, found in rounds of mutually best pairs."""
    from docweave.scratch import Scratch

    scratch = Scratch(pairs.sparkSession, "greedy")
    left, taken = scratch.save(pairs), []
    while not left.isEmpty():
        ranked = left.withColumn("order", F.struct((-F.col("score")).alias("s"), F.col("source_key").alias("a"), F.col("target_key").alias("b")))
        by_source = ranked.groupBy("source_key").agg(F.min("order").alias("best"))
        by_target = ranked.groupBy("target_key").agg(F.min("order").alias("best"))
        mutual = by_source.join(by_target.select("best"), "best").select(
            F.col("best.a").alias("source_key"), F.col("best.b").alias("target_key"), (-F.col("best.s")).alias("score")
        )
        chosen = scratch.save(mutual)
        taken.append(chosen)
        rest = left.join(chosen.select("source_key"), "source_key", "left_anti").join(chosen.select("target_key"), "target_key", "left_anti")
        after = scratch.save(rest.select("source_key", "target_key", "score"))
        scratch.drop(left)
        left = after
        if len(taken) > 24:  # keeps the plan short
            taken = [scratch.save(reduce(DataFrame.unionByName, taken))]
    return reduce(DataFrame.unionByName, taken, left.select("source_key", "target_key", "score"))


def _solve(part: pd.DataFrame) -> pd.DataFrame:
    """Best total over one-to-one choices of a small component; sources may stay free."""
    sources, targets = sorted(set(part["source_key"])), sorted(set(part["target_key"]))
    score = {(a, b): s for a, b, s in zip(part["source_key"], part["target_key"], part["score"], strict=True)}
    best: dict[int, tuple[float, list]] = {0: (0.0, [])}
    for a in reversed(sources):  # the choice of earlier sources is settled last, so ties leave later targets free
        after = dict(best)
        for used, (total, chosen) in best.items():
            for i, b in enumerate(targets):
                if (a, b) in score and not used >> i & 1:
                    key, value = used | 1 << i, total + score[a, b]
                    if value > after.get(key, (-1.0, []))[0] + 1e-12:
                        after[key] = (value, [(a, b), *chosen])
        best = after
    _, chosen = max(best.values(), key=lambda x: x[0])
    return pd.DataFrame({"source_key": [a for a, _ in chosen], "target_key": [b for _, b in chosen], "score": [score[p] for p in chosen]})


# ---------------------------------------------------------------- designations and evidence


def resolve_designations(candidates: DataFrame, elements: DataFrame) -> DataFrame:
    """key, element_id: the first candidate spelling that names an element.

    ``candidates``: key, ord, designation.  ``elements``: element_id, designation, ord.  Exact spellings come first, the
    earliest element among equals; then, for candidates without a terminal, the base designation if it names one element.
    """
    named = elements.where(F.trim("designation") != "")
    spelled = named.select("element_id", "ord", F.explode(designation_keys("designation")).alias("k"))
    exact = spelled.groupBy("k").agg(F.min(F.struct("ord", "element_id")).alias("e")).select("k", F.col("e.element_id").alias("element_id"))
    base = (
        named.select("element_id", designation_base("designation").alias("k")).where("k <> ''").distinct()
        .groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("element_id").alias("element_id")).where("n = 1").drop("n")
    )
    tried = candidates.where(F.trim("designation") != "")
    first = tried.select("key", "ord", F.posexplode(designation_keys("designation")).alias("p", "k")).join(exact, "k").select(
        "key", F.lit(0).alias("tier"), "ord", "p", "element_id"
    )
    second = (
        tried.where(~F.contains("designation", F.lit(":"))).select("key", "ord", designation_base("designation").alias("k"))
        .join(base, "k").select("key", F.lit(1).alias("tier"), "ord", F.lit(0).alias("p"), "element_id")
    )
    return first_per_key(first.unionByName(second), ["key"], ["tier", "ord", "p"]).select("key", "element_id")


def evidence_for_fields(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """record, field, evidence_id by precedence: the field's own evidence key, then record and field, record, document.

    ``fields``: record, field, document, evidence_key.  ``evidence``: evidence_id, record, field, document, key, ord;
    empty strings mean none.  The earliest evidence wins on each level; fields without any keep a null id.
    """

    def first(keys: list[str]) -> DataFrame:
        some = evidence.where(" and ".join(f"{k} <> ''" for k in keys))
        return some.groupBy(*keys).agg(F.min(F.struct("ord", "evidence_id")).alias("e")).select(
            *[F.col(k).alias(f"e_{k}") for k in keys], F.col("e.evidence_id").alias("id")
        )

    found = fields
    for i, keys in enumerate((["key"], ["record", "field"], ["record"], ["document"])):
        own = {"key": "evidence_key"}
        level = first(keys).withColumnRenamed("id", f"id{i}")
        condition = [F.col(own.get(k, k)) == F.col(f"e_{k}") for k in keys]
        found = found.join(level, condition, "left").drop(*[f"e_{k}" for k in keys])
    return found.select("record", "field", F.coalesce("id0", "id1", "id2", "id3").alias("evidence_id"))


def fill_blanks(rows: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with blank cells of ``columns`` filled from the last ``source`` row (by ``ord``) of the same key.

    Keys compare cleaned, without case and underscores.  Rows without a partner stay as they are.
    """
    fold = lambda c: F.replace(F.lower(clean_cell(c)), F.lit("_"), F.lit(""))
    last = source.groupBy(fold(key).alias("_k")).agg(F.max(F.struct("ord", *columns)).alias("_s")).where("_k <> ''")
    joined = rows.withColumn("_k", fold(key)).join(last, "_k", "left")
    filled = {c: F.coalesce(or_null(F.trim(c)), F.col("_s")[c], F.col(c)) for c in columns}
    return joined.withColumns(filled).drop("_k", "_s")


def nearest(points: DataFrame, nodes: DataFrame, within: list[str]) -> DataFrame:
    """within, point_id, node_id, distance: the nearest node of the same page whose reach covers the point.

    ``points``: point_id, x, y.  ``nodes``: node_id, ord, box (x0, y0, x1, y1).  A node reaches 48 or twice its longer
    side from its centre; ties go to the earlier node.  Pages are small; points and nodes meet on the page.
    """
    centred = nodes.select(
        *within, "node_id", "ord",
        ((F.col("box")[0] + F.col("box")[2]) / 2).alias("cx"), ((F.col("box")[1] + F.col("box")[3]) / 2).alias("cy"),
        F.greatest(F.lit(48.0), 2 * F.greatest(F.col("box")[2] - F.col("box")[0], F.col("box")[3] - F.col("box")[1])).alias("reach"),
    )
    pairs = points.join(centred, within).withColumn("distance", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    best = first_per_key(pairs.where("distance <= reach").select(*within, "point_id", "distance", "ord", "node_id"), [*within, "point_id"], ["distance", "ord"])
    return best.select(*within, "point_id", "node_id", rounded(F.col("distance"), 6).alias("distance"))
