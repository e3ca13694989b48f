"""Decisions over evidence: presence, votes, cardinality, finalised rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import clean_cell, normalize_identifier, or_null, rounded, strip_function_prefix, text_or_empty
from docweave.operators.matching import near_pairs, nearest_within
from docweave.operators.ordered import first_per_key
from docweave.scratch import Scratch


def presence(strict: Column, top_score: Column, supports: Column) -> Column:
    """struct(decision, confidence, needs_review, reason): a ladder from certain presence to the need for review."""
    top, n = F.coalesce(top_score, F.lit(0.0)), F.coalesce(supports, F.lit(0))
    make = lambda d, c, r, why: F.struct(
        F.lit(d).alias("decision"), c.cast("double").alias("confidence"), r.alias("needs_review"), why.alias("reason")
    )
    clamp = lambda low, high: F.least(F.lit(high), F.greatest(F.lit(low), top))
    weak = top < 0.85
    return (
        F.when(F.coalesce(strict, F.lit(False)), make("present", F.lit(1.0), F.lit(False), F.lit("")))
        .when(
            (top >= 0.70) | ((n >= 2) & (top >= 0.40)),
            make("present", clamp(0.65, 0.95), weak, F.when(weak, "retrieval_only_alignment").otherwise("")),
        )
        .when((top <= 0.20) & (n == 0), make("missing", F.lit(0.9), F.lit(False), F.lit("no_supporting_evidence")))
        .otherwise(make("needs_review", clamp(0.35, 0.75), F.lit(True), F.lit("ambiguous_retrieval")))
    )


def vote_tracks(a: DataFrame, b: DataFrame, least_agreement: float = 0.7) -> DataFrame:
    """One row per key of two tracks (key, value, confidence): the value taken, its confidence, and who agreed.

    Both agree: mean confidence.  They differ: the more confident one, the first track on ties.  Only one: that one.
    ``needs_review`` unless they agree; the keys of each side are distinct.
    """
    joined = a.select("key", F.col("value").alias("a"), F.col("confidence").alias("ca")).join(
        b.select("key", F.col("value").alias("b"), F.col("confidence").alias("cb")), "key", "full_outer"
    )
    both, same = F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a") == F.col("b")
    status = F.when(both & same, "agreed").when(both, "disagreed").when(F.col("a").isNotNull(), "only_a").otherwise("only_b")
    first = F.col("ca") >= F.col("cb")
    value = F.when(status == "disagreed", F.when(first, F.col("a")).otherwise(F.col("b"))).otherwise(F.coalesce("a", "b"))
    confidence = F.when(status == "agreed", (F.col("ca") + F.col("cb")) / 2).otherwise(F.greatest("ca", "cb"))
    return joined.select("key", value.alias("value"), rounded(confidence).alias("confidence"), status.alias("status"), (status != "agreed").alias("needs_review"))


def agreement(votes: DataFrame) -> DataFrame:
    """Keys, agreed keys and their ratio."""
    return votes.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("status") == "agreed").alias("n_agreed"),
        rounded(F.count_if(F.col("status") == "agreed") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("agreement"),
    )


def cardinality(source: DataFrame, targets: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations of "must occur in": key, missing_in, present_in (sorted arrays), severity, confidence, review_status.

    ``source``: key (normalised designations).  ``targets``: doc_type, key.  ``rules``: target_doc, min_count, severity.
    A key is present in a target if it or its form without function prefix occurs there, or something within one edit of
    either; two edits leave an obligatory target missing and ask for review.  An obligatory target without any keys is
    missing outright.  Only keys that miss an obligatory target come out.  Tables that grow with the keys are merged by
    sorting, never broadcast.
    """
    rule = rules.groupBy("target_doc").agg(F.max("min_count").alias("min_count"), F.min("severity").alias("severity"))
    scratch = Scratch(source.sparkSession, "cardinality")
    keys = scratch.save(source.select("key").where("key <> ''").distinct())
    named = rule.select(F.col("target_doc").alias("doc_type"))
    has = scratch.save(targets.where("key <> ''").select("doc_type", "key").distinct().join(F.broadcast(named), "doc_type", "left_semi"))
    forms = scratch.save(keys.select("key", F.explode(F.array_distinct(F.array("key", strip_function_prefix("key")))).alias("form")))

    def near(of: DataFrame, edits: int) -> DataFrame:
        found = nearest_by_target(of.select(F.col("form").alias("key")), has, edits)
        return of.join(found.withColumnRenamed("left_key", "form").hint("merge"), "form").groupBy("key", "doc_type").agg(F.min("distance").alias("distance"))

    close = scratch.save(near(forms, 1))
    # only keys that miss an obligatory target come out, so only those are looked for within two edits
    asked_for = rule.where("min_count > 0").select(F.col("target_doc").alias("doc_type"))
    known = close.hint("merge")
    short = keys.crossJoin(F.broadcast(asked_for)).join(known, ["key", "doc_type"], "left_anti").select("key").distinct()
    asking = scratch.save(forms.join(short.hint("merge"), "key", "left_semi"))
    best = close.unionByName(near(asking, 2).join(known, ["key", "doc_type"], "left_anti")).hint("merge")
    # rules are a short list, so every key carries all of them
    every = rule.agg(F.collect_list(F.struct("target_doc", "min_count", "severity"))).scalar()
    asked_of = keys.withColumn("rule", F.explode(every)).select("key", "rule.*")
    state = asked_of.join(best, (best["key"] == asked_of["key"]) & (best["doc_type"] == F.col("target_doc")), "left").select(
        asked_of["key"], "target_doc", "min_count", "severity", "distance"
    )
    present, asked = F.col("distance") <= 1, F.col("distance") == 2
    missing = ~F.coalesce(present, F.lit(False)) & (F.col("min_count") > 0)
    found = state.groupBy("key").agg(
        F.sort_array(F.collect_list(F.when(missing, F.col("target_doc")))).alias("missing_in"),
        F.sort_array(F.collect_list(F.when(present, F.col("target_doc")))).alias("present_in"),
        F.max(F.coalesce(missing & (F.col("severity") == "critical"), F.lit(False))).alias("critical"),
        F.max(F.coalesce(asked, F.lit(False))).alias("asked"),
    )
    return found.where(F.size("missing_in") > 0).select(
        "key", "missing_in", "present_in",
        F.when(F.col("critical"), "critical").otherwise("warning").alias("severity"),
        F.when(F.col("asked"), 0.75).otherwise(0.95).alias("confidence"),
        F.when(F.col("asked"), "needs_review").otherwise("auto").alias("review_status"),
    )


def nearest_by_target(keys: DataFrame, targets: DataFrame, edits: int = 2) -> DataFrame:
    """left_key, doc_type, distance: how near each target type comes to each key, within ``edits``."""
    left = keys.select(F.col("key").alias("left_key")).where("left_key <> ''").distinct()
    right = targets.where("key <> ''").groupBy(F.col("key").alias("right_key")).agg(F.collect_set("doc_type").alias("types"))
    pairs = near_pairs(left, right, edits).select("left_key", F.explode("types").alias("doc_type"), "distance")
    return pairs.groupBy("left_key", "doc_type").agg(F.min("distance").alias("distance"))


def near_misses(missing: DataFrame, targets: DataFrame, edits: int = 2) -> DataFrame:
    """left_key, right_key, distance: the nearest existing key of each missing one."""
    return nearest_within(missing, targets, "key", edits)


def finalize(rows: DataFrame, confidence: float = 0.7, method: str = "exact_tag") -> DataFrame:
    """Missing confidence, method and review reason filled in: columns match_confidence, match_method, needs_review_reason."""
    score = F.coalesce(or_null("match_confidence").try_cast("double"), F.lit(confidence))
    reason = F.when(score < 0.8, "low_confidence").otherwise("")
    return rows.withColumns(
        {
            "match_confidence": score,
            "match_method": F.coalesce(or_null("match_method"), F.lit(method)),
            "needs_review_reason": F.coalesce(or_null("needs_review_reason"), reason),
        }
    )


def tagged(conditions: dict[str, Column], separator: str = " | ") -> Column:
    """The names of the conditions that hold, joined."""
    return F.concat_ws(separator, *[F.when(c, F.lit(n)) for n, c in conditions.items()])


def noisy_or(confidence: Column, cap: float = 1.0) -> Column:
    """Aggregate: confidence that at least one of several independent sources is right."""
    miss = F.greatest(F.lit(0.0), F.lit(1.0) - confidence)
    return F.least(F.lit(cap), 1 - F.product(miss))


def majority(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value per key, the first seen among equals."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return first_per_key(counted.withColumn("m", -F.col("n")), keys, ["m", "first"]).select(*keys, value, "n")


def least_confidence(*parts: Column) -> Column:
    """The smallest positive confidence, null without one."""
    return rounded(F.least(*[F.when(p > 0, F.least(F.lit(1.0), p)) for p in parts], F.lit(None).cast("double")))


def decision_status(decision: Column | str) -> Column:
    """The short state of a decision."""
    text = text_or_empty(decision)
    return F.when(text == "present", "present").when(text == "missing", "missing").otherwise("needs_review")


def route(rows: DataFrame, routes: dict[str, Column], name: str = "source_type") -> DataFrame:
    """Rows once for each route whose predicate they meet."""
    marks = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in routes.items()]))
    return rows.withColumn(name, F.explode(marks))


def with_verdicts(rows: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the verdict of an outside judge (keys, verdict, confidence) where there is one, else ``unavailable``.

    The surest verdict of a key counts.  Without any verdicts every row keeps its rule-based state.
    """
    best = verdicts.groupBy(*keys).agg(F.max(F.struct("confidence", "verdict")).alias("_v"))
    joined = rows.join(best, keys, "left")
    return joined.withColumns({"verdict": F.coalesce("_v.verdict", F.lit("unavailable")), "verdict_confidence": F.col("_v.confidence")}).drop("_v")


def group_rows(rows: DataFrame, candidates: list[str]) -> DataFrame:
    """Rows with ``identity``, the first candidate column that is filled after folding; rows without one are left out."""
    first = F.coalesce(*[or_null(normalize_identifier(clean_cell(c))) for c in candidates if c in rows.columns])
    return rows.withColumn("identity", first).where("identity is not null")


def group_summary(rows: DataFrame, keys: list[str], confidence: str, needs_review: Column, text: str, order: str, first: int = 3) -> DataFrame:
    """Per group: rows, least and mean confidence (3 places), whether any needs review, and the first texts by ``order``.

    A text is reduced to its first place, and the first ones are found by rank, before the texts of a group meet.
    """
    from docweave.operators.ordered import top_k

    figures = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(confidence).alias("least"), F.round(F.avg(confidence), 3).alias("mean"),
        F.max(F.coalesce(needs_review, F.lit(False))).alias("needs_review"),
    )
    once = rows.where(F.col(text) != "").groupBy(*keys, text).agg(F.min(order).alias("_at"))
    top = top_k(once, keys, ["_at", text], first).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", text))).alias("_t"))
    named = top.select(*[F.col(k).alias(f"_{k}") for k in keys], F.array_join(F.transform("_t", lambda x: x[text]), " | ").alias("first_texts"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return figures.join(named, same, "left").select(*keys, "n", "least", "mean", "needs_review", F.coalesce("first_texts", F.lit("")).alias("first_texts"))


def recommended_action(flags: dict[str, Column], none: str = "No completion required") -> Column:
    """The actions whose condition holds, joined; a fixed text without any."""
    return F.coalesce(or_null(tagged(flags, "; ")), F.lit(none))


def dispatch(rows: DataFrame, family: str, extractors: dict) -> DataFrame:
    """The united results of each family's extractor (a function of its rows); families without one give nothing."""
    from functools import reduce

    parts = [extract(rows.where(F.col(family) == name)).withColumn(family, F.lit(name)) for name, extract in sorted(extractors.items())]
    return reduce(DataFrame.unionByName, parts)
