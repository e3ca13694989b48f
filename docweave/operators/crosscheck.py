"""Cross-checks between sources: indexes by normalised keys, presence per source, missing targets, summaries, pairings."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import clean_cell, fold_path, normalize_identifier, or_null
from docweave.operators.matching import similarity_ratio
from docweave.operators.ordered import last_per_key


def identity_keys(row_columns: list[str], candidates: list[str]) -> Column:
    """Distinct normalised values of the candidate columns a table has, in the order of the candidates."""
    keys = F.array(*[normalize_identifier(clean_cell(c)) for c in candidates if c in row_columns]).cast("array<string>")
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def key_index(rows: DataFrame, scope: str, keys: Column, record: str) -> DataFrame:
    """scope, key, record: which records carry a key; one row each, however many share a key."""
    return rows.select(F.col(scope).alias("scope"), F.explode(keys).alias("key"), F.col(record).cast("string").alias("record")).distinct()


def evidence_index(rows: DataFrame, tag: str, record: str, kind: str, kinds: dict[str, list[str]]) -> DataFrame:
    """key, record and a flag per group of evidence kinds the record has for the tag."""
    keyed = rows.withColumn("key", normalize_identifier(tag)).where("key <> ''")
    flags = [F.max(F.coalesce(F.col(kind).isin(*k), F.lit(False))).alias(n) for n, k in kinds.items()]
    return keyed.groupBy("key", F.col(record).alias("record")).agg(*flags)


def presence_by_source(entities: DataFrame, occurrences: DataFrame, sources: list[str]) -> DataFrame:
    """key and a flag per source that has it; entities without occurrences have none.

    ``entities``: key (normalised).  ``occurrences``: source, key.  One aggregate over the occurrences, so the number of
    sources costs no joins.
    """
    flags = occurrences.where("key <> ''").groupBy("key").agg(*[F.max(F.col("source") == s).alias(s) for s in sources])
    joined = entities.select("key").distinct().join(flags, "key", "left")
    return joined.select("key", *[F.coalesce(F.col(s), F.lit(False)).alias(s) for s in sources])


def missing_targets(flags: DataFrame, sources: list[str], actions: dict[str, str], none: str = "No completion required") -> DataFrame:
    """Flags with ``missing_targets`` (names joined by `` | ``), ``issue_count`` and ``recommended_action``."""
    absent = {s: ~F.col(s) for s in sources}
    names = F.concat_ws(" | ", *[F.when(a, F.lit(s)) for s, a in absent.items()])
    todo = F.concat_ws("; ", *[F.when(absent[s], F.lit(t)) for s, t in actions.items()])
    count = reduce(lambda a, b: a + b, [a.cast("int") for a in absent.values()])
    return flags.withColumns({"missing_targets": names, "issue_count": count, "recommended_action": F.coalesce(or_null(todo), F.lit(none))})


def summary(checked: DataFrame) -> DataFrame:
    """entities, with_issues, issues: totals of a cross-check."""
    return checked.agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(F.col("issue_count") > 0).alias("with_issues"), F.coalesce(F.sum("issue_count"), F.lit(0)).alias("issues")
    )


def category_state(rows: DataFrame, key: str, category: str, wanted: list[str], broken: str) -> DataFrame:
    """key, state: conflict if any row is broken, present if a wanted category occurs, else missing."""
    found = rows.groupBy(key).agg(F.max(F.col(broken)).alias("b"), F.max(F.col(category).isin(*wanted)).alias("w"))
    return found.select(key, F.when(F.coalesce("b", F.lit(False)), "conflict").when(F.coalesce("w", F.lit(False)), "present").otherwise("missing").alias("state"))


def completion_map(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The last row of each identity, blank ones left out."""
    return last_per_key(rows.withColumn("identity", key).where("identity <> ''"), ["identity"], [order])


def flatten_star(objects: DataFrame, facts: DataFrame, elements: DataFrame, links: DataFrame, first: int = 10) -> DataFrame:
    """One row per object with its facts, number of elements, first elements and attributes, and connections.

    ``objects``: object_id, document.  ``facts``: document, name, value.  ``elements``: object_id, element_id, attribute.
    ``links``: link_id, element_id.  Connections belong to an object through its elements.
    """
    per_document = facts.where("name <> ''").groupBy("document", "name").agg(F.min("value").alias("value"))
    facts_of = per_document.groupBy("document").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("facts"))
    distinct = elements.select("object_id", "element_id").distinct()
    counts = distinct.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_elements"))
    # the first ones by rank, so no object's elements are collected whole
    from docweave.operators.ordered import top_k

    top = lambda df, c: top_k(df.select("object_id", c).distinct(), ["object_id"], [c], first).groupBy("object_id").agg(F.array_sort(F.collect_list(c)).alias(f"{c}s"))
    joined = links.join(distinct, "element_id").groupBy("object_id").agg(F.countDistinct("link_id").alias("n_links"))
    whole = objects.join(facts_of, "document", "left").join(counts, "object_id", "left").join(joined, "object_id", "left")
    return whole.join(top(distinct, "element_id"), "object_id", "left").join(top(elements.where("attribute <> ''"), "attribute"), "object_id", "left").na.fill({"n_elements": 0, "n_links": 0})


def pair_files(drawings: DataFrame, models: DataFrame, least: float = 0.28) -> DataFrame:
    """root, drawing, model, score, status: each drawing of a root with the best model not yet taken.

    ``drawings``: root, path.  ``models``: root, path, drawing_name, drawing_title.  The score is 0.7 times the best ratio
    of names and 0.3 times the share of the drawing's words.  A root with one of each is paired at once; drawings choose in
    path order.  A root is a folder of drawings, so its files fit one task.
    """
    name = lambda c: F.replace(fold_path(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*\z", "")), F.lit("_"), F.lit(" "))
    d = drawings.select("root", F.col("path").alias("drawing"), name("path").alias("d_name"))
    other = lambda c: F.replace(fold_path(c), F.lit("_"), F.lit(" "))
    m = models.select("root", F.col("path").alias("model"), name("path").alias("m_name"), other("drawing_name").alias("m_drawing"), other("drawing_title").alias("m_title"))

    def words(text: str) -> set[str]:
        return {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text).split() if w}

    def score(a: str, names: list[str]) -> float:
        ratio = max(similarity_ratio(a, n) if n or i == 0 else 0.0 for i, n in enumerate(names))
        own = words(a)
        return 0.7 * ratio + 0.3 * len(own & words(" ".join(names))) / max(1, len(own))

    def pair(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free = {r.model: [r.m_name, r.m_drawing, r.m_title] for r in right.sort_values("model").itertuples()}
        rows = []
        alone = len(left) == 1 and len(free) == 1
        for r in left.sort_values("drawing").itertuples():
            scored = [(1.0 if alone else score(r.d_name, names), model) for model, names in free.items()]
            best = max(scored, key=lambda x: x[0], default=(0.0, None))
            if best[1] is None or best[0] <= 0:
                rows.append((key[0], r.drawing, None, 0.0, "missing"))
            elif best[0] < least:
                rows.append((key[0], r.drawing, None, round(best[0], 4), "ambiguous"))
            else:
                free.pop(best[1])
                rows.append((key[0], r.drawing, best[1], round(best[0], 4), "paired"))
        return pd.DataFrame(rows, columns=["root", "drawing", "model", "score", "status"])

    return d.groupBy("root").cogroup(m.groupBy("root")).applyInPandas(pair, "root string, drawing string, model string, score double, status string")


def vector_names(names: DataFrame, corpus: DataFrame, known: DataFrame) -> DataFrame:
    """name, attribute: unknown names take the attribute of the nearest vector, if it is near enough for their length.

    ``names``: name, vector.  ``corpus``: attribute, vector (a lookup table).  ``known``: name.  Known names stay as they
    are, and so do those nothing is near to: below 0.45, 0.55 up to six and 0.65 up to five characters.
    """
    from docweave.operators.scoring import nearest_label

    asked = names.join(known.select("name").distinct(), "name", "left_anti")
    near = nearest_label(asked, corpus.select(F.col("attribute").alias("label"), "vector"))
    best = near.groupBy("name").agg(F.max(F.struct(F.col("similarity").alias("s"), F.col("label").alias("a"))).alias("x"))
    least = F.when(F.length("name") <= 5, 0.65).when(F.length("name") <= 6, 0.55).otherwise(0.45)
    kept = best.where(F.col("x.s") >= least).select("name", F.col("x.a").alias("attribute"))
    return names.select("name").distinct().join(kept, "name", "left").select("name", F.coalesce("attribute", "name").alias("attribute"))


def foreign_key_guesses(tables: dict[str, list[str]]) -> list[tuple[str, str, str, str]]:
    """(table, column, target table, target column) whose id column names contain one another; the first target counts."""
    stem = lambda x: x.lower().removesuffix("_id")
    keys = {t: next((c for c in columns if c.lower().endswith("_id")), None) for t, columns in tables.items()}
    found = []
    for t, columns in tables.items():
        for c in (c for c in columns if c.lower().endswith("_id")):
            target = next((o for o, k in keys.items() if k and o != t and (stem(c) in stem(o) or stem(o) in stem(c))), None)
            if target:
                found.append((t, c, target, keys[target]))
    return found


def profile_difference(draft: DataFrame, existing: DataFrame) -> DataFrame:
    """canonical, alias, change: aliases added to or removed from a profile."""
    a, b = draft.select("canonical", "alias").distinct(), existing.select("canonical", "alias").distinct()
    mark = lambda df, s: df.withColumn("change", F.lit(s))
    return mark(a.exceptAll(b), "added").unionByName(mark(b.exceptAll(a), "removed"))
