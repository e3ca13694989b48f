"""Parent-child links to full hierarchies: root, depth, path and descendants of every node, and cycle detection.

The frontier of each round is joined with a table of hops, the chains of up to ``span`` links, so one round settles that
many levels.  At first the hops are the links themselves; once the wide levels near the roots are settled, the hops left
are joined with themselves, which doubles the span each round, so deep trees take a number of rounds that grows with the
logarithm of their depth.  Joins run under adaptive skew handling, because one parent may hold a large share of all
children.  Whatever no root reaches lies on a cycle or below one.

Where a node has several parents a root may also reach a cycle, so there a node counts as reached only once all its
parents have been; what never is lies on a cycle or below one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.scratch import Scratch

#: Levels settled link by link before hops are joined with themselves.
PLAIN_LEVELS = 4
#: Hops may grow to this many times the links; beyond it their span stays as it is.
HOP_SHARE = 4
#: Levels written together after so many.
MERGE_LEVELS = 24


def clean_links(links: DataFrame, parent: str, child: str) -> DataFrame:
    """Distinct trimmed links (parent, child); a blank parent leaves the child without one, blank children drop out."""
    p, c = F.trim(parent), F.trim(child)
    return (
        links.select(F.when(p != "", p).alias("parent"), F.when(c != "", c).alias("child"))
        .where("parent is not null or child is not null")
        .distinct()
    )


def hierarchy(
    links: DataFrame,
    parent: str = "parent_label",
    child: str = "child_label",
    with_path: bool = True,
) -> DataFrame:
    """One row per node: node_label, root_label, depth (bigint), in_cycle, and path (array from the root) if wanted.

    A label that is nobody's child (rows with a blank parent aside) is a root of depth 0.  Labels are trimmed of spaces;
    blank ones are no nodes.  Repeated links count once.  A node with several parents takes the smallest depth, then the
    smallest parent label.  Nodes on a cycle (self-links included) or below one get root_label '' , depth -1 and an
    empty path.  An empty input gives an empty table.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    pairs = scratch.save(clean_links(links, parent, child))
    edges = pairs.where("parent is not null and child is not null")
    labels = pairs.select(F.explode(F.array("parent", "child")).alias("node_label")).where("node_label is not null")
    nodes = scratch.save(
        labels.select("node_label", F.lit(0).alias("is_child"))
        .unionByName(edges.select(F.col("child").alias("node_label"), F.lit(1).alias("is_child")))
        .groupBy("node_label")
        .agg(F.max("is_child").alias("is_child"))
    )
    path = [F.array("node_label").alias("path")] if with_path else []
    frontier = scratch.save(
        nodes.where("is_child = 0").select(
            "node_label", F.col("node_label").alias("root_label"), F.lit(0).cast("bigint").alias("depth"), *path
        )
    )
    reached = (_reach if _is_tree(edges) else _peel)(frontier, edges, scratch)
    return nodes.select("node_label").join(reached, "node_label", "left").select(
        "node_label",
        F.coalesce("root_label", F.lit("")).alias("root_label"),
        F.coalesce("depth", F.lit(-1).cast("bigint")).alias("depth"),
        F.col("depth").isNull().alias("in_cycle"),
        *([F.coalesce("path", F.array().cast("array<string>")).alias("path")] if with_path else []),
    )


def _reach(frontier: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """All nodes the roots in ``frontier`` reach, if no node has two parents."""
    with_path = "path" in frontier.columns
    via = [F.array("child").alias("via")] if with_path else []
    hops = edges.select(F.col("parent").alias("above"), F.col("child").alias("below"), F.lit(1).alias("steps"), *via)
    links = rows = edges.count()
    span, saved, levels, merged, settled = 1, None, [frontier], [], []  # settled: nodes whose hops are used up
    while rows:
        longer = [F.concat("path", "via").alias("path")] if with_path else []
        step = hops.join(frontier, hops["above"] == frontier["node_label"]).select(
            F.col("below").alias("node_label"), "root_label", (F.col("depth") + F.col("steps")).alias("depth"), *longer,
            (F.col("steps") == span).alias("last"),
        )
        found = scratch.save(step)
        if found.where("last").isEmpty():
            levels.append(found.drop("last"))
            break
        settled += [frontier.select("node_label"), found.where("not last").select("node_label")]
        frontier = found.where("last").drop("last")
        levels.append(found.drop("last"))
        if len(levels) + len(merged) > PLAIN_LEVELS:
            rest = scratch.save(hops.join(_union(settled), F.col("above") == F.col("node_label"), "left_anti"))
            scratch.drop(saved)
            hops = saved = rest
            rows, settled = rest.count(), []
            if 0 < rows <= HOP_SHARE * links:
                hops = saved = scratch.save(rest.unionByName(_composed(rest, span)))
                scratch.drop(rest)
                span *= 2
        if len(levels) > MERGE_LEVELS:  # keeps the final plan short for deep trees; each level is rewritten once
            merged.append(scratch.save(_union(levels)))
            settled, levels = [_union(settled)] if settled else [], []
    return _union(merged + levels)


def _composed(hops: DataFrame, span: int) -> DataFrame:
    """The hops of more than ``span`` and at most twice as many links: a longest one, then any from where it ends."""
    first = hops.where(F.col("steps") == span).select("above", F.col("below").alias("mid"), *[F.col("via").alias("way") for c in hops.columns if c == "via"])
    second = hops.select(F.col("above").alias("mid"), "below", "steps", *[c for c in hops.columns if c == "via"])
    way = [F.concat("way", "via").alias("via")] if "via" in hops.columns else []
    return first.join(second, "mid").select("above", "below", (F.col("steps") + F.lit(span)).alias("steps"), *way)


def _peel(frontier: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """All nodes that lie neither on a cycle nor below one, if nodes may have several parents.

    A node is settled once all its parents are, by the best of the ways they offer: the smallest depth, then the smallest
    parent.  ``waiting`` holds the best offer so far of nodes with an unsettled parent.
    """
    state = [c for c in frontier.columns if c not in ("node_label", "depth")]
    levels, merged, unused, waiting, size = [frontier], [], edges, None, frontier.count()
    while size:
        start = frontier.withColumnRenamed("node_label", "parent")
        longer = [F.concat("path", F.array("child")).alias("path")] if "path" in state else []
        offers = unused.join(start, "parent").select(
            F.col("child").alias("node_label"), (F.col("depth") + 1).alias("depth"), "parent", "root_label", *longer
        )
        best = F.min(F.struct("depth", "parent", *state)).alias("best")
        both = offers if waiting is None else offers.unionByName(waiting)
        kept = scratch.save(both.groupBy("node_label").agg(best).select("node_label", "best.*"))
        rest = scratch.save(unused.join(frontier.select(F.col("node_label").alias("parent")), "parent", "left_anti"))
        blocked = rest.select(F.col("child").alias("node_label")).distinct()
        frontier = scratch.save(kept.join(blocked, "node_label", "left_anti").select(*frontier.columns))
        old, waiting = waiting, scratch.save(kept.join(blocked, "node_label", "left_semi"))
        scratch.drop(kept, old, unused if unused is not edges else None)
        unused, size = rest, frontier.count()
        levels.append(frontier)
        if len(levels) > MERGE_LEVELS:
            merged.append(scratch.save(_union(levels[:-1])))
            levels = levels[-1:]
    return _union(merged + levels)


def _is_tree(edges: DataFrame) -> bool:
    """Whether no child has two parents, which spares the levels a duplicate check."""
    return edges.groupBy("child").count().where("count > 1").isEmpty()


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def descendants(tree: DataFrame) -> DataFrame:
    """All (ancestor_label, node_label, distance) pairs of a hierarchy with paths; nodes in cycles have none."""
    return (
        tree.where("depth > 0")
        .select("node_label", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth").cast("int"))).alias("at", "ancestor_label"))
        .select("ancestor_label", "node_label", (F.col("depth") - F.col("at")).cast("bigint").alias("distance"))
    )
