"""Graph operators: bounded search, components, clusters, pages, assemblies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.values import box_iou
from docweave.operators.ordered import first_per_key, forward_fill, number_rows
from docweave.scratch import Scratch


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (x, y) in both directions, without self-loops."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y")))
    return both.where("x <> y").distinct()


def nearest_target(starts: DataFrame, edges: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """start, node, depth: the nearest target within ``hops``, the smaller node among equally near ones.

    ``starts``: start.  ``edges``: x, y (see ``undirected``).  ``targets``: node.  A start that is a target has depth 0.
    Each level drops nodes a start has visited, and starts that have found a target.
    """
    scratch = Scratch(starts.sparkSession, "search")
    goal = targets.select("node").distinct()
    frontier = scratch.save(starts.select("start", F.col("start").alias("node")).distinct())
    visited, found = frontier, []
    for depth in range(hops + 1):
        hit = frontier.join(goal, "node", "left_semi").groupBy("start").agg(F.min("node").alias("node"))
        hit = scratch.save(hit.withColumn("depth", F.lit(depth)))
        found.append(hit)
        if depth == hops:
            break
        open_ = frontier.join(hit.select("start"), "start", "left_anti")
        step = open_.join(edges, open_["node"] == edges["x"]).select("start", F.col("y").alias("node")).distinct()
        frontier = scratch.save(step.join(visited, ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: the smallest node it is linked to, by label spreading with shortcuts until nothing changes.

    Self-loops make a component of one.  Each round a node takes the smallest label around it and then that label's own
    label, so long chains shrink quickly.
    """
    scratch = Scratch(edges.sparkSession, "labels")
    links = scratch.save(undirected(edges, a, b))
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).where("node is not null").distinct()
    label = scratch.save(nodes.select("node", F.col("node").alias("component")))
    while True:
        around = links.join(label, links["y"] == label["node"]).select(F.col("x").alias("node"), "component")
        best = label.unionByName(around).groupBy("node").agg(F.min("component").alias("component"))
        far = best.select(F.col("node").alias("n"), F.col("component").alias("far"))
        jumped = best.join(far, best["component"] == far["n"]).select("node", F.least("component", "far").alias("component"))
        old = label.select(F.col("node").alias("n"), F.col("component").alias("was"))
        after = scratch.save(jumped.join(old, jumped["node"] == old["n"]).select("node", "component", (F.col("component") != F.col("was")).alias("moved")))
        scratch.drop(label)
        label = after.select("node", "component")
        if after.where("moved").isEmpty():
            return label
        scratch.paths[id(label)] = scratch.paths.pop(id(after))


def overlap_pairs(boxes: DataFrame, within: list[str], least: float = 0.45) -> DataFrame:
    """within, a, b (a < b), iou of the boxes of a page that overlap by at least ``least`` (intersection over union).

    Boxes that overlap so much have sides of similar length, so they are looked up in grids whose cells suit the longer
    side of the two: a box touches at most two cells of a grid on each axis, in as few grids as ``least`` allows, however
    large it is.  Boxes without area overlap nothing.
    """
    steps = math.ceil(-math.log2(least))
    wide = lambda lo, hi: F.floor(F.log2(F.col("box")[hi] - F.col("box")[lo])).cast("int")
    sized = boxes.where((F.col("box")[2] > F.col("box")[0]) & (F.col("box")[3] > F.col("box")[1])).select(
        *within, "box_id", "box", wide(0, 2).alias("w"), wide(1, 3).alias("h")
    )
    every = sized.select(*within, "box_id", "box", "w", "h", F.explode(F.sequence("w", F.col("w") + steps)).alias("gw")).select(
        "*", F.explode(F.sequence("h", F.col("h") + steps)).alias("gh")
    )
    cells = lambda lo, hi, level: F.sequence(F.floor(F.col("box")[lo] / F.pow(2.0, F.col(level) + 1)), F.floor(F.col("box")[hi] / F.pow(2.0, F.col(level) + 1)))
    placed = every.select("*", F.explode(cells(0, 2, "gw")).alias("cx")).select("*", F.explode(cells(1, 3, "gh")).alias("cy"))
    left, right = placed.alias("l"), placed.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in within] + [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("gw", "gh", "cx", "cy")]
    own = (F.greatest("l.w", "r.w") == F.col("l.gw")) & (F.greatest("l.h", "r.h") == F.col("l.gh"))
    met = left.join(right, [*same, own, F.col("l.box_id") < F.col("r.box_id")])
    pairs = met.select(*[F.col(f"l.{c}").alias(c) for c in within], F.col("l.box_id").alias("a"), F.col("r.box_id").alias("b"), box_iou(F.col("l.box"), F.col("r.box")).alias("iou"))
    return pairs.where(F.col("iou") >= least).distinct()


def overlap_clusters(boxes: DataFrame, within: list[str], least: float = 0.45) -> DataFrame:
    """within, box_id, cluster: boxes of a page chained by overlaps of at least ``least`` (see ``overlap_pairs``)."""
    every = overlap_pairs(boxes, within, least).select("a", "b").unionByName(boxes.select(F.col("box_id").alias("a"), F.col("box_id").alias("b")))
    label = connected_components(every, "a", "b")
    return boxes.select(*within, "box_id").join(label, F.col("box_id") == F.col("node")).select(*within, "box_id", F.col("component").alias("cluster"))


def vote_clusters(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Per cluster the text of highest confidence (the first among equals), noisy-or confidence, and how many agree.

    ``clustered``: keys, ord, text, confidence.
    """
    miss = F.product(F.greatest(F.lit(0.0), 1 - F.col("confidence")))
    best = F.max(F.struct("confidence", (-F.col("ord")).alias("o"), "text"))
    return clustered.groupBy(*keys).agg(
        best["text"].alias("text"), F.bround(F.least(F.lit(1.0), 1 - miss), 4).alias("confidence"), F.count(F.lit(1)).alias("members")
    )


# ---------------------------------------------------------------- assemblies


def _with_next(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Rows of an assembly that another follows, with its ``columns`` as next_<column>; large assemblies are spread over tasks."""
    numbered = number_rows(rows, order, "_n", ["assembly"])
    after = numbered.select(F.col("assembly").alias("_a"), (F.col("_n") - 1).alias("_m"), *[F.col(c).alias(f"next_{c}") for c in columns])
    return numbered.join(after, F.col("assembly").eqNullSafe(F.col("_a")) & (F.col("_n") == F.col("_m"))).drop("_a", "_m", "_n")


def assembly_links(steps: DataFrame) -> DataFrame:
    """assembly, no, from_id, to_id, dx, dy, dz, distance of components that follow each other: assembly, no, id, x, y, z."""
    step = _with_next(steps.select("assembly", "no", "id", "x", "y", "z"), ["no", "id"], ["id", "x", "y", "z"])
    apart = step.select("assembly", "no", F.col("id").alias("from_id"), F.col("next_id").alias("to_id"), *[(F.col(f"next_{c}") - F.col(c)).alias(f"d{c}") for c in "xyz"])
    return apart.withColumn("distance", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2))


def bend_angles(links: DataFrame) -> DataFrame:
    """assembly, no, angle (degrees) between each link and the next; null where either has no length."""
    both = _with_next(links.select("assembly", "no", "from_id", "dx", "dy", "dz", "distance"), ["no", "from_id"], ["dx", "dy", "dz", "distance"])
    dot = sum((F.col(c) * F.col(f"next_{c}") for c in ("dx", "dy", "dz")), F.lit(0.0))
    lengths = F.col("distance") * F.col("next_distance")
    angle = F.when(lengths > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / lengths)))))
    return both.select("assembly", "no", angle.alias("angle"))


def part_library(steps: DataFrame, label: str, kind: str, order: str) -> DataFrame:
    """part_id, label, type, instances: distinct parts numbered by first occurrence.

    The number of kinds of parts is that of a catalogue; they are numbered after they are counted.
    """
    from docweave.operators.ordered import assign_ids

    parts = steps.groupBy(F.col(label).alias("label"), F.col(kind).alias("type")).agg(F.count(F.lit(1)).alias("instances"), F.min(order).alias("first"))
    numbered = assign_ids(parts, "p", ["first", "label", "type"], "n")
    number = F.substring("n", 3, 20).cast("bigint")
    return numbered.select(F.format_string("PART_%04d", number).alias("part_id"), "label", "type", "instances")


def running_parent(steps: DataFrame, is_parent: Column) -> DataFrame:
    """assembly, no, id, parent_id: the last component before it that opens a group, by assembly order."""
    filled = forward_fill(steps.select("assembly", "no", "id", F.col("id").alias("opener"), F.coalesce(is_parent, F.lit(False)).alias("opens")), "opener", F.col("opens"), ["assembly"], ["no", "id"])
    numbered = number_rows(filled, ["no", "id"], "_n", ["assembly"])
    before = numbered.select(F.col("assembly").alias("_a"), (F.col("_n") + 1).alias("_m"), F.col("opener").alias("parent_id"))
    joined = numbered.join(before, F.col("assembly").eqNullSafe(F.col("_a")) & (F.col("_n") == F.col("_m")), "left")
    return joined.select("assembly", "no", "id", "parent_id")


def evidence_precedence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The preferred row per key, by explicit priority columns."""
    return first_per_key(rows, keys, order)
