"""Pairwise matches to groups: Borůvka hooking with pointer doubling.

Every component selects its smallest outgoing edge and hooks onto the component at its other end; since the edges are
totally ordered the hooks form trees whose only cycles are pairs, which the smaller label breaks.  The trees collapse by
pointer doubling, the edges are relabelled and deduplicated, and the rounds go on until no edge is left.  Each round at
least halves the components that still have edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.scratch import Scratch


def linking_edges(pairs: DataFrame, source: str, target: str, score: str, threshold: float) -> DataFrame:
    """Distinct edges (a <= b) of rows whose keys are not blank and whose score reaches the threshold.

    Keys are taken as they are.  A row without a score links nothing; a self-pair gives a = b and makes its key a record.
    """
    linked = pairs.where((F.trim(source) != "") & (F.trim(target) != "") & (F.col(score) >= threshold) & ~F.isnan(score))
    return linked.select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """group_key, record_key: one row per key of ``edges`` (a, b), with the smallest key it is linked to.

    Self-loops make a group of one unless another edge joins it.  An empty input gives an empty table.  Only partially
    aggregated or joined rows are shuffled; a key with very many links is reduced to its smallest edge map-side.
    """
    scratch = Scratch(edges.sparkSession, "components")
    base = scratch.save(edges)
    label = base.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rounds: list[DataFrame] = []  # (child, parent): parent is a root after that round
    alive = base.where("a <> b")
    left = alive.count()
    while left:
        ends = alive.select(F.col("a").alias("node"), "a", "b").unionByName(alive.select(F.col("b").alias("node"), "a", "b"))
        smallest = ends.groupBy("node").agg(F.min(F.struct("a", "b")).alias("edge"))
        tree = scratch.save(_hooked(smallest))
        pointer = _collapse(tree, scratch)
        scratch.drop(tree)
        rounds.append(pointer)
        to = pointer.select(F.col("node").alias("x"), F.col("parent").alias("y"))
        moved = alive.join(to, alive["a"] == to["x"]).select(F.col("y").alias("p"), "b")
        moved = moved.join(to, moved["b"] == to["x"]).select("p", F.col("y").alias("q"))
        edge = scratch.save(
            moved.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        )
        if len(rounds) > 1:
            scratch.drop(alive)
        alive, left = edge, edge.count()
    for later in rounds:
        step = later.select(F.col("node").alias("x"), F.col("parent").alias("y"))
        label = (label.withColumn("root", F.col("node")) if "root" not in label.columns else label)
        label = label.join(step, label["root"] == step["x"], "left").select("node", F.coalesce("y", "root").alias("root"))
    if not rounds:
        return label.select(F.col("node").alias("group_key"), F.col("node").alias("record_key"))
    label = scratch.save(label)
    scratch.retain(label)
    lowest = label.groupBy("root").agg(F.min("node").alias("group_key"))
    return label.join(lowest, "root").select("group_key", F.col("node").alias("record_key"))


def _hooked(smallest: DataFrame) -> DataFrame:
    """node, parent: every node hooks onto the other end of its edge; where both ends chose an edge, the smaller is the root.

    Only its two ends can choose an edge, so an aggregate over edges sees which were chosen twice.
    """
    chosen = smallest.groupBy("edge").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    one, two = F.col("edge.a"), F.col("edge.b")
    both = F.array(F.struct(one.alias("node"), one.alias("parent")), F.struct(two.alias("node"), one.alias("parent")))
    single = F.array(F.struct(F.col("node"), F.when(F.col("node") == one, two).otherwise(one).alias("parent")))
    return chosen.select(F.explode(F.when(F.col("n") == 2, both).otherwise(single)).alias("h")).select("h.node", "h.parent")


def _collapse(pointer: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointer doubling until every node points at a root.

    A node whose pointer no longer moves has its root and takes no further part; the others follow two pointers at a time,
    through the newest pointers of all nodes.
    """
    settled: list[DataFrame] = []
    newest = moving = pointer
    while True:
        one, two = (newest.select(F.col("node").alias(f"n{i}"), F.col("parent").alias(f"p{i}")) for i in (1, 2))
        step = scratch.save(
            moving.join(one, moving["parent"] == one["n1"])
            .join(two, one["p1"] == two["n2"])
            .select("node", F.col("p2").alias("parent"), (F.col("p2") != F.col("p1")).alias("moved"))
        )
        settled.append(step.where("not moved").select("node", "parent"))
        moving = step.where("moved").select("node", "parent")
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        newest = reduce(DataFrame.unionByName, settled, moving)
