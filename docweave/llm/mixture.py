"""Mixing sources to target weights, measured in tokens.

Documents are counted by exact token length.  Each source gets whole passes over its documents and a rest, which is
fitted as a subset sum by a bounded-knapsack dynamic programme.  A rest beyond the programme's window is first filled with
a share of every length down to that window; the window widens until the sum is hit or the programme spans the whole rest,
which proves the best sum.  The documents of a length are taken in a seeded order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.scratch import Scratch

#: Tokens the dynamic programme spans at first; it grows eightfold while the sum is not hit.
EXACT_BUDGET = 16_384
#: Tokens the programme may span (five bytes each); a rest beyond that is proven best only if it is hit.
MAX_WINDOW = 1 << 26
#: Documents of a length are ranked in this many hash buckets, of which one is cut by rank.
RANK_BUCKETS = 4_096
#: Sources the targets may have; they are read by the driver.
MAX_SOURCES = 10_000


def fit(lengths: list[int], counts: list[int], budget: int, exact: int = EXACT_BUDGET, most: int = MAX_WINDOW) -> list[int]:
    """How many of each length to take so that their sum is as near below ``budget`` as possible; never above it."""
    total = sum(x * c for x, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    budget -= budget % math.gcd(*lengths)  # no sum lies between
    best, reached = [0] * len(lengths), 0
    while reached < budget:
        take, rest = _filled(lengths, counts, budget, exact) if budget > exact else ([0] * len(lengths), budget)
        more, added = _knapsack(lengths, [c - t for c, t in zip(counts, take, strict=True)], min(rest, most))
        if budget - rest + added > reached:
            best, reached = [t + m for t, m in zip(take, more, strict=True)], budget - rest + added
        if exact >= min(budget, most):
            break
        exact *= 8
    return best


def _filled(lengths: list[int], counts: list[int], budget: int, window: int) -> tuple[list[int], int]:
    """A share of every length, then larger lengths, so that about half to one ``window`` of the budget stays free."""
    total = sum(x * c for x, c in zip(lengths, counts, strict=True))
    take = [c * max(0, budget - window // 2) // total for c in counts]
    rest = budget - sum(x * n for x, n in zip(lengths, take, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        more = min(counts[i] - take[i], max(0, (rest - window // 2) // lengths[i]))
        take[i] += more
        rest -= more * lengths[i]
    return take, rest


def _knapsack(lengths: list[int], counts: list[int], budget: int) -> tuple[list[int], int]:
    """Bounded knapsack: the largest sum of at most ``counts`` of each length that is not above ``budget``.

    ``via[s]`` is the item (a length, a number of it as a power of two) that first reached the sum s.
    """
    via = np.full(budget + 1, -1, np.int32)
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-counts[i], lengths[i])):
        left, part = counts[i], 1
        while left > 0 and lengths[i] * part <= budget and not reach[budget]:
            part = min(part, left)
            step = lengths[i] * part
            new = np.flatnonzero(reach[: budget + 1 - step] & ~reach[step:]) + step
            via[new] = len(items)
            reach[new] = True
            items.append((i, part))
            left -= part
            part *= 2
    goal = int(np.flatnonzero(reach)[-1])
    take, at = [0] * len(lengths), goal
    while at:
        i, part = items[via[at]]
        take[i] += part
        at -= lengths[i] * part
    return take, goal


def budgets(tokens: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int | None) -> dict[str, int]:
    """Tokens of each source: its share of ``total``, or of the largest total that no source's repeats forbid."""
    used = {s: w for s, w in shares.items() if w > 0}
    if total is None:
        total = min((int(tokens.get(s, 0) * repeats[s] / w) for s, w in used.items()), default=0)
    return {s: min(int(total * used.get(s, 0.0)), tokens.get(s, 0) * repeats[s]) for s in shares}


def mixture(
    sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Documents with their repeats, and the report of shares.

    ``sized``: doc_id, source, n_tokens.  ``targets``: source, target_share, max_repeats.  Sources compare trimmed and
    without case.  Documents of other or missing sources and those without tokens are not used; they do not change the
    shares.  Without ``total`` the mixture is the largest one in which every source keeps its share.  A source without
    documents makes that 0; with a given total a source that cannot fill its budget gives all it may and reports it.

    Returns (doc_id, source, n_tokens, repeats) and (source, target_share, max_repeats, available_documents,
    available_tokens, budget_tokens, taken_tokens, records, share).
    """
    spark = sized.sparkSession
    scratch = Scratch(spark, "mixture")
    clean = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    goals = clean.where("source <> ''").orderBy("source").take(MAX_SOURCES + 1)
    if len(goals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = spark.createDataFrame([(g.source,) for g in goals], "source string")
    pool = scratch.save(
        sized.select("doc_id", F.lower(F.trim("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens"))
        .where("n_tokens > 0")
        .join(F.broadcast(names), "source")
    )
    counts = scratch.save(pool.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("documents")))
    have = {
        r.source: r
        for r in counts.groupBy("source").agg(F.sum("documents").alias("d"), F.sum(F.expr("documents * n_tokens")).alias("t")).collect()
    }  # one row per target source
    shares = {g.source: float(g.target_share or 0) for g in goals}
    repeats = {g.source: int(g.max_repeats or 0) for g in goals}
    budget = budgets({s: int(r.t) for s, r in have.items()}, shares, repeats, total)

    def plan(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n_tokens")
        lengths, documents = part["n_tokens"].tolist(), part["documents"].tolist()
        passes, rest = divmod(budget[key[0]], sum(x * c for x, c in zip(lengths, documents, strict=True)))
        return part.assign(passes=passes, take=fit(lengths, documents, rest))

    # one row per distinct length of a source
    plans = scratch.save(
        counts.groupBy("source").applyInPandas(plan, "source string, n_tokens bigint, documents bigint, passes bigint, take bigint")
    )
    joined = pool.join(plans, ["source", "n_tokens"]).withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    sure = joined.where("take = 0 or take = documents").select(
        "doc_id", "source", "n_tokens", (F.col("passes") + (F.col("take") > 0).cast("bigint")).alias("repeats")
    )
    ranked = joined.where("take > 0 and take < documents").withColumn("bucket", F.pmod("h", F.lit(RANK_BUCKETS)))
    group = ["source", "n_tokens", "bucket"]
    filled = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    filled = filled.withColumn(
        "before", F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ).na.fill({"before": 0})
    placed = ranked.join(filled, group).withColumn("free", F.col("take") - F.col("before"))
    clear = placed.where("free <= 0 or free >= n").withColumn("one", (F.col("free") > 0).cast("bigint"))
    cut = placed.where("free > 0 and free < n").withColumn(
        "one", (F.row_number().over(Window.partitionBy(*group).orderBy("h", "doc_id")) <= F.col("free")).cast("bigint")
    )
    partly = clear.unionByName(cut).select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("one")).alias("repeats"))
    chosen = scratch.save(sure.unionByName(partly).where("repeats > 0"))
    taken = chosen.groupBy("source").agg(
        F.sum(F.expr("n_tokens * repeats")).alias("taken_tokens"), F.sum("repeats").alias("records")
    )
    stated = spark.createDataFrame(
        [
            (g.source, shares[g.source], repeats[g.source], int(have[g.source].d) if g.source in have else 0,
             int(have[g.source].t) if g.source in have else 0, budget[g.source])
            for g in goals
        ],
        "source string, target_share double, max_repeats bigint, available_documents bigint, available_tokens bigint, budget_tokens bigint",
    )
    report = stated.join(F.broadcast(taken), "source", "left").na.fill({"taken_tokens": 0, "records": 0})
    whole = report.agg(F.sum("taken_tokens")).scalar()
    return chosen, report.withColumn("share", F.coalesce(F.col("taken_tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)))
