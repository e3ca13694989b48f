"""Operators whose result depends on an order, which is always a column: winners, ids, versions, fills, pages.

Every winner is found by a partially aggregated minimum or maximum rather than by a window, so that a hot key is reduced
before it is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import or_null
from docweave.scratch import Scratch


def ordered_values(value: Column, order: Column) -> Column:
    """Aggregate: the values in order, nulls left out."""
    rows = F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(F.array_sort(rows), lambda r: r["v"])


def ordered_distinct(value: Column, order: Column, separator: str | None = " | ") -> Column:
    """Aggregate: the distinct non-empty values by first occurrence, joined unless ``separator`` is None.

    Use ``distinct_joined`` where one group may hold very many rows.
    """
    values = F.array_distinct(ordered_values(or_null(value), order))
    return values if separator is None else F.array_join(values, separator)


def distinct_joined(df: DataFrame, keys: list[str], value: str, order: str, separator: str = " | ") -> DataFrame:
    """keys, value: distinct non-empty values per key by first occurrence, joined.

    Repeats are reduced before the values of a key meet, so a hot key costs its distinct values, not its rows.
    """
    firsts = df.where(F.col(value) != "").groupBy(*keys, value).agg(F.min(order).alias("_first"))
    return firsts.groupBy(*keys).agg(F.array_join(ordered_values(F.col(value), F.col("_first")), separator).alias(value))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is first in ``order`` (column names); ties are broken by the other columns."""
    return _extreme(df, keys, order, F.min)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``; ties are broken by the other columns."""
    return _extreme(df, keys, order, F.max)


def _extreme(df: DataFrame, keys: list[str], order: list[str], aggregate) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not rest and not order:
        return df.select(*keys).distinct()
    best = df.groupBy(*keys).agg(aggregate(F.struct(*order, *rest)).alias("_best"))
    return best.select(*[F.col(k) if k in keys else F.col("_best")[k].alias(k) for k in df.columns])


def richest_per_key(df: DataFrame, keys: list[str], size: Column, order: list[str]) -> DataFrame:
    """The row of each key with the largest ``size``, the first in ``order`` among equals."""
    return first_per_key(df.withColumn("_size", -size), keys, ["_size", *order]).drop("_size")


def assign_ids(df: DataFrame, prefix: str, order: list[str], name: str = "id", within: list[str] | None = None) -> DataFrame:
    """Running ids ``<prefix>.<n>`` in a total order, restarting in each group of ``within``."""
    numbered = number_rows(df, order, "_row_rank", within)
    return numbered.withColumn(name, F.concat(F.lit(f"{prefix}."), F.col("_row_rank").cast("string"))).drop("_row_rank")


def number_rows(df: DataFrame, order: list[str], name: str, within: list[str] | None = None) -> DataFrame:
    """Rows numbered from 1 in a total order, restarting in each group of ``within``.

    Rows are range-partitioned and counted per partition, so no task sees all rows, nor all rows of a large group; the
    first number of each group, one aggregate, is taken off afterwards.
    """
    keys = [*(within or []), *order]
    # the numbered rows are written, so all uses below see the same range partitions
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    written = Scratch(df.sparkSession, "ids").save(placed.withColumn("_row_no", F.monotonically_increasing_id()))
    # the number holds the partition in its upper bits and the row within it below
    parts = written.groupBy(F.shiftrightunsigned("_row_no", 33).alias("_row_part")).agg(F.count(F.lit(1)).alias("_part_size"))
    before = F.coalesce(F.sum("_part_size").over(Window.orderBy("_row_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_row_part", before.alias("_rows_before"))  # one row per partition
    joined = written.withColumn("_row_part", F.shiftrightunsigned("_row_no", 33)).join(F.broadcast(offsets), "_row_part")
    place = F.col("_rows_before") + F.col("_row_no").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    numbered = joined.withColumn(name, place).drop("_row_no", "_row_part", "_rows_before")
    if not within:
        return numbered
    firsts = numbered.groupBy(*within).agg(F.min(name).alias("_first_no"))
    both = numbered.alias("_l").join(firsts.alias("_r"), _same(within, "_l", "_r"))
    return both.select(*[F.col(f"_l.{c}") for c in df.columns], (F.col(name) - F.col("_first_no") + 1).alias(name))


#: Rows of a group that one task handles when a window slides over it.
BLOCK_ROWS = 100_000


def _same(keys: list[str], left: str, right: str) -> Column:
    """Equality of keys in which nulls are equal."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def forward_fill(
    df: DataFrame, column: str, keep: Column, within: list[str], order: list[str], block: int = BLOCK_ROWS
) -> DataFrame:
    """Values where ``keep`` holds, carried forward within each group; null before the first.

    A group is filled in blocks of rows, and each block starts with the last value of the blocks before it, so a large
    group is spread over tasks.
    """
    numbered = number_rows(df.withColumn("_kept", F.struct(F.coalesce(keep, F.lit(False)).alias("is"), F.col(column).alias("v"))), order, "_n", within)
    placed = numbered.withColumn("_block", F.floor(F.col("_n") / block))
    value = F.when(F.col("_kept.is"), F.struct(F.col("_kept.v").alias("v")))  # a struct, so a kept null is told from none
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(*within, "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    ends = placed.where("_kept.is").groupBy(*within, "_block").agg(F.max(F.struct("_n", "_kept.v")).alias("_end"))
    blocks = placed.select(*within, "_block").distinct().alias("b").join(ends.alias("e"), _same([*within, "_block"], "b", "e"), "left")
    before = Window.partitionBy(*[F.col(f"b.{w}") for w in within]).orderBy("b._block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*[F.col(f"b.{c}").alias(c) for c in [*within, "_block"]], F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    joined = placed.withColumn("_own", own).alias("l").join(carried.alias("r"), _same([*within, "_block"], "l", "r"))
    filled = F.when(F.col("_own").isNotNull(), F.col("_own.v")).otherwise(F.col("_carry.v"))
    return joined.select(*[filled.alias(c) if c == column else F.col(f"l.{c}").alias(c) for c in df.columns])


def _with_halo(df: DataFrame, reach: int, within: list[str], order: list[str], block: int) -> DataFrame:
    """Numbered rows in blocks (``_block``), rows near an edge also in the next block; ``_home`` tells their own block."""
    numbered = number_rows(df, order, "_n", within)
    home = F.floor(F.col("_n") / block)
    near = F.array_distinct(F.array(home, F.floor((F.col("_n") - reach) / block), F.floor((F.col("_n") + reach) / block)))
    return numbered.withColumns({"_home": home, "_block": F.explode(near)})


def look_ahead(
    df: DataFrame, value: Column, ok: Column, reach: int, within: list[str], order: list[str], name: str, block: int = BLOCK_ROWS
) -> DataFrame:
    """The first accepted value of the next ``reach`` rows of the group; large groups are handled in blocks."""
    marked = df.withColumn("_seen", F.when(ok, value))
    placed = _with_halo(marked, reach, within, order, block)
    window = Window.partitionBy(*within, "_block").orderBy("_n").rowsBetween(1, reach)
    found = placed.withColumn(name, F.first("_seen", ignorenulls=True).over(window))
    return found.where("_block = _home").select(*df.columns, name)


def neighbours(
    df: DataFrame, column: str, reach: int, within: list[str], order: list[str], name: str, block: int = BLOCK_ROWS
) -> DataFrame:
    """The values of up to ``reach`` rows before and after, the row itself included; large groups are handled in blocks."""
    window = Window.partitionBy(*within, "_block").orderBy("_n").rowsBetween(-reach, reach)
    found = _with_halo(df, reach, within, order, block).withColumn(name, F.collect_list(column).over(window))
    return found.where("_block = _home").select(*df.columns, name)


def ordinal_window(df: DataFrame, column: str, kind: str, radius: int, within: list[str], order: list[str], name: str) -> DataFrame:
    """``neighbours`` among the rows of the same kind."""
    return neighbours(df, column, radius, [*within, kind], order, name)


def consecutive_pairs(df: DataFrame, key: str, within: list[str], order: list[str]) -> DataFrame:
    """within, from_id, to_id of rows that follow each other: a join of row numbers, so a large group is spread."""
    rest = [o for o in order if o != key and o not in within]
    numbered = number_rows(df.select(*within, key, *rest), order, "_n", within)
    left = numbered.select(*within, F.col(key).alias("from_id"), "_n").alias("l")
    right = numbered.select(*within, F.col(key).alias("to_id"), (F.col("_n") - 1).alias("_n")).alias("r")
    return left.join(right, _same([*within, "_n"], "l", "r")).select(*[F.col(f"l.{w}").alias(w) for w in within], "from_id", "to_id")


def duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Second and later rows of a key: keys, the row's order, the first one's; keys that are blank in all parts do not count."""
    filled = reduce(lambda a, b: a | b, [F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) != "" for k in keys])
    firsts = df.where(filled).groupBy(*keys).agg(F.min(order).alias("first_row"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    left, right = df.alias("l"), firsts.alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return left.join(right, same & (F.col(f"l.{order}") > F.col("r.first_row"))).select(
        *[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{order}").alias("row"), "first_row"
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All new rows, and old rows whose key no new row has."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def page(df: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a total order; all of them if ``limit`` is not positive."""
    ordered = df.orderBy(*order)
    if limit <= 0:
        return ordered.offset(offset) if offset > 0 else ordered
    return ordered.offset(max(0, offset)).limit(limit)


def display_order(column: str) -> list[Column]:
    """Numbers by value, then texts without case, then empty ones."""
    text = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    number = F.when(text.rlike(r"\A[+-]?[0-9]+([.,][0-9]+)?\z"), F.replace(text, F.lit(","), F.lit(".")).cast("double"))
    rank = F.when(text == "", 2).when(number.isNotNull(), 0).otherwise(1)
    return [rank, F.when(rank == 0, number), F.lower(text), text]


def positional_match(left: DataFrame, right: DataFrame, order: list[str], key: str) -> DataFrame:
    """left_id, right_id, status of rows of equal rank on the two sides: Matched, Only_Left or Only_Right."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        ids = assign_ids(df.select(key, *[o for o in order if o != key]), "n", order, "_id")
        return ids.select(F.substring("_id", 3, 20).cast("bigint").alias("rank"), F.col(key).alias(name))

    both = ranked(left, "left_id").join(ranked(right, "right_id"), "rank", "full_outer")
    status = F.when(F.col("left_id").isNull(), "Only_Right").when(F.col("right_id").isNull(), "Only_Left").otherwise("Matched")
    return both.select("rank", "left_id", "right_id", status.alias("status"))


def distinct_undirected(edges: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Edges without self-loops, the first of each unordered pair."""
    pairs = edges.where(F.col(a) != F.col(b)).withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)})
    return first_per_key(pairs, ["_lo", "_hi"], [order]).drop("_lo", "_hi")


def top_k(df: DataFrame, within: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("rank") <= k)
