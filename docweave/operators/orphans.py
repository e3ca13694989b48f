"""References to records that do not exist, reported per table and period.

A Bloom filter over all parent keys proves most orphans outright: a key the filter does not hold was never registered.
Only references the filter lets through are joined exactly, against the parents' validity spans.

The filter grows with the distinct parent keys.  It is made of parts, each for the keys of one hash class, which one
aggregation builds together; a reference is tested against the part of its class.  Its size has an upper bound, so it may
always be broadcast: with more keys than that bound serves well, more references pass it to the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

#: Bits of one part of the filter (8 MB), the most the engine's aggregate builds.
PART_BITS = 1 << 26
#: Parts of a filter at most, so 256 MB are broadcast at most; 215 million keys keep ``BITS_PER_KEY`` bits each.
MAX_PARTS = 32
#: Bits spent for each parent key; about 1 % false positives, which the exact join removes.
BITS_PER_KEY = 10


def reference_key(column: Column | str) -> Column:
    """Keys are compared trimmed of spaces and in upper case; blank keys become null."""
    text = F.upper(F.trim(column))
    return F.when(text != "", text)


def _catalyst(df: DataFrame):
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.classic.ExpressionUtils


def _hash_class(key: str, parts: int) -> Column:
    return F.pmod(F.hash(key), F.lit(parts))


def bloom_filter(df: DataFrame, key: str, keys: int, part_bits: int = PART_BITS, max_parts: int = MAX_PARTS) -> tuple[Column, int]:
    """A scalar subquery whose value is a struct of Bloom filters of ``key``, evaluated once on the executors; and their number.

    ``keys`` is the (estimated) number of distinct keys, which sets the size.
    """
    expressions, bridge = _catalyst(df)
    parts = min(max_parts, max(1, -(-keys * BITS_PER_KEY // part_bits)))
    each = -(-keys // parts)
    bits = min(part_bits, 1 << max(13, (each * BITS_PER_KEY - 1).bit_length()))
    # one row per key first: far fewer partial filters reach the last merge than there are input splits
    distinct = df.select(key, F.xxhash64(key).alias("h")).where(F.col(key).isNotNull()).distinct().withColumn("part", _hash_class(key, parts))

    def part(i: int) -> Column:
        aggregate = expressions.aggregate.BloomFilterAggregate(
            bridge.expression(F.when(F.col("part") == i, F.col("h"))._jc),  # null hashes are skipped
            bridge.expression(F.lit(each).cast("long")._jc),
            bridge.expression(F.lit(bits).cast("long")._jc),
        )
        return ClassicColumn(bridge.column(aggregate.toAggregateExpression())).alias(f"p{i}")

    built = distinct.agg(*[part(i) for i in range(parts)])
    return built.select(F.struct(*[f"p{i}" for i in range(parts)]).alias("bloom")).scalar(), parts


def might_contain(df: DataFrame, bloom: Column, parts: int, key: str) -> Column:
    """Whether the filter may hold ``key``: never false for a key that is in it."""
    expressions, bridge = _catalyst(df)

    def test(i: int) -> Column:
        held = bridge.expression(bloom.getField(f"p{i}")._jc)
        found = ClassicColumn(bridge.column(expressions.BloomFilterMightContain(held, bridge.expression(F.xxhash64(key)._jc))))
        return F.coalesce(found, F.lit(False))  # a part without keys is null

    if parts == 1:
        return test(0)
    chosen = F.when(F.lit(False), F.lit(False))
    for i in range(parts):
        chosen = chosen.when(_hash_class(key, parts) == i, test(i))
    return F.coalesce(chosen, F.lit(False))


def orphan_references(references: DataFrame, parents: DataFrame, part_bits: int = PART_BITS, max_parts: int = MAX_PARTS) -> DataFrame:
    """References without a parent that is valid at their time.

    ``references``: ref_table, row_key, ref_value (raw), at (timestamp); further columns are ignored.
    ``parents``: key (raw), valid_from, valid_until (null = open); several spans per key are allowed.
    Returns distinct rows of ref_table, period (``yyyy-MM``), row_key, ref_value (trimmed, upper case).

    Blank references are no references.  A reference without a time has no valid parent at its time: it is an orphan
    with a null period.  A parent without ``valid_from`` is never valid.  With no parents at all every reference is an
    orphan.  Repeated references come out once.

    Skew: the filter decides per row without moving it; the exact join shuffles only references it lets through, and
    adaptive skew handling splits a key that holds many of them (its parent spans are first reduced to distinct ones).
    """
    refs = references.select("ref_table", "row_key", reference_key("ref_value").alias("ref_value"), "at").where(
        F.col("ref_value").isNotNull()
    )
    spans = parents.select(reference_key("key").alias("p_key"), "valid_from", "valid_until").where(
        F.col("p_key").isNotNull()
    )
    keys = max(1, spans.agg(F.approx_count_distinct("p_key")).first()[0])
    kind = references.schema["at"].dataType
    open_end = F.lit("9999-12-31").cast(kind)
    valid = (
        spans.where("valid_from is not null")
        .groupBy("p_key", F.col("valid_from").cast(kind).alias("valid_from"))
        .agg(F.max(F.coalesce(F.col("valid_until").cast(kind), open_end)).alias("valid_until"))
    )
    match = (
        (F.col("ref_value") == F.col("p_key"))
        & (F.col("at") >= F.col("valid_from"))
        & (F.col("at") < F.col("valid_until"))
    )
    held = might_contain(refs, *bloom_filter(spans, "p_key", keys, part_bits, max_parts), "ref_value")
    missing = refs.where(~held).unionByName(refs.where(held).join(valid, match, "left_anti"))
    return missing.select(
        "ref_table", F.date_format("at", "yyyy-MM").alias("period"), "row_key", "ref_value"
    ).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table and period: number of references and of distinct missing keys."""
    return orphans.groupBy("ref_table", "period").agg(
        F.count(F.lit(1)).alias("orphans"), F.countDistinct("ref_value").alias("missing_keys")
    )
