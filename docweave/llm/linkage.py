"""Matching entities across sources without keys: probabilistic record linkage.

Several blocking passes propose pairs, every pair is compared field by field in agreement levels, expectation
maximisation over the counts of all comparison patterns estimates how likely each level is among matches and
non-matches, and the posterior is the confidence.  Rows with the same features are compared once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.scratch import Scratch

#: Signatures of one block that one join key pairs with as many of the other side.
TILE_ROWS = 1_000
#: Patterns that the levels of all comparisons may form; the driver holds a count for each that occurs.
MAX_PATTERNS = 1 << 22


@dataclass(frozen=True)
class Comparison:
    """A field's agreement: ``level`` is a column over l_ and r_ features, 0 for none, null where either is missing."""

    name: str
    level: Column
    levels: int


@dataclass(frozen=True)
class Model:
    """Estimated shares of the classes, and per class and field the level probabilities; the first class are the matches."""

    shares: np.ndarray
    levels: list[list[np.ndarray]]

    @property
    def share(self) -> float:
        return float(self.shares[0])

    def responsibilities(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of each class for each row of levels (-1 is missing and says nothing)."""
        score = np.tile(np.log(self.shares), (len(patterns), 1))
        for k, fields in enumerate(self.levels):
            for f, probability in enumerate(fields):
                seen = patterns[:, f] >= 0
                score[seen, k] += np.log(probability[patterns[seen, f]])
        score = np.exp(score - score.max(axis=1, keepdims=True, initial=-np.inf))
        return score / score.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Match probability of each row of levels."""
        return self.responsibilities(patterns)[:, 0] if len(patterns) else np.zeros(0)


def estimate(patterns: np.ndarray, counts: np.ndarray, levels: list[int], kinds: int = 2, rounds: int = 300) -> Model:
    """Expectation maximisation over pattern counts, for matches and ``kinds`` kinds of non-matches.

    It starts from agreement being likely among matches and less so among each further kind: non-matches that share a
    block because they belong together (neighbours in a loop) agree on much, those that share one by chance on little,
    and one class for both would make the neighbours look like matches.
    """
    tilt = np.linspace(1.0, -1.0, kinds + 1)  # from strong agreement to strong disagreement
    start = [[np.exp(1.1 * t * np.linspace(-1.0, 1.0, n)) for n in levels] for t in tilt]
    model = Model(np.array([0.3] + [0.7 / kinds] * kinds), [[p / p.sum() for p in fields] for fields in start])
    if not len(patterns):
        return model
    before = -1.0
    for _ in range(rounds):
        weight = model.responsibilities(patterns) * counts[:, None]
        classes = []
        for k in range(kinds + 1):
            fields = []
            for f, n in enumerate(levels):
                seen = patterns[:, f] >= 0
                got = np.bincount(patterns[seen, f], weight[seen, k], n) + 0.5  # half a pair keeps every level possible
                fields.append(got / got.sum())
            classes.append(fields)
        shares = np.clip(weight.sum(axis=0) / counts.sum(), 1e-6, 1.0)
        model = Model(shares / shares.sum(), classes)
        if abs(model.share - before) < 1e-7:
            break
        before = model.share
    return model


def _blocks(side: DataFrame, passes: dict[str, Column], prefix: str) -> DataFrame:
    """id, block: one row per value of each pass; a pass is an array of keys, of which null and empty ones drop out."""
    keys = [_named(name, c) for name, c in passes.items()]
    every = F.flatten(F.array(*[F.coalesce(k, F.array().cast("array<string>")) for k in keys]))
    return side.select(F.col("sig").alias(f"{prefix}sig"), F.explode(F.array_distinct(F.array_compact(every))).alias("block"))


def _named(name: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(f"{name}|"), k))


def candidates(left: DataFrame, right: DataFrame, passes: dict[str, Column], scratch: Scratch, tile: int = TILE_ROWS) -> DataFrame:
    """Distinct (l_sig, r_sig) that share a block; every pair of a block, however large it is.

    A block of more than ``tile`` members on a side is cut into tiles of about that many, and every tile of one side meets
    every tile of the other under a key of its own, so no task holds all pairs of a block.
    """
    l_blocks = scratch.save(_blocks(left, passes, "l_"))
    r_blocks = scratch.save(_blocks(right, passes, "r_"))
    l_sizes = l_blocks.groupBy("block").agg(F.count(F.lit(1)).alias("l_n"))
    r_sizes = r_blocks.groupBy("block").agg(F.count(F.lit(1)).alias("r_n"))
    large = scratch.save(
        l_sizes.join(r_sizes, "block")
        .where(F.greatest("l_n", "r_n") > tile)
        .select("block", *[F.ceil(F.col(f"{x}_n") / F.lit(tile)).cast("bigint").alias(f"{x}_tiles") for x in "lr"])
    )
    small = l_blocks.join(large, "block", "left_anti").join(r_blocks.join(large, "block", "left_anti"), "block")
    pairs = small.select("l_sig", "r_sig")
    if not large.isEmpty():
        fine = _tiled(l_blocks, large, "l", "r").join(_tiled(r_blocks, large, "r", "l"), ["block", "l_tile", "r_tile"])
        pairs = pairs.unionByName(fine.select("l_sig", "r_sig"))
    return pairs.distinct()


def _tiled(blocks: DataFrame, large: DataFrame, own: str, other: str) -> DataFrame:
    """The members of large blocks, each in one tile of its side and once for every tile of the other side."""
    return blocks.join(large, "block").select(
        "block",
        f"{own}_sig",
        F.pmod(F.xxhash64(f"{own}_sig"), f"{own}_tiles").alias(f"{own}_tile"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_tiles") - 1)).alias(f"{other}_tile"),
    )


def link(
    left: DataFrame,
    right: DataFrame,
    passes: dict[str, Column],
    comparisons: list[Comparison],
    threshold: float = 0.5,
) -> DataFrame:
    """l_key, r_key, confidence: for each left row the right rows that most likely describe the same thing.

    ``left`` and ``right`` have ``key`` (one row per key) and feature columns of the same names; null features say
    nothing.  Features equal in all columns form one signature, compared once and expanded at the end, so copies cost no
    pairs.  A left row goes to the right signature of highest confidence, if that reaches ``threshold``; ties go to the
    smaller signature.  Without candidates the result is empty.
    """
    radix = np.cumprod([1, *[c.levels + 1 for c in comparisons]])  # one digit for each comparison, 0 for missing
    if radix[-1] > MAX_PATTERNS:
        raise ValueError("the comparisons form too many patterns; use fewer levels")
    scratch = Scratch(left.sparkSession, "linkage")
    features = [c for c in left.columns if c != "key"]

    def signed(side: DataFrame) -> DataFrame:
        return scratch.save(side.withColumn("sig", F.md5(F.to_json(F.struct(*features)))))

    l_all, r_all = signed(left), signed(right)
    l_one, r_one = (scratch.save(x.drop("key").dropDuplicates(["sig"])) for x in (l_all, r_all))
    pairs = candidates(l_one, r_one, passes, scratch)
    l_side = l_one.select(*[F.col(c).alias(f"l_{c}") for c in ["sig", *features]])
    r_side = r_one.select(*[F.col(c).alias(f"r_{c}") for c in ["sig", *features]])
    digits = [(F.coalesce(c.level.cast("int"), F.lit(-1)) + 1) * F.lit(int(r)) for c, r in zip(comparisons, radix[:-1], strict=True)]
    compared = scratch.save(
        pairs.join(l_side, "l_sig").join(r_side, "r_sig").select("l_sig", "r_sig", reduce(Column.__add__, digits).alias("pattern"))
    )
    scratch.retain(compared, l_all, r_all)
    found = compared.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most radix[-1] rows
    patterns = found["pattern"].to_numpy(np.int64)[:, None] // radix[:-1] % (radix[1:] // radix[:-1]) - 1
    model = estimate(patterns, found["n"].to_numpy(float), [c.levels for c in comparisons])
    likely = found.assign(confidence=model.posterior(patterns))[["pattern", "confidence"]].query("confidence >= @threshold")
    scores = left.sparkSession.createDataFrame(likely.astype({"pattern": "int32"}), "pattern int, confidence double")
    scored = compared.join(F.broadcast(scores), "pattern")
    best = scored.groupBy("l_sig").agg(F.max(F.struct("confidence", "r_sig")).alias("best"))
    chosen = best.select("l_sig", F.col("best.r_sig").alias("r_sig"), F.col("best.confidence").alias("confidence"))
    return (
        chosen.join(l_all.select(F.col("sig").alias("l_sig"), F.col("key").alias("l_key")), "l_sig")
        .join(r_all.select(F.col("sig").alias("r_sig"), F.col("key").alias("r_key")), "r_sig")
        .select("l_key", "r_key", "confidence")
    )
