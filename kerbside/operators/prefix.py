"""The greatest value before each key, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the key taken per level: a window never holds more than 2**BITS keys.
BITS = 16
LEVELS = 64 // BITS


def max_before(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, before)``: for each distinct ``key`` (a long), the greatest ``value`` of rows with a smaller key (null if none).

    The keys form a trie of ``BITS`` bits a level. At each level the keys that share a parent
    are ordered in one window, at most 2**BITS of them; the maximum of all smaller keys is the
    maximum over levels of the siblings left of the key's ancestor. Sparse keys (clock-like,
    up to 2**63) cost as dense ones: at most ``LEVELS`` levels of bounded windows.
    """
    level = df.groupBy(F.col(key).cast("bigint").alias("k")).agg(F.max(value).alias("v"))
    keys = level.select("k")
    parts = []
    for depth in range(LEVELS):
        top = depth == LEVELS - 1
        parent = F.lit(0).cast("bigint") if top else F.shiftright("k", BITS)
        left = F.max("v").over(Window.partitionBy("p").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
        parts.append(level.withColumn("p", parent).select(F.col("k").alias(f"k{depth}"), left.alias(f"b{depth}")))
        if top:
            break
        level = level.groupBy(parent.alias("k")).agg(F.max("v").alias("v"))
    out = keys
    for depth, part in enumerate(parts):
        out = out.withColumn(f"k{depth}", F.shiftright("k", BITS * depth) if depth else F.col("k")).join(part, f"k{depth}", "left")
    return out.select(F.col("k").alias(key), F.greatest(*[F.col(f"b{d}") for d in range(len(parts))]).alias("before"))
