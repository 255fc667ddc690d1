"""First, last and top-k rows per key, safe for keys that hold much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` per key.

    An aggregate rather than a window: each task reduces its rows to one per key
    before the shuffle, by hashing when the columns are of fixed size. ``order``
    must not repeat within a key.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest])


def top_k_per_key(
    df: DataFrame, keys: list[str], order: list[Column], k: int, spread: str, ways: int = 16
) -> DataFrame:
    """The first ``k`` rows per key under ``order``, with their rank ``rn``.

    Two steps: ranks within (key, hash of ``spread``) leave at most ``ways * k``
    rows per key for the final ranking, so a hot key is shared out over ``ways``
    tasks. Spark also applies the limit before each shuffle.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(ways))
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_part", part)
        .withColumn("rn", F.row_number().over(inner))
        .filter(F.col("rn") <= k)
        .drop("rn", "_part")
        .withColumn("rn", F.row_number().over(outer))
        .filter(F.col("rn") <= k)
    )


def rank_by_ranges(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``df`` with ``rank`` from 0 within ``key`` in ``order`` (sort orders), for keys of any size.

    Rows are range-partitioned by (key, order) at sampled bounds, so one key's rows span as
    many tasks as their number asks; each task numbers its rows, and a row's rank is the
    count of its key's rows in earlier partitions plus its place in its own. Only a table of
    (partition, key) counts is windowed, at most one row per partition and key. The numbered
    rows are written to the shared folder, so a lost executor cannot number them anew.
    ``order`` must tell all rows of a key apart for the ranks to be repeatable.
    """
    from kerbside.sources.tables import cut_lineage

    sort = [F.col(key).asc_nulls_first(), *order]
    placed = cut_lineage(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort)
        .withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    )
    counts = placed.groupBy("_part", key).agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", key, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_mono") - F.col("_first")
    return placed.join(counts, ["_part", key], "left").withColumn("rank", rank).drop("_part", "_mono", "_first", "_before")
