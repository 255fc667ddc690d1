"""Dense positions of rows in an order, within groups, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.common import cut


def positions(df: DataFrame, group: Column, *order: Column, idx: str = "idx", size: str = "m") -> DataFrame:
    """``df`` with ``g`` (the group key), ``idx`` (0, 1, ... within the group in ``order``, ascending, null first) and ``m`` (rows of the group).

    Rows are range-partitioned and sorted by (group, order), so a group of a third of all
    rows is spread over many tasks; each task numbers its rows, and the number of a row is
    the rows of its group in earlier partitions plus its place in its own. Only a table of
    (partition, group) counts is windowed, at most one row per partition and group. The
    numbered rows are written to the shared folder first, so a lost executor cannot renumber
    them. Rows equal in (group, order) are numbered in an arbitrary order: callers order
    by all columns that can differ. ``group`` must not be null: callers map null to a key.
    """
    keys = [group.alias("g"), *[o.alias(f"_o{i}") for i, o in enumerate(order)]]
    named = df.select("*", *keys)
    names = ["g", *[f"_o{i}" for i in range(len(order))]]
    sort = [F.col(n).asc_nulls_first() for n in names]
    placed = cut(
        named.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_mono", F.monotonically_increasing_id())
        .drop(*names[1:])
    )
    counts = placed.groupBy("_part", "g").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    whole = Window.partitionBy("g")
    counts = counts.select(
        "_part", "g", "_first",
        F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias(size),
    )
    at = (F.col("_before") + F.col("_mono") - F.col("_first")).alias(idx)
    return placed.join(counts, ["_part", "g"]).select(*[c for c in df.columns], "g", at, size)
