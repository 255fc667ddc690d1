"""Lot, spot, station and event-history reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import constants as K
from kerbside.operators.metrics import latest_metric
from kerbside.operators.ranking import top_k_per_key


def available_by_lot(spots: DataFrame) -> DataFrame:
    """Open spot rows per lot, whatever the lot's declared size."""
    return spots.groupBy("lot_id").agg(F.count_if("is_available").alias("available_spots"))


def lots_overview(lots: DataFrame, spots: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each lot with its open spots (0 when it has none) and its latest metric (null when none)."""
    latest = latest_metric(metrics).select(
        "lot_id",
        F.col("avg_occupancy_percent").alias("latest_avg_occupancy_percent"),
        F.col("reservations_count").alias("latest_reservations"),
    )
    return (
        lots.join(available_by_lot(spots), "lot_id", "left")
        .join(latest, "lot_id", "left")
        .select(
            "lot_id",
            "name",
            "address",
            "total_spots",
            F.coalesce("available_spots", F.lit(0).cast("bigint")).alias("available_spots"),
            "price_per_hour",
            "has_ev_charging",
            "distance_meters",
            "latest_avg_occupancy_percent",
            "latest_reservations",
        )
    )


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row with that key, or none."""
    return df.filter(F.col(key) == F.lit(value))


def lookup_many(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """A batch of lookups: every asked key, with ``found`` and null columns when unknown."""
    return keys.join(df.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def lot_spots(spots: DataFrame, lot_id) -> DataFrame:
    """Spots of one lot; an unknown lot has none."""
    return spots.filter(F.col("lot_id") == F.lit(lot_id))


def _newest_first() -> list[Column]:
    return [F.col("recorded_at").desc(), F.col("event_id").desc()]


def lot_history(events: DataFrame, lot_id, k: int = K.HISTORY_LIMIT) -> DataFrame:
    """The newest ``k`` events of one lot."""
    return events.filter(F.col("lot_id") == F.lit(lot_id)).orderBy(*_newest_first()).limit(k)


def lot_history_all(events: DataFrame, k: int = K.HISTORY_LIMIT) -> DataFrame:
    """The newest ``k`` events of every lot."""
    return top_k_per_key(events, ["lot_id"], _newest_first(), k, spread="event_id")


def history_cutoffs(events: DataFrame, k: int = K.HISTORY_LIMIT) -> DataFrame:
    """Per lot, ``cutoff`` (the oldest UTC day that can hold one of its newest ``k`` events) and ``with_nulls``.

    Only a table of (lot, day, count) is windowed, one row per day a lot has events.
    Days count from the newest; a day is needed while fewer than ``k`` events lie on
    newer days. Events without a time come last, after the oldest day.
    """
    days = events.groupBy("lot_id", F.to_date("recorded_at").alias("day")).agg(F.count("*").alias("n"))
    newer = F.sum("n").over(Window.partitionBy("lot_id").orderBy(F.col("day").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    needed = days.withColumn("newer", F.coalesce(newer, F.lit(0))).filter(F.col("newer") < k)
    return needed.groupBy("lot_id").agg(F.min("day").alias("cutoff"), F.max(F.col("day").isNull()).alias("with_nulls"))


def lot_history_by_days(events: DataFrame, k: int = K.HISTORY_LIMIT) -> DataFrame:
    """The same rows as ``lot_history_all``, reading only each lot's days from its cut-off on.

    The earliest cut-off of all lots is a literal filter that reaches the scan; each lot's
    own cut-off then drops its older days before any ranking, so a busy lot's history
    is not ranked past the day its ``k``-th newest event falls on.
    """
    cuts = history_cutoffs(events, k)
    bound = cuts.agg(F.min("cutoff").alias("first"), F.max("with_nulls").alias("nulls")).first()
    if bound is None or (bound["first"] is None and not bound["nulls"]):
        return lot_history_all(events.limit(0), k)
    since = F.col("recorded_at") >= F.lit(bound["first"]).cast("timestamp") if bound["first"] is not None else F.lit(False)
    read = events.filter(since | F.col("recorded_at").isNull()) if bound["nulls"] else events.filter(since)
    own = (F.to_date("recorded_at") >= F.col("cutoff")) | (F.col("recorded_at").isNull() & F.col("with_nulls"))
    kept = read.join(cuts, "lot_id").filter(own).select(*events.columns)
    return lot_history_all(kept, k)
