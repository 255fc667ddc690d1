"""Daily metrics per lot: roll-up, incremental merge, look-back report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import scalars as S
from kerbside.operators.ranking import latest_per_key
from kerbside.sources.tables import append_rows

COUNTS = ["reservations_count", "charging_sessions_count", "energy_kwh", "revenue_cents"]
KEYS = ["lot_id", "day"]


def _deltas(df: DataFrame, at: str, **values) -> DataFrame:
    """One delta per input row, at its time; measures not given add nothing."""
    zero = {
        "reservations_count": F.lit(0).cast("bigint"),
        "charging_sessions_count": F.lit(0).cast("bigint"),
        "energy_kwh": F.lit(0.0),
        "revenue_cents": F.lit(0).cast("bigint"),
        "avg_occupancy_percent": F.lit(None).cast("double"),
        "occupancy_seq": F.lit(None).cast("bigint"),
    }
    columns = {**zero, **values}
    return df.select("lot_id", F.col(at).alias("at"), *[c.alias(n) for n, c in columns.items()])


def reservation_deltas(reservations: DataFrame) -> DataFrame:
    return _deltas(reservations, "start_time", reservations_count=F.lit(1).cast("bigint"))


def session_deltas(sessions: DataFrame) -> DataFrame:
    """``sessions`` must carry the lot of their station."""
    return _deltas(
        sessions,
        "started_at",
        charging_sessions_count=F.lit(1).cast("bigint"),
        energy_kwh=F.coalesce("energy_kwh", F.lit(0.0)),
        revenue_cents=F.coalesce(F.col("cost").cast("bigint"), F.lit(0).cast("bigint")),
    )


def occupancy_deltas(samples: DataFrame) -> DataFrame:
    """Samples set the day's occupancy and add nothing else."""
    return _deltas(
        samples.filter(F.col("sample").isNotNull()),
        "sampled_at",
        avg_occupancy_percent=F.col("sample").cast("double"),
        occupancy_seq=F.col("seq").cast("bigint"),
    )


def with_station_lot(sessions: DataFrame, stations: DataFrame) -> DataFrame:
    """A session's lot is its station's lot.

    Spark broadcasts the stations only if its size figures allow; else both sides
    are sort-merged and adaptive execution splits a hot station.
    """
    return sessions.join(stations.select("station_id", "lot_id"), "station_id")


def sum_deltas(deltas: DataFrame) -> DataFrame:
    """Deltas to one row per (lot, day). The last occupancy sample of the day wins."""
    return deltas.groupBy("lot_id", S.utc_day(F.col("at")).alias("day")).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.max_by("avg_occupancy_percent", "occupancy_seq").alias("avg_occupancy_percent"),
    )


def daily_metrics(
    reservations: DataFrame,
    sessions: DataFrame,
    stations: DataFrame,
    samples: DataFrame | None = None,
    since=None,
) -> DataFrame:
    """Metrics per (lot, UTC day) with at least one fact.

    ``since`` limits the facts by their own timestamps, so the bound reaches the
    Parquet scans.
    """
    if since is not None:
        bound = since.cast("timestamp_ntz")
        reservations = reservations.filter(F.col("start_time") >= bound)
        sessions = sessions.filter(F.col("started_at") >= bound)
        samples = None if samples is None else samples.filter(F.col("sampled_at") >= bound)
    parts = [reservation_deltas(reservations), session_deltas(with_station_lot(sessions, stations))]
    if samples is not None:
        parts.append(occupancy_deltas(samples))
    return sum_deltas(append_rows(*parts))


def merge_metrics(existing: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add summed deltas onto stored metrics; days not stored yet are inserted.

    A new occupancy value replaces the stored one; no new value leaves it.
    """
    columns = KEYS + COUNTS + ["avg_occupancy_percent"]
    both = append_rows(
        existing.select(*columns, F.lit(0).alias("age")), deltas.select(*columns, F.lit(1).alias("age"))
    )
    newest = F.when(F.col("avg_occupancy_percent").isNotNull(), F.col("age"))
    return both.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.max_by("avg_occupancy_percent", newest).alias("avg_occupancy_percent"),
    )


def last_occupancy(samples: DataFrame) -> DataFrame:
    """The day's last non-null sample per lot, by arrival."""
    return (
        samples.filter(F.col("sample").isNotNull())
        .groupBy("lot_id", S.utc_day(F.col("sampled_at")).alias("day"))
        .agg(F.max_by("sample", "seq").alias("avg_occupancy_percent"))
    )


def latest_metric(metrics: DataFrame) -> DataFrame:
    return latest_per_key(metrics, ["lot_id"], "day")


def analytics_daily(metrics: DataFrame, lots: DataFrame, days, as_of) -> DataFrame:
    """Metrics from ``days`` days before ``as_of`` on, with no upper bound, in day order."""
    return (
        metrics.filter(F.col("day") >= S.since_day(days, as_of))
        .join(lots.select("lot_id", F.col("name").alias("lot_name"), "has_ev_charging"), "lot_id")
        .select(
            "lot_id",
            "lot_name",
            "day",
            F.col("reservations_count").alias("reservations"),
            F.col("charging_sessions_count").alias("charging_sessions"),
            "energy_kwh",
            "revenue_cents",
            "avg_occupancy_percent",
            "has_ev_charging",
        )
        .orderBy("day", "lot_id")
    )
