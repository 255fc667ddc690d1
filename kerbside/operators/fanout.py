"""Accepted requests written out as facts, events and metric deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import constants as K
from kerbside.functions import scalars as S
from kerbside.operators.admission import accepted, decide_reservations, decide_sessions, rejected
from kerbside.operators.metrics import reservation_deltas, session_deltas, sum_deltas
from kerbside.operators.slots import set_where_key_in
from kerbside.sources.tables import cut_lineage

def _no_text() -> Column:
    return F.lit(None).cast("string")


def _user() -> Column:
    return F.coalesce(F.col("user_id").cast("string"), F.lit(K.DEFAULT_USER))


def reservation_tables(taken: DataFrame, as_of) -> dict[str, DataFrame]:
    """The rows each accepted reservation request gives rise to."""
    reservations = taken.select(
        S.key_of("reservation", F.col("spot_id"), F.col("seq")).alias("reservation_id"),
        "lot_id",
        "spot_id",
        _user().alias("user_id"),
        "vehicle_plate",
        F.col("start_at").alias("start_time"),
        F.lit(None).cast("timestamp_ntz").alias("end_time"),
        F.lit("reserved").alias("status"),
    )
    events = taken.select(
        S.key_of("reservation_event", F.col("spot_id"), F.col("seq")).alias("event_id"),
        S.key_of("reservation", F.col("spot_id"), F.col("seq")).alias("reservation_id"),
        F.lit("reserved").alias("status"),
        S.as_timestamp(as_of).alias("recorded_at"),
        F.lit(K.RESERVATION_NOTE).alias("note"),
        _no_text().alias("metadata"),
    )
    usage = taken.select(
        S.key_of(K.RESERVATION_START, F.col("spot_id"), F.col("seq")).alias("event_id"),
        "lot_id",
        "spot_id",
        F.lit(K.RESERVATION_START).alias("event_type"),
        F.col("start_at").alias("recorded_at"),
        F.lit(-1).alias("delta_available"),
        F.lit(None).cast("int").alias("occupancy"),
        _no_text().alias("note"),
        _no_text().alias("metadata"),
    )
    return {
        "reservations": reservations,
        "reservation_events": events,
        "usage_events": usage,
        "metric_deltas": sum_deltas(reservation_deltas(reservations)),
    }


def session_tables(started: DataFrame, as_of, spot_type: str = "string") -> dict[str, DataFrame]:
    """The rows each accepted session request gives rise to, all at ingest time."""
    key = S.key_of("session", F.col("station_id"), F.col("seq"))
    sessions = started.select(
        key.alias("session_id"),
        "station_id",
        "reservation_id",
        _user().alias("user_id"),
        S.as_timestamp(as_of).alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("ended_at"),
        F.lit("active").alias("status"),
        "energy_kwh",
        "cost",
        "lot_id",
    )
    usage = started.select(
        S.key_of(K.CHARGING_START, F.col("station_id"), F.col("seq")).alias("event_id"),
        "lot_id",
        F.lit(None).cast(spot_type).alias("spot_id"),
        F.lit(K.CHARGING_START).alias("event_type"),
        S.as_timestamp(as_of).alias("recorded_at"),
        F.lit(None).cast("int").alias("delta_available"),
        F.lit(None).cast("int").alias("occupancy"),
        _no_text().alias("note"),
        F.to_json(F.struct(F.col("station_id").alias("stationId"))).alias("metadata"),
    )
    return {
        "charging_sessions": sessions.drop("lot_id"),
        "usage_events": usage,
        "metric_deltas": sum_deltas(session_deltas(sessions)),
    }


def ingest_reservations(
    requests: DataFrame, spots: DataFrame, as_of, keep=cut_lineage
) -> dict[str, DataFrame]:
    """A batch of reservation requests as the tables it changes.

    ``keep`` stores the decisions once, so that the tables are read from the stored rows
    and the request join runs once. A caller that reads one table alone may leave it out.
    """
    decisions = keep(decide_reservations(requests, spots, as_of))
    taken = accepted(decisions)
    return {
        **reservation_tables(taken, as_of),
        "spots": set_where_key_in(spots, taken, "spot_id", "is_available", False),
        "rejected": rejected(decisions),
    }


def ingest_sessions(
    requests: DataFrame, stations: DataFrame, as_of, keep=cut_lineage
) -> dict[str, DataFrame]:
    """A batch of session requests as the tables it changes."""
    decisions = keep(decide_sessions(requests, stations))
    return {**session_tables(accepted(decisions), as_of), "rejected": rejected(decisions)}
