"""Checks on reservation and session requests, in the order they apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import constants as K
from kerbside.functions import scalars as S


def _verdict(rules: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """Status and message of the first rule that holds; 201 and no message when none does."""
    status, message = F.lit(201), F.lit(None).cast("string")
    for condition, code, text in reversed(rules):
        status = F.when(condition, code).otherwise(status)
        message = F.when(condition, text).otherwise(message)
    return status, message


def _start_at(requests: DataFrame, as_of) -> Column:
    """The start; a request may give it as a number of milliseconds in ``start_ms`` in place of a text."""
    ms = F.col("start_ms") if "start_ms" in requests.columns else None
    return S.start_or(F.col("start_time"), S.as_timestamp(as_of), ms)


def _is_incomplete() -> Column:
    return S.is_blank(F.col("lot_id")) | S.is_blank(F.col("spot_id")) | S.is_blank(F.col("vehicle_plate"))


def spot_winners(requests: DataFrame, spots: DataFrame, as_of) -> DataFrame:
    """Spots with ``winner_seq``, the first sound request for an open spot.

    Requests are reduced to their least ``seq`` per claimed (spot, lot) before any
    join, so a spot that everyone asks for costs one row per task. A request whose
    start time cannot be read does not take the spot.
    """
    first = (
        requests.filter(~_is_incomplete() & _start_at(requests, as_of).isNotNull())
        .groupBy("spot_id", "lot_id")
        .agg(F.min("seq").alias("winner_seq"))
    )
    known = spots.select("spot_id", "lot_id", "is_available")
    return known.join(first, ["spot_id", "lot_id"], "left").withColumn(
        "winner_seq", F.when(F.col("is_available"), F.col("winner_seq"))
    )


def decide_reservations(requests: DataFrame, spots: DataFrame, as_of) -> DataFrame:
    """Every request with ``start_at``, ``status`` and ``message``.

    Requests count in ``seq`` order, and ``seq`` must differ between requests: of two with
    the same number both would win. Once a spot is won it stays taken. The one
    large join keeps the requests on its preserved side, which adaptive execution
    may split when a spot is hot.
    """
    state = spot_winners(requests, spots, as_of).select(
        "spot_id", F.col("lot_id").alias("spot_lot_id"), "is_available", "winner_seq"
    )
    wrong_lot = F.col("spot_lot_id").isNull() | (F.col("spot_lot_id") != F.col("lot_id"))
    gone = ~F.col("is_available") | F.coalesce(F.col("winner_seq") < F.col("seq"), F.lit(False))
    status, message = _verdict(
        [
            (_is_incomplete(), 400, K.MISSING_RESERVATION_FIELDS),
            (wrong_lot, 400, K.SPOT_NOT_FOUND),
            (gone, 409, K.SPOT_TAKEN),
            (F.col("start_at").isNull(), 500, K.SERVER_ERROR),
        ]
    )
    return (
        requests.withColumn("start_at", _start_at(requests, as_of))
        .join(state, "spot_id", "left")
        .withColumns({"status": status, "message": message})
        .select(*requests.columns, "start_at", "status", "message")
    )


def decide_sessions(requests: DataFrame, stations: DataFrame) -> DataFrame:
    """Every session request with its station's lot, ``status`` and ``message``.

    Neither the station's availability nor the reservation is checked.
    """
    known = stations.select("station_id", "lot_id", F.lit(True).alias("_known"))
    status, message = _verdict(
        [
            (S.is_blank(F.col("station_id")), 400, K.MISSING_STATION),
            (F.col("_known").isNull(), 404, K.STATION_NOT_FOUND),
        ]
    )
    return (
        requests.join(known, "station_id", "left")
        .withColumns({"status": status, "message": message})
        .select(*requests.columns, "lot_id", "status", "message")
    )


def accepted(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("status") == 201).drop("status", "message")


def rejected(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("status") != 201)
