"""Registered queries: each operator over the given tables.

Every query takes ``(spark, sf_dir)``, reads whole tables and returns a DataFrame.
``oracle.py`` holds the SQL with the same result under the same name.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions import scalars as S
from kerbside.operators import admission, detail, fanout, lots, metrics, replay, slots
from kerbside.sources import adapters as A
from kerbside.sources import json_state
from kerbside.sources.tables import append_rows, cut_lineage, flatten_children

AS_OF = dt.datetime(2001, 8, 1)
LOOKBACK = "7"
CUTOVER = dt.datetime(1998, 1, 1)
LOT = 3

Query = Callable[[SparkSession, str], DataFrame]


def one_table(decisions: DataFrame) -> DataFrame:
    """For queries that read one of the tables that requests make, so nothing needs to be stored."""
    return decisions

REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _metrics(spark: SparkSession, d: str, **kw) -> DataFrame:
    return metrics.daily_metrics(A.reservations(spark, d), A.charging_sessions(spark, d), A.stations(spark, d), **kw)


# --- metrics ----------------------------------------------------------------


@query
def analytics_daily(spark, d):
    recent = _metrics(spark, d, since=S.since_day(LOOKBACK, AS_OF))
    return metrics.analytics_daily(recent, A.lots(spark, d), LOOKBACK, AS_OF).drop("avg_occupancy_percent")


@query
def daily_metrics(spark, d):
    return _metrics(spark, d).drop("avg_occupancy_percent")


@query
def daily_metrics_with_occupancy(spark, d):
    return _metrics(spark, d, samples=A.occupancy_samples(spark, d))


@query
def daily_last_occupancy(spark, d):
    return metrics.last_occupancy(A.occupancy_samples(spark, d))


@query
def latest_metric(spark, d):
    return metrics.latest_metric(_metrics(spark, d).drop("avg_occupancy_percent"))


@query
def merge_metrics(spark, d):
    reservations, sessions, stations = A.reservations(spark, d), A.charging_sessions(spark, d), A.stations(spark, d)
    cutover = S.as_timestamp(CUTOVER)
    # Sessions are split by energy, so that most days are on both sides.
    stored = metrics.daily_metrics(
        reservations.filter(F.col("start_time") < cutover), sessions.filter(F.col("energy_kwh") < 25), stations
    )
    deltas = metrics.daily_metrics(
        reservations.filter(F.col("start_time") >= cutover), sessions.filter(F.col("energy_kwh") >= 25), stations
    )
    return metrics.merge_metrics(stored, deltas).drop("avg_occupancy_percent")


@query
def lots_overview(spark, d):
    return lots.lots_overview(A.lots(spark, d), A.spots(spark, d), _metrics(spark, d))


# --- the same with occupancy ------------------------------------------------


def _occupied(spark: SparkSession, d: str, **kw) -> DataFrame:
    return _metrics(spark, d, samples=A.occupancy_samples(spark, d), **kw)


@query
def analytics_daily_with_occupancy(spark, d):
    recent = _occupied(spark, d, since=S.since_day("400", AS_OF))
    return metrics.analytics_daily(recent, A.lots(spark, d), "400", AS_OF)


@query
def latest_metric_with_occupancy(spark, d):
    return metrics.latest_metric(_occupied(spark, d))


@query
def lots_overview_with_occupancy(spark, d):
    return lots.lots_overview(A.lots(spark, d), A.spots(spark, d), _occupied(spark, d))


@query
def merge_metrics_with_occupancy(spark, d):
    """Stored days have the samples up to 50, new ones the rest, which replace them on days with both."""
    reservations, sessions, stations = A.reservations(spark, d), A.charging_sessions(spark, d), A.stations(spark, d)
    samples, cutover = A.occupancy_samples(spark, d), S.as_timestamp(CUTOVER)
    stored = metrics.daily_metrics(
        reservations.filter(F.col("start_time") < cutover), sessions.filter(F.col("energy_kwh") < 25), stations,
        samples.filter("sample <= 50"),
    )
    deltas = metrics.daily_metrics(
        reservations.filter(F.col("start_time") >= cutover), sessions.filter(F.col("energy_kwh") >= 25), stations,
        samples.filter("sample > 50"),
    )
    return metrics.merge_metrics(stored, deltas)


# --- reads ------------------------------------------------------------------


@query
def lot_spots(spark, d):
    return lots.lot_spots(A.spots(spark, d), LOT)


@query
def stations_scan(spark, d):
    return A.stations(spark, d)


@query
def available_by_lot(spark, d):
    return lots.available_by_lot(A.spots(spark, d))


@query
def lot_history(spark, d):
    return lots.lot_history(A.usage_events(spark, d), LOT)


@query
def lot_history_all(spark, d):
    return lots.lot_history_all(A.usage_events(spark, d))


@query
def lot_history_by_days(spark, d):
    return lots.lot_history_by_days(A.usage_events(spark, d))


@query
def reservation_lookup(spark, d):
    """Each session's reservation id looked up, an unknown id from each station as well."""
    asked = append_rows(
        A.charging_sessions(spark, d).select("reservation_id"),
        A.stations(spark, d).select((-F.col("station_id") - 1).alias("reservation_id")),
    )
    held = A.reservations(spark, d).select("reservation_id", "spot_id", "status")
    return lots.lookup_many(asked, held, "reservation_id")


@query
def reservation_detail(spark, d):
    """One row per child, both kinds in the same columns."""
    rows = detail.reservation_rows(
        A.reservations(spark, d), A.reservation_events(spark, d), A.charging_sessions(spark, d)
    )
    return rows.select(
        "reservation_id",
        "spot_id",
        "lot_id",
        "status",
        "start_time",
        "kind",
        F.col("event.status").alias("event_status"),
        F.col("event.recorded_at").alias("recorded_at"),
        F.col("session.station_id").alias("station_id"),
        F.col("session.started_at").alias("started_at"),
        F.col("session.energy_kwh").alias("energy_kwh"),
        F.col("session.cost").alias("cost"),
    )


def _nested(spark, d, **page):
    """The nested form: list sizes, ordered event statuses and session totals."""
    nested = detail.reservation_detail(
        A.reservations(spark, d), A.reservation_events(spark, d), A.charging_sessions(spark, d), **page
    )
    total = F.aggregate("sessions", F.lit(0).cast("bigint"), lambda acc, s: acc + s.cost)
    return nested.select(
        "reservation_id",
        "part",
        "status",
        F.size("events").cast("bigint").alias("n_events"),
        F.array_join(F.col("events.status"), ",").alias("event_statuses"),
        F.size("sessions").cast("bigint").alias("n_sessions"),
        total.alias("cost"),
    )


@query
def reservation_detail_nested(spark, d):
    return _nested(spark, d)


@query
def reservation_detail_pages(spark, d):
    """Pages of three, so that many reservations have several."""
    return _nested(spark, d, page=3)


@query
def start_times(spark, d):
    start = S.start_or(F.col("start_time"), S.as_timestamp(AS_OF), F.col("start_ms"))
    return A.start_forms(spark, d).select("seq", start.alias("start_at"))


@query
def lookback_texts(spark, d):
    return A.lookback_texts(spark, d).select("event_id", S.since_day(F.col("days"), AS_OF).alias("since"))


@query
def nested_lot_flatten(spark, d):
    """Spots and stations of nested creates, each with its lot."""
    nested = A.nested_lots(spark, d)
    new_spots = flatten_children(nested, "lot_id", "spots", "lot_id").select(
        "lot_id", F.lit("spot").alias("kind"), F.col("label").alias("name"), "is_available"
    )
    new_stations = flatten_children(nested, "lot_id", "stations", "lot_id").select(
        "lot_id", F.lit("station").alias("kind"), "name", "is_available"
    )
    return append_rows(new_spots, new_stations)


# --- ingestion --------------------------------------------------------------


def _requests(kind: str, spark: SparkSession, d: str) -> DataFrame:
    if kind == "untidy":
        return A.untidy_reservation_requests(spark, d)
    return A.reservation_requests(spark, d, own_lot=kind == "own")


def _decisions(kind: str, spark: SparkSession, d: str) -> DataFrame:
    decided = admission.decide_reservations(_requests(kind, spark, d), A.spots(spark, d), AS_OF)
    return decided.select("seq", "spot_id", "lot_id", "start_at", "status", "message")


@query
def admission_claimed_lot(spark, d):
    return _decisions("claimed", spark, d)


@query
def admission_own_lot(spark, d):
    return _decisions("own", spark, d)


@query
def admission_untidy(spark, d):
    return _decisions("untidy", spark, d)


def _ingested(kind: str, spark: SparkSession, d: str, keep=one_table) -> dict[str, DataFrame]:
    return fanout.ingest_reservations(_requests(kind, spark, d), A.spots(spark, d), AS_OF, keep)


def _table_counts(kind: str, spark: SparkSession, d: str) -> DataFrame:
    out = _ingested(kind, spark, d, cut_lineage)
    one = F.lit(1).cast("bigint")
    none = F.lit(None).cast("date")
    counted = {
        "reservations": out["reservations"].select(
            "lot_id", S.utc_day(F.col("start_time")).alias("day"), one.alias("n")
        ),
        "reservation_events": out["reservation_events"].select(
            F.lit(None).cast("int").alias("lot_id"), S.utc_day(F.col("recorded_at")).alias("day"), one.alias("n")
        ),
        "usage_events": out["usage_events"].select(
            "lot_id", S.utc_day(F.col("recorded_at")).alias("day"), F.col("delta_available").cast("bigint").alias("n")
        ),
        "metric_deltas": out["metric_deltas"].select("lot_id", "day", F.col("reservations_count").alias("n")),
        "spots": out["spots"].filter("is_available").select("lot_id", none.alias("day"), one.alias("n")),
    }
    rows = append_rows(*[df.withColumn("table_name", F.lit(name)) for name, df in counted.items()])
    return rows.groupBy("table_name", "lot_id", "day").agg(F.sum("n").alias("n"))


@query
def reservation_fanout(spark, d):
    return _table_counts("claimed", spark, d)


@query
def reservation_fanout_own_lot(spark, d):
    return _table_counts("own", spark, d)


@query
def reservation_usage_events(spark, d):
    events = _ingested("untidy", spark, d)["usage_events"]
    return events.select("lot_id", "spot_id", "event_type", "recorded_at", "delta_available")


@query
def spots_after_reservations(spark, d):
    return _ingested("own", spark, d)["spots"].select("spot_id", "lot_id", "is_available")


@query
def session_decisions(spark, d):
    decided = admission.decide_sessions(A.session_requests(spark, d), A.stations(spark, d))
    return decided.select("reservation_id", "line_number", "station_id", "lot_id", "status", "message")


@query
def session_rejects(spark, d):
    decided = admission.decide_sessions(A.session_requests(spark, d), A.stations(spark, d))
    return admission.rejected(decided).groupBy("status", "message").agg(F.count("*").alias("n"))


def _started(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return fanout.ingest_sessions(A.session_requests(spark, d), A.stations(spark, d), AS_OF, one_table)


@query
def session_ingest(spark, d):
    return _started(spark, d)["metric_deltas"].drop("avg_occupancy_percent")


@query
def session_usage_events(spark, d):
    events = _started(spark, d)["usage_events"]
    return events.groupBy("lot_id", "event_type", "recorded_at", "metadata").agg(F.count("*").alias("n"))


# --- slots ------------------------------------------------------------------


@query
def slot_filter(spark, d):
    return slots.filter_slots(A.slots(spark, d), "Parking", "Occupied")


@query
def slot_filter_by_status(spark, d):
    return slots.filter_slots(A.slots(spark, d), status="Available")


@query
def ev_slots(spark, d):
    return slots.ev_slots(A.slots(spark, d))


@query
def bookable_slots(spark, d):
    return slots.with_bookable(A.slots(spark, d))


@query
def slot_stats(spark, d):
    return slots.slot_stats(A.slots(spark, d), A.slot_reservations(spark, d))


@query
def system_analytics(spark, d):
    return slots.system_analytics(A.slots(spark, d), A.slot_reservations(spark, d))


@query
def slot_vocabulary(spark, d):
    return slots.in_present_words(A.slots_in_old_words(spark, d))


@query
def slot_labels(spark, d):
    return A.slots(spark, d).select(
        "slot_id",
        S.slot_label(F.col("type"), F.col("slot_id"), F.col("status")).alias("label"),
        S.charging_label(F.col("status") == "Occupied").alias("charging"),
    )


@query
def reservations_newest_first(spark, d):
    held = A.slot_reservations(spark, d).select(
        "reservation_id",
        "slot_id",
        S.reserved_message(F.col("slot_id"), F.col("date"), F.lit("09:00")).alias("message"),
        "created_at",
    )
    return slots.newest_first(held, "created_at")


@query
def reservations_after_cancel(spark, d):
    return slots.remove(A.slot_reservations(spark, d), A.cancelled_keys(spark, d), "reservation_id")


@query
def session_estimate(spark, d):
    return slots.session_estimate(A.session_seconds(spark, d), "seconds")


OUTCOME = ["seq", "command", "slot_id", "ok", "message", "status_before", "status_after"]


@query
def slot_replay(spark, d):
    """Reserves and releases only, so no cancel needs resolving."""
    return replay.replay(A.slot_commands(spark, d), A.slots(spark, d), only_live_cancels=True).select(*OUTCOME)


@query
def slot_replay_any_log(spark, d):
    """All four commands, with cancels of reservations that are not listed."""
    return replay.replay(A.full_slot_commands(spark, d), A.slots(spark, d)).select(*OUTCOME)


@query
def slots_after_replay(spark, d):
    commands, held = A.full_slot_commands(spark, d), A.slots(spark, d)
    return replay.slots_after(replay.replay(commands, held), commands, held)


@query
def reservations_after_replay(spark, d):
    commands = A.full_slot_commands(spark, d)
    return replay.reservations_after(replay.replay(commands, A.slots(spark, d)), commands)


# --- JSON state -------------------------------------------------------------


@query
def json_state_load(spark, d):
    shape = T.StructType([T.StructField("k", T.IntegerType())])
    default = F.struct(F.lit(-1).alias("k"))
    loaded = json_state.load_json(A.state_texts(spark, d), "text", shape, default, "state")
    return loaded.select("event_id", F.col("state").isNull().alias("is_null"), "state.k")


@query
def json_state_load_list(spark, d):
    item = T.StructType([T.StructField("k", T.IntegerType())])
    default = F.array(F.struct(F.lit(-1).alias("k")))
    loaded = json_state.load_json(A.state_list_texts(spark, d), "text", T.ArrayType(item), default, "state")
    return loaded.select(
        "event_id", F.col("state").isNull().alias("is_null"), F.size("state").cast("bigint").alias("n"), F.col("state")[0]["k"].alias("k")
    )


@query
def json_state_save(spark, d):
    held = A.slots(spark, d)
    return held.select("slot_id", json_state.json_text(held).alias("state"))
