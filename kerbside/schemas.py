"""Declared schemas: domain tables, request inputs and the given test tables.

Schemas are DDL text, which Spark readers take as they are. Nothing is inferred.
Whole-number sums are ``bigint``; money columns are whole cents; timestamps are UTC
wall clock.
"""

DOMAIN = {
    "lots": (
        "lot_id string, name string, address string, total_spots int, price_per_hour int, "
        "has_ev_charging boolean, distance_meters int, timezone string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "spots": "spot_id string, lot_id string, label string, is_available boolean, supports_ev boolean",
    "stations": (
        "station_id string, lot_id string, name string, connector_type string, max_kw int, is_available boolean"
    ),
    "reservations": (
        "reservation_id string, lot_id string, spot_id string, user_id string, vehicle_plate string, "
        "start_time timestamp_ntz, end_time timestamp_ntz, status string"
    ),
    "reservation_events": (
        "event_id string, reservation_id string, status string, recorded_at timestamp_ntz, "
        "note string, metadata string"
    ),
    "charging_sessions": (
        "session_id string, station_id string, reservation_id string, user_id string, "
        "started_at timestamp_ntz, ended_at timestamp_ntz, status string, energy_kwh double, cost bigint"
    ),
    "usage_events": (
        "event_id string, lot_id string, spot_id string, event_type string, recorded_at timestamp_ntz, "
        "delta_available int, occupancy int, note string, metadata string"
    ),
    "lot_daily_metrics": (
        "lot_id string, day date, reservations_count bigint, charging_sessions_count bigint, "
        "energy_kwh double, revenue_cents bigint, avg_occupancy_percent double"
    ),
    "tariffs": (
        "tariff_id string, name string, price_per_hour int, price_per_kwh double, "
        "peak_multiplier double, created_at timestamp_ntz"
    ),
    "transactions": (
        "transaction_id string, reservation_id string, amount_cents int, currency string, "
        "status string, created_at timestamp_ntz"
    ),
    "slots": "slot_id string, type string, status string",
    "slot_reservations": (
        "reservation_id string, slot_id string, date string, time string, created_at bigint"
    ),
}

REQUESTS = {
    "reservation_requests": (
        "seq bigint, lot_id string, spot_id string, user_id string, vehicle_plate string, start_time string"
    ),
    "session_requests": (
        "seq bigint, station_id string, reservation_id string, user_id string, energy_kwh double, cost bigint"
    ),
    "slot_commands": (
        "seq bigint, command string, slot_id string, date string, time string, reservation_id string"
    ),
    # One stream carries both kinds; ``received_at`` is the arrival time.
    "stream_requests": (
        "kind string, seq bigint, received_at timestamp_ntz, lot_id string, spot_id string, user_id string, "
        "vehicle_plate string, start_time string, start_ms bigint, station_id string, reservation_id string, "
        "energy_kwh double, cost bigint"
    ),
}

GIVEN = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
}

ALL = {**DOMAIN, **REQUESTS, **GIVEN}
