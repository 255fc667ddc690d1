"""The given test tables seen as the domain tables.

Each function maps a given table to a domain table by column expressions only, so
filters and column lists still reach the Parquet scan. Keys keep their integer
types; the operators work with any key type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.functions import scalars as S
from kerbside.sources.tables import read_table

AVAILABLE_OVER = 4500
LOT_COUNT = 25


def _is_open() -> Column:
    return F.col("c_acctbal") > AVAILABLE_OVER


def _is_ev() -> Column:
    return F.col("c_mktsegment") == "AUTOMOBILE"


def lots(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "nation").select(
        F.col("n_nationkey").alias("lot_id"),
        F.col("n_name").alias("name"),
        F.lit(None).cast("string").alias("address"),
        F.lit(None).cast("int").alias("total_spots"),
        F.lit(None).cast("int").alias("price_per_hour"),
        (F.col("n_nationkey") % 2 == 0).alias("has_ev_charging"),
        F.lit(None).cast("int").alias("distance_meters"),
    )


def spots(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("spot_id"),
        F.col("c_nationkey").alias("lot_id"),
        F.col("c_name").alias("label"),
        _is_open().alias("is_available"),
        _is_ev().alias("supports_ev"),
    )


def slots(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("slot_id"),
        F.when(_is_ev(), "EV").otherwise("Parking").alias("type"),
        F.when(_is_open(), "Available").otherwise("Occupied").alias("status"),
    )


def slots_in_old_words(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("slot_id"),
        F.when(_is_ev(), "EV Charger").otherwise("Parking Slot").alias("type"),
        F.when(_is_open(), "Available").when(_is_ev(), "In Use").otherwise("Occupied").alias("status"),
    )


def stations(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("station_id"),
        F.col("s_nationkey").alias("lot_id"),
        F.col("s_name").alias("name"),
        (F.col("s_acctbal") > 0).alias("is_available"),
    )


def reservations(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders")
    spot_lots = spots(spark, d).select("spot_id", "lot_id")
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "reserved")
        .otherwise("active")
    )
    return orders.select(
        F.col("o_orderkey").alias("reservation_id"),
        F.col("o_custkey").alias("spot_id"),
        F.col("o_orderdate").alias("start_time"),
        status.alias("status"),
    ).join(spot_lots, "spot_id")


def reservation_events(spark: SparkSession, d: str) -> DataFrame:
    """Every order was reserved when placed; finished ones were completed a day later."""
    orders = read_table(spark, d, "orders")
    reserved = F.struct(
        F.lit("reserved").alias("status"), F.col("o_orderdate").alias("recorded_at"), F.lit(0).alias("step")
    )
    completed = F.struct(
        F.lit("completed").alias("status"),
        (F.col("o_orderdate") + F.expr("INTERVAL '1' DAY")).alias("recorded_at"),
        F.lit(1).alias("step"),
    )
    steps = F.when(F.col("o_orderstatus") == "F", F.array(reserved, completed)).otherwise(F.array(reserved))
    return orders.select(F.col("o_orderkey").alias("reservation_id"), F.explode(steps).alias("e")).select(
        (F.col("reservation_id") * 2 + F.col("e.step")).alias("event_id"),
        "reservation_id",
        "e.status",
        "e.recorded_at",
    )


def _cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def charging_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Line items as sessions; the id is a 256-bit hash of the row and, among equal rows, its number."""
    parts = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "_cents"]
    equal = Window.partitionBy(*parts).orderBy("l_shipdate", "l_quantity")
    lines = read_table(spark, d, "lineitem").withColumn("_cents", _cents())
    return lines.withColumn("_twin", F.row_number().over(equal) - 1).select(
        S.key_of("session", *[F.col(c) for c in [*parts, "_twin"]]).alias("session_id"),
        F.col("l_orderkey").alias("reservation_id"),
        F.col("l_suppkey").alias("station_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_shipdate").alias("started_at"),
        F.col("l_quantity").alias("energy_kwh"),
        _cents().alias("cost"),
    )


def session_seconds(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("reservation_id"),
        F.col("l_linenumber").alias("line_number"),
        (F.col("l_quantity") * 60).alias("seconds"),
    )


def usage_events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select(
        "event_id",
        (F.col("user_id") % LOT_COUNT).cast("int").alias("lot_id"),
        "event_type",
        F.col("ts").alias("recorded_at"),
    )


def occupancy_samples(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select(
        (F.col("user_id") % LOT_COUNT).cast("int").alias("lot_id"),
        F.col("ts").alias("sampled_at"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("sample"),
    )


def _order_requests(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderkey") % LOT_COUNT).cast("int").alias("lot_id"),
        F.col("o_custkey").alias("spot_id"),
        F.lit(None).cast("string").alias("user_id"),
        F.concat(F.lit("PL-"), F.col("o_custkey").cast("string")).alias("vehicle_plate"),
        F.col("o_orderdate").cast("date").cast("string").alias("start_time"),
        "o_orderpriority",
    )


def _with_own_lot(requests: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return requests.drop("lot_id").join(spots(spark, d).select("spot_id", "lot_id"), "spot_id")


def reservation_requests(spark: SparkSession, d: str, own_lot: bool = False) -> DataFrame:
    """One request per order. The claimed lot is wrong for most unless ``own_lot``."""
    requests = _order_requests(spark, d).drop("o_orderpriority")
    return _with_own_lot(requests, spark, d) if own_lot else requests


def untidy_reservation_requests(spark: SparkSession, d: str) -> DataFrame:
    """Own-lot requests with missing plates, unreadable and blank start times mixed in."""
    priority = F.col("o_orderpriority")
    start = F.when(priority == "4-NOT SPECIFIED", "soon").when(priority == "3-MEDIUM", "")
    return (
        _with_own_lot(_order_requests(spark, d), spark, d)
        .withColumn("vehicle_plate", F.when(priority != "5-LOW", F.col("vehicle_plate")))
        .withColumn("start_time", start.otherwise(F.col("start_time")))
        .drop("o_orderpriority")
    )


def session_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request per session: no station on line 1, an unknown station on line 2."""
    station = F.when(F.col("line_number") == 2, -F.col("station_id") - 1).when(
        F.col("line_number") > 2, F.col("station_id")
    )
    # An arrival number: order, line, and the number among the order's lines of that number.
    same_line = Window.partitionBy("reservation_id", "line_number").orderBy("session_id")
    seq = F.col("reservation_id") * 4096 + F.col("line_number") * 256 + F.row_number().over(same_line)
    return charging_sessions(spark, d).select(
        seq.alias("seq"),
        station.alias("station_id"),
        "reservation_id",
        F.lit(None).cast("string").alias("user_id"),
        "energy_kwh",
        "cost",
        "line_number",
    )


def slot_commands(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups and purchases reserve, errors release; other events are no commands."""
    command = F.when(F.col("event_type").isin("signup", "purchase"), "reserve").when(
        F.col("event_type") == "error", "release"
    )
    return (
        read_table(spark, d, "events")
        .select(
            F.col("event_id").alias("seq"),
            command.alias("command"),
            F.col("user_id").alias("slot_id"),
            F.col("ts").cast("date").cast("string").alias("date"),
            F.substring(F.col("ts").cast("string"), 12, 5).alias("time"),
            F.col("event_id").alias("reservation_id"),
        )
        .filter(F.col("command").isNotNull())
    )


def full_slot_commands(spark: SparkSession, d: str) -> DataFrame:
    """All four commands. Cancels name any earlier event, so many name no live reservation.

    Views cancel, a click of high value resets, other clicks release an unknown
    slot. Among reserves, those of low value lack a time and the next ones name an
    unknown slot.
    """
    k = F.get_json_object("props", "$.k").cast("bigint")
    command = (
        F.when(F.col("event_type").isin("signup", "purchase"), "reserve")
        .when(F.col("event_type") == "view", "cancel")
        .when((F.col("event_type") == "click") & (F.col("value") > 300), "reset")
        .otherwise("release")
    )
    unknown = (F.col("event_type") == "click") | ((F.col("command") == "reserve") & F.col("value").between(5, 8))
    return (
        read_table(spark, d, "events")
        .select(
            F.col("event_id").alias("seq"),
            command.alias("command"),
            F.col("event_type"),
            F.col("user_id"),
            F.col("value"),
            F.col("ts").cast("date").cast("string").alias("date"),
            F.substring(F.col("ts").cast("string"), 12, 5).alias("clock"),
            (F.col("event_id") - 1 - k).alias("earlier"),
        )
        .select(
            "seq",
            "command",
            F.when(F.col("command").isin("reserve", "release") & unknown, -F.col("user_id") - 1)
            .when(F.col("command").isin("reserve", "release"), F.col("user_id"))
            .alias("slot_id"),
            F.when(F.col("command") == "reserve", F.col("date")).alias("date"),
            F.when((F.col("command") == "reserve") & (F.col("value") >= 5), F.col("clock")).alias("time"),
            F.when(F.col("command") == "reserve", F.col("seq"))
            .when(F.col("command") == "cancel", F.col("earlier"))
            .alias("reservation_id"),
        )
    )


def slot_reservations(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a reservation held on a slot, newest order last."""
    return read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("reservation_id"),
        F.col("o_custkey").alias("slot_id"),
        F.col("o_orderdate").cast("date").cast("string").alias("date"),
        F.col("o_orderkey").alias("created_at"),
    )


def cancelled_keys(spark: SparkSession, d: str) -> DataFrame:
    """Reservations with a returned line count as cancelled."""
    return (
        read_table(spark, d, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .select(F.col("l_orderkey").alias("reservation_id"))
    )


def state_texts(spark: SparkSession, d: str) -> DataFrame:
    """Event properties as stored state text, with empty, cut-off, ``null`` and wrong-type text mixed in."""
    return read_table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)"))
        .when(F.col("event_type") == "signup", "")
        .when((F.col("event_type") == "view") & (F.col("value") < 50), "null")
        .when(F.col("event_type") == "view", F.regexp_replace("props", r"\d+", '"text"'))
        .otherwise(F.col("props"))
        .alias("text"),
    )


def state_list_texts(spark: SparkSession, d: str) -> DataFrame:
    """Event properties as stored lists; cut off, empty, ``null``, of wrong type, a lone object, or with more text after it."""
    whole = F.concat(F.lit(" ["), F.col("props"), F.lit(","), F.col("props"), F.lit("]\n"))
    return read_table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.concat(F.lit("["), F.col("props")))
        .when(F.col("event_type") == "signup", "")
        .when((F.col("event_type") == "view") & (F.col("value") < 50), "\nnull ")
        .when(F.col("event_type") == "view", F.regexp_replace(whole, r"\d+", '"text"'))
        .when(F.col("event_type") == "click", F.col("props"))
        .when(F.col("event_id") % 3 == 0, F.concat(whole, F.lit("trailing")))
        .otherwise(whole)
        .alias("text"),
    )


def nested_lots(spark: SparkSession, d: str) -> DataFrame:
    """One nested create per supplier: a lot with one to four spots and one charger."""
    key = F.col("s_suppkey")
    labels = F.sequence(F.lit(1).cast("bigint"), key % 4 + 1)
    new_spots = F.transform(
        labels,
        lambda i: F.struct(
            F.concat(F.lit("S"), i.cast("string")).alias("label"),
            (i % 2 == 1).alias("is_available"),
            (i == 1).alias("supports_ev"),
        ),
    )
    charger = F.struct(
        F.col("s_name").alias("name"),
        F.when(key % 2 == 0, "CCS2").otherwise("Type2").alias("connector_type"),
        F.when(key % 2 == 0, 50).otherwise(22).alias("max_kw"),
        F.lit(True).alias("is_available"),
    )
    return read_table(spark, d, "supplier").select(
        key.alias("lot_id"),
        F.col("s_name").alias("name"),
        new_spots.alias("spots"),
        F.array(charger).alias("stations"),
    )



def start_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each order's date in one of the forms that a start time may have, or as a number, or unreadable."""
    day = F.col("o_orderdate").cast("date")
    form = F.col("o_orderkey") % 10
    tails = {1: "T10:20:30Z", 2: "T23:30:00+05:30", 3: "T10:20:30+0530", 4: "T10:20:30.123456", 5: " 01:00-02", 8: "T10:20 Europe/Berlin"}
    text = F.when(form == 0, day.cast("string")).when(form == 7, "soon").when(form == 9, F.date_format(day.cast("timestamp_ntz"), "yyyyMMdd"))
    for n, tail in tails.items():
        text = text.when(form == n, F.concat(day.cast("string"), F.lit(tail)))
    days = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint")
    return read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), text.alias("start_time"), F.when(form == 6, days * 86_400_000 + 123).alias("start_ms")
    )


def lookback_texts(spark: SparkSession, d: str) -> DataFrame:
    """Look-back texts, some beyond what an integer or a long holds."""
    texts = ["3", " 12", "2147483648", "-2", "abc", "7.9", "99999999999999999999", ""]
    return read_table(spark, d, "events").select(
        "event_id", F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % len(texts) + 1).cast("int")).alias("days")
    )
