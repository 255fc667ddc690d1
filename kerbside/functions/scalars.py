"""Scalar column expressions. All stay inside whole-stage code generation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions import constants as K

# Start times that are read: a year, month or day, or a day with a time, a fraction and a zone, each optional.
START_TIME = (
    r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:\.(\d{1,9}))?(Z|[+-]\d{2}(?::?\d{2})?)?)?)?)?$"
)
# Milliseconds since 1970 that a date can hold, either way.
MAX_EPOCH_MS = 8_640_000_000_000_000
# Look-backs beyond this many days reach all dates.
MAX_DAYS = 4_000_000
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"

EPOCH = "1970-01-01 00:00:00"


def is_blank(c: Column) -> Column:
    """Missing or empty text."""
    return c.isNull() | (F.length(c.cast("string")) == 0)


def as_utc(instant: Column) -> Column:
    """An instant (``TIMESTAMP``) as UTC wall clock, whatever the session zone."""
    return micros_to_utc(F.unix_micros(instant))


def as_instant(wall_clock: Column) -> Column:
    """UTC wall clock as an instant, whatever the session zone."""
    return F.concat(wall_clock.cast("string"), F.lit("Z")).cast("timestamp")


def micros_to_utc(micros: Column) -> Column:
    seconds = (micros.cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def epoch_ms_to_utc(ms: Column) -> Column:
    """Milliseconds since 1970 as UTC wall clock; null beyond what a date can hold."""
    ms = ms.cast("bigint")
    return F.when(F.abs(ms) <= MAX_EPOCH_MS, as_utc(F.timestamp_millis(ms)))


def parse_instant(text: Column) -> Column:
    """Start-time text as UTC wall clock at millisecond precision, null when unreadable.

    One pattern says what is read: ISO years, months, dates and date-times, these with
    ``Z`` or an offset (hours, or hours and minutes) or, without, as UTC. All else is
    refused, digits alone too, whatever their number; milliseconds come as a number.
    """
    def part(i: int) -> Column:
        return F.regexp_extract(text, START_TIME, i)

    zone = part(7)
    day = F.concat_ws("-", part(1), F.when(part(2) != "", part(2)).otherwise("01"), F.when(part(3) != "", part(3)).otherwise("01"))
    clock = F.concat(F.when(part(4) != "", part(4)).otherwise("00:00"), F.when(part(5) != "", part(5)).otherwise(":00"))
    wall = F.concat(day, F.lit("T"), clock, F.lit("."), F.rpad(F.left(part(6), F.lit(3)), 3, "0")).try_cast("timestamp_ntz")
    hours = F.substring(zone, 2, 2).try_cast("int")
    minutes = F.coalesce(F.right(zone, F.lit(2)).try_cast("int"), F.lit(0))
    offset = F.when((zone == "") | (zone == "Z"), F.lit(0)).otherwise(
        (hours * 60 + F.when(F.length(zone) > 3, minutes).otherwise(0)) * F.when(F.left(zone, F.lit(1)) == "-", -1).otherwise(1)
    )
    sound = text.rlike(START_TIME) & (F.abs(offset) < 24 * 60)
    return F.when(sound, wall - F.make_dt_interval(mins=offset))


def start_or(text: Column, as_of: Column, ms: Column | None = None) -> Column:
    """A start given as number ``ms`` or as text; neither means ``as_of``; an unreadable one stays null."""
    from_text = F.when(is_blank(text), as_of).otherwise(parse_instant(text.cast("string")))
    return from_text if ms is None else F.when(ms.isNotNull(), epoch_ms_to_utc(ms)).otherwise(from_text)


def utc_day(c: Column) -> Column:
    return c.cast("date")


def as_timestamp(value: Column | dt.datetime | str) -> Column:
    """A column, date-time or text as UTC wall clock."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, dt.datetime):
        # As text, since Spark would read a date-time literal in the session's zone.
        value = (value.astimezone(dt.UTC) if value.tzinfo else value).replace(tzinfo=None).isoformat(" ")
    return F.lit(value).cast("timestamp_ntz")


def lookback_days(days) -> Column:
    """Leading whole number of the text, else the default; up to ``MAX_DAYS`` either way, which reaches all dates."""
    text = days if isinstance(days, Column) else F.lit(None if days is None else str(days))
    digits = F.regexp_extract(text.cast("string"), r"^\s*([+-]?[0-9]+)", 1)
    far = F.when(F.left(digits, F.lit(1)) == "-", F.lit(-MAX_DAYS)).otherwise(F.lit(MAX_DAYS))
    number = F.when(digits != "", F.coalesce(digits.try_cast("bigint"), far.cast("bigint")))
    # Null stays null here, which least and greatest alone would not do.
    bounded = F.when(number.isNotNull(), F.greatest(F.least(number, F.lit(MAX_DAYS)), F.lit(-MAX_DAYS)))
    return F.coalesce(bounded, F.lit(K.DEFAULT_LOOKBACK_DAYS)).cast("int")


def since_day(days, as_of) -> Column:
    """First day kept by a look-back of ``days`` before ``as_of``, no earlier than year 1 and no later than 9999."""
    day = F.date_sub(as_timestamp(as_of).cast("date"), lookback_days(days))
    return F.greatest(F.least(day, F.lit(LAST_DAY).cast("date")), F.lit(FIRST_DAY).cast("date"))


def minutes_of(seconds: Column) -> Column:
    return F.floor(seconds / 60)


def hours_of(seconds: Column) -> Column:
    return seconds / F.lit(3600.0)


def energy_of(seconds: Column, power_kw: float = K.POWER_KW) -> Column:
    return F.lit(float(power_kw)) * hours_of(seconds)


def to_fixed(c: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded from the exact binary value, ties away from zero.

    ``format_number`` rounds the exact value too, but sends ties to even; a double
    is a tie only when it is an odd multiple of 2**-(digits + 1).
    """
    size = F.abs(c)
    halves = size * F.lit(float(2 ** (digits + 1)))
    tie = (halves == F.floor(halves)) & (halves % 2 == 1)
    away = F.floor(size * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))
    text = F.translate(F.format_number(F.when(tie, away).otherwise(size), digits), ",", "")
    return F.when(c < 0, F.concat(F.lit("-"), text)).otherwise(text)


def charging_label(is_charging: Column) -> Column:
    return F.when(is_charging, K.LABEL_CHARGING).otherwise(K.LABEL_IDLE)


def slot_label(slot_type: Column, slot_id: Column, status: Column) -> Column:
    return F.format_string("%s %s — %s", slot_type, slot_id.cast("string"), status)


def charger_label(slot_id: Column, status: Column) -> Column:
    return F.format_string("%s — %s", slot_id.cast("string"), status)


def reserved_message(slot_id: Column, date: Column, time: Column) -> Column:
    return F.format_string("✅ Reserved %s on %s at %s", slot_id.cast("string"), date, time)


def cancelled_message(slot_id: Column) -> Column:
    return F.format_string("✅ Cancelled reservation for %s", slot_id.cast("string"))


def stopped_message(energy_kwh: Column, cost: Column) -> Column:
    return F.format_string(
        "✅ Charging stopped. Energy: %s kWh | Cost: ₹%s", to_fixed(energy_kwh, 2), to_fixed(cost, 0)
    )


def key_of(kind: str, *parts: Column) -> Column:
    """Repeatable id from business keys."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts]), 256)
