"""Slot lists, filters, counts and session estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import constants as K
from kerbside.functions import scalars as S
from kerbside.sources.tables import append_rows


def filter_slots(slots: DataFrame, slot_type: str = K.ANY, status: str = K.ANY) -> DataFrame:
    """Slots of a type and a status; ``All`` switches a condition off."""
    for column, wanted in (("type", slot_type), ("status", status)):
        if wanted != K.ANY:
            slots = slots.filter(F.col(column) == wanted)
    return slots


def ev_slots(slots: DataFrame) -> DataFrame:
    return filter_slots(slots, slot_type="EV")


def with_bookable(slots: DataFrame) -> DataFrame:
    """A slot may be chosen unless it is occupied."""
    return slots.withColumn("is_bookable", F.col("status") != K.OCCUPIED)


def set_where(df: DataFrame, condition: Column, column: str, value) -> DataFrame:
    """Change one column where the condition holds; keep every other value."""
    value = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def set_where_key_in(df: DataFrame, keys: DataFrame, key: str, column: str, value) -> DataFrame:
    """``set_where`` for a set of keys."""
    marked = df.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return set_where(marked, F.col("_hit").isNotNull(), column, value).select(*df.columns)


def remove(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``keys``, which may repeat."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def newest_first(df: DataFrame, seq: str) -> DataFrame:
    return df.orderBy(F.col(seq).desc())


def _counts(slots: DataFrame, reservations: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Slot measures and the reservation count as one row.

    Each table is counted on its own; the two one-row results are then added up.
    """
    zero = F.lit(0).cast("bigint")
    of_slots = slots.agg(*[c.alias(n) for n, c in measures.items()]).withColumn("reservations", zero)
    of_reservations = reservations.agg(F.count("*").alias("reservations")).select(
        *[zero.alias(n) for n in measures], "reservations"
    )
    return append_rows(of_slots, of_reservations).agg(*[F.sum(c).alias(c) for c in of_slots.columns])


def slot_stats(slots: DataFrame, reservations: DataFrame) -> DataFrame:
    """One row: total, available, occupied, reservations."""
    return _counts(
        slots,
        reservations,
        {
            "total": F.count("*"),
            "available": F.count_if(F.col("status") == K.AVAILABLE),
            "occupied": F.count_if(F.col("status") == K.OCCUPIED),
        },
    )


def system_analytics(slots: DataFrame, reservations: DataFrame) -> DataFrame:
    """``slot_stats`` and the number of EV and parking slots."""
    return _counts(
        slots,
        reservations,
        {
            "total": F.count("*"),
            "available": F.count_if(F.col("status") == K.AVAILABLE),
            "occupied": F.count_if(F.col("status") == K.OCCUPIED),
            "ev": F.count_if(F.col("type") == "EV"),
            "parking": F.count_if(F.col("type") == "Parking"),
        },
    )


def _reword(c: Column, words: dict[str, str]) -> Column:
    out = c
    for old, new in words.items():
        out = F.when(c == old, new).otherwise(out)
    return out


def in_present_words(slots: DataFrame) -> DataFrame:
    """Slots in the older vocabulary, put into the present one; other words stay."""
    return slots.withColumn("type", _reword(F.col("type"), K.SLOT_TYPE_WORDS)).withColumn(
        "status", _reword(F.col("status"), K.SLOT_STATUS_WORDS)
    )


def session_estimate(
    df: DataFrame, seconds: str, power_kw: float = K.POWER_KW, rate_per_kwh: float = K.RATE_PER_KWH
) -> DataFrame:
    """Minutes, energy and cost in rupees of sessions of a given length, exact and as shown."""
    energy = S.energy_of(F.col(seconds), power_kw)
    cost = energy * F.lit(float(rate_per_kwh))
    return df.select(
        "*",
        S.minutes_of(F.col(seconds)).cast("bigint").alias("minutes"),
        energy.alias("energy_kwh"),
        cost.alias("cost_rupees"),
        S.to_fixed(energy, 2).alias("energy_text"),
        S.to_fixed(cost, 0).alias("cost_text"),
    )
