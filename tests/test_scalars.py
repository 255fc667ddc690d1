from __future__ import annotations

import datetime as dt
import json
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from kerbside.functions import scalars as S

T = dt.datetime


def values(spark, rows, kind, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


STARTS = [
    ("2024-03-05", T(2024, 3, 5)),
    ("2024-03", T(2024, 3, 1)),
    ("2024", T(2024, 1, 1)),
    ("2024-03-05T10:20", T(2024, 3, 5, 10, 20)),
    ("2024-03-05 10:20:30", T(2024, 3, 5, 10, 20, 30)),
    ("2024-03-05T10:20:30.123456Z", T(2024, 3, 5, 10, 20, 30, 123000)),
    ("2024-03-05T10:20:30.123456", T(2024, 3, 5, 10, 20, 30, 123000)),
    ("2024-03-05T23:30:00+05:30", T(2024, 3, 5, 18, 0)),
    ("2024-03-05T23:30:00-02:00", T(2024, 3, 6, 1, 30)),
    ("2024-03-05T10:20:30+0530", T(2024, 3, 5, 4, 50, 30)),
    ("2024-03-05T10:20:30-02", T(2024, 3, 5, 12, 20, 30)),
    # Digits alone are a year or nothing; milliseconds come as a number.
    ("1700000000123", None),
    ("20240305", None),
    ("12345", None),
    ("2099-12-31T00:00:00Z", T(2099, 12, 31)),
    ("soon", None),
    ("2024-13-01", None),
    ("2024-03-05T10:20 Europe/Berlin", None),
    ("10:20", None),
    (None, None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_instant_whatever_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = values(spark, [t for t, _ in STARTS], "string", S.parse_instant)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [want for _, want in STARTS]


def test_blank_start_is_as_of(spark):
    now = T(2024, 1, 2, 3)
    got = values(spark, ["", None, "soon", "2024-05-06"], "string", lambda c: S.start_or(c, S.as_timestamp(now)))
    assert got == [now, now, None, T(2024, 5, 6)]


def test_numeric_start(spark):
    now = S.as_timestamp(T(2024, 1, 2))
    got = values(spark, [0, 12345, 1700000000123, -86400000, 8640000000000001], "bigint", lambda c: S.start_or(F.lit("soon"), now, c))
    assert got == [T(1970, 1, 1), T(1970, 1, 1, 0, 0, 12, 345000), T(2023, 11, 14, 22, 13, 20, 123000), T(1969, 12, 31), None]


def test_longer_lookback_never_keeps_less(spark):
    asked = ["7", "2147483647", "2147483648", "9" * 30]
    got = values(spark, asked, "string", lambda c: S.since_day(c, T(2001, 8, 1)))
    assert got == [dt.date(2001, 7, 25), dt.date(1, 1, 1), dt.date(1, 1, 1), dt.date(1, 1, 1)]


def test_lookback_text(spark):
    asked = [None, "", "abc", "3abc", " 12", "0", "-2", "+4", "7.9", "99999999999999999999"]
    assert values(spark, asked, "string", S.lookback_days) == [7, 7, 7, 3, 12, 0, -2, 4, 7, S.MAX_DAYS]


def test_since_day_covers_eight_days(spark):
    assert values(spark, [7], "int", lambda c: S.since_day("7", T(2001, 8, 1, 15))) == [dt.date(2001, 7, 25)]


def test_blank(spark):
    assert values(spark, [None, "", " ", "0"], "string", S.is_blank) == [True, True, False, False]


def exact(x: float, digits: int) -> str:
    size = Decimal(abs(x)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)
    return ("-" if x < 0 else "") + f"{size:f}"


@pytest.mark.parametrize("digits", [0, 2])
def test_to_fixed_rounds_the_exact_value(spark, digits):
    import random

    rnd = random.Random(digits)
    numbers = [0.0, 0.5, 1.5, 2.5, 0.125, 0.375, 1.005, 2.675, 8.345, 1234567.125, -0.125, -2.5, 99.995, 999.5]
    numbers += [rnd.uniform(0, 10000) for _ in range(300)] + [rnd.randrange(100000) / 8 for _ in range(300)]
    assert values(spark, numbers, "double", lambda c: S.to_fixed(c, digits)) == [exact(n, digits) for n in numbers]


def test_session_maths(spark):
    df = spark.createDataFrame([(3599,), (3600,), (0,)], "s int")
    got = df.select(S.minutes_of(F.col("s")), S.energy_of(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(59, 7.2 * (3599 / 3600)), (60, 7.2), (0, 0.0)]


def test_labels(spark):
    df = spark.createDataFrame([("EV", "C1", "Occupied", 1.005, 17.5)], "t string, s string, st string, e double, c double")
    row = df.select(
        S.slot_label(F.col("t"), F.col("s"), F.col("st")),
        S.charger_label(F.col("s"), F.col("st")),
        S.cancelled_message(F.col("s")),
        S.stopped_message(F.col("e"), F.col("c")),
        S.charging_label(F.lit(False)),
    ).first()
    assert list(row) == [
        "EV C1 — Occupied",
        "C1 — Occupied",
        "✅ Cancelled reservation for C1",
        "✅ Charging stopped. Energy: 1.00 kWh | Cost: ₹18",
        "Idle",
    ]


def test_keys_repeat(spark):
    one = values(spark, ["a", "b", "a"], "string", lambda c: S.key_of("k", c, F.lit(1)))
    assert one[0] == one[2] != one[1]


def test_epoch_ms(spark):
    assert values(spark, [0, 1500], "bigint", S.epoch_ms_to_utc) == [T(1970, 1, 1), T(1970, 1, 1, 0, 0, 1, 500000)]


def test_json_state(spark, tmp_path):
    from pyspark.sql import types as P

    from kerbside.sources.json_state import json_text, load_json, save_json

    texts = [None, "", "{bad", "null", '{"a": 1, "b": "x"}', '{"a": "zz", "b": "y"}', '{"b": "only"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    shape = P.StructType([P.StructField("a", P.IntegerType()), P.StructField("b", P.StringType())])
    default = F.struct(F.lit(-1).alias("a"), F.lit("d").alias("b"))
    got = [r.v and tuple(r.v) for r in load_json(df, "t", shape, default, "v").orderBy("i").collect()]
    assert got == [(-1, "d")] * 3 + [None, (1, "x"), (-1, "d"), (None, "only")]

    listed = P.ArrayType(shape)
    none = F.array().cast(listed)
    rows = spark.createDataFrame([(0, '[{"a":1,"b":"x"}]'), (1, "oops"), (2, "null")], "i int, t string")
    got = [r.v for r in load_json(rows, "t", listed, none, "v").orderBy("i").collect()]
    assert [None if v is None else [tuple(x) for x in v] for v in got] == [[(1, "x")], [], None]

    state = spark.createDataFrame([("A1", None)], "slot_id string, note string")
    assert json.loads(state.select(json_text(state)).first()[0]) == {"slot_id": "A1", "note": None}
    save_json(state, str(tmp_path / "s"))
    assert spark.read.schema("slot_id string, note string").json(str(tmp_path / "s")).collect() == state.collect()
