"""Fact logs by day: batch and stream readers agree with the tables written, and days prune folders."""

from __future__ import annotations

import glob
import re

from pyspark.sql import functions as F

from kerbside.operators import metrics
from kerbside.sources import adapters as A
from kerbside.sources import event_log as L
from kerbside.streaming import ingest_stream as I

DIRECTORY = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def write_in_parts(df, path, time, key):
    for part in (F.col(key).isNull() | (F.crc32(F.col(key).cast("string")) % 2 == 0), ~(F.col(key).isNull() | (F.crc32(F.col(key).cast("string")) % 2 == 0))):
        L.write_log(df.filter(part), path, time, key)


def test_batch_and_stream_give_the_metrics_of_the_tables(spark, tmp_path):
    reservations, sessions, stations = A.reservations(spark, DIRECTORY), A.charging_sessions(spark, DIRECTORY), A.stations(spark, DIRECTORY)
    r_path, s_path = str(tmp_path / "r"), str(tmp_path / "s")
    write_in_parts(reservations, r_path, "start_time", "reservation_id")
    write_in_parts(sessions, s_path, "started_at", "session_id")
    r_log, s_log = L.read_log(spark, r_path, reservations.schema), L.read_log(spark, s_path, sessions.schema)
    assert rows(r_log.drop("day")) == rows(reservations) and rows(s_log.drop("day")) == rows(sessions)
    want = metrics.daily_metrics(reservations, sessions, stations)
    got = metrics.daily_metrics(r_log.drop("day"), s_log.drop("day"), stations)
    assert rows(got) == rows(want)
    streamed = I.daily_metrics_stream(
        L.read_log_stream(spark, r_path, reservations.schema, 500).drop("day"), L.read_log_stream(spark, s_path, sessions.schema, 500).drop("day"), stations
    )
    query = (
        streamed.writeStream.outputMode("complete").format("memory").queryName("log_metrics")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(300) and query.exception() is None
    table = spark.table("log_metrics")
    assert rows(table) == rows(want.select(table.columns))


def test_look_back_prunes_day_folders(spark, tmp_path):
    reservations = A.reservations(spark, DIRECTORY)
    path = str(tmp_path / "r")
    L.write_log(reservations, path, "start_time", "reservation_id")
    recent = L.read_log_since(spark, path, reservations.schema, 30, "1998-08-01T00:00:00Z", "start_time")
    text = recent._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= ", text)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(start_time,", text)
    want = reservations.filter(F.col("start_time") >= F.lit("1998-07-02").cast("timestamp_ntz"))
    assert rows(recent.drop("day")) == rows(want)


def test_a_busy_day_is_spread_over_files(spark, tmp_path):
    df = spark.range(40_000).select(
        F.col("id").cast("string").alias("k"),
        F.when(F.col("id") % 10 < 8, F.lit("2024-01-01 10:00:00")).otherwise(F.lit("2024-01-02 10:00:00")).cast("timestamp_ntz").alias("t"),
    )
    path = str(tmp_path / "busy")
    L.write_log(df.repartition(8), path, "t", "k")
    assert len(glob.glob(f"{path}/day=2024-01-01/*.parquet")) > 1
    assert L.read_log(spark, path, df.schema).filter("day = DATE'2024-01-02'").count() == 8_000
