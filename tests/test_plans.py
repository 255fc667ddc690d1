"""Plans the queries must keep: no cross joins, no Python, pruned and filtered scans, early limits."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from kerbside.operators import metrics
from kerbside.sources import adapters as A

DIRECTORY = "/root/testdata/sf0.001"
QUERIES = entry.REGISTRY


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, DIRECTORY))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
        assert banned not in text


def test_lookback_reaches_both_scans(spark):
    text = plan(QUERIES["analytics_daily"](spark, DIRECTORY))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(o_orderdate", text)
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(l_shipdate", text)


@pytest.mark.parametrize(
    ("name", "read"),
    [
        ("available_by_lot", {"customer": "c_nationkey:int,c_acctbal:double"}),
        ("slot_stats", {"customer": "c_acctbal:double", "orders": ""}),
        ("daily_last_occupancy", {"events": "event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double"}),
        ("session_rejects", {"lineitem": "l_suppkey:bigint,l_linenumber:int", "supplier": "s_suppkey:bigint"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, read):
    text = plan(QUERIES[name](spark, DIRECTORY))
    scans = dict(re.findall(r"Location: \S+ \[[^\]]*/(\w+)\.parquet\][\s\S]*?ReadSchema: struct<([^>]*)>", text))
    assert scans == read


def test_limits_apply_before_the_shuffle(spark):
    every_lot = plan(QUERIES["lot_history_all"](spark, DIRECTORY))
    assert every_lot.count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan(QUERIES["lot_history"](spark, DIRECTORY))


def test_roll_up_has_one_shuffle_for_both_facts(spark):
    df = metrics.daily_metrics(
        A.reservations(spark, DIRECTORY), A.charging_sessions(spark, DIRECTORY), A.stations(spark, DIRECTORY)
    )
    tree = df._jdf.queryExecution().executedPlan().toString()
    # Stations and spots are small here, so Spark broadcasts them by their file sizes.
    assert tree.count("Exchange hashpartitioning") == 1
    assert tree.count("HashAggregate") == 2 and "SortAggregate" not in tree


def test_large_stations_are_not_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        text = plan(QUERIES["session_ingest"](spark, DIRECTORY))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text


def test_history_cutoff_reaches_the_scan(spark):
    text = plan(QUERIES["lot_history_by_days"](spark, DIRECTORY))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,", text)
    assert text.count("WindowGroupLimit") >= 2
