from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kerbside.functions import scalars as S
from kerbside.operators import admission, detail, fanout, lots, metrics, ranking, slots
from kerbside.sources import tables

T, D = dt.datetime, dt.date
NOW = T(2024, 5, 10, 12)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def facts(frames):
    reservations = frames(
        "reservations",
        {"reservation_id": "R1", "lot_id": "L1", "spot_id": "A1", "start_time": T(2024, 5, 1, 23, 59), "status": "reserved"},
        {"reservation_id": "R2", "lot_id": "L1", "spot_id": "A2", "start_time": T(2024, 5, 2), "status": "reserved"},
        {"reservation_id": "R3", "lot_id": "L2", "spot_id": "B1", "start_time": T(2030, 1, 1), "status": "reserved"},
    )
    sessions = frames(
        "charging_sessions",
        {"session_id": "S1", "station_id": "C1", "reservation_id": "R1", "started_at": T(2024, 5, 1, 1), "energy_kwh": 2.5, "cost": 100},
        {"session_id": "S2", "station_id": "C1", "started_at": T(2024, 5, 1, 2)},
        {"session_id": "S3", "station_id": "C2", "reservation_id": "R1", "started_at": T(2024, 5, 3), "energy_kwh": 1.0, "cost": 50},
    )
    return reservations, sessions


def test_daily_metrics_rows_exist_only_with_facts(facts, seed):
    got = rows(metrics.daily_metrics(*facts, seed["stations"]))
    assert got == sorted(
        [
            ("L1", D(2024, 5, 1), 1, 2, 2.5, 100, None),
            ("L1", D(2024, 5, 2), 1, 0, 0.0, 0, None),
            ("L2", D(2024, 5, 3), 0, 1, 1.0, 50, None),
            ("L2", D(2030, 1, 1), 1, 0, 0.0, 0, None),
        ],
        key=str,
    )


def test_occupancy_last_sample_wins(spark, facts, seed):
    samples = spark.createDataFrame(
        [("L1", T(2024, 5, 1, 5), 1, 80.0), ("L1", T(2024, 5, 1, 6), 2, 10.0), ("L1", T(2024, 5, 1, 7), 3, None),
         ("L3", T(2024, 5, 1), 4, 5.0)],
        "lot_id string, sampled_at timestamp_ntz, seq bigint, sample double",
    )
    assert rows(metrics.last_occupancy(samples)) == [("L1", D(2024, 5, 1), 10.0), ("L3", D(2024, 5, 1), 5.0)]
    both = metrics.daily_metrics(*facts, seed["stations"], samples=samples)
    by_key = {(r.lot_id, r.day): r for r in both.collect()}
    assert by_key["L1", D(2024, 5, 1)].avg_occupancy_percent == 10.0
    assert tuple(by_key["L3", D(2024, 5, 1)]) == ("L3", D(2024, 5, 1), 0, 0, 0.0, 0, 5.0)


def test_merge_over_random_splits_equals_roll_up(spark, facts, seed):
    rnd = random.Random(3)
    whole = spark.createDataFrame(
        [(f"R{i}", rnd.choice(["L1", "L2"]), T(2024, 5, rnd.randrange(1, 4))) for i in range(60)],
        "reservation_id string, lot_id string, start_time timestamp_ntz",
    )
    sessions = facts[1]
    want = rows(metrics.daily_metrics(whole, sessions, seed["stations"]))
    for trial in range(2):
        share = F.pmod(F.xxhash64("reservation_id", F.lit(trial)), F.lit(3))
        parts = [
            metrics.daily_metrics(
                whole.filter(share == i), sessions if i == 1 else sessions.limit(0), seed["stations"]
            )
            for i in range(3)
        ]
        merged = metrics.merge_metrics(metrics.merge_metrics(parts[0], parts[1]), parts[2])
        assert rows(merged, *parts[0].columns) == want


def test_merge_replaces_occupancy_only_when_given(frames):
    def one(value):
        return frames("lot_daily_metrics", {"lot_id": "L", "day": D(2024, 1, 1), "reservations_count": 1,
                      "charging_sessions_count": 0, "energy_kwh": 1.0, "revenue_cents": 2, "avg_occupancy_percent": value})

    assert metrics.merge_metrics(one(5.0), one(None)).first().avg_occupancy_percent == 5.0
    assert metrics.merge_metrics(one(5.0), one(7.0)).first().avg_occupancy_percent == 7.0
    assert metrics.merge_metrics(one(5.0), one(7.0)).first().revenue_cents == 4


def test_analytics_daily_keeps_future_days(facts, seed):
    daily = metrics.daily_metrics(*facts, seed["stations"])
    got = metrics.analytics_daily(daily, seed["lots"], "8", NOW).collect()
    assert [(r.lot_id, r.day, r.lot_name) for r in got] == [
        ("L1", D(2024, 5, 2), "North"), ("L2", D(2024, 5, 3), "South"), ("L2", D(2030, 1, 1), "South")]


def test_lots_overview(facts, seed):
    daily = metrics.daily_metrics(*facts, seed["stations"])
    got = lots.lots_overview(seed["lots"], seed["spots"], daily)
    assert rows(got, "lot_id", "available_spots", "total_spots", "latest_reservations") == [
        ("L1", 1, 60, 1), ("L2", 2, 80, 1), ("L3", 0, 10, None)]


def test_lookups(seed):
    assert lots.lookup(seed["spots"], "spot_id", "A1").count() == 1
    assert lots.lookup(seed["spots"], "spot_id", "zz").count() == 0
    assert lots.lot_spots(seed["spots"], "nowhere").count() == 0
    asked = seed["spots"].select("spot_id").union(seed["lots"].select("lot_id")).distinct()
    found = lots.lookup_many(asked, seed["spots"], "spot_id")
    assert rows(found, "spot_id", "found") == [(s, True) for s in ["A1", "A2", "B1", "B2"]] + [
        (s, False) for s in ["L1", "L2", "L3"]]


def test_history_top_k_with_a_hot_lot(spark):
    base = T(2024, 1, 1)
    events = spark.range(3000).select(
        F.col("id").cast("string").alias("event_id"),
        F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("lot_id"),
        (S.as_timestamp(base) + F.make_dt_interval(secs=F.col("id") % 700)).alias("recorded_at"),
    )
    got = lots.lot_history_all(events, k=50)
    by_lot = {}
    for r in events.collect():
        by_lot.setdefault(r.lot_id, []).append((r.recorded_at, r.event_id))
    want = {lot: sorted(v, reverse=True)[:50] for lot, v in by_lot.items()}
    for lot in want:
        mine = got.filter(F.col("lot_id") == lot).orderBy("rn").collect()
        assert [(r.recorded_at, r.event_id) for r in mine] == want[lot]
        assert [(r.recorded_at, r.event_id) for r in lots.lot_history(events, lot, 50).collect()] == want[lot]


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 5, "y")], "k string, o int, v string")
    assert rows(ranking.latest_per_key(df, ["k"], "o")) == [("a", 2, None), ("b", 5, "y")]


@pytest.fixture(scope="module")
def family(frames, facts):
    events = frames(
        "reservation_events",
        {"event_id": "E1", "reservation_id": "R1", "status": "reserved", "recorded_at": T(2024, 5, 1)},
        {"event_id": "E2", "reservation_id": "R1", "status": "active", "recorded_at": T(2024, 5, 2)},
        {"event_id": "E3", "reservation_id": "R2", "status": "reserved", "recorded_at": T(2024, 5, 2)},
        {"event_id": "E9", "reservation_id": "R-unknown", "status": "reserved", "recorded_at": T(2024, 5, 2)},
    )
    reservations, sessions = facts
    return reservations, events, sessions.filter("reservation_id IS NOT NULL")


def test_detail_lists(family):
    got = {r.reservation_id: r for r in detail.reservation_detail(*family).collect()}
    assert set(got) == {"R1", "R2", "R3"}
    assert [e.event_id for e in got["R1"].events] == ["E2", "E1"]
    assert sorted(s.session_id for s in got["R1"].sessions) == ["S1", "S3"]
    assert got["R3"].events == [] and got["R3"].sessions == []
    assert all(r.part == 0 for r in got.values())
    assert got["R2"].spot_id == "A2"


def test_detail_rows(family):
    got = detail.reservation_rows(*family)
    assert rows(got, "reservation_id", "kind", "event.event_id", "session.session_id") == sorted(
        [("R1", "event", "E1", None), ("R1", "event", "E2", None), ("R1", "session", None, "S1"),
         ("R1", "session", None, "S3"), ("R2", "event", "E3", None), ("R3", None, None, None)], key=str)


def test_large_reservation_is_whole_over_several_rows(spark, family):
    reservations, _, sessions = family
    events = spark.range(1000).select(
        F.format_string("E%04d", "id").alias("event_id"),
        F.when(F.col("id") < 990, "R1").otherwise("R2").alias("reservation_id"),
        F.lit("reserved").alias("status"),
        S.as_timestamp(NOW).alias("recorded_at"),
    )
    got = detail.reservation_detail(reservations, events, sessions, page=100).collect()
    big = [r for r in got if r.reservation_id == "R1"]
    assert len(big) == 10 and {r.part for r in big} == set(range(10))
    assert sorted(e.event_id for r in big for e in r.events) == [f"E{i:04d}" for i in range(990)]
    assert all([e.event_id for e in r.events] == sorted((e.event_id for e in r.events), reverse=True) for r in big)
    in_order = [e.event_id for r in sorted(big, key=lambda r: r.part) for e in r.events]
    assert in_order == [f"E{i:04d}" for i in range(989, -1, -1)]
    assert [len(r.events) for r in sorted(big, key=lambda r: r.part)] == [100] * 9 + [90]
    assert sum(len(r.sessions) for r in big) == 2
    assert [len(r.events) for r in got if r.reservation_id == "R2"] == [10]


def reference_admission(requests, spots):
    state = {s["spot_id"]: dict(s) for s in spots}
    out = {}
    for r in sorted(requests, key=lambda r: r["seq"]):
        spot = state.get(r.get("spot_id"))
        if not r.get("lot_id") or not r.get("spot_id") or not r.get("vehicle_plate"):
            out[r["seq"]] = (400, "lotId, spotId, vehiclePlate are required")
        elif spot is None or spot["lot_id"] != r["lot_id"]:
            out[r["seq"]] = (400, "Spot not found for lot")
        elif not spot["is_available"]:
            out[r["seq"]] = (409, "Spot is not available")
        elif r.get("start_time") == "soon":
            out[r["seq"]] = (500, "Internal server error")
        else:
            spot["is_available"] = False
            out[r["seq"]] = (201, None)
    return out


@pytest.mark.parametrize("trial", range(3))
def test_admission_equals_one_by_one(frames, trial):
    rnd = random.Random(trial)
    spots = [{"spot_id": f"S{i}", "lot_id": f"L{i % 2}", "is_available": rnd.random() < 0.8} for i in range(12)]
    requests = [
        {"seq": seq, "spot_id": rnd.choice([None, "", "S99", "S0"] + [f"S{i}" for i in range(12)]),
         "lot_id": rnd.choice([None, "L0", "L1", "L0", "L1"]), "vehicle_plate": rnd.choice(["p", "p", "p", ""]),
         "start_time": rnd.choice([None, "", "soon", "2024-02-03", "2024-02-03T04:05:06Z"])}
        for seq in range(300)
    ]
    decided = admission.decide_reservations(frames("reservation_requests", *requests), frames("spots", *spots), NOW)
    got = {r.seq: (r.status, r.message) for r in decided.collect()}
    assert got == reference_admission(requests, spots)
    assert decided.count() == 300


def test_reservation_fanout(frames, seed):
    requests = frames(
        "reservation_requests",
        {"seq": 1, "lot_id": "L1", "spot_id": "A1", "vehicle_plate": "P1", "start_time": "2024-01-02T03:04:05Z"},
        {"seq": 2, "lot_id": "L1", "spot_id": "A1", "vehicle_plate": "P2"},
        {"seq": 3, "lot_id": "L2", "spot_id": "B1", "vehicle_plate": "P3", "user_id": "u"},
    )
    out = fanout.ingest_reservations(requests, seed["spots"], NOW, keep=tables.cut_lineage)
    held = {r.spot_id: r for r in out["reservations"].collect()}
    assert set(held) == {"A1", "B1"}
    assert (held["A1"].user_id, held["A1"].start_time, held["A1"].status) == ("demo-user", T(2024, 1, 2, 3, 4, 5), "reserved")
    assert (held["B1"].user_id, held["B1"].start_time) == ("u", NOW)
    events = {r.reservation_id: r for r in out["reservation_events"].collect()}
    assert set(events) == {r.reservation_id for r in held.values()}
    assert {(e.status, e.note, e.recorded_at) for e in events.values()} == {("reserved", "Created via API", NOW)}
    assert rows(out["usage_events"], "lot_id", "spot_id", "event_type", "recorded_at", "delta_available") == sorted(
        [("L1", "A1", "reservation_start", T(2024, 1, 2, 3, 4, 5), -1), ("L2", "B1", "reservation_start", NOW, -1)], key=str)
    assert rows(out["metric_deltas"], "lot_id", "day", "reservations_count") == [
        ("L1", D(2024, 1, 2), 1), ("L2", D(2024, 5, 10), 1)]
    assert rows(out["spots"], "spot_id", "is_available") == [("A1", False), ("A2", False), ("B1", False), ("B2", True)]
    assert rows(out["rejected"], "seq", "status") == [(2, 409)]


def test_session_fanout(frames, seed):
    requests = frames(
        "session_requests",
        {"seq": 1, "station_id": "C2", "energy_kwh": 3.5, "cost": 700, "reservation_id": "never-checked"},
        {"seq": 2, "station_id": "C1"},
        {"seq": 3, "station_id": ""},
        {"seq": 4, "station_id": "C9"},
    )
    out = fanout.ingest_sessions(requests, seed["stations"], NOW)
    assert rows(out["charging_sessions"], "station_id", "status", "started_at", "ended_at", "energy_kwh", "cost") == sorted(
        [("C2", "active", NOW, None, 3.5, 700), ("C1", "active", NOW, None, None, None)], key=str)
    assert rows(out["usage_events"], "lot_id", "spot_id", "delta_available", "metadata") == sorted(
        [("L1", None, None, '{"stationId":"C1"}'), ("L2", None, None, '{"stationId":"C2"}')], key=str)
    assert rows(out["metric_deltas"], "lot_id", "charging_sessions_count", "energy_kwh", "revenue_cents") == [
        ("L1", 1, 0.0, 0), ("L2", 1, 3.5, 700)]
    assert rows(out["rejected"], "seq", "status", "message") == [
        (3, 400, "stationId is required"), (4, 404, "Charging station not found")]


@pytest.fixture(scope="module")
def slot_list(frames):
    return frames(
        "slots",
        {"slot_id": "A1", "type": "Parking", "status": "Available"},
        {"slot_id": "A2", "type": "Parking", "status": "Occupied"},
        {"slot_id": "C1", "type": "EV", "status": "Available"},
    )


def test_slot_filters_and_counts(slot_list, frames):
    assert slots.filter_slots(slot_list).count() == 3
    assert rows(slots.filter_slots(slot_list, "Parking", "Occupied"), "slot_id") == [("A2",)]
    assert rows(slots.ev_slots(slot_list), "slot_id") == [("C1",)]
    assert rows(slots.with_bookable(slot_list), "slot_id", "is_bookable") == [("A1", True), ("A2", False), ("C1", True)]
    held = frames("slot_reservations", {"reservation_id": "r1", "slot_id": "A2"})
    assert slots.slot_stats(slot_list, held).first().asDict() == {"total": 3, "available": 2, "occupied": 1, "reservations": 1}
    assert slots.system_analytics(slot_list, held.limit(0)).first().asDict() == {
        "total": 3, "available": 2, "occupied": 1, "ev": 1, "parking": 2, "reservations": 0}


def test_slot_updates(slot_list, frames):
    changed = slots.set_where(slot_list, F.col("slot_id") == "A1", "status", "Occupied")
    assert rows(changed, "slot_id", "status") == [("A1", "Occupied"), ("A2", "Occupied"), ("C1", "Available")]
    keys = slot_list.filter("type = 'Parking'").select("slot_id")
    freed = slots.set_where_key_in(slot_list, keys.union(keys), "slot_id", "status", "Available")
    assert rows(freed, "slot_id", "status") == [("A1", "Available"), ("A2", "Available"), ("C1", "Available")]
    assert rows(slots.remove(slot_list, keys.union(keys), "slot_id"), "slot_id") == [("C1",)]
    held = frames("slot_reservations", {"reservation_id": "r1", "created_at": 1}, {"reservation_id": "r2", "created_at": 2})
    assert [r.reservation_id for r in slots.newest_first(held, "created_at").collect()] == ["r2", "r1"]


def test_old_words(spark):
    old = spark.createDataFrame([("A1", "Parking Slot", "Available"), ("C2", "EV Charger", "In Use"), ("X", "EV", "Occupied")],
                                "slot_id string, type string, status string")
    assert rows(slots.in_present_words(old)) == [
        ("A1", "Parking", "Available"), ("C2", "EV", "Occupied"), ("X", "EV", "Occupied")]


def test_session_estimate(spark):
    got = slots.session_estimate(spark.createDataFrame([(1800,), (59,)], "seconds int"), "seconds").collect()
    assert (got[0].minutes, got[0].energy_kwh, got[0].energy_text, got[0].cost_text) == (30, 3.6, "3.60", "65")
    assert got[1].minutes == 0


def test_tables_round_trip(spark, seed, tmp_path):
    root = str(tmp_path / "store")
    tables.reload_tables({"spots": seed["spots"], "lots": seed["lots"]}, root, 1)
    tables.reload_tables({"spots": seed["spots"].limit(1), "lots": seed["lots"]}, root, 2)
    # Version 3 is not published, so it does not count.
    seed["spots"].limit(0).write.parquet(f"{root}/version=3/spots")
    assert tables.current_version(spark, root) == 2
    assert tables.read_current(spark, root, "spots").count() == 1
    path = str(tmp_path / "rows")
    tables.append(seed["spots"], path)
    tables.append(seed["spots"], path)
    assert spark.read.parquet(path).count() == 8


def test_flatten_children(spark):
    nested = spark.createDataFrame(
        [("L1", [("A1", True), ("A2", False)]), ("L2", [])], "lot_id string, spots array<struct<label: string, is_available: boolean>>"
    )
    assert rows(tables.flatten_children(nested, "lot_id", "spots", "lot_id")) == [("L1", "A1", True), ("L1", "A2", False)]


class Named:
    """A session with ``spark.checkpoint.dir`` set, which a running one does not let us change."""

    def __init__(self, folder, master="spark://host:1"):
        self.sparkContext = self
        self.conf = {"spark.sql.warehouse.dir": "hdfs:///warehouse"} | ({"spark.checkpoint.dir": folder} if folder else {})
        self.master = master

    def getCheckpointDir(self):
        return None


def test_checkpoint_folder_is_the_named_one(spark):
    assert tables.checkpoint_dir(Named("hdfs:///shared")) == "hdfs:///shared"
    assert tables.checkpoint_dir(Named(None)) == "hdfs:///warehouse/_intermediate"
    assert tables.cut_lineage(spark.range(3)).count() == 3


def test_new_rows_take_defaults(spark):
    given = spark.createDataFrame([("T1", 2000, None), ("T2", 10, "USD")], "transaction_id string, amount_cents int, currency string")
    got = tables.new_rows(given, "transactions")
    assert rows(got, "transaction_id", "amount_cents", "currency", "status", "reservation_id") == [
        ("T1", 2000, "INR", "pending", None), ("T2", 10, "USD", "pending", None)]
    spot = tables.new_rows(spark.createDataFrame([("A1", "L1")], "spot_id string, lot_id string"), "spots")
    assert rows(spot) == [("A1", "L1", None, True, False)]


def test_history_by_days_reads_from_cutoffs(spark):
    base = T(2024, 1, 1)
    events = spark.range(5000).select(
        F.col("id").cast("string").alias("event_id"),
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "cold").otherwise("sparse").alias("lot_id"),
        F.when(F.col("id") == 4999, F.lit(None)).otherwise(S.as_timestamp(base) + F.make_dt_interval(days=F.col("id") % 40, secs=F.col("id") % 700)).alias("recorded_at"),
    )
    for k in (1, 50, 200, 2000):
        want = sorted((r.lot_id, r.rn, r.event_id) for r in lots.lot_history_all(events, k=k).collect())
        assert sorted((r.lot_id, r.rn, r.event_id) for r in lots.lot_history_by_days(events, k=k).collect()) == want
    cuts = {r.lot_id: r.cutoff for r in lots.history_cutoffs(events, 50).collect()}
    assert cuts["hot"] > base.date()
    assert lots.lot_history_by_days(events.limit(0), 5).count() == 0


def test_max_before_over_sparse_keys(spark):
    from kerbside.operators.prefix import max_before

    rnd = random.Random(1)
    picks = (lambda: rnd.randrange(-5, 300), lambda: rnd.randrange(0, 1 << 62), lambda: rnd.randrange(1 << 40, (1 << 40) + 70_000))
    data = [(rnd.choice(picks)(), rnd.choice([None, rnd.randrange(1000)])) for _ in range(3000)]
    got = {r["k"]: r["before"] for r in max_before(spark.createDataFrame(data, "k bigint, v bigint"), "k", "v").collect()}
    want = {}
    for k in {k for k, _ in data}:
        values = [v for kk, v in data if kk < k and v is not None]
        want[k] = max(values) if values else None
    assert got == want


def test_hot_reservation_day_and_null_times_are_ranked_whole(spark, family):
    reservations, _, sessions = family
    events = spark.range(12_000).select(
        F.format_string("E%05d", "id").alias("event_id"),
        F.when(F.col("id") < 11_000, "R1").otherwise("R2").alias("reservation_id"),
        F.lit("reserved").alias("status"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(S.as_timestamp(NOW) + F.make_dt_interval(secs=F.col("id") % 500)).alias("recorded_at"),
    )
    got = detail.reservation_detail(reservations, events, sessions, page=1000).collect()
    by = {}
    for r in got:
        by.setdefault(r.reservation_id, []).append(r)
    rows_ = events.collect()
    for rid in ("R1", "R2"):
        mine = [r for r in rows_ if r.reservation_id == rid]
        timed = sorted((r for r in mine if r.recorded_at is not None), key=lambda r: (r.recorded_at, r.event_id), reverse=True)
        untimed = sorted((r for r in mine if r.recorded_at is None), key=lambda r: r.event_id, reverse=True)
        want = [r.event_id for r in timed + untimed]
        pages = sorted(by[rid], key=lambda r: r.part)
        assert [e.event_id for p in pages for e in p.events] == want
        assert all(len(p.events) <= 1000 for p in pages)
    assert by["R3"][0].events == [] and by["R3"][0].part == 0


def test_children_move_once_in_reservation_detail(spark, family):
    """One shuffle for the children of both kinds and one for their reservations, none for ranks, pages or the join."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = detail.reservation_detail(*family)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "rangepartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_large_reservations_are_paged_as_small_ones(spark, family):
    """Both ways of ranking, by key and by ranges, give the same pages; null keys, repeated and childless reservations included."""
    reservations, _, sessions = family
    reservations = reservations.unionByName(reservations.filter("reservation_id = 'R1'")).unionByName(
        reservations.limit(1).withColumn("reservation_id", F.lit(None).cast("string"))
    )
    at = F.when(F.col("id") % 7 > 0, S.as_timestamp(NOW) + F.make_dt_interval(secs=F.col("id") % 50))
    key = F.when(F.col("id") < 700, "R1").when(F.col("id") < 760, "R2").when(F.col("id") < 780, "R-unknown")
    events = spark.range(800).select(
        F.format_string("E%05d", "id").alias("event_id"), key.alias("reservation_id"), F.lit("reserved").alias("status"), at.alias("recorded_at")
    )
    found = [
        sorted(detail.reservation_detail(reservations, events, sessions, page=50, hot=hot).collect(), key=str) for hot in (1, 100, 100_000)
    ]
    assert found[0] == found[1] == found[2]
    parts = [(r.reservation_id, r.part) for r in found[0]]
    assert sorted(parts, key=str) == sorted([("R1", k) for k in range(14) for _ in (1, 2)] + [("R2", 0), ("R2", 1), ("R3", 0), (None, 0)], key=str)
