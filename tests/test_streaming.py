from __future__ import annotations

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import admission, fanout, metrics
from kerbside.streaming import ingest_stream as I

T = dt.datetime
FILES = 4


def request_rows(rnd, n):
    rows = []
    for seq in range(n):
        at = T(2024, 1, 30) + dt.timedelta(hours=seq)
        row = {"seq": seq, "received_at": at.isoformat()}
        if rnd.random() < 0.7:
            row |= {"kind": "reservation", "lot_id": rnd.choice(["L1", "L2"]), "spot_id": f"S{rnd.randrange(60)}",
                    "vehicle_plate": rnd.choice(["p", "p", ""]),
                    "start_time": rnd.choice(["2024-02-03", "2023-12-31T23:59:59Z", "2031-01-01", "", "soon"])}
        else:
            row |= {"kind": "session", "station_id": rnd.choice(["C1", "C2", "C9", ""]), "energy_kwh": float(seq % 5),
                    "cost": seq}
        rows.append(row)
    return rows


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    folder = tmp_path_factory.mktemp("requests")
    rows = request_rows(random.Random(1), 200)
    for i in range(FILES):
        part = rows[i * 50 : (i + 1) * 50]
        (folder / f"part-{i}.json").write_text("\n".join(json.dumps(r) for r in part))
        os.utime(folder / f"part-{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


@pytest.fixture(scope="module")
def spots(frames):
    return frames("spots", *[
        {"spot_id": f"S{i}", "lot_id": f"L{1 + i % 2}", "is_available": i % 5 != 0, "label": f"S{i}"} for i in range(60)])


def table(df):
    return sorted(tuple(r) for r in df.collect())


def in_one_batch(spark, source, spots, stations):
    """All requests at once, without the stream."""
    from kerbside import schemas

    requests = spark.read.schema(schemas.REQUESTS["stream_requests"]).json(source)
    now = F.col("received_at")
    asked = requests.filter("kind = 'reservation'").drop("station_id", "reservation_id", "energy_kwh", "cost", "kind")
    plugged = requests.filter("kind = 'session'").drop("lot_id", "spot_id", "vehicle_plate", "start_time", "kind")
    won = admission.accepted(admission.decide_reservations(asked, spots, now))
    started = admission.accepted(admission.decide_sessions(plugged, stations))
    a, b = fanout.reservation_tables(won, now), fanout.session_tables(started, now)
    return a, b, metrics.merge_metrics(a["metric_deltas"], b["metric_deltas"])


def run(spark, source, out, checkpoint, spots, stations):
    query = I.start_metrics_stream(spark, source, out, checkpoint, spots, stations, files_per_batch=1)
    assert query.awaitTermination(300)
    assert query.exception() is None


def test_stream_equals_one_batch(spark, source, spots, seed, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    stations = seed["stations"]
    run(spark, source, out, checkpoint, spots, stations)
    assert I.last_batch(spark, out) == FILES - 1
    a, b, want = in_one_batch(spark, source, spots, stations)
    columns = want.columns
    assert table(I.current_metrics(spark, out).select(columns).drop("avg_occupancy_percent")) == table(
        want.drop("avg_occupancy_percent"))
    ids = I.published(spark, out, "reservations").select("reservation_id")
    assert table(ids) == table(a["reservations"].select("reservation_id"))
    sessions = I.published(spark, out, "charging_sessions").select("session_id")
    assert table(sessions) == table(b["charging_sessions"].select("session_id"))
    assert I.published(spark, out, "usage_events").count() == ids.count() + sessions.count()
    assert I.published(spark, out, "rejected").count() == 200 - ids.count() - sessions.count()


def test_batches_run_again(spark, source, spots, seed, tmp_path):
    """A batch that broke off before its manifest, and one run again after it, change nothing."""
    out, stations = str(tmp_path / "out"), seed["stations"]

    def requests(i):
        return spark.read.schema(I.schemas.REQUESTS["stream_requests"]).json(f"{source}/part-{i}.json")

    I.process_batch(requests(0), 0, out, spots, stations)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(I, "_publish_metrics", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            I.process_batch(requests(1), 1, out, spots, stations)
    assert I.last_batch(spark, out) == 0
    I.process_batch(requests(1), 1, out, spots, stations)
    held = I.current_metrics(spark, out)
    before = table(held.drop("avg_occupancy_percent"))
    taken = table(I.published(spark, out, "reservations").select("reservation_id"))
    I.process_batch(requests(1), 1, out, spots, stations)
    assert table(I.current_metrics(spark, out).drop("avg_occupancy_percent")) == before
    assert table(I.published(spark, out, "reservations").select("reservation_id")) == taken
    assert sum(r.reservations_count for r in held.collect()) == len(taken)


def test_batches_without_results_count(spark, spots, seed, tmp_path):
    """A first batch in which all is turned away, and an empty one, are published and not run again."""
    out = str(tmp_path / "out")
    schema = I.schemas.REQUESTS["stream_requests"]
    names = [f.split()[0] for f in schema.split(",")]
    row = {"kind": "reservation", "seq": 1, "lot_id": "nowhere", "spot_id": "none", "vehicle_plate": "P", "start_time": "2024-01-01"}
    bad = spark.createDataFrame([tuple(row.get(n) for n in names)], schema)
    bad = bad.withColumn("received_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    I.process_batch(bad, 0, out, spots, seed["stations"])
    assert I.last_batch(spark, out) == 0 and I.current_metrics(spark, out).count() == 0
    assert [r.status for r in I.published(spark, out, "rejected").collect()] == [400]
    I.process_batch(bad.limit(0), 1, out, spots, seed["stations"])
    assert I.last_batch(spark, out) == 1 and I.published(spark, out, "rejected").count() == 1
    I.process_batch(bad, 0, out, spots, seed["stations"])
    assert I.published(spark, out, "rejected").count() == 1


def test_taken_spots_over_snapshots(spark, source, spots, seed, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "SNAPSHOT_EVERY", 2)
    out = str(tmp_path / "out")
    run(spark, source, out, str(tmp_path / "checkpoint"), spots, seed["stations"])
    a, _, _ = in_one_batch(spark, source, spots, seed["stations"])
    want = table(a["reservations"].select("spot_id"))
    for batch in (FILES, FILES - 1):
        held = I.taken_spots(spark, out, batch)
        assert held.count() == held.select("spot_id").distinct().count()
    assert table(I.taken_spots(spark, out, FILES).select("spot_id")) == want


def test_metrics_of_streamed_facts(spark, source, spots, seed, tmp_path):
    stations = seed["stations"]
    a, b, want = in_one_batch(spark, source, spots, stations)
    reservations, sessions = str(tmp_path / "r"), str(tmp_path / "s")
    a["reservations"].repartition(3).write.parquet(reservations)
    b["charging_sessions"].repartition(3).write.parquet(sessions)

    def facts(path, df):
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    # A watermark longer than the facts are apart drops none of them.
    for name, watermark in (("daily_of_facts", None), ("daily_of_facts_bounded", "4000 days")):
        daily = I.daily_metrics_stream(
            facts(reservations, a["reservations"]), facts(sessions, b["charging_sessions"]), stations, watermark
        )
        query = (
            daily.writeStream.outputMode("complete").format("memory").queryName(name)
            .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        )
        assert query.awaitTermination(300) and query.exception() is None
        got = spark.table(name)
        assert table(got) == table(want.select(got.columns))
