"""Streamed daily metrics with the last occupancy sample, in complete and in update mode."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.operators import metrics
from kerbside.sources import adapters as A
from kerbside.streaming import ingest_stream as I

DIRECTORY = "/root/testdata/sf0.001"


def table(df):
    return sorted(tuple(r) for r in df.collect())


def test_last_sample_wins_over_batches(spark, tmp_path):
    reservations, sessions = A.reservations(spark, DIRECTORY), A.charging_sessions(spark, DIRECTORY)
    stations, samples = A.stations(spark, DIRECTORY), A.occupancy_samples(spark, DIRECTORY)
    want = metrics.daily_metrics(reservations, sessions, stations, samples)
    paths = {n: str(tmp_path / n) for n in ("r", "s", "o")}
    reservations.repartition(3).write.parquet(paths["r"])
    sessions.repartition(3).write.parquet(paths["s"])
    # newer arrivals first: later files hold samples that arrived earlier
    for i, part in enumerate((F.col("seq") % 3 == 2, F.col("seq") % 3 == 1, F.col("seq") % 3 == 0)):
        samples.filter(part).coalesce(1).write.parquet(f"{paths['o']}/part-{i}")

    def stream(path, df, glob=""):
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path + glob)

    daily = I.daily_metrics_stream(stream(paths["r"], reservations), stream(paths["s"], sessions), stations, samples=stream(paths["o"], samples, "/*"))
    query = (
        daily.writeStream.outputMode("complete").format("memory").queryName("occupancy_complete")
        .option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(300) and query.exception() is None
    got = spark.table("occupancy_complete")
    assert table(got) == table(want.select(got.columns))

    upserted = {}

    def upsert(batch, _):
        for r in batch.collect():
            upserted[(r.lot_id, r.day)] = tuple(r)

    query = (
        daily.writeStream.outputMode("update").foreachBatch(upsert)
        .option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(300) and query.exception() is None
    assert sorted(upserted.values()) == table(want.select(got.columns))
