"""Requests as a stream: admission, fact tables and daily metrics, batch by batch.

Everything a micro-batch writes goes to ``<table>/batch_id=N``, so a batch that broke
off and is run again overwrites only itself. Daily metrics are kept by month: batch N reads the
months it touches as of batch N-1, adds its deltas and writes them anew under its own
number. The manifest of batch N, written last, names the batch that holds each month,
and has one row without a month, so that a batch without metrics counts as well;
until it is there, readers see batch N-1. Start times may lie anywhere in the past or
future and count on their own day.

Output and checkpoint belong together: a new checkpoint needs a new output folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbside import schemas
from kerbside.functions import scalars as S
from kerbside.operators import fanout, metrics
from kerbside.operators.admission import accepted, decide_reservations, decide_sessions, rejected
from kerbside.operators.slots import set_where_key_in
from kerbside.sources.tables import append_rows, read_rows

# Taken spots are written whole every so many batches and as additions in between.
SNAPSHOT_EVERY = 50

MANIFEST = "month string, held_by bigint"


def _folder(out: str, table: str, batch: int) -> str:
    return f"{out}/{table}/batch_id={batch}"


def _store(df: DataFrame, out: str, table: str, batch: int) -> DataFrame:
    """Write the batch's rows of a table and go on from the written rows."""
    path = _folder(out, table, batch)
    df.write.mode("overwrite").parquet(path)
    return read_rows(df.sparkSession, path, df.schema)


def taken_spots(spark: SparkSession, out: str, batch: int) -> DataFrame:
    """Spots taken before ``batch``."""
    schema = "spot_id string, seq bigint"
    if batch == 0:
        return spark.createDataFrame([], schema)
    first = (batch - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    return read_rows(spark, [_folder(out, "spots_taken", i) for i in range(first, batch)], schema)


def _manifest(spark: SparkSession, out: str, batch: int) -> DataFrame:
    if batch < 0:
        return spark.createDataFrame([], MANIFEST)
    return read_rows(spark, _folder(out, "manifest", batch), MANIFEST).filter("month is not null")


def _is_published(spark: SparkSession, out: str, batch: int) -> bool:
    """Whether the batch has run to its end."""
    try:
        return not read_rows(spark, _folder(out, "manifest", batch), MANIFEST).isEmpty()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def _months(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """Metrics of the months of a manifest. Only month names, as many as the calendar has, reach the driver."""
    paths = [f"{_folder(out, 'metrics', r.held_by)}/month={r.month}" for r in manifest.collect()]
    if not paths:
        return spark.createDataFrame([], schemas.DOMAIN["lot_daily_metrics"])
    return read_rows(spark, paths, schemas.DOMAIN["lot_daily_metrics"])


def _publish_metrics(deltas: DataFrame, out: str, batch: int) -> None:
    spark = deltas.sparkSession
    month = F.date_format(F.col("day").cast("timestamp_ntz"), "yyyy-MM").alias("month")
    touched = deltas.select(month).distinct()
    before = _manifest(spark, out, batch - 1)
    held = _months(spark, out, before.join(touched, "month", "left_semi"))
    merged = metrics.merge_metrics(held, deltas)
    merged.select("*", month).write.mode("overwrite").partitionBy("month").parquet(_folder(out, "metrics", batch))
    held_by = F.lit(batch).cast("bigint").alias("held_by")
    now = append_rows(
        before.join(touched, "month", "left_anti"),
        touched.select("month", held_by),
        spark.range(1).select(F.lit(None).cast("string").alias("month"), held_by),
    )
    now.coalesce(1).write.mode("overwrite").parquet(_folder(out, "manifest", batch))


def process_batch(requests: DataFrame, batch: int, out: str, spots: DataFrame, stations: DataFrame) -> None:
    """Admit one batch of requests and write all it changes, unless that was done before."""
    spark = requests.sparkSession
    if _is_published(spark, out, batch):
        return
    # Both kinds of requests are read from the stored rows; the source is parsed once.
    requests = _store(requests, out, "requests", batch)
    now = F.col("received_at")

    taken = taken_spots(spark, out, batch)
    open_spots = set_where_key_in(spots, taken, "spot_id", "is_available", False)
    asked = requests.filter(F.col("kind") == "reservation").select(
        "seq", "received_at", "lot_id", "spot_id", "user_id", "vehicle_plate", "start_time", "start_ms"
    )
    reservation_decisions = _store(decide_reservations(asked, open_spots, now), out, "reservation_decisions", batch)
    won = accepted(reservation_decisions)

    plugged = requests.filter(F.col("kind") == "session").select(
        "seq", "received_at", "station_id", "reservation_id", "user_id", "energy_kwh", "cost"
    )
    session_decisions = _store(decide_sessions(plugged, stations), out, "session_decisions", batch)

    of_reservations = fanout.reservation_tables(won, now)
    of_sessions = fanout.session_tables(accepted(session_decisions), now)
    _store(of_reservations["reservations"], out, "reservations", batch)
    _store(of_reservations["reservation_events"], out, "reservation_events", batch)
    _store(of_sessions["charging_sessions"], out, "charging_sessions", batch)
    _store(append_rows(of_reservations["usage_events"], of_sessions["usage_events"]), out, "usage_events", batch)
    turned_away = [rejected(d).select("seq", "status", "message") for d in (reservation_decisions, session_decisions)]
    _store(append_rows(*turned_away), out, "rejected", batch)

    newly_taken = won.select("spot_id", "seq")
    if batch % SNAPSHOT_EVERY == 0:
        newly_taken = append_rows(taken, newly_taken)
    _store(newly_taken, out, "spots_taken", batch)

    deltas = append_rows(of_reservations["metric_deltas"], of_sessions["metric_deltas"])
    _publish_metrics(_store(deltas, out, "metric_deltas", batch), out, batch)


def last_batch(spark: SparkSession, out: str) -> int:
    """The last published batch."""
    found = spark.read.schema(MANIFEST + ", batch_id bigint").parquet(f"{out}/manifest")
    return found.agg(F.max("batch_id")).first()[0]


def current_metrics(spark: SparkSession, out: str) -> DataFrame:
    """Daily metrics as of the last published batch."""
    return _months(spark, out, _manifest(spark, out, last_batch(spark, out)))


def published(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A fact or event table up to the last published batch."""
    schema = schemas.DOMAIN.get(table, "seq bigint, status int, message string")
    rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{out}/{table}")
    return rows.filter(F.col("batch_id") <= last_batch(spark, out))


def read_requests(spark: SparkSession, src: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON request files as a stream; both kinds in one schema."""
    reader = spark.readStream.schema(schemas.REQUESTS["stream_requests"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(src)


def start_metrics_stream(
    spark: SparkSession,
    src: str,
    out: str,
    checkpoint: str,
    spots: DataFrame,
    stations: DataFrame,
    files_per_batch: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Ingest request files as they arrive, keeping the fact tables and daily metrics in ``out``."""
    writer = (
        read_requests(spark, src, files_per_batch)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch: process_batch(df, batch, out, spots, stations))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def daily_metrics_stream(
    reservations: DataFrame, sessions: DataFrame, stations: DataFrame, watermark: str | None = None, samples: DataFrame | None = None
) -> DataFrame:
    """Daily metrics over streams of accepted facts, for update or complete mode.

    Without a watermark every day stays open, as late and future facts must count. A
    ``watermark`` bounds the state and drops facts that come later than it allows.
    With a stream of occupancy ``samples``, each (lot, day) also carries the sample of the
    greatest arrival number so far (``avg_occupancy_percent``): the state keeps value and
    arrival, so a late sample with a smaller arrival never replaces a newer one.
    """
    parts = [metrics.reservation_deltas(reservations), metrics.session_deltas(metrics.with_station_lot(sessions, stations))]
    if samples is not None:
        parts.append(metrics.occupancy_deltas(samples))
    both = append_rows(*parts)
    day = F.col("w.start").cast("date")
    if watermark:
        # Watermarks need an instant.
        both = both.withColumn("at", S.as_instant(F.col("at"))).withWatermark("at", watermark)
        day = S.utc_day(S.as_utc(F.col("w.start")))
    last = [F.max_by("avg_occupancy_percent", "occupancy_seq").alias("avg_occupancy_percent")] if samples is not None else []
    out = ["avg_occupancy_percent"] if samples is not None else []
    return (
        both.groupBy("lot_id", F.window("at", "1 day").alias("w"))
        .agg(*[F.sum(c).alias(c) for c in metrics.COUNTS], *last)
        .select("lot_id", day.alias("day"), *metrics.COUNTS, *out)
    )
