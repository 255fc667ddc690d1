"""Slot replay as a stream: the outcome of each command as batches of the log arrive.

Each slot's state (status, the reservations listed on it, the last reset it has seen) is
kept between batches as rows per slot, written per batch under ``out``. A batch's commands
are grouped by slot and folded in ``seq`` order against that state; a cancel goes to the
slot of the reservation it names, found in an index of all reserves so far. A reset
reaches every slot, also those without a command in the batch, as an epoch: each command
carries the last reset before it, and a slot whose state is older starts again from
available with nothing listed. A batch is published by a marker written last, so a batch
that Spark runs again after a break replaces its own partial rows and nothing counts twice.

Batches must follow the log: seq is the arrival number, so no command of a later batch has
a smaller seq than one of an earlier batch. A slot's commands of one batch are folded in
one task, in order, as the rules require;
the batch size bounds them. The reservations listed on one slot are held in its state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbside import schemas
from kerbside.functions import constants as K
from kerbside.functions import scalars as S
from kerbside.operators.prefix import max_before
from kerbside.sources.tables import read_rows

STATE = "slot_id string, status string, listed array<string>, epoch bigint, known boolean"
INDEX = "reservation_id string, slot_id string"
RESETS = "reset_seq bigint"
OUTCOMES = (
    "seq bigint, command string, slot_id string, date string, time string, reservation_id string, "
    "ok boolean, message string, status_before string, status_after string"
)
FOLDED = OUTCOMES + ", state_status string, state_listed array<string>, state_epoch bigint, state_known boolean"
#: Commands in one chunk when the last reset before each command is found.
WIDTH = 1 << 16
NEVER = -(1 << 62)


def _folder(out: str, table: str, batch: int) -> str:
    return f"{out}/{table}/batch_id={batch}"


def _published(spark: SparkSession, out: str) -> list[int]:
    try:
        marks = read_rows(spark, f"{out}/published", "batch bigint").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r["batch"] for r in marks)


def _read(spark: SparkSession, out: str, table: str, batches: list[int], schema: str) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], schema)
    return read_rows(spark, [_folder(out, table, b) for b in batches], schema)


def _states(spark: SparkSession, out: str, batches: list[int]) -> DataFrame:
    """The latest state row of each slot over the published batches."""
    rows = _read(spark, out, "state", batches, STATE + ", batch bigint")
    latest = F.max_by(F.struct("status", "listed", "epoch", "known"), F.col("batch"))
    return rows.groupBy("slot_id").agg(latest.alias("s")).select("slot_id", "s.*")


def _last_reset(spark: SparkSession, out: str, batches: list[int]) -> int:
    value = _read(spark, out, "resets", batches, RESETS).agg(F.max("reset_seq")).first()[0]
    return NEVER if value is None else int(value)


def _resets_before(commands: DataFrame, since: int) -> DataFrame:
    """Each command with ``reset_before``: the greatest reset seq below its own (``since`` from earlier batches)."""
    is_reset = F.col("command") == "reset"
    chunked = commands.withColumn("chunk", F.floor(F.col("seq") / WIDTH))
    chunks = chunked.groupBy("chunk").agg(F.max(F.when(is_reset, F.col("seq"))).alias("last"))
    earlier = max_before(chunks, "chunk", "last").select("chunk", F.col("before").alias("earlier"))
    within = F.max(F.when(is_reset, F.col("seq"))).over(Window.partitionBy("chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return chunked.withColumn("within", within).join(earlier, "chunk").select(
        *commands.columns, F.greatest(F.lit(since), F.col("earlier"), F.col("within")).alias("reset_before")
    )


def _fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One slot's commands in seq order against its state; each row gets its outcome, the last also the new state."""
    rows = rows.sort_values("seq", kind="stable")
    first = rows.iloc[0]
    known = bool(first["init_known"]) if first["init_known"] is not None else False
    status = first["init_status"] if known else None
    listed = list(first["init_listed"]) if first["init_listed"] is not None else []
    epoch = int(first["init_epoch"]) if pd.notna(first["init_epoch"]) else NEVER
    out = []
    for row in rows.itertuples(index=False):
        if row.reset_before > epoch:
            epoch = int(row.reset_before)
            listed = []
            status = K.AVAILABLE if known else None
        before, ok, message = status, True, None
        if row.command == "reserve":
            if not known:
                message = K.SLOT_NOT_FOUND
            elif status == K.OCCUPIED:
                message = K.SLOT_OCCUPIED
            elif not row.date or not row.time:
                message = K.SLOT_FIELDS_BLANK
            else:
                status = K.OCCUPIED
                listed.append(row.reservation_id)
            ok = message is None
        elif row.command == "release":
            ok = known
            if ok:
                status = K.AVAILABLE
        else:  # cancel
            ok = row.reservation_id in listed
            if ok:
                listed.remove(row.reservation_id)
                status = K.AVAILABLE
        out.append((row.seq, row.command, row.slot_id, row.date, row.time, row.reservation_id, ok, message, before, status))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOMES.split(", ")])
    last = len(frame) - 1
    frame["state_status"] = [status if i == last else None for i in range(len(frame))]
    frame["state_listed"] = [listed if i == last else None for i in range(len(frame))]
    frame["state_epoch"] = [epoch if i == last else None for i in range(len(frame))]
    frame["state_known"] = [known if i == last else None for i in range(len(frame))]
    frame["slot_id"] = key[0]
    return frame


def process_batch(commands: DataFrame, batch: int, out: str, slots: DataFrame) -> None:
    """Outcomes of one batch of the log, and the state it leaves; a published batch is not run again."""
    spark = commands.sparkSession
    done = _published(spark, out)
    if batch in done:
        return
    done = [b for b in done if b < batch]
    log = commands.select(*[c.split()[0] for c in schemas.REQUESTS["slot_commands"].split(", ")])
    log = _resets_before(log, _last_reset(spark, out, done))
    is_cancel = F.col("command") == "cancel"
    made = log.filter(F.col("command") == "reserve").select("reservation_id", "slot_id")
    index = _read(spark, out, "index", done, INDEX).unionByName(made).dropDuplicates(["reservation_id"])
    cancels = log.filter(is_cancel).drop("slot_id").join(index, "reservation_id", "left")
    routed = log.filter(~is_cancel & (F.col("command") != "reset")).unionByName(cancels)
    state = _states(spark, out, done).select(
        "slot_id", F.col("status").alias("init_status"), F.col("listed").alias("init_listed"),
        F.col("epoch").alias("init_epoch"), F.col("known").alias("init_known"),
    )
    given = slots.select("slot_id", F.col("status").alias("given_status"))
    start = routed.join(state, "slot_id", "left").join(given, "slot_id", "left").select(
        *log.columns,
        F.coalesce("init_status", "given_status").alias("init_status"),
        F.coalesce("init_listed", F.array().cast("array<string>")).alias("init_listed"),
        "init_epoch",
        F.coalesce("init_known", F.col("given_status").isNotNull()).alias("init_known"),
    )
    # a cancel of an unknown reservation has no slot: it fails alone
    lost = start.filter(F.col("slot_id").isNull()).select(
        *[F.col(c) for c in ("seq", "command", "slot_id", "date", "time", "reservation_id")],
        F.lit(False).alias("ok"), F.lit(None).cast("string").alias("message"),
        F.lit(None).cast("string").alias("status_before"), F.lit(None).cast("string").alias("status_after"),
    )
    folded = start.filter(F.col("slot_id").isNotNull()).groupBy("slot_id").applyInPandas(_fold, FOLDED)
    folded.write.mode("overwrite").parquet(_folder(out, "folded", batch))
    folded = read_rows(spark, _folder(out, "folded", batch), FOLDED)
    resets = log.filter(F.col("command") == "reset").select(
        "seq", "command", F.lit(None).cast("string").alias("slot_id"), "date", "time", "reservation_id",
        F.lit(True).alias("ok"), F.lit(None).cast("string").alias("message"),
        F.lit(None).cast("string").alias("status_before"), F.lit(None).cast("string").alias("status_after"),
    )
    outcomes = folded.select(*[c.split()[0] for c in OUTCOMES.split(", ")]).unionByName(lost).unionByName(resets)
    outcomes.write.mode("overwrite").parquet(_folder(out, "outcomes", batch))
    folded.filter(F.col("state_epoch").isNotNull()).select(
        "slot_id", F.col("state_status").alias("status"), F.col("state_listed").alias("listed"),
        F.col("state_epoch").alias("epoch"), F.col("state_known").alias("known"), F.lit(batch).cast("bigint").alias("batch"),
    ).write.mode("overwrite").parquet(_folder(out, "state", batch))
    made.write.mode("overwrite").parquet(_folder(out, "index", batch))
    log.filter(F.col("command") == "reset").agg(F.max("seq").alias("reset_seq")).write.mode("overwrite").parquet(_folder(out, "resets", batch))
    spark.createDataFrame([(batch,)], "batch bigint").write.mode("append").parquet(f"{out}/published")


def outcomes(spark: SparkSession, out: str) -> DataFrame:
    """Outcomes of all published batches."""
    return _read(spark, out, "outcomes", _published(spark, out), OUTCOMES)


def slots_now(spark: SparkSession, out: str, slots: DataFrame) -> DataFrame:
    """The slots as the published batches leave them; a later reset frees slots it has not met."""
    done = _published(spark, out)
    last = _last_reset(spark, out, done)
    state = _states(spark, out, done)
    status = (
        F.when(F.col("epoch").isNotNull() & (F.lit(last) > F.col("epoch")), K.AVAILABLE)
        .when(F.col("epoch").isNotNull(), F.col("state_status"))
        .when(F.lit(last) > NEVER, K.AVAILABLE)
        .otherwise(F.col("status"))
    )
    joined = slots.join(state.withColumnRenamed("status", "state_status").select("slot_id", "state_status", "epoch"), "slot_id", "left")
    return joined.withColumn("status", status).select(*slots.columns)


def read_commands(spark: SparkSession, src: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.REQUESTS["slot_commands"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(src)


def start_replay_stream(
    spark: SparkSession, src: str, out: str, checkpoint: str, slots: DataFrame, files_per_batch: int | None = None, available_now: bool = True
) -> StreamingQuery:
    """Replays the command files arriving in ``src``; outcomes and state go to ``out``."""
    writer = (
        read_commands(spark, src, files_per_batch)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch: process_batch(df, batch, out, slots))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
