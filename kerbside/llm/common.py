"""Helpers shared by the text operators: tables, Arrow columns, bounded slices, folds, cuts."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ID, TEXT = "doc_id", "text"

#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null keys are in fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(0))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def give_back() -> None:
    """Returns freed memory to the system; a Python worker that waits for its next task would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: its own policy holds


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with up to ``limit`` bytes of text, or one row; nothing is left out."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


def text_bytes(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows' UTF-8 bytes, one after the other, and the rows' offsets into them. Null is empty."""
    column = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8, int(offsets[-1]))[int(offsets[0]) :] if offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder named by ``spark.checkpoint.dir``, and read again from there.

    Every executor can read it, so a lost executor costs no second run of what is before.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df))


def write_shared(df: DataFrame) -> str:
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where unset, one in the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"
