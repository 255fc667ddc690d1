"""Fact logs stored by UTC day: one writer, and readers for batch and stream over the same folder.

Rows go to ``day=YYYY-MM-DD`` folders. Before writing they are range-partitioned by
(day, key, time), so a busy day is spread over several files instead of one task, and the
rows of a file are clustered by key and time, which keeps Parquet statistics narrow.
Readers see ``day`` as a column: a filter on it prunes whole folders, and a filter on
the time column skips row groups inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions import scalars as S

DAY = "day"


def day_of(time: Column) -> Column:
    """The UTC day of an instant without zone; null times go to the folder of null days."""
    return F.to_date(time)


def write_log(df: DataFrame, path: str, time: str, key: str) -> None:
    """Appends ``df`` to the log at ``path``, by the day of ``time``, clustered by ``key`` and ``time``.

    A ``day`` column of ``df`` is replaced. Appends add files; folders of days
    already written keep theirs.
    """
    rows = df.drop(DAY).withColumn(DAY, day_of(F.col(time)))
    order = [F.col(DAY).asc_nulls_first(), F.col(key).asc_nulls_first(), F.col(time).asc_nulls_first()]
    # a stated count, which adaptive execution keeps, so a busy day stays spread over tasks
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("append").partitionBy(DAY).parquet(path)


def log_schema(schema: str | T.StructType) -> T.StructType:
    """The rows' schema with the ``day`` partition column."""
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return T.StructType([f for f in struct.fields if f.name != DAY] + [T.StructField(DAY, T.DateType())])


def read_log(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The whole log as a table; filters on ``day`` prune folders."""
    return spark.read.schema(log_schema(schema)).option("basePath", path).parquet(path)


def read_log_since(spark: SparkSession, path: str, schema: str | T.StructType, days: int, as_of, time: str) -> DataFrame:
    """Rows from ``days`` days before ``as_of`` on: folders by day, row groups by ``time``."""
    first = S.since_day(days, as_of)
    return read_log(spark, path, schema).filter((F.col(DAY) >= first) & (F.col(time) >= first.cast("timestamp_ntz")))


def read_log_stream(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """The same folder as a stream of the files that appear in it, ``day`` included."""
    reader = spark.readStream.schema(log_schema(schema)).option("basePath", path)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
