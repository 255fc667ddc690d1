"""Table scans, appends and whole-set reloads over Parquet."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside import schemas
from kerbside.functions.constants import COLUMN_DEFAULTS

PUBLISHED = "_published"
PUBLISHED_SCHEMA = "version bigint"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan one table with its declared schema; nothing is inferred."""
    return spark.read.schema(schemas.ALL[name]).parquet(f"{directory}/{name}.parquet")


def read_rows(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.schema(schema).parquet(*paths)


def new_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows in the shape of a domain table: columns not given take their default, or null."""
    defaults = COLUMN_DEFAULTS.get(name, {})

    def column(field: str):
        column_name, kind = field.split()
        given = F.col(column_name) if column_name in df.columns else F.lit(None)
        filled = F.coalesce(given, F.lit(defaults[column_name])) if column_name in defaults else given
        return filled.cast(kind).alias(column_name)

    return df.select(*[column(field) for field in schemas.DOMAIN[name].split(",")])


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table."""
    df.write.mode("append").parquet(path)


def reload_tables(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Replace a whole set of tables at once.

    Each table goes to its own directory of the new version, so readers of the
    current version are not disturbed. The version counts only once its one-row
    note is written, after every table; a failed reload changes nothing and can
    be run again.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/version={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    note = spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
    append(note.coalesce(1), f"{root}/{PUBLISHED}")


def current_version(spark: SparkSession, root: str) -> int:
    notes = read_rows(spark, f"{root}/{PUBLISHED}", PUBLISHED_SCHEMA)
    return notes.agg(F.max("version")).first()[0]


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = current_version(spark, root)
    return read_rows(spark, f"{root}/version={version}/{name}", schemas.DOMAIN[name])


def flatten_children(df: DataFrame, pk: str, child_col: str, fk: str) -> DataFrame:
    """Child rows of a nested create, each carrying its parent's key."""
    return df.select(F.col(pk).alias(fk), F.explode(child_col).alias("child")).select(fk, "child.*")


def append_rows(*frames: DataFrame) -> DataFrame:
    """Bag union by name."""
    return reduce(lambda left, right: left.unionByName(right), frames)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where unset, a folder in the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"


def drop_written(df: DataFrame) -> None:
    """Removes the table that ``cut_lineage`` wrote for ``df``, once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a table in the shared checkpoint folder and go on from there.

    A lost executor costs a re-read, not a re-run, and later steps read only the
    columns they need, with known sizes.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/kerbside-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return read_rows(df.sparkSession, path, df.schema)
