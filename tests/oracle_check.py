"""Runs each registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import duckdb

GIVEN = ["nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "benchmark", "pages"]


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is not None, str(v)) for v in row))


# Spark type name -> type names on the SQL side.
TYPES = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "date": {"DATE"},
    "timestamp_ntz": {"TIMESTAMP"},
}


def compare(spark, con, directory: str, query, sql: str) -> str:
    """Empty when equal, else what differs."""
    df = query(spark, directory)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    there = dict(zip(rel.columns, map(str, rel.types)))
    for name, kind in df.dtypes:
        if there[name] not in TYPES.get(kind, {kind}):
            return f"type of {name}: {kind} / {there[name]}"
    got = _sorted_rows(df.columns, df.collect())
    want = _sorted_rows(rel.columns, rel.fetchall())
    if got == want:
        return "" if got else "no rows"
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)} rows"
    at = next(i for i, (a, b) in enumerate(zip(got, want)) if a != b)
    return f"row {at}: {got[at]} / {want[at]}"


def main(directory: str, names: list[str]) -> int:
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from kerbside.session import build_session

    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    bad = 0
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in names or [q for q in queries if q in sqls]:
        begun = time.time()
        try:
            problem = compare(spark, con, directory, queries[name], sqls[name])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{name:34s} {time.time() - begun:6.2f}s {problem or 'ok'}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
