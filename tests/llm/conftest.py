from __future__ import annotations

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """A folder for written tables, only for the session of the tests."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def table_of(spark, tmp_path_factory):
    """Rows as a written table; extra columns clash with names that operators use inside."""

    def make(rows: list[tuple], names: str = "doc_id bigint, text string, n bigint, _text string, sid bigint, chunk string, rid int"):
        width = len(names.split(","))
        path = str(tmp_path_factory.mktemp("table"))
        full = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        spark.createDataFrame(full, names).coalesce(2).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return make


LONG = " ".join(f"word{i % 977}" for i in range(40_000))

#: Null id and text, empty and blank texts, a very long text, repeated rows, odd characters.
EDGE_ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, LONG), (6, "Ünï cödé — 中文 \U0001f600 x"),
    (7, "same text here twice now"), (7, "same text here twice now"), (8, "same text here twice now"),
    (None, "no id at all but a text"), (None, None), (9, "a\x00b \x1f c <|endoftext|> d"),
]


@pytest.fixture(scope="session")
def edge(table_of):
    return table_of(EDGE_ROWS)


@pytest.fixture(scope="session")
def empty(table_of):
    return table_of([])


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE_ROWS
