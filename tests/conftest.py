from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from kerbside.session import build_session

    session = build_session(
        "kerbside-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frames(spark):
    """Rows to a DataFrame of a declared table; columns not given are null."""
    from kerbside import schemas

    def make(table: str, *rows: dict):
        names = [part.split()[0] for part in schemas.ALL[table].split(",")]
        unknown = {k for row in rows for k in row} - set(names)
        assert not unknown, unknown
        return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schemas.ALL[table])

    return make


@pytest.fixture(scope="session")
def seed(frames):
    """A small car park: two lots with two spots and one charger each."""
    return {
        "lots": frames(
            "lots",
            {"lot_id": "L1", "name": "North", "total_spots": 60, "price_per_hour": 40, "has_ev_charging": True},
            {"lot_id": "L2", "name": "South", "total_spots": 80, "price_per_hour": 30, "has_ev_charging": True},
            {"lot_id": "L3", "name": "Empty", "total_spots": 10, "price_per_hour": 10, "has_ev_charging": False},
        ),
        "spots": frames(
            "spots",
            {"spot_id": "A1", "lot_id": "L1", "label": "A1", "is_available": True, "supports_ev": True},
            {"spot_id": "A2", "lot_id": "L1", "label": "A2", "is_available": False, "supports_ev": False},
            {"spot_id": "B1", "lot_id": "L2", "label": "B1", "is_available": True, "supports_ev": True},
            {"spot_id": "B2", "lot_id": "L2", "label": "B2", "is_available": True, "supports_ev": False},
        ),
        "stations": frames(
            "stations",
            {"station_id": "C1", "lot_id": "L1", "name": "One", "connector_type": "CCS2", "max_kw": 50, "is_available": True},
            {"station_id": "C2", "lot_id": "L2", "name": "Two", "connector_type": "Type2", "max_kw": 22, "is_available": False},
        ),
    }
