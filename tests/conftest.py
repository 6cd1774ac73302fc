from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from stayrate.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(df, *order):
    """Rows as tuples, sorted by ``order`` columns (NULL last)."""
    columns = list(order) or df.columns
    position = [df.columns.index(c) for c in columns]
    rows = [tuple(r) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((r[i] is None, r[i]) for i in position))
