from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from basketry.session import build_session  # noqa: E402

SAMPLES = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "basketry-tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample_dir():
    return str(SAMPLES / "sf0.001")


@pytest.fixture
def frame(spark):
    """Build a frame from a DDL schema and rows, spread over several partitions."""

    def build(schema: str, *rows, partitions: int = 3):
        return spark.createDataFrame(list(rows), schema).repartition(partitions)

    return build


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples (nulls last)."""

    def collect(df):
        got = [tuple(r) for r in df.collect()]
        return sorted(got, key=lambda r: [(v is None, str(v)) for v in r])

    return collect


@pytest.fixture
def one():
    """The only value of a one-row, one-column frame."""

    def collect(df):
        [[value]] = df.collect()
        return value

    return collect
