import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanlake.operators.skew import HEAVY_ROWS_CONF  # noqa: E402
from spanlake.session import build_session, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.sql.maxMetadataStringLength": "10000",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    shared_dir(session)
    yield session
    session.stop()


@pytest.fixture
def heavy(spark):
    """Every key with at least 10 rows counts as heavy."""
    spark.conf.set(HEAVY_ROWS_CONF, "10")
    yield
    spark.conf.unset(HEAVY_ROWS_CONF)
