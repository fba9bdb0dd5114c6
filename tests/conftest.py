import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from stave.session import build_session

    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_blocks(spark):
    """Every key counts as hot, so ordered operators take the block path."""
    from stave.session import BLOCK_ROWS_CONF

    spark.conf.set(BLOCK_ROWS_CONF, "3")
    yield
    spark.conf.unset(BLOCK_ROWS_CONF)
