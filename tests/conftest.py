import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def make_session():
    from litlake.session import build_session

    return build_session(
        "litlake-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"),
            "spark.log.level": "ERROR",
            "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="spark-"),
        },
    )


@pytest.fixture(scope="session")
def spark():
    from litlake.session import release_scratch

    session = make_session()
    yield session
    release_scratch(session)
    session.stop()
