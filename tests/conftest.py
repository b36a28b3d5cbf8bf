import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from medlink.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "medlink-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column expression of literals."""

    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run
