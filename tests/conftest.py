import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from check_queries import session

    return session(4)


@pytest.fixture(scope="session")
def rows(spark):
    """Builds a frame from tuples and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)
