import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewright import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4, **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def people(spark):
    """Six rows with one exact duplicate, a missing name and a missing value."""
    rows = [
        (1, "Alice", "A", 10.0, True),
        (2, "Bob", "B", 20.0, False),
        (2, "Bob", "B", 20.0, False),
        (3, "Cara", "A", None, True),
        (4, None, "C", 40.0, False),
        (5, "Eve", "B", 50.0, True),
    ]
    return spark.createDataFrame(rows, "id long, name string, category string, value double, active boolean")
