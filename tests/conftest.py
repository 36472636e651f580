import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelfold.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=8, memory="12g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def daily(spark):
    """Panel from a dict: series -> values on consecutive days."""
    def build(series, start=datetime.date(2024, 1, 1)):
        rows = [(uid, start + datetime.timedelta(days=i), None if v is None else float(v))
                for uid, values in series.items() for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "unique_id string, ds date, y double")
    return build
