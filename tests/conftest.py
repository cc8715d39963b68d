import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ebbflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "ebbflow-tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Build a long daily table from ``{key: [values]}`` starting on a date (None: missing value)."""
    import datetime as dt

    def build(values, start="2001-01-01"):
        first = dt.date.fromisoformat(start)
        rows = [(k, first + dt.timedelta(days=i), None if v is None else float(v))
                for k, vs in values.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "series_id string, time date, value double")

    return build
