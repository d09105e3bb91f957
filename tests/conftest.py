import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def hourly(spark):
    """Build rows (series_id, time, value) from (series, hour offset, value)."""
    def make(rows, column="us_aqi"):
        data = [(s, T0 + dt.timedelta(hours=h), None if v is None else float(v)) for s, h, v in rows]
        return spark.createDataFrame(data, f"series_id string, time timestamp_ntz, {column} double")
    return make
