import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + ":" + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from (open, high, low, close, volume) rows a day, or ``minutes``, apart."""
    from candlewick.sources.bars import SCHEMA

    def make(rows, symbol="T", start=dt.datetime(2024, 1, 1), minutes=24 * 60):
        data = [(symbol, start + dt.timedelta(minutes=minutes * i), *[None if v is None else float(v) for v in row]) for i, row in enumerate(rows)]
        return spark.createDataFrame(data, SCHEMA)

    return make
