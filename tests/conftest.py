import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("ferrowatch-tests")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Build a frame from rows of Python values and a schema."""

    def build(rows, schema):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def rows_of():
    """The rows of a frame as a sorted list of tuples, NULL first."""

    def collect(df, *columns):
        names = columns or df.columns
        return sorted(
            (tuple(row) for row in df.select(*names).collect()),
            key=lambda row: [(value is not None, str(value)) for value in row],
        )

    return collect
