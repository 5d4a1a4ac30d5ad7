import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test data")
    return DATA


@pytest.fixture
def series(spark):
    from strandline.sources.tables import series_from

    return lambda values: series_from(spark, values)


@pytest.fixture
def column():
    """Values of a column in the order of another, NaN and null as None."""

    def read(df, name, order="i"):
        return [None if r[name] is None or r[name] != r[name] else r[name] for r in sorted(df.collect(), key=lambda r: r[order])]

    return read
