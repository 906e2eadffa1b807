"""One local session for all tests, and planted clusters."""

import numpy as np
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def table(spark):
    """(id, x) rows of a matrix."""
    return lambda x, start=0: spark.createDataFrame([(start + i, [float(e) for e in row]) for i, row in enumerate(x)], "id long, x array<double>")


@pytest.fixture(scope="session")
def planted():
    """120 unit rows around 4 directions in 12 dimensions, and their clusters."""
    rng = np.random.default_rng(3)
    truth = np.repeat(np.arange(4), 30)
    x = np.eye(12)[truth] + 0.12 * rng.normal(size=(120, 12))
    return x / np.linalg.norm(x, axis=1, keepdims=True), truth
