"""A session for the tests of this folder, whatever other tests run."""

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
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


SCHEMA = "doc_id long, text string, source string"


@pytest.fixture
def docs(spark):
    """Makes a table of documents from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, schema=SCHEMA):
        return spark.createDataFrame([tuple(r) + ("s",) * (3 - len(r)) for r in rows] if schema == SCHEMA else rows, schema)

    return make
