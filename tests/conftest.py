"""One local session for all tests."""

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def make_session() -> SparkSession:
    from runsight.session import prepare

    return prepare(
        SparkSession.builder.master("local[8]")
        .appName("runsight-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
