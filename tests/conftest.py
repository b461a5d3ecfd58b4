import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("riskloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture
def small_chunks(spark):
    """Force the paths for very large keys on small data."""
    spark.conf.set("spark.riskloom.chunkRows", "12")
    spark.conf.set("spark.riskloom.spanLinks", "300")
    yield
    spark.conf.unset("spark.riskloom.chunkRows")
    spark.conf.unset("spark.riskloom.spanLinks")
