import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from corpuscle.session import DEFAULTS

    builder = SparkSession.builder.master("local[4]").appName("tests")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("checkpoint")))
    session = builder.config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
