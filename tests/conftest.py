import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="kinrank-test-")
    s = (
        SparkSession.builder.master("local[4]")
        .appName("kinrank-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.path.join(scratch, "ckpt"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


FIXTURE = [
    (1, 10, 5.0), (1, 20, 3.0), (1, 30, 4.0),
    (2, 10, 4.0), (2, 20, 2.0), (2, 30, 3.0),
    (3, 10, 1.0), (3, 20, 5.0), (3, 40, 3.0),
    (4, 30, 4.0), (4, 40, 4.0),
]


@pytest.fixture(scope="session")
def tiny(spark):
    return spark.createDataFrame(FIXTURE, "user_id bigint, item_id bigint, rating double")
