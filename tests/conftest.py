import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from checks.run import session
    from titleflow.session import configure

    spark = session(4)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield configure(spark)
    spark.stop()


@pytest.fixture
def column(spark):
    """``column(function, type, values)``: what a column function makes of the values."""

    def run(function, ddl, values):
        from pyspark.sql import functions as F

        rows = list(enumerate(values))
        frame = spark.createDataFrame(rows, f"n int, v {ddl}").select("n", function(F.col("v")).alias("r"))
        return [row.r for row in sorted(frame.collect())]

    return run


@pytest.fixture
def store(spark):
    from titleflow.session import work_path
    from titleflow.sinks.store import TableStore

    return TableStore(spark, work_path(spark, "store"), buckets=2)
