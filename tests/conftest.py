import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from auditmill.session import build_session

    session = build_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column expression over (a, b, ...) rows; gives the list of results."""

    def run(rows, schema, make):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_n int, " + schema)
        out = df.select("_n", make(F.col).alias("out")).orderBy("_n").collect()
        return [r["out"] for r in out]

    return run
