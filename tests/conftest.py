import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rolecall.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.sql.maxMetadataStringLength": "2000"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate an expression of one text column ``x``."""

    def evaluate(expression, value, kind="string"):
        from pyspark.sql import functions as F

        row = spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()
        return row.y

    return evaluate


@pytest.fixture
def each(spark):
    """Evaluate an expression for many values of one column in a single job."""

    def evaluate(expression, values, kind="string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
        return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]

    return evaluate


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
