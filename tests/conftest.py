import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vacantia.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Values of a column function over a list of inputs."""
    from pyspark.sql import functions as F

    def run(fn, values, schema="v string"):
        rows = [(n, *(v if isinstance(v, tuple) else (v,))) for n, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"n int, {schema}")
        args = [F.col(c) for c in df.columns[1:]]
        return [r[0] for r in df.orderBy("n").select(fn(*args)).collect()]

    return run
