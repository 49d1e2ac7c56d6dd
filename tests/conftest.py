import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tideboard.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="tideboard-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Values of a column function over Python inputs: value(fn, inputs, type)."""

    def run(fn, inputs, kind="string"):
        from pyspark.sql import functions as F

        rows = [(i, x) for i, x in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, x {kind}")
        return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
