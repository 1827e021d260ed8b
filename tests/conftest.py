import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from lexiloom.session import local_session

    s = local_session(4, partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Values of Column functions on single rows."""

    def run(f, *values, kinds=None):
        kinds = kinds or ["string"] * len(values)
        df = spark.createDataFrame([values], ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
        from pyspark.sql import functions as F

        return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]

    return run
