import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from listings_spark.sources.session import ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Apply a column builder to plain values and return the results in order."""
    from pyspark.sql import functions as F

    def run(items, build, kind="string"):
        rows = [(i, x) for i, x in enumerate(items)]
        df = spark.createDataFrame(rows, f"i int, x {kind}")
        return [r[1] for r in df.select("i", build(F.col("x"))).orderBy("i").collect()]

    return run
