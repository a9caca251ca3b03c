import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pagemill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over one row of named strings."""

    def run(column, **values):
        if not values:
            return spark.range(1).select(column.alias("r")).first()["r"]
        schema = ", ".join(f"{k} {v[1] if isinstance(v, tuple) else 'string'}" for k, v in values.items())
        row = [tuple(v[0] if isinstance(v, tuple) else v for v in values.values())]
        return spark.createDataFrame(row, schema).select(column.alias("r")).first()["r"]

    return run
