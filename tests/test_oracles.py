"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pagemill.plans import load_all  # noqa: E402
from tools.check import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
REGISTRY = load_all()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_matches_sql(spark, duck, name):
    status, _, _, _, detail = compare(spark, duck, REGISTRY[name], FOLDER)
    assert status == "ok", detail


def test_every_query_is_named_once_and_entry_runs(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
