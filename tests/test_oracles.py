"""Every registered query against its oracle, over the whole small data set."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import check  # noqa: E402
from fleetstats.catalog import ORACLES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.oracle_connection(SF)


@pytest.mark.parametrize("name", ORACLES)
def test_matches_oracle(spark, con, name):
    assert check.compare(spark, con, SF, name).startswith("ok")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
