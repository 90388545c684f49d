"""Every registered query equals its check SQL on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry
from tools.check import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")

@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


# the queries of the optional subpackage have tests of their own
NAMES = [name for name in entry.queries() if not re.match(r"op\d+_|pipeline$", name)]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    status, _ = compare(spark, con, name, FOLDER)
    assert status.startswith(("ok", "rows-only")), status


def test_entry(spark):
    result = entry.entry(spark)
    assert "h7_log_units_sold" in result.columns
    assert result.count() > 0


def test_snapshot_bounds_reach_the_scan(spark):
    from restock.sources.star_schema import StarSchema

    lines = StarSchema(spark, FOLDER)._lines("1995-01-01", "2000-08-15", ahead=7)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
