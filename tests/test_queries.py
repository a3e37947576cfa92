"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from pointloom.bindings import ORACLES, QUERIES  # noqa: E402

FOLDER = entry.SMOKE_TABLES
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def database():
    import compare
    return compare.database(FOLDER)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["chart_id", "cell", "x_bin", "y_bin", "count", "value"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, database, name):
    import compare
    ok, text = compare.compare(spark, database, FOLDER, name)
    assert ok, text


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
