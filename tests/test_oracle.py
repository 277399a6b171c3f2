"""Every registered query against its SQL twin."""

import pytest

import check
from assayer.plans.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
COMPOSED = {"L6_shortcut_control"}  # exercised by their own tests


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in COMPOSED])
def test_query_matches_sql(spark, con, name):
    status, rows, _, note = check.compare(spark, con, name, SF_DIR)
    spark.catalog.clearCache()
    assert status in ("ok", "rows-only"), note
    assert rows > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
