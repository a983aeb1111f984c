"""Every registered query against its SQL counterpart on two sizes of test data."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points
from rackwise.plans.catalogue import QUERIES
from rackwise.plans.oracle import ORACLE_SQL as ORACLES

FOLDERS = [os.environ["TEST_SF_DIR"]] if "TEST_SF_DIR" in os.environ else ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


@pytest.fixture(scope="module")
def connections():
    return {folder: connect(folder) for folder in FOLDERS}


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, connections, name, folder):
    assert differences(QUERIES[name](spark, folder), connections[folder], ORACLES[name]) == []


def test_every_query_has_an_oracle_and_is_registered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["category", "qty", "revenue", "share_pct", "cumulative_pct", "abc_class"]
    assert df.count() > 0
