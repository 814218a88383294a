"""Every registered query at the smallest scale against its SQL twin."""

import os

import pytest

import __spark_entry__ as entry
from tests import oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns and df.limit(1).count() == 1


def test_every_query_has_known_twin():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    res, _, _ = oracle.check(spark, con, name, SF, entry.queries(), entry.oracle_sql())
    assert res in ("ok", "rows-only", "ok-EMPTY"), res
