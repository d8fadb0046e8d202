"""Every query that has an SQL counterpart equals it; the others return rows."""

import pytest

import __spark_entry__ as entry_module
from inkwell.plans import ORACLES, QUERIES
from tools.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, name):
    ok, note = compare(spark, db, name, SF_DIR)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
